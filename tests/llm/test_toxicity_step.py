"""One training step against finite differences of the loss."""

import copy

import numpy as np

from firmgraph.llm import toxicity as tox


def test_a_step_goes_down_the_gradient():
    rng = np.random.default_rng(3)
    lengths = np.array([5, 1, 9, 4])
    n = int(lengths.sum())
    flat = tox.Flat.of(rng.integers(0, 50, n), rng.integers(0, 40, n), lengths)
    toxic = np.array([1, 0, 1, 0], np.float32)
    model = tox.Model(seed=5)
    for name in ("words", "stems", "out"):
        setattr(model, name, getattr(model, name).astype(np.float64) * (6 if name != "out" else 1) + (rng.normal(0, 0.2, getattr(model, name).shape) if name == "out" else 0))
    model.filters = {k: v.astype(np.float64) for k, v in model.filters.items()}
    model.bias = {k: v.astype(np.float64) + 0.7 for k, v in model.bias.items()}
    model.shift = np.float64(model.shift)

    def loss(m):
        z = m.logits(flat)
        return float((np.log1p(np.exp(z)) - toxic * z).mean())

    rate, moved = 1e-3, copy.deepcopy(model)
    moved.step(flat, toxic, rate)
    places = [("out", None, (i,)) for i in (0, 3, len(model.out) - 1)]
    places += [(t, None, (int(b), d)) for t, used in (("words", flat.words), ("stems", flat.stems)) for b in np.unique(used)[:6] if b < tox.BUCKETS for d in (0, 2)]
    places += [("bias", k, (f,)) for k in tox.WIDTHS for f in (0, 1)] + [("filters", k, (j, d, f)) for k in tox.WIDTHS for j in range(k) for d in (0, 3) for f in (0, 2)]
    of = lambda m, name, k: getattr(m, name) if k is None else getattr(m, name)[k]
    told = []
    for name, k, at in places:
        sides = []
        for h in (1e-5, -1e-5):
            other = copy.deepcopy(model)
            of(other, name, k)[at] += h
            sides.append(loss(other))
        slope = (sides[0] - sides[1]) / 2e-5
        stepped = (of(model, name, k)[at] - of(moved, name, k)[at]) / rate
        assert abs(stepped - slope) < 1e-5 + 1e-3 * abs(slope), (name, k, at)
        told.append(abs(slope) > 1e-6)
    assert sum(told) > len(told) // 3 and loss(moved) < loss(model)
    sides = []
    for h in (1e-5, -1e-5):
        other = copy.deepcopy(model)
        other.shift += h
        sides.append(loss(other))
    assert abs((model.shift - moved.shift) / rate - (sides[0] - sides[1]) / 2e-5) < 1e-5
