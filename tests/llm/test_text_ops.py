"""Chat formatting, WARC archives, main text of pages and toxicity: round trips, brute force, held-out accuracy."""

import gzip
import hashlib
import io
import json
import random
import re

import numpy as np
import pytest

from firmgraph.llm import chat_format as cf
from firmgraph.llm import toxicity as tx
from firmgraph.llm import warc
from firmgraph.llm import wrapper as wr

NASTY = ["", "a", "<|im_end|>", "<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "<<||>", "\n<|", "ü<|\n|>", "\\<|", "<|newline|>", "<"]


def test_formatting_round_trip():
    turns = [(r, t) for r in ("user", "assistant", "", "a\nb<|newline|>", "<\\|") for t in NASTY]
    text = "".join(cf.format_turn(*x) for x in turns)
    read = list(cf.parse_formatted(text))
    assert [(r, t) for r, t, _, _ in read] == turns
    assert [cf.unescape(text[a:b]) for a, b in cf.loss_spans(text)] == [t for r, t in turns if r == "assistant"]


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        {"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "i", "input": "x", "output": "o"},
        {"instruction": "i", "output": "o"},
        {"prompt": "p", "completion": "c"},
        {"question": "q", "answer": "a"},
        {"text": "t", "role": "user"},
        {"unknown": 1},
    ]
    rows = [(i, json.dumps(r), "x") for i, r in enumerate(records)] + [(8, "no json", "x"), (9, None, "x"), (10, "[1]", "x")]
    got = cf.canonical_turns(spark.createDataFrame(rows, "id int, record string, turns string")).orderBy("id").collect()
    turns = [None if r["schema"]["turns"] is None else [tuple(t) for t in r["schema"]["turns"]] for r in got]
    assert turns[:7] == [
        [("user", "q"), ("assistant", "")],
        [("system", "s"), ("user", "q"), ("assistant", "a")],
        [("user", "i\n\nx"), ("assistant", "o")],
        [("user", "i"), ("assistant", "o")],
        [("user", "p"), ("assistant", "c")],
        [("user", "q"), ("assistant", "a")],
        [("user", "t")],
    ]
    assert turns[7:] == [None] * 4 and got[7]["schema"]["fingerprint"] and got[0]["turns"] == "x"


def test_conversation_digests(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([*NASTY, None])) for c in range(30) for t in range(rng.randint(1, 6))]
    rows += [(None, 1, "assistant", "x"), (None, 0, "user", "y"), (5, 0, "assistant", "tie")]
    got = {r["conv_id"]: tuple(r)[1:] for r in cf.conversation_digests(cf.format_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(x for _, r, x in own if r == "assistant")
        want = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), sum(len(cf.format_turn(r, x)) for _, r, x in own))
        assert got[conv] == want
    assert cf.conversation_digests(cf.format_rows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_archives_read_back(spark):
    rng = random.Random(2)
    big = ["é" * 600, "x" * 999, "y" * 1000, "<p>\r\n\r\nWARC/1.1</p>" * 80]
    rows = [(i, rng.choice(["http://a.b/ü\r\nx", None, "https://c.d/?q=1"]), rng.choice([*big, None, "", "z"]), "x") for i in range(120)] + [(None, None, big[0], "x"), (500, "http://e", big[0], "x"), (500, "http://e", big[0], "x")]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3), archive_bytes=20_000).collect()
    want = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        top = max((r[0] for r in rows if (r[2] or "") == (h or "") and r[0] is not None), default=None)
        again = len(data) >= 1000 and i is not None and i < top
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_normaliser_rewrites_members(tmp_path):
    records = [warc.record_bytes(i, f"http://h/{i}", bytes([i % 256]) * (i * 997 % 5000), hashlib.sha1(b"").hexdigest(), None) for i in range(300)]
    whole = b"".join(records)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(whole))
    target = f"file://{tmp_path}/out/a.warc.gz"
    assert warc.normalise_archive(f"file:{tmp_path}/a.warc.gz", target) == 300
    data = (tmp_path / "out/a.warc.gz").read_bytes()
    assert gzip.decompress(data) == whole
    lines = [x.split("\t") for x in (tmp_path / "out/a.warc.gz.idx").read_text().splitlines()]
    assert [gzip.decompress(data[int(x[1]) : int(x[1]) + int(x[2])]) for x in lines] == records
    assert b"".join(warc.inflated(io.BytesIO(gzip.compress(whole[:100]) + gzip.compress(whole[100:])))) == whole


def test_main_text_of_generated_pages(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r, src in zip(wr.extract_pages(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect()):
        body = re.search(r"<article>(.*)</article>", src["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


PAGES = "page_id long, url string, html string, wrapper string"


def texts_of(spark, rows):
    return {r["page_id"]: r["text"] for r in wr.extract_pages(spark.createDataFrame([(*r, "x") for r in rows], PAGES)).collect()}


def test_wrapper_drops_template(spark):
    def page(i):
        return f"<html><body><div id=top>Site name</div><div><span>Tagline of all pages</span></div>{'<div>extra</div>' * (i % 3)}<div><p>Own text {i}, first.</p><p>Shared lead.</p><p>Own   text {i}&nbsp;&amp;c.</p></div><div>Imprint 2020</div></body></html>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(9)]
    rows += [(20, "http://other/1", page(1)), (21, None, None), (22, "x", ""), (23, "http://q/", "<main><ul><li>a<li>b</ul><form>no</form>t<!-- c --><p>x<div class='comments'>no</div></main>out"), (24, "http://q/", "<p>an < b <unfinished")]
    got = texts_of(spark, rows)
    for i in range(9):
        assert got[i] == f"Own text {i}, first.\n\nShared lead.\n\nOwn text {i} &c."
    assert "Site name" in got[20]
    assert [got[i] for i in range(21, 25)] == ["", "", "a\n\nb\n\nt\n\nx", "an < b <unfinished"]
    assert wr.extract_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_content_is_found_by_induction_alone(spark):
    def page(i):  # neither article nor telling names, and neither menu, notice nor last lines are always the same
        items = "".join(f"<div><a href=/{k}>Topic {k}</a></div>" for k in range(5 + i % 2))
        body = "".join(f"<div>Passage {i} {j} with a number of words that only this page has.</div>" for j in range(1 + i % 7))
        return f"<body><div>{items}</div><div>Day {i % 5}</div><section><div><h2>Headline {i}</h2>{body}<div>Shared last line.</div></div></section><div>Seen {i} times</div></body>"

    got = texts_of(spark, [(i, f"http://h.example/{i}", page(i)) for i in range(60)] + [(60, "http://h.example/0", page(0))])
    for i in range(60):
        parts = [f"Passage {i} {j} with a number of words that only this page has." for j in range(1 + i % 7)]
        assert got[i] == "\n\n".join([f"Headline {i}", *parts, "Shared last line."])
    assert got[60] == got[0]


def test_shared_text_of_an_article_stays(spark):
    rows = [(i, f"http://h/{i}", f"<body><nav>m</nav><article><h1>Heading {i}</h1><p>Common lead paragraph.</p><p>Own paragraph {i}.</p></article><footer>f {i}</footer></body>") for i in range(5)]
    got = texts_of(spark, rows)
    assert got == {i: f"Heading {i}\n\nCommon lead paragraph.\n\nOwn paragraph {i}." for i in range(5)}


def test_heading_beside_the_container_stays(spark):
    rows = [(i, f"http://h/{i}", f"<body><div>Menu</div><h1>Heading {i}</h1><div>{'<p>Own words %d.</p>' % i * 9}</div><div>Imprint</div></body>") for i in range(5)]
    got = texts_of(spark, rows)
    assert all(got[i] == "\n\n".join([f"Heading {i}", *[f"Own words {i}."] * 9]) for i in range(5))


def test_layouts_of_a_host_have_their_own_wrappers(spark):
    a = lambda i: f"<body><div class=x>Menu of a</div><div class=y><p>First kind {i}</p></div></body>"
    b = lambda i: f"<body><section id=z><div><p>Second kind {i}</p></div><div>Box of b</div></section></body>"
    got = texts_of(spark, [(i, f"http://h/{i}", (a if i % 2 else b)(i)) for i in range(40)])
    assert got == {i: ("First kind" if i % 2 else "Second kind") + f" {i}" for i in range(40)}


def test_every_layout_of_a_host_has_its_wrapper(spark):
    """Layouts with less than a sixteenth of a host's pages were read by the wrapper of its most frequent one."""
    # twenty layouts of four pages: menu, content and imprint have their places by the number of boxes before them
    page = lambda k, i: f"<body>{'<div>Box</div>' * (k % 4)}<div id=m{k}>Menu {k}</div><div id=c{k}><p>Own {k} {i}.</p></div><section><div>Shared {k} lines, which all pages of the layout have</div></section></body>"
    rows = [(100 * k + i, f"http://h/{k}/{i}", page(k, i)) for k in range(20) for i in range(4)]
    # the most frequent layout, and pages of rare ones: with one more box, of another kind, with an article
    plain = lambda i, more="": f"<body><div>Menu</div>{more}<table><tr><td>Words of page {i}.</td></tr></table><div>Imprint of all</div></body>"
    rows += [(i, f"http://h/{i}", plain(i)) for i in range(5000, 5030)] + [(6000, "http://h/x", plain(6000, "<section></section>"))]
    rows += [(6001, "http://h/y", "<body><section><p>A long text that stands apart.</p></section><table><tr><td>small</td></tr></table></body>")]
    got = texts_of(spark, rows)
    assert {i: got[i] for i in got if i < 5000} == {100 * k + i: f"Own {k} {i}." for k in range(20) for i in range(4)}
    assert {i: got[i] for i in got if 5000 <= i <= 6000} == {i: f"Words of page {i}." for i in [*range(5000, 5030), 6000]}
    assert got[6001] == "A long text that stands apart.\n\nsmall"


def test_deep_wide_and_long_pages(spark):
    deep = lambda i: "<div>" * 2000 + f"<p>deep {i}</p>" + "</div>" * 2000
    rng = random.Random(5)
    wide = lambda i: "<body><div>menu</div><div>" + "".join(rng.choice(["<p>a</p>", "<span>b</span>", "<p>c<b>d</b></p>", f"<p>{'<i>e</i>' * rng.randint(0, 40)}</p>"]) for _ in range(10_000)) + f"<p>wide {i}</p></div></body>"
    rows = [(i, "http://deep/", deep(i)) for i in range(20)] + [(100 + i, "http://wide/", wide(i)) for i in range(4)]
    rows += [(200, "http://long/", "<p>" + "word " * 500_000)] + [(300 + i, "http://same/", "<p>the same page</p>") for i in range(5)]
    got = texts_of(spark, rows)
    assert all(got[i] == f"deep {i}" for i in range(20))
    assert all(got[100 + i].endswith(f"wide {i}") and not got[100 + i].startswith("menu") and got[100 + i].count("\n\n") > 5000 for i in range(4))
    assert len(got[200]) == 2_499_999 and {got[300 + i] for i in range(5)} == {"the same page"}


def test_long_lists_are_matched_in_order():
    rng = random.Random(6)

    def row(k):
        n = wr.Node("div")
        for t in k:
            n.children.append(wr.Node(t))
        return n

    kinds = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(3000)]
    x, y = wr.Node("r"), wr.Node("r")
    x.children = [row(k) for k in kinds]
    y.children = [row(k) for i, k in enumerate(kinds) if i % 50] + [row("aaaaaaab")]
    wr.shapes(x), wr.shapes(y)
    place = {id(n): i for i, n in enumerate(y.children)}
    pairs = [(a, b) for a, b in wr.align(x, y) if id(b) in place]
    at = {id(n): i for i, n in enumerate(x.children)}
    spots = [(at[id(a)], place[id(b)]) for a, b in pairs]
    assert len(spots) > 2800 and len({i for i, _ in spots}) == len(spots)
    ordered = [j for _, j in sorted(spots)]
    assert ordered == sorted(ordered) and len(set(ordered)) == len(ordered)


def test_tree_matching_is_largest():
    rng = random.Random(4)

    def tree(depth):
        n = wr.Node(rng.choice("ab"))
        n.children = [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
        return n

    def brute(a, b):
        if a.tag != b.tag:
            return 0
        m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children):
            for j, y in enumerate(b.children):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute(x, y))
        return 1 + m[-1][-1]

    for _ in range(300):
        a, b = tree(3), tree(3)
        b.tag = a.tag
        wr.shapes(a), wr.shapes(b)
        pairs = wr.align(a, b)
        assert len(pairs) == brute(a, b) and all(x.tag == y.tag for x, y in pairs)


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(900):
        lang, bad = rng.choice(["en", "de"]), rng.random() < 0.25
        w = [rng.choice(words) for _ in range(rng.randint(1, 80))]
        for _ in range(3 if bad else 0):
            w.insert(rng.randint(0, len(w)), rng.choice(["nasty", "vile"]) if lang == "en" else "grob" + rng.choice("abcdefgh") + rng.choice("xyz"))
        rows.append((i, " ".join(w), lang, "x"))
        labels.append((i, int(bad)))
    rows += [(5000, None, "en", "x"), (5001, "", None, "x"), (None, "nasty vile nasty", "en", "x")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    model = tx.fit(docs, known)
    scored = tx.score(docs, model).withColumn("held", tx.remainder() == 0).collect()
    right = [(r["score"] >= 0.5) == bool(dict(labels)[r["doc_id"]]) for r in scored if r["held"] and r["doc_id"] in dict(labels)]
    assert len(right) > 100 and np.mean(right) > 0.97
    by = {r["doc_id"]: r["score"] for r in scored}
    assert by[5000] == by[5001] < 0.5 < by[None]
    assert tx.score(docs.limit(0), model).count() == 0
    assert tx.fit(docs, known.limit(0)).constant == 0.0
    flipped = tx.score(docs.select("doc_id", "text"), tx.fit(docs, known.filter("toxic = 1")))
    assert flipped.filter("score != 1").count() == 0


def test_forward_pass_is_that_of_plain_loops():
    rng = np.random.default_rng(3)
    model = tx.Model(seed=2)
    texts = [rng.integers(0, tx.BUCKETS, n) for n in (0, 1, 2, 7, 40, 3000)]
    stems = [rng.integers(0, tx.BUCKETS, len(t)) for t in texts]
    got = model.logits(tx.Flat.of(*(np.concatenate(x) - tx.SHORT for x in (texts, stems)), np.array([len(t) for t in texts])))
    for w, s, logit in zip(texts, stems, got):
        x = [model.words[a].astype(float) + model.stems[b] for a, b in zip(w, s)] + [np.zeros(tx.DIM)] * (tx.PAD + 1)
        want, at = float(model.shift), 0
        for k in tx.WIDTHS:
            for f in range(tx.FILTERS):
                best = max(sum(float(x[i + j] @ model.filters[k][j][:, f]) for j in range(k)) for i in range(len(w) + 1))
                want += max(best + float(model.bias[k][f]), 0) * float(model.out[at])
                at += 1
        assert abs(want - logit) < 1e-4


def test_fit_sample_is_bounded_in_words(spark):
    docs = spark.createDataFrame([(i, f"nasty{i % 2} " * (50_000 if i == 7 else 20), "en") for i in range(200)], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 1), (3, 0)], "doc_id long, toxic int")
    model = tx.fit(docs, known, epochs=2, max_words=2000)
    got = {r["doc_id"]: r["score"] for r in tx.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in range(200))


@pytest.mark.parametrize("scores", [[0.9, 0.8, 0.2, 0.1], [0.9, 0.3, 0.2, 0.1]])
def test_threshold_stands_in_the_gap(scores):
    toxic = np.array([1.0, 1.0, 0.0, 0.0])
    assert scores[2] < tx.best_threshold(np.array(scores), toxic) < scores[1]


def test_thresholds_rest_on_all_labels(spark):
    import zlib

    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    rng = random.Random(9)
    words = [f"w{i}" for i in range(50)]
    rows, labels = [], []
    tried = [i for i in range(70_000) if fold(i) == 1][:12_000]
    for at, i in enumerate([*tried, *[i for i in range(2000) if fold(i) > 1]]):
        lang = "rare" if at % 12 == 0 else None if at % 12 == 1 else "en"
        bad = at % 600 == 0 or lang is None and at % 5 == 0 if at < len(tried) else at % 2
        rows.append((i, " ".join(rng.choices(words, k=4) + ["nasty"] * bool(bad)), lang))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = tx.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), epochs=1)
    assert set(model.thresholds) == {None, "rare"}
    model.thresholds[None] = 0.25
    got = {r["lang"]: r["t"] for r in docs.select("lang", tx.threshold_of(model).alias("t")).distinct().collect()}
    assert got == {None: 0.25, "rare": model.thresholds["rare"], "en": 0.5}
