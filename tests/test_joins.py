"""Containment joins and the assignment of sites, against brute force."""

import random

from firmgraph.operators import containment
from firmgraph.operators.containment import contained
from firmgraph.operators.discovery import assign_sites


def test_containment_finds_all_pairs(spark):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcd 日本株。\n") for _ in range(n))
    texts = [(i, some(rng.choice([0, 3, 64, 65, 400]))) for i in range(40)] + [(40, None), (41, "aaaa" * 100), (42, "x" * 63 + "needle" + "y" * 200)]
    needles = [(i, some(rng.randint(1, 5))) for i in range(30)] + [(100 + i, t[5 : 5 + rng.randint(1, 180)]) for i, t in texts[:40] if len(t) > 300]
    needles += [(200, None), (201, ""), (202, "needle"), (203, "needle"), (204, "aaaaa"), (205, "absent"), (206, texts[41][1]), (207, texts[41][1] + "a")]
    got = {tuple(r) for r in contained(spark.createDataFrame(needles, "n long, name string"), spark.createDataFrame(texts, "t long, body string"), "n", "name", "t", "body").collect()}
    assert got == {(n, t) for n, name in needles for t, body in texts if name and body and name in body}
    empty = spark.createDataFrame([], "n long, name string")
    assert contained(empty, spark.createDataFrame(texts, "t long, body string"), "n", "name", "t", "body").collect() == []


def test_places_without_a_sought_gram_make_no_rows(spark, monkeypatch):
    """Each place of each text was a row of two joins; now only more names than are sent to tasks are joined. Both find the same pairs."""
    texts = [(i, t) for i, t in enumerate(["the needle in hay", "nee" * 50, "日本株式会社の株", "\U0001f600" * 9 + "x needles", "a" * 300 + "b", "", None])]
    names = ["needle", "neen", "日本株式", "\U0001f600\U0001f600\U0001f600x n", "a" * 200 + "b", "株", "zzzz", "needle in hay and more", "株式会社", *(chr(97 + i) + chr(98 + j) for i in range(9) for j in range(9))]
    want = {(n, t) for n, name in enumerate(names) for t, body in texts if body and name in body}
    made, grams = [], containment._grams
    monkeypatch.setattr(containment, "_grams", lambda *a: made.append(1) or grams(*a))
    monkeypatch.setattr(containment, "AT_ONCE", 7)
    assert [i for at, _ in containment._Grams(["need", "hay!"], 4).places("a needle, hay, needs") for i in at.tolist()] == [2, 15]
    found = lambda: [tuple(r) for r in contained(spark.createDataFrame(list(enumerate(names)), "n long, name string"), spark.createDataFrame(texts, "t long, body string"), "n", "name", "t", "body").collect()]
    assert sorted(found()) == sorted(want) and not made
    monkeypatch.setattr(containment, "SENT", 0)
    assert sorted(found()) == sorted(want) and made


def assigned(rows):
    """Companies in the order of their scores take what is left; scores are the same on both sides, so this is the stable answer."""
    best = {}
    for c, d, s, o in rows:
        if d is not None and s is not None:
            best[c, d] = min(best.get((c, d), (1, 0)), (-s, o))
    taken, mine = {}, {}
    order = lambda c: sorted((v, d) for (x, d), v in best.items() if x == c)
    free, at = [c for c, *_ in rows], {}
    free = sorted(set(free))
    while free:  # proposals one by one
        c = free.pop()
        options = order(c)
        k = at.get(c, 0)
        if k >= len(options):
            continue
        at[c] = k + 1
        (less, _), d = options[k]
        if d in taken and taken[d] < (less, c):
            free.append(c)
            continue
        if d in taken:
            loser = taken[d][1]
            mine.pop(loser)
            free.append(loser)
        taken[d], mine[c] = (less, c), d
    out = {}
    for c in {r[0] for r in rows}:
        options = order(c)
        first = options[0][1] if options else None
        status = "no_website" if first is None else "verified" if mine.get(c) == first else "needs_review"
        out[c] = (mine.get(c), status, taken[first][1] if status == "needs_review" else None)
    return out


def test_one_company_for_each_domain(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(60), rng.choice([f"d{rng.randrange(25)}", "hot.jp", None]), rng.choice([None, *range(40, 60)]), i) for i in range(260)]
    rows += [(100 + i, "hot.jp", 50, i) for i in range(40)]
    got = assign_sites(spark.createDataFrame(rows, "company_id long, domain string, score int, ord long")).collect()
    assert {r["company_id"]: (r["domain"], r["status"], r["conflict"]) for r in got} == assigned(rows) and len(got) == len({r[0] for r in rows})
    held = [r["domain"] for r in got if r["domain"]]
    assert len(held) == len(set(held))
