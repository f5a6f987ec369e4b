"""Crawls in rounds against a queue for each host."""

import random

from pyspark.sql import functions as F

from firmgraph.functions import urls
from firmgraph.operators import crawl


def simulated(homes, links, kinds, titles, most):
    """A queue for each host: kinds tells the kind and priority of a (url, text, title)."""
    out = []
    for site, home in sorted(homes.items()):
        queue, queued, counts, turn = [(home, None, 1000)], {home.rstrip("/")}, {}, 0
        while queue and turn < most:
            queue.sort(key=lambda q: -q[2])
            url, said, priority = queue.pop(0)
            key = url.rstrip("/")
            turn += 1
            kind = "top" if turn == 1 else kinds[url, said, titles.get((site, key))][0]
            counts[kind] = counts.get(kind, 0) + 1
            out.append((site, turn, key, kind))
            for to, text in links.get((site, key), []):
                k, p = kinds[to, text, None]
                if to.rstrip("/") in queued or to.endswith(".pdf") or (k == "other" and len(queue) > most * 2) or counts.get(k, 0) >= crawl.KIND_CAPS.get(k, crawl.KIND_CAP):
                    continue
                queued.add(to.rstrip("/"))
                queue.append((to, text, p))
    return sorted(out)


def test_equals_a_queue_for_each_host(spark):
    rng = random.Random(6)
    names = ["recruit", "company", "news", "blog", "x", "y", "z", "contact", "service", "staff", "a.pdf", "privacy"]
    texts = [None, "採用情報", "会社概要", "お知らせ", "その他"]
    homes, links, titles = {}, {}, {}
    for s in range(4):
        site = f"s{s}.jp"
        homes[site] = f"https://{site}/"
        pages = [f"https://{site}/{n}{i}" if not n.endswith("pdf") else f"https://{site}/{i}{n}" for n in names for i in range(3)]
        for p in [homes[site], *pages]:
            links[site, p.rstrip("/")] = [(q, rng.choice(texts)) for q in rng.sample(pages, rng.randint(0, 14))]
            titles[site, p.rstrip("/")] = rng.choice(["お知らせ", "会社概要", "ようこそ"])
    wanted = {(u, t, None) for ls in links.values() for u, t in ls} | {(u, t, x) for ls in links.values() for u, t in ls for x in titles.values()}
    asked = spark.createDataFrame(sorted(wanted, key=str), "url string, text string, title string")
    found = asked.select("url", "text", "title", urls.classify_page(F.col("url"), F.col("text"), F.col("title"), urls.root_url(F.col("url"))).alias("k")).collect()
    kinds = {(r["url"], r["text"], r["title"]): (r["k"]["page_type"], r["k"]["priority"]) for r in found}
    rows = [(site, key, u, t, at) for (site, key), ls in links.items() for at, (u, t) in enumerate(ls)]
    got = crawl.crawl_order(spark.createDataFrame(list(homes.items()), "site string, url string"), spark.createDataFrame(rows, "site string, key string, url string, link_text string, at int"), spark.createDataFrame([(s, k, t) for (s, k), t in titles.items()], "site string, key string, title string"), 7).collect()
    assert sorted((r["site"], r["turn"], r["key"], r["kind"]) for r in got) == simulated(homes, links, kinds, titles, 7)
    assert max(r["turn"] for r in got) <= 7
