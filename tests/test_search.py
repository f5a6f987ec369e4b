"""Searches in the registry: what can be asked, what a step does, and the gates around it."""

from pyspark.sql import functions as F

from firmgraph.operators import search

ENTRY = "place long, corporate_number string, name string, location string, close_date string, business_items array<string>, business_summary string, employee_number string, company_url string"
KNOWN = "company_id string, corporate_number string, domain string, normalized_name string, address_key string, crawl_status string"


def test_criteria_and_their_words():
    asked, wrong = search.criteria({"prefecture": "大阪府", "city": "", "keyword": "ねじ", "requested": "80", "employee_min": "20", "require_website": "off", "industry": "none", "employee_max": "-1", "x": "1"})
    assert asked == {"requested": 80, "require_website": False, "require_recruiting": False, "prefecture": "大阪府", "keyword": "ねじ", "employee_min": 20}
    assert wrong == ["employee_max", "industry", "x"]
    assert search.described(asked) == '大阪府 / "ねじ" / 20〜名 / 80社'
    assert search.criteria({})[0]["requested"] == 50 and search.criteria({"requested": "501"})[1] == ["requested"]


def test_a_step_stops_when_enough_are_registered(spark):
    entry = lambda i, name="株式会社甲", where="大阪府堺市1", closed=None, url="https://a.jp", number=None: (i, number or str(1000000000000 + i), name, where, closed, [], None, None, url)
    rows = [entry(0, url="https://x0.jp"), entry(1, " "), entry(2, "桜井財産区"), entry(3, "株式会社乙", url=None), entry(4, "株式会社丙", url="https://x4.jp"), entry(5, "株式会社丙", url="https://x4.jp", number="123"), entry(6, "株式会社丁", url="https://x6.jp"), entry(7, "株式会社戊", url="https://x7.jp")]
    df = spark.createDataFrame(rows, ENTRY)
    known = spark.createDataFrame([("c1", str(1000000000000), None, None, None, "not_crawled")], KNOWN)
    items, crawls = search.search_step(df, known, {"requested": 3, "require_website": True}, page=4, pages=2)
    got = {r["place"]: (r["status"], r["reason"]) for r in items.collect()}
    assert got == {0: ("duplicate", "corporate_number"), 2: ("skipped", "public body"), 3: ("skipped", "no site"), 4: ("new", None), 5: ("duplicate", "domain")}
    assert {r["company_id"] for r in crawls.collect()} == {"c1", "4"}
    items, _ = search.search_step(df, known, {"requested": 9}, cursor=2, page=4, pages=1)
    assert sorted(r["place"] for r in items.collect()) == [4, 5, 6, 7]


def test_addresses_and_robots(spark):
    rows = [("本社 大阪府堺市中区1-2-3。 大阪府堺市中区1-2-3", "大阪府"), ("東成区中本1-2-3 です", "大阪府"), ("東成区中本1-2-3 です", None), (None, "大阪府")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, p string").select(search.address_like(F.col("t"), F.col("p"))).collect()]
    assert got == [["大阪府堺市中区1-2-3"], ["東成区中本1-2-3"], [], []]
    links = spark.createDataFrame([("a", "https://a/x/1"), ("a", "https://a/y"), ("b", "https://b/x"), (None, "https://c/x")], "host string, url string")
    robots = spark.createDataFrame([("a", "User-agent: *\nDisallow: /x/\nCrawl-delay: 3"), ("b", None)], "host string, body string")
    assert sorted((r["url"], r["allowed"], r["delay_ms"]) for r in search.allowed(links, robots, "bot").collect()) == [("https://a/x/1", False, 3000), ("https://a/y", True, 3000), ("https://b/x", True, None), ("https://c/x", True, None)]
