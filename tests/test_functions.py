"""Normalisation and classification functions: hand-written cases."""

import pytest
from pyspark.sql import functions as F

from firmgraph.functions import scoring, text, urls
from firmgraph.operators import crawl, resolve


def values(spark, f, *inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, s string").select("i", f(F.col("s")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


CASES = [
    (text.company_name, [("株式会社 ＡＢＣ製作所", "abc製作所"), ("ABC製作所 株式会社", "abc製作所"), ("（株）ABC・製作所", "abc製作所"), ("ABC Co., Ltd.", "abc")]),
    (text.address, [("大阪府大阪市中央区本町１丁目２番３号", "大阪府大阪市中央区本町1-2-3"), ("〒541-0053 大阪府大阪市中央区本町一丁目2-3 ", "大阪府大阪市中央区本町1-2-3"), ("本町十二丁目3番地", "本町12-3"), (None, None), ("", None)]),
    (text.city, [("大阪府大阪市中央区本町1-1", "大阪市中央区"), ("北海道河東郡音更町木野1", "河東郡音更町"), ("東京都千代田区丸の内1", "千代田区"), ("nowhere", None)]),
    (text.prefecture, [("京都府京都市", "京都府"), ("東京都", "東京都"), ("x", None)]),
    (text.phone, [("０６−１２３４−５６７８", "06-1234-5678"), ("123", None), ("(06)12345678", "0612345678")]),
    (text.employee_count, [("１２０名", 120), ("1,200", 1200), ("0", None), ("none", None)]),
    (text.corporate_number, [("１２３４５６７８９０１２３", "1234567890123"), ("12", None)]),
    (text.company_core, [("株式会社長津製作所", "長津"), ("アオイ自動車工業", "アオイ"), ("大阪工業", None)]),
    (text.normal_date, [("2020年3月5日", "2020-03-05"), ("1999/12", "1999-12-01"), ("2001", "2001-01-01"), ("x", None)]),
    (text.industry, [("金属加工業", "manufacturing"), ("倉庫と配送", "logistics"), ("x", None)]),
    (text.emails, [("Info@firm.co.jp a.png@x.png info@example.com sales [at] firm.jp", ["info@firm.co.jp", "sales@firm.jp"])]),
    (text.phones, [("TEL 06-1234-5678, 〒541-0053, 00-1234-5678", ["06-1234-5678"])]),
    (text.redact_secrets, [("x postgres://u:p@h/d https://a.b/c y", "x *** *** y")]),
    (urls.normal_url, [("Example.CO.JP", "https://example.co.jp"), ("https://example.jp/?utm_source=x#top", "https://example.jp"), ("https://example.jp/company/?ref=1&utm_medium=y", "https://example.jp/company/?ref=1"), ("mailto:a@b", None), (" ", None), (None, None)]),
    (urls.host, [("http://www.Example.co.jp:8080/about", "example.co.jp")]),
    (urls.site_reject_reason, [("https://www.indeed.com/x", "non-official domain"), ("https://pref.osaka.jp/", "non-official domain"), ("https://a.or.jp/", "organisation domain"), ("https://x.jp/1234567890123.html", "corporate database"), ("https://x.jp/company_list/654/", "directory page"), ("https://x.jp/a.pdf", "not html"), ("https://firm.co.jp/company/", None), (None, "no url")]),
    (urls.is_record_page, [("https://x.jp/company/4630/", True), ("https://x.jp/a.php?n=4644", True), ("https://x.jp/company/outline.html", False)]),
    (urls.is_root, [("https://x.jp/", True), ("x.jp", True), ("https://x.jp/a", False), ("https://x.jp/?a=1", False)]),
    (urls.canonical_key, [("https://www.x.jp/a/index.html?b=2&a=1#c", "https://x.jp/a?a=1&b=2")]),
]


@pytest.mark.parametrize("f,cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_cases(spark, f, cases):
    assert values(spark, f, *[a for a, _ in cases]) == [b for _, b in cases]


def test_normal_forms_are_stable(spark):
    for f in (text.company_name, text.address, urls.normal_url):
        first = values(spark, f, *[a for g, cases in CASES for a, _ in cases if g is f])
        assert values(spark, f, *first) == first


def test_address_in_text(spark):
    def one(address, page):
        df = spark.createDataFrame([(address, page)], "a string, t string")
        return df.select(text.appears(text.address_keys(F.col("a")), text.address(F.col("t"))).alias("v")).first()["v"]

    where = "大阪府東大阪市長田中1丁目2番3号"
    assert one(where, "所在地 〒577-0013 東大阪市長田中1-2-3")
    assert not one(where, "大阪市中央区本町1-2-3")
    assert one("兵庫県三木市吉川町鍛治屋1", "三木市吉川町鍛冶屋1番地")
    assert not one(None, "x")


def test_similarity_and_scores(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    lit = F.lit
    assert one(text.similarity(lit("abcdefg"), lit("abcdefg"))) == 1
    assert one(text.similarity(lit("山田製作所"), lit("山田製作"))) >= 0.8
    assert one(text.similarity(lit("山田製作所"), lit("鈴木商店"))) < 0.4
    assert one(text.names_related(lit("山田製作所"), lit("山田製作所大阪"))) and not one(text.names_related(lit(""), lit("a")))
    assert [one(scoring.rank_from_score(lit(x))) for x in (75, 74, 55, 35, 34)] == ["A", "B", "B", "C", "D"]
    assert one(scoring.rank_from_score(lit(None).cast("int"))) is None
    assert one(scoring.range_of(lit(300))) == "300-999" and one(scoring.range_of(lit(0))) is None
    assert one(scoring.analysis_priority(lit(False), lit(True), lit(9), lit(9), lit(9), lit(99))) == 100
    assert round(one(scoring.token_cost(lit(457379), lit(74865), lit(10386), lit(90012), lit(5.0), lit(25.0))), 2) == 4.27
    gate = scoring.site_confidence(lit(None).cast("string"), lit("web"), lit(True), lit(False), lit(True), lit(False), lit(True), lit(False), lit(False), lit(False), lit(True), lit(True))
    assert one(gate)["confidence"] == 65
    kind = urls.classify_page(lit("https://x.jp/recruit/"), lit("採用情報"), lit(None).cast("string"), lit("https://x.jp"))
    assert tuple(one(kind)) == ("recruit", 105)
    assert tuple(one(urls.classify_page(lit("https://x.jp/"), lit(""), lit(""), lit("https://www.x.jp")))) == ("top", 110)
    assert one(scoring.recruit_target(lit(True), lit(True), lit(True), lit(False), lit(1200), lit(0), lit(False))) == "active_recruit"
    assert one(scoring.auto_review(lit(None).cast("string"), lit("https://x.jp"), lit(59)))["action"] == "reject"


def test_crawled_site(spark):
    html = """<html><head><title> 山田 </title><meta name="description" content="金属加工"></head><body><script>x()</script><main><p>営業目的のお問い合わせはお断りします。</p>
    <p>sales@yamada.co.jp TEL 06-1234-5678</p><form><input name=a><textarea></textarea></form></main><a href="/recruit/">採用情報</a><a href="https://x.com/share?u">s</a><a href="https://x.com/yamada?x=1">x</a></body></html>"""
    pages = spark.createDataFrame([("https://yamada.co.jp/contact/", html), ("https://yamada.co.jp/", "<p>top")], "url string, html string").withColumn("host", urls.host(F.col("url")))
    row = crawl.site_summary(crawl.page_features(pages), "host").first()
    assert (row["email"], row["phone"], row["x"], row["sales_contact_allowed"], row["contact_form"]) == ("sales@yamada.co.jp", "06-1234-5678", "https://x.com/yamada", "false", "https://yamada.co.jp/contact/")
    assert crawl.recruiting_signal(crawl.page_features(pages), "host").first()["signal"] == "yes"
    page = crawl.page_features(pages).filter("url LIKE '%contact%'").first()["page"]
    assert page["title"] == "山田" and page["text"].startswith("金属加工\n営業目的") and page["field_count"] == 2


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 != 19], "a long, b long")
    got = {r["id"]: r["label"] for r in resolve.connected_components(edges).collect()}
    assert got == {i: i - i % 20 for i in range(60)}
