"""Discovery stages, charset, outreach checks: hand-written cases."""

import pytest
from pyspark.sql import functions as F

from firmgraph.functions.names import clean_company_name, is_plausible_company
from firmgraph.operators import discovery, outreach
from firmgraph.sources import charset


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("title,name", [("株式会社山田製作所 | 大阪の金属加工", "株式会社山田製作所"), ("株式会社山田製作所の求人情報", "株式会社山田製作所"), ("株式会社山田製作所 公式サイト", "株式会社山田製作所"), ("大阪の加工業ならイトウ精工株式会社", "イトウ精工株式会社"), ("「「光電気工業」へ」", "光電気工業"), ("アルミ加工・精密加工・微細加工の中田製作所", "中田製作所"), ("大阪府豊中市にある金属切削加工の株式会社トーシン", "株式会社トーシン")])
def test_clean_names(spark, title, name):
    assert one(spark, clean_company_name(F.col("s")), s=title) == name


@pytest.mark.parametrize("name,good", [("求人ランキング2026", False), ("金属加工とは", False), ("あ", False), ("株式会社山田製作所", True), ("株式会社会社情報", False), ("大阪府電気工事工業組合", False), ("金属加工 大阪", False), ("中田製作所", True), ("工場 [3社]", False)])
def test_plausible_names(spark, name, good):
    assert one(spark, is_plausible_company(F.col("s")), s=name) is good


def test_candidates(spark):
    rows = [("株式会社山田製作所 | 公式", "大阪府東大阪市長田中1丁目2番", "06-1234-5678", "www.yamada.co.jp/?utm_source=x", "1234567890123", 150), ("求人ランキング", None, None, None, None, 10)]
    got = discovery.candidates(spark.createDataFrame(rows, "name string, address string, phone string, website string, corporate_number string, source_confidence int")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["name"], r["normalized_name"], r["prefecture"], r["city"], r["domain"], r["source_confidence"]) == ("株式会社山田製作所", "山田製作所", "大阪府", "東大阪市", "yamada.co.jp", 100)
    assert one(spark, discovery.criteria_mismatch("京都府", None), prefecture="大阪府", address="x") == "other prefecture"
    assert one(spark, discovery.criteria_mismatch("大阪府", None), prefecture="大阪府", address="x") is None


def test_official_sites(spark):
    companies = spark.createDataFrame([("a", "株式会社山田製作所", "大阪府東大阪市長田中1-2-3", None, None, None), ("b", "無名株式会社", None, None, None, None)], "company_id string, name string, address string, phone string, corporate_number string, representative_name string")
    own = "株式会社山田製作所 会社概要 東大阪市長田中1-2-3"
    sites = spark.createDataFrame([("a", "https://yamada.example.jp/", "web", "株式会社山田製作所", None, own, "株式会社山田製作所", own, 1), ("a", "https://portal.example.jp/company/4630/", "web", "株式会社山田製作所", None, own, "名簿", "いろいろ", 0), ("a", "https://www.facebook.com/x", "gbiz", None, None, None, None, None, 2)], "company_id string, url string, source string, title string, snippet string, page_text string, root_title string, root_text string, ord int")
    got = {r["company_id"]: r for r in discovery.official_sites(companies, sites).collect()}
    assert (got["a"]["url"], got["a"]["confidence"], got["a"]["status"]) == ("https://yamada.example.jp/", 65, "verified")
    assert (got["b"]["url"], got["b"]["status"]) == (None, "no_website")


def test_verification(spark):
    rows = [("山田製作所", "大阪府東大阪市長田中1-2-3", "06-1234-5678", "y.jp", "1234567890123", ["gbiz", "web_search"], "株式会社山田製作所", "東大阪市長田中1-2-3 TEL 06-1234-5678", 70), ("他社", None, None, None, None, ["web_search"], None, None, None)]
    df = spark.createDataFrame(rows, "normalized_name string, address string, phone string, domain string, corporate_number string, sources array<string>, site_title string, site_text string, site_confidence int")
    assert [(r["verification"]["score"], r["verification"]["status"]) for r in discovery.verified(df).orderBy("phone").collect()] == [(0, "rejected"), (100, "verified")]


def test_reviews(spark):
    found = spark.createDataFrame([(1, "needs_review", None, None, None), (2, "needs_review", "https://a", None, None)], "candidate_id int, status string, website string, reject_reason string, reviewed_by string")
    actions = spark.createDataFrame([(1, "reject", None, "no", "u", 1), (1, "approve", "b.jp", None, "v", 2)], "candidate_id int, action string, website string, reason string, reviewed_by string, at int")
    got = [tuple(r) for r in discovery.apply_reviews(found, actions).orderBy("candidate_id").collect()]
    assert got == [(1, "verified", "https://b.jp", None, "v"), (2, "needs_review", "https://a", None, None)]


@pytest.mark.parametrize("name", ["cp932", "euc-jp", "utf-8"])
def test_charsets(spark, name):
    page = "<meta charset=shift_jis>株式会社丸山商会のホームページへようこそ"
    df = spark.createDataFrame([(bytearray(page.encode(name)), None), (None, None), (bytearray(b"plain"), "text/html; charset=x-sjis")], "body binary, content_type string")
    got = [r["decoded"] for r in charset.decoded(df).collect()]
    assert got[0]["text"] == page and got[1]["text"] is None and tuple(got[2]) == ("plain", "shift_jis")


def test_contexts(spark):
    rows = [("a", "H", "news", "n", "u2", "x" * 1000), ("a", "H", "top", None, "u1", "Q" * 2000), ("a", "H", "privacy", "p", "u3", " "), ("a", "H", "company", "c", "u4", "z" * 5000)]
    df = spark.createDataFrame(rows, "company_id string, header string, page_type string, title string, url string, body string")
    whole = outreach.contexts(df).first()
    assert whole["urls"] == ["u1", "u4", "u2"] and whole["text"].count("Q") == 1200 and whole["text"].count("x") == 400
    cut = outreach.contexts(df, 2000).first()
    assert cut["urls"] == ["u1", "u4"] and len(cut["text"]) < 2000


def test_answers_and_drafts(spark):
    reply = 'Sure:\n```json\n{"recruiting_status": "maybe", "confidence": 40, "employee_count_observed": 0, "evidence": [{"category": "x", "evidence_text": " "}, {"category": "y", "evidence_text": "t"}], "personalization": ["a","b","c","d"]}\n```'
    got = one(spark, outreach.answers(F.col("s")), s=reply)
    assert got["recruiting_status"] == "unknown" and got["employee_count_observed"] is None and len(got["evidence"]) == 1 and len(got["personalization"]) == 3
    assert one(spark, outreach.answers(F.col("s")), s="none") is None
    problem = outreach.draft_problem(*[F.col(c) for c in ("allowed", "subject", "body", "facts", "mails", "numbers")])
    base = {"allowed": "unknown", "subject": "件名", "body": "本文です info@a.jp 06-1234-5678", "facts": ["f"], "mails": ["Info@a.jp"], "numbers": ["06-1234-5678"]}
    assert one(spark, problem, **base) is None
    for change, want in (({"allowed": "false"}, "contact refused"), ({"body": " "}, "subject or body empty"), ({"facts": [" "]}, "no fact about the company"), ({"mails": ["x@b.jp"]}, "unknown address"), ({"numbers": ["0"]}, "unknown number"), ({"body": "良い judgment です"}, "foreign words"), ({"body": "名簿で拝見"}, "tells the source")):
        assert one(spark, problem, **{**base, **change}) == want
    allowed = outreach.contact_allowed(F.col("a"), F.lit(False), F.col("t"), F.lit(True))
    assert [one(spark, allowed, a=a, t=t) for a, t in (("false", None), ("unknown", "x"), ("unknown", None))] == ["false", "unknown", "true"]
