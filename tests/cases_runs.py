"""Operators on whole tables of a discovery run, over hand-written rows whose outcome the SQL lists."""

from __future__ import annotations

from cases_domain import query, values_sql
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmgraph.operators import crawl, discovery, outreach, planning, resolve


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """The few rows of a hand-written result with their number."""
    return df.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("i"), "*")


COMPANIES = [("c1", "1111111111111", "yamada.jp", "山田製作所", "大阪府東大阪市1"), ("c2", None, None, "田中商店", "京都府京都市1")]
INCOMING = [
    (1, "1111111111111", None, "山田", None), (2, "2222222222222", "yamada.jp", "山田製作所", None), (3, None, "yamada.jp", "山田", None), (4, None, None, "田中商店", "京都府京都市1"),
    (5, None, "new.jp", "新規", "大阪府堺市1"), (6, None, "new.jp", "新規堺", None), (7, None, None, "新規", "大阪府堺市1"), (8, None, None, "単独", None),
]


@query(values_sql({"id": "long", "company_id": "string", "reason": "string", "status": "string"}, [
    (1, "c1", "corporate_number", "duplicate"), (2, "2", None, "new"), (3, "c1", "domain", "duplicate"), (4, "c2", "name_address", "duplicate"), (5, "5", None, "new"), (6, "5", "domain", "duplicate"), (7, "5", "name_address", "duplicate"), (8, "8", None, "new"),
]))
def run_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as new companies or duplicates; another number is never the same company."""
    keys = "corporate_number string, domain string, normalized_name string, address_key string"
    incoming = spark.createDataFrame([(str(i), *r) for i, *r in INCOMING], f"id string, {keys}")
    found = resolve.register(spark.createDataFrame(COMPANIES, f"company_id string, {keys}"), incoming)
    return numbered(found.select(F.col("id").cast("long").alias("id"), "company_id", "reason", "status"), "id")


@query(values_sql({"id": "long", "group": "long", "reason": "string"}, [(1, 1, None), (2, 1, "domain"), (3, 1, "corporate_number")]).replace(", group,", ', "group",'))
def run_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are one company after all: not with differing numbers, nor with unrelated names."""
    rows = [(1, "1", "a.jp", "山田製作所"), (2, None, "a.jp", "山田製作所"), (3, "1", None, "山田"), (4, "2", "a.jp", "山田製作所"), (5, None, "a.jp", "無関係商会"), (6, None, None, "別")]
    given = spark.createDataFrame(rows, "id long, corporate_number string, domain string, normalized_name string")
    return numbered(resolve.reconcile(given, "id", ["id"]), "id")


@query(values_sql({"name": "string", "normalized_name": "string", "prefecture": "string", "city": "string", "phone": "string", "domain": "string", "corporate_number": "string", "source_confidence": "int"}, [
    ("株式会社山田製作所", "山田製作所", "大阪府", "東大阪市", "06-1234-5678", "yamada.co.jp", "1234567890123", 100), ("田中商店", "田中商店", None, None, None, None, None, 10),
]))
def run_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as candidates: names out of titles, normalised keys; what is no company is left out."""
    rows = [(1, "株式会社山田製作所 | 公式", "大阪府東大阪市長田中1丁目2番", "０６－１２３４－５６７８", "www.yamada.co.jp/?utm_source=x", "1234567890123", 150), (2, "求人ランキング", None, None, None, None, 10), (3, "「田中商店」へ", None, "1", None, "12", 10)]
    found = discovery.candidates(spark.createDataFrame(rows, "i int, name string, address string, phone string, website string, corporate_number string, source_confidence int"))
    return numbered(found.select(F.col("i").alias("o"), "name", "normalized_name", "prefecture", "city", "phone", "domain", "corporate_number", "source_confidence"), "o").drop("o")


OWN = "株式会社山田製作所 会社概要 東大阪市長田中1-2-3"


@query(values_sql({"company_id": "string", "url": "string", "confidence": "int", "status": "string"}, [("a", "https://yamada.example.jp/", 65, "verified"), ("b", None, None, "no_website"), ("c", "https://other.example.jp/", 25, "needs_review")]))
def run_official_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate site of each company: never a directory's page about it."""
    firms = spark.createDataFrame([("a", "株式会社山田製作所", "大阪府東大阪市長田中1-2-3", None, None, None), ("b", "無名株式会社", None, None, None, None), ("c", "他社株式会社", None, None, None, None)], "company_id string, name string, address string, phone string, corporate_number string, representative_name string")
    sites = spark.createDataFrame([
        ("a", "https://yamada.example.jp/", "web", "株式会社山田製作所", None, OWN, "株式会社山田製作所", OWN, 1), ("a", "https://portal.example.jp/company/4630/", "web", "株式会社山田製作所", None, OWN, "名簿", "いろいろ", 0),
        ("a", "https://www.facebook.com/x", "gbiz", None, None, None, None, None, 2), ("c", "https://other.example.jp/", "web", None, None, None, "他社株式会社", "他社", 0), ("c", "https://www.facebook.com/y", "gbiz", None, None, None, None, None, 1),
    ], "company_id string, url string, source string, title string, snippet string, page_text string, root_title string, root_text string, ord int")
    return numbered(discovery.official_sites(firms, sites).select("company_id", "url", "confidence", "status"), "company_id")


@query(values_sql({"owned": "boolean", "confirmed": "boolean", "reason": "string"}, [
    (True, True, "domain from name"), (True, False, "root page unknown"), (True, True, "name in title"), (True, True, "name on root page"), (True, True, "same group"), (False, False, "record page"), (False, False, "directory"), (True, False, "undecided"),
]))
def run_domain_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a site is a company's own, by its root page."""
    directory = "".join(f"株式会社{c}社 " for c in "甲乙丙丁戊己庚")
    rows = [
        ("ABC Works", "https://abcworks.jp/", "x", "y"), ("山田製作所", "https://a.jp/", None, None), ("山田製作所", "https://a.jp/", "山田製作所の工場", None), ("山田製作所", "https://a.jp/", "工場", "ようこそ山田製作所へ"),
        ("増子製作所", "https://a.jp/", "増子グループ", None), ("山田製作所", "https://a.jp/company/4630/", "名簿", "いろいろ"), ("山田製作所", "https://a.jp/", "会員一覧", directory), ("山田製作所", "https://a.jp/", "ようこそ", "いろいろ"),
    ]
    given = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, url string, title string, body string")
    return given.select("i", discovery.domain_ownership(*[F.col(c) for c in ("name", "url", "title", "body")]).alias("d")).select("i", "d.*")


@query(values_sql({"score": "int", "status": "string", "matched": "array<string>"}, [(100, "verified", ["corporate_number", "official_source", "website_name", "address", "phone", "domain", "multi_source"]), (0, "rejected", []), (65, "needs_review", ["corporate_number", "website_name", "multi_source"])]))
def run_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that a candidate is the company it claims to be."""
    rows = [
        ("山田製作所", "大阪府東大阪市長田中1-2-3", "06-1234-5678", "y.jp", "1234567890123", ["gbiz", "web_search"], "株式会社山田製作所", "東大阪市長田中1-2-3 TEL 06-1234-5678", 70),
        ("他社", None, None, None, None, ["web_search"], None, None, None),
        ("田中商店", None, None, None, "1234567890123", ["web_search", "google_places"], "田中商店", "", None),
    ]
    given = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, normalized_name string, address string, phone string, domain string, corporate_number string, sources array<string>, site_title string, site_text string, site_confidence int")
    return discovery.verified(given).select("i", "verification.*")


@query(values_sql({"candidate_id": "int", "status": "string", "website": "string", "reject_reason": "string", "reviewed_by": "string"}, [(1, "verified", "https://b.jp", None, "v"), (2, "needs_review", "https://a", None, None), (3, "rejected", "https://c", "no", "u"), (4, "discovered", "https://d.jp", None, "u")]))
def run_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates after what people decided; the last decision holds."""
    found = spark.createDataFrame([(1, "needs_review", None, None, None), (2, "needs_review", "https://a", None, None), (3, "needs_review", "https://c", None, None), (4, "rejected", None, None, None)], "candidate_id int, status string, website string, reject_reason string, reviewed_by string")
    actions = spark.createDataFrame([(1, "reject", None, "no", "u", 1), (1, "approve", "b.jp", None, "v", 2), (3, "reject", None, "no", "u", 1), (4, "correct", "d.jp", None, "u", 1)], "candidate_id int, action string, website string, reason string, reviewed_by string, at int")
    return numbered(discovery.apply_reviews(found, actions).select("candidate_id", "status", "website", "reject_reason", "reviewed_by"), "candidate_id")


@query(values_sql({"company_id": "string", "letters": "int", "urls": "array<string>"}, [("a", 1655, ["u1", "u2"]), ("b", 1, []), ("c", 1902, ["u1", "u4"])]))
def run_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by kind as far as they fit, the last one cut."""
    rows = [
        ("a", "H", "news", "n", "u2", "x" * 1000), ("a", "H", "top", None, "u1", "Q" * 2000), ("a", "H", "privacy", "p", "u3", " "), ("b", "H", "top", "t", "u1", ""),
        ("c", "H", "top", None, "u1", "Q" * 2000), ("c", "H", "company", "c", "u4", "z" * 5000), ("c", "H", "other", "o", "u9", "w" * 90),
    ]
    found = outreach.contexts(spark.createDataFrame(rows, "company_id string, header string, page_type string, title string, url string, body string"), 2000)
    return numbered(found.select("company_id", F.length("text").alias("letters"), "urls"), "company_id")


@query(values_sql({"status": "string", "count": "int", "confidence": "int", "evidence": "int", "own": "array<string>"}, [("unknown", None, 40, 1, ["a", "b", "c"]), (None, None, None, None, None), ("active", 12, 90, 0, None), (None, None, None, None, None)]))
def run_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model replies, as rows: JSON within text, unknown values mended."""
    replies = [
        'Sure:\n```json\n{"recruiting_status": "maybe", "confidence": 40, "employee_count_observed": 0, "evidence": [{"category": "x", "evidence_text": " "}, {"category": "y", "evidence_text": "t"}], "personalization": ["a","b","c","d"]}\n```',
        "none", '{"recruiting_status": "active", "confidence": 90, "employee_count_observed": 12}', '{"confidence": 140}',
    ]
    got = spark.createDataFrame(list(enumerate(replies)), "i int, s string").select("i", outreach.answers(F.col("s")).alias("a"))
    size = F.when(F.col("a").isNotNull(), F.size("a.evidence"))
    return got.select("i", F.col("a.recruiting_status").alias("status"), F.col("a.employee_count_observed").alias("count"), "a.confidence", size.alias("evidence"), F.col("a.personalization").alias("own"))


@query(values_sql({"v": "string"}, [(None,), ("contact refused",), ("no draft",), ("subject or body empty",), ("no fact about the company",), ("unknown address",), ("unknown number",), ("foreign words",), ("tells the source",)]))
def run_draft_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a draft must not be sent."""
    good = ("unknown", "件名", "本文です info@a.jp 06-1234-5678", ["f"])
    drafts = [good, ("false", *good[1:]), ("unknown", None, None, ["f"]), ("unknown", "件名", " ", ["f"]), (*good[:3], [" "]), ("unknown", "件名", "本文 x@b.jp", ["f"]), ("unknown", "件名", "本文 03-9999-8888", ["f"]), ("unknown", "件名", "judgment の", ["f"]), ("unknown", "件名", "名簿で拝見", ["f"])]
    given = spark.createDataFrame([(i, *d, ["Info@a.jp"], ["06-1234-5678"]) for i, d in enumerate(drafts)], "i int, allowed string, subject string, body string, facts array<string>, mails array<string>, numbers array<string>")
    return given.select("i", outreach.draft_problem(*[F.col(c) for c in ("allowed", "subject", "body", "facts", "mails", "numbers")]).alias("v"))


@query(values_sql({"id": "long", "verification_status": "string", "email": "string", "phone": "string", "sales_contact_allowed": "string"}, [(1, "verified", "n@a.jp", "06", "unknown"), (2, "manual", "o@b.jp", "07", "false"), (3, "verified", None, None, "false")]))
def run_company_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawl changes: a known phone, a manual verification and a refusal stay."""
    known = spark.createDataFrame([(1, "unverified", None, "06", "unknown"), (2, "manual", "o@b.jp", None, "false"), (3, "needs_review", None, None, "true"), (4, "verified", None, None, "unknown")], "id long, verification_status string, email string, phone string, sales_contact_allowed string")
    sites = spark.createDataFrame([(1, "https://a.jp", "n@a.jp", "99", None, False), (2, "https://b.jp", None, "07", "https://b.jp/f", None), (3, "https://c.jp", None, None, None, True)], "id long, website_url string, email string, phone string, contact_form string, refused boolean")
    return numbered(crawl.company_patch(known, sites, "id").select("id", "verification_status", "email", "phone", "sales_contact_allowed"), "id")


@query(values_sql({"site": "string", "turn": "int", "url": "string", "priority": "int"}, [("a", 1, "https://a.jp/", 110), ("a", 2, "https://a.jp/recruit/", 105), ("a", 3, "https://a.jp/company", 100), ("b", 1, "https://b.jp/", 110)]))
def run_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages of a site a crawl of three pages reads, and when."""
    links = [("a", "https://a.jp/", None), ("a", "https://a.jp/index.html", None), ("a", "https://a.jp/recruit/", "採用情報"), ("a", "https://a.jp/company", None), ("a", "https://a.jp/x", None), ("a", "https://a.jp/y.pdf", "会社概要"), ("b", "https://b.jp/", None)]
    found = crawl.frontier(spark.createDataFrame(links, "site string, url string, link_text string"), "site", 3)
    return numbered(found.select("site", "turn", "url", "priority"), "site", "turn")


@query(values_sql({"company_id": "int", "source_url": "string", "fact": "string", "source_title": "string"}, [(1, "u1", "x", "t1"), (1, "u2", "y", None)]))
def run_supported_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence from pages that the model was given; made-up addresses are left out."""
    pages = spark.createDataFrame([(1, "u1", "t1"), (1, "u1", "t9"), (1, "u2", None), (2, "u3", "t3")], "company_id int, url string, title string")
    evidence = spark.createDataFrame([(1, "u1", "x"), (1, "u2", "y"), (1, "u3", "z"), (1, None, "w")], "company_id int, source_url string, fact string")
    return numbered(outreach.supported_evidence(evidence, pages), "source_url")


@query(values_sql({"provider": "string", "requests": "long", "failed": "long", "results": "long", "new": "long", "duplicates": "long"}, [("p", 2, 0, 4, 3, 1), ("q", 2, 1, 2, 1, 1)]))
def run_provider_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries run in order until the budget is used up; a failed one stops nothing."""
    plan = spark.createDataFrame([(0, "q0", "p", 1.0, False), (1, "q1", "q", 1.0, False), (2, "q2", "q", 1.0, True), (3, "q3", "p", 1.0, False), (4, "q4", "p", 1.0, False)], "seq int, id string, provider string, cost double, failed boolean")
    results = spark.createDataFrame([("q0", "a"), ("q0", "b"), ("q1", "b"), ("q1", "c"), ("q2", "z"), ("q3", "c"), ("q3", "d"), ("q4", "e")], "id string, key string")
    return numbered(planning.provider_stats(plan, results, 4.0), "provider")


@query(values_sql({"run_id": "int", "phase": "string", "status": "string"}, [(1, "discovering", "running"), (2, "verifying", "running"), (3, "promoting", "running"), (4, "done", "completed"), (5, "done", "partially_completed")]))
def run_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which phase a run is in, and how it ended."""
    rows = [(1, 10, 39, 20, 5, 9, 0, 0), (2, 10, 40, 20, 5, 9, 0, 0), (3, 10, 40, 20, 5, 0, 12, 3), (4, 10, 40, 20, 5, 0, 12, 10), (5, 10, 20, 20, 20, 0, 4, 4)]
    return numbered(planning.phase(spark.createDataFrame(rows, "run_id int, requested int, found int, planned int, executed int, waiting int, verified int, promoted int")).select("run_id", "phase", "status"), "run_id")


@query(values_sql({"requests": "int", "candidates": "int", "verification": "int"}, [(12, 40, 40), (40, 200, 300), (60, 600, 300)]))
def run_scaled_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of runs for 3, 50 and 500 companies."""
    whole = {"provider_requests": 60, "candidates": 600, "verification_requests": 300}
    return spark.createDataFrame([(i, *planning.scaled_budget(whole, n).values()) for i, n in enumerate((3, 50, 500))], "i int, requests int, candidates int, verification int")
