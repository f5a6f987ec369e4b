"""The domain core over whole given tables: Japanese names, addresses, numbers and forms written from ids by rules that both engines evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmgraph.functions import dims, names, text
from firmgraph.operators import outreach, planning, promotion, search
from firmgraph.operators.resolve import reconcile
from firmgraph.plans.registry import query, table
from firmgraph.sources import registry

K = "c_custkey"
STEM = f"CASE {K} % 6 WHEN 0 THEN '山田' WHEN 1 THEN 'サクラ' WHEN 2 THEN '増子' WHEN 3 THEN 'ＡＢＣ－' || CAST({K} % 7 AS STRING) WHEN 4 THEN '大阪' ELSE 'Any-Ware' END || CASE {K} % 4 WHEN 0 THEN '製作所' WHEN 1 THEN '・工業' WHEN 2 THEN '　商会' ELSE '' END"
NAME = f"CASE {K} % 5 WHEN 0 THEN '株式会社' || {STEM} WHEN 1 THEN {STEM} || '有限会社' WHEN 2 THEN '（株）　' || {STEM} WHEN 3 THEN {STEM} || ' Co., Ltd.' ELSE {STEM} END"
HALF_SQL = "translate({}, '" + text.WIDE + "', '" + text.NARROW.replace("'", "''") + "')"
BARE_SQL = f"trim(regexp_replace(half, '(?i){dims.LEGAL_FORMS}', '', 'g'))"
ENDING_SQL = f"'({dims.INDUSTRY_ENDINGS})$', ''"


def _customers(spark: SparkSession, sf_dir: str, **texts: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col(K).alias("id"), *[F.expr(x).alias(c) for c, x in texts.items()])


@query(rf"""WITH n AS (SELECT {K} AS id, {HALF_SQL.replace("{}", f"({NAME})", 1)} AS half FROM customer), b AS (SELECT id, half, {BARE_SQL} AS bare FROM n),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(bare, {ENDING_SQL}), {ENDING_SQL}), {ENDING_SQL}) AS core FROM b)
SELECT id, half, bare, trim(lower(regexp_replace(regexp_replace(regexp_replace(half, '(?i){dims.LEGAL_FORMS}', '', 'g'), '[\s　]+', '', 'g'), '[・･.,，、。「」『』【】\[\]()（）\-‐－―—_＿''"’”`~〜～]', '', 'g'))) AS key,
  CASE WHEN length(core) >= 2 AND core NOT IN ({", ".join(f"'{x}'" for x in dims.GENERIC_CORES)}) THEN core END AS core, list_sort(list_distinct(regexp_extract_all(lower(bare), '[a-z0-9]{{3,}}'))) AS tokens FROM c""")
def firm_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in half width, without their legal form, as keys, without endings of their industry, and their Latin words."""
    c = F.col("name")
    return _customers(spark, sf_dir, name=NAME).select("id", text.half_width(c).alias("half"), text.without_legal_form(c).alias("bare"), text.company_name(c).alias("key"), text.company_core(c).alias("core"), F.array_sort(text.name_tokens(c)).alias("tokens"))


PREF = f"CASE {K} % 4 WHEN 0 THEN '大阪府' WHEN 1 THEN '京都府' WHEN 2 THEN '奈良県' ELSE '' END"
CITY = f"CASE {K} % 4 WHEN 0 THEN '東大阪市' WHEN 1 THEN '京都市上京区' WHEN 2 THEN '生駒郡斑鳩町' ELSE '堺市中区' END"
BLOCK = f"CASE WHEN {K} % 12 = 0 THEN '十' WHEN {K} % 12 = 10 THEN '十一' WHEN {K} % 12 = 11 THEN '二十三' ELSE substr('一二三四五六七八九', CAST({K} % 12 AS INT), 1) END"
BLOCK_NO = f"CASE WHEN {K} % 12 = 0 THEN 10 WHEN {K} % 12 = 10 THEN 11 WHEN {K} % 12 = 11 THEN 23 ELSE {K} % 12 END"
LOT = f"CASE {K} % 3 WHEN 0 THEN '２番３号' WHEN 1 THEN '2－３' ELSE '2番地の3' END"
ADDRESS = f"CASE WHEN {K} % 2 = 0 THEN '〒577-' || lpad(CAST({K} % 10000 AS STRING), 4, '0') || ' ' ELSE '' END || {PREF} || {CITY} || '長田中' || {BLOCK} || '丁目' || {LOT}"


@query(f"""WITH a AS (SELECT {K} AS id, {PREF} AS pref, {CITY} AS city, '長田中' || CAST({BLOCK_NO} AS STRING) || '-' || CASE {K} % 3 WHEN 2 THEN '2の3' ELSE '2-3' END AS rest FROM customer),
k AS (SELECT *, pref || city || rest AS whole FROM a)
SELECT id, whole AS key, nullif(pref, '') AS prefecture, city, CASE WHEN pref = '' THEN [substr(whole, 1, 12)] ELSE [substr(whole, 1, 12), substr(city || rest, 1, 10)] END AS keys, true AS shown, false AS elsewhere FROM k""")
def firm_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as keys, their parts, the beginnings by which pages show them, and whether two texts do."""
    a, c = F.col("address"), F.col
    # dealt anew: a small file of many customers would be one task's
    rows = _customers(spark, sf_dir, address=ADDRESS).repartition("id")
    told = rows.select("id", "address", text.address_keys(a).alias("keys"), text.address(F.concat(F.lit("本社 "), a, F.lit(" 電話"))).alias("page"), text.address(F.lit("北海道札幌市北区")).alias("other"))
    return told.select("id", text.address(a).alias("key"), text.prefecture(a).alias("prefecture"), text.city(a).alias("city"), "keys", text.appears(c("keys"), c("page")).alias("shown"), text.appears(c("keys"), c("other")).alias("elsewhere"))


DIGITS = f"'06' || lpad(CAST({K} * 7919 % 100000000 AS STRING), 8, '0')"
PHONE = f"CASE {K} % 4 WHEN 0 THEN '（06）' || substr({DIGITS}, 3, 4) || ' ' || substr({DIGITS}, 7, 4) WHEN 1 THEN '06－' || substr({DIGITS}, 3, 4) || '－' || substr({DIGITS}, 7, 4) WHEN 2 THEN '06-12' ELSE {DIGITS} END"
NUMBER = f"CASE {K} % 3 WHEN 0 THEN 'T' || lpad(CAST({K} AS STRING), 13, '1') WHEN 1 THEN lpad(CAST({K} AS STRING), 13, '１') ELSE CAST({K} AS STRING) END"
STAFF = f"CASE {K} % 4 WHEN 0 THEN '約１，' || lpad(CAST({K} % 1000 AS STRING), 3, '0') || '名' WHEN 1 THEN CAST({K} % 90 AS STRING) || '人' WHEN 2 THEN '不明' ELSE '0' END"
FOUNDED = f"CASE {K} % 4 WHEN 0 THEN CAST(1950 + {K} % 60 AS STRING) || '年' || CAST(1 + {K} % 12 AS STRING) || '月1日' WHEN 1 THEN CAST(1950 + {K} % 60 AS STRING) || '/' || CAST(1 + {K} % 12 AS STRING) WHEN 2 THEN '１９８０' ELSE '昭和' END"
SECRET = f"'GET https://a.b/c?x=' || CAST({K} AS STRING) || ' to postgres://u:p@h/' || CAST({K} AS STRING) || ' failed'"


@query(f"""SELECT {K} AS id, CASE {K} % 4 WHEN 1 THEN '06-' || substr({DIGITS}, 3, 4) || '-' || substr({DIGITS}, 7, 4) WHEN 2 THEN NULL ELSE {DIGITS} END AS phone,
 CASE {K} % 3 WHEN 2 THEN NULL ELSE lpad(CAST({K} AS STRING), 13, '1') END AS number, CASE {K} % 4 WHEN 0 THEN 1000 + {K} % 1000 WHEN 1 THEN nullif({K} % 90, 0) END AS staff,
 CASE {K} % 4 WHEN 0 THEN CAST(1950 + {K} % 60 AS STRING) || '-' || lpad(CAST(1 + {K} % 12 AS STRING), 2, '0') || '-01' WHEN 1 THEN CAST(1950 + {K} % 60 AS STRING) || '-' || lpad(CAST(1 + {K} % 12 AS STRING), 2, '0') || '-01' WHEN 2 THEN '1980-01-01' END AS founded,
 'GET *** to *** failed' AS message, CASE {K} % 3 WHEN 0 THEN 'manufacturing' WHEN 1 THEN 'it' END AS industry FROM customer""")
def firm_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telephone and corporate numbers, staff, dates of founding, redacted messages and industries."""
    rows = _customers(spark, sf_dir, phone=PHONE, number=NUMBER, staff=STAFF, founded=FOUNDED, message=SECRET, trade=f"CASE {K} % 3 WHEN 0 THEN '金属加工業' WHEN 1 THEN 'ソフトウェア開発' ELSE 'その他' END")
    c = F.col
    return rows.select("id", text.phone(c("phone")).alias("phone"), text.corporate_number(c("number")).alias("number"), text.employee_count(c("staff")).alias("staff"), text.normal_date(c("founded")).alias("founded"), text.redact_secrets(c("message")).alias("message"), text.industry(c("trade")).alias("industry"))


TITLE = f"CASE {K} % 6 WHEN 0 THEN '大阪府豊中市にある金属切削加工の株式会社トーシン' WHEN 1 THEN '株式会社山田製作所の求人情報' WHEN 2 THEN '「光電気工業」へ' WHEN 3 THEN '求人ランキング2026' WHEN 4 THEN '株式会社第' || CAST({K} AS STRING) || '工業 | 公式' ELSE '大阪府電気工事工業組合' END"


@query(f"""SELECT {K} AS id, CASE {K} % 6 WHEN 0 THEN '株式会社トーシン' WHEN 1 THEN '株式会社山田製作所' WHEN 2 THEN '光電気工業' WHEN 3 THEN '求人ランキング2026' WHEN 4 THEN '株式会社第' || CAST({K} AS STRING) || '工業' ELSE '大阪府電気工事工業組合' END AS name,
 CASE {K} % 6 WHEN 3 THEN 'list or search' WHEN 5 THEN 'industry body' END AS problem, {K} % 5 IN (0, 1) AS public FROM customer""")
def firm_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names out of page titles, why some cannot be a company's, and bodies that are public."""
    body = f"CASE {K} % 5 WHEN 0 THEN '桜井財産区' WHEN 1 THEN '大阪地方裁判所' WHEN 2 THEN '株式会社山田製作所' ELSE '' END"
    rows = _customers(spark, sf_dir, title=TITLE, body=body).withColumn("name", names.clean_company_name(F.col("title")))
    return rows.select("id", "name", names.name_problem(F.col("name")).alias("problem"), registry.is_public_body(F.col("body")).alias("public"))


@query(f"""WITH p AS (SELECT a.c_custkey AS id, lower(a.c_name) AS x, lower(b.s_name) AS y, substr(lower(a.c_name), 1, 12) AS z FROM customer a JOIN supplier b ON a.c_custkey = b.s_suppkey)
SELECT id, x = y OR (length(x) >= 3 AND length(y) >= 3 AND (contains(x, y) OR contains(y, x))) OR (abs(length(x) - length(y)) <= 4 AND 1 - levenshtein(x, y) * 1e0 / greatest(length(x), length(y)) >= 0.6) AS related, true AS part FROM p""")
def related_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether names of customers and suppliers with the same key look related, and a name and its beginning."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    rows = c.join(s, c.c_custkey == s.s_suppkey).select(F.col(K).alias("id"), F.lower("c_name").alias("x"), F.lower("s_name").alias("y"))
    return rows.select("id", text.names_related(F.col("x"), F.col("y")).alias("related"), text.names_related(F.col("x"), F.substring("x", 1, 12)).alias("part"))


MAILS = f"array('Web@agency.jp', 'info@' || CASE {K} % 3 WHEN 0 THEN 'mail.' ELSE '' END || 'c' || CAST({K} % 50 AS STRING) || '.jp', 'x@gmail.com')"


@query(f"SELECT {K} AS id, CASE WHEN {K} % 4 = 0 THEN 'x@gmail.com' ELSE 'info@' || CASE {K} % 3 WHEN 0 THEN 'mail.' ELSE '' END || 'c' || CAST({K} % 50 AS STRING) || '.jp' END AS mail FROM customer")
def company_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a site's addresses, the company's own, else one of free mail."""
    rows = _customers(spark, sf_dir, mails=MAILS, site=f"CASE WHEN {K} % 4 = 0 THEN 'other.jp' ELSE 'c' || CAST({K} % 50 AS STRING) || '.jp' END")
    return rows.select("id", text.company_email(F.col("mails"), F.col("site")).alias("mail"))


@query("""WITH n AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN 'n' || s_suppkey % 7 END AS number, CASE WHEN s_suppkey % 2 = 0 THEN 'd' || s_suppkey % 5 END AS domain FROM supplier)
SELECT number, count(*) AS rows_, count(DISTINCT g) AS groups_ FROM (SELECT number, min(id) OVER (PARTITION BY number) AS g FROM n WHERE number IS NOT NULL) t GROUP BY number""")
def reconciled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with one number are one company after all, however their names and domains differ; none with differing numbers are."""
    s = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(s.alias("id"), F.when(s % 3 != 0, F.concat(F.lit("n"), (s % 7).cast("string"))).alias("corporate_number"), F.lit(None).cast("string").alias("domain"), F.lower("s_name").alias("normalized_name"))
    told = rows.join(reconcile(rows, "id", ["id"]), "id", "left").filter("corporate_number IS NOT NULL")
    return told.groupBy(F.col("corporate_number").alias("number")).agg(F.count("*").alias("rows_"), F.count_distinct(F.coalesce("group", "id")).alias("groups_"))


FORM = f"CASE {K} % 7 WHEN 0 THEN 'https://c' || CAST({K} AS STRING) || '.example.jp/contact/' WHEN 1 THEN 'https://form.c' || CAST({K} AS STRING) || '.example.jp/contact' WHEN 2 THEN NULL WHEN 3 THEN 'https://www.facebook.com/c' || CAST({K} AS STRING) WHEN 4 THEN 'https://c' || CAST({K} AS STRING) || '.example.jp/recruit/entry' WHEN 5 THEN 'https://other' || CAST({K} AS STRING) || '.example.com/contact' ELSE 'https://c' || CAST({K} AS STRING) || '.example.jp/inquiry' END"


@query(f"""SELECT {K} AS id, CASE WHEN {K} % 7 = 2 THEN 'no form' WHEN {K} % 5 = 0 THEN 'no confirmed site' WHEN {K} % 4 = 0 THEN 'site not verified' WHEN {K} % 7 = 3 THEN 'non-official domain' WHEN {K} % 7 = 4 THEN 'not a contact form' WHEN {K} % 7 = 5 THEN 'form on another site' END AS problem,
 {K} % 6 <> 0 AS contactable, list_filter([CASE WHEN {K} % 3 = 0 THEN 'company' END, CASE WHEN {K} % 2 = 0 THEN 'name' END], lambda x: x IS NOT NULL) AS missing,
 CASE WHEN {K} % 8 = 0 THEN 'no sign of hiring' WHEN {K} % 200 >= 100 THEN 'budget spent' END AS block FROM customer""")
def outreach_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why forms must not be used, who may be contacted, what senders lack, and why companies are not analysed."""
    rows = _customers(spark, sf_dir, form=FORM, site=f"CASE WHEN {K} % 5 <> 0 THEN 'https://c' || CAST({K} AS STRING) || '.example.jp/' END", status=f"CASE {K} % 4 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'manual' ELSE 'verified' END", allowed=f"CASE {K} % 6 WHEN 0 THEN 'false' WHEN 1 THEN NULL ELSE 'unknown' END", company=f"CASE WHEN {K} % 3 <> 0 THEN 'A' ELSE '' END", name=f"CASE WHEN {K} % 2 <> 0 THEN 'B' END", target=f"CASE WHEN {K} % 8 = 0 THEN 'no_signal' ELSE 'active_recruit' END", spent=f"CAST({K} % 200 AS INT)")
    c = F.col
    return rows.select("id", outreach.form_problem(c("form"), c("site"), c("status")).alias("problem"), outreach.contactable(c("allowed")).alias("contactable"), outreach.missing_sender({"company": c("company"), "name": c("name")}, ("company", "name")).alias("missing"), outreach.analysis_block(True, True, c("target"), c("spent"), F.lit(100)).alias("block"))


FIELDS = (("text", "company", "会社名", "company"), ("text", "kana", "フリガナ", "nameKana"), ("text", "mail2", "メールアドレス（確認用）", "emailConfirm"), ("tel", "t", "", "phone"), ("text", "zip", "郵便番号", "zip"), ("select", "kind", "お問い合わせ種別", "inquiryType"), ("textarea", "x", "自由記入", "body"), ("checkbox", "agree", "同意", "consent"), ("text", "zzz", "", "unknown"))
_field = lambda i: f"CASE {K} % {len(FIELDS)} " + " ".join(f"WHEN {n} THEN '{f[i]}'" for n, f in enumerate(FIELDS)) + " END"


@query(f"SELECT {K} AS id, {_field(3)} AS purpose FROM customer")
def field_purposes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fields of forms are for."""
    rows = _customers(spark, sf_dir, kind=_field(0), name=_field(1), label=_field(2))
    return rows.select("id", outreach.field_purpose(F.col("kind"), F.col("name"), F.col("label")).alias("purpose"))


@query("""WITH r AS (SELECT o_custkey AS run_id, 10 AS requested, count(*) * 3 AS found, 20 AS planned, count(*) AS executed, count(*) FILTER (o_orderstatus = 'P') AS waiting, count(*) FILTER (o_orderstatus = 'F') AS verified, count(*) FILTER (o_orderpriority LIKE '1%') AS promoted FROM orders GROUP BY o_custkey)
SELECT run_id, phase, CASE WHEN phase <> 'done' THEN 'running' WHEN promoted >= requested THEN 'completed' ELSE 'partially_completed' END AS status FROM (
  SELECT *, CASE WHEN found < requested * 4 AND executed < planned THEN 'discovering' WHEN waiting > 0 THEN 'verifying' WHEN promoted < least(verified, requested) THEN 'promoting' ELSE 'done' END AS phase FROM r) p""")
def run_phases_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phase of each run, customers' orders standing for its steps."""
    n = lambda when: F.count_if(F.expr(when)).cast("int")
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.lit(10).alias("requested"), (F.count("*") * 3).alias("found"), F.lit(20).alias("planned"), F.count("*").alias("executed"), n("o_orderstatus = 'P'").alias("waiting"), n("o_orderstatus = 'F'").alias("verified"), n("o_orderpriority LIKE '1%'").alias("promoted"))
    return planning.phase(runs).select("run_id", "phase", "status")


SITED = f"CASE WHEN {K} % 4 <> 0 THEN 'https://c' || CAST({K} AS STRING) || '.jp' END"
HELD = ", ".join(f"CASE WHEN {{K}} % {{n}} = 0 THEN '{c}' || CAST({{K}} AS STRING) END AS {c}".format(K=K, n=2 + i % 5) for i, c in enumerate(promotion.FROM_SITE))


@query(f"""WITH c AS (SELECT {K} AS id, {SITED} AS website_url, {K} % 6 = 1 AS bad, {HELD} FROM customer),
d AS (SELECT *, (bad AND website_url IS NOT NULL) AS hit, (bad AND website_url IS NOT NULL) OR (website_url IS NULL AND coalesce({", ".join(promotion.LEFT_OVER)}) IS NOT NULL) AS cleaned FROM c)
SELECT id, CASE WHEN NOT hit THEN website_url END AS website_url, CASE WHEN NOT hit THEN 'd' || id END AS website_domain, CASE WHEN NOT hit THEN 70 END AS official_site_confidence,
 CASE WHEN hit THEN website_url || ': directory' END AS noted, CASE WHEN hit THEN 'needs_review' ELSE 'verified' END AS verification_status, CASE WHEN hit THEN 'no_website' ELSE 'crawled' END AS crawl_status, CASE WHEN cleaned THEN 'not_analyzed' ELSE 'analyzed' END AS analysis_status, 'false' AS sales_contact_allowed,
 {", ".join(f"CASE WHEN NOT cleaned THEN {c} END AS {c}" for c in promotion.FROM_SITE)} FROM d""")
def retracted_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies after wrong sites are taken away with all eighteen columns that came from them, and what earlier retractions left."""
    rows = table(spark, sf_dir, "customer").selectExpr(f"{K} AS id", f"{SITED} AS website_url", f"'d' || {K} AS website_domain", "70 AS official_site_confidence", "CAST(NULL AS ARRAY<STRING>) AS website_candidates", "'verified' AS verification_status", "'crawled' AS crawl_status", "'analyzed' AS analysis_status", "'false' AS sales_contact_allowed", *HELD.split(", "))
    bad = rows.filter("id % 6 = 1").select("id", F.lit("directory").alias("reason"))
    return promotion.retracted_sites(rows, bad).withColumn("noted", F.get("website_candidates", F.lit(0))).drop("website_candidates")


@query("""WITH o AS (SELECT user_id AS company_id, event_type AS provider, nullif('x' || event_id % 5, 'x0') AS external_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'u' || event_id % 3 END AS source_url, 'discovery' AS source_type, CAST(floor(value) AS BIGINT) AS confidence FROM events
UNION ALL SELECT c_custkey, 'official_web', 'd' || c_custkey, 'https://c' || c_custkey, 'verification', 60 + c_custkey % 40 FROM customer WHERE c_custkey % 3 <> 0)
SELECT company_id, provider, external_id, nullif(coalesce(source_url, ''), '') AS source_url, source_type, max(confidence) AS confidence FROM o GROUP BY company_id, provider, external_id, nullif(coalesce(source_url, ''), ''), source_type""")
def sources_of_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where what is known of each company comes from, each source once with its highest certainty."""
    e = F.col("event_id")
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("company_id"), F.col("event_type").alias("provider"), F.nullif(F.concat(F.lit("x"), (e % 5).cast("string")), F.lit("x0")).alias("external_id"), F.when(e % 3 == 0, "").otherwise(F.concat(F.lit("u"), (e % 3).cast("string"))).alias("source_url"), F.floor("value").alias("confidence"))
    c = F.col(K)
    sites = table(spark, sf_dir, "customer").select(c.alias("company_id"), F.when(c % 3 != 0, F.concat(F.lit("https://c"), c.cast("string"))).alias("website"), F.concat(F.lit("d"), c.cast("string")).alias("domain"), (c % 40 + 60).alias("confidence"))
    return promotion.company_sources(seen, sites)


ENTRY = f"CASE WHEN {K} % 9 = 0 THEN '第' || CAST({K} AS STRING) || '財産区' ELSE '株式会社第' || CAST({K} AS STRING) || '工業' END"


@query(f"""WITH e AS (SELECT {K} AS id, {K} AS place, {ENTRY} AS company_name, lpad(CAST({K} AS STRING), 13, '0') AS corporate_number,
  CASE WHEN {K} % 9 = 0 THEN 'public body' WHEN {K} % 8 = 0 THEN 'closed' WHEN {K} % 7 = 0 THEN 'other city' WHEN {K} % 5 = 0 THEN 'no site' END AS why FROM customer),
r AS (SELECT *, sum(CASE WHEN why IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY place) AS upto FROM e WHERE place < 300)
SELECT place, corporate_number, company_name, CASE WHEN why IS NOT NULL THEN 'skipped' WHEN id % 4 = 0 THEN 'duplicate' ELSE 'new' END AS status, CASE WHEN why IS NOT NULL THEN why WHEN id % 4 = 0 THEN 'corporate_number' END AS reason FROM r WHERE upto - CASE WHEN why IS NULL THEN 1 ELSE 0 END < 120""")
def registry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six pages of a registry, customers as its entries, read until 120 companies are registered; every fourth is known by its number."""
    c = F.col(K)
    number = F.lpad(c.cast("string"), 13, "0")
    entries = table(spark, sf_dir, "customer").select(c.alias("place"), number.alias("corporate_number"), F.expr(ENTRY).alias("name"), F.when(c % 7 == 0, "大阪府堺市1").otherwise(F.concat(F.lit("大阪府東大阪市"), c.cast("string"))).alias("location"), F.when(c % 8 == 0, "2020-01-01").alias("close_date"), F.array().cast("array<string>").alias("business_items"), F.lit(None).cast("string").alias("business_summary"), F.lit(None).cast("string").alias("employee_number"), F.when(c % 5 != 0, F.concat(F.lit("https://c"), c.cast("string"), F.lit(".jp"))).alias("company_url"))
    none = F.lit(None).cast("string")
    known = table(spark, sf_dir, "customer").filter(c % 4 == 0).select(c.alias("company_id"), number.alias("corporate_number"), none.alias("domain"), none.alias("normalized_name"), none.alias("address_key"), F.lit("not_crawled").alias("crawl_status"))
    asked, wrong = search.criteria({"city": "東大阪市", "requested": "120", "industry": ""})
    items, _ = search.search_step(entries, known, asked)
    return items.select("place", "corporate_number", "company_name", "status", "reason")


@query(rf"""SELECT {K} AS id, list_sort(list_distinct(regexp_extract_all('本社は' || {ADDRESS} || '。電話 大阪府堺市中区1-2-3|以上', '(?:{"|".join(dims.PREFECTURES)})[^\s、。|｜]{{4,30}}'))) AS found FROM customer""")
def address_like_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What looks like an address in texts about customers."""
    page = F.concat(F.lit("本社は"), F.expr(ADDRESS), F.lit("。電話 大阪府堺市中区1-2-3|以上"))
    return table(spark, sf_dir, "customer").select(F.col(K).alias("id"), search.address_like(page).alias("found"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'error' AND (CASE WHEN value > 50 THEN 'warn' ELSE 'info' END) = 'warn'")
def filtered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warnings of one category of the log."""
    rows = table(spark, sf_dir, "events").withColumn("category", F.col("event_type")).withColumn("level", F.when(F.col("value") > 50, "warn").otherwise("info"))
    return search.filtered_log(rows, "error", "warn").select("event_id", "event_type", "value")


@query("""WITH u AS (SELECT page_id, url, regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages), d AS (SELECT *, length(host) % 3 AS k FROM u)
SELECT page_id, CASE k WHEN 0 THEN NOT (path LIKE '/en/%' AND path NOT LIKE '/en/1%') WHEN 1 THEN path NOT LIKE '/fr/%' ELSE true END AS allowed, CASE k WHEN 0 THEN 2000 END AS delay_ms FROM d""")
def robots_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages robots' rules let a crawler read, rules being told by the host; a third of the hosts have none."""
    links = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract(F.lower("url"), "^https?://([^/?#]+)", 1).alias("host"))
    k = F.length("host") % 3
    body = F.when(k == 0, "User-agent: *\nAllow: /en/1\nDisallow: /en/\nCrawl-delay: 2\n").when(k == 1, "User-agent: *\nDisallow: /fr/\n")
    return search.allowed(links, links.select("host", body.alias("body")).distinct(), "firmgraph").select("page_id", "allowed", "delay_ms")


@query(f"""SELECT (SELECT count(*) FROM customer) AS total_companies, (SELECT count(*) FROM customer WHERE TIMESTAMP '2024-03-01' - to_days(CAST({K} % 30 AS INTEGER)) >= date_trunc('week', TIMESTAMP '2024-03-01')) AS added_this_week, (SELECT count(*) FROM customer WHERE c_acctbal >= 8000) AS rank_a, (SELECT count(*) FROM customer WHERE c_acctbal >= 5000 AND c_acctbal < 8000) AS rank_b,
 (SELECT count(*) FROM customer WHERE {K} % 3 = 0) AS unanalyzed, (SELECT count(*) FROM customer WHERE {K} % 10 = 0) AS sales_restricted, (SELECT count(*) FROM customer WHERE {K} % 4 IN (0, 1)) AS website_unverified, (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 0) AS needs_review_candidates,
 (SELECT count(*) FROM orders WHERE o_orderstatus IN ('O', 'P')) + (SELECT count(*) FROM events WHERE event_type = 'click') AS pending_jobs""")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine counts of the dashboard, customers standing for companies, orders and events for queues."""
    c, now = F.col, F.lit("2024-03-01 00:00:00").cast("timestamp")
    firms = table(spark, sf_dir, "customer").select(F.date_sub(now.cast("date"), (c(K) % 30).cast("int")).cast("timestamp").alias("created_at"), F.when(c("c_acctbal") >= 8000, "A").when(c("c_acctbal") >= 5000, "B").otherwise("C").alias("rank"), F.when(c(K) % 3 != 0, c(K)).alias("analysis_id"), F.when(c(K) % 10 == 0, "false").otherwise("unknown").alias("sales_contact_allowed"), F.when(c(K) % 4 == 0, "unverified").when(c(K) % 4 == 1, "needs_review").otherwise("verified").alias("verification_status"))
    found = table(spark, sf_dir, "supplier").select(F.when(c("s_suppkey") % 5 == 0, "needs_review").otherwise("verified").alias("status"))
    orders = table(spark, sf_dir, "orders").select(F.when(c("o_orderstatus") == "O", "pending").when(c("o_orderstatus") == "P", "retrying").otherwise("done").alias("status"))
    events = table(spark, sf_dir, "events").select(F.when(c("event_type") == "click", "processing").otherwise("done").alias("status"))
    return search.dashboard(firms, found, [orders, events], now)
