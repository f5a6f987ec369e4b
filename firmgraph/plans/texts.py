"""Text functions over documents, conversations and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmgraph.functions import text
from firmgraph.functions.scoring import analysis_priority, range_of, rank_from_score, verification, weighted_score
from firmgraph.functions import dims
from firmgraph.functions.sentences import mentions, refusals, sentence_table, sentences, surest
from firmgraph.operators.crawl import HIRING_TEXT, sales_contact_allowed
from firmgraph.plans.registry import query, table


@query(r"""SELECT doc_id, list_distinct(found) AS emails FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'), lambda e: regexp_replace(lower(e), '^[._-]+', '')),
lambda e: NOT regexp_matches(e, '\.(png|jpe?g|gif|svg|webp|css|js)$|^(example|sample|test|xxx|your|name|user|mail|email|info@example)|@(example|sample|test)\.|@\d+\.\d+') AND length(e) <= 100) AS found FROM documents) d WHERE len(list_distinct(found)) = 1""")
def emails_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of documents that are no placeholders, in their order; the SQL has only documents with a single one."""
    found = table(spark, sf_dir, "documents").select("doc_id", text.emails(F.col("text")).alias("emails"))
    return found.filter(F.size("emails") > 0)


@query(rf"""SELECT doc_id, phones FROM (SELECT doc_id, list_filter(found, lambda x, i: list_position(found, x) = i) AS phones FROM (SELECT doc_id, list_filter(list_transform(
  regexp_extract_all(translate(text, '{text.WIDE}', '{text.NARROW.replace("'", "''")}'), '0\d{{1,4}}[-‐−ー－(（]?\d{{1,4}}[-‐−ー－)）]?\d{{3,4}}'),
  lambda m: CASE WHEN length(regexp_replace(m, '\D', '', 'g')) BETWEEN 10 AND 11 THEN CASE WHEN regexp_matches(m, '[ー−‐―—－-]') THEN regexp_replace(regexp_replace(m, '[()（）\s]', '', 'g'), '[ー−‐―—－]', '-', 'g') ELSE regexp_replace(m, '\D', '', 'g') END END),
  lambda p: p IS NOT NULL AND regexp_matches(regexp_replace(p, '\D', '', 'g'), '^0[1-9]')) AS found FROM documents WHERE text IS NOT NULL) f) g WHERE len(phones) > 0""")
def phones_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domestic phone numbers in documents."""
    return table(spark, sf_dir, "documents").select("doc_id", text.phones(F.col("text")).alias("phones")).filter(F.size("phones") > 0)


@query(r"""SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]{1,}'), lambda w: NOT regexp_full_match(w, '[A-Z0-9-]+')))) AS INTEGER) AS n
FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\.[0-9A-Za-z_.-]{2,}', ' ', 'g'), 'https?://\S+', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL) d""")
def foreign_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different Latin words a text has that are not all capitals."""
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.size(text.foreign_words(F.col("text"))).alias("n"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), ''), '[ \t\f]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS digest FROM documents""")
def whitespace_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each text after collapsing white space."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.collapse_whitespace(F.col("text"))).alias("digest"))


@query(r"SELECT p_partkey, trim(lower(regexp_replace(regexp_replace(regexp_replace(p_name, '(?i)Co\.,?\s*Ltd\.?|Inc\.?|Corp\.?|Corporation|Company|Limited|LLC|K\.K\.', '', 'g'), '\s+', '', 'g'), '[.,_''\"`~()\[\]-]', '', 'g'))) AS key FROM part")
def name_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key by which names are compared."""
    return table(spark, sf_dir, "part").select("p_partkey", text.company_name(F.col("p_name")).alias("key"))


SCORES_SQL = """s AS (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size * 2 AS BIGINT) END AS a, CASE WHEN p_size % 5 <> 0 THEN CAST(p_partkey % 101 AS BIGINT) END AS b, CASE WHEN p_size % 3 <> 0 THEN CAST(floor(p_retailprice / 20) AS BIGINT) END AS c FROM part),
w AS (SELECT p_partkey, coalesce(0.3e0 * least(greatest(a, 0), 100), 0e0) + coalesce(0.2e0 * least(greatest(b, 0), 100), 0e0) + CASE WHEN c IS NULL THEN 0e0 ELSE 0.1e0 * (100 - least(greatest(c, 0), 100)) END AS n,
  CASE WHEN a IS NULL THEN 0e0 ELSE 0.3e0 END + CASE WHEN b IS NULL THEN 0e0 ELSE 0.2e0 END + CASE WHEN c IS NULL THEN 0e0 ELSE 0.1e0 END AS d FROM s),
scored AS (SELECT p_partkey, CASE WHEN d > 0 THEN CAST(floor(round(n / d, 9) + 0.5e0) AS INTEGER) END AS score FROM w)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 2).cast("bigint").alias("a"), F.when(F.col("p_size") % 5 != 0, F.col("p_partkey") % 101).alias("b"), F.when(F.col("p_size") % 3 != 0, F.floor(F.col("p_retailprice") / 20)).alias("c")
    )
    return part.select("p_partkey", weighted_score((("a", 0.3, False), ("b", 0.2, False), ("c", 0.1, True))).alias("score"))


@query(f"WITH {SCORES_SQL} SELECT * FROM scored")
def priority_score_null_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted score in which missing parts leave the denominator."""
    return _scored(spark, sf_dir)


@query(f"WITH {SCORES_SQL} SELECT p_partkey, CASE WHEN score >= 75 THEN 'A' WHEN score >= 55 THEN 'B' WHEN score >= 35 THEN 'C' WHEN score IS NOT NULL THEN 'D' END AS rank FROM scored")
def rank_of_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("p_partkey", rank_from_score(F.col("score")).alias("rank"))


@query("""SELECT c_custkey, score, CASE WHEN score >= 80 THEN 'verified' WHEN score >= 60 THEN 'needs_review' ELSE 'rejected' END AS status FROM (SELECT c_custkey, least(100, CASE WHEN c_custkey % 2 = 0 THEN 40 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN c_acctbal > 0 THEN 20 ELSE 0 END
 + CASE WHEN c_nationkey < 12 THEN 15 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 10 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 10 ELSE 0 END + CASE WHEN c_custkey % 7 = 0 THEN 5 ELSE 0 END) AS score FROM customer) t""")
def verification_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity score out of seven signals."""
    c = F.col
    signals = {"corporate_number": c("c_custkey") % 2 == 0, "official_source": c("c_custkey") % 3 == 0, "website_name": c("c_acctbal") > 0, "address": c("c_nationkey") < 12, "phone": c("c_custkey") % 5 == 0, "domain": c("c_mktsegment") == "BUILDING", "multi_source": c("c_custkey") % 7 == 0}
    return table(spark, sf_dir, "customer").select("c_custkey", verification(signals).alias("v")).select("c_custkey", "v.score", "v.status")


@query("""SELECT user_id, CAST(CASE WHEN errors > 25 THEN 0 ELSE least(100, CASE WHEN signups > 0 THEN 30 ELSE 0 END + least(15, signups * 5) + least(25, purchases * 10) + least(15, clicks * 5) + least(15, CAST(floor(views / 2) AS BIGINT) * 3)) END AS INTEGER) AS priority
FROM (SELECT user_id, count(*) FILTER (event_type = 'error') errors, count(*) FILTER (event_type = 'signup') signups, count(*) FILTER (event_type = 'purchase') purchases, count(*) FILTER (event_type = 'click') clicks, count(*) FILTER (event_type = 'view') views FROM events GROUP BY user_id) u""")
def crawl_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of analysis from counts of facts."""
    n = {k: F.count_if(F.col("event_type") == k).alias(k) for k in ("error", "signup", "purchase", "click", "view")}
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(*n.values())
    return u.select("user_id", analysis_priority(F.col("error") > 25, F.col("signup") > 0, F.col("signup"), F.col("purchase"), F.col("click"), F.col("view")).alias("priority"))


@query("""SELECT p_partkey, CASE WHEN n BETWEEN 1 AND 9 THEN '1-9' WHEN n BETWEEN 10 AND 19 THEN '10-19' WHEN n BETWEEN 20 AND 49 THEN '20-49' WHEN n BETWEEN 50 AND 99 THEN '50-99' WHEN n BETWEEN 100 AND 299 THEN '100-299' WHEN n BETWEEN 300 AND 999 THEN '300-999' WHEN n >= 1000 THEN '1000+' END AS range
FROM (SELECT p_partkey, p_size * p_size - 1 AS n FROM part) t""")
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", range_of(F.col("p_size") * F.col("p_size") - 1).alias("range"))


@query("""SELECT conv_id, turn, CASE WHEN before + n <= 1000 THEN n ELSE 1000 - before END AS taken FROM (SELECT conv_id, turn, n, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT conv_id, turn, length(text) AS n FROM conversations) c) t
WHERE before + n <= 1000 OR (before < 1000 AND 1000 - before >= 200)""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that fit a budget of letters; the one at its end is cut if a fifth of the budget is left for it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    whole = F.col("before") + F.col("n") <= 1000
    fits = rows.filter(whole | ((F.col("before") < 1000) & (1000 - F.col("before") >= 200)))
    return fits.select("conv_id", "turn", F.when(whole, F.col("n")).otherwise(1000 - F.col("before")).cast("bigint").alias("taken"))


@query("""SELECT user_id, event_id, used FROM (SELECT user_id, event_id, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM events) t WHERE used <= 500""")
def running_budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in order until the budget is used up."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.sum(F.floor("value")).over(w).alias("used")).filter("used <= 500")


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.missing'), 'default') AS other FROM events")
def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of stored JSON, with defaults for those that are missing."""
    read = F.from_json("props", "k long, missing string")
    return table(spark, sf_dir, "events").withColumn("p", read).select("event_id", F.coalesce("p.k", F.lit(-1)).alias("k"), F.coalesce("p.missing", F.lit("default")).alias("other"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'closed' WHEN c_nationkey > 20 THEN 'other region' WHEN c_mktsegment <> 'BUILDING' THEN 'other segment' END AS reason FROM customer")
def residual_filter_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason to leave a row out that a source could not be asked about; null for rows that stay."""
    reason = F.coalesce(F.when(F.col("c_acctbal") < 0, "closed"), F.when(F.col("c_nationkey") > 20, "other region"), F.when(F.col("c_mktsegment") != "BUILDING", "other segment"))
    return table(spark, sf_dir, "customer").select("c_custkey", reason.alias("reason"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '42') OR c_custkey = 42")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a keyword in the name or as the identifier; wildcards in it have no meaning."""
    keyword = "42%".replace("%", " ").replace("_", " ").strip().lower()
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").filter(F.lower("c_name").contains(keyword) | (F.col("c_custkey") == int(keyword)))


def _refusals_sql() -> str:
    """The rules of refusals as SQL over a column s of sentences: the first rule that a sentence meets."""
    rules = " ".join(f"WHEN regexp_matches(s, '{p}') THEN {i}" for i, (p, _, _) in enumerate(dims.REFUSALS))
    return f"CASE {rules} END"


#: Wordings that are written into the given texts, by doc_id: one that refuses, one that does not, between sentences or on one long line.
PLANTED = ("営業メールはお断りしております。", "業者の皆様からのご提案は固くお断りします。", "営業時間は九時からです。", "人材紹介のご案内はご遠慮ください。", "本フォームの営業でのご利用はご遠慮ください。", "売り込みの電話は禁止")
SAID = "text || CASE doc_id % 4 WHEN 0 THEN chr(10) ELSE ' ' END || CASE doc_id % 7 {} ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '。ほか' ELSE '' END".format(" ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PLANTED)))


@query(rf"""WITH t AS (SELECT doc_id, {SAID} AS text FROM documents), c AS (SELECT doc_id, regexp_extract_all(text, '[^。
]+[。
]?|[。
]') AS parts FROM t),
r AS (SELECT doc_id, k, s, {_refusals_sql()} AS rule FROM (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS k FROM c) x),
f AS (SELECT doc_id, arg_min(s, row(rule, k)) AS s, min(rule) AS rule, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CAST(n AS INTEGER) AS n, substr(trim(regexp_replace(s, '^\s+|\s+$', '', 'g')), 1, 300) AS sentence, CAST([{", ".join(str(x[2]) for x in dims.REFUSALS)}][rule + 1] AS INTEGER) AS confidence, CASE WHEN [{", ".join(str(x[2]) for x in dims.REFUSALS)}][rule + 1] >= 85 THEN 'false' ELSE 'unknown' END AS allowed FROM f""")
def refused_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that refuse sales contact in whole texts, into which wordings are written by doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(SAID).alias("text"))
    found = docs.withColumn("found", refusals(F.col("text"))).filter("size(found) > 0").withColumn("first", surest(F.col("found")))
    return found.select("doc_id", F.size("found").alias("n"), F.col("first.text").alias("sentence"), F.col("first.confidence").alias("confidence"), sales_contact_allowed(F.col("first.confidence")).alias("allowed"))


@query(r"""WITH c AS (SELECT doc_id, regexp_extract_all(text, '[^。
]+[。
]?|[。
]') AS parts FROM documents),
r AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS k FROM c)
SELECT doc_id, CAST(k - 1 AS INTEGER) AS at, CAST(coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(length(s) AS BIGINT) AS letters FROM r""")
def sentence_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of the texts, with its place."""
    return sentence_table(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "at", "start", F.length("sentence").cast("bigint").alias("letters"))


@query(r"""WITH c AS (SELECT doc_id, regexp_extract_all(text, '[^。
]+[。
]?|[。
]') AS parts FROM documents)
SELECT doc_id, list_transform(list_filter(parts, lambda s: regexp_matches(s, '(?i)recruit|career|entry')), lambda s: trim(s, chr(10) || ' ' || chr(9) || chr(13))) AS said FROM c WHERE len(list_filter(parts, lambda s: regexp_matches(s, '(?i)recruit|career|entry'))) > 0""")
def hiring_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of the texts that speak of hiring."""
    docs = table(spark, sf_dir, "documents").select("doc_id", mentions(sentences(F.col("text")), HIRING_TEXT).alias("said"))
    return docs.filter("size(said) > 0")
