"""Stages of a discovery run: candidates out of observations, official sites, verification, promotion, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmgraph.functions import scoring, text, urls
from firmgraph.functions.dims import OFFICIAL_SITE_FROM
from firmgraph.functions.names import clean_company_name, is_plausible_company
from firmgraph.operators.resolve import Saved, keep_first

DIRECTORY_WORDS = "企業一覧|会員一覧|会員企業|会員紹介|加盟店|掲載企業|事業所一覧|企業検索|企業情報検索|会社検索|求人情報|求人検索|ポータル|データベース|登録企業|取引先検索|口コミ"


def candidates(observations: DataFrame) -> DataFrame:
    """Observations with a name that can be a company's, with all keys normalised; the raw name stays as original_name."""
    c = F.col
    rows = observations.withColumnRenamed("name", "original_name").withColumn("name", clean_company_name(c("original_name"))).filter(is_plausible_company(c("name")))
    return rows.withColumns({
        "normalized_name": text.company_name(c("name")),
        "prefecture": text.prefecture(c("address")),
        "city": text.city(c("address")),
        "address_key": text.address(c("address")),
        "phone": text.phone(c("phone")),
        "website": urls.normal_url(c("website")),
        "domain": urls.host(c("website")),
        "corporate_number": text.corporate_number(c("corporate_number")),
        "source_confidence": scoring.clamp(c("source_confidence")),
    })


def criteria_mismatch(prefecture: str | None, city: str | None) -> Column:
    """Why a candidate is outside of what is searched for; what is not known does not count."""
    return F.coalesce(
        F.when(F.lit(prefecture).isNotNull() & (F.col("prefecture") != F.lit(prefecture)), "other prefecture"),
        F.when(F.lit(city).isNotNull() & ~F.contains("address", F.lit(city)), "other city"),
    )


def looks_like_directory(title: Column, body: Column) -> Column:
    """Six different company names, or three and the words of a directory."""
    hay = F.concat_ws("\n", title, body)
    n = lambda x: F.size(F.array_distinct(F.regexp_extract_all(x, F.lit(r"(株式会社|有限会社|合同会社|合資会社)[^\s、。・|｜/（）()【】\[\]]{2,14}"), F.lit(0))))
    return F.coalesce(text.let(hay, lambda x: (n(x) >= 6) | ((n(x) >= 3) & x.rlike(DIRECTORY_WORDS))), F.lit(False))


def domain_ownership(name: Column, url: Column, root_title: Column, root_text: Column) -> Column:
    """struct(owned, confirmed, reason): whether a site is the company's own, judged by its root page.

    A site is refused only where it is known to be a directory; without evidence it is owned, but not confirmed.
    """
    bare, key, core = text.without_legal_form(name), text.company_name(name), text.company_core(name)
    title, page = text.half_width(F.coalesce(root_title, F.lit(""))), text.company_name(F.substring(F.coalesce(root_text, F.lit("")), 1, 20_000))
    verdict = lambda owned, sure, why: F.struct(F.lit(owned).alias("owned"), F.lit(sure).alias("confirmed"), F.lit(why).alias("reason"))
    return (
        F.when(urls.domain_matches_name(name, urls.host(url)), verdict(True, True, "domain from name"))
        .when((F.coalesce(root_title, F.lit("")) == "") & (F.coalesce(root_text, F.lit("")) == ""), verdict(True, False, "root page unknown"))
        .when((bare != "") & F.contains(title, bare), verdict(True, True, "name in title"))
        .when((key != "") & F.contains(page, key), verdict(True, True, "name on root page"))
        .when(core.isNotNull() & (F.contains(title, core) | F.contains(page, text.company_name(core))), verdict(True, True, "same group"))
        .when(urls.is_record_page(url), verdict(False, False, "record page"))
        .when(looks_like_directory(root_title, root_text), verdict(False, False, "directory"))
        .otherwise(verdict(True, False, "undecided"))
    )


def official_sites(companies: DataFrame, sites: DataFrame) -> DataFrame:
    """company_id, url, confidence, reasons, status: the best candidate site of each company.

    companies(company_id, name, address, phone, corporate_number, representative_name);
    sites(company_id, url, source, title, snippet, page_text, root_title, root_text, ord), of which the first of equal ones is taken.
    """
    c = F.col
    rows = sites.join(companies, "company_id").withColumn("own", domain_ownership(c("name"), c("url"), c("root_title"), c("root_text")))
    title, body = text.half_width(F.coalesce("title", F.lit(""))), text.half_width(F.coalesce("page_text", F.lit("")))
    rows = rows.withColumns({"t": title, "b": body, "hay": F.concat_ws("\n", title, text.half_width(F.coalesce("snippet", F.lit(""))), body), "bare": text.without_legal_form(c("name")), "digits": F.regexp_replace(text.phone(c("phone")), r"\D", "")})
    yes = lambda x: F.coalesce(x, F.lit(False))
    score = scoring.site_confidence(
        F.coalesce(urls.site_reject_reason(c("url")), F.when(~c("own.owned"), c("own.reason"))),
        c("source"),
        yes((c("bare") != "") & F.contains("t", "bare")),
        yes((text.company_name(c("name")) != "") & F.contains(text.company_name(F.substring("hay", 1, 20_000)), text.company_name(c("name")))),
        c("title").isNotNull() | c("page_text").isNotNull(),
        urls.domain_matches_name(c("name"), urls.host(c("url"))),
        yes((c("b") != "") & text.appears(text.address_keys(c("address")), text.address(c("b")))),
        yes(F.contains(F.regexp_replace("b", r"\D", ""), c("digits"))),
        yes(F.contains("b", c("corporate_number"))),
        yes((c("representative_name") != "") & F.contains("b", F.regexp_replace(text.half_width(c("representative_name")), r"\s", ""))),
        c("hay").rlike("(?i)会社概要|企業情報|会社案内|company|about"),
        c("own.confirmed"),
    )
    scored = rows.withColumn("score", score).filter(urls.host(c("url")).isNotNull()).select("company_id", "url", "ord", "score.confidence", "score.reasons")
    best = keep_first(scored, ["company_id"], [F.desc("confidence"), "ord"]).drop("ord")
    status = F.when(c("confidence") >= OFFICIAL_SITE_FROM, "verified").when(c("confidence").isNotNull(), "needs_review").otherwise("no_website")
    return companies.select("company_id").join(best, "company_id", "left").withColumn("status", status)


def verified(found: DataFrame) -> DataFrame:
    """found(normalized_name, address, phone, domain, corporate_number, sources, site_title, site_text, site_confidence) with verification(score, status, matched)."""
    c = F.col
    body = F.coalesce(text.half_width(c("site_text")), F.lit(""))
    page = text.company_name(F.concat_ws("\n", "site_title", F.substring(body, 1, 20_000)))
    digits = F.regexp_replace("phone", r"\D", "")
    return found.withColumn("verification", scoring.verification({
        "corporate_number": c("corporate_number").isNotNull(),
        "official_source": F.arrays_overlap("sources", F.array(F.lit("gbiz"), F.lit("edinet"))),
        "website_name": (c("normalized_name") != "") & F.contains(page, c("normalized_name")),
        "address": (body != "") & text.appears(text.address_keys(c("address")), text.address(body)),
        "phone": (F.length(digits) >= 10) & F.contains(F.regexp_replace(body, r"\D", ""), digits),
        "domain": c("domain").isNotNull() & (F.coalesce("site_confidence", F.lit(0)) >= OFFICIAL_SITE_FROM),
        "multi_source": F.size("sources") >= 2,
    }))


def apply_reviews(found: DataFrame, actions: DataFrame) -> DataFrame:
    """Candidates after manual actions(candidate_id, action, website, reason, reviewed_by, at); the last action of each holds."""
    last = keep_first(actions, ["candidate_id"], [F.desc("at"), "action"]).select("candidate_id", "action", F.col("website").alias("new_site"), F.col("reason").alias("why"), F.col("reviewed_by").alias("by"))
    rows = found.join(last, "candidate_id", "left")
    status = F.when(F.col("action") == "approve", "verified").when(F.col("action") == "reject", "rejected").when(F.col("action") == "correct", "discovered").otherwise(F.col("status"))
    return rows.withColumns({
        "status": status,
        "website": F.when(F.col("action").isin("approve", "correct"), F.coalesce(urls.normal_url(F.col("new_site")), F.col("website"))).otherwise(F.col("website")),
        "reject_reason": F.when(F.col("action") == "reject", F.col("why")).otherwise(F.col("reject_reason")),
        "reviewed_by": F.coalesce("by", "reviewed_by"),
    }).drop("action", "new_site", "why", "by")


def assign_sites(found: DataFrame, least: int | None = None) -> DataFrame:
    """company_id, domain, score, place, status, conflict: one domain for each company and one company for each domain, of found(company_id, domain, score, ord).

    Companies propose to their domains from the best score (then least ord) on; a domain keeps its best proposal (then the least id), and the
    others go on to their next one, until nobody is turned away: no company and domain would both rather have each other. A round is a
    join and an aggregate by domain, over the companies that still move; a domain that many want keeps one row of each task. place is
    which of its domains a company got; who did not get its first one needs a review, with the company that has it.
    """
    spark = found.sparkSession
    saved = Saved(spark, "assigned")
    good = found.filter(F.col("domain").isNotNull() & F.col("score").isNotNull())
    if least is not None:
        good = good.filter(F.col("score") >= least)
    once = keep_first(good, ["company_id", "domain"], [F.desc("score"), "ord"])
    place = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("score"), "ord", "domain"))
    ranked = saved.save(once.select("company_id", "domain", "score", place.alias("place")), "ranked")
    moving, held, turn = ranked.filter("place = 1"), None, 0
    while True:
        asked = moving if held is None else held.unionByName(moving)
        rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("score"), "company_id"))
        told = saved.save(asked.withColumn("rank", rank), f"told-{turn}")
        held = told.filter("rank = 1").drop("rank")
        away = told.filter("rank > 1").select("company_id", (F.col("place") + 1).alias("place"))
        moving = saved.save(ranked.join(away, ["company_id", "place"]).select("company_id", "domain", "score", "place"), f"moving-{turn}")
        if turn:
            saved.drop(f"told-{turn - 1}")
            saved.drop(f"moving-{turn - 1}")
        if not moving.limit(1).count():
            break
        turn += 1
    first = ranked.filter("place = 1").select("company_id", F.col("domain").alias("wanted"))
    rows = found.select("company_id").distinct().join(held, "company_id", "left").join(first, "company_id", "left")
    rows = rows.join(held.select(F.col("domain").alias("wanted"), F.col("company_id").alias("owner")), "wanted", "left")
    lost = F.col("wanted").isNotNull() & ~F.coalesce(F.col("place") == 1, F.lit(False))
    status = F.when(F.col("wanted").isNull(), "no_website").when(lost, "needs_review").otherwise("verified")
    return rows.select("company_id", "domain", "score", "place", status.alias("status"), F.when(lost, F.col("owner")).alias("conflict"))
