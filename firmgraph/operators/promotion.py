"""What follows from decisions about sites: promoted candidates with their sources and crawls, and retracted sites with all that came from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmgraph.operators import tables
from firmgraph.operators.resolve import keep_first

#: What a company has from its site only; a refusal of contact stays, to be safe.
FROM_SITE = (
    "email", "phone", "contact_page_url", "contact_form_url", "recruit_page_url", "recruit_target", "recruit_target_reasons", "job_boards", "instagram_url", "facebook_url",
    "x_url", "youtube_url", "linkedin_url", "tiktok_url", "latest_analysis_id",
)
SITE = ("website_url", "website_domain", "official_site_confidence")
#: What shows that something of a site is left.
LEFT_OVER = ("contact_form_url", "contact_page_url", "email", "recruit_page_url", "phone", "latest_analysis_id")


def retracted_sites(companies: DataFrame, bad: DataFrame) -> DataFrame:
    """Companies(id, the columns of SITE and FROM_SITE, website_candidates array<string>, statuses) after the sites of bad(id, reason) are taken away.

    A retracted site stays among the candidates with the reason, the company needs a review, and the analysis is void. Companies that
    had lost their site before and still show something of it are cleaned as well.
    """
    reasons = bad.groupBy(F.col("id").alias("id")).agg(F.min("reason").alias("__reason"))
    rows = companies.join(reasons, "id", "left")
    hit = F.col("__reason").isNotNull() & F.col("website_url").isNotNull()
    rows = rows.withColumn("__hit", hit)
    note = F.concat_ws(": ", "website_url", "__reason")
    rows = tables.update_where(rows, F.col("__hit"), website_candidates=F.concat(F.coalesce("website_candidates", F.array().cast("array<string>")), F.array(note)), verification_status=F.lit("needs_review"), crawl_status=F.lit("no_website"))
    rows = tables.retract(rows, F.col("__hit"), SITE)
    left = F.col("__hit") | (F.col("website_url").isNull() & F.coalesce(*[F.col(c).cast("string") for c in LEFT_OVER]).isNotNull())
    rows = tables.update_where(rows.withColumn("__left", left), F.col("__left"), analysis_status=F.lit("not_analyzed"))
    return tables.retract(rows, F.col("__left"), FROM_SITE).drop("__reason", "__hit", "__left")


def company_sources(observations: DataFrame, sites: DataFrame) -> DataFrame:
    """company_id, provider, external_id, source_url, source_type, confidence: where what is known of a company comes from.

    observations(company_id, provider, external_id, source_url, confidence); sites(company_id, website, domain, confidence) are verified
    sites, a source of their own. Of rows that say the same, the most certain one stays; nulls and empty texts are the same.
    """
    seen = observations.select("company_id", "provider", "external_id", "source_url", F.lit("discovery").alias("source_type"), "confidence")
    own = sites.filter(F.col("website").isNotNull() & F.col("confidence").isNotNull()).select("company_id", F.lit("official_web").alias("provider"), F.col("domain").alias("external_id"), F.col("website").alias("source_url"), F.lit("verification").alias("source_type"), "confidence")
    same = [F.coalesce(c, F.lit("")).alias(c) for c in ("external_id", "source_url")]
    best = seen.unionByName(own).groupBy("company_id", "provider", *same, "source_type").agg(F.max("confidence").alias("confidence"))
    return best.select("company_id", "provider", *[F.nullif(c, F.lit("")).alias(c) for c in ("external_id", "source_url")], "source_type", "confidence")


def crawls(promoted: DataFrame, recruiting_required: bool, known: DataFrame) -> DataFrame:
    """company_id of promoted(company_id, website, recruiting_signal) whose site is to be crawled, each once, without those that known(company_id) has in its queue.

    Where a run looks for companies that hire, one whose site shows no hiring is not crawled.
    """
    wanted = F.col("website").isNotNull() & ~(F.lit(recruiting_required) & F.coalesce(F.col("recruiting_signal") == "no", F.lit(False)))
    return promoted.filter(wanted).select("company_id").distinct().join(known.select("company_id"), "company_id", "left_anti")


def backfilled(companies: DataFrame, registered: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    """Companies with what they lacked, from the first of their duplicates that has it; a value that is there stays.

    registered(id, company_id), incoming(id, columns).
    """
    offers = registered.join(incoming.select("id", *columns), "id")
    first = offers.groupBy("company_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"__{c}") for c in columns])
    return companies.join(first, "company_id", "left").withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def source_of(provider: Column) -> Column:
    """How a company's source is named: registry and places by themselves, all else as an import."""
    return F.when(provider.isin("gbiz", "google_places"), provider).otherwise("import")


def promoted(candidates: DataFrame, registered: DataFrame) -> DataFrame:
    """candidates(id, ...) with company_id and whether it is new, of registered(id, company_id, status); of candidates with one id, one."""
    told = keep_first(registered, ["id"], ["company_id"]).select("id", "company_id", (F.col("status") == "new").alias("created"))
    return candidates.join(told, "id")
