"""Input tables that stand for outside services, with the choice among them and lookups in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmgraph.functions import text, urls
from firmgraph.functions.dims import INDUSTRIES
from firmgraph.functions.text import company_name, prefecture
from firmgraph.operators.resolve import keep_first


def usable_sources(wanted: list[str], available: dict[str, bool]) -> tuple[list[str], dict[str, str]]:
    """Those of the wanted sources that can be read, and the reason for each of the others."""
    good = [s for s in wanted if available.get(s)]
    return good, {s: "not configured" if s in available else "unknown" for s in wanted if s not in good}


def read_source(observations: DataFrame, source: str) -> DataFrame:
    """The rows of one source; a table that is partitioned by source is pruned."""
    return observations.filter(F.col("source") == source)


def lookup(rows: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """rows with the registry's row of the same key, the first by all its columns if it has several."""
    details = keep_first(registry.filter(F.col(key).isNotNull()), [key], [F.to_json(F.struct("*"))])
    return rows.join(details, key, "left")


def enrich_by_name(rows: DataFrame, registry: DataFrame, id: str) -> DataFrame:
    """id, registry row: the first registry entry (by ord) with the same normalised name and no other prefecture."""
    left = rows.select(id, company_name(F.col("name")).alias("__name"), prefecture(F.col("address")).alias("__pref"))
    right = registry.select(company_name(F.col("name")).alias("__name"), prefecture(F.col("location")).alias("__where"), F.struct("*").alias("entry"), "ord")
    hits = left.join(right, "__name").filter(F.col("__pref").isNull() | F.col("__where").isNull() | (F.col("__pref") == F.col("__where")))
    return keep_first(hits, [id], ["ord"]).select(id, "entry")


def first_per_host(hits: DataFrame, host: Column, keep: Column) -> DataFrame:
    """Search hits that are kept, the first of each host by rank."""
    return keep_first(hits.withColumn("host", host).filter(keep & F.col("host").isNotNull()), ["host"], ["rank"])


#: Names of bodies that have a corporate number but are no companies.
PUBLIC_BODIES = (
    "財産区$",
    "検察審査会$",
    "裁判所$",
    "(法務|税務|労働|運輸|気象|検疫|森林|河川|港湾)局$",
    "^(国|地方)",
    "(都道府県|市|区|町|村)役所$",
    "(議会|教育委員会|選挙管理委員会|人事委員会|監査委員)$",
    "(公安委員会|警察署|消防署|保健所)$",
    "(独立行政法人|国立大学法人|公立大学法人|地方独立行政法人)",
    "(土地改良区|water|水利組合)",
    "(共済組合|健康保険組合|国民健康保険団体連合会)$",
    "(社会福祉協議会|商工会議所|商工会)$",
)


def is_public_body(name: Column) -> Column:
    return F.coalesce(F.trim(name).rlike("|".join(f"(?:{p})" for p in PUBLIC_BODIES)), F.lit(False))


def residual_reason(city: str | None = None, industry: str | None = None, least: int | None = None, most: int | None = None) -> Column:
    """Why a row(name, location, close_date, business_items, business_summary, employee_number) is not what is searched for, by what the registry's own search cannot tell; null if it fits.

    Rows without any statement of industry or size are let through.
    """
    c = F.col
    items = F.coalesce(F.array_join("business_items", " "), F.lit(""))
    said = F.concat_ws(" ", items, F.coalesce("business_summary", F.lit("")), F.coalesce("name", F.lit("")))
    wanted = dict(INDUSTRIES).get(industry, "").split()
    named = F.greatest(*[F.contains(said, F.lit(w)).cast("int") for w in wanted], F.lit(0), F.lit(0)) == 1
    told = (items != "") | (F.coalesce("business_summary", F.lit("")) != "")
    staff = text.employee_count(c("employee_number"))
    return F.coalesce(
        F.when(is_public_body(c("name")), "public body"),
        F.when(F.coalesce("close_date", F.lit("")) != "", "closed"),
        *([F.when(~F.contains(F.coalesce("location", F.lit("")), F.lit(city)), "other city")] if city else []),
        *([F.when(told & ~named, "other industry")] if wanted else []),
        *([F.when(staff < least, "too few employees")] if least is not None else []),
        *([F.when(staff > most, "too many employees")] if most is not None else []),
    )


def company_rows(entries: DataFrame, industry: str | None = None) -> DataFrame:
    """Registry entries as rows of companies, with all values normalised."""
    c = F.col
    said = F.concat_ws(" ", F.coalesce(F.array_join("business_items", " "), F.lit("")), F.coalesce("business_summary", F.lit("")), F.coalesce("name", F.lit("")))
    capital = F.regexp_replace(text.half_width(c("capital_stock")), r"[^\d]", "").try_cast("long")
    return entries.select(
        text.corporate_number(c("corporate_number")).alias("corporate_number"),
        F.trim("name").alias("company_name"),
        c("location").alias("address"),
        prefecture(c("location")).alias("prefecture"),
        text.city(c("location")).alias("city"),
        F.regexp_replace(text.half_width(c("postal_code")), r"^(.*?)(\d{3})(\d{4})", "$1$2-$3").alias("postal_code"),
        F.coalesce(F.lit(industry).cast("string"), text.industry(said)).alias("industry"),
        F.array_join("business_items", " / ").alias("industry_detail"),
        text.employee_count(c("employee_number")).alias("employee_count"),
        F.when(capital > 0, capital).alias("capital"),
        text.normal_date(c("date_of_establishment")).alias("established_date"),
        urls.normal_url(c("company_url")).alias("website_url"),
    )
