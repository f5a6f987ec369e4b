"""A step of a search in the registry, what may be asked of it, and gates and filters around it."""

from __future__ import annotations

import urllib.robotparser
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmgraph.functions import text, urls
from firmgraph.functions.dims import INDUSTRIES, PREFECTURES
from firmgraph.operators.planning import running_sums
from firmgraph.operators.resolve import register
from firmgraph.sources.registry import residual_reason

#: Entries of a page, pages of a step.
PAGE, PAGES = 50, 6
#: Fixed values of what can be asked for: how many companies, by default and at most; employees at most; letters of texts.
REQUESTED, MOST_REQUESTED, MOST_EMPLOYEES = 50, 500, 1_000_000
LETTERS = {"city": 50, "industry_subcategory": 50, "keyword": 100}


def criteria(raw: dict[str, str]) -> tuple[dict, list[str]]:
    """What a form asks for, as values, and the fields that are wrong; empty fields are left out, those with a default have it."""
    given = {k: v.strip() if isinstance(v, str) else v for k, v in raw.items() if v not in (None, "") and not (isinstance(v, str) and not v.strip())}
    out, wrong = {"requested": REQUESTED, "require_website": True, "require_recruiting": False}, []
    among = {"prefecture": PREFECTURES, "industry": [k for k, _ in INDUSTRIES]}
    between = {"requested": (1, MOST_REQUESTED), "employee_min": (0, MOST_EMPLOYEES), "employee_max": (0, MOST_EMPLOYEES)}
    for k, v in given.items():
        if k in among and v in among[k] or k in LETTERS and len(v) <= LETTERS[k]:
            out[k] = v
        elif k in between and str(v).lstrip("-").isdigit() and between[k][0] <= int(v) <= between[k][1]:
            out[k] = int(v)
        elif k in ("require_website", "require_recruiting") and str(v).lower() in ("on", "true", "1", "off", "false", "0"):
            out[k] = str(v).lower() in ("on", "true", "1")
        else:
            wrong.append(k)
    return out, sorted(wrong)


def described(asked: dict) -> str:
    """What is asked for, in words, joined by strokes; what is not asked for is left out."""
    staff = f"{asked.get('employee_min', '')}〜{asked.get('employee_max', '')}名" if {"employee_min", "employee_max"} & asked.keys() else None
    word = f'"{asked["keyword"]}"' if asked.get("keyword") else None
    parts = [asked.get("prefecture"), asked.get("city"), asked.get("industry"), asked.get("industry_subcategory"), word, staff, f"{asked['requested']}社"]
    return " / ".join(p for p in parts if p)


def search_step(entries: DataFrame, companies: DataFrame, asked: dict, cursor: int = 1, registered: int = 0, page: int = PAGE, pages: int = PAGES) -> tuple[DataFrame, DataFrame]:
    """The items of the next pages of a search: place, corporate_number, company_name, status, reason, company_id; and the companies to crawl.

    entries(place, and the columns that registry.company_rows takes) are the registry's answer, from place 0 on; only the places of the pages are read, which a
    sorted table prunes. An entry is skipped with the reason why it does not fit, or for want of a site where one is asked for; the others are registered in
    order, as new or duplicate, until enough companies are. companies(company_id, corporate_number, domain, normalized_name, address_key, crawl_status).
    """
    c = F.col
    low, high = (cursor - 1) * page, (cursor - 1 + pages) * page
    rows = entries.filter((c("place") >= low) & (c("place") < high) & (F.trim("name") != ""))
    why = residual_reason(asked.get("city"), asked.get("industry"), asked.get("employee_min"), asked.get("employee_max"))
    no_site = F.when(F.lit(bool(asked.get("require_website"))) & urls.normal_url(c("company_url")).isNull(), "no site")
    judged = rows.withColumn("why", F.coalesce(why, no_site)).withColumn("fits", c("why").isNull().cast("int"))
    # those that come before enough are registered
    counted = running_sums(judged, ["place"], "fits", "upto").filter(c("upto") - c("fits") < asked["requested"] - registered)
    keyed = counted.filter("fits = 1").select("place", text.corporate_number(c("corporate_number")).alias("corporate_number"), urls.host(c("company_url")).alias("domain"), text.company_name(c("name")).alias("normalized_name"), text.address(c("location")).alias("address_key"))
    told = register(companies, keyed.select(c("place").alias("id"), "corporate_number", "domain", "normalized_name", "address_key"))
    items = counted.select("place", "corporate_number", F.trim("name").alias("company_name"), "why").join(told.withColumnRenamed("id", "place"), "place", "left")
    items = items.select("place", "corporate_number", "company_name", F.coalesce("status", F.lit("skipped")).alias("status"), F.coalesce("why", "reason").alias("reason"), "company_id")
    fresh = items.filter("status = 'new'").select("company_id")
    waiting = companies.filter("crawl_status = 'not_crawled'").select(c("company_id").cast("string").alias("company_id"))
    again = items.filter("status = 'duplicate'").select("company_id").join(waiting, "company_id", "left_semi")
    return items, fresh.unionAll(again).distinct()


def filtered_log(rows: DataFrame, category: str | None = None, level: str | None = None) -> DataFrame:
    """The rows of a log of a category and a level, as far as they are asked for."""
    for name, value in (("category", category), ("level", level)):
        rows = rows if value is None else rows.filter(F.col(name) == value)
    return rows


def address_like(page: Column, home: Column | None = None) -> Column:
    """Distinct runs of a text that look like addresses, sorted: those with a prefecture, else, where a home prefecture is known, those with a municipality."""
    whole = "(?:" + "|".join(PREFECTURES) + r")[^\s、。|｜]{4,30}"
    short = r"[一-龥ぁ-んァ-ヶ]{2,8}(?:市|区|郡|町|村)[^\s、。|｜]{3,24}"
    of = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(p), F.lit(0))))
    if home is None:
        return of(whole)
    return F.when((F.size(of(whole)) > 0) | home.isNull(), of(whole)).otherwise(of(short))


def allowed(links: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """links(host, url) with allowed and delay_ms, by robots(host, body); a host without a body allows all. A host's rules are read once a batch."""
    rules = robots.filter(F.col("body").isNotNull()).groupBy("host").agg(F.min("body").alias("body"))
    met = links.join(rules, "host", "left")
    kinds = {f.name: f.dataType.simpleString() for f in met.drop("body").schema}

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsers: dict = {}
            yes, delays = [], []
            for host, body, url in zip(batch["host"], batch["body"], batch["url"]):
                if body is None or body != body:
                    yes.append(True)
                    delays.append(None)
                    continue
                if (host, body) not in parsers:
                    parsers[host, body] = p = urllib.robotparser.RobotFileParser()
                    p.parse(body.splitlines())
                p = parsers[host, body]
                wait = p.crawl_delay(agent)
                yes.append(bool(p.can_fetch(agent, url)))
                delays.append(None if wait is None else int(float(wait) * 1000))
            yield batch.drop(columns="body").assign(allowed=yes, delay_ms=pd.array(delays, "Int64"))

    return met.mapInPandas(judge, ", ".join([*(f"{k} {v}" for k, v in kinds.items()), "allowed boolean, delay_ms long"]))


def dashboard(companies: DataFrame, candidates: DataFrame, queues: list[DataFrame], now: Column) -> DataFrame:
    """One row of nine counts: companies(created_at, rank, analysis_id, sales_contact_allowed, verification_status), candidates(status), and queues(status) of which four kinds wait. Each table is read once."""
    is_ = lambda name, *values: F.count_if(F.col(name).isin(*values))
    firms = companies.agg(
        F.count("*").alias("total_companies"), F.count_if(F.col("created_at") >= F.date_trunc("WEEK", now)).alias("added_this_week"), is_("rank", "A").alias("rank_a"), is_("rank", "B").alias("rank_b"),
        F.count_if(F.col("analysis_id").isNull()).alias("unanalyzed"), is_("sales_contact_allowed", "false").alias("sales_restricted"), is_("verification_status", "unverified", "needs_review").alias("website_unverified"),
    )
    found = candidates.agg(is_("status", "needs_review").alias("needs_review_candidates"))
    waiting = queues[0].select("status")
    for q in queues[1:]:
        waiting = waiting.unionAll(q.select("status"))
    jobs = waiting.agg(is_("status", "pending", "retrying", "processing", "running").alias("pending_jobs"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    return one(firms).join(one(found), "__one").join(one(jobs), "__one").drop("__one")
