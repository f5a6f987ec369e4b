"""The company list: request parameters to filters, filters to one predicate, named sorts, pages.

It works on any overview with the columns that the chosen filters name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An analysis below this confidence does not count; page sizes and the sorts with their column and direction.
LEAST_CONFIDENCE = 30
PER_PAGE = (10, 50, 200)  # least, default, most
SORTS = {
    "priority": ("sales_priority_score", False),
    "newest": ("created_at", False),
    "recruitment_issue": ("recruitment_issue_score", False),
    "sns_issue": ("sns_activity_score", True),
    "web_issue": ("web_quality_score", True),
    "dx": ("dx_opportunity_score", False),
    "employees": ("employee_count", False),
    "name": ("company_name", True),
    "analyzed": ("analyzed_at", False),
}

TEXTS = ("q", "prefecture", "industry", "employeeRange", "rank", "recruitTarget")
SCORES = ("minPriority", "minRecruitIssue", "maxSns", "maxWeb")
SWITCHES = (
    "recruiting", "includeNoRecruitSignal", "hasWebsite", "hasContact", "hasEmail", "hasOutreach", "includeLowConfidence", "includeRestricted",
    "includeUnverifiedSite", "excludeRestricted", "unanalyzed", "needsReview",
)


def defaults() -> dict:
    return {**dict.fromkeys(TEXTS + SCORES), **dict.fromkeys(SWITCHES, False), "sort": "priority", "page": 1, "perPage": PER_PAGE[1]}


def parse(params: dict) -> dict:
    """Filters of request parameters; blank ones are absent, and with one that is invalid all take their defaults."""
    given = {k: v[0] if isinstance(v, (list, tuple)) else v for k, v in params.items() if not (isinstance(v, (list, tuple)) and not v)}
    given = {k: v for k, v in given.items() if v is not None and str(v).strip() != ""}
    out = defaults()
    try:
        for name in TEXTS:
            out[name] = str(given[name]) if name in given else None
        for name in SCORES:
            out[name] = _number(given[name], 0, 100) if name in given else None
        for name in SWITCHES:
            out[name] = given.get(name) in ("1", "true", "on", True)
        out["sort"] = given.get("sort", "priority")
        out["page"] = _whole(given.get("page", "1"), 1, math.inf)
        out["perPage"] = _whole(given.get("perPage", str(PER_PAGE[1])), PER_PAGE[0], PER_PAGE[2])
        if out["sort"] not in SORTS:
            raise ValueError(out["sort"])
    except ValueError:
        return defaults()
    return out


def _number(value, least: float, most: float) -> float:
    x = float(value)
    if not least <= x <= most:
        raise ValueError(value)
    return x


def _whole(value, least: float, most: float) -> int:
    x = _number(value, least, most)
    if x != int(x):
        raise ValueError(value)
    return int(x)


def to_params(filters: dict) -> dict[str, str]:
    """The parameters that parse to the same filters; what is absent or a default is left out."""
    usual = defaults()
    shown = lambda v: "1" if v is True else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return {k: shown(v) for k, v in filters.items() if v not in (None, "", False) and usual.get(k) != v}


def predicate(filters: dict) -> Column:
    """The rows of an overview that the filters let through. What a default leaves out has a switch that lets it in."""
    c, on = F.col, {**defaults(), **filters}
    none_or = lambda name, test: c(name).isNull() | test
    term = (on["q"] or "").replace("%", " ").replace("_", " ").strip()
    found = [F.contains(F.lower(name), F.lit(term.lower())) for name in ("company_name", "website_domain")] if term else []
    if term.isdigit() and len(term) == 13:
        found.append(c("corporate_number") == term)
    equal = {"prefecture": "prefecture", "industry": "industry", "employeeRange": "employee_range", "rank": "sales_priority_rank", "recruitTarget": "recruit_target"}
    flags = {"hasWebsite": "has_website", "hasContact": "has_contact", "hasEmail": "has_email", "hasOutreach": "has_outreach"}
    clauses = [
        *([found[0] | found[1] | (found[2] if len(found) > 2 else F.lit(False))] if found else []),
        *[c(column) == on[name] for name, column in equal.items() if on[name]],
        *[c(column) for name, column in flags.items() if on[name]],
        *([c("sales_priority_score") >= on["minPriority"]] if on["minPriority"] is not None else []),
        *([c("recruitment_issue_score") >= on["minRecruitIssue"]] if on["minRecruitIssue"] is not None else []),
        *([c("sns_activity_score") <= on["maxSns"]] if on["maxSns"] is not None else []),
        *([c("web_quality_score") <= on["maxWeb"]] if on["maxWeb"] is not None else []),
        *([c("recruiting_status") == "active"] if on["recruiting"] else []),
        *([c("sales_contact_allowed") == "true"] if on["excludeRestricted"] else []),
        *([c("analysis_id").isNull()] if on["unanalyzed"] else []),
        *([c("verification_status").isin("needs_review", "unverified")] if on["needsReview"] else []),
        *([] if on["includeRestricted"] else [c("sales_contact_allowed") != "false"]),
        *([] if on["includeUnverifiedSite"] else [c("website_url").isNotNull() & c("verification_status").isin("verified", "manual")]),
        *([] if on["includeNoRecruitSignal"] else [none_or("recruit_target", c("recruit_target") != "no_signal")]),
        *([] if on["includeLowConfidence"] else [none_or("analysis_id", (c("confidence_score") >= LEAST_CONFIDENCE) & c("sales_priority_rank").isNotNull())]),
    ]
    out = F.lit(True)
    for clause in clauses:
        out = out & clause
    return out


def order(filters: dict, id: str) -> list[Column]:
    """Nulls last; of equal ones the newest first, then by id."""
    column, ascending = SORTS[filters.get("sort", "priority")]
    first = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    return [first, *([] if column == "created_at" else [F.desc("created_at")]), F.col(id)]


def page(overview: DataFrame, filters: dict, id: str) -> DataFrame:
    """One page of the list."""
    on = {**defaults(), **filters}
    return overview.filter(predicate(on)).orderBy(*order(on, id)).offset((on["page"] - 1) * on["perPage"]).limit(on["perPage"])
