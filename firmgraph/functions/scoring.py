"""Scores, ranks and buckets as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: int = 0, high: int = 100) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def round_half_up(value: Column) -> Column:
    """Half-up rounding to a whole number; the inner round takes away binary noise of sums such as .3 + .2."""
    return F.floor(F.round(value, 9) + F.lit(0.5)).cast("int")


def weighted_score(parts: Iterable[tuple[str, float, bool]]) -> Column:
    """Weighted mean of 0-100 columns; inverted ones count as 100 - x, nulls leave the denominator, all null gives null."""
    top, weights = F.lit(0.0), F.lit(0.0)
    for name, weight, inverted in parts:
        x = F.least(F.greatest(F.col(name), F.lit(0)), F.lit(100))
        x = F.when(F.col(name).isNotNull(), 100 - x if inverted else x)
        top = top + F.coalesce(F.lit(weight) * x, F.lit(0.0))
        weights = weights + F.when(F.col(name).isNull(), 0.0).otherwise(weight)
    return round_half_up(F.when(weights > 0, top / weights))


def rank_from_score(score: Column) -> Column:
    """A from 75, B from 55, C from 35, else D; no score, no rank."""
    return F.when(score >= 75, "A").when(score >= 55, "B").when(score >= 35, "C").when(score.isNotNull(), "D")


def range_of(count: Column, ranges=None) -> Column:
    """The key of the range of counts that holds a count; null for none and for what is not positive."""
    from firmgraph.functions.dims import EMPLOYEE_RANGES

    out = F.lit(None).cast("string")
    for key, least, most in reversed(ranges or EMPLOYEE_RANGES):
        out = F.when((count >= least) & ((count <= most) if most is not None else F.lit(True)), key).otherwise(out)
    return out


def analysis_priority(restricted: Column, has_recruit: Column, recruit_pages: Column, channels: Column, networks: Column, pages: Column) -> Column:
    """0-100, from facts a crawl gives; 0 for companies that refuse contact."""
    points = F.when(has_recruit, 30).otherwise(0) + F.least(F.lit(15), recruit_pages * 5) + F.least(F.lit(25), channels * 10) + F.least(F.lit(15), networks * 5) + F.least(F.lit(15), F.floor(pages / 2) * 3)
    return F.when(restricted, 0).otherwise(clamp(points)).cast("int")


def verification(signals: dict[str, Column]) -> Column:
    """struct(score, status, matched): points of the signals that hold, out of dims.VERIFICATION_POINTS."""
    from firmgraph.functions.dims import REVIEW_FROM, VERIFICATION_POINTS, VERIFIED_FROM

    held = {k: F.coalesce(signals[k], F.lit(False)) for k, _ in VERIFICATION_POINTS}
    score = clamp(sum((F.when(held[k], p).otherwise(0) for k, p in VERIFICATION_POINTS), F.lit(0)))
    return F.struct(
        score.alias("score"),
        F.when(score >= VERIFIED_FROM, "verified").when(score >= REVIEW_FROM, "needs_review").otherwise("rejected").alias("status"),
        F.array_compact(F.array(*[F.when(held[k], F.lit(k)) for k, _ in VERIFICATION_POINTS])).alias("matched"),
    )


def auto_review(reject_reason: Column, website: Column, confidence: Column) -> Column:
    """struct(action, reason): promote companies whose own site is certain."""
    from firmgraph.functions.dims import OFFICIAL_SITE_FROM

    reason = F.when(website.isNull() | (website == ""), "no site").when(reject_reason.isNotNull(), reject_reason).when(F.coalesce(confidence, F.lit(0)) < OFFICIAL_SITE_FROM, "site not certain")
    return F.struct(F.when(reason.isNull(), "promote").otherwise("reject").alias("action"), F.coalesce(reason, F.lit("site confirmed")).alias("reason"))


def recruit_target(has_page: Column, listing: Column, employee: Column, message: Column, text_length: Column, boards: Column, mentioned: Column) -> Column:
    """Four classes of hiring activity; rich pages have two kinds of depth and 1200 letters."""
    depth = listing.cast("int") + employee.cast("int") + message.cast("int")
    return F.when(has_page & (depth >= 2) & (text_length >= 1200), "active_recruit").when(has_page, "weak_recruit_page").when((boards > 0) | mentioned, "no_recruit_page").otherwise("no_signal")


def recruit_reasons(has_page: Column, pages: Column, listing: Column, employee: Column, message: Column, text_length: Column, boards: Column, mentioned: Column, read_enough: Column) -> Column:
    """The facts behind recruit_target, in words that a person can check; boards is an array of names.

    "Not read" and "nothing found" are told apart, though both are no_signal.
    """
    depth = F.array_compact(F.array(F.when(listing, "募集要項"), F.when(employee, "社員紹介"), F.when(message, "代表メッセージ")))
    named = F.array_join(boards, " / ")
    rich = (F.size(depth) >= 2) & (text_length >= 1200)
    with_page = F.array_compact(F.array(
        F.concat(F.lit("採用ページあり（採用関連 "), pages.cast("string"), F.lit("ページ）")),
        F.when(F.size(depth) > 0, F.concat(F.lit("掲載あり: "), F.array_join(depth, " / "))),
        F.when(F.size(boards) > 0, F.concat(F.lit("求人媒体: "), named)),
        F.when(~rich & (F.size(depth) == 0), "募集要項・社員紹介・メッセージのいずれも見つからない"),
        F.when(~rich & (text_length < 1200), F.concat(F.lit("採用ページの情報量が少ない（"), text_length.cast("string"), F.lit("字）"))),
    ))
    without = (
        F.when(F.size(boards) > 0, F.concat(F.lit("公式サイトに採用ページが無い / 求人媒体を利用: "), named))
        .when(mentioned, "公式サイトに採用ページが無いが、本文に採用・求人の記載がある")
        .when(~read_enough, "サイトを十分に読めていないため判断できない")
        .otherwise("採用・求人の記載が見つからない")
    )
    return F.when(has_page, with_page).otherwise(F.array(without))


def token_cost(tokens_in: Column, tokens_out: Column, cache_write: Column, cache_read: Column, rate_in: Column, rate_out: Column) -> Column:
    """US dollars; null where the rate is unknown, which is not the same as free."""
    return ((tokens_in + cache_write * 1.25 + cache_read * 0.1) * rate_in + tokens_out * rate_out) / 1e6


def site_confidence(gate: Column, source: Column, name_in_title: Column, name_in_text: Column, has_page: Column, like_domain: Column, address: Column, phone: Column, number: Column, representative: Column, outline: Column, owned: Column) -> Column:
    """struct(confidence, reasons) of a candidate site; 5 where the gate has a reason."""
    base = F.when(source == "gbiz", 55).when(source == "manual", 50).when(source == "google_places", 35).otherwise(15)
    name = F.when(name_in_title, 20).when(name_in_text, 12).when(has_page, -15).otherwise(0)
    extras = ((like_domain, 12, "domain like name"), (address, 15, "address"), (phone, 15, "phone"), (number, 20, "corporate number"), (representative, 8, "representative"), (outline, 5, "company outline"), (owned, 10, "domain owner"))
    total = clamp(base + name + sum((F.when(c, p).otherwise(0) for c, p, _ in extras), F.lit(0)))
    why = F.array_compact(F.array(F.when(name_in_title, "name in title").when(name_in_text, "name in text").when(has_page, "name missing"), *[F.when(c, F.lit(w)) for c, _, w in extras]))
    return F.when(gate.isNotNull(), F.struct(F.lit(5).alias("confidence"), F.array(gate).alias("reasons"))).otherwise(F.struct(total.alias("confidence"), why.alias("reasons")))
