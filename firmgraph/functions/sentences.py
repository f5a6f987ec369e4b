"""Texts cut into sentences once, which the detectors of wordings share.

A sentence ends behind a Japanese full stop or a line end, which belong to it; all of a text's letters are in one sentence each.
Detectors look at one sentence at a time, behind a cheap test for words that each wording has, so that their time grows with the text and
not with the square of a line. A wording does not reach over a sentence's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmgraph.functions import dims
from firmgraph.functions.text import half_width, let

CUT = r"[^。\n]++[。\n]?|[。\n]"
#: Every wording of refusal has one of these words.
REFUSING = r"お断り|ご遠慮|禁止|お受け|受け付けて|お控え|できません|(?i:not accepted|prohibited|declined|refuse)"
MOST, SHOWN, SAME, BEYOND = 5, 300, 60, 60


def sentences(text: Column) -> Column:
    """array<string> of a text's sentences, one after the other; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CUT), F.lit(0))


def sentence_table(rows: DataFrame, id: str, text: str) -> DataFrame:
    """id, at, start, sentence: a row for each sentence of rows with one text for each id, with its number and the letters before it."""
    each = rows.select(id, F.posexplode(sentences(F.col(text))).alias("at", "sentence"))
    before = F.sum(F.length("sentence")).over(Window.partitionBy(id).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return each.select(id, "at", F.coalesce(before, F.lit(0)).cast("long").alias("start"), "sentence")


def refusal_rule(sentence: Column) -> Column:
    """The first rule by which a sentence refuses sales contact, by its place in the list; null if none does."""
    rules = F.coalesce(*[F.when(sentence.rlike(p), F.lit(i)) for i, (p, _, _) in enumerate(dims.REFUSALS)])
    return F.when(sentence.rlike(REFUSING), rules)


def _shown(sentence: Column, rule: Column) -> Column:
    """A sentence as evidence: trimmed, at most SHOWN letters; without an end of its own, up to BEYOND letters behind the wording."""
    def upto(p: str) -> Column:
        return F.substring(sentence, F.lit(1), F.regexp_instr(sentence, F.lit(p)) - 1 + F.length(F.regexp_extract(sentence, p, 0)) + BEYOND)

    open_ = F.coalesce(*[F.when(rule == i, upto(p)) for i, (p, _, _) in enumerate(dims.REFUSALS)])
    cut = F.when(sentence.rlike("[。\n]$"), sentence).otherwise(open_)
    return F.substring(F.regexp_replace(cut, "^\\s+|\\s+$", ""), 1, SHOWN)


def refusals_in(parts: Column) -> Column:
    """array of struct(text, pattern, confidence) of the sentences that refuse sales contact, each once by its first SAME letters.

    They come in the order of the rules, then of the text. The first MOST are given in this order; of fewer, the most certain is first.
    """
    pick = lambda rule, k: F.element_at(F.array(*[F.lit(x[k]) for x in dims.REFUSALS]), rule + 1)
    ruled = F.filter(F.transform(parts, lambda s, i: F.struct(refusal_rule(s).alias("rule"), i.alias("at"), s.alias("s"))), lambda x: x["rule"].isNotNull())
    hit = lambda x: F.struct(x["rule"].alias("rule"), x["at"].alias("at"), _shown(x["s"], x["rule"]).alias("text"))
    hits = F.transform(F.array_sort(ruled), hit)
    none = F.array().cast("array<struct<rule: int, at: int, text: string>>")
    head = lambda x: F.substring(x["text"], 1, SAME)
    first = F.aggregate(hits, none, lambda held, x: F.when((F.size(held) >= MOST) | F.exists(held, lambda y: head(y) == head(x)), held).otherwise(F.concat(held, F.array(x))))

    def told(found: Column) -> Column:
        surest = F.transform(found, lambda x, i: F.struct((-pick(x["rule"], 2)).alias("less"), i.alias("i"), x.alias("x")))
        ordered = F.when(F.size(found) >= MOST, found).otherwise(F.transform(F.array_sort(surest), lambda y: y["x"]))
        return F.transform(ordered, lambda x: F.struct(x["text"].alias("text"), pick(x["rule"], 1).alias("pattern"), pick(x["rule"], 2).alias("confidence")))

    return let(first, told)


def refusals(text: Column) -> Column:
    """The refusals of a text, whose full-width letters count as ASCII."""
    return refusals_in(sentences(half_width(text)))


def surest(found: Column) -> Column:
    """The most certain of refusals, the first of equal ones; null if there is none."""
    top = lambda xs: F.array_max(F.transform(xs, lambda x: x["confidence"]))
    return let(found, lambda xs: F.get(F.filter(xs, lambda x: x["confidence"] == top(xs)), F.lit(0)))


def mentions(parts: Column, wording: str, most: int | None = None) -> Column:
    """The sentences that have a wording, trimmed; the first `most`, or all."""
    found = F.transform(F.filter(parts, lambda s: s.rlike(wording)), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", ""))
    return F.slice(found, 1, most) if most else found
