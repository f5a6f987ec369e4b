"""Sentences and what detectors find in them."""

import re
import time

import pytest
from pyspark.sql import functions as F

from firmgraph.functions import dims
from firmgraph.functions.sentences import refusals, sentence_table, surest


def brute(text):
    """The rules over a whole text, match by match."""
    hits, seen = [], set()
    for pattern, label, sure in dims.REFUSALS:
        for m in re.finditer(pattern.replace("(?i)", ""), text, re.I if "(?i)" in pattern else 0):
            start = max(text.rfind("\n", 0, m.start()), text.rfind("。", 0, m.start())) + 1
            ends = [i for i in (text.find("。", m.end()), text.find("\n", m.end())) if i >= 0]
            said = text[start : min(ends) + 1 if ends else min(len(text), m.end() + 60)].strip()[:300]
            if said[:60] not in seen:
                seen.add(said[:60])
                hits.append((said, label, sure))
                if len(hits) == 5:
                    return hits
    return sorted(hits, key=lambda h: -h[2])


TEXTS = [
    "会社概要\n営業メールはお断りしております。\n以上", "売り込みは受け付けておりません。業者の皆様からのご提案はお断りします。営業・勧誘は禁止", "営業時間は9:00〜18:00です。", "Unsolicited offers are declined\n営業はご遠慮ください" + "長い文" * 60,
    "".join(f"第{i}に、営業の電話はお断りします。" for i in range(9)) + "セールスの電話は禁止。", "前置き" * 120 + "営業メールはお断り" + "後書き" * 90, "営業はご遠慮ください\n人材紹介のご案内はご遠慮ください。\n営業メール禁止\n本フォームの営業での利用はできません。\n取引先からの営業はお断り。\n売り込み禁止", "",
]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_refusals_are_those_of_whole_texts(spark, i):
    got = spark.createDataFrame([(TEXTS[i],)], "t string").select(refusals(F.col("t"))).first()[0]
    assert [tuple(r) for r in got] == brute(TEXTS[i])


def test_surest_and_null(spark):
    rows = [(TEXTS[4],), (TEXTS[6],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(surest(refusals(F.col("t")))).collect()]
    assert got[0]["confidence"] == 95 and got[1]["confidence"] == max(h[2] for h in brute(TEXTS[6])) and got[2] is None


def test_one_long_line_takes_linear_time(spark):
    line = spark.createDataFrame([("営業時間のご案内と製品" * 100_000,)], "t string")
    line.limit(0).select(refusals(F.col("t"))).collect()
    began = time.time()
    assert line.select(F.size(refusals(F.col("t")))).first()[0] == 0
    assert time.time() - began < 20


def test_offsets_put_the_text_together(spark):
    texts = [(1, "一。二\n\n三"), (2, None), (3, ""), (4, "x")]
    got = {}
    for r in sentence_table(spark.createDataFrame(texts, "id long, t string"), "id", "t").orderBy("id", "at").collect():
        assert r["start"] == len(got.get(r["id"], ""))
        got[r["id"]] = got.get(r["id"], "") + r["sentence"]
    assert got == {1: texts[0][1], 4: "x"}
