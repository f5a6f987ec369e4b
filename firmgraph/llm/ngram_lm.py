"""Stupid-backoff scores of documents under the n-gram counts of a corpus, as joins and sums.

For words w[1..n] the score of w[i] is count(w[i-m+1..i]) / count(w[i-m+1..i-1]), m being the order, if that n-gram is in the
corpus, else BACKOFF times the score with one word less of context, down to count(w[i]) / N. The first words of a text have
the context there is. A document's score is the sum of the natural logarithms.

`score_against` scores documents by another corpus: the count tables of all orders are joined to the exploded n-grams of the
documents, the best order is taken at each place, and the logarithms are summed by document.

`score_documents` scores a corpus by itself, all n-grams of all documents, those that occur once too. There every n-gram of a
document is in the tables, so no place backs off, and the logarithms telescope: the first m - 1 words add
log count(w[1..m-1]) - log N, and each later word log count(n-gram) - log count(its context). A row for each context with the
word that follows it (null at the end of a text) has what both counts need. The rows are dealt to the partitions of the count
tables by a hash of their context, where two windows count contexts and n-grams, which is the join of a count table with the
rows it was counted from; then they are summed by document. So a place costs one row of one shuffle, whatever the order.

* Frequent contexts and n-grams do not gather in one task. A sample of the documents proposes those with more than 1 / HEAVY
  of its rows, of which there are HEAVY at most; they are counted exactly beforehand by a map-side sum, their counts reach
  the rows by broadcast, and their rows are dealt by n-gram or by document instead. The sample decides where rows go only.
* The hash space is worked through in SLICES equal parts at every size, so that the disk holds the shuffle of one at a time.
* Contexts and words travel as 64-bit hashes: an n-gram is told apart by 128 bits, a context by 64.

Defined results: words are runs of letters and digits of the lower-cased text; null and empty texts have 0 words, score 0
and a null mean; repeated rows count as often as they occur, and are scored alike; null ids are kept; an empty table gives an
empty result; other columns are not read. A text is one row of an array however long it is, and then a row for each word.
Against another corpus, a word that the corpus lacks at every order counts as if it occurred once; an empty corpus counts as
one word.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmgraph.llm.common import Workspace, word_hashes

ORDER, BACKOFF = 3, 0.4
SLICES, HEAVY, SAMPLE, LEAST = 4, 1 << 16, 64, 32


def told(docs: DataFrame, work: Workspace) -> DataFrame:
    """A row for each row of docs: rid, doc_id, words."""
    return work.save(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", word_hashes(F.col("text")).alias("words")), "words")


def exploded(texts: DataFrame, length: int) -> DataFrame:
    """rid, at, w0 .. w[length - 1]: the words from each place on, null beyond the end."""
    rows = texts.select("rid", "words", F.posexplode("words").alias("at", "w0"))
    return rows.select("rid", "at", "w0", *[F.get("words", F.col("at") + i).alias(f"w{i}") for i in range(1, length)])


def _key(n: int) -> Column:
    return F.xxhash64(*[f"w{i}" for i in range(n)])


def contexts(texts: DataFrame, order: int) -> DataFrame:
    """rid, first, context, next: a row for each place where order - 1 words stand."""
    rows = exploded(texts, order).filter(F.col(f"w{order - 2}").isNotNull())
    return rows.select("rid", (F.col("at") == 0).alias("first"), _key(order - 1).alias("context"), F.col(f"w{order - 1}").alias("next"))


def frequent(texts: DataFrame, order: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Counts of frequent contexts (context, often) and n-grams (context, next, often); at most HEAVY rows each."""
    sample = work.save(contexts(texts.filter(F.pmod(F.xxhash64("rid"), F.lit(SAMPLE)) == 0), order).groupBy("context", "next").count(), "sample")
    n = sample.agg(F.sum("count")).first()[0] or 0
    least = max(LEAST, n / HEAVY)
    # at most n / least rows each
    heavy = work.save(sample.groupBy("context").agg(F.sum("count").alias("count")).filter(F.col("count") >= least).select("context"), "heavy")
    pairs = work.save(sample.filter((F.col("count") >= least) & F.col("next").isNotNull()).select("context", "next", F.lit(True).alias("named")), "heavy-pairs")
    held = contexts(texts, order).join(F.broadcast(heavy), "context").join(F.broadcast(pairs), ["context", "next"], "left")
    counts = work.save(held.groupBy("context", F.when(F.col("named"), F.col("next")).alias("next")).count(), "frequent")
    return counts.groupBy("context").agg(F.sum("count").alias("often_context")), counts.filter("next IS NOT NULL").select("context", "next", F.col("count").alias("often"))


def _slice(rows: DataFrame, i: int, parts: int) -> DataFrame:
    """rid, logs: the sums over the n-grams of one part of the hash space."""
    dealt = rows.filter(F.pmod("deal", F.lit(SLICES)) == i).repartition(parts, "deal")
    gram, context = Window.partitionBy("deal", "context", "next"), Window.partitionBy("deal", "context")
    counted = dealt.withColumn("n", F.count("*").over(gram)).withColumn("m", F.count("*").over(context))
    n, m = (F.log(F.coalesce(a, b).cast("double")) for a, b in (("often", "n"), ("often_context", "m")))
    part = F.when(F.col("next").isNull(), 0.0).otherwise(n - m) + F.when(F.col("first"), m).otherwise(0.0)
    return counted.select("rid", part.alias("part")).groupBy("rid").agg(F.sum("part").alias("logs"))


def _short(texts: DataFrame, order: int) -> list[DataFrame]:
    """rid, logs of the texts with 1 to order - 2 words: the logarithm of the count of all their words."""
    found = []
    for n in range(1, order - 1):
        own = texts.filter(F.size("words") == n).select("rid", *[F.col("words")[i].alias(f"w{i}") for i in range(n)]).select("rid", _key(n).alias("gram"))
        grams = exploded(texts, n).filter(F.col(f"w{n - 1}").isNotNull()).select(_key(n).alias("gram")).groupBy("gram").count()
        found.append(own.join(grams, "gram").select("rid", F.log(F.col("count").cast("double")).alias("logs")))
    return found


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score (natural), mean_log (by word) for each row of docs(doc_id, text), by the counts of docs themselves; order is 2 at least."""
    spark = docs.sparkSession
    work = Workspace(spark, "ngrams")
    texts = told(docs, work)
    often_context, often = frequent(texts, order, work)
    rows = contexts(texts, order).join(F.broadcast(often_context), "context", "left").join(F.broadcast(often), ["context", "next"], "left")
    deal = F.when(F.col("often").isNotNull(), F.xxhash64("rid")).when(F.col("often_context").isNotNull(), F.xxhash64("context", "next")).otherwise(F.col("context"))
    rows = rows.withColumn("deal", deal)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = [work.save(_slice(rows, i, parts), f"sums-{i}") for i in range(SLICES)]
    sums += [work.save(x, f"short-{i}") for i, x in enumerate(_short(texts, order))]
    logs = work.save(reduce(DataFrame.unionAll, sums).groupBy("rid").agg(F.sum("logs").alias("logs")), "logs")
    return _scored(texts.select("rid", "doc_id", F.size("words").cast("long").alias("n_words")), logs, texts)


def _scored(texts: DataFrame, logs: DataFrame, corpus: DataFrame | None) -> DataFrame:
    """The columns of the result; with a corpus, the logarithm of its words is taken off each text that has words."""
    whole = F.coalesce(F.col("logs"), F.lit(0.0))
    if corpus is not None:
        total = corpus.agg(F.sum(F.size("words"))).first()[0] or 1
        whole -= F.when(F.col("n_words") > 0, F.lit(math.log(max(1, total)))).otherwise(0.0)
    joined = texts.join(logs, "rid", "left").withColumn("whole", whole)
    return joined.select("doc_id", "n_words", F.round("whole", 6).alias("log_score"), F.round(F.col("whole") / F.nullif("n_words", F.lit(0)), 6).alias("mean_log"))


def score_against(docs: DataFrame, corpus: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """The columns of score_documents for docs(doc_id, text), by the counts of corpus(text)."""
    work = Workspace(docs.sparkSession, "backoff")
    texts, known = told(docs, work), told(corpus.select(F.lit(None).cast("long").alias("doc_id"), "text"), Workspace(docs.sparkSession, "backoff-corpus"))
    total = known.agg(F.sum(F.size("words"))).first()[0] or 1
    places = []
    for n in range(1, order + 1):
        end = F.col(f"w{n - 1}").isNotNull()
        counts = exploded(known, n).filter(end).select(_key(n).alias("gram")).groupBy("gram").count()
        rows = exploded(texts, n).filter(end).select("rid", (F.col("at") + n - 1).alias("end"), _key(n).alias("gram"))
        places.append(rows.join(counts, "gram").select("rid", "end", F.lit(n).alias("n"), F.col("count").cast("double").alias("count")))
    # at a place: the n-grams that end there, and those that end one word before, which are the contexts
    seen = reduce(DataFrame.unionAll, places)
    both = seen.select("rid", "end", "n", "count", F.lit(0).alias("back")).unionAll(seen.filter(F.col("n") < order).select("rid", F.col("end") + 1, F.col("n") + 1, "count", F.lit(1)))
    every = exploded(texts, 1).select("rid", F.col("at").alias("end"))
    of = lambda n, back: F.max(F.when((F.col("n") == n) & (F.col("back") == back), F.col("count")))
    table = both.groupBy("rid", "end").agg(*[of(n, b).alias(f"c{n}{b}") for n in range(1, order + 1) for b in (0, 1)])
    at = every.join(table, ["rid", "end"], "left")
    score = F.log(F.coalesce(F.col("c10"), F.lit(1.0))) - math.log(max(1, total))
    for n in range(2, order + 1):
        score = F.when(F.col(f"c{n}0").isNotNull(), F.log(f"c{n}0") - F.log(f"c{n}1")).otherwise(score + F.when(F.col("end") >= n - 1, math.log(backoff)).otherwise(0.0))
    logs = work.save(at.select("rid", score.alias("part")).groupBy("rid").agg(F.sum("part").alias("logs")), "logs")
    return _scored(texts.select("rid", "doc_id", F.size("words").cast("long").alias("n_words")), logs, None)
