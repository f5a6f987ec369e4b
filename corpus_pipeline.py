"""A training corpus from raw documents, in stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the docs of the next. All but the last return the columns of documents.

Defined results: a null text counts as empty throughout. Empty texts have the toxicity score of a text without words, are
copies of each other, of which the largest doc_id stays, hold no benchmark item, and are mixed like others of their source,
with no tokens. Rows without doc_id pass near dedup and decontamination by their text; of equal texts one with a doc_id stays.
Rows that repeat doc_id and text stay or go together until the mix, which uses them together. Of equally good rows the choice
is told by each operator (largest doc_id of equal texts, least doc_id of near-copies). A very long text is read whole by every
stage. Columns that clash with a result of the mix are replaced there, other further columns pass through. Empty tables give
an empty result; without labels nothing is rejected as toxic, without a benchmark nothing as contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmgraph.llm import toxicity as tox
from firmgraph.llm.common import Workspace, table
from firmgraph.llm.decontaminate import decontaminate as without_items
from firmgraph.llm.exact_dedup import exact_dedup as without_copies
from firmgraph.llm.mixing import mix
from firmgraph.llm.near_dedup import near_dedup as without_near_copies


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold of their language."""
    model = tox.fit(docs, table(spark, sf_dir, "labels"))
    scored = tox.score(docs.select(F.struct("*").alias("row"), "text", "lang"), model)
    return scored.filter(F.col("score") < tox.threshold_of(model)).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return without_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's weight has it, with their place in the mix."""
    return mix(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mixing)]

#: A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from documents."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
