"""The queries of the operators on the smallest tables: DuckDB's rows where there is SQL."""

import duckdb
import pytest

from firmgraph.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted([[str(r[c]) for c in columns] for r in got.collect()]) == sorted([list(map(str, r)) for r in want.fetchall()])


def test_pipeline_keeps_what_brute_force_keeps(spark):
    """Stages against each other: no rejected, repeated, near-repeated or contaminated document is left, and no other is lost."""
    import corpus_pipeline
    from firmgraph.llm import decontaminate, exact_dedup, near_dedup, toxicity
    from firmgraph.llm.common import table

    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    clean = {r["doc_id"] for r in toxicity.score(docs, model).filter(toxicity.F.col("score") < toxicity.threshold_of(model)).collect()}
    rows = [r for r in docs.collect() if r["doc_id"] in clean]
    last = {}
    for r in rows:
        last[r["text"] or ""] = max(last.get(r["text"] or "", -1), r["doc_id"])
    stage = docs.filter(docs.doc_id.isin(sorted(last.values())))
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(stage).collect()}
    kept = stage.filter(stage.doc_id.isin(sorted(set(classes.values()))))
    bad = {r["doc_id"] for r in decontaminate.contaminated(kept, table(spark, SF, "benchmark")).collect()}
    got = corpus_pipeline.run(spark, SF)
    assert set(docs.columns) <= set(got.columns)
    mixed = {r["doc_id"] for r in got.select("doc_id").collect()}
    assert mixed <= set(classes.values()) - bad
    assert len(mixed) > 0.5 * len(set(classes.values()) - bad)
    assert exact_dedup.exact_dedup(docs.filter(docs.doc_id.isin(sorted(clean)))).count() == len(last)
