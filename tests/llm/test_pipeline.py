"""The pipeline against a plain version of each stage, on its own input."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import __spark_entry__ as entry
    from foliospark.llm import exact, mixing, quality_rules, simhash

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        seen.append(docs)
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns and docs.join(seen[k], columns, "left_anti").count() == 0
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    out = [*seen[1:], docs]
    assert ids(out[0]) == ids(quality_rules.judged(seen[0]).where("kept"))
    assert ids(out[1]) == ids(exact.exact_duplicates(seen[1]).where("kept"))
    edges = simhash.resembling(seen[2]).unionByName(simhash.near_duplicates(seen[2]).where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    root = {i: i for i in ids(seen[2])}
    for a, b in edges.collect():
        root = {i: min(root[a], root[b]) if r in (root[a], root[b]) else r for i, r in root.items()}
    assert ids(out[2]) == sorted(set(root.values()))
    taken = mixing.mixed(seen[3]).where("copies > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    assert ids(out[3]) == ids(taken)
    assert ids(out[4]) == ids(out[3]) and docs.where("not round_trip").count() == 0
    assert ids(corpus_pipeline.run(spark, DATA)) == ids(docs)
    assert "pipeline" in entry.queries() and [n for n, _ in corpus_pipeline.STAGES] and len([n for n in entry.queries() if n.startswith("op")]) == 10


def test_oracle(spark):
    import duckdb

    from foliospark.llm import queries

    con = duckdb.connect()
    con.sql(f"create view documents as from '{DATA}/documents.parquet'")
    for name, sql in queries.ORACLES.items():
        want = con.sql(sql).df()
        got = queries.QUERIES[name](spark, DATA).toPandas()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns and sorted(map(str, got[columns].itertuples(index=False))) == sorted(map(str, want[columns].itertuples(index=False)))
