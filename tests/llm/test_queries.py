"""Every registered query of the subpackage on the smallest test tables; the pipeline's stages."""

from __future__ import annotations

import pytest

import corpus_pipeline
from orderloom.llm import queries
from tests.compare import duck, oracle_rows, spark_rows

from .helpers import documents, empty, words

TABLES = {"op1": "pages", "op3": None, "op8": None, "op12": None}


@pytest.mark.parametrize("key", sorted(queries.registered()))
def test_query(spark, sf_dir, key):
    found = queries.registered()[key](spark, sf_dir)
    table = TABLES.get(key.split("_")[0], "documents")
    columns, rows = spark_rows(found)
    if table:
        assert len(rows) == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    if key in queries.statements():
        assert (columns, rows) == oracle_rows(duck(sf_dir), queries.statements()[key])


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = out.collect()
        assert rows and {r["doc_id"] for r in rows} <= set(kept)
        assert all(r["text"] == kept[r["doc_id"]]["text"] for r in rows)
        if name != "sharding":
            assert out.columns == docs.columns
        kept = {r["doc_id"]: r for r in rows}
        docs = out
    assert sorted((r["shard"], r["slot"]) for r in rows) == sorted(
        (s, k) for s in range(8) for k in range(sum(r["shard"] == s for r in rows))
    )


def test_decisions_take_effect(spark, sf_dir):
    import numpy as np

    rng = np.random.default_rng(0)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("text is not null").first()["text"]
    clean = [words(rng, 80, 90_000) for _ in range(6)]
    texts = [*clean, clean[0], clean[1] + " more", f"{clean[2][:200]} {item} {clean[3][:200]}", None, ""]
    docs = documents(spark, texts)
    left = corpus_pipeline.without_near_duplicates(spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 1, 2, 3, 4, 5, 8, 9]
    left = corpus_pipeline.without_benchmark(spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 9, 10]
    mixed = corpus_pipeline.mixed(spark, docs, sf_dir).collect()
    assert {r["text"] for r in mixed} <= set(texts) and len(mixed) > 9
    assert len(corpus_pipeline.sharded(spark, docs, sf_dir).collect()) == len(texts)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, sf_dir, stage):
    assert stage(spark, empty(spark), sf_dir).collect() == []
