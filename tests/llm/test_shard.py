from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import shard

from .helpers import documents, empty, rows_of


def check_places(rows, shards, total):
    counts = Counter(r["shard"] for r in rows)
    assert sum(counts.values()) == total
    sizes = [counts.get(k, 0) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for k in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(counts.get(k, 0)))


def test_exact_sizes_places_and_digest(spark):
    texts = [None, "", "ünï", "same", "same", "x" * 200_000, *[f"text {i}" for i in range(300)]]
    docs = documents(spark, texts)
    docs = docs.union(docs.limit(3))
    rows = shard.shard_documents(docs).collect()
    check_places(rows, 8, 309)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 1
        assert r["text_crc32"] == zlib.crc32(text.encode())
        assert r["law"] == "rows" and r["grown_shard"] is None


def test_many_buckets_rerun_alike_and_keep_columns(spark):
    docs = documents(spark, [f"t{i}" for i in range(500)]).withColumn("shard", F.lit("old")).withColumn("_bucket", F.lit(7))
    placed = shard.shuffle_to_shards(docs, [F.col("doc_id")], shards=3, bucket_rows=20)
    check_places(placed.collect(), 3, 500)
    assert rows_of(placed) == rows_of(shard.shuffle_to_shards(docs.repartition(5), [F.col("doc_id")], shards=3, bucket_rows=20))
    assert {r["_bucket"] for r in placed.collect()} == {7}
    assert placed.columns.count("shard") == 1


def test_null_ids_and_empty_tables(spark):
    docs = documents(spark, ["a", "b", None, "b"]).withColumn("doc_id", F.lit(None).cast("long"))
    check_places(shard.shard_documents(docs).collect(), 8, 4)
    assert shard.shard_documents(empty(spark)).collect() == []


def test_order_is_not_that_of_the_input(spark):
    rows = shard.shard_documents(documents(spark, [f"t{i}" for i in range(4000)])).collect()
    place = np.array([(r["doc_id"], r["shard"], r["slot"]) for r in rows])
    assert abs(np.corrcoef(place[:, 0], place[:, 1])[0, 1]) < 0.06
    assert abs(np.corrcoef(place[:, 0], place[:, 2])[0, 1]) < 0.06


def test_matrix_has_the_given_sums():
    counts, room = np.array([5, 0, 9, 6]), np.array([7, 7, 6])
    drawn = shard.communication_matrix(counts, room, np.random.default_rng(1))
    assert drawn.sum(axis=1).tolist() == counts.tolist() and drawn.sum(axis=0).tolist() == room.tolist()


def test_matrix_follows_the_hypergeometric_law():
    rng = np.random.default_rng(3)
    first = [shard.communication_matrix(np.array([4, 4]), np.array([4, 4]), rng)[0, 0] for _ in range(4000)]
    share = np.bincount(first, minlength=5) / 4000
    assert share == pytest.approx(np.array([1, 16, 36, 16, 1]) / 70, abs=0.03)


def test_draws_beyond_the_generators_range():
    rng = np.random.default_rng(5)
    drawn = [shard.hypergeometric(rng, 3_000_000_000, 1_000_000_000, 10_000) for _ in range(300)]
    assert np.mean(drawn) == pytest.approx(7500, abs=15)
    assert 25 < np.std(drawn) < 65
    assert shard.hypergeometric(rng, 3_000_000_000, 0, 7) == 7
    assert shard.hypergeometric(rng, 0, 3_000_000_000, 7) == 0
