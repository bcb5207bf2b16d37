"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in buckets by a hash of their identity.  The numbers of rows that each
bucket sends to each shard are drawn exactly as a uniform permutation would have
them: one multivariate hypergeometric draw per bucket from what is left of the
shards.  Each bucket permutes its rows and deals them out by its drawn counts, the
rows are exchanged, and each shard permutes what it received.

Draws are seeded and rows are ordered by seeded hashes of their own content, so a
re-run task deals the same rows to the same places.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name

#: Rows a bucket holds on average, and buckets a matrix block holds.
BUCKET_ROWS = 20_000
BLOCK_BUCKETS = 512


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` drawn without replacement, for counts of any size.

    Beyond the generator's own limit of a billion: inversion from the mode outwards,
    with ratios of neighbouring probabilities.
    """
    if good + bad < 1_000_000_000 or not (good and bad and draws):
        return int(rng.hypergeometric(good, bad, draws)) if good + bad < 1_000_000_000 else (draws if not bad else 0)
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - at_mode
    up, down, p_up, p_down = mode, mode, at_mode, at_mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(counts: np.ndarray, room: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows that each sender gives each receiver; rows sum to ``counts`` and columns to ``room``."""
    room = [int(x) for x in room]
    out = np.zeros((len(counts), len(room)), dtype=np.int64)
    for i, n in enumerate(counts):
        n, rest = int(n), sum(room)
        for j, have in enumerate(room):
            if not n:
                break
            take = hypergeometric(rng, have, rest - have, n)
            rest -= have
            room[j] -= take
            n -= take
            out[i, j] = take
    return out


def _matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """bucket -> ends: running totals of the rows it sends to shards 0, 1, ..."""

    def blocks(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        total = int(rows["n"].sum())
        room = np.array([total // shards + (k < total % shards) for k in range(shards)])
        drawn = communication_matrix(rows["n"].to_numpy(), room, np.random.default_rng([seed, 1]))
        return pd.DataFrame({"block": rows["block"], "room": list(drawn)})

    def buckets(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        rng = np.random.default_rng([seed, 2, int(rows["block"].iloc[0])])
        drawn = communication_matrix(rows["n"].to_numpy(), np.array(rows["room"].iloc[0]), rng)
        return pd.DataFrame({"bucket": rows["bucket"], "ends": list(np.cumsum(drawn, axis=1))})

    counts = counts.withColumn("block", F.expr(f"bucket div {BLOCK_BUCKETS}"))
    # One row per block of buckets: the counts of ten million rows.
    room = (
        counts.groupBy("block").agg(F.sum("n").alias("n"))
        .groupBy().applyInPandas(blocks, "block long, room array<long>")
    )
    return counts.join(room, "block").groupBy("block").applyInPandas(buckets, "bucket long, ends array<long>")


def shuffle_to_shards(
    docs: DataFrame, identity: list[Column], *, shards: int = 8, seed: int = 0, bucket_rows: int = BUCKET_ROWS,
    shard_name: str = "shard", slot_name: str = "slot",
) -> DataFrame:
    """All rows and columns of ``docs`` with a shard and a place in it, uniform over all arrangements.

    ``identity``: expressions that tell rows apart; rows equal in all of them may trade
    places.  Shard sizes differ by one at most, places count from 0 without gaps.  Nulls
    are values like others.  An empty table gives no rows.  ``shard_name`` and
    ``slot_name`` replace input columns of the same name.
    """
    docs = docs.drop(shard_name, slot_name)
    kept = docs.columns
    bucket, here, there, rank, ends, sub, base = (
        free_name(docs, x) for x in ("_bucket", "_here", "_there", "_rank", "_ends", "_sub", "_base")
    )
    parts = max(1, math.ceil(docs.count() / bucket_rows))

    def random(n: int) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(n), *identity)

    rows = docs.select(
        "*",
        F.pmod(random(0), F.lit(parts)).alias(bucket),
        random(1).alias(here),
        random(2).alias(there),
        F.pmod(random(3), F.lit(parts)).alias(sub),
    )
    counts = rows.groupBy(F.col(bucket).alias("bucket")).agg(F.count("*").alias("n"))
    matrix = _matrix(counts, shards, seed).withColumnsRenamed({"bucket": bucket, "ends": ends})
    dealt = (
        rows.withColumn(rank, F.row_number().over(Window.partitionBy(bucket).orderBy(here, there)))
        .join(matrix, bucket)
        .withColumn(shard_name, F.size(F.filter(ends, lambda end: end < F.col(rank))).cast("int"))
        .drop(bucket, here, rank, ends)
    )
    # Places before a sub-bucket of a shard; sub-buckets are in random order already.
    before = (
        dealt.groupBy(shard_name, sub).agg(F.count("*").alias(base))
        .withColumn(base, F.coalesce(F.sum(base).over(Window.partitionBy(shard_name).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    return (
        dealt.withColumn(rank, F.row_number().over(Window.partitionBy(shard_name, sub).orderBy(there)))
        .join(before, [shard_name, sub])
        .select(*kept, shard_name, (F.col(base) + F.col(rank) - 1).alias(slot_name))
    )


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def shard_documents(docs: DataFrame, *, shards: int = 8, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, under the law of equal counts.

    A null text has size 1 and the checksum of an empty one.
    """
    rows = docs.select("doc_id", text_size(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"))
    placed = shuffle_to_shards(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards=shards, seed=seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
