"""Nearest neighbours by multi-index hashing.

Vectors get binary codes: signs after learned rotations.  A code is split into substrings
and each substring has its table of the codes by value.  A code within Hamming radius r of
a query's agrees with it in one of m substrings up to floor(r / m) bits (pigeonhole), so
probing every table that far finds every code within the radius; those are ranked by the
true measure on the original vectors.

For inner products each vector gets one more component that brings all to the largest
norm; then the angle to a query orders them as the inner product does.  Rotations and radius
are fitted on a bounded sample; every vector is indexed.  The table is cut into blocks, the
queries into blocks, and each pair of blocks is one task's work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, settle, sorted_groups

#: Vectors the fit reads at most, and queries among them that set the radius.
SAMPLE = 4_096
SAMPLE_QUERIES = 256
#: Share of the sample's true neighbours that the radius covers.
COVER = 0.97
BITS = 128
SUBSTRING = 16
INDEX_ROWS = (4_096, 65_536)
QUERY_ROWS = 16_384


@dataclass
class Hasher:
    """Codes of BITS bits: ``basis`` holds the rotations side by side; ``norm`` is the largest norm; ``radius`` the search radius."""

    basis: np.ndarray
    norm: float
    radius: int = 0

    def extended(self, x: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, more])

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(vector, substring) values of 16 bits."""
        bits = self.extended(x, query) @ self.basis > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint16)


def rotations(x: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Columns of iterative quantization: rotations of the principal directions that bring the rows of ``x`` near to signs."""
    _, _, directions = np.linalg.svd(x, full_matrices=True)
    rng = np.random.default_rng(seed)
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        width = min(x.shape[1], bits - sum(p.shape[1] for p in parts))
        axes = directions[:width].T
        turn, _ = np.linalg.qr(rng.normal(size=(width, width)))
        for _ in range(20):
            low = x @ axes
            u, _, vt = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (u @ vt).T
        parts.append(axes @ turn)
    return np.concatenate(parts, axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances between all codes of ``a`` and ``b``."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    out = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint8)
    for k in range(1, a.shape[1]):
        out += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return out


def train(sample: np.ndarray, norm: float, neighbours: int, seed: int = 0) -> Hasher:
    hasher = Hasher(np.empty(0), norm)
    hasher.basis = rotations(hasher.extended(sample, False), BITS, seed)
    queries = sample[:SAMPLE_QUERIES]
    near = queries @ sample.T
    near[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    k = min(neighbours, len(sample) - 1)
    if k < 1:
        hasher.radius = BITS
        return hasher
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    apart = distances(hasher.codes(queries, True), hasher.codes(sample, False))
    hasher.radius = int(np.quantile(np.take_along_axis(apart, top, axis=1), COVER, method="higher"))
    return hasher


class Index:
    """Tables of a block of codes: for each substring its distinct values and the codes that have them."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = [np.unique(codes[:, s], return_inverse=True) for s in range(codes.shape[1])]

    def probe(self, codes: np.ndarray, radius: int) -> np.ndarray:
        """(query, code): which codes agree with a query in some substring up to the pigeonhole's bits."""
        bits = radius // codes.shape[1]
        found = np.zeros((len(codes), len(self.codes)), dtype=bool)
        for s, (values, member) in enumerate(self.tables):
            close = np.bitwise_count(codes[:, None, s] ^ values[None, :]) <= bits
            found |= close[:, member]
            if found.all():
                break
        return found


def search(queries: np.ndarray, own: np.ndarray, base: np.ndarray, ids: np.ndarray, keys: np.ndarray, hasher: Hasher, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of ``base``, score): each query's ``k`` best in a block by inner product, ties to smaller ids.

    Rows whose key is the query's ``own`` are not candidates.  Where fewer than ``k`` codes lie
    within the radius, it is widened to the k-th nearest code.
    """
    index, q_codes = Index(hasher.codes(base, False)), hasher.codes(queries, True)
    out_q, out_b, out_s = [], [], []
    for at in range(0, len(queries), 128):
        part, codes = queries[at : at + 128], q_codes[at : at + 128]
        apart = distances(codes, index.codes).astype(np.int16)
        found = index.probe(codes, hasher.radius) & (apart <= hasher.radius)
        other = keys[None, :] != own[at : at + 128, None]
        found &= other
        few = np.flatnonzero(found.sum(axis=1) < k)
        if len(few):
            reach = np.where(other[few], apart[few], np.int16(BITS + 1))
            kth = np.partition(reach, min(k, reach.shape[1]) - 1, axis=1)[:, min(k, reach.shape[1]) - 1]
            found[few] |= (reach <= kth[:, None]) & other[few]
        score = np.where(found, part @ base.T, -np.inf)
        n = min(k, score.shape[1])
        last = -np.partition(-score, n - 1, axis=1)[:, n - 1]
        for i in range(len(part)):
            rows = np.flatnonzero((score[i] >= last[i] - 1e-9 * max(1.0, abs(last[i]))) & found[i]) if np.isfinite(last[i]) else np.flatnonzero(found[i])
            exact = (base[rows] * part[i]).sum(axis=1)
            best = np.lexsort((ids[rows], -exact))[:k]
            out_q.append(np.full(len(best), at + i))
            out_b.append(rows[best])
            out_s.append(exact[best])
    return np.concatenate(out_q), np.concatenate(out_b), np.concatenate(out_s)


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _cells(batches: Iterator[pa.RecordBatch], hasher: Hasher, k: int) -> Iterator[pa.RecordBatch]:
    names = ["query", "query_id", "vec_id", "score"]
    for group in sorted_groups(batches, "cell"):
        asks = group.column("asks").to_numpy()
        base, queries = group.filter(pa.array(~asks)), group.filter(pa.array(asks))
        if not len(base) or not len(queries):
            continue
        ids, own, key = (t.column(c).to_numpy() for t, c in ((base, "vec_id"), (queries, "key"), (base, "key")))
        q, b, s = search(_matrix(queries.column("vector")), own, _matrix(base.column("vector")), ids, key, hasher, k)
        yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(queries.column("vec_id").to_numpy()[q]), pa.array(ids[b]), pa.array(s)], names)


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best found for each row that ``is_query``, of all rows but itself.

    ``vectors``: vec_id, embedding.  Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without id, take no part; nor do lengths other than the most
    frequent one (of ties, the longest).  Rows equal in id and vector are one row.  Equal
    vectors score the same and go by id, so of each vector only the ``k + 1`` smallest ids
    are indexed; none of the others can be among the best.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = lengths["n"] if lengths else 0
    # Minus zero and zero are one value.
    rows = rows.filter(F.size("vector") == length).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).distinct()
    rows = settle(rows.withColumn("key", F.xxhash64("vec_id", "vector")))
    by_id = Window.partitionBy("vector").orderBy("vec_id")
    base = rows.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1).drop("n")
    queries = rows.filter(is_query)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    total, asked, longest = rows.agg(F.count("*"), F.count_if(is_query), F.max(norm)).first()
    index_rows = min(INDEX_ROWS[1], max(INDEX_ROWS[0], total // 16))
    blocks, query_blocks = max(1, math.ceil(total / index_rows)), max(1, math.ceil(asked / QUERY_ROWS))
    sample = [r["vector"] for r in hash_sample(rows.select("vec_id", "key", "vector"), SAMPLE, "vec_id", "key", seed=seed).collect()]
    hasher = train(np.array(sample, dtype=np.float64), longest, k, seed) if sample else Hasher(np.empty(0), 0.0)

    def spread(frame: DataFrame, asks: bool) -> DataFrame:
        own = F.pmod(F.xxhash64(F.lit(seed + 1), "vec_id"), F.lit(query_blocks if asks else blocks))
        others = F.explode(F.sequence(F.lit(0), F.lit((blocks if asks else query_blocks) - 1)))
        cell = F.col("other") * query_blocks + F.col("own") if asks else F.col("own") * query_blocks + F.col("other")
        return frame.select("vec_id", "vector", "key", own.alias("own"), others.alias("other")).select(
            cell.cast("long").alias("cell"), F.lit(asks).alias("asks"), "vec_id", "key", "vector"
        )

    cells = spread(base, False).union(spread(queries, True))
    # One partition per cell, so that blocks do not meet in one task.
    found = (
        cells.repartition(blocks * query_blocks, "cell").sortWithinPartitions("cell")
        .mapInArrow(lambda batches: _cells(batches, hasher, k), "query long, query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
