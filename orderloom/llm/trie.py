"""Prefix trie of conversations by union-find over the common prefixes of sorted neighbours.

A conversation is a sequence of turns; its key is the turns' digests end to end, so keys sort
with equal beginnings side by side.  Conversations are dealt by range of (key, conv_id) and
sorted.  In each block of a partition the edges between neighbours, as long as their common
prefix, are joined from the deepest up: every merge of components creates a branching node, or
adds a child to the node of that depth, and a component is the run of all that share the
node's prefix.  Nodes between a branching node and the one above it have the same members.

Runs that touch neither end of a block are complete.  The others are prefixes of the block's
first or last conversation: each is contracted to what its complete parts sum up to, and these
spines, one row a block and depth, are merged by the same algorithm over the ends of all
blocks.  A group of copies of any size is many blocks; ids of its members stand in order, so
their hash is streamed over the blocks' pieces.

A null role or text is empty.  Turns are ordered by turn, null first, ties by digest, so
repeated rows are turns of their own.  Rows without conv_id belong to no conversation.  A
conversation's key is one value of 16 bytes a turn, whatever the texts' length.  An empty table
has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, sorted_groups

#: Bytes of a turn's digest in a key.
DIGEST = 16
#: Conversations and bytes of keys of a block; conversations that a partition holds on average.
BLOCK_ROWS = 1 << 17
BLOCK_BYTES = 1 << 25
PART_ROWS = 1 << 14
EMPTY_SHA256 = hashlib.sha256().hexdigest()

NODE, SPINE, ENDS, EDGE = 0, 1, 2, 3
#: Sides of a block: prefixes of all of it, of its first conversations, of its last.
BOTH, LEFT, RIGHT = 0, 1, 2

FIELDS = (
    "kind byte, block long, side byte, depth long, conv_id long, parent_conv_id long, parent_side byte,"
    " n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends string, first binary, last binary"
)
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
TYPES = {"long": pa.int64(), "byte": pa.int8(), "string": pa.string(), "binary": pa.binary()}
SCHEMA = pa.schema([(f.split()[0], TYPES[f.split()[1]]) for f in FIELDS.split(", ")])


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, key (hex digests) and size (bytes of text) of each conversation's turns in order: array<struct>."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.filter("conv_id is not null").select(
        "conv_id", F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("t")
    )
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def with_shared_heads(seqs: DataFrame, group: int = 5, lengths: int = 9) -> DataFrame:
    """Conversation c begins with the first h turns of c - c % group, h = crc32(c) % lengths, and goes on with its own after its first h."""
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(lengths)).cast("int")
    none = F.expr("array()").cast(seqs.schema["turns"].dataType)
    bases = seqs.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, lengths - 1).alias("head"))
    joined = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(bases, "base", "left")
    own = F.when(F.size("turns") > head, F.slice("turns", head + 1, F.greatest(F.size("turns") - head, F.lit(0)))).otherwise(none)
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), 1, head), own).alias("turns"))


def keys(seqs: DataFrame) -> DataFrame:
    """conv_id, key, sizes of conversations (conv_id, turns)."""
    return seqs.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("key"), F.col("turns.size").alias("sizes"))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at their beginnings."""
    n = min(len(a), len(b)) // DIGEST * DIGEST
    if a[:n] == b[:n]:
        return n // DIGEST
    low, high = 0, n // DIGEST - 1
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * DIGEST] == b[: mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


class Forest:
    """Compact trie of elements 0 .. n-1 (``length`` turns each) with ``shared`` turns in common from one to the next.

    Compact nodes are the elements and, from n on, the branching nodes in order of descending
    depth: ``depth``, ``parent`` (-1: none), ``first`` and ``last`` element.
    """

    def __init__(self, length: list[int], shared: list[int]):
        n = len(length)
        self.depth, self.parent = list(length), [-1] * n
        self.first, self.last = list(range(n)), list(range(n))
        root = list(range(n))
        top = list(range(n))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        weight = [1] * n
        for edge in np.argsort(-np.array(shared, dtype=np.int64), kind="stable").tolist():
            depth = shared[edge]
            a, b = find(edge), find(edge + 1)
            left, right = top[a], top[b]
            if left >= n and self.depth[left] == depth:
                node = left
            else:
                node = len(self.depth)
                self.depth.append(depth)
                self.parent.append(-1)
                self.first.append(self.first[left])
                self.last.append(0)
                self.parent[left] = node
            self.parent[right] = node
            self.last[node] = self.last[right]
            if weight[a] < weight[b]:
                a, b = b, a
            root[b] = a
            weight[a] += weight[b]
            top[a] = node
        self.top = top[find(0)] if n else -1

    def above(self, node: int) -> int:
        """Depth of the node above, -1 over the root."""
        return self.depth[self.parent[node]] if self.parent[node] >= 0 else -1


def _row(**values) -> tuple:
    return tuple(values.get(c) for c in NAMES)


def block_rows(block: int, ids: list[int], sequence: list[bytes], sizes: list[list[int]]) -> Iterator[tuple]:
    """The complete nodes of a block of sorted conversations, its spines, their members' ids, and its ends."""
    n = len(ids)
    tree = Forest([len(k) // DIGEST for k in sequence], [common_turns(a, b) for a, b in zip(sequence, sequence[1:])])
    count = len(tree.depth)
    low, kids, leaves, saved = list(ids), [0] * count, [0] * count, [0] * count
    low += [None] * (count - n)
    ends: list[list[int]] = [[] for _ in range(count)]
    pending: list[list[tuple]] = [[] for _ in range(count)]

    def side(node: int) -> int | None:
        a, b = tree.first[node] == 0, tree.last[node] == n - 1
        return BOTH if a and b else LEFT if a else RIGHT if b else None

    # Children come before their parents: elements, then branching nodes by descending depth.
    for node in range(count):
        above, depth, parent = tree.above(node), tree.depth[node], tree.parent[node]
        if depth == above:
            # An element that ends where the node above it branches.
            ends[parent].append(node)
            low[parent] = ids[node] if low[parent] is None else min(low[parent], ids[node])
            continue
        members = [ids[e] for e in sorted(ends[node])] if node >= n else [ids[node]]
        text = ",".join(map(str, members)) if members else None
        copies = tree.last[node] - tree.first[node] + 1
        size = sizes[tree.first[node]]
        where = side(node)
        if parent >= 0:
            low[parent] = low[node] if low[parent] is None else min(low[parent], low[node])
        if where is not None:
            for x in range(above + 1, depth + 1):
                own = x == depth
                yield _row(
                    kind=SPINE, block=block, side=where, depth=x, conv_id=low[node], n_convs=copies, n_children=kids[node] if own else 0,
                    n_leaves=leaves[node] if own else 0, saved_tokens=saved[node] if own else 0, size=size[x - 1] if x else 0,
                )
            if text is not None:
                yield _row(kind=ENDS, block=block, side=where, depth=depth, ends=text)
            for child in pending[node]:
                yield _row(kind=NODE, block=block, side=None, parent_side=where, **dict(child))
            continue
        for child in pending[node]:
            yield _row(kind=NODE, block=block, parent_conv_id=low[node], **dict(child))
        if kids[node] == 0:
            leaves[node] = 1
        total = saved[node]
        for x in range(depth, above, -1):
            total += (copies - 1) * (size[x - 1] if x else 0)
            own = x == depth
            row = {
                "depth": x, "conv_id": low[node], "n_convs": copies, "n_children": kids[node] if own else 1, "n_leaves": leaves[node], "saved_tokens": total,
                "ends": hashlib.sha256(text.encode()).hexdigest() if own and text is not None else EMPTY_SHA256,
            }
            if x > above + 1:
                yield _row(kind=NODE, block=block, parent_conv_id=low[node], **row)
            else:
                pending[parent].append(tuple(row.items()))
        kids[parent] += 1
        leaves[parent] += leaves[node]
        saved[parent] += total
    yield _row(kind=EDGE, block=block, depth=tree.depth[tree.top], first=sequence[0], last=sequence[-1])


def merge_spines(edges: list[tuple[int, int, bytes, bytes]], spines: dict[tuple[int, int], dict[int, tuple]]) -> Iterator[dict]:
    """Nodes of all blocks' spines; ``at`` of a node names the (block, side) pairs it is made of.

    ``edges``: block, turns common to all of it, first and last key, in order.  ``spines``: by block
    and side, depth -> (conv_id, n_convs, n_children, n_leaves, saved_tokens, size).
    """
    length, shared = [], []
    for i, (_, inner, first, last) in enumerate(edges):
        if i:
            shared.append(common_turns(edges[i - 1][3], first))
        shared.append(inner)
        length += [len(first) // DIGEST, len(last) // DIGEST]
    tree = Forest(length, shared)
    # What each compact node is made of: (block, side, lowest depth, deepest).
    parts: list[list[tuple[int, int, int, int]]] = [[] for _ in tree.depth]
    for i, (block, inner, _, _) in enumerate(edges):
        for element, side in ((2 * i, BOTH), (2 * i, LEFT), (2 * i + 1, RIGHT)):
            low, high = (0, inner) if side == BOTH else (inner + 1, length[element])
            node = element
            while node >= 0 and tree.depth[node] >= low:
                a, b = max(low, tree.above(node) + 1), min(high, tree.depth[node])
                if a <= b:
                    parts[node].append((block, side, a, b))
                node = tree.parent[node]
    kids, leaves, saved = [0] * len(tree.depth), [0] * len(tree.depth), [0] * len(tree.depth)
    waiting: list[list[dict]] = [[] for _ in tree.depth]
    for node in range(len(tree.depth)):
        above, depth, parent = tree.above(node), tree.depth[node], tree.parent[node]
        if depth == above:
            continue
        by_depth: dict[int, list[tuple]] = {}
        for block, side, a, b in parts[node]:
            for x in range(a, b + 1):
                by_depth.setdefault(x, []).append((block, side, spines[block, side][x]))
        below, lower_leaves, lower_saved = kids[node], leaves[node], saved[node]
        children = waiting[node]
        for x in range(depth, above, -1):
            rows = [r for _, _, r in by_depth[x]]
            copies, low = sum(r[1] for r in rows), min(r[0] for r in rows)
            n_children = below + sum(r[2] for r in rows)
            n_leaves = (lower_leaves + sum(r[3] for r in rows)) or 1
            total = lower_saved + sum(r[4] for r in rows) + (copies - 1) * rows[0][5]
            for child in children:
                yield child | {"parent_conv_id": low}
            children = [
                {
                    "at": [(b, s) for b, s, _ in by_depth[x]], "depth": x, "conv_id": low, "n_convs": copies,
                    "n_children": n_children, "n_leaves": n_leaves, "saved_tokens": total,
                }
            ]
            below, lower_leaves, lower_saved = 1, n_leaves, total
        if parent < 0:
            yield children[0] | {"parent_conv_id": None}
        else:
            waiting[parent] += children
            kids[parent] += 1
            leaves[parent] += lower_leaves
            saved[parent] += lower_saved


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def forests(placed: DataFrame, block_rows_: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows (FIELDS) of all blocks of ``placed`` (conv_id, key, sizes), which is dealt by range and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def blocks() -> Iterator[tuple[list, list, list]]:
            ids, sequence, sizes, held = [], [], [], 0
            for batch in batches:
                for conv_id, key, size in zip(*(c.to_pylist() for c in batch.columns)):
                    ids.append(conv_id)
                    sequence.append(key)
                    sizes.append(size)
                    held += len(key) + DIGEST
                    if len(ids) == block_rows_ or held >= block_bytes:
                        yield ids, sequence, sizes
                        ids, sequence, sizes, held = [], [], [], 0
            if ids:
                yield ids, sequence, sizes

        for number, block in enumerate(blocks()):
            yield from _batches(block_rows((part << 32) + number, *block), SCHEMA)

    return placed.mapInArrow(run, FIELDS)


MERGED = "block long, side byte, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, is_first boolean"


def merged_spines(rows: DataFrame) -> DataFrame:
    """The node of every block, side and depth of a spine; ``is_first`` marks each node once.

    One task reads one row a block and depth: blocks hold BLOCK_ROWS conversations, so it is a
    small share of the table at any size, and no texts, members or complete nodes are among it.
    """
    schema = pa.schema([(f.split()[0], {"boolean": pa.bool_()}.get(f.split()[1]) or TYPES[f.split()[1]]) for f in MERGED.split(", ")])
    columns = ["kind", "block", "side", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, spines = [], {}
        for batch in batches:
            for kind, block, side, depth, *figures, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == EDGE:
                    edges.append((block, depth, first, last))
                else:
                    spines.setdefault((block, side), {})[depth] = tuple(figures)
        if not edges:
            return
        edges.sort(key=lambda e: e[0])

        def out() -> Iterator[tuple]:
            for node in merge_spines(edges, spines):
                figures = [node[c] for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
                for i, (block, side) in enumerate(node["at"]):
                    yield (block, side, *figures, i == 0)

        yield from _batches(out(), schema)

    small = rows.filter(F.col("kind").isin(SPINE, EDGE)).select(*columns)
    return small.repartition(1).mapInArrow(run, MERGED)


def streamed_hashes(pieces: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of pieces of ids (conv_id, depth, block, ends) taken in order of block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

        def out() -> Iterator[tuple]:
            nonlocal node, digest
            for batch in batches:
                for conv_id, depth, _, ends in zip(*(c.to_pylist() for c in batch.columns)):
                    if (conv_id, depth) != node:
                        if node:
                            yield (*node, digest.hexdigest())
                        node, digest = (conv_id, depth), hashlib.sha256(ends.encode())
                    else:
                        digest.update(b"," + ends.encode())
            if node:
                yield (*node, digest.hexdigest())

        yield from _batches(out(), schema)

    dealt = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block")
    return dealt.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(seqs: DataFrame, *, part_rows: int = PART_ROWS, block_rows_: int = BLOCK_ROWS) -> DataFrame:
    """One row per node of the trie of conversations (conv_id: long, distinct; turns: array<struct<digest, size>>).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rows = settle(keys(seqs))
    parts = max(1, -(-rows.count() // part_rows))
    placed = settle(rows.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id"))
    found = settle(forests(placed, block_rows_))
    spine = settle(merged_spines(found))
    place = ["block", "side", "depth"]
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]

    complete = found.filter(F.col("kind") == NODE).withColumnRenamed("ends", "ends_sha256")
    inner = complete.filter("parent_side is null").select(*columns)
    above = spine.select("block", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    under = complete.filter("parent_side is not null").join(above, ["block", "parent_side", "depth"]).withColumn("parent_conv_id", F.col("above")).select(*columns)

    names = spine.select(*place, "conv_id")
    pieces = found.filter(F.col("kind") == ENDS).select(*place, "ends").join(names, place).select("conv_id", "depth", "block", "ends")
    nodes = spine.filter("is_first").join(streamed_hashes(pieces), ["conv_id", "depth"], "left")
    nodes = nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256))).select(*columns)
    return inner.unionByName(under).unionByName(nodes)


def rebuilt_trie(turns: DataFrame, **options) -> DataFrame:
    """The trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text and any more)."""
    return prefix_trie(with_shared_heads(sequences(turns.select("conv_id", "turn", "role", "text"))), **options)


def rebuilt_trie_sql() -> str:
    """The same rows in DuckDB: prefixes spelt out, each node's figures added to all nodes above it."""
    return r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS size,
         md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT conv_id, digest, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i FROM turns),
convs AS (
  SELECT conv_id,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
             lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM placed)),
rebuilt AS (
  SELECT c.conv_id, i, digest, size FROM convs c JOIN placed p ON p.conv_id = c.conv_id - c.conv_id % 5 AND i <= h
  UNION ALL SELECT c.conv_id, i, digest, size FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND i > h),
paths AS (
  SELECT conv_id, size, row_number() OVER w AS depth, string_agg(digest, '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY i)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length) AS ends
  FROM paths JOIN lengths USING (conv_id) GROUP BY prefix, depth),
links AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = left(n.prefix, 32 * (n.depth - 1)::INTEGER)),
kids AS (SELECT parent_conv_id, depth - 1 AS depth, count(*) AS n_children FROM links WHERE depth > 0 GROUP BY ALL),
own AS (SELECT links.*, coalesce(n_children, 0) AS n_children FROM links LEFT JOIN kids ON kids.parent_conv_id = links.conv_id AND kids.depth = links.depth),
upward AS (
  SELECT a.prefix, a.depth, sum((o.n_convs - 1) * o.size) AS saved, count(*) FILTER (o.n_children = 0) AS n_leaves
  FROM own o JOIN paths a ON a.conv_id = o.conv_id AND a.depth <= o.depth GROUP BY a.prefix, a.depth)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM own JOIN upward USING (prefix, depth)
"""
