"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint is the bitwise majority of the hashes of its word shingles.
Anchors are the code words of a covering code: the fingerprint's leading bits are cut
into blocks of odd length (3 at least) and each block is covered by the repetition code, so the
nearest anchor is one majority bit per block.  A fingerprint's home is its nearest
anchor.  A partner within the threshold has a home that can be reached by flipping that
many bits; so each fingerprint is replicated to those anchors, all of them within covering
radius plus threshold, and pairs are compared where one is at home.  No pair is lost.

Equal fingerprints are compared once.  A task that compares an anchor's rows links them to
their smallest linked member, so groups give one link a member, not all their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, narrow, settle, sorted_groups
from .components import components

SEED = 42
#: Rows of one side that a cell of an anchor compares.
CELL_ROWS = 8_192
#: Home rows that are compared with a cell's other rows at a time.
STRIP_ROWS = 128
#: Rows of a table from which on its fingerprints meet at finer anchors.
LARGE_ROWS = 1 << 25
#: Words of a shingle and similarity of near duplicates; bits by which one of two word fingerprints of such differs at most.
#: Pairs up to 7 bits apart surely meet, of those 8 to 12 apart nineteen in twenty to two in three, in each of the two.
SHINGLE = 5
SIMILARITY = 0.8
WORD_BITS = 12
SKETCH_BITS = 128
#: Deviations of a sketch's estimate below the similarity at which a pair is still compared exactly.
SKETCH_MARGIN = 3.0
#: Rounds in which each member is compared with its closest candidate in another component, after the first two comparisons.
ROUNDS = 1
#: Rows of one side that a cell compares with their shingle sets.
SET_ROWS = 512


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by blanks; fewer words: of all of them; none: empty."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], dtype=np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit value whose bit is set where over half the hashes have it, as a signed long."""
    if not len(hashes):
        return 0
    counts = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """64-bit fingerprint; bytes A-Z are lowered, words are split at ASCII white space, null is empty."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([majority_bits(shingle_hashes(t or b"", shingle)) for t in texts], dtype="int64")

    return prints.asNondeterministic()(text.cast("binary"))


def _margins(prints: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Homes, and for each block the bits to flip before its majority does."""
    blocks = 64 // block
    home, cost = np.zeros(len(prints), dtype=np.int64), np.empty((len(prints), blocks), dtype=np.int8)
    for b in range(blocks):
        ones = np.bitwise_count((prints >> np.uint64(b * block)) & np.uint64((1 << block) - 1)).astype(np.int8)
        major = ones > block // 2
        home |= major.astype(np.int64) << b
        cost[:, b] = np.where(major, ones - block // 2, block // 2 + 1 - ones)
    return home, cost


def reachable_anchors(prints: np.ndarray, block: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, bits flipped) for every anchor that is home to something within ``threshold``."""
    home, cost = _margins(prints, block)
    row, anchor, spent = np.arange(len(prints)), home, np.zeros(len(prints), dtype=np.int8)
    for b in range(cost.shape[1]):
        then = spent + cost[row, b]
        ok = then <= threshold
        row = np.concatenate([row, row[ok]])
        anchor = np.concatenate([anchor, anchor[ok] ^ (1 << b)])
        spent = np.concatenate([spent, then[ok]])
    return row, anchor, spent


def _local_roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index linked to each of ``size`` members by the links (a, b)."""
    root = np.arange(size)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            break
    return root


class Bits:
    """Alike: fingerprints that differ in at most ``threshold`` bits.  A pair meets at the home of one of them."""

    columns = ()

    def __init__(self, threshold: int, block: int):
        self.threshold, self.block = threshold, block

    def replicas(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, at home) of every row at every anchor it is compared at."""
        row, anchor, spent = reachable_anchors(prints, self.block, self.threshold)
        return row, anchor, spent == 0

    def alike(self, a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
        return np.bitwise_count(a["print"][:, None] ^ b["print"][None, :]) <= self.threshold


class PartBits(Bits):
    """Candidates: one of two word fingerprints within ``threshold`` bits, and sketches that agree to ``agree`` of their bits.

    Where 7 bits differ, one of four quarters differs in a bit at most; where more do, it mostly does.  Every 16-bit word is an anchor, of
    covering radius 0, for each quarter.  Of two that differ in one bit, the one that has the
    bit goes to the other's home.  The second fingerprint mixes the words' hashes anew, so
    pairs that chance puts far apart in one are met in the other.
    """

    columns = ("print_b", "sketch_0", "sketch_1")

    def __init__(self, threshold: int, agree: float, tested: tuple[str, ...] = ()):
        self.threshold, self.most_apart, self.tested = threshold, (1 - agree) * SKETCH_BITS, tested
        if tested:
            self.columns = (*self.columns, "root", *tested)

    def replicas(self, prints: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, anchors, homes = [], [], []
        everyone = np.arange(len(prints))
        for part in range(4 if second is None else 8):
            held = prints if part < 4 else second
            word = ((held >> np.uint64(16 * (part % 4))) & np.uint64(0xFFFF)).astype(np.int64)
            rows.append(everyone)
            anchors.append(word | part << 16)
            homes.append(np.ones(len(prints), dtype=bool))
            for bit in range(16):
                some = np.flatnonzero(word >> bit & 1)
                rows.append(some)
                anchors.append(word[some] ^ (1 << bit) | part << 16)
                homes.append(np.zeros(len(some), dtype=bool))
        return np.concatenate(rows), np.concatenate(anchors), np.concatenate(homes)

    def candidates(self, a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of a, row of b, bits in which their sketches differ) of the pairs that may be alike."""
        near = np.bitwise_count(a["print"][:, None] ^ b["print"][None, :]) <= self.threshold
        near |= np.bitwise_count(a["print_b"][:, None] ^ b["print_b"][None, :]) <= self.threshold
        x, y = near.nonzero()
        apart = sum(np.bitwise_count(a[c][x] ^ b[c][y]).astype(np.int64) for c in ("sketch_0", "sketch_1"))
        close = apart <= self.most_apart
        return x[close], y[close], apart[close]


def _cell_sides(cell: pa.Table, rule: Bits) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Nodes of a cell's home rows and of its other rows, and their columns."""
    node, role = cell.column("node").to_numpy(), cell.column("role").to_numpy()
    columns = {c: cell.column(c).to_numpy().view(np.uint64) for c in ("print", *rule.columns)}
    home, other = role < 2, role > 0
    return node[home], node[other], {c: v[home] for c, v in columns.items()}, {c: v[other] for c, v in columns.items()}


def _first_of_each(u: np.ndarray, v: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the pairs of each u the one of fewest bits, ties to the smaller v."""
    order = np.lexsort((v, apart, u))
    u, v, apart = u[order], v[order], apart[order]
    first = np.ones(len(u), dtype=bool)
    first[1:] = u[1:] != u[:-1]
    return u[first], v[first], apart[first]


def _closest(cell: pa.Table, rule: PartBits) -> tuple[np.ndarray, ...]:
    """(home row, other, bits apart) of each home row's closest candidate in a cell, and of its closest among smaller nodes."""
    homes, others, own, rest = _cell_sides(cell, rule)
    found = []
    for at in range(0, len(homes), STRIP_ROWS):
        x, y, apart = rule.candidates({c: v[at : at + STRIP_ROWS] for c, v in own.items()}, rest)
        u, v = homes[at + x], others[y]
        for some in (u != v, v < u):
            found.append(_first_of_each(u[some], v[some], apart[some]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (homes[:0], homes[:0], homes[:0])


def _closest_apart(cell: pa.Table, rule: PartBits) -> tuple[np.ndarray, ...]:
    """(home row, other, bits apart) of each home row's closest candidate in another component that it was not compared with."""
    homes, others, own, rest = _cell_sides(cell, rule)
    own, rest = ({c: v.view(np.int64) if c in ("root", *rule.tested) else v for c, v in side.items()} for side in (own, rest))
    found = [(homes[:0],) * 3]
    for at in range(0, len(homes), STRIP_ROWS):
        x, y, apart = rule.candidates({c: v[at : at + STRIP_ROWS] for c, v in own.items()}, rest)
        u, v, x = homes[at + x], others[y], at + x
        some = own["root"][x] != rest["root"][y]
        for c in rule.tested:
            some &= (own[c][x] != v) & (rest[c][y] != u)
        found.append(_first_of_each(u[some], v[some], apart[some]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _open_pairs(cell: pa.Table, rule: PartBits) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first home row of a strip, row of the strip, other row) of a cell's candidates in different components that were not compared and that meet here first."""
    homes, others, own, rest = _cell_sides(cell, rule)
    whole = (own["print"], own["print_b"]), (rest["print"], rest["print_b"])
    own, rest = ({c: v.view(np.int64) if c in ("root", *rule.tested) else v for c, v in side.items()} for side in (own, rest))
    at_part = cell.column("part").to_numpy()[0]
    for at in range(0, len(homes), STRIP_ROWS):
        x, y, _ = rule.candidates({c: v[at : at + STRIP_ROWS] for c, v in own.items()}, rest)
        u, v, k = homes[at + x], others[y], at + x
        some = own["root"][k] != rest["root"][y]
        for c in rule.tested:
            some &= (own[c][k] != v) & (rest[c][y] != u)
        x, y, k = x[some], y[some], k[some]
        first = np.full(len(x), 8)
        for part in reversed(range(8)):
            a, b = whole[0][part // 4][k], whole[1][part // 4][y]
            first[np.bitwise_count(((a ^ b) >> np.uint64(16 * (part % 4))) & np.uint64(0xFFFF)) <= 1] = part
        yield at, x[first == at_part], y[first == at_part]


def _open_rows(cell: pa.Table, rule: PartBits) -> tuple[np.ndarray, ...]:
    """(cell, part, node, role: 0 home row, 2 other, 1 both) of a cell's rows that have an open pair in it."""
    homes, others, _, _ = _cell_sides(cell, rule)
    home, other = np.zeros(len(homes), dtype=bool), np.zeros(len(others), dtype=bool)
    for at, x, y in _open_pairs(cell, rule):
        home[at + x] = True
        other[y] = True
    one, two = homes[home], others[other]
    node = np.union1d(one, two)
    role = np.where(np.isin(node, one), np.where(np.isin(node, two), 1, 0), 2)
    return np.full(len(node), cell.column("cell")[0].as_py()), np.full(len(node), cell.column("part")[0].as_py()), node, role


def _verified_links(cell: pa.Table, rule: PartBits, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member) among a cell's rows, by all its open pairs whose sets are ``similarity`` alike.

    Pairs that links found in the cell have joined are passed over.
    """
    roles, sets = cell.column("role").to_numpy(), cell.column("shingles").combine_chunks()
    codes, code = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(np.diff(sets.offsets.to_numpy()))])
    home_at, other_at = (roles < 2).nonzero()[0], (roles > 0).nonzero()[0]
    names, index = np.unique(cell.column("node").to_numpy(), return_inverse=True)
    group, size, held = np.arange(len(names)), np.diff(ends), np.zeros(len(codes), dtype=bool)
    for at, x, y in _open_pairs(cell, rule):
        order = np.argsort(x, kind="stable")
        for row, some in zip(*(lambda r, s: (r, np.split(y[order], s[1:])))(*np.unique(x[order], return_index=True))):
            me = home_at[at + row]
            some = other_at[some]
            some = some[group[index[some]] != group[index[me]]]
            some = some[np.minimum(size[some], size[me]) >= similarity * np.maximum(size[some], size[me]) - 1e-9]
            some = some[size[some] > 0]
            if not len(some):
                continue
            held[code[ends[me] : ends[me + 1]]] = True
            both = np.array([np.count_nonzero(held[code[ends[k] : ends[k + 1]]]) for k in some])
            held[code[ends[me] : ends[me + 1]]] = False
            alike = both >= similarity * (size[some] + size[me] - both) - 1e-9
            joined = np.unique(group[index[np.append(some[alike], me)]])
            group[np.isin(group, joined)] = joined[0]
    linked = (group != np.arange(len(names))).nonzero()[0]
    return names[linked], names[group[linked]]


def _compare(cell: pa.Table, rule: Bits) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member) among the nodes of a cell."""
    node, role = cell.column("node").to_numpy(), cell.column("role").to_numpy()
    columns = {c: cell.column(c).to_numpy().view(np.uint64) for c in ("print", *rule.columns)}
    nodes, first, index = np.unique(node, return_index=True, return_inverse=True)
    homes, others = index[role < 2], index[role > 0]
    found_a, found_b = [], []
    other_rows = {c: v[first[others]] for c, v in columns.items()}
    for at in range(0, len(homes), 512):
        part = homes[at : at + 512]
        x, y = rule.alike({c: v[first[part]] for c, v in columns.items()}, other_rows).nonzero()
        keep = part[x] != others[y]
        found_a.append(part[x[keep]])
        found_b.append(others[y[keep]])
    if not found_a:
        return nodes[:0], nodes[:0]
    root = _local_roots(len(nodes), np.concatenate(found_a), np.concatenate(found_b))
    linked = (root != np.arange(len(nodes))).nonzero()[0]
    return nodes[linked], nodes[root[linked]]


def covering_links(nodes: DataFrame, rule: Bits, cell_rows: int = CELL_ROWS, *, compare=_compare, names: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """Links u, v between the longs ``node`` of different rows that join all rows alike by ``rule``; or what ``compare`` gives of each cell.

    ``nodes`` (node, print and the rule's columns; nodes distinct) is read twice.  Role 0 is
    compared as home row, 2 as replica, 1 as both.  An anchor of over ``cell_rows`` rows is cut into a
    grid of cells: home rows are repeated over the replica cuts and replicas over the home cuts.
    """
    result, names = list(names), ["node", "print", *rule.columns]

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                prints = [part.column(names.index(c)).to_numpy().view(np.uint64) for c in ("print", "print_b") if c in names]
                row, anchor, home = rule.replicas(*prints)
                kept = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(anchor), pa.array(home)], [*names, "anchor", "at_home"])

    near = nodes.select(*names).mapInArrow(replicate, ", ".join(f"{c} long" for c in [*names, "anchor"]) + ", at_home boolean")
    counted = near.groupBy("anchor").agg(F.count("*").alias("all"), F.count_if("at_home").alias("homes")).filter(F.col("all") > cell_rows)
    cuts = settle(
        counted.select(
            "anchor",
            F.greatest(F.ceil(F.col("homes") / cell_rows), F.lit(1)).cast("int").alias("home_cuts"),
            F.ceil(F.col("all") / cell_rows).cast("int").alias("all_cuts"),
        )
    )
    slot = F.xxhash64("node")
    home_slot, all_slot = F.pmod(slot, "home_cuts").cast("int"), F.pmod(slot, "all_cuts").cast("int")

    def cell(i: Column, j: Column, role: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), role.alias("role"))

    # (i, j): home rows i against replicas j.  Where there is one cell, a home row goes once.
    one = (F.col("home_cuts") == 1) & (F.col("all_cuts") == 1)
    as_home = F.transform(F.sequence(F.lit(0), F.col("all_cuts") - 1), lambda j: cell(home_slot, j, F.lit(0)))
    as_other = F.transform(F.sequence(F.lit(0), F.col("home_cuts") - 1), lambda i: cell(i, all_slot, F.lit(2)))
    single = F.array(cell(F.lit(0), F.lit(0), F.when(F.col("at_home"), 1).otherwise(2)))
    each = F.when(one, single).when(F.col("at_home"), F.concat(as_home, as_other)).otherwise(as_other)
    part = [F.shiftright("anchor", 16).cast("byte").alias("part")] if "root" in rule.columns else []
    cells = (
        near.join(narrow(cuts), "anchor", "left").fillna(1, ["home_cuts", "all_cuts"])
        .select(*names, "anchor", F.explode(each).alias("c"))
        .select(*names, *part, F.xxhash64("anchor", "c.i", "c.j").alias("cell"), F.col("c.role").cast("byte").alias("role"))
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "cell"):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in compare(group, rule)], result)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(compared, ", ".join(f"{c} long" for c in result)).distinct()


def component_ids(rows: DataFrame, rule: Bits) -> DataFrame:
    """node, root, component_id: a name of the node's component and its smallest doc_id (rows: doc_id, node, print and the rule's columns)."""
    lowest = settle(rows.groupBy("node", "print", *rule.columns).agg(F.min("doc_id").alias("low")))
    roots = components(covering_links(lowest, rule)).toDF("node", "root")
    rooted = lowest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return settle(rooted.join(ids, "root").select("node", "root", "component_id"))


def near_duplicates(docs: DataFrame, *, shingle: int = 3, threshold: int = 2, block: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    Links join fingerprints that differ in at most ``threshold`` bits; a component's id is its
    smallest doc_id.  Blocks of ``block`` bits make the anchors: by default 5, for 2^12 anchors
    and some 38 replicas a fingerprint, and 3 for tables of over LARGE_ROWS rows, for 2^21 anchors and
    some 140 replicas, so that the rows that meet at an anchor do not grow with the table as fast.  Null and empty texts have fingerprint zero and are linked like others.
    A null doc_id is never a component's id unless all of the component's are null.  Repeated
    rows are returned as often as they occur.
    """
    prints = settle(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("print")))
    block = block or (5 if prints.count() <= LARGE_ROWS else 3)
    ids = component_ids(prints.withColumn("node", F.col("print")), Bits(threshold, block))
    return prints.join(ids, prints["print"] == ids["node"]).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _sketch_factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 1 << 63, SKETCH_BITS, dtype=np.uint64) | np.uint64(1), rng.integers(1, 1 << 63, SKETCH_BITS, dtype=np.uint64)


def sketch(hashes: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """One bit of each of SKETCH_BITS minima of a set; two sets of similarity s agree in (1 + s) / 2 of them."""
    a, b = factors
    low = np.full(SKETCH_BITS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 2_048):
            mixed = hashes[at : at + 2_048, None] * a + b
            low = np.minimum(low, (mixed ^ (mixed >> np.uint64(31))).min(axis=0))
        # A bit that does not depend on the minima being small.
        bits = np.packbits(((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(bool))
    return int.from_bytes(bits[:8].tobytes(), "big", signed=True), int.from_bytes(bits[8:].tobytes(), "big", signed=True)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _marks(text: Column) -> Column:
    """set_0 and set_1 (128 bits that name a text's set of word shingles), two prints of its words, and the sketch of the set."""
    factors = _sketch_factors()

    @F.pandas_udf("struct<set_0:long,set_1:long,print:long,print_b:long,sketch_0:long,sketch_1:long>")
    def marks(texts: pd.Series) -> pd.DataFrame:
        out = []
        for value in texts:
            value = value or b""
            words = np.array([xxhash.xxh64_intdigest(w, SEED) for w in value.lower().split()], dtype=np.uint64)
            with np.errstate(over="ignore"):
                mixed = (words ^ (words >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            shingles = np.unique(shingle_hashes(value, SHINGLE))
            named = xxhash.xxh3_128_intdigest(shingles.tobytes())
            out.append((_signed(named >> 64), _signed(named & (1 << 64) - 1), majority_bits(words), majority_bits(mixed ^ (mixed >> np.uint64(29))), *sketch(shingles, factors)))
        return pd.DataFrame(out, columns=["set_0", "set_1", "print", "print_b", "sketch_0", "sketch_1"], dtype="int64")

    return marks.asNondeterministic()(text.cast("binary"))


def _shingle_sets(text: Column) -> Column:
    """32-bit hashes of a text's distinct word shingles; two of one text's thousands are equal by chance in one text of hundreds."""

    @F.pandas_udf("array<int>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t or b"", SHINGLE).astype(np.uint32)).view(np.int32) for t in texts], dtype=object)

    return sets.asNondeterministic()(text.cast("binary"))


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (u, v) whose sets (node, shingles) are ``similarity`` alike, counted exactly."""
    one, other = (sets.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_set")) for side in ("u", "v"))
    both = F.size(F.array_intersect("u_set", "v_set"))
    pairs = one.join(narrow(edges), "u").join(other, "v")
    return pairs.filter(both >= similarity * (F.size("u_set") + F.size("v_set") - both) - 1e-9).select("u", "v")


def all_similar(rooted: DataFrame, rule: PartBits, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Links u, v that join what all candidates in different components join that were not compared, each compared exactly.

    ``rooted`` has node and the rule's columns.  A first pass over the cells returns their rows that
    have such a candidate, so only these get their sets.  Pairs are compared inside the cells, each in one
    of them; no table holds a row a pair.  A cell is cut into a grid of SET_ROWS by SET_ROWS rows.
    """
    found = settle(covering_links(rooted, rule, compare=_open_rows, names=("cell", "part", "node", "role")))
    counted = found.groupBy("cell").agg(F.count_if(F.col("role") < 2).alias("homes"), F.count_if(F.col("role") > 0).alias("others"))
    large = settle(
        counted.filter((F.col("homes") > SET_ROWS) | (F.col("others") > SET_ROWS))
        .select("cell", F.ceil(F.col("homes") / SET_ROWS).cast("int").alias("home_cuts"), F.ceil(F.col("others") / SET_ROWS).cast("int").alias("other_cuts"))
    )
    slot = F.xxhash64("node")
    home_slot, other_slot = F.pmod(slot, "home_cuts").cast("int"), F.pmod(slot, "other_cuts").cast("int")

    def place(i: Column, j: Column, role: Column) -> Column:
        return F.struct(F.xxhash64("cell", i, j).alias("cell"), role.alias("role"))

    one = (F.col("home_cuts") == 1) & (F.col("other_cuts") == 1)
    as_home = F.transform(F.sequence(F.lit(0), F.col("other_cuts") - 1), lambda j: place(home_slot, j, F.lit(0).cast("long")))
    as_other = F.transform(F.sequence(F.lit(0), F.col("home_cuts") - 1), lambda i: place(i, other_slot, F.lit(2).cast("long")))
    each = F.when(one, F.array(place(F.lit(0), F.lit(0), F.col("role")))).when(F.col("role") == 0, as_home)
    each = each.when(F.col("role") == 2, as_other).otherwise(F.concat(as_home, as_other))
    cut = found.join(narrow(large), "cell", "left").fillna(1, ["home_cuts", "other_cuts"])
    cut = cut.select(F.explode(each).alias("c"), "part", "node").select("c.cell", "part", "node", "c.role")
    rows = cut.join(rooted, "node").join(sets_of(found), "node")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "cell"):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _verified_links(group, rule, similarity)], ["u", "v"])

    return settle(rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(compared, "u long, v long").distinct())


def similar_links(classes: DataFrame, docs: DataFrame, similarity: float, agree: float) -> DataFrame:
    """Links u, v between nodes of ``classes`` that join all candidates whose shingle sets are ``similarity`` alike.

    ``classes`` (node, low_id, low_mark, low_copies and the rule's columns) name one row of
    ``docs`` (doc_id, mark, text) each, of which there are low_copies.  Each class is compared
    exactly with its closest candidate and its closest among smaller nodes, which joins groups of
    any size by two comparisons a member, and then, in ROUNDS rounds, with its closest candidate
    in another component that it was not compared with.  What these leave apart is compared
    in full by ``all_similar``.  So none is linked below the similarity and no candidate is left out; the rounds
    keep the last step small.
    """
    rule = PartBits(WORD_BITS, agree)
    close = settle(covering_links(classes, rule, compare=_closest, names=("u", "v", "apart")))
    best = settle(
        close.groupBy("u").agg(
            F.min(F.struct("apart", "v"))["v"].alias("best"), F.min(F.when(F.col("v") < F.col("u"), F.struct("apart", "v")))["v"].alias("lower")
        )
    )
    directed = best.select("u", F.explode(F.array_compact(F.array("best", "lower"))).alias("v"))
    edges = settle(directed.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("u", "v")).alias("node"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        some = nodes.select("node").distinct()
        named = narrow(settle(classes.select("node", "low_id", "low_mark", "low_copies").join(some, "node")))
        here = docs.join(named, docs["doc_id"].eqNullSafe(named["low_id"]) & (docs["mark"] == named["low_mark"]))
        once, again = here.filter("low_copies = 1"), here.filter("low_copies > 1").dropDuplicates(["node"])
        return settle(once.union(again).select("node", _shingle_sets(F.col("text")).alias("shingles")))

    first = settle(verified(edges, sets_of(ends(edges)), similarity))
    # Only what has a candidate at all is looked at again.
    some = settle(ends(close).distinct().join(best.withColumnRenamed("u", "node"), "node", "left").fillna(-1))
    links, tested = first, ["best", "lower"]

    def rooted_by(rule: PartBits) -> DataFrame:
        roots = components(links).toDF("node", "root")
        rooted = classes.join(some, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        return settle(rooted.select("node", "print", *rule.columns))

    for _ in range(ROUNDS):
        rule = PartBits(WORD_BITS, agree, tuple(tested))
        rooted = rooted_by(rule)
        apart = covering_links(rooted, rule, compare=_closest_apart, names=("u", "v", "apart"))
        apart = settle(apart.groupBy("u").agg(F.min(F.struct("apart", "v"))["v"].alias("v")))
        left = settle(apart.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        found = settle(verified(left, sets_of(ends(left)), similarity))
        links = links.union(found)
        tested.append(f"tested_{len(tested)}")
        some = some.join(apart.toDF("node", tested[-1]), "node", "left").fillna(-1, [tested[-1]])
    rule = PartBits(WORD_BITS, agree, tuple(tested))
    return links.union(all_similar(rooted_by(rule), rule, sets_of, similarity))


def one_of_each(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` but for near duplicates: of each group the row of smallest doc_id stays.

    Texts are near duplicates if their sets of five-word shingles have a similarity of
    ``similarity``, counted exactly, and groups are what such links join.  Candidates are texts
    of which one of two word fingerprints differs in at most WORD_BITS bits and whose sketches
    are within SKETCH_MARGIN deviations of the similarity.  Texts without words are one group.
    Of rows equal in doc_id and text one stays; a null doc_id goes first.
    """
    mark, count, here_mark, kept_id = (free_name(docs, x) for x in ("_mark", "_copies", "_here", "_kept_id"))
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), _marks(F.col("text")).alias("m")).select("doc_id", "mark", "m.*")
    rows = settle(marked)
    # Half the disagreement that the similarity leaves, and some deviations of the estimate.
    agree = (1 + similarity) / 2 - SKETCH_MARGIN * math.sqrt((1 - similarity**2) / 4 / SKETCH_BITS)
    # Texts of one shingle set are one node; nodes are numbered once, in a stored table.
    looks = F.struct("print", "print_b", "sketch_0", "sketch_1")
    copies = rows.groupBy("set_0", "set_1", "doc_id", "mark").agg(F.count("*").alias("copies"), F.min(looks).alias("looks"))
    low = F.min(F.struct("doc_id", "mark", "copies"))
    classes = copies.groupBy("set_0", "set_1").agg(F.min("looks").alias("looks"), low.alias("low"))
    classes = settle(
        classes.select(
            F.monotonically_increasing_id().alias("node"), "looks.*",
            F.col("low.doc_id").alias("low_id"), F.col("low.mark").alias("low_mark"), F.col("low.copies").alias("low_copies"),
        )
    )
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    roots = components(similar_links(classes, texts, similarity, agree)).toDF("node", "root")
    grouped = classes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    kept = settle(grouped.agg(F.min(F.struct(F.col("low_id").alias("doc_id"), F.col("low_mark").alias("mark"), F.col("low_copies").alias("copies"))).alias("low")).select("low.*"))
    kept = kept.select(F.col("doc_id").alias(kept_id), F.col("mark").alias(mark), F.col("copies").alias(count))
    here = docs.withColumn(here_mark, F.xxhash64("text"))
    same = here["doc_id"].eqNullSafe(kept[kept_id]) & (here[here_mark] == kept[mark])
    joined = here.join(kept, same).select(*[here[c] for c in docs.columns], kept[count], kept[mark])
    once = joined.filter(F.col(count) == 1).select(*docs.columns)
    again = joined.filter(F.col(count) > 1).dropDuplicates(["doc_id", mark]).select(*docs.columns)
    return once.unionByName(again)
