from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import trie

from .helpers import empty

TURNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The contract's nodes of (conv_id, turn, role, text) from sets of members of spelt-out prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, below = [], {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(below[k][1] for k in children[p])
        below[p] = (sum(below[k][0] for k in children[p]) or 1, saved)
        parent = members[p[:-1]][0] if p else None
        digest = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out.append((members[p][0], len(p), parent, len(members[p]), len(children[p]), *below[p], digest))
    return sorted(out, key=repr)


def rows_of(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def table(seed, n=60):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(-7, n):
        if rng.random() < 0.15:
            continue
        length = int(rng.integers(1, 12)) if rng.random() < 0.9 else 60
        for t in range(length):
            rows.append((c, t, "user" if t % 2 else "assistant", f"é{rng.integers(0, 1 + t % 3)}" * int(rng.integers(1, 3))))
    return rows


def awkward():
    rows = table(0)
    rows += [(200, None, "user", "x"), (200, 0, None, None), (200, 0, "", ""), (200, 1, "user", "x"), (200, 1, "user", "x")]
    rows += [(None, 0, "user", "nobody"), (203, 0, "user", "lone"), (1005, 0, "user", "z" * 100_000)]
    for c in range(300, 420):
        rows += [(c, t, "user", f"same {t}") for t in range(10)]
    return rows


@pytest.mark.parametrize("options", [{}, {"part_rows": 20}, {"part_rows": 1_000, "block_rows_": 3}, {"part_rows": 7, "block_rows_": 1}])
def test_same_as_brute_force(spark, options):
    """Parts and blocks of any size, one conversation included, give the same nodes."""
    rows = awkward()
    turns = spark.createDataFrame(rows, TURNS).withColumn("key", F.lit(0)).withColumn("base", F.lit("x")).repartition(5)
    assert rows_of(trie.rebuilt_trie(turns, **options)) == plain(rows)


def test_same_as_sql(spark, tmp_path):
    spark.createDataFrame(awkward(), TURNS).coalesce(1).write.parquet(str(tmp_path / "conversations"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations/*.parquet'")
    want = sorted(con.execute(trie.rebuilt_trie_sql()).fetchall(), key=repr)
    assert rows_of(trie.rebuilt_trie(spark.createDataFrame(awkward(), TURNS), part_rows=30)) == want


@pytest.mark.parametrize("seed", range(40))
def test_blocks_without_spark(seed):
    """Random sequences, cut at random into blocks, against sets of members."""
    rng = np.random.default_rng(seed)
    seqs = sorted((bytes(rng.integers(0, 2, int(rng.integers(0, 6)), dtype=np.uint8)), int(i)) for i in rng.permutation(int(rng.integers(1, 40))))
    keyed = [(b"".join(bytes([t] * trie.DIGEST) for t in s), i) for s, i in seqs]
    members, ends = defaultdict(list), defaultdict(list)
    for s, i in seqs:
        for d in range(len(s) + 1):
            members[s[:d]].append(i)
        ends[s].append(i)
    cuts = sorted({0, len(keyed), *rng.integers(0, len(keyed) + 1, int(rng.integers(0, 6))).tolist()})
    out = [
        dict(zip(trie.NAMES, r))
        for b, (x, y) in enumerate(zip(cuts, cuts[1:]))
        for r in trie.block_rows(b, [i for _, i in keyed[x:y]], [k for k, _ in keyed[x:y]], [[1 << d for d in range(len(k) // trie.DIGEST)] for k, _ in keyed[x:y]])
    ]
    edges = [(r["block"], r["depth"], r["first"], r["last"]) for r in out if r["kind"] == trie.EDGE]
    spines = defaultdict(dict)
    figures = ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size")
    for r in out:
        if r["kind"] == trie.SPINE:
            spines[r["block"], r["side"]][r["depth"]] = tuple(r[c] for c in figures)
    merged = list(trie.merge_spines(edges, spines))
    low = {(b, s, m["depth"]): m["conv_id"] for m in merged for b, s in m["at"]}
    got = [(m["conv_id"], m["depth"], m["parent_conv_id"], *(m[c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))) for m in merged]
    for r in out:
        if r["kind"] == trie.NODE:
            parent = r["parent_conv_id"] if r["parent_side"] is None else low[r["block"], r["parent_side"], r["depth"] - 1]
            got.append((r["conv_id"], r["depth"], parent, *(r[c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))))
    want, below = [], {}
    for p in sorted(members, key=len, reverse=True):
        kids = [k for k in members if len(k) == len(p) + 1 and k[:-1] == p]
        saved = (len(members[p]) - 1) * ((1 << len(p)) >> 1) + sum(below[k][1] for k in kids)
        below[p] = (sum(below[k][0] for k in kids) or 1, saved)
        want.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), *below[p]))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_common_turns():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (bytes(np.repeat(rng.integers(0, 2, int(rng.integers(0, 9)), dtype=np.uint8), trie.DIGEST)) for _ in range(2))
        n = 0
        while (n + 1) * trie.DIGEST <= min(len(a), len(b)) and a[: (n + 1) * trie.DIGEST] == b[: (n + 1) * trie.DIGEST]:
            n += 1
        assert trie.common_turns(a, b) == n


def test_empty_and_turnless(spark):
    assert trie.rebuilt_trie(empty(spark, TURNS)).collect() == []
    turns = spark.createDataFrame([(9, 0, "user", "x"), (14, 0, "user", "x")], TURNS)
    assert rows_of(trie.rebuilt_trie(turns)) == plain([tuple(r) for r in turns.collect()])
