from __future__ import annotations

import time
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orderloom.llm import simhash
from orderloom.llm.common import released_shuffles, settle
from orderloom.llm.components import components

from .helpers import documents, empty, rows_of, words


def plain_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, near):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if label[j] > label[i] and near(prints[i], prints[j]):
                    label[j] = label[i]
                    changed = True
    return label


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(2)
    base = [words(rng, n) for n in (3, 30, 200, 400, 1, 2)]
    out = [None, "", "  \t", "One", "ONE", "one two", "Ünï ünï", *base]
    for b in base[2:4]:
        parts = b.split()
        for k in range(8):
            parts[k * 7] = "changed"
            out.append(" ".join(parts))
    return [*out, base[0], words(rng, 30_000)]


def test_same_as_brute_force(spark, texts):
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = [plain_print(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)


@pytest.mark.parametrize("threshold,block", [(1, 3), (2, 5), (3, 7)])
def test_covering_loses_no_pair(spark, threshold, block):
    rng = np.random.default_rng(threshold)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(120)]
    prints = sorted({int(base[k % 12]) ^ f for k, f in enumerate(flips)} | {0, (1 << 64) - 1})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(s, s) for s in signed], "node long, print long")
    for cell_rows in (2, 8192) if block == 5 else (8192,):
        links = simhash.covering_links(nodes, simhash.Bits(threshold, block), cell_rows)
        root = dict(tuple(r) for r in components(links).collect())
        label = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= threshold)
        groups: dict = {}
        for s, k in zip(signed, label):
            groups.setdefault(k, set()).add(root.get(s, s))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_quarters_lose_no_pair():
    rng = np.random.default_rng(9)
    rule = simhash.PartBits(7, 0.9)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, 7, replace=False):
            b ^= 1 << int(bit)
        row, anchor, home = rule.replicas(np.array([a, b], dtype=np.uint64))
        at = {(r, k): h for r, k, h in zip(row.tolist(), anchor.tolist(), home.tolist())}
        assert any((1 - r, k) in at and h for (r, k), h in at.items())


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(20, 40)] + [(3, 3), (5, 4), (5, 4)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{k: 7 for k in range(20, 40)}, 4: 4, 5: 4}


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = documents(spark, ["a b c d", "a b c d", "x y z"])
    more = docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long"))).withColumn("print", F.lit("odd"))
    got = simhash.near_duplicates(more).collect()
    assert len(got) == 9
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(0, 0), (1, 0), (2, 2), (None, 0), (None, 2)}
    assert simhash.near_duplicates(empty(spark)).collect() == []


def test_one_of_each_group_stays(spark):
    rng = np.random.default_rng(4)
    clean = [words(rng, n, 50_000) for n in (40, 300, 900, 300)]
    near = []
    for k in (3, 50, 120, 200, 250):
        parts = clean[1].split()
        parts[k] = "edited"
        near.append(" ".join(parts))
    docs = documents(spark, [*clean, *near, clean[2], None, "", None]).withColumn("_mark", F.lit(1))
    docs = docs.union(docs.filter("doc_id in (0, 10)"))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 10]
    assert simhash.one_of_each(empty(spark)).collect() == []


def test_same_id_with_other_text_is_another_document(spark):
    rng = np.random.default_rng(6)
    docs = documents(spark, [words(rng, 60), words(rng, 60), words(rng, 60)])
    same = docs.withColumn("doc_id", F.lit(5).cast("long"))
    none = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.one_of_each(same).count() == 3
    assert rows_of(simhash.one_of_each(none.union(none))) == rows_of(none)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(8)
    factors = simhash._sketch_factors()
    both = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for shared in (0, 500, 900):
        a, b = both[:1000], np.concatenate([both[:shared], rng.integers(0, 1 << 63, 1000 - shared, dtype=np.uint64)])
        x, y = simhash.sketch(a, factors), simhash.sketch(b, factors)
        apart = sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x, y))
        similarity = shared / (2000 - shared)
        assert abs(1 - 2 * apart / 128 - similarity) < 0.25


def shingles(text, n=5):
    parts = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(parts[i : i + n]) for i in range(max(1, len(parts) - n + 1))} if parts else set()


def copies_at_all_similarities(rng, n_groups=60):
    """Texts with copies in which some words are changed, left out or put in, from hardly any to very many."""
    texts = []
    for _ in range(n_groups):
        own = words(rng, int(rng.integers(12, 500)), 4_000).split()
        texts.append(" ".join(own))
        for _ in range(int(rng.integers(1, 7))):
            copy = list(own)
            for k in sorted(rng.choice(len(copy), int(rng.integers(0, max(2, len(copy) // 22))), replace=False), reverse=True):
                copy[k : k + 1] = ([], ["edit"], [copy[k], "more"])[int(rng.integers(0, 3))]
            texts.append(" ".join(copy))
    return texts


def test_links_are_those_of_exact_similarity(spark):
    """Against all pairs: none below 0.8 is linked, and of those at 0.8 and above 99 in 100 are."""
    texts = copies_at_all_similarities(np.random.default_rng(12))
    sets = [shingles(t) for t in texts]
    alike = {
        (i, j): len(a & sets[j]) / len(a | sets[j])
        for i, a in enumerate(sets) for j in range(i)
        if len(a & sets[j]) * 2 > len(a)
    }
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, j), share in sorted(alike.items()):
        if share >= 0.8 - 1e-12:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    want = {i for i in range(len(texts)) if find(i) == i}
    kept = {r["doc_id"] for r in simhash.one_of_each(documents(spark, texts)).collect()}
    assert want <= kept
    edges = sum(0.75 < s < 0.85 for s in alike.values())
    gone = len(texts) - len(want)
    assert edges > 50 and gone > 100
    assert len(kept - want) <= 0.01 * gone


def test_candidates_behind_many_closer_ones_are_compared(spark, monkeypatch):
    """Two alike texts whose sketches are closer to seven texts each that are not alike; cells are cut into grids."""
    monkeypatch.setattr(simhash, "SET_ROWS", 2, raising=False)
    rng = np.random.default_rng(17)
    own = words(rng, 120, 9_000)
    texts = [words(rng, 120, 9_000) for _ in range(14)] + [own + " one", own + " two"]
    docs = documents(spark, texts).withColumn("mark", F.xxhash64("text"))
    far = F.expr("(doc_id >= 7 and doc_id < 14) or doc_id = 15")
    classes = docs.select(
        F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("print"), F.lit(0).cast("long").alias("print_b"),
        F.when(far, 1).otherwise(0).cast("long").alias("sketch_0"), F.lit(0).cast("long").alias("sketch_1"),
        F.col("doc_id").alias("low_id"), F.col("mark").alias("low_mark"), F.lit(1).cast("long").alias("low_copies"),
    )
    links = simhash.similar_links(classes, docs, 0.8, 0.7).collect()
    assert {tuple(sorted((r["u"], r["v"]))) for r in links} == {(14, 15)}


def test_a_large_group_of_near_copies_is_one(spark):
    rng = np.random.default_rng(13)
    own = words(rng, 120, 9_000).split()
    texts = []
    for k in range(700):
        copy = list(own)
        copy[k % 120] = f"z{k}"
        texts.append(" ".join(copy))
    kept = [r["doc_id"] for r in simhash.one_of_each(documents(spark, [*texts, words(rng, 50)])).collect()]
    assert sorted(kept) == [0, 700]


def test_finer_anchors_give_the_same_components(spark, monkeypatch):
    rng = np.random.default_rng(14)
    texts = [words(rng, int(rng.integers(1, 12)), 12) for _ in range(400)]
    want = rows_of(simhash.near_duplicates(documents(spark, texts)))
    monkeypatch.setattr(simhash, "LARGE_ROWS", 100)
    assert rows_of(simhash.near_duplicates(documents(spark, texts))) == want
    assert len({r[2] for r in want}) < 400


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f.name for d in folders for f in Path(d.getPath()).rglob("shuffle_*")}


def left_after(spark, before, seconds=20):
    """Shuffle files that are more than those of ``before``; removal runs in the background."""
    end = time.time() + seconds
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    return left


def test_settled_steps_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    once, again = settle(sums), settle(sums)
    assert rows_of(once) == rows_of(again) == [(k, sum(range(k, 1000, 7))) for k in range(7)]
    assert left_after(spark, before) == set()
    rng = np.random.default_rng(21)
    own = words(rng, 90)
    kept = simhash.one_of_each(documents(spark, [own, own + " more", words(rng, 90)]))
    assert left_after(spark, before) == set()
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]


def test_tables_outside_keep_their_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(name, None)
    with pytest.raises(ValueError), released_shuffles(spark):
        assert spark.conf.get(name) == "true"
        raise ValueError
    assert spark.conf.get(name, None) == held
    before = shuffle_files(spark)
    counted = spark.range(100).groupBy((F.col("id") % 3).alias("k")).count()
    first = rows_of(counted)
    own = shuffle_files(spark) - before
    settle(counted)
    assert own and own <= shuffle_files(spark)
    assert rows_of(counted) == first
