from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from orderloom.llm import licenses as L

from .helpers import documents, empty, words

TEXTS = [
    None,
    "",
    "MIT License",
    "the mit  license, MIT\nLicense; apache license",
    "GNU general public license general public license",
    "Released under the MIT License.\nother line",
    "x\nLicensed under CC BY-NC 4.0.\ny",
    "Licensed under CC BY 4.0",
    "Licensed, under the Apache-License; Version 2",
    "ünlicense mit ülicense",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files",
    "license licensed under version",
    "A\x00mit\x7flicense{}",
]


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_places(found):
    return sorted(
        (i, label) for phrase, label in L.PHRASES for i in range(len(found)) if found[i : i + len(phrase.split())] == phrase.split()
    )


def plain_blocks(text):
    """(first word, template, containment) by comparing every block with every template."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        line = plain_words(line)
        starts = [0] if len(line) <= L.BLOCK_WORDS else range(0, len(line) - L.BLOCK_WORDS // 2, L.BLOCK_WORDS // 2)
        for a in starts:
            block = set(line[a : a + L.BLOCK_WORDS])
            for t, (_, notice) in enumerate(L.TEMPLATES):
                need = set(plain_words(notice))
                if len(need & block) >= L.THRESHOLD * len(need) - 1e-9:
                    out.append((at + a, t, len(need & block) / len(need)))
        at += len(line)
    return sorted(out)


def long_texts():
    rng = np.random.default_rng(0)
    deep = words(rng, 500).replace(" w", " Licensed under CC BY-SA 4.0 w", 1)
    return [words(rng, 30_000) + " Use of this source code is governed by a BSD-style license that can be found in the LICENSE file " + words(rng, 99), deep]


def test_base_columns_and_labels(spark):
    texts = [*TEXTS, *long_texts()]
    docs = documents(spark, texts).withColumn("labels", F.lit("x")).withColumn("score", F.lit(9))
    rows = L.scan_documents(docs.union(docs.filter("doc_id = 2"))).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        found = plain_words(texts[r["doc_id"]])
        places = plain_places(found)
        assert r["n_words"] == len(found) and r["n_base"] == len(places)
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    got = {r["doc_id"]: r for r in rows}
    labels = [got[i]["labels"] for i in range(len(texts))]
    assert labels == ["", "", "mit", "apache,mit", "gpl", "mit", "cc-by-nc", "cc-by", "apache", "", "mit", "", "mit", "bsd", "cc-by-sa"]


def test_join_finds_all_that_brute_force_finds(spark):
    rng = np.random.default_rng(1)
    bag = sorted({w for _, t in L.TEMPLATES for w in plain_words(t)})
    noise = ["\n".join(" ".join(rng.choice(bag, rng.integers(1, 40))) for _ in range(20)) for _ in range(20)]
    for _, notice in L.TEMPLATES:
        parts = notice.split()
        rng.shuffle(parts)
        noise.append(" ".join(parts[: max(1, int(len(parts) * 0.85))]))
    texts = [*TEXTS, *noise, *long_texts()]
    got: dict = {}
    for r in L.license_blocks(documents(spark, texts)).collect():
        got.setdefault(r["doc_id"], []).append((r["first_word"], r["template"], r["containment"]))
    assert {d: sorted(v) for d, v in got.items()} == {d: b for d, t in enumerate(texts) if (b := plain_blocks(t))}


def test_other_thresholds_and_empty_tables(spark):
    docs = documents(spark, TEXTS)
    strict = {r["containment"] for r in L.license_blocks(docs, threshold=1.0).collect()}
    assert strict == {1.0}
    assert L.scan_documents(empty(spark)).collect() == []
    assert L.license_blocks(empty(spark)).collect() == []


def plain_windows(text):
    """(first word, template, containment) of the windows over several lines by comparing each with every template."""
    lines = [(n, w) for n, line in enumerate((text or "").split("\n")) for w in plain_words(line)]
    out, step = [], L.BLOCK_WORDS // 2
    for a in range(0, max(1, len(lines) - step), step):
        part = lines[a : a + L.BLOCK_WORDS]
        block = {w for _, w in part}
        for t, (_, notice) in enumerate(L.TEMPLATES):
            need = set(plain_words(notice))
            if len({n for n, _ in part}) > 1 and len(need & block) >= L.THRESHOLD * len(need) - 1e-9:
                out.append((a, t, len(need & block) / len(need)))
    return sorted(out)


def wrapped(text, width, leader):
    lines = [""]
    for word in text.split():
        if len(lines[-1]) + len(word) > width:
            lines.append("")
        lines[-1] += " " + word
    return "\n".join(leader + line for line in lines)


def test_wrapped_notices_have_their_label(spark):
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for label, notice in L.TEMPLATES:
        for width, leader in ((25, " *"), (40, "#"), (70, "//")):
            texts.append(words(rng, rng.integers(0, 90)) + "\n" + wrapped(notice, width, leader) + "\n" + words(rng, rng.integers(0, 90)))
            labels.append(label)
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in L.scan_documents(docs).collect()}
    for d, label in enumerate(labels):
        assert label in got[d]["labels"].split(","), texts[d]
        assert got[d]["score"] == 1.0
    found: dict = {}
    for r in L.license_windows(docs).collect():
        found.setdefault(r["doc_id"], []).append((r["first_word"], r["template"], r["containment"]))
    assert {d: sorted(v) for d, v in found.items()} == {d: b for d, t in enumerate(texts) if (b := plain_windows(t))}


def test_wrapped_notices_side_by_side(spark):
    notices = dict((label, notice) for label, notice in reversed(L.TEMPLATES))
    mpl = notices["mpl"]
    bsd = next(n for label, n in L.TEMPLATES if n.startswith("Redistribution"))
    text = wrapped(bsd, 30, "#") + "\n" + wrapped(mpl, 30, "#")
    rows = L.scan_documents(documents(spark, [text, "one line only: " + mpl, wrapped("Licensed under CC BY-NC 4.0.", 9, "#")])).collect()
    assert {r["doc_id"]: r["labels"] for r in rows} == {0: "bsd,mpl", 1: "mpl", 2: "cc-by-nc"}


def test_a_text_of_very_many_notices(spark):
    line = "Licensed under the Apache License, Version 2.0. See the MIT license.\n"
    n = 20_000
    row = L.scan_documents(documents(spark, [line * n])).first()
    assert row["n_base"] == 2 * n and row["first_word"] == 3 and row["last_word"] == 12 * (n - 1) + 10
    assert row["base_labels"] == "apache,mit" and row["score"] == 1.0
