"""License notices by an exact set-similarity join of text blocks with templates.

Blocks are lines, and windows of ``BLOCK_WORDS`` words that overlap by half over lines of
more words and over the whole text, regardless of line ends, so a notice of up to half a
window lies whole in one of them however it is wrapped.  A block meets a template if it
contains ``THRESHOLD`` of the template's distinct words.  A window over several lines that meets
several templates has all their labels, but for those that the words of a better one explain.

All words are put in one order, rarest first, by the number of blocks in the whole corpus
that have them.  A block that shares o words with a template of n shares one of the
template's first n - o + 1 words in that order (prefix filter), has o template words at
least (length filter), and has o words left from a shared word on (positional filter).
What passes is counted exactly, so every block that meets the threshold is found.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
BLOCK_WORDS = 64

#: Phrases whose words name a license wherever they stand together.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices by which public licenses are declared, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc0", "Released under CC0 1.0 into the public domain."),
)

#: Digits, a-z and all bytes of other characters are words; the rest of ASCII separates them.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_LINE_BYTES = _WORD_BYTES[:0x0A] + b"\n" + _WORD_BYTES[0x0B:]


def split_words(text: bytes) -> list[bytes]:
    return text.lower().translate(_WORD_BYTES).split()


def text_blocks(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(first word, words) of every block with words."""
    at = 0
    for line in text.lower().translate(_LINE_BYTES).split(b"\n"):
        words = line.split()
        if len(words) <= BLOCK_WORDS:
            if words:
                yield at, words
        else:
            step = BLOCK_WORDS // 2
            for a in range(0, len(words) - step, step):
                yield at + a, words[a : a + BLOCK_WORDS]
        at += len(words)


def text_windows(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(first word, words) of the windows over the whole text that take words of several lines."""
    lines = [line.split() for line in text.lower().translate(_LINE_BYTES).split(b"\n")]
    starts, n = [], 0
    for line in lines:
        if line:
            starts.append(n)
        n += len(line)
    words = list(chain.from_iterable(lines))
    step = BLOCK_WORDS // 2
    for a in range(0, max(1, n - step), step):
        if bisect_right(starts, a) < bisect_right(starts, min(n, a + BLOCK_WORDS) - 1):
            yield a, words[a : a + BLOCK_WORDS]


def phrase_places(words: list[bytes], joined: bytes) -> list[tuple[int, str]]:
    """(first word, label) of every place of a phrase; ``joined``: the words with a blank before and after each."""
    found = []
    for phrase, label in PHRASES:
        key = b" " + phrase.encode() + b" "
        at, before, number = joined.find(key), 0, 0
        while at >= 0:
            number += joined.count(b" ", before, at)
            before = at
            found.append((number, label))
            at = joined.find(key, at + 1)
    return sorted(found)


class Templates:
    """The templates' word sets in the corpus's order, and the index of their prefixes."""

    def __init__(self, templates: tuple[tuple[str, str], ...], counts: dict[bytes, int], threshold: float):
        self.labels = [label for label, _ in templates]
        sets = [set(split_words(text.encode())) for _, text in templates]
        vocabulary = sorted(set(chain.from_iterable(sets)), key=lambda w: (counts.get(w, 0), w))
        self.order = {w: k for k, w in enumerate(vocabulary)}
        self.sets = [sorted(self.order[w] for w in words) for words in sets]
        self.need = [math.ceil(threshold * len(words) - 1e-9) for words in sets]
        #: word -> (template, place in it), for words in a template's prefix.
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, (words, need) in enumerate(zip(self.sets, self.need)):
            for i, w in enumerate(words[: len(words) - need + 1] if words else []):
                self.prefix.setdefault(w, []).append((t, i))
        self.members = [frozenset(words) for words in self.sets]
        self.seeds = frozenset(vocabulary[w] for w in self.prefix)

    def unexplained(self, found: list[tuple[int, int, float]]) -> set[int]:
        """The templates in ``found`` whose threshold is not met by the words of one there that shares more, or as many and a larger part."""
        return {
            t
            for t, shared, share in found
            if not any((more, part) > (shared, share) and len(self.members[t] & self.members[u]) >= self.need[t] for u, more, part in found)
        }

    def meet(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, shared words, containment) of the templates that a block meets."""
        order = self.order
        block = sorted({order[w] for w in words if w in order})
        candidates = set()
        for j, w in enumerate(block):
            for t, i in self.prefix.get(w, ()):
                left = min(len(self.sets[t]) - i, len(block) - j)
                if len(block) >= self.need[t] and left >= self.need[t]:
                    candidates.add(t)
        found = []
        for t in sorted(candidates):
            shared = len(self.members[t].intersection(block))
            if shared >= self.need[t]:
                found.append((t, shared, shared / len(self.sets[t])))
        return found


def word_counts(docs: DataFrame, templates: tuple[tuple[str, str], ...]) -> dict[bytes, int]:
    """In how many blocks of the whole corpus each of the templates' words stands."""
    vocabulary = frozenset(chain.from_iterable(split_words(text.encode()) for _, text in templates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    for _, words in text_blocks(text):
                        for w in vocabulary.intersection(words):
                            total[w] = total.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("text").cast("binary")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # At most one row per word of the templates.
    return {bytes(r["word"]): r["n"] for r in rows.collect()}


SCAN_TYPE = (
    "struct<n_words:long,places:array<struct<word:long,label:string>>,"
    "blocks:array<struct<first_word:long,words:int,shared:int,template:int,label:string,containment:double,best:boolean>>,"
    "windows:array<struct<first_word:long,words:int,shared:int,template:int,label:string,containment:double,kept:boolean>>>"
)


def scan(text: Column, templates: Templates) -> Column:
    """n_words, the places of phrases, and the line blocks and windows that meet templates (one row per block and template)."""

    @F.pandas_udf(SCAN_TYPE)
    def read(texts: pd.Series) -> pd.DataFrame:
        out = {"n_words": [], "places": [], "blocks": [], "windows": []}
        for value in texts:
            value = value or b""
            words = split_words(value)
            blocks, windows = [], []
            if not templates.seeds.isdisjoint(words):
                for first, block in text_blocks(value):
                    found = templates.meet(block)
                    top = max((f[1:] for f in found), default=None)
                    for t, shared, share in found:
                        blocks.append({"first_word": first, "words": len(block), "shared": shared, "template": t, "label": templates.labels[t], "containment": share, "best": (shared, share) == top})
                for first, block in text_windows(value):
                    found = templates.meet(block)
                    kept = templates.unexplained(found)
                    for t, shared, share in found:
                        windows.append({"first_word": first, "words": len(block), "shared": shared, "template": t, "label": templates.labels[t], "containment": share, "kept": t in kept})
            places = phrase_places(words, b" " + b" ".join(words) + b" ") if b"license" in value.lower() else []
            out["n_words"].append(len(words))
            out["places"].append([{"word": w, "label": label} for w, label in places])
            out["blocks"].append(blocks)
            out["windows"].append(windows)
        return pd.DataFrame(out).astype({"n_words": np.int64})

    return read.asNondeterministic()(text.cast("binary"))


def _scanned(docs: DataFrame, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    known = Templates(templates, word_counts(docs, templates), threshold)
    return docs.select("doc_id", scan(F.col("text"), known).alias("s")).select("doc_id", "s.*")


def license_blocks(docs: DataFrame, *, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, first_word, words, shared, template, label, containment of every line block and template that meet the threshold.

    Null and empty texts have no blocks; repeated rows give repeated results.  A text costs time
    and memory in proportion to its words and its notices.
    """
    return _scanned(docs, templates, threshold).select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*").drop("best")


def license_windows(docs: DataFrame, *, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``license_blocks`` and ``kept`` of every window over several lines and template that meet the threshold.

    A window is not kept for a template that the words of a better one explain.
    """
    return _scanned(docs, templates, threshold).select("doc_id", F.explode("windows").alias("b")).select("doc_id", "b.*")


def scan_documents(docs: DataFrame, *, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    A line block's labels are those of the templates it shares most words with, and of these
    contains most of; a window over several lines has those of all templates that no better one
    explains.  The score is the largest containment found; a phrase counts as contained in full.
    """
    rows = _scanned(docs, templates, threshold)
    best = F.filter("blocks", lambda b: b["best"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    wrapped = F.filter("windows", lambda b: b["kept"])
    added = F.array_distinct(F.concat(F.transform(best, lambda b: b["label"]), F.transform(wrapped, lambda b: b["label"])))
    starts = F.transform("places", lambda p: p["word"])
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, added)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0)
        .otherwise(F.coalesce(F.greatest(*[F.array_max(F.transform(c, lambda b: b["containment"])) for c in ("blocks", "windows")]), F.lit(0.0)))
        .alias("score"),
    )
