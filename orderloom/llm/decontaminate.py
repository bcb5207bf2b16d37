"""Benchmark decontamination by word-pair anchors and Smith-Waterman alignment.

An alignment of m matched words and e edits scores 2m - e.  If that is ``threshold`` of the
best score 2n of an item of n words, at most m - threshold * n of the steps from one matched
word to the next hold two edits or more, so ``threshold * n - 1`` steps at least hold one or
none: two item words at distance 1 or 2 stand in the document at distance 1 or 2.  An item
is anchored by the words that start such pairs, without the commonest ones as long as each
alignment keeps half of its pairs as anchors.  Passages with too few pairs for the threshold
are left out, all others aligned in full, so every copy that meets the threshold is found,
with words changed, left out or put in anywhere.

The test items are the stated query set: they meet the documents in blocks of at most
``BLOCK_WORDS`` words, so what a task holds of them is bounded.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Words of an item at least.
SEED_WORDS = 3
#: Words of test items that a pass over the documents takes.
BLOCK_WORDS = 500_000
#: Alignment score of a pair from which the document is contaminated: the share of the best possible score of the item.
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1

WORD = re.compile(r"\w+")


def split_words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Items:
    """A block of test items as word numbers, and the keys of their word pairs."""

    def __init__(self, items: list[tuple[int, str]]):
        words = [split_words(text) for _, text in items]
        numbers: dict[str, int] = {}
        for word in chain.from_iterable(words):
            numbers.setdefault(word, len(numbers))
        self.numbers = numbers
        self.ids = [item for item, _ in items]
        self.words = [np.array([numbers[w] for w in ws], dtype=np.int64) for ws in words]
        pairs = [self.pairs(ws) for ws in self.words]
        keys = np.unique(np.concatenate([x for pair in pairs for x in pair] or [np.empty(0, dtype=np.int64)]))
        self.pair_keys = keys[keys >= 0]
        #: For each item the indexes in ``pair_keys`` of the pairs that start at each of its words, at distance 1 and 2; the last index is no pair.
        self.starts = [tuple(self.index(x) for x in pair) for pair in pairs]

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key in ``pair_keys``, or their number if it is not there."""
        if not len(self.pair_keys):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, at, len(self.pair_keys))

    def pairs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact keys of each word with the next and with the one after it; negative where there is none or a word is no item's."""
        size = len(self.numbers)
        keys = []
        for apart in (1, 2):
            key = np.full(len(numbers), -1, dtype=np.int64)
            one, other = numbers[:-apart], numbers[apart:]
            key[:-apart] = np.where((one >= 0) & (other >= 0), one * size + other, -1)
            keys.append(key)
        return keys[0], keys[1]

    def number(self, words: list[str]) -> np.ndarray:
        get = self.numbers.get
        return np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score of ``item`` in ``passage``, and the place of the first and last aligned word.

    A row's gaps along the passage are a running maximum, so each item word is one pass over
    the row.  Ties go to the first end.
    """
    n = len(passage)
    steps = np.arange(1, n + 1) * -GAP
    score, start = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    best, best_start, best_end = 0, 0, 0
    columns = np.arange(1, n + 1)
    for word in item:
        diagonal = score[:-1] + np.where(passage == word, MATCH, MISMATCH)
        above = score[1:] + GAP
        cell = np.maximum(diagonal, above)
        origin = np.where(diagonal >= above, start[:-1], start[1:])
        fresh = cell <= 0
        cell[fresh] = 0
        origin = np.where(fresh, columns, origin)
        lifted = cell + steps
        run = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == run, np.arange(n), -1))
        row = run - steps
        origin = np.where(row > 0, origin[at], columns)
        score = np.concatenate([[0], np.maximum(row, 0)])
        start = np.concatenate([[0], origin])
        top = int(score.argmax())
        if score[top] > best:
            best, best_start, best_end = int(score[top]), int(start[top]), top - 1
    return best, best_start, best_end


class Anchors:
    """The anchors of a block of items at a threshold, by pair."""

    def __init__(self, items: Items, threshold: float):
        self.items, self.threshold = items, threshold
        none = len(items.pair_keys)
        held = np.concatenate([x for pair in items.starts for x in pair] or [np.empty(0, dtype=np.int64)])
        common = np.bincount(held, minlength=none + 1)
        common[none] = 0
        #: Pairs that an alignment at the threshold holds at least; below 1, one matched word makes an alignment.
        self.need = [math.ceil(threshold * len(ws) - 1 - 1e-9) for ws in items.words]
        #: Of these, pairs at least that are anchors.
        self.least = np.array([max(1, n // 2) for n in self.need], dtype=np.int64)
        self.slack = [max(0, math.floor(2 * len(ws) * (1 - threshold) + 1e-9)) for ws in items.words]
        key, owner, offset = [], [], []
        self.lone: list[int] = []
        for i, (near, far) in enumerate(items.starts):
            if self.need[i] < 1:
                self.lone.append(i)
                continue
            # The last word starts no pair.
            weight = (common[near] + common[far])[:-1]
            chosen = np.argsort(weight, kind="stable")[: len(weight) - self.need[i] + int(self.least[i])]
            for pair in (near, far):
                at = chosen[pair[chosen] < none]
                key.append(pair[at])
                owner.append(np.full(len(at), i))
                offset.append(at)
        key, owner, offset = (np.concatenate(x or [np.empty(0, dtype=np.int64)]).astype(np.int64) for x in (key, owner, offset))
        order = np.argsort(key, kind="stable")
        self.owner, self.offset = owner[order], offset[order]
        #: Numbers the starts of all items.
        self.start = np.cumsum([0, *map(len, items.words)])[self.owner] + self.offset
        #: Anchors ``first[k]`` to ``first[k + 1]`` are those of pair k.
        self.first = np.searchsorted(key[order], np.arange(none + 1))

    def matches(self, words: np.ndarray) -> list[tuple]:
        """(item, score, first word, last word) of each item aligned to a document's word numbers."""
        items, none = self.items, len(self.items.pair_keys)
        best: dict = {}

        def settle(i: int, low: int, high: int) -> None:
            length = len(items.words[i])
            score, start, end = align(items.words[i], words[low:high])
            share = score / (MATCH * length)
            if score and score >= self.threshold * MATCH * length and (items.ids[i] not in best or share > best[items.ids[i]][1]):
                best[items.ids[i]] = (items.ids[i], share, low + start, low + end)

        for i in self.lone:
            settle(i, 0, len(words))
        if len(words) > 1 and none:
            near, far = (items.index(x) for x in items.pairs(words))
            place = np.concatenate([(near < none).nonzero()[0], (far < none).nonzero()[0]])
            pair = np.concatenate([near[near < none], far[far < none]])
            for i, low, high in self.passages(place, pair, len(words)):
                settle(i, low, high)
        return [best[k] for k in sorted(best)]

    def passages(self, place: np.ndarray, pair: np.ndarray, n_words: int) -> Iterator[tuple[int, int, int]]:
        """(item, first word, word after the last) of the passages that can hold an alignment, of the pairs at ``place``."""
        n = self.first[pair + 1] - self.first[pair]
        rows = np.repeat(self.first[pair] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, begin = self.owner[rows], np.repeat(place, n) - self.offset[rows]
        _, once = np.unique(self.start[rows], return_index=True)
        enough = (np.bincount(item[once], minlength=len(self.least)) >= self.least)[item]
        item, begin = item[enough], begin[enough]
        order = np.lexsort((begin, item))
        item, begin = item[order], begin[order]
        order = np.argsort(place, kind="stable")
        place, pair = place[order], pair[order]
        cuts = [0, *((item[1:] != item[:-1]).nonzero()[0] + 1).tolist(), len(item)] if len(item) else [0]
        own = np.zeros(len(self.items.pair_keys) + 1, dtype=bool)
        for a, b in zip(cuts[:-1], cuts[1:]):
            i = int(item[a])
            near, far = self.items.starts[i]
            length, slack, need = len(self.items.words[i]), self.slack[i], self.need[i]
            own[near] = own[far] = True
            own[-1] = False
            mine = own[pair]
            own[near] = own[far] = False
            at, held = place[mine], pair[mine]
            starts = at[np.concatenate([[True], at[1:] != at[:-1]])]
            low, high = begin[a:b] - slack, begin[a:b] + length + slack
            full = np.searchsorted(starts, high) - np.searchsorted(starts, low) >= need
            low, high = low[full], high[full]
            k = 0
            while k < len(low):
                # Anchors of one item that lie close are one passage.
                j = k + 1
                while j < len(low) and low[j] - low[j - 1] <= slack:
                    j += 1
                x, y = np.searchsorted(at, [low[k], high[j - 1]])
                own[held[x:y]] = True
                found = int((own[near] | own[far]).sum())
                own[held[x:y]] = False
                if found >= need:
                    yield i, max(0, int(low[k])), min(n_words, int(high[j - 1]))
                k = j


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The test items with enough words, streamed to the driver in blocks of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null").distinct()
    block: list[tuple[int, str]] = []
    words = 0
    for item, text in rows.orderBy("item_id", "text").toLocalIterator():
        n = len(split_words(text))
        if n < SEED_WORDS:
            continue
        if block and words + n > BLOCK_WORDS:
            yield block
            block, words = [], 0
        block.append((item, text))
        words += n
    if block:
        yield block


def _matcher(anchors: Anchors):
    @F.pandas_udf("array<struct<item_id:long,score:double,first_word:int,last_word:int>>")
    def match(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            words = anchors.items.number(split_words(text))
            out.append([
                {"item_id": int(i), "score": float(s), "first_word": int(a), "last_word": int(b)}
                for i, s, a, b in anchors.matches(words)
            ])
        return pd.Series(out)

    return match.asNondeterministic()


def contamination(benchmark: DataFrame, *, text: str = "text", threshold: float = THRESHOLD) -> Iterator[Column]:
    """For one block of test items after the other an array column of the items found in ``text``: item_id, score, first_word, last_word.

    The score is the alignment's share of the best possible, best place per item.  Null and
    empty texts have none; items that are null or shorter than a seed are found nowhere; an
    item_id with several texts is found by any of them.  Callers that settle what a block gives
    before they ask for the next hold one block on the driver and in the tasks.
    """
    for block in _blocks(benchmark):
        yield _matcher(Anchors(Items(block), threshold))(F.col(text))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word of every document and test item that align to ``threshold``."""
    pairs = last = None
    for found in contamination(benchmark, threshold=threshold):
        if last is not None:
            pairs = settle(last) if pairs is None else settle(pairs.union(last))
        last = docs.select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.*")
    if last is None:
        return docs.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("score", "double"), ("first_word", "int"), ("last_word", "int"))]).limit(0)
    return last if pairs is None else pairs.union(last)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The documents in which no test item is found."""
    kept, more = docs, False
    for found in contamination(benchmark, threshold=threshold):
        kept = (settle(kept) if more else kept).filter(F.size(found) == 0)
        more = True
    return kept
