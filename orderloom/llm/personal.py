"""Personal data by patterns and a semi-Markov conditional random field.

Patterns find the base spans.  The random field scores whole candidate segments: features
of a span's shape, digits, check digit, separators and neighbours, with weights per type.
A dynamic program over the tokens around digits and "@" chooses boundaries and types
together; an entity has at most ``MOST_TOKENS`` tokens.  It is trained by maximum
likelihood on the base spans of a bounded sample of texts; stretches that look like a base
span but fail its check are left out there, since they may or may not be one.  Its own
finds are the spans of that look which the patterns' checks drop, such as card numbers with a
wrong digit; they are named ``card_like`` and so on, and never replace a base span.

A long text costs time in proportion to its characters; of its longest stretch the program
keeps about a hundred bytes a token.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

KINDS = ("email", "ip", "card", "phone")
#: Texts with digits or "@" that the training reads at most, and stretches it takes of them.
SAMPLE_TEXTS = 2_000
SAMPLE_STRETCHES = 1_000
MOST_TOKENS = 16
#: Spans' signatures whose scores a worker remembers.
MOST_KNOWN = 100_000
SLOTS = 1 << 12
EPOCHS = 6

#: The base patterns.  A run of digits is only tried from its start; later starts cannot match where it does not.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]")
SPACE = re.compile(r"\s")
TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|\S")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _check_sums(digits: str) -> tuple[int, int]:
    """Luhn sums of a run of digits: with its last digit single, and with it doubled."""
    once = sum(map(int, digits))
    twice = [sum(2 * n - 9 * (n > 4) - n for n in map(int, digits[start::-2])) for start in (len(digits) - 2, len(digits) - 1)]
    return once + (twice[0] if len(digits) > 1 else 0), once + twice[1]


def only_digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of EMAIL: each "@" is tried from the first character that can lead to it."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL_PART:
            begin -= 1
        match = EMAIL.match(text, begin) if begin < at else None
        if match:
            end = match.end()
            found.append((begin, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Spans the patterns find, by start and kind; and the matches dropped because their check fails."""
    spans: list[tuple[int, int, int]] = [(a, b, 0) for a, b in emails(text)]
    dropped = []

    def take(match: re.Match, kind: int, good: bool) -> None:
        if good:
            spans.append((match.start(), match.end(), kind))
        else:
            dropped.append(match.span())

    if DIGIT.search(text):
        for m in IP.finditer(text):
            take(m, 1, all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")))
        for m in CARD.finditer(text):
            digits = only_digits(m[0])
            if 14 <= len(digits) <= 19:
                take(m, 2, luhn(digits))
        if "+" in text:
            for m in PHONE.finditer(text):
                take(m, 3, 10 <= len(only_digits(m[0])) <= 15)
    spans.sort(key=lambda s: (s[0], s[2]))
    return [(a, b, KINDS[k]) for a, b, k in spans], dropped


def stretches(text: str) -> list[tuple[int, int]]:
    """Runs of neighbouring words that have a digit or "@", or are brackets of digits around a "+"."""
    found: list[list[int]] = []
    at = 0
    while match := TRIGGER.search(text, at):
        begin = match.start()
        while begin > at and not text[begin - 1].isspace():
            begin -= 1
        gap = SPACE.search(text, match.end())
        end = gap.start() if gap else len(text)
        if found and begin - found[-1][1] <= 1:
            found[-1][1] = end
        else:
            found.append([begin, end])
        at = end
    return [(a, b) for a, b in found]


def _bucket(n: int) -> int:
    return n if n <= 20 else 20 + n.bit_length()


def _side(char: str) -> str:
    return "space" if not char or char.isspace() else "word" if char.isalnum() else char


def signature_slots(signature: tuple) -> np.ndarray:
    """Slots of the features of a span."""
    shape, runs, digits, size, quad, checked, left, right = signature
    names = [
        "shape" + shape,
        f"first{shape[0]}last{shape[-1]}",
        f"digits{_bucket(digits)}",
        f"runs{list(runs)}",
        f"tokens{_bucket(size)}",
        f"at{shape.count('@')}dots{min(shape.count('.'), 5)}",
        f"plus{shape[0] == '+'}{_bucket(digits)}",
        f"quad{quad}",
        f"luhn{checked}",
        f"card{digits}{set(shape) <= {'9', '_', '-'}}",
        f"left{left}",
        f"right{right}",
        "any",
    ]
    return np.array([zlib.crc32(n.encode()) % SLOTS for n in names])


class Streamed:
    """A stretch as tokens; its candidate spans are read one last token at a time."""

    def __init__(self, text: str, begin: int, end: int):
        self.text, self.tokens = text, [m.span() for m in TOKEN.finditer(text, begin, end)]
        #: Check sum of each run of digits, if an even or an odd number of digits follow it.
        self.sums = [_check_sums(text[a:b]) if "0" <= text[a] <= "9" else (0, 0) for a, b in self.tokens]

    def ending(self, j: int) -> Iterator[tuple[int, tuple]]:
        """(first token, signature) of the spans that end at token j, shortest first; the signature has all that the features ask for.

        Digits and check sums are carried from span to span, so a span costs one token.
        """
        text, tokens = self.text, self.tokens
        end = tokens[j][1]
        right = _side(text[end : end + 1])
        shape, runs, digits, total, card = "", (), 0, 0, True
        for i in range(j, max(-1, j - MOST_TOKENS), -1):
            a, b = tokens[i]
            first = text[a]
            if i < j and b < tokens[i + 1][0]:
                shape = "_" + shape
                card = card and text[b : tokens[i + 1][0]].strip(" ") == ""
            if "0" <= first <= "9":
                shape = "9" + shape
                runs = (b - a, *runs[:5])
                total += self.sums[i][digits % 2]
                digits += b - a
            else:
                shape = ("a" if first.isalpha() else first) + shape
                card = card and first == "-" and b - a == 1
            quad = shape == "9.9.9.9" and all(y - x <= 3 and int(text[x:y]) <= 255 for x, y in (tokens[k] for k in (i, i + 2, i + 4, i + 6)))
            checked = card and digits >= 12 and total % 10 == 0
            yield i, (shape, runs, digits, j - i + 1, quad, checked, _side(text[a - 1 : a] if a else ""), right)

    def spans(self, j: int, field: "Field") -> tuple[list[int], list[np.ndarray]]:
        """First tokens, in order, and scores of the spans that end at token j."""
        read = list(self.ending(j))[::-1]
        return [i for i, _ in read], [field.score(signature) for _, signature in read]

    def gold(self, spans: list[Span]) -> list[tuple[int, int, int]] | None:
        """Token spans (first, last, kind) of ``spans``; None if one does not fit the tokens or they overlap."""
        first = {a: k for k, (a, _) in enumerate(self.tokens)}
        last = {b: k for k, (_, b) in enumerate(self.tokens)}
        out = []
        for a, b, kind in spans:
            if a not in first or b not in last or last[b] - first[a] >= MOST_TOKENS:
                return None
            out.append((first[a], last[b], KINDS.index(kind)))
        out.sort()
        return None if any(y[0] <= x[1] for x, y in pairwise(out)) else out


class Stretch(Streamed):
    """A stretch with the features of all its candidate spans, as the training asks for them."""

    def __init__(self, text: str, begin: int, end: int):
        super().__init__(text, begin, end)
        self.starts, self.ends, slots = [], [], []
        for j in range(len(self.tokens)):
            for i, signature in reversed(list(self.ending(j))):
                self.starts.append(i)
                self.ends.append(j)
                slots.append(signature_slots(signature))
        self.slots = np.array(slots).reshape(len(slots), -1)

    def spans(self, j: int, field: "Field") -> tuple[list[int], list[np.ndarray]]:
        here = [s for s, end in enumerate(self.ends) if end == j]
        return [self.starts[s] for s in here], [field.weights[:, self.slots[s]].sum(axis=1) for s in here]


class Field:
    """Weights of the random field: per kind and feature slot, and for each pair of neighbouring segments' labels.

    Label 0 is a single token that is no entity; label k + 1 is kind k.
    """

    def __init__(self):
        self.weights = np.zeros((len(KINDS), SLOTS))
        #: Scores of the spans' signatures met so far, once the weights are fixed.
        self.known: dict[tuple, np.ndarray] = {}
        self.follows = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def scores(self, stretch: Stretch) -> np.ndarray:
        """(span, kind) scores; a token that is no entity scores 0."""
        return self.weights[:, stretch.slots].sum(axis=2).T if len(stretch.slots) else np.zeros((0, len(KINDS)))

    def score(self, signature: tuple) -> np.ndarray:
        """Score of each kind for a span, once the weights are fixed."""
        score = self.known.get(signature)
        if score is None:
            if len(self.known) >= MOST_KNOWN:
                self.known.clear()
            score = self.known[signature] = self.weights[:, signature_slots(signature)].sum(axis=1)
        return score

    def best(self, stretch: Streamed) -> list[tuple[int, int, int]]:
        """The most likely segmentation's entities: (first token, last token, kind).

        Spans are read as the program reaches their last token; a token leaves its scores and
        where they came from, however long the stretch.
        """
        n, labels = len(stretch.tokens), len(KINDS) + 1
        best = np.full((n + 1, labels), -np.inf)
        best[0, 0] = 0.0
        came_from, came_label = np.zeros((n + 1, labels), dtype=np.int32), np.zeros((n + 1, labels), dtype=np.int8)
        follows = self.follows[:, 1:]
        kinds = np.arange(labels - 1)
        for j in range(n):
            prior = best[j] + self.follows[:, 0]
            p = int(prior.argmax())
            best[j + 1, 0] = prior[p]
            came_from[j + 1, 0], came_label[j + 1, 0] = j, p
            starts, scores = stretch.spans(j, self)
            value = best[starts[0] : j + 1, :, None] + follows + np.array(scores)[:, None, :]
            over = value.max(axis=1)
            first = over.argmax(axis=0)
            best[j + 1, 1:] = over[first, kinds]
            came_from[j + 1, 1:], came_label[j + 1, 1:] = starts[0] + first, value.argmax(axis=1)[first, kinds]
        out, j, label = [], n, int(best[n].argmax())
        while j:
            i, p = int(came_from[j, label]), int(came_label[j, label])
            if label:
                out.append((i, j - 1, label - 1))
            j, label = i, p
        return out[::-1]

    def likelihood(self, stretch: Stretch, gold: list[tuple[int, int, int]]) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of ``gold`` and its gradients by (span, kind) score and by ``follows``."""
        n, labels = len(stretch.tokens), len(KINDS) + 1
        spans = self.scores(stretch)
        ending: list[list[int]] = [[] for _ in range(n)]
        beginning: list[list[int]] = [[] for _ in range(n)]
        for s, (i, j) in enumerate(zip(stretch.starts, stretch.ends)):
            ending[j].append(s)
            beginning[i].append(s)
        forward = np.full((n + 1, labels), -np.inf)
        forward[0, 0] = 0.0
        backward = np.full((n + 1, labels), -np.inf)
        backward[n] = 0.0
        lse = np.logaddexp.reduce
        for j in range(n):
            forward[j + 1, 0] = lse(forward[j] + self.follows[:, 0])
            own = np.array([lse(forward[stretch.starts[s]][:, None] + self.follows[:, 1:], axis=0) + spans[s] for s in ending[j]])
            forward[j + 1, 1:] = lse(own, axis=0)
        for i in range(n - 1, -1, -1):
            options = [self.follows[:, 0] + backward[i + 1, 0]]
            for s in beginning[i]:
                options.append(lse(self.follows[:, 1:] + (spans[s] + backward[stretch.ends[s] + 1, 1:])[None, :], axis=1))
            backward[i] = lse(np.array(options), axis=0)
        total = lse(forward[n])
        d_spans, d_follows = np.zeros_like(spans), np.zeros_like(self.follows)
        for i in range(n):
            d_follows[:, 0] -= np.exp(forward[i] + self.follows[:, 0] + backward[i + 1, 0] - total)
        for s, (i, j) in enumerate(zip(stretch.starts, stretch.ends)):
            share = np.exp(forward[i][:, None] + self.follows[:, 1:] + (spans[s] + backward[j + 1, 1:])[None, :] - total)
            d_spans[s] -= share.sum(axis=0)
            d_follows[:, 1:] -= share
        index = {(i, j): s for s, (i, j) in enumerate(zip(stretch.starts, stretch.ends))}
        value, at, label = 0.0, 0, 0
        for i, j, kind in [*gold, (n, n, -1)]:
            while at < i:
                value += self.follows[label, 0]
                d_follows[label, 0] += 1
                at, label = at + 1, 0
            if kind >= 0:
                s = index[i, j]
                value += self.follows[label, kind + 1] + spans[s, kind]
                d_spans[s, kind] += 1
                d_follows[label, kind + 1] += 1
                at, label = j + 1, kind + 1
        return value - total, d_spans, d_follows


def train(texts: list[str], seed: int = 0) -> Field:
    """A field fitted by adaptive gradient ascent to the base spans of ``texts``.

    A label that no sampled span has is never chosen.
    """
    examples = []
    for text in texts:
        spans, dropped = base_spans(text)
        for begin, end in stretches(text):
            if any(a < end and b > begin for a, b in dropped):
                continue
            stretch = Streamed(text, begin, end)
            gold = stretch.gold([s for s in spans if s[0] < end and s[1] > begin])
            if gold is not None and len(stretch.tokens) <= 60:
                examples.append((stretch, gold))
    rng = np.random.default_rng(seed)
    chosen = []
    for k in rng.permutation(len(examples))[:SAMPLE_STRETCHES]:
        stretch, gold = examples[k]
        chosen.append((Stretch(stretch.text, stretch.tokens[0][0], stretch.tokens[-1][1]), gold))
    field = Field()
    seen = {kind for _, gold in chosen for _, _, kind in gold}
    squares = np.full(field.weights.shape, 1e-6)
    squares_f = np.full(field.follows.shape, 1e-6)
    any_slot = zlib.crc32(b"any") % SLOTS
    field.weights[:, any_slot] = -4.0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(chosen)):
            stretch, gold = chosen[k]
            _, d_spans, d_follows = field.likelihood(stretch, gold)
            for kind in seen:
                rows = np.flatnonzero(np.abs(d_spans[:, kind]) > 1e-4)
                if len(rows):
                    slots = stretch.slots[rows].ravel()
                    g = np.bincount(slots, np.repeat(d_spans[rows, kind], stretch.slots.shape[1]), SLOTS)
                    some = np.flatnonzero(g)
                    squares[kind, some] += g[some] ** 2
                    field.weights[kind, some] += 0.2 * g[some] / np.sqrt(squares[kind, some])
            squares_f += d_follows**2
            field.follows += 0.1 * d_follows / np.sqrt(squares_f)
    for kind in set(range(len(KINDS))) - seen:
        field.weights[kind, any_slot] = -1e6
    return field


def find(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, spans the field adds) of a whole text; starts and ends in code points."""
    base, _ = base_spans(text)
    more = []
    for begin, end in stretches(text):
        near = [s for s in base if s[0] < end and s[1] > begin]
        # A stretch that is one base span has no room for more.
        if len(near) == 1 and near[0][0] <= begin and near[0][1] >= end:
            continue
        stretch = Streamed(text, begin, end)
        for i, j, kind in field.best(stretch):
            a, b = stretch.tokens[i][0], stretch.tokens[j][1]
            if not any(s[0] < b and s[1] > a for s in near):
                more.append((a, b, f"{KINDS[kind]}_like"))
    return base, more


def spans_text(spans: list[Span]) -> str:
    order = {k: n for n, k in enumerate([*KINDS, *(f"{k}_like" for k in KINDS)])}
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def fit(docs: DataFrame, *, texts: int = SAMPLE_TEXTS, seed: int = 0) -> Field:
    """Trains on up to ``texts`` texts with a digit or "@", those of smallest hash."""
    rows = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]"))
    return train([r["text"] for r in hash_sample(rows, texts, "doc_id", "text", seed=seed).collect()], seed)


def tag(text: Column, field: Field) -> Column:
    """base and added: arrays of start, end, kind of the spans in ``text``."""
    span = "array<struct<start:int,end:int,kind:string>>"

    @F.pandas_udf(f"struct<base:{span},added:{span},base_text:string,spans_text:string>")
    def read(texts: pd.Series) -> pd.DataFrame:
        out = []
        for value in texts:
            base, more = find(value or "", field)
            rows = [[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in (base, more)]
            out.append((*rows, spans_text(base), spans_text(base + more)))
        return pd.DataFrame(out, columns=["base", "added", "base_text", "spans_text"])

    return read.asNondeterministic()(text)


def tagged_spans(docs: DataFrame, **options) -> DataFrame:
    """doc_id, start, end, kind, found of every span; found is its text.  Null and empty texts have none."""
    rows = docs.select("doc_id", "text", tag(F.col("text"), fit(docs, **options)).alias("t"))
    each = rows.select("doc_id", "text", F.explode(F.concat("t.base", "t.added")).alias("s"))
    return each.select("doc_id", "s.*", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("found"))


def tag_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row; repeated rows are tagged alike."""
    rows = docs.select("doc_id", tag(F.col("text"), fit(docs, **options)).alias("t"))

    def count(kind: str) -> Column:
        return F.size(F.filter("t.base", lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, KINDS), F.sha2("t.base_text", 256).alias("base_sha256"), F.col("t.spans_text").alias("spans"))


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(spans_text(spans).encode()).hexdigest()
