"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters the network twice: by its own weight of evidence, and by those of the
character n-grams it is made of, so inflected and unseen forms of a known stem count.
A forward and a backward gated recurrent layer read windows of words, attention pools a
window's states, and a text's score is that of its worst window.  All windows of the whole
text are scored; neighbouring windows overlap by ``WINDOW - STRIDE`` words.

The network is trained in numpy by one task on a bounded sample of labelled texts: up to
``SAMPLE_PER_CLASS`` of the two classes, those of smallest hash.  Weights of evidence are
cross-fitted while it trains, so it learns how far to trust them on new texts.
"""

from __future__ import annotations

import io
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, settle

WINDOW = 64
STRIDE = 48
HIDDEN = 8
#: Labelled texts that the training takes at most: clean ones, toxic ones.
SAMPLE_PER_CLASS = (2_500, 1_500)
#: UTF-8 bytes of a text that the training takes at most; longer ones are scored but not learned from.
SAMPLE_BYTES = 1 << 18
#: Lengths in bytes of the character n-grams, with "<" and ">" around the word.
GRAMS = (3, 4, 5, 6)
SLOTS = 1 << 18
FEATURES = 6
EPOCHS = 5
BATCH = 128
#: Steps of an epoch at least: a small sample is gone through again.
LEAST_STEPS = 60
#: Texts are scored in runs of about so many words.
RUN_WORDS = 100_000
CACHE_WORDS = 200_000

WORD = re.compile(r"\w+")


def split_words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_slots(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words), dtype=np.int64, count=len(words)) % SLOTS


def gram_slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, slot) of every character n-gram of the words, by word; each word has at least one."""
    buffer = np.frombuffer(b"<" + b"><".join(words) + b">", dtype=np.uint8).astype(np.uint64)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words)), length)
    end = np.repeat(np.cumsum(length), length)
    at = np.arange(len(buffer))
    owners, slots = [], []
    rolling = np.zeros(len(buffer), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            shifted = np.zeros(len(buffer), dtype=np.uint64)
            rest = buffer[n - 1 :]
            shifted[: len(rest)] = rest
            rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(1)
            if n in GRAMS:
                inside = at + n <= end
                owners.append(owner[inside])
                slots.append((((rolling[inside] ^ (rolling[inside] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 18)).astype(np.int64))
    owners, slots = np.concatenate(owners), np.concatenate(slots)
    order = np.argsort(owners, kind="stable")
    return owners[order], slots[order]


@dataclass
class Evidence:
    """Weights of evidence: log odds of standing in a toxic text, of words and of character n-grams."""

    words: np.ndarray
    grams: np.ndarray

    @classmethod
    def of(cls, texts: list[list[str]], toxic: np.ndarray) -> "Evidence":
        seen = np.zeros((2, 2, SLOTS))
        for words, label in zip(texts, toxic):
            if words:
                some = [w.encode() for w in dict.fromkeys(words)]
                seen[0, label, np.unique(word_slots(some))] += 1
                seen[1, label, np.unique(gram_slots(some)[1])] += 1
        total = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
        odds = np.log((seen[:, 1] + 1) / (total[1] + 2)) - np.log((seen[:, 0] + 1) / (total[0] + 2))
        # Slots in no text say nothing.
        odds = np.where(seen.sum(axis=1) > 0, odds, 0.0).astype(np.float32)
        return cls(odds[0], odds[1])

    def features(self, words: list[str]) -> np.ndarray:
        """One row of network inputs per word."""
        coded = [w.encode() for w in words]
        owner, slot = gram_slots(coded)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        value = self.grams[slot]
        n = np.diff(np.r_[first, len(owner)]).astype(np.float32)
        top = np.maximum.reduceat(value, first)
        out = np.empty((len(words), FEATURES), dtype=np.float32)
        out[:, 0] = self.words[word_slots(coded)]
        out[:, 1] = top
        out[:, 2] = np.minimum.reduceat(value, first)
        out[:, 3] = np.add.reduceat(value, first) / n
        out[:, 4] = np.add.reduceat((value > 1.0).astype(np.float32), first) / n
        out[:, 5] = np.minimum(n / 30, 2)
        out[:, :4] /= 2
        return out


class Network:
    """The recurrent layers, attention and output; parameters are float32 arrays by name."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {}
        for side in "fb":
            self.p[f"W{side}"] = rng.normal(0, 0.4, (FEATURES, 3 * HIDDEN))
            self.p[f"U{side}"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
            self.p[f"b{side}"] = np.zeros(3 * HIDDEN)
        self.p["attend"] = rng.normal(0, 0.3, 2 * HIDDEN)
        self.p["out"] = rng.normal(0, 0.3, 2 * HIDDEN)
        self.p["bias"] = np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def project(self, features: np.ndarray) -> np.ndarray:
        """Inputs of both layers' gates, side by side, for rows of features."""
        return np.concatenate([features @ self.p["Wf"] + self.p["bf"], features @ self.p["Wb"] + self.p["bb"]], axis=1)

    def _layer(self, inputs: np.ndarray, mask: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """States (time, window, HIDDEN) of one direction from gate inputs (time, window, 3 HIDDEN)."""
        U, H = self.p[f"U{side}"], HIDDEN
        steps = range(len(inputs)) if side == "f" else range(len(inputs) - 1, -1, -1)
        h = np.zeros((inputs.shape[1], H), dtype=inputs.dtype)
        states = np.empty((len(inputs), inputs.shape[1], H), dtype=inputs.dtype)
        for t in steps:
            g = h @ U
            gates = np.tanh((inputs[t, :, : 2 * H] + g[:, : 2 * H]) * 0.5) * 0.5 + 0.5
            z, r = gates[:, :H] * mask[t][:, None], gates[:, H:]
            c = np.tanh(inputs[t, :, 2 * H :] + r * g[:, 2 * H :])
            if keep is not None:
                keep.append((t, h, gates, z, r, c, g))
            h = h + z * (c - h)
            states[t] = h
        return states

    def forward(self, inputs: np.ndarray, mask: np.ndarray, caches: dict | None = None) -> np.ndarray:
        """Logit of each window; ``inputs`` (time, window, 6 HIDDEN), ``mask`` (time, window) is 1 at words."""
        H3 = 3 * HIDDEN
        keep = {"f": [], "b": []} if caches is not None else {"f": None, "b": None}
        states = np.concatenate(
            [self._layer(inputs[:, :, :H3], mask, "f", keep["f"]), self._layer(inputs[:, :, H3:], mask, "b", keep["b"])], axis=2
        )
        score = np.where(mask > 0, states @ self.p["attend"], np.float32(-1e9))
        share = np.exp(score - score.max(axis=0))
        share = share / share.sum(axis=0) * mask
        pooled = np.einsum("tn,tnh->nh", share, states)
        if caches is not None:
            caches.update(keep=keep, states=states, share=share, pooled=pooled)
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, features: np.ndarray, mask: np.ndarray, toxic: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy and its gradients, by backpropagation through time; ``features`` (time, window, FEATURES)."""
        T, N, _ = features.shape
        H = HIDDEN
        inputs = self.project(features.reshape(T * N, -1)).reshape(T, N, -1)
        c: dict = {}
        logit = self.forward(inputs, mask, c)
        p = 1 / (1 + np.exp(-logit))
        loss = float(np.mean(np.logaddexp(0, logit) - toxic * logit))
        d = (p - toxic) / N
        grads = {"out": c["pooled"].T @ d, "bias": np.array([d.sum()])}
        d_pooled = d[:, None] * self.p["out"][None]
        d_share = np.einsum("nh,tnh->tn", d_pooled, c["states"])
        d_score = c["share"] * (d_share - (c["share"] * d_share).sum(axis=0))
        grads["attend"] = np.einsum("tn,tnh->h", d_score, c["states"])
        d_states = c["share"][:, :, None] * d_pooled[None] + d_score[:, :, None] * self.p["attend"]
        for side, part in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            U = self.p[f"U{side}"]
            d_inputs, dU, d_next = np.zeros((T, N, 3 * H)), np.zeros_like(U, dtype=np.float64), np.zeros((N, H))
            for t, h, gates, z, r, cand, g in reversed(c["keep"][side]):
                dh = d_states[t][:, part] + d_next
                d_cand = dh * z * (1 - cand * cand)
                d_z = dh * (cand - h) * mask[t][:, None] * gates[:, :H] * (1 - gates[:, :H])
                d_r = d_cand * g[:, 2 * H :] * r * (1 - r)
                d_in = np.concatenate([d_z, d_r, d_cand], axis=1)
                d_g = np.concatenate([d_z, d_r, d_cand * r], axis=1)
                dU += h.T @ d_g
                d_next = dh * (1 - z) + d_g @ U.T
                d_inputs[t] = d_in
            grads[f"U{side}"] = dU
            flat = d_inputs.reshape(T * N, -1)
            grads[f"W{side}"] = features.reshape(T * N, -1).T @ flat
            grads[f"b{side}"] = flat.sum(axis=0)
        return loss, grads


def window_starts(n: int) -> list[int]:
    """First words of the windows of a text of ``n`` words; the last window ends with the text; no words: one empty window."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def windows(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose words lie end to end: (text, first word, words) of every window."""
    text, first, size, base = [], [], [], 0
    for i, n in enumerate(lengths):
        starts = window_starts(n)
        text += [i] * len(starts)
        first += [base + s for s in starts]
        size += [min(n, WINDOW)] * len(starts)
        base += n
    return np.array(text), np.array(first), np.array(size)


def window_logits(network: Network, rows: np.ndarray, numbers: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Logit of each window of words; ``rows``: gate inputs by word number, 0 is no word."""
    numbers = np.r_[numbers, np.zeros(WINDOW, dtype=numbers.dtype)]
    out = np.empty(len(first), dtype=np.float32)
    for a in range(0, len(first), 2_048):
        at, n = first[a : a + 2_048], size[a : a + 2_048]
        steps = np.arange(max(1, int(n.max())))[:, None]
        inside = steps < n
        out[a : a + 2_048] = network.forward(rows[numbers[at + steps] * inside], inside.astype(np.float32))
    return out


class Scorer:
    """A trained network with its evidence; scores lists of texts."""

    def __init__(self, evidence: Evidence | None, network: Network | None, shift: float):
        self.evidence, self.network, self.shift = evidence, network, shift
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1, 6 * HIDDEN), dtype=np.float32)

    def dump(self) -> bytes:
        arrays = {"shift": np.array(self.shift)}
        if self.network is not None:
            arrays |= {"words": self.evidence.words, "grams": self.evidence.grams, **{f"p_{k}": v for k, v in self.network.p.items()}}
        file = io.BytesIO()
        np.savez(file, **arrays)
        return file.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Scorer":
        held = np.load(io.BytesIO(data))
        if "words" not in held:
            return cls(None, None, float(held["shift"]))
        network = Network()
        network.p = {k[2:]: held[k] for k in held if k.startswith("p_")}
        return cls(Evidence(held["words"], held["grams"]), network, float(held["shift"]))

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known, self.rows = {}, self.rows[:1]
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, self.network.project(self.evidence.features(new))])
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int32, count=len(words))

    def logits(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(text, logit) of every window."""
        flat = [w for words in texts for w in words]
        text, first, size = windows([len(words) for words in texts])
        numbers = self._numbers(flat)
        return text, window_logits(self.network, self.rows, numbers, first, size)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability that each text is toxic, by its worst window."""
        if self.network is None:
            return np.full(len(texts), 1 / (1 + np.exp(-self.shift)))
        out, run, words = [], [], 0
        for k, text in enumerate(texts):
            run.append(split_words(text))
            words += len(run[-1])
            if words >= RUN_WORDS or k == len(texts) - 1:
                owner, logit = self.logits(run)
                worst = np.full(len(run), -np.inf)
                np.maximum.at(worst, owner, logit)
                out.append(1 / (1 + np.exp(-np.clip(worst + self.shift, -60, 60))))
                run, words = [], 0
        return np.concatenate(out) if out else np.empty(0)


def train(texts: list[list[str]], toxic: np.ndarray, toxic_share: float, seed: int = 0) -> Scorer:
    """A scorer from word lists and 0/1 labels; ``toxic_share`` is the share of toxic ones among all labelled texts.

    Without labels of both classes every text gets the share of toxic ones as its score.
    """
    toxic = np.asarray(toxic)
    share = min(max(toxic_share, 1e-4), 1 - 1e-4)
    if not len(toxic) or toxic.min() == toxic.max():
        return Scorer(None, None, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    evidence = Evidence.of(texts, toxic)
    # A text's inputs come from the evidence of the other half.
    half = np.zeros(len(texts), dtype=int)
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(toxic == label))
        half[own[: len(own) // 2]] = 1
    others = [Evidence.of([t for t, h in zip(texts, half) if h != k], toxic[half != k]) for k in (0, 1)]
    network = Network(seed)
    folds = []
    for k in (0, 1):
        mine = np.flatnonzero(half == k)
        if not len(mine):
            continue
        flat = [w for i in mine for w in texts[i]]
        number = {w: n for n, w in enumerate(dict.fromkeys(flat), 1)}
        features = np.zeros((len(number) + 1, FEATURES), dtype=np.float32)
        if number:
            features[1:] = others[k].features(list(number))
        numbers = np.fromiter(map(number.__getitem__, flat), dtype=np.int32, count=len(flat))
        folds.append((mine, features, numbers, windows([len(texts[i]) for i in mine])))
    moments = {k: (np.zeros(v.shape), np.zeros(v.shape)) for k, v in network.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        chosen, labels = [], []
        for mine, features, numbers, (owner, first, size) in folds:
            if epoch:
                value = window_logits(network, network.project(features), numbers, first, size)
            else:  # the window with the strongest evidence, before the network knows better
                strength = features[numbers][:, :2].max(axis=1, initial=-99)
                value = np.array([strength[a : a + n].max(initial=-99) for a, n in zip(first, size)])
            order = np.lexsort((-value, owner))
            best = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
            for w in best:
                row = np.zeros((WINDOW, FEATURES), dtype=np.float32)
                row[: size[w]] = features[numbers[first[w] : first[w] + size[w]]]
                chosen.append((row, size[w]))
                labels.append(toxic[mine[owner[w]]])
        labels = np.array(labels, dtype=np.float64)
        rounds = max(1, -(-LEAST_STEPS * BATCH // len(chosen)))
        order = np.concatenate([rng.permutation(len(chosen)) for _ in range(rounds)])
        rate = 0.02 if epoch < EPOCHS // 2 else 0.005
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            features = np.stack([chosen[i][0] for i in part], axis=1)
            mask = (np.arange(WINDOW)[:, None] < np.array([chosen[i][1] for i in part])).astype(np.float32)
            _, grads = network.gradients(features, mask, labels[part])
            step += 1
            for name, g in grads.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                network.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    sampled = toxic.mean()
    shift = np.log(share / (1 - share)) - np.log(sampled / (1 - sampled))
    return Scorer(evidence, network, float(shift))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, per_class: tuple[int, int] = SAMPLE_PER_CLASS, seed: int = 0) -> Scorer:
    """Trains on up to ``per_class`` labelled texts (clean, toxic), those of smallest hash.

    One task trains on the sample, which is at most that many texts of SAMPLE_BYTES; the driver
    gets the model.  Null ids and labels are left out; an id with several labels is toxic if one
    of them is, and one with several texts is learned from by the least of them.
    """
    marks = (
        labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    marks = settle(marks)
    counted = {int(k): n for k, n in marks.groupBy(F.least("toxic", F.lit(1)).alias("toxic")).count().collect()}
    sample = None
    for label in (0, 1):
        part = hash_sample(marks.filter(F.least("toxic", F.lit(1)) == label), per_class[label], "doc_id", seed=seed)
        sample = part if sample is None else sample.union(part)
    total = sum(counted.values())
    share = (counted.get(1, 0) + 0.5) / (total + 1)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        words = [split_words(text) for text in rows["text"]]
        return pd.DataFrame({"model": [train(words, (rows["toxic"] > 0).to_numpy(dtype=int), share, seed).dump()]})

    short = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    rows = short.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    model = rows.groupBy().applyInPandas(learn, "model binary").first()
    return Scorer.load(model["model"]) if model else train([], np.empty(0), share)


def toxicity(text: Column, scorer: Scorer) -> Column:
    """Score of ``text`` from 0 to 1; null and empty texts get that of a text without words."""
    scorer.known, scorer.rows = {}, scorer.rows[:1]

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer.scores(list(texts)), dtype="float64")

    return score.asNondeterministic()(text)


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; repeated rows get the same score."""
    scorer = fit(docs, labels, **options)
    scored = docs.select("doc_id", toxicity(F.col("text"), scorer).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
