from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import personal as P

from .helpers import documents, empty

PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t, d: all(int(p) <= 255 for p in t.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda t, d: 14 <= len(d) <= 19 and plain_luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t, d: 10 <= len(d) <= 15),
)


def plain_luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain_spans(text):
    found = []
    for k, (kind, pattern, good) in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            if good(m[0], "".join(re.findall("[0-9]", m[0]))):
                found.append((m.start(), k, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


TEXTS = [
    None,
    "",
    "no data here",
    "a.b%c+d-e@x-y.co.uk, @x.y z@ a@b a@b.c@d.e x@y..z q@-.-",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 1.2.3 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111 4111  11111111 1111",
    "+1 (455) 555-2359 +49.30-1234567 +1 23 ++1 555 555 5555 + 1 555 555 5555 +1-----------2 +123456789012345678",
    "ü +1 (455) 555-2359 4732500337014340 x 1.2.3.4 é@b.de 😀 a@b.de",
    "version 2.0. 4.0 page 12 of 300, 2021-12-31",
    "1" * 50_000,
    "1." * 20_000,
    "a" * 50_000 + "@" * 5_000,
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_are_those_of_the_patterns(text):
    assert P.base_spans(text or "")[0] == plain_spans(text)


def test_base_spans_of_random_texts():
    rng = np.random.default_rng(0)
    for _ in range(3000):
        text = "".join(rng.choice(list("0123456789..@@ab-+ ()%é"), rng.integers(1, 60)))
        assert P.base_spans(text)[0] == plain_spans(text), text


def sample():
    rng = np.random.default_rng(1)

    def card():
        head = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        return next(head + str(k) for k in range(10) if plain_luhn(head + str(k)))

    makers = [
        lambda: f"ab{rng.integers(99)}.c@mail{rng.integers(9)}.example.com",
        lambda: ".".join(map(str, rng.integers(1, 255, 4))),
        card,
        lambda: f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}",
        lambda: f"version {rng.integers(9)}.{rng.integers(9)}",
    ]
    return [f"some words {makers[k % 5]()} and more words" for k in range(500)], card


@pytest.fixture(scope="module")
def field():
    return P.train(sample()[0])


def test_dynamic_program_finds_the_best_segmentation(field):
    stretch = P.Stretch("c@d.e 1", 0, 7)
    n = len(stretch.tokens)
    spans = field.scores(stretch)
    index = {(i, j): s for s, (i, j) in enumerate(zip(stretch.starts, stretch.ends))}

    def all_ways(at):
        if at == n:
            yield []
            return
        for rest in all_ways(at + 1):
            yield [(at, at, -1), *rest]
        for j in range(at, min(n, at + 3)):
            for kind in range(4):
                for rest in all_ways(j + 1):
                    yield [(at, j, kind), *rest]

    def value(way):
        total, label = 0.0, 0
        for i, j, kind in way:
            total += field.follows[label, kind + 1] + (spans[index[i, j], kind] if kind >= 0 else 0.0)
            label = kind + 1
        return total

    stretch.starts, stretch.ends = zip(*((i, j) for i, j in zip(stretch.starts, stretch.ends) if j - i < 3))
    keep = [index[i, j] for i, j in zip(stretch.starts, stretch.ends)]
    stretch.slots = stretch.slots[keep]
    ways = list(all_ways(0))
    best = max(ways, key=value)
    assert field.best(stretch) == [w for w in best if w[2] >= 0]
    total = np.logaddexp.reduce([value(w) for w in ways])
    gold = [w for w in best if w[2] >= 0]
    assert field.likelihood(stretch, gold)[0] == pytest.approx(value(best) - total)


def test_gradients_are_those_of_the_likelihood(field):
    stretch = P.Stretch("1.2.3.4 +1 5", 0, 12)
    gold = [(0, 6, 1)]
    _, d_spans, d_follows = field.likelihood(stretch, gold)
    base = field.likelihood(stretch, gold)[0]
    field.follows[0, 2] += 1e-5
    assert d_follows[0, 2] == pytest.approx((field.likelihood(stretch, gold)[0] - base) / 1e-5, abs=1e-3)
    field.follows[0, 2] -= 1e-5
    whole = field.scores(stretch)
    span = stretch.starts.index(0)
    shifted = whole.copy()
    shifted[span, 1] += 1e-5
    field.scores = lambda _: shifted
    up = field.likelihood(stretch, gold)[0]
    del field.scores
    assert d_spans[span, 1] == pytest.approx((up - base) / 1e-5, abs=1e-3)


def test_finds_spans_that_the_patterns_misjudge(field):
    _, card = sample()
    good = card()
    wrong = good[:-1] + str((int(good[-1]) + 1) % 10)
    assert P.find(f"pay {wrong} now", field)[1] == [(4, 20, "card_like")]
    # The pattern takes the neighbour's digits for the card's.
    base, more = P.find(f"from 10.20.30.132 {good[:15]}{good[15]} now", field)
    assert [s[2] for s in base] == ["ip"] or [s[2] for s in base] == ["ip", "card"]
    assert all(s[2].endswith("_like") for s in more)
    for clean in ("version 2.0 page 12 of 300", "no data", "", "in 1999 and 2001, 50 % of 12,000"):
        assert P.find(clean, field) == ([], [])


def test_documents(spark):
    texts = [*TEXTS, *sample()[0][:60]]
    docs = documents(spark, texts).withColumn("start", F.lit(1)).withColumn("spans", F.lit("x"))
    docs = docs.union(docs.filter("doc_id = 4"))
    rows = P.tag_documents(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = plain_spans(texts[r["doc_id"]])
        for kind in P.KINDS:
            assert r[f"n_{kind}"] == sum(s[2] == kind for s in want)
        told = [f"{k}:{a}:{b}" for a, b, k in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and "_like" not in s] == told
    for r in P.tagged_spans(docs).collect():
        assert r["found"] == texts[r["doc_id"]][r["start"] : r["end"]]


def test_empty_tables(spark):
    assert P.tag_documents(empty(spark)).collect() == []
    assert [r["spans"] for r in P.tag_documents(documents(spark, [None, "", "no data"])).collect()] == ["", "", ""]


@pytest.mark.parametrize("text", ["see 1.2.3.²", "10.0.0.①", "٣.٣.٣.٣ 1.2.3.٤", "+² 12345678901234", "²"])
def test_digits_of_other_scripts(field, text):
    base, more = P.find(text, field)
    assert base == plain_spans(text)
    assert all(text[a:b].strip() for a, b, _ in more)


def test_check_sums_are_carried(field):
    """The signatures of a stretch's spans against the text of each span."""
    text = "4111 1111-1111 1111 9.8.7.6 1.2.300.4 12 345-678 9012  34 5\t6789012345678 +1 (2) 3"
    stretch = P.Streamed(text, 0, len(text))
    for j in range(len(stretch.tokens)):
        for i, (shape, runs, digits, size, quad, checked, left, right) in stretch.ending(j):
            part = text[stretch.tokens[i][0] : stretch.tokens[j][1]]
            found = P.only_digits(part)
            assert digits == len(found) and size == j - i + 1
            assert checked == (digits >= 12 and digits == len(part.replace(" ", "").replace("-", "")) and P.luhn(found))
            numbers = part.split(".")
            assert quad == (len(numbers) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in numbers))


def test_a_text_of_many_numbers(field):
    rng = np.random.default_rng(2)
    parts = [str(n) for n in rng.integers(0, 100_000, 5_000)]
    parts[2500:2500] = ["a@b.example.com", "10.1.2.3"]
    text = " ".join(parts)
    base, more = P.find(text, field)
    assert base == plain_spans(text) and {"email", "ip"} <= {k for _, _, k in base}
    streamed, whole = P.Streamed(text, 0, 3_000), P.Stretch(text, 0, 3_000)
    assert field.best(streamed) == field.best(whole)
