"""Fill-in-middle transformation by displacement scatter.

The texts of an Arrow batch lie end to end in one byte buffer.  A scan finds token starts,
hence the two cuts of each text.  A byte's place in the output is its place in the buffer plus
a shift that changes only where a segment (prefix, middle, suffix) begins; the changes are
written to a difference array, whose running sum is every byte's shift, and one scatter puts
all bytes.  Markers fill the gaps that the shifts leave.  Restoring finds the markers, builds
the same shifts and gathers.

Buffers are walked in blocks, the sum carried from block to block, so the working arrays do
not grow with a text.  No rows are exchanged.  A null text is empty; a null doc_id draws as
the empty string; an empty table gives no rows; equal rows give equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: The markers, and how texts are drawn.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
SHARE = 50
SPM_SHARE = 80
#: Bytes that one scatter handles, and bytes of texts that are laid end to end at once (one text at least).
BLOCK = 1 << 20
LAID = 1 << 24

PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")
#: Markers and segments (0 prefix, 1 middle, 2 suffix) in output order.
LAYOUT = {PSM: ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), SPM: ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}


def draws(doc_id: Column, seed: int = SEED) -> Column:
    """Four unsigned 32-bit numbers from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def token_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places in the laid bytes where a token starts: a text's first byte, and each white space after a word.

    A token is a run of white space with the word after it; white space at a text's end is one more.
    """
    found = [starts]
    for at in range(0, len(data), BLOCK):
        part = data[max(at - 1, 0) : at + BLOCK]
        space = (part == 32) | ((part >= 9) & (part <= 13))
        found.append(np.flatnonzero(space[1:] & ~space[:-1]) + max(at - 1, 0) + 1)
    return np.unique(np.concatenate(found))


def code_points(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Number of code points that start before each of the sorted ``places``."""
    out, before = np.empty(len(places), dtype=np.int64), 0
    for at in range(0, len(data) + 1, BLOCK):
        running = np.concatenate([[0], np.cumsum((data[at : at + BLOCK] & 0xC0) != 0x80, dtype=np.int64)])
        a, b = np.searchsorted(places, [at, at + BLOCK])
        out[a:b] = before + running[places[a:b] - at]
        before += running[-1]
    return out


def displaced(places: np.ndarray, changes: np.ndarray, size: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Blocks of the buffer with the place of each byte: own place plus the running sum of the changes at ``places``."""
    order = np.argsort(places, kind="stable")
    places, changes = places[order], changes[order]
    carried = 0
    for at in range(0, size, BLOCK):
        stop = min(at + BLOCK, size)
        a, b = np.searchsorted(places, [at, stop])
        steps = np.zeros(stop - at, dtype=np.int64)
        np.add.at(steps, places[a:b] - at, changes[a:b])
        shift = np.cumsum(steps) + carried
        carried = shift[-1]
        yield slice(at, stop), np.arange(at, stop) + shift


def _changes(begin: np.ndarray, size: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Difference array of the shifts of segments; empty segments change nothing."""
    some = size > 0
    begin, shift = begin[some], shift[some]
    order = np.argsort(begin, kind="stable")
    begin, shift = begin[order], shift[order]
    return begin, np.diff(shift, prepend=0)


def scatter(data: np.ndarray, bounds: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output bytes and their starts; ``bounds`` has start, two cuts and end of each text in ``data``."""
    size = np.diff(bounds, axis=1)
    total = size.sum(axis=1) + np.where(form == PLAIN, 0, len(PREFIX) + len(SUFFIX) + len(MIDDLE))
    out_starts = np.concatenate([[0], np.cumsum(total)])
    out = np.empty(out_starts[-1], dtype=np.uint8)
    shift = np.repeat((out_starts[:-1] - bounds[:, 0])[:, None], 3, axis=1)
    for kind, layout in LAYOUT.items():
        rows = np.flatnonzero(form == kind)
        at = out_starts[rows].copy()
        for marker, segment in layout:
            for k, byte in enumerate(marker):
                out[at + k] = byte
            at += len(marker)
            shift[rows, segment] = at - bounds[rows, segment]
            at += size[rows, segment]
    places, changes = _changes(bounds[:, :3].ravel(), size.ravel(), shift.ravel())
    for block, to in displaced(places, changes, len(data)):
        out[to] = data[block]
    return out, out_starts


def gather(data: np.ndarray, starts: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Restored bytes and their starts from outputs laid end to end and their forms."""
    raw = data.data
    ends = starts[1:]
    whole = np.diff(starts) - np.where(form == PLAIN, 0, len(PREFIX) + len(SUFFIX) + len(MIDDLE))
    out_starts = np.concatenate([[0], np.cumsum(whole)])
    begin = np.repeat(starts[:-1, None], 3, axis=1)
    size = np.zeros((len(form), 3), dtype=np.int64)
    size[:, 0] = whole
    for kind, layout in LAYOUT.items():
        for row in np.flatnonzero(form == kind).tolist():
            text, at = bytes(raw[starts[row] : ends[row]]), 0
            found = []
            for marker, _ in layout:
                at = text.index(marker, at) + len(marker)
                found.append(at)
            stops = [f - len(m) for f, (m, _) in zip(found[1:], layout[1:])] + [len(text)]
            for (_, segment), a, b in zip(layout, found, stops):
                begin[row, segment], size[row, segment] = starts[row] + a, b - a
    first = out_starts[:-1, None] + np.cumsum(size, axis=1) - size
    out = np.empty(out_starts[-1], dtype=np.uint8)
    places, changes = _changes(first.ravel(), size.ravel(), (begin - first).ravel())
    for block, source in displaced(places, changes, len(out)):
        out[block] = data[source]
    return out, out_starts


def _laid(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of a binary column of at most LAID bytes or one row: first row, last, bytes, starts."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + LAID, side="right")) - 1)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def _texts(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)])


def _transform(data: np.ndarray, starts: np.ndarray, draw: np.ndarray, share: int, spm_share: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of texts laid end to end."""
    filled = starts[:-1] < starts[1:]
    tokens = token_starts(data, starts[:-1][filled])
    first = np.searchsorted(tokens, starts[:-1])
    n = np.searchsorted(tokens, starts[1:]) - first
    held = np.array([any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in (bytes(data[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()))], dtype=bool)
    form = np.where(~filled | held | (draw[:, 2] % 100 >= share), PLAIN, np.where(draw[:, 3] % 100 < spm_share, SPM, PSM))
    cuts = np.sort(draw[:, :2] % (n[:, None] + 1), axis=1)
    places = np.append(tokens, len(data))
    cut = np.where(cuts == n[:, None], starts[1:, None], places[np.minimum(first[:, None] + cuts, len(tokens))])
    bounds = np.column_stack([starts[:-1], cut, starts[1:]])
    chars = code_points(data, bounds[:, :3].ravel()).reshape(-1, 3)
    out, out_starts = scatter(data, bounds, form)
    plain = form == PLAIN
    return [
        pa.array(n.astype(np.int64)), pa.array([FORMS[f] for f in form.tolist()], pa.string()),
        pa.array(chars[:, 1] - chars[:, 0], mask=plain), pa.array(chars[:, 2] - chars[:, 1], mask=plain), _texts(out, out_starts),
    ]


def _by_batch(df: DataFrame, text: str, added: str, work: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], list[pa.Array]], drop: list[str]) -> DataFrame:
    """``df`` less ``drop`` with the columns that ``work`` makes of a run of texts and its rows."""
    names = [c for c in df.columns if c not in drop]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names), added])
    new = [c.split()[0].strip("`") for c in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
            for row, stop, data, starts in _laid(column):
                part = batch.slice(row, stop - row)
                kept = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, *work(data, starts, part)], [*names, *new])

    return df.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, *, key: str = "doc_id", text: str = "text", share: int = SHARE, spm_share: int = SPM_SHARE, seed: int = SEED) -> DataFrame:
    """The columns of ``docs`` but the text, and n, form, prefix_chars, middle_chars, output.

    Columns of ``docs`` of these names are left out.  ``share`` per cent of the texts are cut, of
    which ``spm_share`` per cent begin with the suffix.
    """
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    draw = free_name(docs, "draw")
    rows = docs.drop(*[c for c in made if c not in (key, text)]).withColumn(draw, draws(F.col(key), seed)).withColumn(text, F.coalesce(F.col(text), F.lit("")))

    def work(data: np.ndarray, starts: np.ndarray, part: pa.RecordBatch) -> list[pa.Array]:
        numbers = part.column(part.schema.get_field_index(draw)).flatten().to_numpy().reshape(-1, 4)
        return _transform(data, starts, numbers, share, spm_share)

    return _by_batch(rows, text, "`n` long, `form` string, `prefix_chars` long, `middle_chars` long, `output` string", work, [draw, text])


def restore(rows: DataFrame, *, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """``rows`` with the exact text rebuilt from output and form in place of the output."""

    def work(data: np.ndarray, starts: np.ndarray, part: pa.RecordBatch) -> list[pa.Array]:
        kinds = np.array([FORMS.index(f) for f in part.column(part.schema.get_field_index(form)).to_pylist()], dtype=np.int64)
        return [_texts(*gather(data, starts, kinds))]

    return _by_batch(rows, output, f"`{restored}` string", work, [output])


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row."""
    cut = fill_in_middle(docs.select("doc_id", "text"), **options).withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256))
    return restore(cut).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256")
    )


def digests_sql() -> str:
    """The same rows in DuckDB."""
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS digest,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents),
drawn AS (
  SELECT doc_id, text, tokens, len(tokens)::BIGINT AS n,
         [('0x' || substr(digest, 1 + 8 * k, 8))::BIGINT FOR k IN range(4)] AS h
  FROM docs),
cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= {SHARE} THEN 'plain'
              WHEN h[4] % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix
  FROM cut)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
