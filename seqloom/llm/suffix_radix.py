"""Substring dedup over bytes by radix-sorting suffixes through a threshold, and no deeper.

A byte goes if a string of ``width`` bytes that covers it also starts earlier: in a document before, by key, or earlier
in the same one. Suffixes are ordered by their first ``width`` bytes only; those that stay in one group to that depth
are exactly the occurrences of one repeated string, and all but the first go. No order within a group is needed.

The first digit is not the first byte. Of the ``anchor``-byte strings inside a suffix's first ``width`` bytes the one
with the smallest hash (the leftmost of equal ones) is its anchor. Equal suffixes have equal anchors at equal offsets,
and neighbours mostly share one: a run of consecutive suffixes with one anchor is one row. So

* pass 1 groups runs by anchor; groups of one run are done, as in any radix sort (about one row for 35 bytes),
* pass 2 groups what is left by the run as a whole (64 bits, within one anchor): suffixes of a run that is found more
  than once all go, but for its first occurrence,
* the following passes take the first occurrences of different runs under one anchor, with the bytes they cover, and
  sort their suffixes by (anchor, offset of the anchor) and then digit by digit, eight bytes a digit, most significant
  first, inside tasks. Suffixes alone in their group are dropped after each digit. Bytes decide, not hashes.

An anchor with more than ``crowd`` different runs (a very common passage whose surroundings all differ) is not gathered
in one task: its suffixes are grouped by 128-bit hashes of their first ``width`` bytes with map-side aggregates instead.
Groups of copies are counted by map-side aggregates too, and never meet in pairs. Both ways give the same result.

Rows that repeat a key and text are one document and get one result. Rows with one key and different texts are ordered
by a hash of the text; null keys come first. Null and empty texts have no bytes. Long texts are cut into pieces that
overlap by ``width`` - 1 bytes, so that memory is bounded by the longest text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import stored

_U = np.uint64
SLICE = 1 << 18
BLOCK = 4096
_SHAPE = 1 << 16


class Rolling:
    """Polynomial hashes of all strings of bytes inside a buffer."""

    def __init__(self):
        rng = np.random.default_rng(50_021)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=_U)
        self.step = int(rng.integers(1, 1 << 62)) * 2 + 1
        self.size = 0

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        if len(raw) >= self.size:
            self.size = max(2 * len(raw), 2 * SLICE)
            self.up, self.down = (self._powers(x, self.size) for x in (self.step, pow(self.step, -1, 1 << 64)))
        out = np.zeros(len(raw) + 1, _U)
        np.cumsum(self.byte[raw] * self.up[: len(raw)], out=out[1:])
        return out

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, _U(base & ((1 << 64) - 1)))
        out[0] = 1
        return np.multiply.accumulate(out)

    @staticmethod
    def mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> _U(32))) * _U(0x9E6C63D0876A9A99)
        return h ^ (h >> _U(29))

    def all(self, prefix: np.ndarray, length: int) -> np.ndarray:
        n = len(prefix) - length
        return self.mix((prefix[length:] - prefix[:n]) * self.down[:n])

    def some(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.mix((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(_U))


def sliding_min(keys: np.ndarray, wide: int) -> np.ndarray:
    """The minimum of each ``wide`` consecutive keys, by doubling."""
    have = 1
    while 2 * have <= wide:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - (wide - have)], keys[wide - have :]) if have < wide else keys


def runs(raw: np.ndarray, valid: np.ndarray, width: int, anchor: int, rolling: Rolling):
    """Runs of valid suffixes that share an anchor: starts, sizes, anchors' places, anchors' and runs' hashes."""
    prefix = rolling.prefix(raw)
    each = rolling.all(prefix, anchor)
    keys = (each & _U(0xFFFFFFFF00000000)) | np.arange(len(each), dtype=_U)
    lead = (sliding_min(keys, width - anchor + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    first = valid.copy()
    first[1:] &= ~(valid[:-1] & (lead[1:] == lead[:-1]))
    at = np.flatnonzero(first)
    if not len(at):
        return at, at, at, each[:0], each[:0]
    n = np.add.reduceat(valid.astype(np.int64), at)
    place = lead[at]
    return at, n, place, each[place], rolling.some(prefix, at, at + n + (width - 1))


def _pieces(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of pieces of texts: bytes, starts of pieces in the buffer, their texts, their places in the texts."""
    raw, owner, place, size = [], [], [], 0
    for i, x in enumerate(texts):
        for at in range(0, len(x) - width + 1, SLICE):
            piece = np.frombuffer(x, np.uint8, min(SLICE + width - 1, len(x) - at), at)
            raw.append(piece)
            owner.append(i)
            place.append(at)
            size += len(piece)
            if size >= SLICE:
                yield np.concatenate(raw), np.cumsum([0, *map(len, raw)]), np.array(owner), np.array(place)
                raw, owner, place, size = [], [], [], 0
    if raw:
        yield np.concatenate(raw), np.cumsum([0, *map(len, raw)]), np.array(owner), np.array(place)


def text_runs(texts: list[bytes], width: int, anchor: int, rolling: Rolling):
    """Text, start, size, offset of the anchor, hash of the anchor and of the run, for each run of each text."""
    for raw, edges, owner, place in _pieces(texts, width):
        valid = np.ones(len(raw) - width + 1, bool)
        for e in edges[1:-1].tolist():
            valid[max(0, e - width + 1) : e] = False
        at, n, lead, h, r = runs(raw, valid, width, anchor, rolling)
        piece = np.searchsorted(edges, at, side="right") - 1
        yield owner[piece], at - edges[piece] + place[piece], n, lead - at, h, r


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    x = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("_k"), F.xxhash64(x).alias("_t"), x.cast("binary").alias("_x"))


def _met(rows: DataFrame, reply: DataFrame, how: str) -> DataFrame:
    other = reply.withColumnRenamed("_k", "_rk").withColumnRenamed("_t", "_rt")
    same = F.col("_k").eqNullSafe(F.col("_rk")) & (F.col("_t") == F.col("_rt"))
    return rows.join(other, same, how).drop("_rk", "_rt")


def _all_runs(rows: DataFrame, width: int, anchor: int, whole: bool) -> DataFrame:
    """``h`` of each run; with ``whole`` also ``_k``, ``_t``, ``at``, ``shape`` (offset of the anchor and size) and ``r``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for b in batches:
            for owner, at, n, lead, h, r in text_runs(b.column(b.num_columns - 1).to_pylist(), width, anchor, rolling):
                if not whole:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])
                    continue
                who = pa.array(owner)
                numbers = [at.astype(np.int32), (lead * _SHAPE + n).astype(np.int32), h.view(np.int64), r.view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(who), b.column(1).take(who), *map(pa.array, numbers)], ["_k", "_t", "at", "shape", "h", "r"]
                )

    if not whole:
        return rows.select("_x").mapInArrow(run, "h long")
    return rows.mapInArrow(run, f"_k {rows.schema['_k'].dataType.simpleString()}, _t long, at int, shape int, h long, r long")


def _covered(rows: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """The runs of ``reps`` (``h``, ``_k``, ``_t``, ``at``, ``shape``, ``classes``) with the bytes they cover, ``x``."""
    each = F.collect_list(F.struct("at", "shape", "h", "classes")).alias("_w")
    both = _met(rows, reps.groupBy("_k", "_t").agg(each), "inner")
    x = F.expr(f"substring(_x, w.at + 1, w.shape % {_SHAPE} + {width - 1})")
    both = both.select("_k", "_t", "_x", F.explode("_w").alias("w")).select("_k", "_t", "w.*", x.alias("x"))
    # once for all rows that repeat a key and text
    return both.groupBy("h", "_k", "_t", "at").agg(*[F.first(c).alias(c) for c in ("shape", "classes", "x")])


def equal_suffixes(group: np.ndarray, starts: np.ndarray, raw: np.ndarray, width: int) -> np.ndarray:
    """Indices of the suffixes that equal an earlier one of their group to the depth ``width``.

    Passes over digits of eight bytes, most significant first; what is alone in its group is dropped after each.
    """
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").ravel().astype(_U)
    left = np.arange(len(starts))

    def split(order: np.ndarray, new: np.ndarray):
        number = np.cumsum(new) - 1
        many = np.bincount(number)[number] > 1
        return order[many], number[many]

    order = np.argsort(group, kind="stable")
    g = group[order]
    left, number = split(left[order], np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else (left, left)
    for depth in range(0, width, 8):
        if not len(left):
            break
        digit = words[starts[left] + depth]
        if width - depth < 8:
            digit = digit >> _U(8 * (8 - (width - depth)))
        order = np.lexsort((digit, number))
        d, g = digit[order], number[order]
        left, number = split(left[order], np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]))
    later = np.concatenate([[False], number[1:] == number[:-1]]) if len(left) else np.zeros(0, bool)
    return left[later]


def _sorted_suffixes(found: DataFrame, width: int) -> DataFrame:
    """``_k``, ``_t``, ``at`` and ``n`` of consecutive suffixes that start earlier under the same anchor."""

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h, at, shape = (t.column(c).to_numpy() for c in ("h", "at", "shape"))
        raw = [np.frombuffer(x, np.uint8) for x in t.column("x").to_pylist()]
        edges, n, lead = np.cumsum([0, *map(len, raw)])[:-1], shape % _SHAPE, shape // _SHAPE
        row = np.repeat(np.arange(len(h)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        under = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
        gone = np.sort(equal_suffixes(under[row] * _SHAPE + (lead[row] - step), edges[row] + step, np.concatenate(raw), width))
        if not len(gone):
            return
        first = np.concatenate([[True], (np.diff(gone) > 1) | (np.diff(row[gone]) > 0)])
        start = gone[first]
        size = np.diff(np.append(np.flatnonzero(first), len(gone)))
        who = pa.array(row[start])
        for part in t.select(["_k", "_t"]).take(who).combine_chunks().to_batches():
            numbers = [(at[row[start]] + step[start]).astype(np.int32), size.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, numbers)], ["_k", "_t", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < BLOCK:
                continue
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # sorted; the last anchor may go on
            if cut:
                yield from done(t.slice(0, cut).combine_chunks())
                held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held).combine_chunks())

    rows = found.select("h", "_k", "_t", "at", "shape", "x").repartition("h").sortWithinPartitions("h", "_k", "_t", "at")
    kind = rows.schema["_k"].dataType.simpleString()
    return rows.mapInArrow(run, f"_k {kind}, _t long, at int, n int")


def _hashed_suffixes(found: DataFrame, width: int) -> DataFrame:
    """As ``_sorted_suffixes``, by hashes of the suffixes' first bytes, for anchors with very many runs."""
    part = f"substring(x, i + 1, {width})"
    each = found.withColumn("i", F.explode(F.expr(f"sequence(0, shape % {_SHAPE} - 1)"))).select(
        "_k", "_t", (F.col("at") + F.col("i")).alias("at"), F.expr(f"xxhash64({part})").alias("w1"), F.expr(f"xxhash64(1, {part})").alias("w2")
    )
    me = F.struct("_k", "_t", "at")
    first = each.groupBy("w1", "w2").agg(F.min(me).alias("first"), F.count("*").alias("times")).filter("times > 1")
    return each.join(first, ["w1", "w2"]).filter(~me.eqNullSafe(F.col("first"))).select("_k", "_t", "at", F.lit(1).alias("n"))


def repeated(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text", anchor: int | None = None, crowd: int = 4096) -> DataFrame:
    """``_k``, ``_t`` (key and hash of the text) and ``spans``: starts and numbers of suffixes that also start earlier."""
    anchor = anchor or max(1, width * 32 // 100)
    rows = _rows(docs, key, text)
    alive = stored(_all_runs(rows, width, anchor, False).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    left = stored(_all_runs(rows, width, anchor, True).join(alive, "h"))
    me = F.struct("_k", "_t", "at", "shape")
    classes = stored(left.groupBy("h", "r").agg(F.min(me).alias("first"), F.count("*").alias("times")))
    settled = left.join(classes.filter("times > 1"), ["h", "r"]).filter(~me.eqNullSafe(F.col("first")))
    settled = settled.select("_k", "_t", "at", (F.col("shape") % _SHAPE).alias("n"))
    mixed = stored(classes.groupBy("h").agg(F.count("*").alias("classes")).filter("classes > 1"))
    reps = classes.join(mixed, "h").select("h", "classes", "first.*")
    found = stored(_covered(rows, reps, width))
    few, many = F.col("classes") <= crowd, F.col("classes") > crowd
    gone = settled.unionByName(_sorted_suffixes(found.filter(few), width)).unionByName(_hashed_suffixes(found.filter(many), width))
    return stored(gone.groupBy("_k", "_t").agg(F.collect_list(F.struct("at", "n")).alias("spans")))


def dedup(docs: DataFrame, width: int = 100, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans`` (runs of removed bytes) and ``kept`` (the other bytes) of each row."""
    rows = _rows(docs, key, text)
    both = _met(rows, repeated(docs, width, key, text, **options), "left")
    both = both.select("_k", "_x", F.col("spans.at").alias("a"), F.col("spans.n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                size, gone, spans, kept = [], [], [], []
                for x, a, n in zip(*(part.column(c).to_pylist() for c in (1, 2, 3))):
                    size.append(len(x))
                    if not a:
                        gone.append(0)
                        spans.append(0)
                        kept.append(x)
                        continue
                    first = np.array(a, np.int64)
                    edge = np.zeros(len(x) + 1, np.int32)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + np.array(n, np.int64) + (width - 1), -1)
                    out = np.cumsum(edge)[:-1] > 0
                    gone.append(int(out.sum()))
                    spans.append(int(out[0]) + int((out[1:] & ~out[:-1]).sum()))
                    kept.append(np.frombuffer(x, np.uint8)[~out].tobytes())
                numbers = [pa.array(c, pa.int64()) for c in (size, gone, spans)]
                yield pa.RecordBatch.from_arrays([part.column(0), *numbers, pa.array(kept, pa.binary())], [key, "n_bytes", "n_removed", "n_spans", "kept"])

    kind = rows.schema["_k"].dataType.simpleString()
    return both.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (
  SELECT doc_id, p, md5(substring(x, 2 * p + 1, 200)) AS w
  FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - 99)) AS p FROM d WHERE len(x) >= 200)),
hit AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
mark AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM hit),
run AS (
  SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 100 THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY p) AS k FROM mark),
span AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM run GROUP BY 1, 2),
edge AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM span),
piece AS (
  SELECT doc_id, a, substring(x, 2 * since + 1, 2 * (a - since)) AS y FROM edge JOIN d USING (doc_id)
  UNION ALL
  SELECT doc_id, max(b), any_value(substring(x, 2 * b + 1)) FROM
    (SELECT doc_id, b, x, max(b) OVER (PARTITION BY doc_id) AS last FROM span JOIN d USING (doc_id)) WHERE b = last GROUP BY 1),
cut AS (SELECT doc_id, string_agg(y, '' ORDER BY a) AS y FROM piece GROUP BY 1),
sums AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM span GROUP BY 1)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN cut USING (doc_id)
"""
