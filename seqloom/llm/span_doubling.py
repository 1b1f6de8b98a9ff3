"""Substring dedup by level-wise doubling of windows of words.

A word goes if a window of ``width`` words that covers it starts anywhere else, in the same document or another.
Windows that are repeated at one length alone are extended to twice that length, the last step being cut to
``width``: a window can only be repeated if every shorter window inside it is. Levels end when a length has no
repeated windows or ``width`` is reached.

At each length below ``width`` one window stands for all longer ones around it: of the windows inside a longer one,
that with the smallest hash. Equal longer windows choose alike, so nothing is lost, and about one window in ten has to
be counted. At the last length the windows led by one such choice form a run of neighbours, and runs are compared
first: if the whole run occurs twice, so does each of its windows. Only runs that occur once, and one representative of
each run that occurs more often, are taken apart into single windows. So a group of copies, however large, is counted
by map-side aggregates, and its members never meet in pairs.

Windows are hashed by 64 bits where they are candidates, by 96 bits where they decide. Words are the runs of characters
other than space, tab, \\n, \\v, \\f and \\r. Null and empty texts have no words. Rows that repeat a key and text count
as two documents, so each window of such a row starts elsewhere too; rows with one key and different texts are told
apart by 64 bits of the text. The hashes of a text are held by one task; memory
is linear in the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import stored

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


class Hashes:
    """Hashes of words and of windows of words; ``family`` picks independent functions."""

    def __init__(self, family: int):
        rng = np.random.default_rng([family, 20_011])
        self.byte = rng.integers(1, 1 << 63, 256, dtype=_U)
        self.base = int(rng.integers(1, 1 << 62)) * 2 + 1
        self.step = int(rng.integers(1, 1 << 62)) * 2 + 1
        self._powers: dict[int, np.ndarray] = {}

    def powers(self, base: int, n: int) -> np.ndarray:
        have = self._powers.get(base)
        if have is None or len(have) < n:
            have = np.full(max(n, 1024), _U(base & ((1 << 64) - 1)))
            have[0] = 1
            self._powers[base] = have = np.multiply.accumulate(have)
        return have[:n]

    @staticmethod
    def mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
        h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
        return h ^ (h >> _U(33))

    def words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """One hash per word of the bytes ``raw``."""
        place = np.arange(len(raw))[inside] - np.repeat(starts, ends - starts)
        each = self.byte[raw[inside]] * self.powers(self.base, int((ends - starts).max()))[place]
        first = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
        return self.mix(np.add.reduceat(each, first) + (ends - starts).astype(_U))

    def prefix(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words) + 1, _U)
        np.cumsum(words * self.powers(self.step, len(words)), out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``starts`` up to ``ends``."""
        back = self.powers(pow(self.step, -1, 1 << 64), len(prefix))
        return self.mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(_U))


def _bounds(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    inside = ~_BLANK[raw]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return raw, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), inside


class Text:
    """The windows of one text."""

    def __init__(self, text: str | None, families: list[Hashes]):
        raw, starts, ends, inside = _bounds(text)
        self.n = len(starts)
        self.families = families
        self.prefix = [f.prefix(f.words(raw, starts, ends, inside)) if self.n else np.zeros(1, _U) for f in families]

    def windows(self, length: int, family: int = 0) -> np.ndarray:
        at = np.arange(max(0, self.n - length + 1))
        return self.families[family].spans(self.prefix[family], at, at + length)

    def leaders(self, short: int, long: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window of ``long`` words the start of its leading one of ``short`` words; and all short hashes."""
        h = self.windows(short)
        wide = long - short + 1
        if len(h) < wide:
            return np.zeros(0, np.int64), h
        view = np.lib.stride_tricks.sliding_window_view(h, wide)
        return view.argmin(axis=1) + np.arange(len(view)), h


def lengths(width: int, shortest: int = 18) -> list[int]:
    """The lengths of the levels, each at most twice the one before; the last is ``width``."""
    out = [width]
    while (out[0] + 1) // 2 >= max(shortest, 2):
        out.insert(0, (out[0] + 1) // 2)
    return out


def _level(levels: list[int], k: int, text: str | None, known: list[int] | None, families: list[Hashes]):
    """Starts and hashes of the windows counted at level ``k``, those of level ``k - 1`` being ``known``."""
    t = Text(text, families)
    lead, h = t.leaders(levels[k], levels[k + 1])
    if k and len(lead):
        before, _ = t.leaders(levels[k - 1], levels[k])
        good = np.zeros(t.n + 1, bool)
        good[np.array(known, np.int64)] = True
        lead = lead[good[before[lead]]]
    at = np.unique(lead)
    return at, h[at]


def _runs(levels: list[int], text: str | None, known: list[int] | None, families: list[Hashes]):
    """Runs of candidate windows of the last length: starts, sizes, and the text's window hashes."""
    t, width = Text(text, families), levels[-1]
    n = max(0, t.n - width + 1)
    if len(levels) > 1 and n:
        lead, _ = t.leaders(levels[-2], width)
        good = np.zeros(t.n + 1, bool)
        good[np.array(known, np.int64)] = True
        live = good[lead]
    else:
        lead, live = np.arange(n), np.ones(n, bool)
    at = np.flatnonzero(live)
    if not len(at):
        return t, at, at
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(lead[at]) != 0)]))
    return t, at[cut], np.diff(np.append(cut, len(at)))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _with_ids(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("_k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_t"), F.col(text).alias("_x"))


def _met(rows: DataFrame, reply: DataFrame, how: str) -> DataFrame:
    other = reply.withColumnRenamed("_k", "_rk").withColumnRenamed("_t", "_rt")
    same = F.col("_k").eqNullSafe(F.col("_rk")) & (F.col("_t") == F.col("_rt"))
    return rows.join(other, same, how).drop("_rk", "_rt")


def repeated(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text", shortest: int = 18) -> DataFrame:
    """``_k``, ``_t`` (key and hash of the text) and ``spans``: starts and sizes of runs of repeated windows."""
    rows = _with_ids(docs, key, text)
    ids = f"_k {rows.schema['_k'].dataType.simpleString()}, _t long"
    levels = lengths(width, shortest)
    reply = None

    def counted(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            families = [Hashes(0)]
            for b in batches:
                for at in range(0, b.num_rows, 128):
                    part = b.slice(at, 128)
                    known = part.column(3).to_pylist() if k else [None] * part.num_rows
                    found = [_level(levels, k, x, c, families) for x, c in zip(part.column(2).to_pylist(), known)]
                    owner = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(owner),
                            part.column(1).take(owner),
                            pa.array(np.concatenate([f[0] for f in found]), pa.int32()),
                            pa.array(_signed(np.concatenate([f[1] for f in found])), pa.int64()),
                        ],
                        ["_k", "_t", "at", "h"],
                    )

        return run

    for k in range(len(levels) - 1):
        source = rows if reply is None else _met(rows, reply, "inner")
        # hashed twice, as the rows would take as much disk as the texts; stored hashes, so that Spark can split the join
        found = source.mapInArrow(counted(k), f"{ids}, at int, h long")
        twice = stored(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
        reply = stored(found.join(twice, "h").groupBy("_k", "_t").agg(F.collect_list("at").alias("known")))

    led = reply is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families = [Hashes(0), Hashes(1)]
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                known = part.column(3).to_pylist() if led else [None] * part.num_rows
                owner, starts, sizes, s1, s2, h1, h2 = [], [], [], [], [], [], []
                for i, (x, c) in enumerate(zip(part.column(2).to_pylist(), known)):
                    t, a, n = _runs(levels, x, c, families)
                    if not len(a):
                        continue
                    owner += [i] * len(a)
                    starts.append(a)
                    sizes.append(n)
                    for f, into in ((0, s1), (1, s2)):
                        into.append(families[f].spans(t.prefix[f], a, a + n + (width - 1)))
                    w1, w2 = t.windows(width, 0), t.windows(width, 1)
                    h1 += [_signed(w1[p : p + m]) for p, m in zip(a.tolist(), n.tolist())]
                    h2 += [w2[p : p + m].astype(np.uint32).view(np.int32) for p, m in zip(a.tolist(), n.tolist())]
                if not owner:
                    continue
                who = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(who),
                        part.column(1).take(who),
                        pa.array(np.concatenate(starts), pa.int32()),
                        pa.array(np.concatenate(sizes), pa.int32()),
                        pa.array(_signed(np.concatenate(s1)), pa.int64()),
                        pa.array(np.concatenate(s2).astype(np.uint32).view(np.int32), pa.int32()),
                        _lists(h1, pa.int64()),
                        _lists(h2, pa.int32()),
                    ],
                    ["_k", "_t", "at", "n", "s1", "s2", "h1", "h2"],
                )

    source = rows if reply is None else _met(rows, reply, "inner")
    runs = stored(source.mapInArrow(run, f"{ids}, at int, n int, s1 long, s2 int, h1 array<bigint>, h2 array<int>"))
    me = F.struct("_k", "_t", "at")
    classes = runs.groupBy("s1", "s2").agg(F.count("*").alias("times"), F.min(me).alias("first"))
    known = runs.join(classes, ["s1", "s2"])
    # a run met twice is settled; its one representative lends its windows to runs met once
    settled = F.when(
        F.col("times") > 1,
        F.array(F.struct(F.xxhash64(me).alias("w1"), F.lit(0).alias("w2"), F.col("at"), "n", F.lit(0).alias("weight"))),
    ).otherwise(F.expr("array()"))
    weight = F.when(F.col("times") > 1, 2).otherwise(1)
    single = F.when(
        (F.col("times") == 1) | me.eqNullSafe(F.col("first")),
        F.transform(
            F.arrays_zip("h1", "h2"),
            lambda x, i: F.struct(
                x["h1"].alias("w1"), x["h2"].alias("w2"), (F.col("at") + i).alias("at"), F.lit(1).alias("n"), weight.alias("weight")
            ),
        ),
    ).otherwise(F.expr("array()"))
    units = known.select("_k", "_t", F.explode(F.concat(settled, single)).alias("u")).select("_k", "_t", "u.*")
    twice = units.filter("weight > 0").groupBy("w1", "w2").agg(F.sum("weight").alias("met")).filter("met > 1")
    found = units.filter("weight < 2").join(twice, ["w1", "w2"], "left").filter("weight = 0 OR met IS NOT NULL")
    return stored(found.groupBy("_k", "_t").agg(F.collect_list(F.struct("at", "n")).alias("spans")))


def dedup(
    docs: DataFrame, width: int = 35, key: str = "doc_id", text: str = "text", shortest: int = 18
) -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept`` (the other words, joined by spaces) of each row."""
    rows = _with_ids(docs, key, text)
    both = _met(rows, repeated(docs, width, key, text, shortest), "left")
    both = both.select("_k", "_x", F.col("spans.at").alias("a"), F.col("spans.n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                words, gone, kept = [], [], []
                for x, a, n in zip(*(part.column(c).to_pylist() for c in (1, 2, 3))):
                    # str.split() would also cut at other white space
                    raw, starts, ends, _ = _bounds(x)
                    edge = np.zeros(len(starts) + 1, np.int64)
                    if a:
                        first = np.array(a, np.int64)
                        np.add.at(edge, first, 1)
                        np.add.at(edge, first + np.array(n, np.int64) + (width - 1), -1)
                    out = np.cumsum(edge)[:-1] > 0
                    whole = raw.tobytes()
                    stay = np.flatnonzero(~out)
                    text_ = b" ".join([whole[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist())])
                    words.append(len(starts))
                    gone.append(int(out.sum()))
                    kept.append(text_.decode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                    [key, "n_words", "n_removed", "kept"],
                )

    kind = rows.schema["_k"].dataType.simpleString()
    return both.mapInArrow(run, f"`{key}` {kind}, n_words long, n_removed long, kept string")


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
win AS (
  SELECT doc_id, p, array_to_string(ws[p + 1 : p + 35], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(len(ws) - 34)) AS p FROM w WHERE len(ws) >= 35)),
again AS (SELECT md5(k) AS k FROM win GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT doc_id, p FROM win JOIN again ON md5(win.k) = again.k),
gone AS (SELECT DISTINCT doc_id, p + unnest(range(35)) AS i FROM hit),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t
  FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
