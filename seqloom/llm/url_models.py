"""URL filter by the ratio of two character language models.

Smoothed Markov models of variable order, one of accepted and one of rejected URLs, give each URL a log-likelihood
difference per character; a cut calibrated on held-back URLs decides. A character's probability at order k is its count
after the last k characters, smoothed towards order k-1, so contexts never seen fall back to shorter ones.

Counts cover all labelled URLs and are a table with a row per (order, context, character) and per context, told apart
by 64 bits, that grows with the input. If its rows are few (counted, ``BROADCAST_BYTES``), they go to the tasks as sorted
arrays; beyond that, the distinct texts' n-grams are joined to the table and scored with just the rows they meet. Labels come from
host and path rules, of which the longest that fits wins; a URL no rule fits gets the models' verdict.

Null URLs and those without ``://`` have an empty host and path and fit no rule; the models judge their text as it is.
An empty text scores 0. If one class has no URL, or none to calibrate on, the models allow. Repeated rows are judged
alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import runtime
from .text import lower_ascii, stored

ALLOW, BLOCK = "allow", "block"


def host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def by_rules(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """Name (host and path joined) and verdict of the longest rule that fits; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


class Hashing:
    """Slots of all (context, character) pairs and contexts of a batch of texts."""

    def __init__(self, order: int, bits: int):
        self.order, self.bits = order, bits
        rng = np.random.default_rng(11)
        self.symbol = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.place = rng.integers(1, 1 << 63, order + 2, dtype=np.uint64) | np.uint64(1)
        self.salt = rng.integers(1, 1 << 63, 2 * (order + 1), dtype=np.uint64)

    def slots(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text of each character, and its slots with and without the character, by order."""
        k = self.order
        flat = np.frombuffer(b"".join(b"\0" * k + t for t in texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        at = np.arange(len(owner)) + (owner + 1) * k
        context = np.zeros(len(owner), np.uint64)
        joint, alone = np.empty((k + 1, len(owner)), np.int64), np.empty((k + 1, len(owner)), np.int64)
        here = self.symbol[flat[at]] * self.place[k + 1]
        shift = np.uint64(64 - self.bits)
        for o in range(k + 1):
            if o:
                context = context + self.symbol[flat[at - o]] * self.place[o]
            for out, h in ((joint, context + here + self.salt[2 * o]), (alone, context + self.salt[2 * o + 1])):
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
                out[o] = ((h ^ (h >> np.uint64(29))) >> shift).astype(np.int64)
        return owner, joint, alone


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in column.to_pylist()]


def _count(rows: DataFrame, hashing: Hashing) -> DataFrame:
    """``slot``, ``allow``, ``block``: counts over rows of (text, accepted), added up per slice before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
            texts, good = _encoded(b.column(0)), np.array(b.column(1).to_pylist(), bool)
            owner, joint, alone = hashing.slots(texts)
            both = np.concatenate([joint, alone]).ravel()
            slot, at, n = np.unique(both, return_inverse=True, return_counts=True)
            allowed = np.bincount(at, np.tile(good[owner], 2 * hashing.order + 2), len(slot)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(allowed), pa.array(n - allowed)], ["slot", ALLOW, BLOCK])

    parts = rows.mapInArrow(run, f"slot long, {ALLOW} long, {BLOCK} long")
    return parts.groupBy("slot").agg(F.sum(ALLOW).alias(ALLOW), F.sum(BLOCK).alias(BLOCK))


def _located(known: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Places of slots among the known ones, which are sorted; the place behind the last for others."""
    at = np.searchsorted(known, slots)
    return np.where(np.append(known, 0)[at] == slots, at, len(known)) if len(known) else np.zeros_like(at)


def log_ratio(
    texts: list[bytes], counts: np.ndarray, hashing: Hashing, smooth: float, known: np.ndarray | None = None
) -> np.ndarray:
    """Log-likelihood of the accepted model less that of the rejected one, per character; 0 for empty texts.

    ``counts`` are by slot, or by place among the ``known`` slots, with a zero behind the last.
    """
    owner, joint, alone = hashing.slots(texts)
    if known is not None:
        joint, alone = _located(known, joint), _located(known, alone)
    logs = []
    for n in counts:
        p = np.full(len(owner), 1 / 256)
        for o in range(hashing.order + 1):
            p = (n[joint[o]] + smooth * p) / (n[alone[o]] + smooth)
        logs.append(np.log(p))
    total = np.bincount(owner, logs[0] - logs[1], minlength=len(texts))
    return total / np.maximum(np.array([len(t) for t in texts]), 1)


def _arrays(slot, allow, block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots in order, and the counts at their places."""
    known, first = np.unique(slot.to_numpy(), return_index=True)
    n = np.zeros((2, len(known) + 1))
    n[0, :-1], n[1, :-1] = allow.to_numpy()[first], block.to_numpy()[first]
    return known, n


def scored(rows: DataFrame, text: str, table: DataFrame, hashing: Hashing, smooth: float) -> DataFrame:
    """All columns plus ``score``."""
    limit = runtime.BROADCAST_BYTES // 24
    if table.limit(limit + 1).count() > limit:
        return _joined(rows, text, table, hashing, smooth)
    held = table.toArrow()
    model = rows.sparkSession.sparkContext.broadcast(_arrays(held["slot"], held[ALLOW], held[BLOCK]))
    names = rows.columns
    place = names.index(text)

    def run(batches):
        for b in batches:
            known, counts = model.value
            s = log_ratio(_encoded(b.column(place)), counts, hashing, smooth, known) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*names, "score"])

    from pyspark.sql.types import DoubleType, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("score", DoubleType()))


def _joined(rows: DataFrame, text: str, table: DataFrame, hashing: Hashing, smooth: float) -> DataFrame:
    """``scored`` with a table of any size. A text that meets no row scores 0, as both models are alike for it."""

    def grams(batches):
        for b in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            owner, joint, alone = hashing.slots(_encoded(b.column(0)))
            pairs = np.stack([np.tile(owner, 2 * hashing.order + 2), np.concatenate([joint, alone]).ravel()])
            pairs = np.unique(pairs, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pairs[0])), pa.array(pairs[1])], ["_text", "slot"])

    def score(batches):
        for b in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            met = b.column(1).flatten()
            known, counts = _arrays(*[met.field(c) for c in ("slot", ALLOW, BLOCK)])
            s = log_ratio(_encoded(b.column(0)), counts, hashing, smooth, known)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["_text", "score"])

    texts = rows.select(F.col(text).alias("_text")).distinct()
    met = texts.mapInArrow(grams, "_text string, slot long").join(table, "slot")
    met = met.groupBy("_text").agg(F.collect_list(F.struct("slot", ALLOW, BLOCK)).alias("_met"))
    scores = met.mapInArrow(score, "_text string, score double")
    out = rows.join(scores, F.col(text) == F.col("_text"), "left")
    return out.select(*[rows[c] for c in rows.columns], F.coalesce("score", F.lit(0.0)).alias("score"))


def calibrated_cut(scores: DataFrame, bins: int = 4000, reach: float = 8.0) -> float | None:
    """The score from which on a URL is accepted: best mean of both classes' hit rates on (score, accepted) rows."""
    b = F.floor(F.least(F.greatest(F.col("score"), F.lit(-reach)), F.lit(reach)) * (bins / (2 * reach)))
    found = scores.groupBy(b.alias("bin")).agg(
        F.sum(F.col("accepted").cast("long")).alias("good"), F.count("*").alias("n")
    )
    rows = sorted((r.bin, r.good, r.n - r.good) for r in found.collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return None
    best, cut, above, below = -1.0, 0.0, good, 0
    for at, g, n in rows:
        worth = above / good + below / bad
        if worth > best:
            best, cut = worth, at * (2 * reach / bins)
        above, below = above - g, below + n
    return cut


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    key: str = "page_id",
    url: str = "url",
    order: int = 5,
    smooth: float = 2.0,
) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of every row."""
    u = F.col(url)
    rows = pages.select(F.col(key), u.alias("_url"), host(u).alias("host"), path(u).alias("path"))
    rule, ruled = by_rules(rules, F.col("host"), F.col("path"))
    text = F.when(F.col("_url").contains("://"), F.concat("host", "path")).otherwise(F.coalesce("_url", F.lit("")))
    rows = rows.withColumn("_seen", text)
    rows = rows.select(key, "host", "path", rule.alias("rule"), ruled.alias("_ruled"), "_seen")
    hashing = Hashing(order, 64)
    labelled = rows.filter(F.col("_ruled").isNotNull()).withColumn("accepted", F.col("_ruled") == ALLOW)
    held = F.crc32("_seen") % 5 == 0
    table = stored(_count(labelled.filter(~held).select("_seen", "accepted"), hashing))
    cut = None
    total = table.agg(F.sum(ALLOW), F.sum(BLOCK)).first()
    if total[0] and total[1]:
        cut = calibrated_cut(scored(labelled.filter(held).select("_seen", "accepted"), "_seen", table, hashing, smooth))
    out = scored(rows, "_seen", table, hashing, smooth)
    judged = F.lit(ALLOW) if cut is None else F.when(F.col("score") >= cut, ALLOW).otherwise(BLOCK)
    return out.select(key, "host", "path", "rule", F.coalesce("_ruled", judged).alias("verdict"), "score")
