"""Requests to next-state vectors, item scores and top-n lists."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import top_positions
from ..runtime import broadcast_if_small, settle
from .estep import next_state, sequences
from .model import DENSE_LIMIT, VEC, Model, vectors_side
from .vectors import lists, matrix

TIE_BITS = 40  # scores that agree in this many leading bits are ties
REQUEST_ROWS = 50_000
#: Catalogues of more items, and of few states, are first reduced to the items that can be among the best of any request.
PRUNE_ITEMS, PRUNE_STATES = 4096, 16
PIVOTS, PRUNE_SLICE = 2048, 50_000
SCORE_SCHEMA = "request_id bigint, item_ix int, score double, tie double"
SCORE_NAMES = ["request_id", "item_ix", "score", "tie"]


def request_rows(requests: DataFrame) -> DataFrame:
    """Requests with an array ``history`` as rows ``(request_id, pos, item_id)``."""
    return requests.select("request_id", F.posexplode("history").alias("pos", "item_id"))


def known_history(rows: DataFrame, item_dim: DataFrame) -> DataFrame:
    """Request rows as positions of the model; unknown items are dropped.

    The gaps they leave need no renumbering: only the order of positions counts.
    """
    return rows.join(broadcast_if_small(item_dim), "item_id").select(
        F.col("request_id").alias("user_id"),
        F.lit(0).alias("chunk"),
        F.col("pos").cast("bigint").alias("t"),
        "item_ix",
        F.lit(1).alias("n"),
    )


def request_states(rows: DataFrame, item_dim: DataFrame, model: Model) -> DataFrame:
    """Next-state vector per request; requests without a known item give no row."""
    nxt = next_state(sequences(known_history(rows, item_dim)), model)
    return nxt.select(F.col("user_id").alias("request_id"), F.col("next").alias("q"))


def keep_top(q: np.ndarray, top_states: int | None) -> np.ndarray:
    """All but the strongest states of each row set to 0; equal ones by position."""
    if top_states is None or top_states >= q.shape[1]:
        return q
    out = np.zeros_like(q)
    best = np.argsort(-q, axis=1, kind="stable")[:, :top_states]
    np.put_along_axis(out, best, np.take_along_axis(q, best, axis=1), axis=1)
    return out


def leading_bits(x: np.ndarray) -> np.ndarray:
    """``x`` rounded to its leading bits, so that rounding is as fine for many items as for few."""
    part, power = np.frexp(x)
    return np.ldexp(np.round(np.ldexp(part, TIE_BITS)), power - TIE_BITS)


def _best(q: np.ndarray, v: np.ndarray, items: np.ndarray, n: int):
    """Per row of ``q`` the n best items, score descending, then item."""
    score = q @ v.T
    n = min(n, len(items))
    edge = np.partition(score, len(items) - n, axis=1)[:, len(items) - n, None]
    # rounding moves a score by less than this share of it, so only scores near the edge need be rounded
    row, col = np.nonzero(score >= edge - np.abs(edge) * 2.0 ** (2 - TIE_BITS))
    tie = leading_bits(score[row, col])
    order = np.lexsort((items[col], -tie, row))
    row, col, tie = row[order], col[order], tie[order]
    begin = np.searchsorted(row, np.arange(len(q)))
    keep = np.arange(len(row)) - begin[row] < n
    row, col = row[keep], col[keep]
    return row, items[col], score[row, col], tie[keep]


def _matrix(column, k: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, k)


def _rank_batches(batches, shared, n, top_states):
    items, v = shared.value
    rows = max(1, 4_000_000 // max(1, len(v)))
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            part = b.slice(lo, rows)
            row, *best = _best(keep_top(_matrix(part.column("q"), v.shape[1]), top_states), v, items, n)
            ids = part.column("request_id").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, best)], names=SCORE_NAMES)


def _rank_block(left: pa.Table, right: pa.Table, n: int, k: int, top_states: int) -> pa.Table:
    if left.num_rows == 0 or right.num_rows == 0:
        types = [pa.int64(), pa.int32(), pa.float64(), pa.float64()]
        return pa.table([pa.array([], t) for t in types], names=SCORE_NAMES)
    v = _matrix(right.column("vec").combine_chunks(), k)
    items = right.column("item_ix").to_numpy().astype(np.int32)
    q = keep_top(_matrix(left.column("q").combine_chunks(), k), top_states)
    ids = left.column("request_id").to_numpy()
    rows = max(1, 4_000_000 // len(v))
    out = [(lo, *_best(q[lo : lo + rows], v, items, n)) for lo in range(0, len(q), rows)]
    return pa.table(
        [
            np.concatenate([ids[lo + row] for lo, row, *_ in out]),
            *(np.concatenate([part[c] for part in out]) for c in (2, 3, 4)),
        ],
        names=SCORE_NAMES,
    )


def _beaten(items: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Which items score behind ``n`` others whatever the request; some that do are not found.

    An item is behind one that is nowhere less probable if that has the smaller id, or if it is everywhere more probable
    by more than what makes a tie.  Of a request without any state all scores are 0, so the ``n`` smallest ids stay.
    """
    order = np.lexsort((items, -v.sum(axis=1)))
    items, v = items[order], v[order]
    lost = np.zeros(len(v), bool)
    top, top_ids = v[:0], items[:0]
    for lo in range(0, len(v), 512):
        one, ids = v[lo : lo + 512], items[lo : lo + 512]
        more, more_ids = np.concatenate([top, one]), np.concatenate([top_ids, ids])
        level = more_ids[None, :] < ids[:, None]
        above = np.broadcast_to((more > 0).all(axis=1), level.shape).copy()
        for k in range(v.shape[1]):
            level &= more[None, :, k] >= one[:, None, k]
            above &= more[None, :, k] >= one[:, None, k] * (1 + 2.0 ** (2 - TIE_BITS))
        lost[lo : lo + 512] = (level | above).sum(axis=1) >= n
        good = ~lost[lo : lo + 512]
        top, top_ids = np.concatenate([top, one[good]])[:PIVOTS], np.concatenate([top_ids, ids[good]])[:PIVOTS]
    lost &= ~np.isin(items, np.sort(items)[:n])
    out = np.empty(len(v), bool)
    out[order] = lost
    return out


def contenders(emis: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The items of ``emis`` that can be among the ``n`` best of a request, and how many.

    Slices of items drop what is beaten within them; what is left is dealt to fewer slices, as long as that halves it.
    """

    def prune(batches):
        held, rows = [], 0
        for b in [*batches, None]:
            if b is not None and b.num_rows:
                held.append((b.column("item_ix").to_numpy(), matrix(b.column("vec"))))
                rows += b.num_rows
            if held and (b is None or rows > PRUNE_SLICE):
                ix, v = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                keep = ~_beaten(ix, v, n)
                held, rows = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(ix[keep].astype(np.int32)), lists(v[keep])], names=["item_ix", "vec"])

    rows, before = emis.select("item_ix", "vec"), None
    while True:
        rows = settle(rows.mapInArrow(prune, f"item_ix int, vec {VEC}"))
        left = rows.count()
        if before is not None and (2 * left > before or left <= 2 * n or before <= PRUNE_SLICE):
            return rows, left
        before = left
        rows = rows.repartition(max(1, -(-left // PRUNE_SLICE)))


def recommend(
    states: DataFrame, model: Model, n: int = 10, top_states: int | None = None, item_rows: int | None = None
) -> DataFrame:
    """The ``n`` best items per request, scored over all states or its ``top_states`` strongest ones.

    Scores are never materialised for all pairs: a task multiplies a slice of requests with the
    item matrix and keeps n items per request.  A model too big to copy is cut into item blocks,
    each meeting each block of requests, and the n best of the blocks are merged.  Without a given ``item_rows``, items
    of large catalogues that no request can rank among its n best are left out first (`contenders`).
    """
    # stored, so that a task holds one Python worker, not a second one that still makes the states
    q = settle(states.select("request_id", "q"))
    emis, n_items = model.emis, model.n_items
    pruned = item_rows is None and n_items > PRUNE_ITEMS and model.states <= PRUNE_STATES
    if pruned:
        emis, n_items = contenders(emis, n)
    if n_items * model.states <= DENSE_LIMIT and item_rows is None:
        if pruned or not model.fits:
            found = emis.toArrow().sort_by("item_ix")
            known = found.column("item_ix").to_numpy(), matrix(found.column("vec"))
        else:
            known = model.items, model.dense[model.items]
        shared = q.sparkSession.sparkContext.broadcast(known)
        top = q.mapInArrow(partial(_rank_batches, shared=shared, n=n, top_states=top_states), SCORE_SCHEMA)
    else:
        item_rows = item_rows or max(1, 4_000_000 // model.states)
        item_blocks = -(-n_items // item_rows)
        req_blocks = max(1, -(-q.count() // REQUEST_ROWS))
        spread = lambda n_blocks: F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
        left = q.select(
            "*",
            F.pmod(F.xxhash64("request_id"), F.lit(req_blocks)).cast("int").alias("rb"),
            spread(item_blocks).alias("ib"),
        )
        right = emis.select(
            "item_ix",
            "vec",
            spread(req_blocks).alias("rb"),
            F.pmod(F.xxhash64("item_ix"), F.lit(item_blocks)).cast("int").alias("ib"),
        )
        k = model.states

        def block(a: pa.Table, b: pa.Table) -> pa.Table:
            return _rank_block(a, b, n, k, top_states)

        top = left.groupBy("rb", "ib").cogroup(right.groupBy("rb", "ib")).applyInArrow(block, SCORE_SCHEMA)
    w = Window.partitionBy("request_id").orderBy(F.desc("tie"), "item_ix")
    return top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("tie")


def score_targets(
    states: DataFrame, model: Model, targets: DataFrame, top_states: int | None = None
) -> DataFrame:
    """Scores of given ``(request_id, item_ix)`` pairs only."""
    pairs = targets.join(vectors_side(model.emis), "item_ix").join(states, "request_id")
    score = F.aggregate(
        top_positions(F.col("q"), top_states or model.states),
        F.lit(0.0),
        lambda s, x: s + x["p"] * F.element_at("vec", x["state"] + 1),
    )
    return pairs.select("request_id", "item_ix", score.alias("score"))


def sample_items(weights: DataFrame, n: int, seed: int, by: list[str]) -> DataFrame:
    """Weighted sample of ``n`` items without replacement per group: n smallest exponential keys.

    The draw hashes (seed, row), so it does not change with the partitioning; other engines can repeat it.
    """
    row = F.concat_ws(",", F.lit(seed), *[F.col(c).cast("string") for c in [*by, "item_ix"]])
    cells = F.conv(F.substring(F.md5(row), 1, 13), 16, 10).cast("double")
    unit = (cells + 0.5) / F.lit(float(1 << 52))
    keyed = weights.where(F.col("p") > 0).withColumn("_key", -F.ln(unit) / F.col("p"))
    w = Window.partitionBy(*by).orderBy("_key", "item_ix")
    return keyed.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= n).drop("_key")


