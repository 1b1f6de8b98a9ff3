"""Best items of large catalogues by pruned search: neither all scores nor copies of all requests are made.

Items are put into blocks whose members resemble each other: sorted by the state they are strongest in (against the
state's strongest item), then by that strength.  A block's bound for a request is its score with the block's largest
probability of each state, so no item of the block can score higher.  A request first visits the blocks with the highest
bounds; its n-th best score there is a threshold, and of all other blocks only those whose bound reaches it are visited.

The bounds are sent to all tasks: blocks are made so large that bounds have at most ``BOUND_NUMBERS`` numbers, whatever
the catalogue.  Requests go to blocks as rows (block, request); a block that many requests visit is split by request.
The result is exactly that of scoring everything (`scoring.recommend`), ties included.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import settle
from .model import VEC, Model
from .scoring import REQUEST_ROWS, SCORE_NAMES, SCORE_SCHEMA, TIE_BITS, _rank_block, keep_top
from .vectors import lists, matrix

BOUND_NUMBERS = 4_000_000
BLOCK_ITEMS = 256
#: A bound may be this much too low by rounding, and scores this close are ties.
SLACK = 2.0 ** (2 - TIE_BITS)


@dataclass
class ItemBlocks:
    """``blocks(blk, item_ix, vec)``, and on the driver each block's id, size and largest probability per state."""

    items: DataFrame
    ids: np.ndarray
    sizes: np.ndarray
    tops: np.ndarray

    @property
    def n_items(self) -> int:
        return int(self.sizes.sum())


def item_blocks(model: Model, block_items: int = BLOCK_ITEMS) -> ItemBlocks:
    """Sort the items into blocks; a range exchange, no window over all of them."""
    k = model.states
    block_items = max(block_items, -(-model.n_items * k // BOUND_NUMBERS))
    tops = model.emis.select(F.posexplode("vec").alias("state", "p")).groupBy("state").agg(F.max("p").alias("top")).collect()
    top = np.ones(k)
    for r in tops:
        top[r["state"]] = r["top"] or 1.0
    relative = F.zip_with("vec", F.array(*[F.lit(float(x)) for x in top]), lambda v, t: v / t)
    rows = model.emis.select("item_ix", "vec", F.array_max(relative).alias("_s"), relative.alias("_r"))
    rows = rows.withColumn("_lead", F.array_position("_r", F.col("_s"))).drop("_r")
    order = ["_lead", F.desc("_s"), "item_ix"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        (F.spark_partition_id().cast("long") * (1 << 40)).alias("at"), "item_ix", "vec"
    )

    def number(batches):
        done = 0
        for b in batches:
            if b.num_rows:
                blk = b.column("at").to_numpy() + (done + np.arange(b.num_rows)) // block_items
                done += b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(blk), b.column("item_ix"), b.column("vec")], names=["blk", "item_ix", "vec"])

    rows = settle(rows.mapInArrow(number, f"blk long, item_ix int, vec {VEC}"))
    each = rows.select("blk", "item_ix", F.posexplode("vec").alias("state", "p"))
    found = each.groupBy("blk", "state").agg(F.max("p").alias("p"), F.count("*").alias("n"))
    found = found.groupBy("blk").agg(F.array_sort(F.collect_list(F.struct("state", "p"))).alias("v"), F.first("n").alias("n")).collect()
    return ItemBlocks(
        rows,
        np.array([r["blk"] for r in found], np.int64),
        np.array([r["n"] for r in found], np.int64),
        np.array([[x["p"] for x in r["v"]] for r in found]).reshape(len(found), k),
    )


def _visits(batches, ids, tops, sizes, n, top_states, first):
    """(blk, request_id, q) for the blocks a request has to see: the best ones that hold n items (``first``), or all
    others whose bound reaches the request's threshold."""
    for b in batches:
        step = max(1, 4_000_000 // max(1, len(ids)))
        for lo in range(0, b.num_rows, step):
            part = b.slice(lo, step)
            if not part.num_rows:
                continue
            q = keep_top(matrix(part.column("q")), top_states)
            bound = q @ tops.T
            order = np.argsort(-bound, axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            early = np.empty(bound.shape, bool)
            np.put_along_axis(early, order, np.concatenate([np.zeros((len(q), 1), bool), held[:, :-1] >= n], axis=1), axis=1)
            early = ~early
            if first:
                chosen = early
            else:
                least = part.column("least").to_numpy(zero_copy_only=False)[:, None]
                chosen = ~early & (bound * (1 + SLACK) >= least)
            row, col = np.nonzero(chosen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[col]), part.column("request_id").take(pa.array(row)), part.column("q").take(pa.array(row))],
                names=["blk", "request_id", "q"],
            )


def _scored(visits: DataFrame, blocks: ItemBlocks, k: int, n: int, top_states: int | None) -> DataFrame:
    """The n best items of each visited block for each of its requests."""
    demand = visits.groupBy("blk").agg(F.ceil(F.count("*") / REQUEST_ROWS).cast("int").alias("parts"))
    demand = F.broadcast(settle(demand))  # at most one row per block
    salted = visits.join(demand, "blk").withColumn("part", F.pmod(F.xxhash64("request_id"), F.col("parts").cast("long")).cast("int"))
    held = blocks.items.join(demand, "blk").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        return _rank_block(left, right, n, k, top_states)

    left = salted.select("request_id", "q", "blk", "part")
    right = held.select("item_ix", "vec", "blk", "part")
    return left.groupBy("blk", "part").cogroup(right.groupBy("blk", "part")).applyInArrow(block, SCORE_SCHEMA)


def _best_of(rows: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("request_id").orderBy(F.desc("tie"), "item_ix")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def recommend(states: DataFrame, model: Model, n: int = 10, top_states: int | None = None, blocks: ItemBlocks | None = None) -> DataFrame:
    """As `scoring.recommend`: ``request_id``, ``item_ix``, ``score`` and ``rank`` of the n best items of each request.

    Request ids are unique.  Requests without states give no rows, nor does an empty catalogue.
    """
    return search(states, model, n, top_states, blocks)[0]


def search(states: DataFrame, model: Model, n: int = 10, top_states: int | None = None, blocks: ItemBlocks | None = None):
    """The best items, and a table of one row: ``requests``, ``items``, ``visits`` (blocks seen) and ``touched`` (share
    of all request x item scores that were made)."""
    blocks = blocks or item_blocks(model)
    q = settle(states.select("request_id", "q"))
    shared = dict(ids=blocks.ids, tops=blocks.tops, sizes=blocks.sizes, n=n, top_states=top_states)
    kind = f"blk long, request_id bigint, q {VEC}"
    early = settle(q.mapInArrow(partial(_visits, first=True, **shared), kind))
    found = settle(_best_of(_scored(early, blocks, model.states, n, top_states), n).drop("rank"))
    least = found.groupBy("request_id").agg(F.min("score").alias("s"), F.count("*").alias("c"))
    least = least.select("request_id", F.when(F.col("c") >= n, F.col("s")).otherwise(float("-inf")).alias("least"))
    late = q.join(least, "request_id").mapInArrow(partial(_visits, first=False, **shared), kind)
    late = settle(late)
    both = found.unionByName(_scored(late, blocks, model.states, n, top_states))
    size = q.sparkSession.createDataFrame(
        [(int(b), int(s)) for b, s in zip(blocks.ids, blocks.sizes)], "blk long, size long"
    )
    seen = early.select("blk").unionAll(late.select("blk")).groupBy("blk").agg(F.count("*").alias("c")).join(F.broadcast(size), "blk")
    share = seen.agg(F.sum("c").alias("visits"), F.sum(F.col("c") * F.col("size")).alias("made"))
    share = share.withColumn("requests", F.lit(q.count()).cast("long")).select(
        "requests", F.lit(blocks.n_items).cast("long").alias("items"), F.coalesce("visits", F.lit(0)).alias("visits"),
        (F.coalesce("made", F.lit(0)) / F.greatest(F.col("requests") * F.lit(max(blocks.n_items, 1)), F.lit(1))).alias("touched"),
    )
    return _best_of(both, n).drop("tie"), share
