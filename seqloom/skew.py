"""Windows over a key that may hold a third of all rows.

A plain window puts all rows of a key into one task.  Here the few keys that are too big are cut
into blocks along their order column, windows run per (key, block), and what has to cross a block
edge (last value, running total, total) is carried over through a table with one row per block.
Keys that are not hot keep one block, so data without hot keys runs the plain window plan.

Sizes: with ``target`` rows per block, at most ``rows / target`` keys are hot and they have at most
``2 * rows / target`` blocks.  ``target`` never falls below ``rows / 8192``, hence at most 16,384
blocks: that is what makes the broadcasts below safe for any data size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLK = "_blk"
MAX_BLOCKS = 8192
GRID = 1024
STRIDE = 32
DEFAULT_ROWS = 5_000_000


@dataclass
class Blocks:
    """Block edges of the hot keys; ``edges`` is None when no key is hot."""

    keys: list[str]
    edges: DataFrame | None

    @property
    def hot(self) -> bool:
        return self.edges is not None

    def assign(self, df: DataFrame, order: Column) -> DataFrame:
        """Add the block number: -1 for keys that stay whole, 0.. along ``order`` for hot keys."""
        if not self.hot:
            return df.withColumn(BLK, F.lit(-1))
        x = order.cast("long")
        head = F.size(F.filter("_heads", lambda v: v < x))
        start = (head - 1) * STRIDE
        inner = F.size(F.filter(F.slice("_edges", start + 1, STRIDE), lambda v: v < x))
        block = (
            F.when(F.col("_edges").isNull(), -1).when(head == 0, 0).otherwise(start + inner)
        )
        return (
            df.join(F.broadcast(self.edges), self.keys, "left")
            .withColumn(BLK, block.cast("int"))
            .drop("_edges", "_heads")
        )

    def window(self, *order: Column | str) -> Window:
        spec = Window.partitionBy(*self.keys, BLK) if self.hot else Window.partitionBy(*self.keys)
        return spec.orderBy(*order) if order else spec

    def carried(self, df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
        """One row per block of the hot keys with the given aggregates, smallest first."""
        return (
            df.where(F.col(BLK) >= 0)
            .groupBy(*self.keys, BLK)
            .agg(*[c.alias(n) for n, c in aggs.items()])
        )


def find_blocks(df: DataFrame, keys: list[str], order: Column, rows: int | None = None) -> Blocks:
    """Find hot keys with one pre-aggregated count and cut them at quantiles of ``order``."""
    rows = rows or DEFAULT_ROWS
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    top = counts.agg(F.max("_n").alias("top"), F.sum("_n").alias("total")).first()
    if top.top is None or top.top <= rows:
        return Blocks(keys, None)
    target = max(rows, -(-top.total // MAX_BLOCKS))
    hot = counts.where(F.col("_n") > target)
    if top.top <= target:
        return Blocks(keys, None)
    grid = [i / GRID for i in range(1, GRID)]
    found = (
        df.join(F.broadcast(hot), keys, "left_semi")
        .groupBy(*keys)
        .agg(
            F.count("*").alias("_n"),
            F.percentile_approx(order.cast("long"), grid, 20_000).alias("_edges"),
        )
        .collect()
    )
    rows_out = []
    for r in found:
        blocks = min(GRID, -(-r["_n"] // target))
        cuts = sorted({r["_edges"][(i * GRID) // blocks - 1] for i in range(1, blocks)})
        if cuts:
            rows_out.append((*[r[k] for k in keys], cuts, cuts[::STRIDE]))
    if not rows_out:
        return Blocks(keys, None)
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    schema += ", _edges array<bigint>, _heads array<bigint>"
    return Blocks(keys, df.sparkSession.createDataFrame(rows_out, schema))


def _attach(df: DataFrame, blocks: Blocks, carry: DataFrame) -> DataFrame:
    return df.join(F.broadcast(carry), [*blocks.keys, BLK], "left")


def previous(df: DataFrame, blocks: Blocks, order: str, values: list[str], prefix: str) -> DataFrame:
    """``lag`` of the value columns along a unique-per-key order, across block edges."""
    w = blocks.window(order)
    out = df.select("*", *[F.lag(v).over(w).alias(prefix + v) for v in values])
    if not blocks.hot:
        return out
    last = blocks.carried(df, {"_l_" + v: F.max_by(v, order) for v in values})
    edge = Window.partitionBy(*blocks.keys).orderBy(BLK)
    last = last.select(
        *blocks.keys, BLK, *[F.lag("_l_" + v).over(edge).alias("_p_" + v) for v in values]
    )
    out = _attach(out, blocks, last)
    for v in values:
        out = out.withColumn(prefix + v, F.coalesce(prefix + v, "_p_" + v))
    return out.drop(*["_p_" + v for v in values])


def totals(
    df: DataFrame, blocks: Blocks, aggs: dict[str, Column], order: str | None = None
) -> DataFrame:
    """Sums or counts over all rows of a key, on every row.

    Naming the order of the windows that follow lets all of them share one sort.
    """
    w = blocks.window(order) if order else blocks.window()
    w = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.select("*", *[c.over(w).alias(n) for n, c in aggs.items()])
    if not blocks.hot:
        return out
    per_block = blocks.carried(df, {"_t_" + n: c for n, c in aggs.items()})
    edge = Window.partitionBy(*blocks.keys)
    per_block = per_block.select(
        *blocks.keys, BLK, *[F.sum("_t_" + n).over(edge).alias("_s_" + n) for n in aggs]
    )
    out = _attach(out, blocks, per_block)
    for n in aggs:
        out = out.withColumn(n, F.coalesce("_s_" + n, n))
    return out.drop(*["_s_" + n for n in aggs])


def position(df: DataFrame, blocks: Blocks, order: str | list[str], name: str) -> DataFrame:
    """0-based position of a row in its key; the first order column is the one the blocks cut."""
    order = [order] if isinstance(order, str) else order
    return _numbered(df, blocks, order, F.row_number(), F.count("*"), name)


def rank(df: DataFrame, blocks: Blocks, order: str, name: str) -> DataFrame:
    """0-based rank of a row's ``order`` value among those of its key; blocks never part equal values."""
    return _numbered(df, blocks, [order], F.dense_rank(), F.count_distinct(order), name)


def _numbered(df: DataFrame, blocks: Blocks, order: list[str], number: Column, size: Column, name: str) -> DataFrame:
    w = blocks.window(*order)
    out = df.withColumn(name, (number.over(w) - 1).cast("long"))
    if not blocks.hot:
        return out
    before = Window.partitionBy(*blocks.keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.carried(df, {"_b": size})
    carry = carry.select(*blocks.keys, BLK, F.sum("_b").over(before).alias("_off"))
    out = _attach(out, blocks, carry)
    return out.withColumn(name, F.col(name) + F.coalesce("_off", F.lit(0))).drop("_off")
