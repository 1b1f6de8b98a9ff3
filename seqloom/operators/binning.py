"""Item attributes to small integer levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import digitize
from ..runtime import broadcast_if_small
from .sessions import ordered_index


def outside(col: str, lo: float, hi: float) -> Column:
    """True for null, NaN and values out of range."""
    c = F.col(col).cast("double")
    return c.isNull() | F.isnan(c) | (c < lo) | (c > hi)


def bin_edges(df: DataFrame, col: str, lo: float, hi: float, min_obs: int, split: float) -> list[float]:
    """Edges ``lo + k * split``, added one at a time while walking the values in order.

    A value may add at most one edge, the next one, if it lies above it; edges that would be added
    by one of the first ``min_obs + 1`` values are skipped.  Only the grid cell of a value matters,
    so the values are first counted per cell: the ordered part works on at most
    ``(hi - lo) / split`` rows, however long the table is.
    """
    cell = F.greatest(F.lit(0), F.ceil((F.col(col).cast("double") - lo) / split) - 1)
    cells = df.where(~outside(col, lo, hi)).groupBy(cell.cast("bigint").alias("b")).count()
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (F.sum("count").over(w) - 1).alias("last")
    low = F.min(F.col("b") - F.col("last")).over(w)
    done = F.least(F.col("last") + 1, F.col("last") + low)
    steps = cells.select("b", "count", last).withColumn("done", done)
    before = F.coalesce(F.lag("done").over(Window.orderBy("b")), F.lit(0))
    steps = steps.withColumn("before", before).where(F.col("done") > F.col("before"))
    step = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("done") - F.col("before") - 1)).alias("d")
    first = F.col("last") - F.col("count") + 1
    edges = steps.select("before", first.alias("first"), step).where(
        F.col("first") + F.col("d") > min_obs
    )
    edges = edges.select((F.lit(lo) + (F.col("before") + F.col("d") + 1) * F.lit(split)).alias("e"))
    return [r["e"] for r in edges.orderBy("e").collect()]


def bin_numeric(
    df: DataFrame, col: str, lo: float, hi: float, min_obs: int, split: float, out: str
) -> DataFrame:
    """Level of a numeric attribute; null, NaN and out-of-range values get a level of their own."""
    edges = bin_edges(df, col, lo, hi, min_obs, split)
    level = F.when(outside(col, lo, hi), len(edges) + 1).otherwise(
        digitize(F.col(col).cast("double"), edges)
    )
    return df.withColumn(out, level.cast("int"))


def category_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.upper(col).alias("category")).count()


def category_levels(df: DataFrame, col: str, min_obs: int) -> DataFrame:
    """Categories with at least ``min_obs`` rows, numbered by falling frequency."""
    common = category_counts(df, col).where(F.col("category").isNotNull() & (F.col("count") >= min_obs))
    out = ordered_index(common, [F.desc("count"), "category"], "level")
    return out.withColumn("level", F.col("level").cast("int"))


def encode_category(df: DataFrame, col: str, min_obs: int, out: str) -> DataFrame:
    """Level of a category; null and rare values share the level after the last one."""
    levels = category_levels(df, col, min_obs)
    rest = levels.count()
    coded = levels.select(F.col("category").alias("_c"), F.col("level").alias(out))
    joined = df.withColumn("_c", F.upper(col)).join(broadcast_if_small(coded), "_c", "left").drop("_c")
    return joined.withColumn(out, F.coalesce(out, F.lit(rest)).cast("int"))
