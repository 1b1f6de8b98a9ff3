"""Column expressions; everything here is built from JVM functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digitize(x: Column, edges: list[float]) -> Column:
    """Number of edges at or below ``x`` (left-closed bins)."""
    if not edges:
        return F.lit(0)
    grid = F.array(*[F.lit(float(e)) for e in edges])
    return F.size(F.filter(grid, lambda e: e <= x))


def top_positions(vec: Column, n: int) -> Column:
    """The ``n`` largest entries as ``struct(state, p)``; equal ones by position."""
    pairs = F.transform(vec, lambda v, i: F.struct((-v).alias("neg"), i.alias("state"), v.alias("p")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda s: F.struct(s["state"], s["p"]))


def neg_xlogx(v: Column) -> Column:
    """``-v ln v`` with 0 ln 0 = 0."""
    return F.when(v > 0, -v * F.ln(v)).otherwise(0.0)


def label(make: Column, model: Column) -> Column:
    return F.concat_ws(": ", make, model)


def pseudo_user(user: Column, chunk: Column) -> Column:
    return F.concat_ws("-", user.cast("string"), chunk.cast("string"))


def pair_lists(items: Column, counts: Column) -> Column:
    return F.array(items, counts)
