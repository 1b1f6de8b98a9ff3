"""Model steps as set operations on long tables ``(keys..., state, p)``, one row per state.

These are the one-step forms for whole tables of users; `estep` chains the steps per sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .model import gather


def _log(v):
    return F.when(v > 0, F.ln(v)).otherwise(F.lit(float("-inf")))


def session_log_lik(seq: DataFrame, emis: DataFrame, keys: list[str]) -> DataFrame:
    """``sum n ln V[state, item]`` per key and state, combined before the shuffle.

    A key is one row with K sums up to the end, so rows are K times fewer on the way, and what groups by ``keys`` next
    finds them together.
    """
    head = emis.select(F.size("vec").alias("k")).first()
    states = range(head["k"] if head else 0)
    rows = gather(seq, emis).where(F.col("vec").isNotNull())
    sums = rows.groupBy(*keys).agg(F.count("*"), *[F.sum(F.col("n") * _log(F.col("vec")[k])).alias(f"_{k}") for k in states])
    each = F.array(*[F.col(f"_{k}") for k in states]).cast("array<double>")
    return sums.select(*keys, F.posexplode(each).alias("state", "log_f"))


def item_log_lik(seq: DataFrame, emis: DataFrame, keys: list[str]) -> DataFrame:
    """``ln V[state, item]`` per click and state."""
    rows = gather(seq, emis).select(*keys, F.posexplode("vec").alias("state", "v"))
    return rows.select(*keys, "state", _log(F.col("v")).alias("log_f"))


def log_normalise(rows: DataFrame, keys: list[str], value: str = "log_f") -> DataFrame:
    """``exp(value)`` scaled to sum 1 per key (K rows each), with the log of the scale."""
    w = Window.partitionBy(*keys)
    top = rows.withColumn("_m", F.max(value).over(w))
    mass = top.withColumn("_e", F.exp(F.col(value) - F.col("_m")))
    return mass.withColumn("_z", F.sum("_e").over(w)).select(
        *keys, "state", (F.col("_e") / F.col("_z")).alias("q"), (F.col("_m") + F.ln("_z")).alias("log_c")
    )


def update(prior: DataFrame, log_f: DataFrame, keys: list[str]) -> DataFrame:
    """Filtered state from predicted ``p`` and evidence ``log_f``."""
    both = prior.join(log_f, [*keys, "state"])
    return log_normalise(both.withColumn("x", F.ln("p") + F.col("log_f")), keys, "x")


def predict(rows: DataFrame, trans: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted state ``q A``; the transition table has K x K rows and is broadcast."""
    return (
        rows.join(F.broadcast(trans.select(F.col("i").alias("state"), "j", F.col("p").alias("a"))), "state")
        .groupBy(*keys, F.col("j").alias("state"))
        .agg(F.sum(F.col("q") * F.col("a")).alias("p"))
    )


def backward(q: DataFrame, p: DataFrame, g_next: DataFrame, trans: DataFrame, keys: list[str]) -> DataFrame:
    """Smoothed state from filtered ``q``, predicted ``p`` and the next smoothed ``g``; 0/0 = 0."""
    ahead = p.join(g_next, [*keys, "state"]).select(
        *keys, F.col("state").alias("j"), F.coalesce(F.try_divide("g", "p"), F.lit(0.0)).alias("r")
    )
    back = (
        ahead.join(F.broadcast(trans.select("i", "j", F.col("p").alias("a"))), "j")
        .groupBy(*keys, F.col("i").alias("state"))
        .agg(F.sum(F.col("a") * F.col("r")).alias("b"))
    )
    return q.join(back, [*keys, "state"]).select(*keys, "state", (F.col("q") * F.col("b")).alias("g"))


def initial(keys: DataFrame, pi) -> DataFrame:
    """The initial state for every key row (K rows per key)."""
    return keys.select("*", F.posexplode(F.array(*[F.lit(float(x)) for x in pi])).alias("state", "p"))
