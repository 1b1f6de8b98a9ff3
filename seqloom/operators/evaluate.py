"""Popularity baselines, held-out likelihood, curves and comparisons, as tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import label, top_positions
from ..runtime import broadcast_if_small, settle, stored
from . import em, estep, states
from .model import Model, emission_long, matrix_table
from .sessions import SEQ, ordered_index
from .vectors import constants, lists, matrix, vector_total

# ---- popularity -------------------------------------------------------------------------------


def popularity(seq: DataFrame, item_dim: DataFrame | None = None) -> DataFrame:
    """Clicks per item; with a dictionary, items never clicked are kept with 0."""
    counts = seq.groupBy("item_ix").agg(F.sum("n").cast("bigint").alias("clicks"))
    if item_dim is None:
        return counts
    return item_dim.select("item_ix").join(counts, "item_ix", "left").select(
        "item_ix", F.coalesce("clicks", F.lit(0)).cast("bigint").alias("clicks")
    )


def smoothed_popularity(pop: DataFrame, add: float = 2.0, normalised: bool = True) -> DataFrame:
    """``(c + a) / sum(c + a)``, or ``(c + a) / sum(c)`` which does not sum to 1."""
    pop = settle(pop)  # one row per item; read for the total and by whoever uses the shares
    weight = F.col("clicks") + F.lit(float(add))
    total = pop.agg(F.sum(weight if normalised else F.col("clicks").cast("double"))).first()[0]
    return pop.select("item_ix", "clicks", (weight / F.lit(total)).alias("p"))


def baseline_log_lik(seq: DataFrame, shares: DataFrame, by: list[str]) -> DataFrame:
    """``sum n ln p`` of the popularity baseline per group."""
    rows = seq.join(broadcast_if_small(shares.select("item_ix", "p")), "item_ix")
    return rows.groupBy(*by).agg(
        F.sum(F.col("n") * F.ln("p")).alias("log_lik"), F.sum("n").cast("bigint").alias("clicks")
    )


def rolling_mean(df: DataFrame, order: list, value: str, width: int, block: int = 100_000) -> DataFrame:
    """Centred rolling mean along a total order of the whole table; null unless the frame is full.

    Rows get a dense rank first; every block of ranks is then computed on its own, with ``width``
    rows of its neighbours copied in.
    """
    lo, hi = width // 2, width - width // 2 - 1
    ranked = ordered_index(df, order, "_ix")
    own = F.floor(F.col("_ix") / block)
    reach = F.sequence(F.floor((F.col("_ix") - hi) / block), F.floor((F.col("_ix") + lo) / block))
    spread = ranked.withColumn("_own", own).withColumn("_b", F.explode(reach))
    w = Window.partitionBy("_b").orderBy("_ix").rowsBetween(-lo, hi)
    full = F.count("*").over(w) == width
    out = spread.withColumn("rolling", F.when(full, F.avg(value).over(w)))
    return out.where(F.col("_b") == F.col("_own")).drop("_b", "_own").withColumnRenamed("_ix", "rank")


# ---- series -----------------------------------------------------------------------------------


def bands(df: DataFrame, by: list[str], value: str, exact: bool = True) -> DataFrame:
    """Median and 10 % / 90 % bands per group.

    The exact, interpolated form keeps a count per distinct value of a group; ``exact=False`` keeps a sketch of bounded
    size, for columns with very many distinct values.
    """
    points = F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))
    q = F.percentile(value, points) if exact else F.percentile_approx(value, points, 10_000)
    return df.groupBy(*by).agg(q.alias("_q")).select(
        *by, F.col("_q")[0].alias("p10"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p90")
    )


def quantile_grid(df: DataFrame, value: str, grid: list[float], exact: bool = True) -> DataFrame:
    """Quantiles of one column, one row per grid point.

    The exact form keeps a count per distinct value, which suits counts; use ``exact=False`` for
    columns with very many distinct values.
    """
    points = F.array(*[F.lit(g) for g in grid])
    q = F.percentile(value, points) if exact else F.percentile_approx(value, points, 10_000)
    points = F.arrays_zip(F.array(*[F.lit(g) for g in grid]).alias("q"), F.col("v"))
    return df.agg(q.alias("v")).select(F.explode(points).alias("p")).select(
        F.col("p.q").alias("q"), F.col("p.v").alias("value")
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Fixed-width bins between the smallest and largest value; the top edge is closed."""
    lo, hi = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    at = F.floor((F.col(value) - F.lit(lo)) * bins / F.lit(hi - lo)) if hi is not None and hi > lo else F.lit(0)
    slot = F.least(F.lit(bins - 1), at)
    return df.where(F.col(value).isNotNull()).groupBy(slot.cast("int").alias("bin")).agg(F.count("*").alias("rows"))


def scale_to_ends(df: DataFrame, by: list[str], x: str, value: str) -> DataFrame:
    """Series shifted and scaled so that its first value is 0 and its last one is 1.

    First and last come from one combined aggregate per series, joined back.
    """
    ends = df.groupBy(*by).agg(F.min_by(value, x).alias("_f"), F.max_by(value, x).alias("_l"))
    scaled = F.try_divide(F.col(value) - F.col("_f"), F.col("_l") - F.col("_f"))
    return df.join(ends, by).select(*by, x, value, scaled.alias("scaled"))


def difference(series: DataFrame, name_col: str, reference: str, x: str, value: str) -> DataFrame:
    """Every series minus the reference series at the same x."""
    ref = series.where(F.col(name_col) == reference).select(x, F.col(value).alias("_r"))
    rest = series.where(F.col(name_col) != reference)
    return rest.join(ref, x).select(name_col, x, (F.col(value) - F.col("_r")).alias("diff"))


def cut_at_zero(df: DataFrame, by: list[str], x: str, value: str) -> DataFrame:
    """Series up to (not including) its first zero, without its first element."""
    ends = df.groupBy(*by).agg(
        F.min(x).alias("_first"), F.min(F.when(F.col(value) == 0, F.col(x))).alias("_zero")
    )
    out = df.join(ends, by)
    return out.where(
        (F.col(x) > F.col("_first")) & (F.col("_zero").isNull() | (F.col(x) < F.col("_zero")))
    ).drop("_first", "_zero")


def click_through(df: DataFrame, by: list[str]) -> DataFrame:
    """Shown, clicked and their ratio per group."""
    return df.groupBy(*by).agg(
        F.sum("in_screen").alias("shown"),
        F.sum("clicks").alias("clicked"),
        F.try_divide(F.sum("clicks"), F.sum("in_screen")).alias("ctr"),
    )


def compare_models(dashboard: DataFrame, switch: int, models: list[str]) -> DataFrame:
    """Click-through rate of the given models after the switch time (epoch seconds) and up to it."""
    period = F.when(F.col("ts") > switch, "after").otherwise("before")
    rows = dashboard.where(F.col("model").isin(models)).withColumn("period", period)
    return click_through(rows, ["model", "period"])


# ---- likelihood studies -------------------------------------------------------------------------


def long_sequences(seq: DataFrame, longer_than: int, groups: int | None = None) -> DataFrame:
    """Sequences of more than ``longer_than`` positions, at most the first ``groups`` lengths."""
    sizes = seq.groupBy(*SEQ).agg((F.max("t") + 1).alias("len")).where(F.col("len") > longer_than)
    if groups is not None:
        lengths = sizes.select("len").distinct().orderBy("len").limit(groups)
        sizes = sizes.join(F.broadcast(lengths), "len")
    return sizes.select(*SEQ, "len")


def history_curve(seq: DataFrame, model: Model, lengths: list[int]) -> DataFrame:
    """Log-likelihood of the last position of all sequences, knowing its last n items only.

    All lengths run as one job: each (sequence, n) is a sequence of its own.  Lengths that cover a
    sequence as a whole give one result, so only the shortest of them runs and counts for all.
    """
    lengths = sorted(lengths)
    grid = F.array(*[F.lit(n) for n in lengths])
    tries = F.explode(
        F.array(
            *[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"), F.lit(m).alias("m"))
              for i, (n, m) in enumerate(zip(lengths, [0, *lengths]))]
        )
    ).alias("try")
    size = seq.groupBy(*SEQ).agg((F.max("t") + 1).alias("len"))
    runs = size.select(*SEQ, "len", tries).where(F.col("try.m") < F.col("len"))
    whole = (F.col("try.n") >= F.col("len")).cast("int")
    run = ((F.col("chunk") * len(lengths) + F.col("try.i")) * 2 + whole).cast("int")
    start = F.greatest(F.lit(0), F.col("len") - F.col("try.n"))
    keyed = seq.join(runs, SEQ).where(F.col("t") >= start)
    keyed = keyed.select("user_id", run.alias("chunk"), (F.col("t") - start).alias("t"), "item_ix", "n")
    rows = estep.next_state(estep.sequences(keyed), model)
    index = (F.floor(F.col("chunk") / 2) % len(lengths)).cast("int")
    covered = F.when(F.col("chunk") % 2 == 1, F.slice(grid, index + 1, F.lit(len(lengths)))).otherwise(
        F.slice(grid, index + 1, F.lit(1))
    )
    return rows.select("log_c", F.explode(covered).alias("last_n")).groupBy("last_n").agg(
        F.sum("log_c").alias("log_lik"), F.count("*").alias("sequences")
    )


def by_split(seq: DataFrame, test: Column, validation: Column | None = None) -> DataFrame:
    """Rows with their ``split``: test, validation if asked for, else train."""
    split = F.when(test, "test")
    if validation is not None:
        split = split.when(validation, "validation")
    return seq.withColumn("split", split.otherwise("train"))


def total_log_lik(seq: DataFrame, models: list[Model]) -> list[float]:
    rows = estep.log_likelihood(estep.sequences(seq), models).groupBy("restart")
    found = {r["restart"]: r["s"] for r in rows.agg(F.sum("log_lik").alias("s")).collect()}
    return [found[i] for i in range(len(models))]


def held_out(
    seq: DataFrame,
    item_dim: DataFrame,
    k: int,
    prior: em.Prior,
    seeds: list[int],
    max_iter: int,
    tol: float = 0.0,
) -> DataFrame:
    """Fit on the train split from several starts; likelihood on both splits next to the baseline."""
    spark = seq.sparkSession
    train = seq.where(F.col("split") == "train")
    starts = [em.random_model(item_dim, k, prior, s) for s in seeds]
    models = em.fit(estep.sequences(train), starts, prior, max_iter, tol)
    shares = smoothed_popularity(popularity(train, item_dim))
    base = {r["split"]: r["log_lik"] for r in baseline_log_lik(seq, shares, ["split"]).collect()}
    test = seq.where(F.col("split") == "test")
    lik = {"train": total_log_lik(train, models), "test": total_log_lik(test, models)}
    rows = [
        (s, split, float(lik[split][i]), float(base[split]))
        for i, s in enumerate(seeds)
        for split in ("train", "test")
    ]
    return spark.createDataFrame(rows, "seed int, split string, fitted double, baseline double")


def grid_study(
    seq: DataFrame,
    item_dim: DataFrame,
    configs: list[dict],
    prior: em.Prior,
    max_iter: int,
    sink: Callable[[DataFrame], None],
    tol: float = 0.0,
) -> None:
    """Held-out study over a grid of state counts and user shares; results are handed to ``sink``.

    A share below 1 keeps a fixed hash sample of users, as the studied quantity is the data size.
    """
    for c in configs:
        rows = seq
        if c.get("share", 1.0) < 1:
            slot = F.pmod(F.xxhash64("user_id"), F.lit(1000))
            rows = seq.where(slot < int(c["share"] * 1000))
        out = held_out(rows, item_dim, c["states"], prior, c.get("seeds", [0]), max_iter, tol)
        sink(out.select(F.lit(c["states"]).alias("states"), F.lit(float(c.get("share", 1.0))).alias("share"), "*"))


def entropy_starts(
    item_dim: DataFrame, k: int, prior: em.Prior, seed: int, known: Model | None = None, top: int = 15
) -> dict[str, Model]:
    """Start values of three kinds: near-flat, peaked at random, peaked at a known model's items.

    Peaked: a fiftieth of the items, picked by hash, holds 95 % of a state's prior mass.
    """
    items = item_dim.select("item_ix")
    low, share, mass = 2.0, 0.02, 0.95
    high = low * (mass / share) / ((1 - mass) / (1 - share))
    picked = [F.pmod(F.xxhash64(F.lit(seed), F.lit(s), "item_ix"), F.lit(50)) == 0 for s in range(k)]
    peaked = F.array(*[F.when(p, high).otherwise(low) for p in picked])
    flat = em.Prior(prior.pi, prior.trans, prior.emis + 10, prior.diag)
    out = {
        "flat": em.random_model(items, k, flat, seed),
        "peaked": em.random_model(items, k, prior, seed, peaked),
    }
    if known is not None:
        best = top_items(known.emis, top).groupBy("item_ix").agg(F.collect_set("state").alias("_s"))
        smallest = emission_long(known.emis).where("v > 0").agg(F.min("v")).first()[0]
        boost = F.transform(
            "vec",
            lambda v, s: F.when(F.coalesce(F.array_contains("_s", s), F.lit(False)), v * (4 / smallest)).otherwise(low),
        )
        base = known.emis.join(best, "item_ix", "left")
        out["known"] = em.random_model(base, k, prior, seed, boost)
    return out


def entropy_trace(seqs, starts: dict[str, Model], prior: em.Prior, rounds: int, tol: float = 0.0) -> DataFrame:
    """State entropies before the fit and after every round a start still takes, for all kinds of start at once."""
    names = list(starts)
    rows = []

    def note(it, models):
        for name, m in zip(names, models):
            if len(m.history) == it + 1:  # a fit that has ended keeps its last round
                for r in states.entropy(m.emis).collect():
                    rows.append((name, it + 1, int(r["state"]), float(r["entropy"])))

    note(-1, list(starts.values()))
    em.fit(seqs, list(starts.values()), prior, rounds, tol, on_round=note)
    spark = seqs.df.sparkSession
    return spark.createDataFrame(rows, "start string, iter int, state int, entropy double")


# ---- model views --------------------------------------------------------------------------------


def top_items(emis: DataFrame, n: int) -> DataFrame:
    """Most likely items per state.  The rank filter is applied before the shuffle as well."""
    w = Window.partitionBy("state").orderBy(F.desc_nulls_last(F.round(F.ln("v"), 11)), "item_ix")
    return emission_long(emis).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def session_trace(
    seqs, model: Model, items: DataFrame, n_states: int, n_items: int = 0, wanted: dict[str, Column] | None = None
) -> DataFrame:
    """State probabilities per position with the item's label and the strongest states.

    ``wanted`` names columns over the state probabilities to return in their place, so that only those meet the labels.
    """
    post = estep.posterior(seqs, model)
    names = items.select("item_ix", label(F.col("make"), F.col("model")).alias("item_label"))
    best = F.transform(top_positions(F.col("filt"), n_states), lambda s: s["state"])
    post = post.withColumn("top_states", best)
    if wanted is not None:
        post = post.select(*SEQ, "t", "item_ix", *[c.alias(name) for name, c in wanted.items()])
    return post.join(broadcast_if_small(names), "item_ix", "left")


def compare_transitions(spark: SparkSession, fitted: np.ndarray, seen: np.ndarray) -> DataFrame:
    """Fitted and re-estimated transition probabilities side by side."""
    a = matrix_table(spark, fitted).withColumnRenamed("p", "fitted")
    b = matrix_table(spark, seen).withColumnRenamed("p", "observed")
    return a.join(b, ["i", "j"]).withColumn("diagonal", F.col("i") == F.col("j"))


# ---- spline regression ----------------------------------------------------------------------------


def _spline_columns(x: Column, knots: list[float]) -> list[Column]:
    """Natural cubic spline basis (linear beyond the outer knots), without the constant."""
    last = knots[-1]

    def cube(k):
        return F.pow(F.greatest(F.lit(0.0), x - F.lit(k)), F.lit(3.0))

    def d(k):
        return (cube(k) - cube(last)) / F.lit(last - k)

    return [x, *[d(k) - d(knots[-2]) for k in knots[:-2]]]


def spline_fit(df: DataFrame, x: str, y: str, grid: list[float], df_spline: int = 5) -> DataFrame:
    """Least-squares natural spline of y on x, predicted on a grid.

    Knots: the ends and equally spaced quantiles of the distinct x values.
    """
    levels = [i / (df_spline - 1) for i in range(df_spline)]
    # read for the knots and for the fit
    pairs = stored(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    distinct = pairs.select("x").distinct()
    knots = distinct.agg(F.percentile("x", F.array(*[F.lit(q) for q in levels]))).first()[0]

    columns = _spline_columns(F.col("x"), knots)
    row = F.array(F.lit(1.0), *columns)
    data = pairs.where("x IS NOT NULL AND y IS NOT NULL")
    beta = least_squares(data.select(row.alias("row"), "y"))
    points = df.sparkSession.createDataFrame([(float(g),) for g in grid], "x double")
    terms = F.zip_with(row, constants(beta), lambda a, b: a * b)
    return points.select("x", F.aggregate(terms, F.lit(0.0), lambda s, t: s + t).alias("prediction"))


def least_squares(rows: DataFrame) -> np.ndarray:
    """Coefficients of ``y`` on the design ``row`` by normal equations.

    A task turns its rows into one matrix of products of all columns; only those are summed.  Columns are scaled to
    length 1 before the equations are solved; columns that depend on others get the smallest coefficients.
    """

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                m = np.c_[matrix(b.column("row")), b.column("y").to_numpy()]
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pa.RecordBatch.from_arrays([lists(total.reshape(1, -1))], names=["vec"])

    found = vector_total(rows.select("row", "y").mapInArrow(run, "vec array<double>"), summed=True)
    if found is None:
        raise ValueError("no rows to fit")
    size = int(round(np.sqrt(len(found))))
    gram, right = np.split(found.reshape(size, size)[:-1], [size - 1], axis=1)
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    return np.linalg.lstsq(gram / np.outer(scale, scale), right[:, 0] / scale, rcond=1e-14)[0] / scale


def restart_transitions(truth: DataFrame, models: list[Model]) -> DataFrame:
    """``restart``, ``i``, ``j``, ``p``: transitions of each fit, states matched one to one with the reference's."""
    rows = []
    for r, m in enumerate(models):
        trans = states.relabel(m, truth, one_to_one=True).trans
        rows += [(r, i, j, float(p)) for (i, j), p in np.ndenumerate(trans)]
    return truth.sparkSession.createDataFrame(rows, "restart int, i int, j int, p double")
