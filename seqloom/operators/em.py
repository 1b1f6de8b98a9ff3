"""Fitting: priors, start values, M-step, EM loop over Spark jobs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import settle
from . import draws
from . import model as store
from .estep import Sequences, dense_sums, statistics
from .model import DENSE_LIMIT, VEC, Model, normalise_columns, vector_rows
from .vectors import constants, lists, matrix, vector_total


@dataclass(frozen=True)
class Prior:
    """Flat Dirichlet priors, optionally stronger on the diagonal of the transitions."""

    pi: float = 2.0
    trans: float = 2.0
    emis: float = 2.0
    diag: float | None = None

    def matrix(self, k: int) -> np.ndarray:
        m = np.full((k, k), float(self.trans))
        if self.diag is not None:
            np.fill_diagonal(m, self.diag)
        return m


#: First counter of the draws for each part of a model.
PARTS = {"emis": 0, "trans": 1, "pi": 2}


def row_shares(weights: np.ndarray, previous: np.ndarray) -> np.ndarray:
    """Rows scaled to sum 1; a row without mass keeps its previous values."""
    total = weights.sum(axis=-1, keepdims=True)
    return np.where(total > 0, weights / np.where(total > 0, total, 1.0), previous)


def random_model(items: DataFrame, states: int, prior: Prior, seed: int, weight=None) -> Model:
    """Start values: each row drawn from its Dirichlet prior.

    A Dirichlet row is a row of gamma draws scaled to sum 1, so every item draws its own K numbers
    as functions of (seed, part, item, state): independent of the partitioning, and no row of N
    numbers ever sits in one task.  ``weight`` optionally replaces the flat item prior by a column
    of K prior values per item.
    """
    k = states
    row, col = np.arange(k)[:, None], np.arange(k)[None, :]
    trans = draws.gamma(prior.matrix(k), seed, PARTS["trans"], row, col)
    pi = draws.gamma(np.full(k, float(prior.pi)), seed, PARTS["pi"], 0, np.arange(k))
    pi, trans = row_shares(pi, np.full(k, 1 / k)), row_shares(trans, np.full((k, k), 1 / k))
    source = items.select("item_ix", (weight if weight is not None else F.array(
        *[F.lit(float(prior.emis))] * k)).alias("w"))

    def draw(batches):
        for b in batches:
            if b.num_rows:
                ix = b.column("item_ix").to_numpy()[:, None]
                vec = draws.gamma(matrix(b.column("w")), seed, PARTS["emis"], ix, col)
                yield pa.RecordBatch.from_arrays([b.column("item_ix"), lists(vec)], names=["item_ix", "vec"])

    raw = settle(source.mapInArrow(draw, f"item_ix int, vec {VEC}"))
    return Model(pi, trans, settle(normalise_columns(raw, k)))


def m_step(model: Model, stats: DataFrame, prior: Prior, restart: int = 0) -> tuple[Model, float]:
    """New parameters from summed expected counts, and the log-likelihood they came with."""
    mine = stats.where(F.col("restart") == restart)
    if model.fits:
        return _m_step_dense(model, mine.toArrow(), prior)
    pi, trans, lik = _small(mine.where(F.col("kind") != "emis").toArrow(), model.states)
    emis = _emission_table(model, mine.where(F.col("kind") == "emis"), prior)
    return Model(*_shares(model, pi, trans, prior), emis, model.history), lik


def _of_kind(rows: pa.Table, kind: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    part = rows.filter(pc.equal(rows.column("kind"), kind))
    return part.column("ix").to_numpy(), vector_rows(part.column("vec"), k)


def _small(rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    pi, trans = np.zeros(k), np.zeros((k, k))
    for _, vec in zip(*_of_kind(rows, "pi", k)):
        pi = vec
    ix, vec = _of_kind(rows, "trans", k)
    trans[ix] = vec
    return pi, trans, float(_of_kind(rows, "lik", k)[1][:, 0].sum())


def _shares(model: Model, pi, trans, prior: Prior):
    return (
        row_shares(pi + prior.pi - 1, model.pi),
        row_shares(trans + prior.matrix(model.states) - 1, model.trans),
    )


def _m_step_dense(model: Model, rows: pa.Table, prior: Prior) -> tuple[Model, float]:
    pi, trans, lik = _small(rows, model.states)
    ix, vec = _of_kind(rows, "emis", model.states)
    emis = np.zeros(model.dense.shape)
    emis[ix] = vec
    return _m_step_sums(model, pi, trans, emis, prior), lik


def _m_step_sums(model: Model, pi: np.ndarray, trans: np.ndarray, emis: np.ndarray, prior: Prior) -> Model:
    """New parameters from expected counts held as arrays; ``emis`` has a row for each index of ``model.dense``."""
    old = model.dense
    weight = np.zeros(old.shape)
    weight[model.items] = prior.emis - 1.0
    weight += emis
    new = row_shares(weight.T, old.T).T
    shares = _shares(model, pi, trans, prior)
    return Model(*shares, None, model.history, dense=new, spark=model._spark, items=model.items)


def _emission_table(model: Model, sums: DataFrame, prior: Prior) -> DataFrame:
    """Item probabilities that stay a table; only K column totals reach the driver."""
    k = model.states
    zero = F.array(*[F.lit(0.0)] * k)
    both = settle(
        model.emis.withColumnRenamed("vec", "old")
        .join(sums.select(F.col("ix").alias("item_ix"), "vec"), "item_ix", "left")
        .withColumn(
            "w",
            F.transform(F.coalesce("vec", zero), lambda v: v + F.lit(prior.emis - 1.0)),
        )
    )
    total = vector_total(both, "w")
    sums = constants(total)
    # a state without mass keeps its probabilities
    new = F.transform("w", lambda w, i: F.when(F.get(sums, i) > 0, w / F.get(sums, i)).otherwise(F.get("old", i)))
    return both.select("item_ix", new.alias("vec"))


def log_prior(model: Model, prior: Prior) -> dict[str, float]:
    """``sum (prior - 1) ln p`` per parameter group; a prior of 1 adds nothing, whatever p is."""

    def part(weight, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return float(np.where(weight == 0, 0.0, weight * np.log(p)).sum())

    if prior.emis == 1:
        emis = 0.0
    else:
        v = F.explode("vec").alias("v")
        total = model.emis.select(v).agg(
            F.sum(F.when(F.col("v") > 0, F.ln("v"))), F.min("v")
        ).first()
        emis = (prior.emis - 1) * (total[0] if total[1] > 0 else -np.inf)
    return {
        "pi": part(np.full(model.states, prior.pi - 1.0), model.pi),
        "trans": part(prior.matrix(model.states) - 1.0, model.trans),
        "emis": emis,
    }


def _tail(flags: np.ndarray) -> int:
    """How many flags hold at the end without a break."""
    broken = np.flatnonzero(~flags)
    return len(flags) - 1 - int(broken[-1]) if len(broken) else len(flags)


def settled(trace: list[float], tol: float) -> bool:
    """Stop rule on the log-likelihoods so far.

    The last six changes at least are below ``tol``, and before the last one there were six steps at least since the
    likelihood last fell by more than a tenth of it.  ``tol`` 0 never stops.
    """
    if tol <= 0:
        return False
    steps = np.diff(np.asarray(trace, dtype=float))
    fell = steps < -tol / 10
    return _tail(np.abs(steps) < tol) > 5 and _tail(~fell[:-1]) > 5


def fit(
    seqs: Sequences,
    starts: list[Model],
    prior: Prior = Prior(),
    max_iter: int = 100,
    tol: float = 0.0,
    sharded: bool | None = None,
    emission_step=None,
    on_round=None,
) -> list[Model]:
    """EM for all restarts together: each round is one pass over the segments and one aggregate.

    Parameters of a round are constants of the next one (item tables beyond the size limit are
    checkpointed), so the lineage does not grow with the rounds.  ``emission_step(restart, stats)`` may
    replace the item part of the M-step.  If it has ``held``, of type `Held`, arrays take the place of tables there
    while all items are few enough.
    """
    models = list(starts)
    traces: list[list[tuple[int, float]]] = [[] for _ in models]
    live = list(range(len(models)))
    for it in range(max_iter):
        size = sum(models[r].n_items * models[r].states for r in live)
        # one collect for all restarts only if each model may be held and all of them are few numbers
        big = sharded or size > 4 * DENSE_LIMIT or not all(models[r].fits for r in live)
        local = getattr(emission_step, "held", None)
        if local is not None and not all(local.fits(r) for r in live):
            local = None
        big = big or emission_step is not None and local is None
        sums = None if big else dense_sums(seqs, [models[r] for r in live])
        stats = settle(statistics(seqs, [models[r] for r in live], sharded=sharded)) if big else None
        still = []
        for pos, r in enumerate(live):
            if sums is not None:
                old, (pi, trans, lik, emis) = models[r], sums[pos]
                if local is None:
                    new = _m_step_sums(old, pi, trans, emis, prior)
                else:
                    shares = _shares(old, pi, trans, prior)
                    new = Model(*shares, None, old.history, dense=local(r, emis), spark=old._spark, items=old.items)
            elif emission_step is not None:
                old, mine = models[r], stats.where(F.col("restart") == pos)
                pi, trans, lik = _small(mine.where(F.col("kind") != "emis").toArrow(), old.states)
                new = Model(*_shares(old, pi, trans, prior), emission_step(r, mine))
                # the items of a fit stay the same: not counted again in every round
                new.n_items = old.n_items
            else:
                new, lik = m_step(models[r], stats, prior, pos)
            traces[r].append((it, lik))
            new.history = traces[r]
            models[r] = new
            if not settled([x for _, x in traces[r]], tol):
                still.append(r)
        if on_round is not None:
            on_round(it, models)
        live = still
        if not live:
            break
    return models


def reestimate(seqs: Sequences, model: Model, prior: Prior, sharded=None) -> Model:
    """Parameters one E and M step would give on another data set."""
    return m_step(model, settle(statistics(seqs, [model], sharded=sharded)), prior)[0]


def save(model: Model, prior: Prior, path: str) -> None:
    """The model's tables and the priors it is fitted with, so that a fit can be taken up again."""
    store.save(model, path)
    rows = [(prior.pi, prior.trans, prior.emis, prior.diag)]
    table = model.emis.sparkSession.createDataFrame(rows, "pi double, trans double, emis double, diag double")
    table.write.mode("overwrite").parquet(f"{path}/prior")


def load(spark: SparkSession, path: str) -> tuple[Model, Prior]:
    return store.load(spark, path), Prior(*spark.read.parquet(f"{path}/prior").first())


def history_table(spark, models: list[Model]) -> DataFrame:
    rows = [(r, i, ll) for r, m in enumerate(models) for i, ll in m.history]
    return spark.createDataFrame(rows, "restart int, iter int, log_lik double")
