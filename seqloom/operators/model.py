"""Model parameters: small matrices on the driver, item probabilities as a table.

``pi`` and ``trans`` have K and K x K entries whatever the data size.  The item probabilities
``emis(item_ix, vec)`` have one row per item.  They are copied to the executors only when a count
shows that they fit (`dense`); otherwise all operators join the table.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import skew
from ..runtime import broadcast_if_small, settle
from .vectors import constants, vector_total

DENSE_LIMIT = 4_000_000
VEC = "array<double>"


class Model:
    """Parameters of one fit.  Given the item table or, for small models, its dense N x K array;
    the other form is built on first use."""

    def __init__(
        self,
        pi: np.ndarray,
        trans: np.ndarray,
        emis: DataFrame | None = None,
        history: list[tuple[int, float]] | None = None,
        dense: np.ndarray | None = None,
        spark: SparkSession | None = None,
        items: np.ndarray | None = None,
    ):
        self.pi, self.trans = pi, trans
        self.history = list(history or [])
        self._emis, self._spark = emis, spark or emis.sparkSession
        if dense is not None:
            self.dense = dense
            self.items = np.arange(len(dense), dtype=np.int32) if items is None else items
            self.n_items = len(self.items)

    @property
    def states(self) -> int:
        return len(self.pi)

    @property
    def emis(self) -> DataFrame:
        if self._emis is None:
            self._emis = emission_table(self._spark, self.dense, self.items)
        return self._emis

    @cached_property
    def n_items(self) -> int:
        return self.emis.count()

    @property
    def fits(self) -> bool:
        """True if K x N numbers are few enough to copy to every executor."""
        return self.n_items * self.states <= DENSE_LIMIT

    @cached_property
    def dense(self) -> np.ndarray:
        """Item probabilities by item index; refused for models beyond the limit.

        Indexes the model has no item for hold zeros: they are not in `items`."""
        if not self.fits:
            raise ValueError("too many items to hold in one process, use the sharded operators")
        rows = self.emis.select("item_ix", "vec").toArrow()
        ix = rows.column("item_ix").to_numpy()
        out = np.zeros((int(ix.max()) + 1 if len(ix) else 0, self.states))
        out[ix] = vector_rows(rows.column("vec"), self.states)
        self.items = np.sort(ix).astype(np.int32)
        return out

    @cached_property
    def items(self) -> np.ndarray:
        """Sorted indexes of the items the model knows; only for models that fit."""
        self.dense
        return self.__dict__["items"]


def vector_rows(column, k: int) -> np.ndarray:
    """An Arrow column of K-entry lists as a matrix."""
    return column.combine_chunks().flatten().to_numpy().reshape(-1, k)


def matrix_table(spark: SparkSession, m: np.ndarray) -> DataFrame:
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "i int, j int, p double")


def vector_table(spark: SparkSession, v: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "state int, p double")


def emission_table(spark: SparkSession, dense: np.ndarray, items: np.ndarray | None = None) -> DataFrame:
    """Rows ``items`` of a dense array as ``emis(item_ix, vec)``; for arrays that were small enough to hold."""
    if items is None:
        items = np.arange(len(dense))
    n, k = len(items), dense.shape[1]
    offsets = pa.array(np.arange(0, n * k + 1, k, dtype=np.int32))
    vec = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(dense[items], dtype=np.float64).ravel()))
    table = pa.Table.from_arrays([pa.array(items.astype(np.int32)), vec], names=["item_ix", "vec"])
    return spark.createDataFrame(table)


def from_tables(pi: DataFrame, trans: DataFrame, emis: DataFrame, history=None) -> Model:
    p = {r["state"]: r["p"] for r in pi.collect()}
    k = len(p)
    a = np.zeros((k, k))
    for r in trans.collect():
        a[r["i"], r["j"]] = r["p"]
    return Model(np.array([p[i] for i in range(k)]), a, emis, history)


def save(model: Model, path: str) -> None:
    """One parquet table per parameter."""
    spark = model.emis.sparkSession
    vector_table(spark, model.pi).write.mode("overwrite").parquet(f"{path}/pi")
    matrix_table(spark, model.trans).write.mode("overwrite").parquet(f"{path}/trans")
    model.emis.write.mode("overwrite").parquet(f"{path}/emis")
    hist = spark.createDataFrame(model.history, "iter int, log_lik double")
    hist.write.mode("overwrite").parquet(f"{path}/history")


def load(spark: SparkSession, path: str) -> Model:
    """Read a saved model; stores without a convergence history are accepted."""
    read = spark.read.parquet
    try:
        rows = read(f"{path}/history").orderBy("iter").collect()
        history = [(r["iter"], r["log_lik"]) for r in rows]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        history = []
    return from_tables(
        read(f"{path}/pi"),
        read(f"{path}/trans"),
        read(f"{path}/emis").select("item_ix", "vec"),
        history,
    )


def labelled_model(
    labelled: DataFrame, item_dim: DataFrame, states: int, prior: float = 1.0, hot_rows=None
) -> Model:
    """Counting estimate from clicks whose state is known: ``(user_id, ord, item_id, state)``.

    First-state, state-pair and item counts, each plus ``prior``, scaled to sum 1.
    """
    return labelled_models(labelled, item_dim, states, [prior], hot_rows)[0]


def labelled_models(labelled: DataFrame, item_dim: DataFrame, states: int, priors: list[float], hot_rows=None) -> list[Model]:
    """``labelled_model`` for each of some priors; the clicks are counted once."""
    blocks = skew.find_blocks(labelled, ["user_id"], F.col("ord"), hot_rows)
    steps = skew.previous(blocks.assign(labelled, F.col("ord")), blocks, "ord", ["state"], "prev_")
    pairs = steps.groupBy("prev_state", "state").count().collect()
    first, moves = np.zeros(states), np.zeros((states, states))
    for r in pairs:
        if r["prev_state"] is None:
            first[r["state"]] += r["count"]
        else:
            moves[r["prev_state"], r["state"]] += r["count"]
    counts = [
        F.count(F.when(F.col("state") == k, 1)).cast("double").alias(f"c{k}") for k in range(states)
    ]
    per_item = labelled.groupBy("item_id").agg(*counts)
    filled = [F.coalesce(F.col(f"c{k}"), F.lit(0.0)) for k in range(states)]
    table = settle(
        item_dim.join(per_item, "item_id", "left").select("item_ix", F.array(*filled).alias("vec"))
    )
    out = []
    for prior in priors:
        pi, trans = first + prior, moves + prior
        rows = table.select("item_ix", F.transform("vec", lambda x: x + F.lit(float(prior))).alias("vec"))
        out.append(Model(pi / pi.sum(), trans / trans.sum(1, keepdims=True), normalise_columns(rows, states)))
    return out


def normalise_columns(emis: DataFrame, k: int) -> DataFrame:
    """Scale every state's item weights to sum 1 (one K-number vector reaches the driver)."""
    total = vector_total(emis)
    if total is None:
        return emis.select("item_ix", "vec")
    return emis.select("item_ix", F.zip_with("vec", constants(total), lambda x, t: x / t).alias("vec"))


def emission_long(emis: DataFrame) -> DataFrame:
    """``emis`` with one row per (item, state)."""
    return emis.select("item_ix", F.posexplode("vec").alias("state", "v"))


def gather(seq: DataFrame, emis: DataFrame) -> DataFrame:
    """Emission vector of every click: broadcast after a size check, else a join AQE may split."""
    return seq.join(vectors_side(emis), "item_ix")


def vectors_side(emis: DataFrame) -> DataFrame:
    """The item table as a join side, broadcast only if its vectors fit."""
    head = emis.select(F.size("vec").alias("k")).first()
    return broadcast_if_small(emis, 64 + 8 * head["k"]) if head else emis
