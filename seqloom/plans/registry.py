"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import skew, sources
from ..operators import estep, sessions
from ..operators.model import labelled_model
from ..runtime import prepare, settle, stored

TYPES = ["view", "click", "purchase"]
STATUS = ["F", "O", "P"]
GAP = 6 * 3600 * 1_000_000

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_VIEWS: dict[tuple[str, str], Views] = {}


class Views:
    """Tables shared by queries of one session and folder; built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder

    def table(self, name: str) -> DataFrame:
        return sources.table(self.spark, self.folder, name)

    @property
    def events(self) -> DataFrame:
        return self.table("events")

    @property
    def part(self) -> DataFrame:
        return sources.parts_as_items(self.table("part"))

    @property
    def clicks(self) -> DataFrame:
        return sources.clicks(self.events, TYPES)

    def sessionize(self, **kw) -> DataFrame:
        args = dict(gap_us=GAP, min_item=1, min_user=10, min_sessions=3)
        return sessions.sessionize(self.clicks, **{**args, **kw})

    @cached_property
    def sess(self) -> DataFrame:
        return settle(self.sessionize())

    @cached_property
    def dim(self) -> DataFrame:
        return settle(sessions.dictionary(self.sess))

    @cached_property
    def seq(self) -> DataFrame:
        return settle(sessions.item_positions(sessions.encode(self.sess, self.dim)))

    @cached_property
    def seqs(self):
        return estep.sequences(self.seq)

    @property
    def labelled(self) -> DataFrame:
        state = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("ad_type")) - 1
        return self.clicks.select("user_id", F.col("us").alias("ord"), "item_id", state.cast("int").alias("state"))

    @cached_property
    def model(self):
        return labelled_model(self.labelled, self.dim, len(TYPES))

    # order lines as clicks, one order = one session

    @cached_property
    def order_lines(self) -> DataFrame:
        """Order lines with the number of the order in its customer's history; joined once for all that read them."""
        orders = self.table("orders").select(
            F.col("o_custkey").alias("user_id"),
            "o_orderkey",
            F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"),
            F.col("o_orderstatus").alias("ad_type"),
        )
        blocks = skew.find_blocks(orders, ["user_id"], F.col("us"))
        numbered = skew.position(
            blocks.assign(orders, F.col("us")), blocks, ["us", "o_orderkey"], "session_ix"
        )
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"),
            F.col("l_partkey").alias("item_id"),
            F.col("l_linenumber").alias("line"),
        )
        return stored(numbered.drop(skew.BLK).join(lines, "o_orderkey").withColumn("chunk", F.lit(0)))

    @property
    def order_sess(self) -> DataFrame:
        """Counted anew from the stored lines wherever it is read: stored as well, it would take several times their disk."""
        keys = [*sessions.SEQ, "session_ix", "item_id"]
        # nearly every row is a group of its own: the number of tasks, not the bytes, bounds what one of them holds
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-self.order_line_count // estep.TASK_CLICKS))
        rows = self.order_lines.select(*keys).repartition(tasks, *keys).groupBy(*keys)
        return rows.agg(F.count("*").alias("n"))

    @cached_property
    def order_line_count(self) -> int:
        return self.order_lines.count()

    @cached_property
    def order_dim(self) -> DataFrame:
        return settle(sessions.dictionary(self.order_lines))

    @cached_property
    def order_encoded(self) -> DataFrame:
        return stored(sessions.encode(self.order_sess, self.order_dim))

    @cached_property
    def order_seq(self) -> DataFrame:
        """Session mode: positions are orders."""
        return settle(sessions.session_positions(self.order_encoded))

    @cached_property
    def order_items(self) -> DataFrame:
        """Item mode: positions are the distinct items of the orders."""
        return settle(sessions.item_positions(self.order_encoded))

    @cached_property
    def order_seqs(self):
        # the positions go straight into the segments, they are not stored in between
        return estep.sequences(sessions.session_positions(self.order_encoded), 512)

    @property
    def order_labelled(self) -> DataFrame:
        state = F.array_position(F.array(*[F.lit(t) for t in STATUS]), F.col("ad_type")) - 1
        return self.order_lines.select(
            "user_id",
            (F.col("session_ix") * 1000 + F.col("line")).alias("ord"),
            "item_id",
            state.cast("int").alias("state"),
        )

    @cached_property
    def order_model(self):
        return labelled_model(self.order_labelled, self.order_dim, len(STATUS))


def views(spark: SparkSession, folder: str) -> Views:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _VIEWS:
        _VIEWS[key] = Views(spark, folder)
    return _VIEWS[key]


def forget() -> None:
    """Drop the shared tables, so that the next query builds them again."""
    _VIEWS.clear()


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under an operator id, with its SQL if there is one."""

    def wrap(fn: Callable[[Views], DataFrame]):
        _QUERIES[name] = lambda spark, folder: fn(views(spark, folder))
        if sql is not None:
            _SQL[name] = sql
        return fn

    return wrap


def _load() -> None:
    from . import evaluation, latent, relational  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle() -> dict[str, str]:
    _load()
    return dict(_SQL)
