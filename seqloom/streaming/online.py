"""Live counterparts: sessions, per-user state, running popularity."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import kernel
from ..operators.model import VEC, Model
from ..runtime import scratch_path

# The process that starts a state processor does not see shipped packages, so the processors and the
# numpy steps travel with the query itself.
cloudpickle.register_pickle_by_value(kernel)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SCHEMA = f"user_id bigint, us bigint, next {VEC}"
SESSION_SCHEMA = f"user_id bigint, start_us bigint, end_us bigint, items bigint, next {VEC}"


def live_sessions(clicks: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a click stream ``(user_id, ts, ...)``, emitted once the watermark passes them.

    Clicks exactly one gap apart share a session, as in the batch form.
    """
    return (
        clicks.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("clicks"), F.max("ts").alias("end_ts"))
        .select("user_id", F.col("w.start").alias("start_ts"), "end_ts", "clicks")
    )


def running_popularity(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("item_id").agg(F.count("*").alias("clicks"))


class _ItemState(StatefulProcessor):
    """Keeps the predicted state of a user; one click in, the next predicted state out."""

    def __init__(self, pi: np.ndarray, trans: np.ndarray, ttl_ms: int | None):
        self.pi, self.trans, self.ttl_ms = pi, trans, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", f"q {VEC}", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        batch = pd.concat(list(rows)).sort_values(["us", "item_id"], na_position="last")
        q = np.array(self.state.get()[0]) if self.state.exists() else self.pi
        out, changed = [], False
        for vec in batch["vec"]:
            if vec is None:
                out.append(q @ self.trans)
                continue
            with np.errstate(divide="ignore"):
                f = np.log(np.asarray(vec, dtype=float))
            q = (kernel.update(f[None], q[None])[0] @ self.trans)[0]
            changed = True
            out.append(q)
        if changed:
            self.state.update((q.tolist(),))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "us": batch["us"].to_numpy(), "next": out})

    def close(self) -> None:
        pass


def online_states(clicks: DataFrame, model: Model, item_dim: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Predicted state of the user after every click of the stream ``(user_id, us, item_id)``.

    The item probabilities reach a click by a stream-static join, so the state processor carries K
    numbers per user and never the item table.  A row without an item asks for a prediction one
    step further and leaves the state as it is; unknown items are dropped.
    """
    clicks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    static = item_dim.join(model.emis, "item_ix").select("item_id", "vec")
    rows = clicks.join(static, "item_id", "left").where(
        F.col("vec").isNotNull() | F.col("item_id").isNull()
    )
    return (
        rows.select("user_id", "us", "item_id", "vec")
        .groupBy("user_id")
        .transformWithStateInPandas(
            _ItemState(model.pi, model.trans, ttl_ms),
            outputStructType=STATE_SCHEMA,
            outputMode="Append",
            timeMode="ProcessingTime" if ttl_ms else "None",
        )
    )


class _SessionState(StatefulProcessor):
    """Collects the evidence of the open session; closing it moves the state one step on.

    A batch of clicks is cut into sessions and their evidence summed as arrays; only sessions are stepped through.
    """

    def __init__(self, pi: np.ndarray, trans: np.ndarray, gap_us: int, keep_us: int | None):
        self.pi, self.trans, self.gap_us, self.keep_us = pi, trans, gap_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "session", f"q {VEC}, f {VEC}, start bigint, last bigint, n bigint"
        )

    def _close(self, q, f):
        return (kernel.update(f[None], q[None])[0] @ self.trans)[0]

    def _row(self, key, start, last, n, q):
        return {"user_id": key[0], "start_us": start, "end_us": last, "items": n, "next": q}

    def _expiry(self, last: int) -> int:
        # a click exactly one gap later still belongs, hence the first whole millisecond after it
        return (last + self.gap_us) // 1000 + 1

    def _forget(self, last: int) -> int:
        return self._expiry(last + self.keep_us)

    def _timers(self, last: int, n: int, act) -> None:
        """The session's end, if one is open, and the end of the state itself."""
        if n:
            act(self._expiry(last))
        if self.keep_us is not None:
            act(self._forget(last))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        # a user has few rows: plain arrays and one call for the state cost a fraction of frames and two
        parts = [(b["us"].to_numpy(), b["vec"].to_numpy()) for b in rows]
        us, vec = (np.concatenate(x) for x in zip(*parts))
        ends = pd.isna(vec)
        order = np.lexsort((ends, us))
        us, vec, ends = us[order], vec[order], ends[order]
        k, out = len(self.pi), []
        known = self.state.get()
        if known is not None:
            q, f, start, last, n = known
            q, f = np.array(q), np.array(f)
            self._timers(last, n, self.handle.deleteTimer)
        elif ends.all():
            # nothing is known of the user: there is no session to end
            return
        else:
            q, f, start, last, n = self.pi, np.zeros(k), 0, int(us[0]), 0
        evidence = np.zeros((len(us), k))
        if not ends.all():
            with np.errstate(divide="ignore"):
                evidence[~ends] = np.log(np.stack(vec[~ends]))
        new = np.diff(us, prepend=last) > self.gap_us
        new[1:] |= ends[:-1]
        new[0] = True
        first = np.flatnonzero(new)
        sums, clicks = np.add.reduceat(evidence, first, axis=0), np.add.reduceat(~ends, first)
        stop = np.append(first[1:], len(us)) - 1
        for s, (a, b) in enumerate(zip(first, stop)):
            c = int(clicks[s])
            if n and (s or us[a] - last > self.gap_us):
                q = self._close(q, f)
                out.append(self._row(key, start, last, n, q))
                f, n = np.zeros(k), 0
            if c:
                start = start if n else int(us[a])
                last = max(last, int(us[b - 1] if ends[b] else us[b]))
            f, n = f + sums[s], n + c
            if ends[b]:
                q = self._close(q, f)
                at = int(us[b])
                out.append(self._row(key, start if n else at, last if n else at, n, q))
                f, n, last = np.zeros(k), 0, max(last, at)
        self.state.update((q.tolist(), f.tolist(), int(start), int(last), n))
        self._timers(last, n, self.handle.registerTimer)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        known = self.state.get()
        if known is not None:
            q, f, start, last, n = known
            at = expiredTimerInfo.getExpiryTimeInMs()
            if n and at == self._expiry(last):
                q = self._close(np.array(q), np.array(f)).tolist()
                self.state.update((q, [0.0] * len(q), start, last, 0))
                yield pd.DataFrame([self._row(key, start, last, n, q)])
            if self.keep_us is not None and at == self._forget(last):
                self.state.clear()

    def close(self) -> None:
        pass


def online_sessions(
    clicks: DataFrame, model: Model, item_dim: DataFrame, gap_us: int, late: str = "1 hour", keep_us: int | None = None
) -> DataFrame:
    """State after every closed session of a click stream ``(user_id, ts, us, item_id)``.

    A session closes when a later click is more than a gap away, when the watermark is, or at a row without an item:
    such a control row ends the user's open session at once (clicks of the same instant belong to it), and without an
    open one moves the state a step on, reported as a session of no items.  A control row of a user of whom nothing is
    known has no effect.  With ``keep_us`` a user's state is dropped once the watermark is that much beyond the end of
    the last session, and a later click starts anew.  Unknown items are dropped, as are rows behind the watermark.
    """
    clicks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    static = item_dim.join(model.emis, "item_ix").select("item_id", "vec")
    return (
        clicks.withWatermark("ts", late)
        .join(static, "item_id", "left")
        .where(F.col("vec").isNotNull() | F.col("item_id").isNull())
        .select("user_id", "ts", "us", "vec")
        .groupBy("user_id")
        .transformWithStateInPandas(
            _SessionState(model.pi, model.trans, gap_us, keep_us),
            outputStructType=SESSION_SCHEMA,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def click_stream(
    spark: SparkSession, path: str, types: list[str] | None = None, max_files: int | None = None
) -> DataFrame:
    """Event files as a stream of clicks ``(user_id, item_id, us, ts, ad_type)``, ``max_files`` files in a micro-batch."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.parquet(path)
    if types is not None:
        raw = raw.where(F.col("event_type").isin(types))
    ts = F.col("ts").cast("timestamp")
    return raw.select(
        "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("item_id"),
        F.unix_micros(ts).alias("us"),
        ts.alias("ts"),
        F.col("event_type").alias("ad_type"),
    )


def replay(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now and return the stored result.

    Append results go to a parquet sink (exactly once); update results keep the last batch's row per
    key by writing each batch with its number.
    """
    spark = stream.sparkSession
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    writer = stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(out)
    else:

        def store(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

        query = writer.foreachBatch(store).outputMode(mode).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out) if mode == "append" else spark.read.parquet(out)
