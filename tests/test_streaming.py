import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import estep, sessions
from seqloom.operators.model import Model, emission_table
from seqloom.streaming import online

GAP = 30 * 60 * 1_000_000


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Three files of clicks in time order, read one file per micro-batch."""
    rng = np.random.default_rng(4)
    path = str(tmp_path_factory.mktemp("clicks"))
    rows, at = [], 1_700_000_000_000_000
    for _ in range(240):
        at += int(rng.integers(1, 20)) * 60_000_000
        rows.append((int(rng.integers(0, 5)), int(rng.integers(0, 6)) + 10, at))
    schema = "user_id long, item_id int, us long"
    parts = []
    for i in range(3):
        df = spark.createDataFrame(rows[i * 80 : (i + 1) * 80], schema).coalesce(1)
        df.write.mode("append").parquet(path)
        parts.append(df)
    whole = parts[0].union(parts[1]).union(parts[2])

    def stream():
        raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        return raw.withColumn("ts", F.timestamp_micros("us"))

    return stream, whole


@pytest.fixture(scope="module")
def hmm(spark):
    rng = np.random.default_rng(5)
    return Model(
        rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), emission_table(spark, rng.dirichlet(np.ones(6), 3).T)
    )


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame([(10 + i, i) for i in range(6)], "item_id int, item_ix int")


def numbered(whole, dim):
    return sessions.timeline(*sessions.user_blocks(whole), GAP).join(dim, "item_id")


def test_item_states_equal_batch(source, hmm, dim):
    stream, whole = source
    live = online.replay(online.online_states(stream(), hmm, dim))
    got = {(r.user_id, r.us): r.next for r in live.collect()}
    rows = whole.join(dim, "item_id")
    from pyspark.sql import Window

    t = F.row_number().over(Window.partitionBy("user_id").orderBy("us")) - 1
    seq = rows.select("user_id", F.lit(0).alias("chunk"), t.cast("long").alias("t"), "item_ix", F.lit(1).alias("n"), "us")
    post = estep.posterior(estep.sequences(seq), hmm).join(seq.select("user_id", "t", "us"), ["user_id", "t"])
    want = {(r.user_id, r.us): np.array(r.filt) @ hmm.trans for r in post.collect()}
    assert set(got) == set(want)
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_prediction_without_item_leaves_the_state(spark, hmm, dim, tmp_path):
    schema = "user_id long, item_id int, us long"
    spark.createDataFrame([(1, 11, 1), (1, None, 2), (1, None, 3), (1, 77, 4), (1, 12, 5)], schema).write.parquet(
        str(tmp_path / "in")
    )
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    rows = {r.us: np.array(r.next) for r in online.replay(online.online_states(stream, hmm, dim)).collect()}
    assert set(rows) == {1, 2, 3, 5}
    assert np.allclose(rows[2], rows[1] @ hmm.trans) and np.allclose(rows[3], rows[2])
    q = rows[1] * hmm.dense[2]
    assert np.allclose(rows[5], q / q.sum() @ hmm.trans)


def test_closed_sessions_equal_batch(source, hmm, dim):
    stream, whole = source
    rows = numbered(whole, dim).cache()
    seq = rows.groupBy("user_id", F.lit(0).alias("chunk"), F.col("session_ix").alias("t"), "item_ix").agg(
        F.count("*").alias("n")
    )
    ends = {(r.user_id, r.session_ix): r.e for r in rows.groupBy("user_id", "session_ix").agg(F.max("us").alias("e")).collect()}
    post = estep.posterior(estep.sequences(seq), hmm).collect()
    want = {(r.user_id, ends[r.user_id, r.t]): np.array(r.filt) @ hmm.trans for r in post}
    got = {(r.user_id, r.end_us): np.array(r.next) for r in online.replay(online.online_sessions(stream(), hmm, dim, GAP)).collect()}
    assert set(got) <= set(want) and len(got) >= len(want) - 5
    assert all(np.allclose(got[k], want[k]) for k in got)


def test_live_sessions_and_popularity(source, dim):
    stream, whole = source
    rows = numbered(whole, dim).groupBy("user_id", "session_ix").agg(F.count("*").alias("c"), F.max("us").alias("e"))
    want = {(r.user_id, r.e): r.c for r in rows.collect()}
    live = online.replay(online.live_sessions(stream(), "30 minutes", "1 hour"))
    got = {(r.user_id, r.e): r.clicks for r in live.select("*", F.unix_micros("end_ts").alias("e")).collect()}
    assert got.items() <= want.items() and len(got) >= len(want) - 10
    counts = online.replay(online.running_popularity(stream()), "update")
    last = {r.item_id: r.c for r in counts.groupBy("item_id").agg(F.max_by("clicks", "epoch").alias("c")).collect()}
    assert last == {r.item_id: r["count"] for r in whole.groupBy("item_id").count().collect()}


def one_user(spark, path, batches):
    """A stream with one file, and so one micro-batch, for each list of (user, item, minute)."""
    schema = "user_id long, item_id int, us long"
    for rows in batches:
        spark.createDataFrame([(u, i, m * 60_000_000) for u, i, m in rows], schema).coalesce(1).write.mode("append").parquet(path)
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return raw.withColumn("ts", F.timestamp_micros("us"))


def walk(hmm, clicks, gap=30):
    """Sessions of one user's (item, minute), None as item ending a session, one click after the other."""
    q, f, n, start, last, out = hmm.pi, np.zeros(3), 0, 0, None, []

    def close():
        p = q * np.exp(f - f.max())
        return p / p.sum() @ hmm.trans

    for item, minute in clicks:
        if n and minute - last > gap:
            q = close()
            out.append((start, last, n, q))
            f, n = np.zeros(3), 0
        if item is None:
            q = close()
            out.append((start if n else minute, last if n else minute, n, q))
            f, n, last = np.zeros(3), 0, minute
            continue
        start = start if n else minute
        f, n, last = f + np.log(hmm.dense[item - 10]), n + 1, minute
    return out


def sessions_of(df):
    rows = [(r.start_us // 60_000_000, r.end_us // 60_000_000, r["items"], np.array(r.next)) for r in df.collect() if r.user_id == 1]
    return sorted(rows, key=lambda r: r[:2])


def test_control_rows_end_sessions_of_a_hot_user_in_any_batches(spark, hmm, dim, tmp_path):
    r = np.random.default_rng(6)
    clicks, minute = [], 1000
    for _ in range(150):
        minute += int(r.integers(1, 45))
        clicks.append((None if r.random() < 0.15 else int(r.integers(10, 16)), minute))
    clicks = [(11, 990), *clicks, (None, minute + 1), (None, minute + 9)]
    rows = [(1, i, m) for i, m in clicks]
    want = walk(hmm, clicks)
    for k, cuts in enumerate(([0, 153], [0, 40, 41, 100, 153])):
        batches = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        got = sessions_of(online.replay(online.online_sessions(one_user(spark, str(tmp_path / f"in{k}"), batches), hmm, dim, GAP, "1000 days")))
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all(np.allclose(g[3], w[3]) for g, w in zip(got, want))


def test_state_is_dropped_after_its_time(spark, hmm, dim, tmp_path):
    """The watermark passes user 1's session and the time their state is kept; their next click starts anew."""
    far = 100_000
    batches = [[(1, 11, 1000), (1, 12, 1010), (3, None, 1010)], [(2, 11, far)], [(2, 11, far + 1)], [(1, 13, far + 2), (1, None, far + 3)]]
    rows = {}
    for keep in (None, 60 * 60_000_000):
        stream = online.online_sessions(one_user(spark, str(tmp_path / f"in{keep}"), batches), hmm, dim, GAP, "1 hour", keep)
        out, states = str(tmp_path / f"out{keep}"), []
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"ckpt{keep}")).option("path", out)
        query = query.outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        rows[keep] = sessions_of(spark.read.schema(stream.schema).parquet(out)), states
    first = walk(hmm, [(11, 1000), (12, 1010), (None, 1040)])[0][3]
    kept, dropped = rows[None][0], rows[60 * 60_000_000][0]
    assert [g[:3] for g in kept] == [g[:3] for g in dropped] == [(1000, 1010, 2), (far + 2, far + 2, 1)]
    anew = walk(hmm, [(13, far + 2), (None, far + 3)])[0][3]
    assert np.allclose(kept[0][3], first) and np.allclose(dropped[1][3], anew) and not np.allclose(kept[1][3], anew)
    assert min(rows[60 * 60_000_000][1][1:-1]) < max(rows[None][1])


def test_a_user_costs_one_read_and_one_write_of_the_state():
    """No second call to ask whether there is a state, and no frame for users of whom nothing is to report."""
    import pandas as pd

    calls = []

    class Value:
        held = None

        def exists(self):
            calls.append("exists")
            return self.held is not None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, *args):
            return Value()

        def registerTimer(self, at):
            self.at = at

        def deleteTimer(self, at):
            pass

        def getExpiryTimeInMs(self):
            return self.at

    work, handle = online._SessionState(np.full(2, 0.5), np.full((2, 2), 0.5), GAP, None), Handle()
    work.init(handle)
    clicks = pd.DataFrame({"us": [2, 1], "vec": [np.array([0.1, 0.2]), np.array([0.3, 0.4])]})
    assert list(work.handleInputRows((7,), iter([clicks[:1], clicks[1:]]), None)) == []
    assert list(work.handleInputRows((7,), iter([clicks.assign(us=[GAP + 2, GAP + 1])]), None)) == []
    assert calls == ["get", "update"] * 2
    (ended,) = work.handleExpiredTimer((7,), None, handle)
    assert ended[["user_id", "start_us", "end_us", "items"]].values.tolist() == [[7, 1, GAP + 2, 4]]
    assert list(work.handleExpiredTimer((7,), None, handle)) == []
    assert calls == ["get", "update"] * 3 + ["get"]
