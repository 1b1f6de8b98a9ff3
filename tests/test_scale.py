"""What bounds the work of a task, and what is read or joined once only."""

import os
import time

import numpy as np
from pyspark.sql import functions as F

from seqloom.operators import em, estep, evaluate, kernel, sessions
from seqloom.operators.model import labelled_model, labelled_models
from seqloom.plans.registry import Views


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def clicks(spark, users=9, length=5):
    rows = [(u, 0, t, t % 3, 1) for u in range(users) for t in range(length)]
    return spark.createDataFrame(rows, "user_id long, chunk int, t long, item_ix int, n int")


def test_tasks_follow_the_clicks_in_whole_rounds(spark, monkeypatch):
    monkeypatch.setattr(estep, "TASK_CLICKS", 10)
    cores = spark.sparkContext.defaultParallelism
    seqs = estep.sequences(clicks(spark, 9 * cores))
    assert seqs.df.rdd.getNumPartitions() == 5 * cores
    assert seqs.df.rdd.getNumPartitions() * 10 >= seqs.entries


def test_evidence_too_faint_for_products():
    log_f = np.array([[0.0, -900.0], [-2000.0, -1.0], [-np.inf, -np.inf], [0.5, 0.25]])
    begin, trans = np.array([[0.0, 1.0], [0.5, 0.5]]), np.array([[0.5, 0.5], [1.0, 0.0]])
    q, p, c, _ = kernel.forward(log_f, np.array([0, 2]), np.array([2, 2]), trans, begin)
    assert np.allclose(q[0], [0, 1]) and np.isclose(c[0], -900)
    assert np.allclose(p[1], [1, 0]) and np.allclose(q[1], [1, 0]) and np.isclose(c[1], -2000)
    assert np.allclose(q[2], 0) and c[2] == -np.inf


def test_sums_by_item_of_few_and_of_wide_ids():
    rows = np.arange(12.0).reshape(6, 2)
    for scale in (1, 1000):
        ids, sums = kernel.sum_by_item(np.array([3, 1, 3, 0, 1, 3], np.int32) * scale, rows)
        assert list(ids) == [0, scale, 3 * scale] and np.allclose(sums, [[6, 7], [10, 12], [14, 17]])


def test_session_positions_need_no_join(spark):
    rows = [(1, 0, 5, 7, 1), (1, 0, 5, 8, 2), (1, 0, 9, 7, 1), (2, 0, 1, 7, 1), (None, 0, 1, 7, 1), (1, 0, None, 7, 1)]
    df = spark.createDataFrame(rows, "user_id long, chunk int, session_ix int, item_ix int, n long")
    out = sessions.session_positions(df)
    assert "Join" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, 0, 0, 5, 7, 1), (1, 0, 0, 5, 8, 2), (1, 0, 1, 9, 7, 1), (2, 0, 0, 1, 7, 1)]


def test_order_lines_are_joined_once(spark, tmp_path, monkeypatch):
    orders = [(k, k % 4, "FOP"[k % 3], f"1996-01-{1 + k % 28:02d}") for k in range(30)]
    lines = [(k % 30, k % 7, k // 30) for k in range(90)]
    o = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, d string")
    o.selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "CAST(d AS DATE) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(estep, "TASK_CLICKS", 10)
    v = Views(spark, str(tmp_path))
    assert "Join" not in plan(v.order_labelled) and v.order_lines.count() == 90
    assert v.order_sess.rdd.getNumPartitions() == 9
    assert v.order_sess.groupBy().sum("n").first()[0] == 90


def shuffle_files(spark) -> set:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def test_rounds_leave_nothing_on_disk(spark):
    """Neither shuffle files nor broadcast item tables of a round stay until the driver happens to collect its garbage."""
    df = clicks(spark)
    seqs = estep.sequences(df)
    starts = [em.random_model(df.select("item_ix").distinct(), 2, em.Prior(), s) for s in (1, 2)]
    [m.dense for m in starts]
    temp = spark.sparkContext._temp_dir
    files, blocks = set(os.listdir(temp)), shuffle_files(spark)
    em.fit(seqs, starts, em.Prior(), 3)
    until = time.time() + 20
    while shuffle_files(spark) - blocks and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - blocks
    assert set(os.listdir(temp)) <= files


def test_sums_of_a_pass_equal_its_statistics(spark, monkeypatch):
    monkeypatch.setattr(estep, "SUM_CLICKS", 10)
    df = clicks(spark, 40)
    items = spark.range(2003).selectExpr("int(id) AS item_ix")
    seqs, models = estep.sequences(df), [em.random_model(items, 2, em.Prior(), s) for s in (1, 2)]
    assert seqs.sum_tasks % spark.sparkContext.defaultParallelism == 0 and seqs.sum_tasks * 10 >= seqs.entries
    rows = {(r.restart, r.kind, r.ix): r.vec for r in estep.statistics(seqs, models).collect()}
    for r, (pi, trans, lik, emis) in enumerate(estep.dense_sums(seqs, models)):
        assert emis.shape == (2003, 2) and np.isclose(lik, sum(v[0] for k, v in rows.items() if k[:2] == (r, "lik")))
        assert np.allclose(pi, rows[r, "pi", 0]) and np.allclose(trans, [rows[r, "trans", i] for i in range(2)])
        want = {k[2]: v for k, v in rows.items() if k[:2] == (r, "emis")}
        assert all(np.allclose(emis[i], want.get(i, 0)) for i in range(2003))


def test_labelled_clicks_are_counted_once_for_all_priors(spark):
    rows = [(u, t, (u + t) % 4, t % 2) for u in range(5) for t in range(6)]
    df = spark.createDataFrame(rows, "user_id long, ord long, item_id long, state int")
    dim = spark.createDataFrame([(i, i) for i in range(5)], "item_id long, item_ix int")
    for prior, got in zip((1.0, 2.5), labelled_models(df, dim, 2, [1.0, 2.5])):
        want = labelled_model(df, dim, 2, prior)
        assert np.allclose(got.dense, want.dense) and np.allclose(got.trans, want.trans) and np.allclose(got.pi, want.pi)
        c = np.array([[sum(r[2] == i and r[3] == k for r in rows) for k in range(2)] for i in range(5)]) + prior
        assert np.allclose(got.dense, c / c.sum(axis=0))


def test_only_wanted_columns_meet_the_labels(spark):
    df = clicks(spark)
    model = em.random_model(df.select("item_ix").distinct(), 2, em.Prior(), 1)
    items = spark.createDataFrame([(i, "m", str(i)) for i in range(2)], "item_ix int, make string, model string")
    seqs = estep.sequences(df)
    whole = evaluate.session_trace(seqs, model, items, 1).selectExpr("user_id", "t", "item_label", "filt[0] AS q", "top_states[0] AS s")
    few = evaluate.session_trace(seqs, model, items, 1, wanted={"q": F.col("filt")[0], "s": F.col("top_states")[0]})
    assert few.columns == ["item_ix", "user_id", "chunk", "t", "q", "s", "item_label"]
    key = ["user_id", "t", "item_label", "q", "s"]
    assert sorted(map(str, few.select(*key).collect())) == sorted(map(str, whole.select(*key).collect()))


def test_points_of_a_spline_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(50).selectExpr("double(id) AS x", "double(id * id) AS y").mapInArrow(note, "x double, y double")
    rows = evaluate.spline_fit(df, "x", "y", [10.0]).collect()
    assert made.value == 50 and len(rows) == 1
