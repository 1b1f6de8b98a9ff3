"""Headline timings on ``$BENCH_SF_DIR`` with ``$BENCH_CPUS`` local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from seqloom.operators import em, estep, evaluate, scoring, sessions
    from seqloom.plans import registry
    from seqloom.plans.relational import LENGTHS, flagship

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    v = registry.Views(spark, folder)
    prior = em.Prior(2, 2, 2, diag=4)
    k = 20
    times: dict[str, float] = {}

    def run(name: str, fn) -> None:
        t = time.perf_counter()
        out = fn()
        if out is not None:
            out.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)

    flagship(registry.Views(spark, "/root/testdata/sf0.001")).count()  # start the JVM and Python workers
    run("E8_sessionize", lambda: flagship(v))

    def order_sequences():
        rows = v.order_lines.groupBy(*sessions.SEQ, "session_ix", "item_id").agg(F.count("*").alias("n"))
        rows = sessions.settle(rows)
        dim = sessions.dictionary(rows)
        return sessions.pack_items(sessions.item_positions(sessions.encode(rows, dim)), 4096)

    run("E8_orders", order_sequences)
    seqs = estep.sequences(v.order_items)
    dim = v.order_dim
    start = em.random_model(dim, k, prior, 1)
    start.dense
    run("A8_popularity", lambda: evaluate.popularity(v.order_items, dim))
    run("H13_H14_em_round", lambda: em.fit(seqs, [start], prior, 1)[0].emis)
    run("H13_H14_em_round_sharded", lambda: em.fit(seqs, [start], prior, 1, sharded=True)[0].emis)
    run("H15_em_5_rounds", lambda: em.fit(seqs, [start], prior, 5)[0].emis)
    run("D3_4_restarts_round", lambda: em.fit(seqs, [start] * 4, prior, 1)[0].emis)
    wide = {n: em.random_model(dim, n, prior, 1) for n in (100, 200)}
    for n, m in wide.items():
        m.dense
        run(f"H13_H14_em_round_{n}_states", lambda m=m: em.fit(seqs, [m], prior, 1)[0].emis)
    run("H17_log_likelihood", lambda: estep.log_likelihood(seqs, [start]))

    def score():
        rows = estep.next_state(seqs, start)
        q = rows.select(F.col("user_id").alias("request_id"), F.col("next").alias("q"))
        return scoring.recommend(q, start, 10)

    run("R4_score_all_users", score)
    run("D7_history_curve", lambda: evaluate.history_curve(v.order_items, start, LENGTHS))
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
