"""Queries: evaluation, diagnostics, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import em, estep, evaluate, states
from ..operators.model import labelled_model, vector_table
from ..runtime import scratch_path
from ..streaming import online
from .latent import BUDGET, PRIOR, all_transitions, assigned_sql, matches_sql, reestimated
from .registry import GAP, TYPES, query
from .relational import LENGTHS, SWITCH, test_user, dashboard, spread
from .sql import ROUNDS, START_PRIORS, evidence_steps, filter_steps, r6, sql, step, trace_sql

# ---- likelihood studies -----------------------------------------------------------------------------

step("train_pop", "SELECT item_ix, coalesce(c, 0) AS c FROM dim LEFT JOIN (SELECT item_ix, count(*) AS c FROM split_seq WHERE split = 'train' GROUP BY item_ix) USING (item_ix)", "dim", "split_seq")
step("train_share", "SELECT item_ix, (c + 2) / sum(c + 2) OVER () AS p FROM train_pop", "train_pop")


@query(
    "D1_popularity_baseline",
    sql(
        """SELECT split, round(sum(ln(p)), 6) AS log_lik, count(*) AS clicks FROM split_seq
        JOIN train_share USING (item_ix) GROUP BY split""",
        "split_seq",
        "train_share",
    ),
)
def _(v):
    rows = evaluate.by_split(v.seq, test_user())
    shares = evaluate.smoothed_popularity(evaluate.popularity(rows.where("split = 'train'"), v.dim))
    out = evaluate.baseline_log_lik(rows, shares, ["split"])
    return out.withColumn("log_lik", F.round("log_lik", 6))


@query("D2_held_out")
def _(v):
    """Fit on the train users; fitted and baseline likelihood on both splits."""
    rows = evaluate.by_split(v.seq, test_user())
    return evaluate.held_out(rows, v.dim, 3, PRIOR, [1], max_iter=BUDGET, tol=5.0)


@query("D3_restarts", sql(*trace_sql(["em_a", "em_b", "em_c"], ROUNDS)))
def _(v):
    """Likelihood per start and round; all starts run together."""
    starts = [labelled_model(v.labelled, v.dim, 3, p) for p in START_PRIORS]
    models = em.fit(v.seqs, starts, PRIOR, max_iter=ROUNDS)
    return em.history_table(v.spark, models).withColumn("log_lik", F.round("log_lik", 4))


@query("D4_convergence", sql(*trace_sql(["em_a"], ROUNDS)))
def _(v):
    models = em.fit(v.seqs, [v.model], PRIOR, max_iter=ROUNDS)
    return em.history_table(v.spark, models).withColumn("log_lik", F.round("log_lik", 4))


@query("D3_restarts_to_the_end")
def _(v):
    """``D3_restarts`` by the stop rule; ``BUDGET`` rounds at most."""
    starts = [labelled_model(v.labelled, v.dim, 3, p) for p in START_PRIORS]
    models = em.fit(v.seqs, starts, PRIOR, max_iter=BUDGET, tol=5.0)
    return em.history_table(v.spark, models)


RESTARTS = {"em_a": "a", "em_b": "b", "em_c": "c"}
for _n, _s in RESTARTS.items():
    step(f"matches_{_s}", matches_sql("hmm_emis", f"{_n}{ROUNDS - 1}_ms_emis"), "hmm_emis", f"{_n}{ROUNDS - 1}_ms_emis")
    step(f"assigned_{_s}", assigned_sql(f"matches_{_s}"), f"matches_{_s}")


@query(
    "D3_restart_transitions",
    sql(
        " UNION ALL ".join(
            f"""SELECT {r}::INTEGER AS restart, {i}::INTEGER AS i, {j}::INTEGER AS j,
            round([[a00, a01, a02], [a10, a11, a12], [a20, a21, a22]][assigned_{s}.p{i} + 1][assigned_{s}.p{j} + 1], 6) AS p
            FROM {n}{ROUNDS - 1}_ms, assigned_{s}"""
            for r, (n, s) in enumerate(RESTARTS.items())
            for i in range(3)
            for j in range(3)
        ),
        *[f"{n}{ROUNDS - 1}_ms" for n in RESTARTS],
        *[f"assigned_{s}" for s in RESTARTS.values()],
    ),
)
def _(v):
    """Transitions of every restart, its states matched one to one with those of the counted model."""
    starts = [labelled_model(v.labelled, v.dim, 3, p) for p in START_PRIORS]
    models = em.fit(v.seqs, starts, PRIOR, max_iter=ROUNDS)
    return evaluate.restart_transitions(v.model.emis, models).withColumn("p", F.round("p", 6))


@query("D3_restart_transitions_to_the_end")
def _(v):
    """The same after fits by the stop rule."""
    starts = [labelled_model(v.labelled, v.dim, 3, p) for p in START_PRIORS]
    models = em.fit(v.seqs, starts, PRIOR, max_iter=BUDGET, tol=5.0)
    return evaluate.restart_transitions(v.model.emis, models)


@query("D4_convergence_to_the_end")
def _(v):
    """``D4_convergence`` by the stop rule; ``BUDGET`` rounds at most."""
    models = em.fit(v.seqs, [v.model], PRIOR, max_iter=BUDGET, tol=5.0)
    return em.history_table(v.spark, models)


@query("D5_entropy_convergence")
def _(v):
    starts = evaluate.entropy_starts(v.dim, 3, PRIOR, 4, known=v.model)
    return evaluate.entropy_trace(v.seqs, starts, PRIOR, BUDGET, tol=5.0)


@query("D6_grid")
def _(v):
    """Number of states and share of users; every configuration appends to one stored table."""
    path = scratch_path(v.spark, "grid")
    rows = evaluate.by_split(v.seq, test_user())
    configs = [{"states": 2}, {"states": 4}, {"states": 2, "share": 0.5}]
    evaluate.grid_study(rows, v.dim, configs, PRIOR, BUDGET, lambda df: df.write.mode("append").parquet(path), tol=5.0)
    return v.spark.read.parquet(path)


step(
    "tail_seq",
    f"SELECT user_id, CAST(chunk * {len(LENGTHS)} + which AS INTEGER) AS chunk, last_n, t, item_ix, n FROM suffixes",
    "suffixes",
)
evidence_steps("tail_ev", "tail_seq", "hmm_emis", False)
filter_steps("hfw", "tail_ev", "hmm")


@query(
    "D7_history_curve",
    sql(
        f"""SELECT CAST({LENGTHS}[chunk % {len(LENGTHS)} + 1] AS INTEGER) AS last_n, round(sum(c), 6) AS log_lik,
        count(*) AS sequences FROM hfw_end GROUP BY last_n""",
        "hfw_end",
    ),
)
def _(v):
    return evaluate.history_curve(v.seq, v.model, LENGTHS).withColumn("log_lik", F.round("log_lik", 6))


step(
    "part_label",
    "SELECT item_ix, p_brand || ': ' || p_type AS item_label FROM order_dim JOIN part ON p_partkey = item_id",
    "order_dim",
)


@query(
    "D8_session_trace",
    sql(
        f"""SELECT i.user_id, i.t, item_label, {r6('i.q0', 'i.r0', 'g.g0')},
        CAST(CASE WHEN i.q0 >= i.q1 AND i.q0 >= i.q2 THEN 0 WHEN i.q1 >= i.q2 THEN 1 ELSE 2 END AS INTEGER) AS top_state
        FROM ifw i JOIN ifw_g g USING (user_id, chunk, t) JOIN part_label USING (item_ix)""",
        "ifw",
        "ifw_g",
        "part_label",
    ),
)
def _(v):
    items = v.part.join(v.order_dim, "item_id")
    wanted = {n: F.round(F.col(c)[0], 6) for n, c in (("q0", "filt"), ("r0", "pred"), ("g0", "smooth"))}
    wanted["top_state"] = F.col("top_states")[0]
    rows = evaluate.session_trace(estep.sequences(v.order_items), v.order_model, items, 2, wanted=wanted)
    return rows.select("user_id", "t", "item_label", *wanted)


@query(
    "D9_state_concentration",
    sql(
        """SELECT item_ix, round(greatest(v0, v1, v2) / (v0 + v1 + v2), 6) AS concentration,
        round(ln(clicks), 6) AS log_clicks FROM order_hmm_emis JOIN pop USING (item_ix)""",
        "order_hmm_emis",
        "pop",
    ),
)
def _(v):
    rows = states.concentration(v.order_model.emis, evaluate.popularity(v.order_seq))
    return rows.select(
        "item_ix", F.round("concentration", 6).alias("concentration"), F.round(F.ln("clicks"), 6).alias("log_clicks")
    )


def spline_sql() -> str:
    """Least squares by orthogonalising the five columns one after the other, on data and grid points alike."""
    cube = lambda j: f"greatest(0.0, x - k[{j}]) ** 3"
    d = lambda j: f"({cube(j)} - {cube(5)}) / (k[5] - k[{j}])"
    body = "SELECT x, y, grid, 1.0::DOUBLE AS r0, x AS c1, " + ", ".join(f"{d(j)} - {d(4)} AS c{j + 1}" for j in (1, 2, 3)) + " FROM points, knots"
    steps = [f"o0 AS ({body})"]
    for j in range(1, 5):
        less = " - ".join(f"(SELECT sum(c{j} * r{i}) / sum(r{i} * r{i}) FROM o{j - 1} WHERE NOT grid) * r{i}" for i in range(j))
        steps.append(f"o{j} AS (SELECT *, c{j} - {less} AS r{j} FROM o{j - 1})")
    total = " + ".join(f"(SELECT sum(y * r{i}) / sum(r{i} * r{i}) FROM o4 WHERE NOT grid) * r{i}" for i in range(5))
    return f"WITH {', '.join(steps)} SELECT round(x, 6) AS x, round({total}, 4) AS prediction FROM o4 WHERE grid"


step(
    "xy",
    """SELECT ln(clicks) AS x, ln(greatest(v0, v1, v2) / (v0 + v1 + v2)) AS y FROM order_hmm_emis JOIN pop USING (item_ix)""",
    "order_hmm_emis",
    "pop",
)
step("knots", "SELECT quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0]) AS k FROM (SELECT DISTINCT x FROM xy)", "xy")
step("points", "SELECT x, y, false AS grid FROM xy UNION ALL SELECT 2 + 8 * i / 100.0, 0, true FROM (SELECT unnest(range(101)) AS i)", "xy")
step("spline", spline_sql(), "points", "knots")


@query("D10_spline_regression", sql("SELECT * FROM spline", "spline"))
def _(v):
    """Log concentration on log popularity, predicted on a grid of 101 points from 2 to 10."""
    rows = states.concentration(v.order_model.emis, evaluate.popularity(v.order_seq))
    rows = rows.select(F.ln("clicks").alias("x"), F.ln("concentration").alias("y"))
    grid = [2 + 8 * i / 100 for i in range(101)]
    return evaluate.spline_fit(rows, "x", "y", grid).select(F.round("x", 6).alias("x"), F.round("prediction", 4).alias("prediction"))


@query(
    "D11_transition_comparison",
    sql(
        " UNION ALL ".join(
            f"""SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, round(a.a{i}{j}, 6) AS fitted,
            round(b.a{i}{j}, 6) AS observed, {str(i == j).lower()} AS diagonal FROM train_hmm a, tms b"""
            for i in range(3)
            for j in range(3)
        ),
        "train_hmm",
        "tms",
    ),
)
def _(v):
    train, seen = reestimated(v)
    rows = evaluate.compare_transitions(v.spark, train.trans, seen.trans)
    return rows.select(
        "i", "j", F.round("fitted", 6).alias("fitted"), F.round("observed", 6).alias("observed"), "diagonal"
    )


@query(
    "D12_initial_and_stationary",
    sql(
        "SELECT s.state, round(ln(p), 6) AS log_stationary, round(ln(CASE s.state WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END), 6) AS log_initial "
        "FROM still s, order_hmm WHERE s.model = 'order_hmm'",
        "still",
        "order_hmm",
    ),
)
def _(v):
    still = states.stationary(all_transitions(v)).where("model = 'order_hmm'").select("state", F.col("p").alias("s"))
    first = vector_table(v.spark, v.order_model.pi)
    return still.join(first, "state").select(
        "state", F.round(F.ln("s"), 6).alias("log_stationary"), F.round(F.ln("p"), 6).alias("log_initial")
    )


@query(
    "D13_online_comparison",
    sql(
        f"""SELECT model, CASE WHEN ts > {SWITCH} THEN 'after' ELSE 'before' END AS period, sum(in_screen) AS shown,
        sum(clicks) AS clicked, round(sum(clicks) / sum(in_screen), 6) AS ctr FROM dashboard
        WHERE model IN ('m0', 'm1') GROUP BY model, period""",
        "dashboard",
    ),
)
def _(v):
    return evaluate.compare_models(dashboard(v), SWITCH, ["m0", "m1"]).withColumn("ctr", F.round("ctr", 6))


# ---- streams --------------------------------------------------------------------------------------------


def stream(v):
    return online.click_stream(v.spark, f"{v.folder}/events*.parquet", TYPES)


step(
    "raw_sessions",
    """SELECT user_id, s, min(us) AS start_us, max(us) AS end_us, count(*) AS items FROM (
    SELECT *, sum(split) OVER (PARTITION BY user_id ORDER BY us) AS s FROM gap_all) GROUP BY user_id, s""",
    "gap_all",
)
CLOSED = "end_us + 21600000000 < (SELECT max(us) FROM clicks) - 3600000000"


@query(
    "T1_live_sessions",
    sql(f"SELECT user_id, start_us, end_us, items AS clicks FROM raw_sessions WHERE {CLOSED}", "raw_sessions"),
)
def _(v):
    """Sessions the watermark has passed once the source is read to its end."""
    rows = online.replay(online.live_sessions(stream(v), "6 hours", "1 hour"))
    return rows.select(
        "user_id",
        F.unix_micros("start_ts").alias("start_us"),
        F.unix_micros("end_ts").alias("end_us"),
        "clicks",
    )


LIVE_SQL = sql(
    """SELECT user_id, us, round(n0, 6) AS n0, round(n1, 6) AS n1, round(n2, 6) AS n2 FROM (
    SELECT user_id, t, q0 * a00 + q1 * a10 + q2 * a20 AS n0, q0 * a01 + q1 * a11 + q2 * a21 AS n1,
    q0 * a02 + q1 * a12 + q2 * a22 AS n2 FROM cfw, hmm) JOIN click_seq USING (user_id, t)""",
    "cfw",
    "click_seq",
    "hmm",
)


def live_states(v):
    rows = online.replay(online.online_states(stream(v), v.model, v.dim))
    return rows.select("user_id", "us", *spread("next", "n"))


@query("T2_live_states", LIVE_SQL)
def _(v):
    return live_states(v)


@query(
    "R5_incremental_states",
    sql(
        f"SELECT user_id, {r6('n0', 'n1', 'n2')} FROM cfw_end",
        "cfw_end",
    ),
)
def _(v):
    """State of every user after the last click of the stream."""
    rows = online.replay(online.online_states(stream(v), v.model, v.dim))
    last = rows.groupBy("user_id").agg(F.max_by("next", "us").alias("next"))
    return last.select("user_id", *spread("next", "n"))


# the live model knows the items of the dictionary only: others are dropped before sessions are cut
step(
    "gap_known",
    """SELECT *, sum(split) OVER (PARTITION BY user_id ORDER BY us) AS s FROM (
    SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > 21600000000 THEN 1 ELSE 0 END AS split
    FROM clicks JOIN dim USING (item_id))""",
    "clicks",
    "dim",
)
step(
    "known_sessions",
    """SELECT user_id, s, min(us) AS start_us, max(us) AS end_us, count(*) AS items FROM gap_known
    GROUP BY user_id, s""",
    "gap_known",
)
step(
    "raw_session_seq",
    """SELECT user_id, CAST(0 AS INTEGER) AS chunk, CAST(s AS BIGINT) AS t, item_ix, count(*) AS n
    FROM gap_known GROUP BY user_id, s, item_ix""",
    "gap_known",
)
evidence_steps("raw_ev", "raw_session_seq", "hmm_emis", True)
filter_steps("sfw", "raw_ev", "hmm")
CLOSED_SQL = sql(
    """SELECT f.user_id, start_us, end_us, items, round(f.q0 * a00 + f.q1 * a10 + f.q2 * a20, 6) AS n0,
    round(f.q0 * a01 + f.q1 * a11 + f.q2 * a21, 6) AS n1, round(f.q0 * a02 + f.q1 * a12 + f.q2 * a22, 6) AS n2
    FROM sfw f JOIN known_sessions r ON r.user_id = f.user_id AND r.s = f.t, hmm
    WHERE f.t < (SELECT max(s) FROM known_sessions x WHERE x.user_id = f.user_id) OR """
    + CLOSED,
    "sfw",
    "known_sessions",
    "hmm",
)


def closed(v):
    return online.replay(online.online_sessions(stream(v), v.model, v.dim, GAP))


@query("T3_closed_sessions", CLOSED_SQL)
def _(v):
    return closed(v).select("user_id", "start_us", "end_us", "items", *spread("next", "n"))


@query(
    "R6_session_states",
    sql("SELECT f.user_id, count(*) AS sessions, CAST(sum(items) AS BIGINT) AS items FROM sfw f JOIN known_sessions r ON r.user_id = f.user_id AND r.s = f.t "
    "WHERE f.t < (SELECT max(s) FROM known_sessions x WHERE x.user_id = f.user_id) OR " + CLOSED + " GROUP BY f.user_id", "sfw", "known_sessions"),
)
def _(v):
    return closed(v).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("items").alias("items"))


# a purchase ends the session it belongs to
step(
    "ended",
    """SELECT *, sum(split) OVER (PARTITION BY user_id ORDER BY us) AS s FROM (
    SELECT *, CASE WHEN us - lag(us) OVER w > 21600000000 OR lag(ad_type) OVER w = 'purchase' THEN 1 ELSE 0 END AS split
    FROM clicks JOIN dim USING (item_id) WINDOW w AS (PARTITION BY user_id ORDER BY us))""",
    "clicks",
    "dim",
)
step(
    "ended_sessions",
    """SELECT user_id, s, min(us) AS start_us, max(us) AS end_us, count(*) AS items, bool_or(ad_type = 'purchase') AS done
    FROM ended GROUP BY user_id, s""",
    "ended",
)
step(
    "ended_seq",
    """SELECT user_id, CAST(0 AS INTEGER) AS chunk, CAST(s AS BIGINT) AS t, item_ix, count(*) AS n
    FROM ended GROUP BY user_id, s, item_ix""",
    "ended",
)
evidence_steps("end_ev", "ended_seq", "hmm_emis", True)
filter_steps("efw", "end_ev", "hmm")


@query(
    "T3_ended_sessions",
    sql(
        """SELECT f.user_id, start_us, end_us, items, round(f.q0 * a00 + f.q1 * a10 + f.q2 * a20, 6) AS n0,
        round(f.q0 * a01 + f.q1 * a11 + f.q2 * a21, 6) AS n1, round(f.q0 * a02 + f.q1 * a12 + f.q2 * a22, 6) AS n2
        FROM efw f JOIN ended_sessions r ON r.user_id = f.user_id AND r.s = f.t, hmm
        WHERE done OR f.t < (SELECT max(s) FROM ended_sessions x WHERE x.user_id = f.user_id) OR """
        + CLOSED,
        "efw",
        "ended_sessions",
        "hmm",
    ),
)
def _(v):
    """Closed by a control row after each purchase, by a gap, or by the watermark."""
    known = stream(v).join(v.dim, "item_id", "left_semi")
    end = F.when(F.col("ad_type") == "purchase", F.array("item_id", F.lit(None))).otherwise(F.array("item_id"))
    rows = known.withColumn("item_id", F.explode(end))
    live = online.replay(online.online_sessions(rows, v.model, v.dim, GAP))
    return live.select("user_id", "start_us", "end_us", "items", *spread("next", "n"))


@query("T4_running_popularity", sql("SELECT item_id, count(*) AS clicks FROM clicks GROUP BY item_id", "clicks"))
def _(v):
    """Counts after the last update of each item."""
    rows = online.replay(online.running_popularity(stream(v)), mode="update")
    return rows.groupBy("item_id").agg(F.max_by("clicks", "epoch").alias("clicks"))
