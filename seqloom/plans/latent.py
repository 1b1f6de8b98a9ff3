"""Queries: latent-state model, factorised item probabilities, scoring."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import top_positions
from ..operators import draws, em, estep, factor, scoring, solver, state_table, states, topn
from ..operators.model import emission_long, labelled_model, labelled_models, matrix_table, vector_table
from ..runtime import settle
from .registry import query
from .relational import test_user, known_dim, long_model, requests, spread
from .sql import (
    EM_LAST,
    ROUNDS,
    START_PRIORS,
    emission_stats,
    evidence_steps,
    filter_steps,
    model_steps,
    mstep_steps,
    r6,
    sql,
    step,
    trace_sql,
)

KEYS = ["user_id", "chunk", "t"]
PRIOR = em.Prior(2.0, 2.0, 2.0)
#: Rounds of a fit that ends by the stop rule.
BUDGET = 90
#: Iterations of a fit of the factor model by itself, and within one round of EM (a round need not end its fit).
FIT_BUDGET = 500
ROUND_BUDGET = 1


def three(name: str, fmt: str, table: str, where: str = "") -> str:
    """Long form of three columns: one SELECT per state."""
    return " UNION ALL ".join(
        f"SELECT user_id, t, CAST({k} AS INTEGER) AS state, round({fmt.format(k=k)}, 6) AS {name} FROM {table} {where}"
        for k in range(3)
    )


# ---- evidence -------------------------------------------------------------------------------------


def session_evidence(v) -> DataFrame:
    return state_table.session_log_lik(v.order_seq, v.order_model.emis, KEYS)


@query("H1_session_log_lik", sql(three("log_f", "ln(f{k})", "order_ev"), "order_ev"))
def _(v):
    return session_evidence(v).select("user_id", "t", "state", F.round("log_f", 6).alias("log_f"))


@query("H2_item_log_lik", sql(three("log_f", "ln(f{k})", "ev"), "ev"))
def _(v):
    rows = state_table.item_log_lik(v.seq, v.model.emis, KEYS)
    return rows.select("user_id", "t", "state", F.round("log_f", 6).alias("log_f"))


@query(
    "H3_log_normalise",
    sql(
        " UNION ALL ".join(
            f"""SELECT user_id, t, CAST({k} AS INTEGER) AS state, round(f{k} / (f0 + f1 + f2), 6) AS q,
            round(ln(f0 + f1 + f2), 6) AS log_c FROM order_ev"""
            for k in range(3)
        ),
        "order_ev",
    ),
)
def _(v):
    rows = state_table.log_normalise(session_evidence(v), KEYS)
    return rows.select("user_id", "t", "state", F.round("q", 6).alias("q"), F.round("log_c", 6).alias("log_c"))


# ---- one-step set operations ----------------------------------------------------------------------


def first_states(v, t: int = 0) -> DataFrame:
    """Filtered state of every user at the first position."""
    here = v.seq.where(F.col("t") == t)
    prior = state_table.initial(here.select(*KEYS), v.model.pi)
    return state_table.update(prior, state_table.item_log_lik(here, v.model.emis, KEYS), KEYS)


@query("H4_update", sql(three("q", "q{k}", "fw", "WHERE t = 0"), "fw"))
def _(v):
    return first_states(v).select("user_id", "t", "state", F.round("q", 6).alias("q"))


def second_predicted(v) -> DataFrame:
    trans = matrix_table(v.spark, v.model.trans)
    return state_table.predict(first_states(v), trans, ["user_id", "chunk"])


@query("H5_predict", sql(three("p", "r{k}", "fw", "WHERE t = 1"), "fw"))
def _(v):
    return second_predicted(v).select("user_id", F.lit(1).cast("bigint").alias("t"), "state", F.round("p", 6).alias("p"))


step(
    "two_step",
    "SELECT a.user_id, CAST(0 AS BIGINT) AS t, "
    + ", ".join(
        f"a.q{i} * (" + " + ".join(f"a{i}{j} * b.q{j} / b.r{j}" for j in range(3)) + f") AS g{i}" for i in range(3)
    )
    + " FROM fw a JOIN fw b ON a.user_id = b.user_id AND a.chunk = b.chunk AND a.t = 0 AND b.t = 1, hmm",
    "fw",
    "hmm",
)


@query("H6_backward", sql(three("g", "g{k}", "two_step"), "two_step"))
def _(v):
    keys = ["user_id", "chunk"]
    trans = matrix_table(v.spark, v.model.trans)
    q, p = settle(first_states(v)), settle(second_predicted(v))
    here = v.seq.where(F.col("t") == 1)
    log_f = state_table.item_log_lik(here, v.model.emis, keys)
    g = state_table.update(p, log_f, keys).select(*keys, "state", F.col("q").alias("g"))
    out = state_table.backward(q, p, g, trans, keys)
    return out.select("user_id", F.lit(0).cast("bigint").alias("t"), "state", F.round("g", 6).alias("g"))


# ---- one-step set operations over all positions ----------------------------------------------------


def at_all(v, **names: str) -> list[DataFrame]:
    """Long tables (user, chunk, t, state, name) of columns of the posterior, stored once."""
    rows = settle(estep.posterior(v.seqs, v.model).select(*KEYS, *names))
    return [rows.select(*KEYS, F.posexplode(c).alias("state", name)) for c, name in names.items()]


def moved(rows: DataFrame, by: int) -> DataFrame:
    return rows.withColumn("t", F.col("t") + by)


@query("H4_update_all", sql(three("q", "q{k}", "fw"), "fw"))
def _(v):
    (p,) = at_all(v, pred="p")
    out = state_table.update(p, state_table.item_log_lik(v.seq, v.model.emis, KEYS), KEYS)
    return out.select("user_id", "t", "state", F.round("q", 6).alias("q"))


AFTER = "(SELECT user_id, t + 1 AS t, n0, n1, n2 FROM fw_end)"


@query(
    "H5_predict_all",
    sql(three("p", "r{k}", "fw", "WHERE t > 0") + " UNION ALL " + three("p", "n{k}", AFTER), "fw", "fw_end"),
)
def _(v):
    """The state after every position, the last included."""
    (q,) = at_all(v, filt="q")
    out = moved(state_table.predict(q, matrix_table(v.spark, v.model.trans), KEYS), 1)
    return out.select("user_id", "t", "state", F.round("p", 6).alias("p"))


@query("H6_backward_all", sql(three("g", "g{k}", "fw_g"), "fw_g"))
def _(v):
    """Every position from the one after it; the last one is smoothed as it is filtered."""
    q, p, g = at_all(v, filt="q", pred="p", smooth="g")
    p, g = moved(p.where("t > 0"), -1), moved(g.where("t > 0"), -1)
    back = state_table.backward(q, p, g, matrix_table(v.spark, v.model.trans), KEYS)
    last = q.join(g, [*KEYS, "state"], "left_anti").withColumnRenamed("q", "g")
    out = back.select(*KEYS, "state", "g").unionByName(last)
    return out.select("user_id", "t", "state", F.round("g", 6).alias("g"))


# ---- forward-backward -------------------------------------------------------------------------------


@query(
    "H7_forward_filter",
    sql(f"SELECT user_id, t, item_ix, {r6('q0', 'q1', 'q2', 'r0', 'r1', 'r2', 'c')} FROM fw", "fw"),
)
def _(v):
    rows = estep.posterior(v.seqs, v.model)
    cols = [*spread("filt", "q"), *spread("pred", "r"), F.round("log_c", 6).alias("c")]
    return rows.select("user_id", "t", "item_ix", *cols)


@query("H8_smoother", sql(f"SELECT user_id, t, {r6('g0', 'g1', 'g2')} FROM fw_g", "fw_g"))
def _(v):
    return estep.posterior(v.seqs, v.model).select("user_id", "t", *spread("smooth", "g"))


@query("H8_smoother_sessions", sql(f"SELECT user_id, t, {r6('g0', 'g1', 'g2')} FROM ofw_g", "ofw_g"))
def _(v):
    return estep.posterior(v.order_seqs, v.order_model).select("user_id", "t", *spread("smooth", "g"))


def stats(v, kind: str, orders: bool = False, **kw) -> DataFrame:
    seqs, m = (v.order_seqs, v.order_model) if orders else (v.seqs, v.model)
    return estep.statistics(seqs, [m], **kw).where(F.col("kind") == kind)


SMALL = "SELECT CAST(ix AS INTEGER) AS ix, {cols} FROM fw_small WHERE kind = '{kind}'"


@query("H9_initial_statistics", sql(SMALL.format(cols=r6("v0", "v1", "v2"), kind="pi"), "fw_small"))
def _(v):
    return stats(v, "pi").select("ix", *spread("vec", "v"))


@query("H10_transition_statistics", sql(SMALL.format(cols=r6("v0", "v1", "v2"), kind="trans"), "fw_small"))
def _(v):
    return stats(v, "trans").select("ix", *spread("vec", "v"))


@query(
    "H11_session_emission_statistics",
    sql(f"SELECT item_ix, {r6('v0', 'v1', 'v2')} FROM ofw_emis", "ofw_emis"),
)
def _(v):
    return stats(v, "emis", orders=True).select(F.col("ix").alias("item_ix"), *spread("vec", "v"))


@query("H12_item_emission_statistics", sql(f"SELECT item_ix, {r6('v0', 'v1', 'v2')} FROM fw_emis", "fw_emis"))
def _(v):
    return stats(v, "emis").select(F.col("ix").alias("item_ix"), *spread("vec", "v"))


step(
    "fw_all",
    """SELECT kind, CAST(ix AS INTEGER) AS ix, v0, v1, v2 FROM fw_small
    UNION ALL SELECT 'emis', item_ix, v0, v1, v2 FROM fw_emis""",
    "fw_small",
    "fw_emis",
)
step(
    "ofw_all",
    """SELECT kind, CAST(ix AS INTEGER) AS ix, v0, v1, v2 FROM ofw_small
    UNION ALL SELECT 'emis', item_ix, v0, v1, v2 FROM ofw_emis""",
    "ofw_small",
    "ofw_emis",
)


def all_stats(rows: DataFrame) -> DataFrame:
    return rows.select("kind", "ix", *spread("vec", "v"))


@query("H13_e_step", sql(f"SELECT kind, ix, {r6('v0', 'v1', 'v2')} FROM fw_all", "fw_all"))
def _(v):
    return all_stats(estep.statistics(v.seqs, [v.model]))


@query("H13_e_step_sharded", sql(f"SELECT kind, ix, {r6('v0', 'v1', 'v2')} FROM ofw_all", "ofw_all"))
def _(v):
    """Item rows co-grouped with blocks of segments, as for models too big to broadcast; segments
    of four sessions, so that most sequences go through the scan over segment edges."""
    seqs = estep.sequences(v.order_seq, 4)
    return all_stats(estep.statistics(seqs, [v.order_model], sharded=True))


def long_sql(name: str) -> str:
    parts = [f"SELECT 'emis' AS part, item_ix AS a, CAST({k} AS INTEGER) AS b, round(v{k}, 6) AS p FROM {name}_emis" for k in range(3)]
    parts += [f"SELECT 'pi', CAST({k} AS INTEGER), CAST(0 AS INTEGER), round(p{k}, 6) FROM {name}" for k in range(3)]
    parts += [
        f"SELECT 'trans', CAST({i} AS INTEGER), CAST({j} AS INTEGER), round(a{i}{j}, 6) FROM {name}"
        for i in range(3)
        for j in range(3)
    ]
    return " UNION ALL ".join(parts)


@query("H14_m_step", sql(long_sql("ms"), "ms", "ms_emis"))
def _(v):
    return long_model(em.reestimate(v.seqs, v.model, PRIOR))


@query("H15_em_loop")
def _(v):
    """EM from a random start with the stop rule; the likelihood after each round."""
    start = em.random_model(v.dim, 3, PRIOR, 7)
    models = em.fit(v.seqs, [start], PRIOR, max_iter=BUDGET, tol=5.0)
    return em.history_table(v.spark, models)


@query("H15_em_one_round", sql(long_sql("ms"), "ms", "ms_emis"))
def _(v):
    return long_model(em.fit(v.seqs, [v.model], PRIOR, max_iter=1)[0])


@query("H15_em_rounds", sql(long_sql(EM_LAST), EM_LAST, f"{EM_LAST}_emis"))
def _(v):
    """Parameters after some rounds from a counted model."""
    return long_model(em.fit(v.seqs, [v.model], PRIOR, max_iter=ROUNDS)[0])


@query("H16_parallel_em", sql(*trace_sql(["oem_a", "oem_b"], 2)))
def _(v):
    """All restarts share every pass over the sequences; partitions are the workers."""
    starts = labelled_models(v.order_labelled, v.order_dim, 3, START_PRIORS[:2])
    models = em.fit(v.order_seqs, starts, PRIOR, max_iter=2)
    return em.history_table(v.spark, models).withColumn("log_lik", F.round("log_lik", 4))


@query("H16_parallel_em_to_the_end")
def _(v):
    """``H16_parallel_em`` with all starts by the stop rule; ``BUDGET`` rounds at most."""
    starts = labelled_models(v.order_labelled, v.order_dim, 3, START_PRIORS)
    return em.history_table(v.spark, em.fit(v.order_seqs, starts, PRIOR, max_iter=BUDGET, tol=5.0))


@query(
    "H17_log_likelihood",
    sql("SELECT user_id, round(sum(c), 6) AS log_lik, count(*) AS positions FROM ofw GROUP BY user_id", "ofw"),
)
def _(v):
    rows = estep.log_likelihood(v.order_seqs, [v.order_model])
    return rows.select("user_id", F.round("log_lik", 6).alias("log_lik"), "positions")


@query(
    "H18_log_prior",
    sql(
        "SELECT 'emis' AS part, round(sum(ln(v0) + ln(v1) + ln(v2)), 6) AS log_prior FROM order_hmm_emis "
        "UNION ALL SELECT 'pi', round(ln(p0) + ln(p1) + ln(p2), 6) FROM order_hmm UNION ALL SELECT 'trans', round("
        + " + ".join(f"{'3 * ' if i == j else ''}ln(a{i}{j})" for i in range(3) for j in range(3))
        + ", 6) FROM order_hmm",
        "order_hmm",
        "order_hmm_emis",
    ),
)
def _(v):
    parts = em.log_prior(v.order_model, em.Prior(2, 2, 2, diag=4))
    rows = [(k, float(x)) for k, x in parts.items()]
    df = v.spark.createDataFrame(rows, "part string, log_prior double")
    return df.withColumn("log_prior", F.round("log_prior", 6))


@query(
    "H19_set_priors",
    """SELECT a.ix AS i, b.ix AS j, CASE WHEN a.ix = b.ix THEN 8.0::DOUBLE ELSE 3.0::DOUBLE END AS p FROM
    (SELECT CAST(unnest(range(k)) AS INTEGER) AS ix FROM (SELECT count(DISTINCT event_type) AS k FROM events)) a,
    (SELECT CAST(unnest(range(k)) AS INTEGER) AS ix FROM (SELECT count(DISTINCT event_type) AS k FROM events)) b""",
)
def _(v):
    k = v.events.select("event_type").distinct().count()
    return matrix_table(v.spark, em.Prior(3, 3, 3, diag=8).matrix(k))


def random_start_sql(states: int, seed: int) -> str:
    """Each part's gamma draws of shape 2 (sums of two exponential draws), scaled to sum 1 within ``g``."""
    k = f"(SELECT unnest(range({states}))::INTEGER AS b)"
    cells = f"""SELECT 'emis' AS part, 0 AS p, item_ix AS a, b, b AS g FROM order_dim, {k} UNION ALL
    SELECT 'trans', 1, x.b, y.b, x.b FROM {k} x, {k} y UNION ALL SELECT 'pi', 2, 0, b, 0 FROM {k}"""
    drawn = draws.uniform_sql(f"({cells}), (SELECT unnest(range(2)) AS r)", ["p", "a", "b", "r"], seed)
    summed = f"SELECT part, a, b, g, sum(-ln(u)) AS w FROM ({drawn}) GROUP BY ALL"
    share = f"SELECT part, a, b, w / sum(w) OVER (PARTITION BY part, g) AS p FROM ({summed})"
    return f"""SELECT part, CAST(CASE WHEN part = 'pi' THEN b ELSE a END AS INTEGER) AS a,
    CAST(CASE WHEN part = 'pi' THEN 0 ELSE b END AS INTEGER) AS b, round(p, 6) AS p FROM ({share})"""


@query("H20_random_start", sql(random_start_sql(5, 11), "order_dim"))
def _(v):
    return long_model(em.random_model(v.order_dim, 5, PRIOR, 11))


step("test_seq", "SELECT * FROM seq WHERE user_id % 5 = 0", "seq")
step("train_lab", "SELECT * FROM lab WHERE user_id % 5 <> 0", "lab")
step("test_lab", "SELECT * FROM lab WHERE user_id % 5 = 0", "lab")
model_steps("train_hmm", "train_lab", "dim")
model_steps("test_hmm", "test_lab", "dim")
evidence_steps("test_ev", "test_seq", "train_hmm_emis", False)
filter_steps("tfw", "test_ev", "train_hmm")
emission_stats("tfw", "tfw_found", "test_seq")
step(
    "tfw_emis",
    """SELECT item_ix, coalesce(v0, 0) AS v0, coalesce(v1, 0) AS v1, coalesce(v2, 0) AS v2
    FROM dim LEFT JOIN tfw_found USING (item_ix)""",
    "dim",
    "tfw_found",
)
mstep_steps("tms", "tfw_small", "tfw_emis")


def split_models(v):
    from ..operators.model import labelled_model

    return [labelled_model(v.labelled.where(c), v.dim, 3) for c in (~test_user(), test_user())]


def reestimated(v):
    """The train model and its parameters re-estimated once on the test users."""
    train = split_models(v)[0]
    return train, em.reestimate(estep.sequences(v.seq.where(test_user())), train, PRIOR)


@query("H21_reestimate", sql(long_sql("tms"), "tms", "tms_emis"))
def _(v):
    return long_model(reestimated(v)[1])


@query(
    "H22_state_popularity",
    sql(
        " UNION ALL ".join(
            f"SELECT CAST({k} AS INTEGER) AS state, round(avg(g{k}), 6) AS p FROM ofw_g" for k in range(3)
        ),
        "ofw_g",
    ),
)
def _(v):
    pop, _ = states.moments(v.order_seqs, v.order_model)
    return vector_table(v.spark, pop).withColumn("p", F.round("p", 6))


@query(
    "H23_state_correlation",
    sql(
        " UNION ALL ".join(
            f"""SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, round(covar_pop(g{i}, g{j}), 6) AS cov,
            round(corr(g{i}, g{j}), 5) AS corr FROM ofw_g"""
            for i in range(3)
            for j in range(3)
        ),
        "ofw_g",
    ),
)
def _(v):
    _, cov = states.moments(v.order_seqs, v.order_model)
    a = matrix_table(v.spark, cov).withColumnRenamed("p", "cov")
    b = matrix_table(v.spark, states.correlation(cov)).withColumnRenamed("p", "corr")
    return a.join(b, ["i", "j"]).select("i", "j", F.round("cov", 6).alias("cov"), F.round("corr", 5).alias("corr"))


step(
    "alike",
    " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, sum(v{i} * v{j}) / sqrt(sum(v{i} * v{i}) * sum(v{j} * v{j})) AS c FROM order_hmm_emis"
        for i, j in ((0, 1), (0, 2), (1, 2))
    ),
    "order_hmm_emis",
)
step("pair", "SELECT i, j FROM alike ORDER BY c DESC, i, j LIMIT 1", "alike")
step(
    "place",
    """SELECT s, CASE WHEN s = j THEN i WHEN s > j THEN s - 1 ELSE s END AS d
    FROM pair, (SELECT unnest([0, 1, 2]) AS s)""",
    "pair",
)
step(
    "order_cells",
    " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, a{i}{j} AS p FROM order_hmm" for i in range(3) for j in range(3)),
    "order_hmm",
)
step(
    "order_long",
    " UNION ALL ".join(f"SELECT item_ix, {k} AS s, v{k} AS v FROM order_hmm_emis" for k in range(3)),
    "order_hmm_emis",
)
step(
    "order_pi", " UNION ALL ".join(f"SELECT {k} AS s, p{k} AS p FROM order_hmm" for k in range(3)), "order_hmm"
)


def likeness(emis: DataFrame, k: int) -> np.ndarray:
    """Cosine between the item distributions of the states."""
    cells = [F.sum(F.col("vec")[i] * F.col("vec")[j]) for i in range(k) for j in range(k)]
    g = np.array(emis.agg(*cells).first()).reshape(k, k)
    d = np.sqrt(np.diag(g))
    return g / np.outer(d, d)


@query(
    "H24_merge_states",
    sql(
        """SELECT 'emis' AS part, item_ix AS a, CAST(d AS INTEGER) AS b, round(avg(v), 6) AS p
        FROM order_long JOIN place USING (s) GROUP BY item_ix, d
        UNION ALL SELECT 'pi', CAST(d AS INTEGER), CAST(0 AS INTEGER), round(sum(p), 6) FROM order_pi JOIN place USING (s) GROUP BY d
        UNION ALL SELECT 'trans', CAST(x.d AS INTEGER), CAST(y.d AS INTEGER), round(avg(p), 6) FROM (
          SELECT c.i, y.d, sum(p) AS p FROM order_cells c JOIN place y ON y.s = c.j GROUP BY c.i, y.d) y
          JOIN place x ON x.s = y.i GROUP BY x.d, y.d""",
        "order_long",
        "order_pi",
        "order_cells",
        "place",
    ),
)
def _(v):
    m = v.order_model
    return long_model(states.merge_states(m, likeness(m.emis, 3), 2))


step(
    "matches",
    " UNION ALL ".join(
        f"SELECT {i} AS true_state, {j} AS fit_state, sum(a.v{i} * ln(b.v{j})) AS fit "
        "FROM train_hmm_emis a JOIN test_hmm_emis b USING (item_ix)"
        for i in range(3)
        for j in range(3)
    ),
    "train_hmm_emis",
    "test_hmm_emis",
)
step(
    "matched",
    """SELECT true_state, fit_state FROM (SELECT *, row_number() OVER (PARTITION BY true_state
    ORDER BY round(fit, 9) DESC, fit_state) AS r FROM matches) WHERE r = 1""",
    "matches",
)


@query(
    "H25_align_states",
    sql(
        """SELECT CAST(true_state AS INTEGER) AS true_state, CAST(fit_state AS INTEGER) AS fit_state,
        count(*) OVER (PARTITION BY fit_state) > 1 AS duplicate FROM matched""",
        "matched",
    ),
)
def _(v):
    train, test = split_models(v)
    return states.match_states(train.emis, test.emis)


def assigned_sql(matches: str) -> str:
    """``p0..p2``: fitted state of each reference state in the best of all one-to-one matchings."""
    fit = lambda i, j: f"max(fit) FILTER (true_state = {i} AND fit_state = {j})"
    each = " UNION ALL ".join(
        f"SELECT {p[0]} AS p0, {p[1]} AS p1, {p[2]} AS p2, " + " + ".join(f"round({fit(i, j)}, 9)" for i, j in enumerate(p)) + f" AS total FROM {matches}"
        for p in permutations(range(3))
    )
    return f"SELECT p0, p1, p2 FROM ({each}) ORDER BY total DESC LIMIT 1"


def matches_sql(truth: str, est: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS true_state, {j} AS fit_state, sum(a.v{i} * ln(b.v{j})) AS fit FROM {truth} a JOIN {est} b USING (item_ix)"
        for i in range(3)
        for j in range(3)
    )


step("assigned", assigned_sql("matches"), "matches")


@query(
    "H25_assign_states",
    sql(" UNION ALL ".join(f"SELECT {i}::INTEGER AS true_state, p{i}::INTEGER AS fit_state, false AS duplicate FROM assigned" for i in range(3)), "assigned"),
)
def _(v):
    """One fitted state for each reference state, none twice."""
    train, test = split_models(v)
    return states.match_states(train.emis, test.emis, one_to_one=True)


def tree(m: str) -> str:
    """Stationary weights of a three-state chain by the spanning trees into each state."""
    w = [
        "a10 * a20 + a12 * a20 + a10 * a21",
        "a01 * a21 + a02 * a21 + a01 * a20",
        "a02 * a12 + a01 * a12 + a02 * a10",
    ]
    total = " + ".join(w)
    return " UNION ALL ".join(
        f"SELECT '{m}' AS model, CAST(0 AS INTEGER) AS restart, CAST({k} AS INTEGER) AS state, ({x}) / ({total}) AS p FROM {m}"
        for k, x in enumerate(w)
    )


step("still", tree("hmm") + " UNION ALL " + tree("order_hmm"), "hmm", "order_hmm")


def all_transitions(v) -> DataFrame:
    parts = [
        matrix_table(v.spark, m.trans).select(F.lit(n).alias("model"), F.lit(0).alias("restart"), "i", "j", "p")
        for n, m in (("hmm", v.model), ("order_hmm", v.order_model))
    ]
    return parts[0].unionByName(parts[1])


@query("H26_stationary", sql("SELECT model, restart, state, round(p, 6) AS p FROM still", "still"))
def _(v):
    return states.stationary(all_transitions(v)).withColumn("p", F.round("p", 6))


# ---- factorised item probabilities --------------------------------------------------------------------

step(
    "part_clicks",
    """SELECT item_ix, p_brand AS make, p_size / 50.0 AS b0, (p_retailprice - 900) / 100.0 AS b1,
    ln(1.0 + count(*)) AS bias, count(*) FILTER (ad_type = 'F') AS c0, count(*) FILTER (ad_type = 'O') AS c1,
    count(*) FILTER (ad_type = 'P') AS c2 FROM order_lines JOIN order_dim USING (item_id)
    JOIN part ON p_partkey = item_id GROUP BY item_ix, p_brand, p_size, p_retailprice""",
    "order_lines",
    "order_dim",
)
step(
    "side",
    "SELECT " + ", ".join(f"sum(c{k} * b{e}) / sum(c{k}) AS s{k}{e}" for k in range(3) for e in range(2)) + " FROM part_clicks",
    "part_clicks",
)
step(
    "effects",
    "SELECT make, "
    + ", ".join(f"ln((1.0 + sum(c{k})) / (3 + sum(c0 + c1 + c2))) AS e{k}" for k in range(3))
    + " FROM part_clicks GROUP BY make",
    "part_clicks",
)
step(
    "linear",
    "SELECT item_ix, b0, b1, bias, c0, c1, c2, "
    + ", ".join(f"s{k}0 * b0 + s{k}1 * b1 + bias + e{k} - (SELECT avg(e{k}) FROM effects) AS x{k}" for k in range(3))
    + " FROM part_clicks JOIN effects USING (make), side",
    "part_clicks",
    "effects",
    "side",
)
step(
    "soft",
    "SELECT item_ix, c0, c1, c2, "
    + ", ".join(f"x{k} - ln(sum(exp(x{k})) OVER ()) AS l{k}" for k in range(3))
    + " FROM linear",
    "linear",
)


def part_clicks(v) -> DataFrame:
    """Per part: attributes, clicks per order status."""
    counts = v.order_lines.groupBy("item_id").agg(
        *[F.count(F.when(F.col("ad_type") == s, 1)).alias(f"c{k}") for k, s in enumerate("FOP")],
        F.count("*").alias("all"),
    )
    return counts.join(v.order_dim, "item_id").join(v.part, "item_id")


def factor_model(v, penalty: float = 0.0):
    """Factor model whose parameters are counts and means of the tables; weights = status counts."""
    from ..operators.binning import encode_category

    rows = settle(encode_category(part_clicks(v), "make", 1, "level"))
    b = [F.col("size") / 50.0, (F.col("price") - 900) / 100.0]
    means = [F.sum(F.col(f"c{k}") * b[e]) / F.sum(f"c{k}") for k in range(3) for e in range(2)]
    side = np.array(rows.agg(*means).first()).reshape(3, 2)
    per_level = rows.groupBy("level").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(3)]).collect()
    effect = np.zeros((3, len(per_level)))
    for r in per_level:
        for k in range(3):
            effect[k, r["level"]] = np.log((1.0 + r[f"c{k}"]) / (3 + r["c0"] + r["c1"] + r["c2"]))
    items = rows.select(
        "item_ix", F.array(*b, F.log1p(F.col("all").cast("double"))).alias("par"), F.array("level").alias("levels")
    )
    weights = rows.select("item_ix", F.array(*[F.col(f"c{k}").cast("double") for k in range(3)]).alias("vec"))
    return factor.FactorModel(side, [effect], settle(items), penalty), settle(weights)


@query("M1_linear_score", sql(f"SELECT item_ix, {r6('x0', 'x1', 'x2')} FROM linear", "linear"))
def _(v):
    return factor.linear_scores(factor_model(v)[0]).select("item_ix", *spread("vec", "x"))


@query("M2_log_softmax", sql(f"SELECT item_ix, {r6('l0', 'l1', 'l2')} FROM soft", "soft"))
def _(v):
    return factor.log_selection(factor_model(v)[0]).select("item_ix", *spread("vec", "l"))


@query(
    "M3_loss",
    sql(
        """SELECT round(-sum(c0 * l0 + c1 * l1 + c2 * l2), 4) AS loss,
        round(-sum((c0 + 0.5) * l0 + (c1 + 0.5) * l1 + (c2 + 0.5) * l2), 4) AS loss_with_prior FROM soft""",
        "soft",
    ),
)
def _(v):
    fm, weights = factor_model(v)
    row = [(float(factor.loss(fm, weights)), float(factor.loss(fm, weights, 1.5)))]
    df = v.spark.createDataFrame(row, "loss double, loss_with_prior double")
    return df.select(F.round("loss", 4).alias("loss"), F.round("loss_with_prior", 4).alias("loss_with_prior"))


step(
    "spread_of",
    "SELECT avg(b0) AS m0, avg(b1) AS m1, stddev_samp(b0) AS d0, stddev_samp(b1) AS d1 FROM part_clicks",
    "part_clicks",
)
step(
    "wide",
    "SELECT *, "
    + ", ".join(f"s{k}{e} * d{e} - (s0{e} + s1{e} + s2{e}) / 3 * d{e} AS z{k}{e}" for k in range(3) for e in range(2))
    + ", (s00 + s10 + s20) / 3 * d0 AS o0, (s01 + s11 + s21) / 3 * d1 AS o1 FROM side, spread_of",
    "side",
    "spread_of",
)


@query(
    "M4_penalty",
    sql(
        "SELECT round(0.001 * (" + " + ".join(f"z{k}{e} * z{k}{e}" for k in range(3) for e in range(2)) + "), 9) AS penalty FROM wide",
        "wide",
    ),
)
def _(v):
    fm, _ = factor_model(v, penalty=0.001)
    df = v.spark.createDataFrame([(factor.penalty(fm),)], "penalty double")
    return df.withColumn("penalty", F.round("penalty", 9))


@query(
    "M5_restrict",
    sql(
        """SELECT item_ix, round((b0 - m0) / d0, 6) AS e0, round((b1 - m1) / d1, 6) AS e1,
        round(bias + o0 * (b0 - m0) / d0 + o1 * (b1 - m1) / d1, 6) AS e2 FROM part_clicks, wide""",
        "part_clicks",
        "wide",
    ),
)
def _(v):
    return factor.restrict(factor_model(v)[0]).items.select("item_ix", *spread("par", "e"))


@query("M6_gradient_fit")
def _(v):
    """Loss before and after a fit that ends by the stop rule, and why it ended."""
    fm, weights = factor_model(v, penalty=0.001)
    fit = solver.solve(fm, weights, budget=FIT_BUDGET)
    row = (fit.losses[0], fit.losses[-1], len(fit.losses) - 1, fit.ended)
    return v.spark.createDataFrame([row], "before double, after double, iterations int, ended string")


step(
    "off",
    "SELECT item_ix, " + ", ".join(f"exp(l{k}) * (SELECT sum(c{k}) FROM soft) - c{k} AS d{k}" for k in range(3)) + " FROM soft",
    "soft",
)


@query(
    "M6_gradient",
    sql(
        """SELECT 'item' AS side, item_ix AS ix, """
        + ", ".join(f"round({' + '.join(f'd{k} * s{k}{e}' for k in range(3))}, 6) AS g{e}" for e in range(2))
        + """, round(d0 + d1 + d2, 6) AS g2 FROM off, side UNION ALL """
        + " UNION ALL ".join(
            f"SELECT 'state', {e}::INT, {', '.join(f'round(sum(d{k} * b{e}), 6)' for k in range(3))} FROM off JOIN linear USING (item_ix)"
            for e in range(2)
        ),
        "off",
        "side",
        "linear",
    ),
)
def _(v):
    """Gradient of the loss: by item over its vector and bias, by vector entry over the states."""
    items, (states_, _), _ = solver.gradient(*factor_model(v))
    rows = items.select(F.lit("item").alias("side"), F.col("item_ix").alias("ix"), *spread("g", "g"))
    side = [("state", e, *[round(float(x), 6) for x in states_[:, e]]) for e in range(states_.shape[1])]
    return rows.unionByName(v.spark.createDataFrame(side, "side string, ix int, g0 double, g1 double, g2 double"))


def level_items(v) -> DataFrame:
    from ..operators.binning import bin_numeric, encode_category

    items = v.part.join(v.order_dim, "item_id")
    coded = bin_numeric(encode_category(items, "make", 20, "l0"), "price", 900.0, 1000.0, 20, 10.0, "l1")
    return settle(coded.select("item_ix", F.array("l0", "l1").alias("levels")))


@query(
    "M7_start_values",
    sql(
        "SELECT item_ix, "
        + ", ".join(f"round(max(CASE WHEN e = {e} THEN (2 * u - 1) * 0.1 * sqrt(6.0 / ((SELECT count(*) FROM order_dim) + 3)) END), 6) AS e{e}" for e in range(3))
        + ", 0.0::DOUBLE AS e3 FROM ("
        + draws.uniform_sql("(SELECT item_ix, 0 AS part FROM order_dim), (SELECT unnest(range(3)) AS e)", ["part", "item_ix", "e"], 5)
        + ") GROUP BY item_ix",
        "order_dim",
    ),
)
def _(v):
    fm = factor.start(level_items(v), 4, 3, 5)
    return fm.items.select("item_ix", *spread("par", "e", 4))


@query("M8_factorised_em")
def _(v):
    """EM to the stop rule, whose item probabilities are solved anew in every round from those of the one before."""
    fm = factor.start(level_items(v), 3, 3, 5, penalty=0.001)
    prior = em.Prior(3, 3, 3, diag=8)
    small = em.random_model(v.order_dim, 3, prior, 5)
    start = factor.initial_model(small.pi, small.trans, fm)
    hook = solver.emission_step([fm], budget=ROUND_BUDGET)
    models = em.fit(v.order_seqs, [start], prior, max_iter=BUDGET, tol=50.0, emission_step=hook)
    return em.history_table(v.spark, models)


@query(
    "M9_emission_table",
    sql("SELECT item_ix, " + ", ".join(f"round(exp(l{k}), 9) AS v{k}" for k in range(3)) + " FROM soft", "soft"),
)
def _(v):
    return factor.emission(factor_model(v)[0]).select("item_ix", *spread("vec", "v", 3, 9))


# ---- scoring ------------------------------------------------------------------------------------------


def user_states(v) -> DataFrame:
    rows = estep.next_state(v.seqs, v.model)
    return rows.select(F.col("user_id").alias("request_id"), F.col("next").alias("q"))


@query("R1_next_state", sql(f"SELECT user_id AS request_id, {r6('n0', 'n1', 'n2')} FROM fw_end", "fw_end"))
def _(v):
    return user_states(v).select("request_id", *spread("q", "n"))


def top_sql(end: str, emis: str, n: int, item: str = "item_ix", keep: int = 3) -> str:
    """Best items per user; states below the ``keep`` strongest count as 0."""
    kept = [f"CASE WHEN (n{k} < n{a})::INT + (n{k} < n{b})::INT < {keep} THEN n{k} ELSE 0 END AS w{k}" for k, a, b in ((0, 1, 2), (1, 0, 2), (2, 0, 1))]
    return f"""SELECT request_id, {item}, CAST(rank AS INTEGER) AS rank, round(score, 9) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_ix) AS rank FROM (
    SELECT user_id AS request_id, item_ix, round(w0 * v0 + w1 * v1 + w2 * v2, 12) AS score FROM (
    SELECT *, {", ".join(kept)} FROM {end}), {emis})) WHERE rank <= {n}"""


def ranked(rows: DataFrame) -> DataFrame:
    return rows.select("request_id", "item_ix", "rank", F.round("score", 9).alias("score"))


@query("R2_item_scores", sql(top_sql("fw_end", "hmm_emis", 10), "fw_end", "hmm_emis"))
def _(v):
    return ranked(scoring.recommend(user_states(v), v.model, 10))


@query("R2_item_scores_blocked", sql(top_sql("fw_end", "hmm_emis", 10, keep=2), "fw_end", "hmm_emis"))
def _(v):
    """Item blocks against request blocks, as for models too big to copy; two strongest states."""
    return ranked(scoring.recommend(user_states(v), v.model, 10, top_states=2, item_rows=30))


@query("R2_item_scores_pruned", sql(top_sql("fw_end", "hmm_emis", 10, keep=2), "fw_end", "hmm_emis"))
def _(v):
    """Blocks of like items, seen only where their bound reaches the request's n-th best score."""
    blocks = topn.item_blocks(v.model, block_items=8)
    return ranked(topn.recommend(user_states(v), v.model, 10, top_states=2, blocks=blocks))


@query("R2_pruned_share")
def _(v):
    """How many of all request x item scores the pruned search makes."""
    return topn.search(user_states(v), v.model, 10, blocks=topn.item_blocks(v.model, block_items=8))[1]


step("target", "SELECT DISTINCT user_id AS request_id, item_ix FROM seq", "seq")


@query(
    "R3_target_scores",
    sql(
        """SELECT request_id, item_ix, round(n0 * v0 + n1 * v1 + n2 * v2, 9) AS score FROM target
        JOIN fw_end ON user_id = request_id JOIN hmm_emis USING (item_ix)""",
        "target",
        "fw_end",
        "hmm_emis",
    ),
)
def _(v):
    targets = v.seq.select(F.col("user_id").alias("request_id"), "item_ix").distinct()
    rows = scoring.score_targets(user_states(v), v.model, targets)
    return rows.withColumn("score", F.round("score", 9))


step(
    "request_seq",
    """SELECT request_id AS user_id, CAST(0 AS INTEGER) AS chunk, item_ix, 1 AS n,
    row_number() OVER (PARTITION BY request_id ORDER BY pos) - 1 AS t FROM request JOIN known_dim USING (item_id)""",
    "request",
    "known_dim",
)
evidence_steps("request_ev", "request_seq", "hmm_emis", False)
filter_steps("rfw", "request_ev", "hmm")


@query("R4_request_scoring", sql(top_sql("rfw_end", "hmm_emis", 5, keep=2), "rfw_end", "hmm_emis"))
def _(v):
    q = scoring.request_states(requests(v), known_dim(v), v.model)
    return ranked(scoring.recommend(q, v.model, 5, top_states=2))


@query(
    "K2_top_states",
    sql(
        "SELECT request_id, CAST(state AS INTEGER) AS state, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY p DESC, state) AS r FROM ("
        + " UNION ALL ".join(f"SELECT user_id AS request_id, {k} AS state, n{k} AS p FROM fw_end" for k in range(3))
        + ")) WHERE r <= 2",
        "fw_end",
    ),
)
def _(v):
    rows = user_states(v).select("request_id", F.explode(top_positions(F.col("q"), 2)).alias("s"))
    return rows.select("request_id", F.col("s.state").alias("state"), F.round("s.p", 6).alias("p"))


@query(
    "K3_top_states_per_position",
    sql(
        "SELECT DISTINCT user_id, CAST(state AS INTEGER) AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id, t ORDER BY p DESC, state) AS r FROM ("
        + " UNION ALL ".join(f"SELECT user_id, t, {k} AS state, q{k} AS p FROM ifw" for k in range(3))
        + ")) WHERE r = 1",
        "ifw",
    ),
)
def _(v):
    post = estep.posterior(estep.sequences(v.order_items), v.order_model)
    best = F.explode(top_positions(F.col("filt"), 1)).alias("s")
    return post.select("user_id", best).select("user_id", F.col("s.state").alias("state")).distinct()


@query("K4_top_scores", sql(top_sql("ofw_end", "order_hmm_emis", 2), "ofw_end", "order_hmm_emis"))
def _(v):
    rows = estep.next_state(v.order_seqs, v.order_model)
    q = rows.select(F.col("user_id").alias("request_id"), F.col("next").alias("q"))
    return ranked(scoring.recommend(q, v.order_model, 2))


@query(
    "K5_weighted_sample",
    sql(
        "SELECT state, CAST(draw AS INTEGER) AS draw, item_ix FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY "
        "-ln((('0x' || substr(md5('3,' || state || ',' || item_ix), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0) / v, "
        "item_ix) AS draw FROM ("
        + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS state, item_ix, v{k} AS v FROM order_hmm_emis" for k in range(3))
        + ") WHERE v > 0) WHERE draw <= 20",
        "order_hmm_emis",
    ),
)
def _(v):
    """Twenty items per state, drawn without replacement by their probability in the state."""
    weights = emission_long(v.order_model.emis).withColumnRenamed("v", "p")
    return scoring.sample_items(weights, 20, 3, ["state"]).select("state", "draw", "item_ix")


step(
    "click_seq",
    """SELECT user_id, CAST(0 AS INTEGER) AS chunk, us, item_ix, 1 AS n,
    row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS t FROM clicks JOIN dim USING (item_id)""",
    "clicks",
    "dim",
)
evidence_steps("click_ev", "click_seq", "hmm_emis", False)
filter_steps("cfw", "click_ev", "hmm")
