import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import em, estep, kernel, scoring
from seqloom.operators.model import Model, emission_table

PI = np.array([0.5, 0.5])
A = np.array([[0.9, 0.1], [0.1, 0.9]])
V = np.array([[0.5, 0.4, 0.1], [0.33, 0.33, 0.34]])
USERS = {1: [0, 1, 2, 2], 2: [2, 0], 3: [1]}


@pytest.fixture(scope="module")
def model(spark):
    return Model(PI, A, emission_table(spark, V.T))


@pytest.fixture(scope="module")
def seq(spark):
    rows = [(u, 0, t, x, 1) for u, xs in USERS.items() for t, x in enumerate(xs)]
    return spark.createDataFrame(rows, "user_id long, chunk int, t long, item_ix int, n int")


def test_update_predict_backward_golden():
    v = np.array([[0.2, 0.1, 0.1, 0.6], [0.1, 0.3, 0.2, 0.4], [0.4, 0.2, 0.3, 0.1]])
    f = np.log(v) @ np.array([0, 1, 0, 2])
    q, _ = kernel.update(f[None], np.array([[0.6, 0.1, 0.3]]))
    assert q[0] == pytest.approx([0.8, 0.1777777778, 0.0222222222])
    a = np.array([[0.2, 0.2, 0.4, 0.2], [0.1, 0.4, 0.2, 0.3], [0.25] * 4, [0.4, 0.6, 0, 0]])
    filtered = np.array([[0.1, 0.3, 0.2, 0.4]])
    predicted = filtered @ a
    assert predicted[0] == pytest.approx([0.26, 0.43, 0.15, 0.16])
    g, _ = kernel.update(np.r_[f, f[2]][None], predicted)
    assert g[0] == pytest.approx([0.3056825604, 0.6740692358, 0.0097975180, 0.0104506858])
    smoothed = filtered * (kernel.ratio(g, predicted) @ a.T)
    assert smoothed[0] == pytest.approx([0.0587851078, 0.2331809275, 0.1436969301, 0.5643370346])
    assert kernel.stationary(np.array([[0.9, 0.1], [0.3, 0.7]]))[0] == pytest.approx([0.75, 0.25])


def _posterior(spark, seqs, model, **kw):
    out = {}
    for r in estep.posterior(seqs, model, **kw).orderBy("user_id", "t").collect():
        out.setdefault(r.user_id, []).append(r)
    return out


@pytest.mark.parametrize("segment", [100, 1, 2])
@pytest.mark.parametrize("sharded", [False, True])
def test_e_step_golden(spark, model, seq, segment, sharded):
    seqs = estep.sequences(seq, segment)
    post = _posterior(spark, seqs, model, sharded=sharded)
    filt = {u: [round(r.filt[0], 8) for r in rows] for u, rows in post.items()}
    smooth = {u: [round(r.smooth[0], 8) for r in rows] for u, rows in post.items()}
    assert filt[1] == pytest.approx([0.60240964, 0.6278639, 0.3081559, 0.13492164])
    assert smooth[1] == pytest.approx([0.3598655, 0.27396832, 0.14877829, 0.13492164])
    assert smooth[2] == pytest.approx([0.2904739, 0.37286505])
    assert [r.item_ix for r in post[1]] == USERS[1]
    lik = {r.user_id: r.log_lik for r in estep.log_likelihood(seqs, [model], sharded).collect()}
    assert lik == pytest.approx({1: -4.8635197498, 2: -2.4872293452, 3: -1.0078579254})
    nxt = {r.user_id: r.next for r in estep.next_state(seqs, model, sharded).collect()}
    assert nxt[1] == pytest.approx([0.20793731, 0.79206269])
    stats = estep.statistics(seqs, [model], sharded=sharded).collect()
    got = {(r.kind, r.ix): r.vec for r in stats}
    assert got["pi", 0] == pytest.approx([1.19828461, 1.80171539])
    assert got["trans", 0] == pytest.approx([0.77344784, 0.29963817])
    assert got["trans", 1] == pytest.approx([0.15708545, 2.76982855])
    assert got["emis", 2] == pytest.approx([0.57417382, 2.42582618])
    assert got["lik", 0][0] == pytest.approx(-8.3586070203)


def test_m_step_golden(spark, model, seq):
    new = em.reestimate(estep.sequences(seq), model, em.Prior())
    assert new.pi == pytest.approx([0.43965692, 0.56034308])
    assert new.trans[1] == pytest.approx([0.23484994, 0.76515006])
    assert new.dense[:, 0] == pytest.approx([0.33784209, 0.35523069, 0.30692722])
    assert sum(em.log_prior(model, em.Prior()).values()) == pytest.approx(-13.4103434943)


def test_late_evidence(spark):
    trans = np.array([[1.0, 0.0], [0.1, 0.9]])
    v = np.array([[0.9, 0.1, 0.0], [0.1, 0.1, 0.8]])
    m = Model(np.array([0.5, 0.5]), trans, emission_table(spark, v.T))
    rows = [(1, 0, t, x, 1) for t, x in enumerate([0, 0, 0, 0, 0, 0, 2])]
    df = spark.createDataFrame(rows, "user_id long, chunk int, t long, item_ix int, n int")
    for segment in (100, 2):
        first = estep.posterior(estep.sequences(df, segment), m).where("t = 0").first()
        assert first.smooth[1] > 0.999


def test_ragged_sessions(spark):
    v = np.array([[0.2, 0.3, 0.5], [0.0, 1.0, 0.0]])
    m = Model(np.array([0.5, 0.5]), np.array([[0.5, 0.5], [0.5, 0.5]]), emission_table(spark, v.T))
    rows = [(1, 0, 0, 1, 2), (1, 0, 1, 0, 1), (1, 0, 1, 1, 5)]
    df = spark.createDataFrame(rows, "user_id long, chunk int, t long, item_ix int, n int")
    post = estep.posterior(estep.sequences(df), m).orderBy("t").collect()
    w = 0.5 * 0.3**2
    assert post[0].filt == pytest.approx([w / (w + 0.5), 0.5 / (w + 0.5)])
    assert post[1].filt == pytest.approx([1, 0])
    stats = {(r.kind, r.ix): r.vec for r in estep.statistics(estep.sequences(df), [m]).collect()}
    assert sum(sum(stats["emis", i]) for i in range(2)) == pytest.approx(8)


def test_impossible_sequence(spark):
    v = np.array([[1.0, 0.0], [1.0, 0.0]])
    m = Model(np.array([0.5, 0.5]), np.array([[0.5, 0.5], [0.5, 0.5]]), emission_table(spark, v.T))
    df = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 0, 1, 1, 1)], "user_id long, chunk int, t long, item_ix int, n int")
    assert estep.log_likelihood(estep.sequences(df), [m]).first().log_lik == -np.inf


def test_objective_never_falls_and_paths_agree(spark, seq):
    rng = np.random.default_rng(0)
    rows = [(u, 0, t, int(x), 1) for u in range(40) for t, x in enumerate(rng.integers(0, 9, rng.integers(1, 30)))]
    df = spark.createDataFrame(rows, "user_id long, chunk int, t long, item_ix int, n int")
    items = df.select("item_ix").distinct()
    prior = em.Prior(2, 2, 2, diag=4)
    starts = [em.random_model(items, 3, prior, s) for s in (1, 2)]
    values = [[], []]

    def note(it, models):
        for r, m in enumerate(models):
            values[r].append(sum(em.log_prior(m, prior).values()))

    a = em.fit(estep.sequences(df), starts, prior, 6, on_round=note)
    for r, m in enumerate(a):
        lik = [x for _, x in m.history]
        first = sum(em.log_prior(starts[r], prior).values())
        goal = [x + y for x, y in zip(lik, [first, *values[r][:-1]])]
        assert all(y >= x - 1e-9 for x, y in zip(goal, goal[1:]))
    b = em.fit(estep.sequences(df, 7), starts, prior, 6, sharded=True)
    for m, n in zip(a, b):
        assert np.allclose(m.trans, n.trans, atol=1e-9)
        assert np.allclose(m.dense, n.dense, atol=1e-9)
        assert [x for _, x in m.history] == pytest.approx([x for _, x in n.history])
    t = em.statistics(estep.sequences(df), starts).where("kind = 'trans' and restart = 0")
    total = t.select(F.explode("vec").alias("v")).agg(F.sum("v")).first()[0]
    assert total == pytest.approx(len(rows) - 40)


def test_true_parameters_stay(spark):
    """One round at the true parameters of a long sample moves them by sampling noise only."""
    rng = np.random.default_rng(1)
    pi = np.array([0.2, 0.5, 0.3])
    trans = np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.1, 0.2, 0.7]])
    v = np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1], [0.05, 0.05, 0.2, 0.7]])
    users, steps = 1000, 100
    state = (rng.random(users)[:, None] > pi.cumsum()).sum(axis=1)
    items = np.empty((users, steps), int)
    for t in range(steps):
        items[:, t] = (rng.random(users)[:, None] > v.cumsum(axis=1)[state]).sum(axis=1)
        state = (rng.random(users)[:, None] > trans.cumsum(axis=1)[state]).sum(axis=1)
    import pandas as pd

    u, t = np.divmod(np.arange(users * steps), steps)
    df = spark.createDataFrame(pd.DataFrame({"user_id": u, "chunk": 0, "t": t, "item_ix": items.ravel(), "n": 1}))
    m = Model(pi, trans, emission_table(spark, v.T))
    prior = em.Prior(1, 1, 1)
    new = em.reestimate(estep.sequences(df), m, prior)
    assert np.allclose(new.trans, trans, atol=0.02) and np.allclose(new.dense.T, v, atol=0.02)
    assert np.allclose(new.pi, pi, atol=0.06)
    other = em.reestimate(estep.sequences(df.repartition(1), 33), m, prior)
    assert np.allclose(new.trans, other.trans, atol=1e-9) and np.allclose(new.dense, other.dense, atol=1e-9)


def test_state_without_mass_keeps_its_row(spark, seq):
    m = Model(np.array([1.0, 0.0]), np.array([[1.0, 0.0], [0.5, 0.5]]), emission_table(spark, V.T))
    for sharded in (False, True):
        new = em.fit(estep.sequences(seq), [m], em.Prior(1, 1, 1), 1, sharded=sharded)[0]
        assert np.allclose(new.trans[1], [0.5, 0.5]) and np.allclose(new.dense[:, 1], V[1])


def test_models_too_big_to_copy(spark, monkeypatch):
    """With the size limit at one number everything runs on tables, with equal results."""
    rng = np.random.default_rng(2)
    rows = [(u, 0, t, int(x), 1) for u in range(30) for t, x in enumerate(rng.integers(0, 12, rng.integers(1, 20)))]
    df = spark.createDataFrame(rows, "user_id long, chunk int, t long, item_ix int, n int")
    items = df.select("item_ix").distinct()
    prior = em.Prior(2, 2, 2)
    seqs = estep.sequences(df, 6)
    starts = [em.random_model(items, 3, prior, s) for s in (1, 2)]
    small = em.fit(seqs, starts, prior, 3)
    dense = [m.dense for m in small]
    lik = sorted(map(tuple, estep.log_likelihood(seqs, small).select("restart", "user_id", "log_lik").collect()))
    for module in ("model", "em", "estep"):
        monkeypatch.setattr(f"seqloom.operators.{module}.DENSE_LIMIT", 1)
    again = [em.random_model(items, 3, prior, s) for s in (1, 2)]
    big = em.fit(seqs, again, prior, 3)
    for m, want, d in zip(big, small, dense):
        with pytest.raises(ValueError):
            m.dense
        assert np.allclose(m.trans, want.trans, atol=1e-9)
        got = {r.item_ix: r.vec for r in m.emis.collect()}
        assert all(np.allclose(got[i], d[i], atol=1e-9) for i in range(12))
        assert [x for _, x in m.history] == pytest.approx([x for _, x in want.history])
    other = sorted(map(tuple, estep.log_likelihood(seqs, big).select("restart", "user_id", "log_lik").collect()))
    assert [x[:2] for x in lik] == [x[:2] for x in other]
    assert [x[2] for x in lik] == pytest.approx([x[2] for x in other])


def test_gaps_between_item_indexes(spark, monkeypatch):
    """Items 0, 2 and 7 only: no form of the model may give mass to, or recommend, an index without an item."""
    rows = [(u, 0, t, x, 1) for u in range(6) for t, x in enumerate([0, 2, 7, 7, 2][: 2 + u % 4])]
    df = spark.createDataFrame(rows, "user_id long, chunk int, t long, item_ix int, n int")
    prior, items = em.Prior(3, 3, 3), df.select("item_ix").distinct()
    seqs, start = estep.sequences(df), em.random_model(df.select("item_ix").distinct(), 2, prior, 1)
    q = spark.createDataFrame([(1, [0.5, 0.5])], "request_id long, q array<double>")

    def both():
        new = em.fit(seqs, [em.random_model(items, 2, prior, 1)], prior, 3)[0]
        best = [r.item_ix for r in scoring.recommend(q, new, 10).orderBy("rank").collect()]
        return {r.item_ix: r.vec for r in new.emis.collect()}, best

    dense, best = both()
    assert sorted(dense) == sorted(best) == [0, 2, 7] and start.n_items == 3
    assert np.allclose(np.array(list(dense.values())).sum(axis=0), 1)
    for module in ("model", "em", "estep"):
        monkeypatch.setattr(f"seqloom.operators.{module}.DENSE_LIMIT", 1)
    table, other = both()
    assert best == other and all(np.allclose(table[i], dense[i], atol=1e-9) for i in dense)


@pytest.mark.parametrize("limit", [23, 24, 25, 97])
def test_one_answer_around_the_limit(spark, monkeypatch, limit):
    """12 items x 2 states are 24 numbers: just above, at and below the limit, and far below it."""
    rng = np.random.default_rng(4)
    rows = [(u, 0, t, int(x), 1) for u in range(10) for t, x in enumerate(rng.permutation(12))]
    df = spark.createDataFrame(rows, "user_id long, chunk int, t long, item_ix int, n int")
    prior = em.Prior(2, 2, 2)
    start = em.random_model(df.select("item_ix").distinct(), 2, prior, 1)
    want = em.fit(estep.sequences(df), [start], prior, 2)[0]
    for module in ("model", "em", "estep"):
        monkeypatch.setattr(f"seqloom.operators.{module}.DENSE_LIMIT", limit)
    again = em.fit(estep.sequences(df), [em.random_model(df.select("item_ix").distinct(), 2, prior, 1)], prior, 2)[0]
    expected = {r.item_ix: r.vec for r in want.emis.collect()}
    assert all(np.allclose(r.vec, expected[r.item_ix], atol=1e-9) for r in again.emis.collect())
    assert np.allclose(again.trans, want.trans, atol=1e-9)


def test_restarts_in_groups(spark, monkeypatch):
    rows = [(u, 0, t, (u + t) % 5, 1) for u in range(9) for t in range(1 + u)]
    df = spark.createDataFrame(rows, "user_id long, chunk int, t long, item_ix int, n int")
    prior = em.Prior(2, 2, 2)
    seqs = estep.sequences(df)
    models = [em.random_model(df.select("item_ix").distinct(), 2, prior, s) for s in range(5)]
    together = em.fit(seqs, models, prior, 2)
    monkeypatch.setattr("seqloom.operators.estep.DENSE_LIMIT", 11)  # one model has 10 numbers
    apart = em.fit(seqs, models, prior, 2)
    for a, b in zip(together, apart):
        assert np.allclose(a.trans, b.trans) and np.allclose(a.dense, b.dense)


def test_session_evidence_keeps_a_key_in_one_row(spark):
    """States are spread after the exchange, and the scaling per key needs no exchange of its own."""
    from seqloom.operators import state_table
    from seqloom.operators.model import emission_table

    emis = emission_table(spark, np.array([[0.5, 0.0], [0.2, 0.7], [0.3, 0.3]]))
    seq = spark.createDataFrame([(1, 0, 0, 0, 2), (1, 0, 0, 1, 1), (1, 0, 1, 2, 3), (2, 0, 0, 1, 1)], "user_id long, chunk int, t long, item_ix int, n long")
    keys = ["user_id", "chunk", "t"]
    rows = state_table.session_log_lik(seq, emis, keys)
    got = {(r.user_id, r.t, r.state): r.log_f for r in rows.collect()}
    want = {
        (1, 0, 0): 2 * np.log(0.5) + np.log(0.2), (1, 0, 1): -np.inf, (1, 1, 0): 3 * np.log(0.3), (1, 1, 1): 3 * np.log(0.3),
        (2, 0, 0): np.log(0.2), (2, 0, 1): np.log(0.7),
    }
    assert got == pytest.approx(want)
    out = state_table.log_normalise(rows, keys)
    assert {r.q for r in out.where("user_id = 1 AND t = 1").collect()} == {0.5}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
