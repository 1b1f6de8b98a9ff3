import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import em, estep, evaluate, factor, scoring, states
from seqloom.operators.model import Model, emission_long, emission_table, load, matrix_table, save

RNG = np.random.default_rng(3)


def random_hmm(spark, k=4, n=37):
    return Model(
        RNG.dirichlet(np.ones(k)),
        RNG.dirichlet(np.ones(k), k),
        emission_table(spark, RNG.dirichlet(np.ones(n), k).T),
    )


@pytest.fixture(scope="module")
def hmm(spark):
    return random_hmm(spark)


def test_recommend_against_brute_force(spark, hmm):
    q = RNG.dirichlet(np.ones(4), 50)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "request_id long, q array<double>")
    for top in (4, 2):
        kept = q.copy()
        for r in kept:
            r[np.argsort(-r)[top:]] = 0
        score = kept @ hmm.dense.T
        for rows in (None, 5):
            out = scoring.recommend(df, hmm, 6, top, item_rows=rows).orderBy("request_id", "rank").toPandas()
            assert out["item_ix"].to_numpy().reshape(50, 6).tolist() == np.argsort(-score, axis=1)[:, :6].tolist()


def test_equal_scores_go_by_item(spark):
    m = Model(np.array([1.0]), np.array([[1.0]]), emission_table(spark, np.full((9, 1), 1 / 9)))
    df = spark.createDataFrame([(1, [1.0])], "request_id long, q array<double>")
    for rows in (None, 2):
        out = scoring.recommend(df, m, 4, item_rows=rows).orderBy("rank")
        assert [r.item_ix for r in out.collect()] == [0, 1, 2, 3]


def test_requests_with_unknown_items(spark, hmm):
    dim = spark.createDataFrame([(100 + i, i) for i in range(37)], "item_id long, item_ix int")
    df = spark.createDataFrame(
        [(1, [101, 5, 102]), (2, [7, 8]), (3, []), (4, [101, 102])], "request_id long, history array<long>"
    )
    out = {r.request_id: r.q for r in scoring.request_states(scoring.request_rows(df), dim, hmm).collect()}
    assert set(out) == {1, 4}
    assert out[1] == pytest.approx(out[4])
    v = hmm.dense
    p = hmm.pi
    for item in (1, 2):
        p = p * v[item]
        p = (p / p.sum()) @ hmm.trans
    assert out[1] == pytest.approx(p)
    targets = spark.createDataFrame([(1, 3), (1, 9), (2, 3)], "request_id long, item_ix int")
    states_df = scoring.request_states(scoring.request_rows(df), dim, hmm)
    got = {(r.request_id, r.item_ix): r.score for r in scoring.score_targets(states_df, hmm, targets).collect()}
    assert got == pytest.approx({(1, 3): float(p @ v[3]), (1, 9): float(p @ v[9])})


def test_sample_is_stable_and_distinct(spark, hmm):
    w = emission_long(hmm.emis).withColumnRenamed("v", "p")
    a = sorted(map(tuple, scoring.sample_items(w, 5, 1, ["state"]).select("state", "item_ix").collect()))
    b = sorted(map(tuple, scoring.sample_items(w.repartition(7), 5, 1, ["state"]).select("state", "item_ix").collect()))
    assert a == b and len(set(a)) == 20


def test_model_round_trip_and_old_layout(spark, hmm, tmp_path):
    hmm.history = [(0, -5.0), (1, -4.0)]
    save(hmm, str(tmp_path / "m"))
    back = load(spark, str(tmp_path / "m"))
    assert np.allclose(back.trans, hmm.trans) and np.allclose(back.dense, hmm.dense)
    assert back.history == hmm.history
    import shutil

    shutil.rmtree(tmp_path / "m" / "history")
    assert load(spark, str(tmp_path / "m")).history == []


def test_merge_and_match(spark, hmm):
    corr = np.array([[1, 0.1, 0.2, 0], [0.1, 1, 0.9, 0], [0.2, 0.9, 1, 0], [0, 0, 0, 1]], dtype=float)
    out = states.merge_states(hmm, corr, 3)
    assert out.pi == pytest.approx([hmm.pi[0], hmm.pi[1] + hmm.pi[2], hmm.pi[3]])
    assert np.allclose(out.dense[:, 1], (hmm.dense[:, 1] + hmm.dense[:, 2]) / 2)
    assert np.allclose(out.trans.sum(axis=1), 1)
    assert states.merge_states(hmm, -np.abs(corr), 3).states == 4
    order = [2, 0, 3, 1]
    mixed = Model(hmm.pi[order], hmm.trans[np.ix_(order, order)], emission_table(spark, hmm.dense[:, order]))
    back = states.relabel(mixed, hmm.emis)
    assert np.allclose(back.trans, hmm.trans) and np.allclose(back.dense, hmm.dense)


def test_stationary_of_several_models(spark, hmm):
    golden = np.array([[0.9, 0.1], [0.3, 0.7]])
    rows = [
        matrix_table(spark, m).select(F.lit(n).alias("model"), F.lit(0).alias("restart"), "i", "j", "p")
        for n, m in (("a", golden), ("b", hmm.trans))
    ]
    out = states.stationary(rows[0].unionByName(rows[1])).orderBy("model", "state").toPandas()
    assert out[out.model == "a"].p.tolist() == pytest.approx([0.75, 0.25])
    b = out[out.model == "b"].p.to_numpy()
    assert np.allclose(b @ hmm.trans, b)


@pytest.fixture(scope="module")
def fm(spark):
    n, k = 30, 3
    items = spark.createDataFrame([(i, [i % 4, i % 3]) for i in range(n)], "item_ix int, levels array<int>")
    x = RNG.gamma(1.0, 3.0, (n, k))
    weights = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "item_ix int, vec array<double>")
    return factor.start(items, k, 2, 1, penalty=0.05), weights


def value(m, weights):
    return factor.loss(m, weights) + factor.penalty(m)


def test_gradients_against_differences(spark, fm):
    m, weights = fm
    rows = m.items.select("item_ix", "par", "levels").join(weights.withColumnRenamed("vec", "x"), "item_ix")
    none = F.array(*[F.lit(0.0)] * 3)
    rows = rows.select("item_ix", "par", "levels", none.alias("m"), none.alias("v"), "x")
    mass = np.array(rows.agg(*[F.sum(F.col("x")[i]) for i in range(3)]).first())
    opt = factor._Adam.empty(0.01, [])
    opt.step = 1
    new, grads = factor._one_step(m, rows, mass, opt)
    eps = 1e-5

    def shifted(states=None, effects=None, items=None):
        return factor.FactorModel(
            m.states if states is None else states, m.effects if effects is None else effects,
            m.items if items is None else items, m.penalty,
        )

    s = m.states.copy()
    s[1, 0] += eps
    lo = m.states.copy()
    lo[1, 0] -= eps
    num = (value(shifted(states=s), weights) - value(shifted(states=lo), weights)) / (2 * eps)
    assert grads[0][1, 0] == pytest.approx(num, rel=1e-4)
    up, down = [c.copy() for c in m.effects], [c.copy() for c in m.effects]
    up[0][2, 1] += eps
    down[0][2, 1] -= eps
    num = (value(shifted(effects=up), weights) - value(shifted(effects=down), weights)) / (2 * eps)
    assert grads[1][2, 1] == pytest.approx(num, rel=1e-4)
    # first Adam memory is a tenth of the gradient
    got = new.where("item_ix = 7").first()["m"]
    for at in (0, 2):
        def move(by, at=at):
            par = F.transform("par", lambda p, i: F.when((F.col("item_ix") == 7) & (i == at), p + by).otherwise(p))
            return shifted(items=m.items.select("item_ix", par.alias("par"), "levels"))

        num = (value(move(eps), weights) - value(move(-eps), weights)) / (2 * eps)
        assert got[at] * 10 == pytest.approx(num, rel=1e-4)


def test_restrict_keeps_probabilities_and_fit_lowers_loss(spark, fm, tmp_path):
    m, weights = fm
    a = factor.log_selection(m).orderBy("item_ix").toPandas()["vec"].to_list()
    b = factor.log_selection(factor.restrict(m)).orderBy("item_ix").toPandas()["vec"].to_list()
    assert np.allclose(a, b)
    assert np.allclose(np.exp(np.array(a)).sum(axis=0), 1)
    train = factor.FactorFit(m)
    values = [value(m, weights), value(train.run(weights, 3), weights), value(train.run(weights, 3), weights)]
    assert values[0] > values[1] > values[2]
    factor.save(train.model, str(tmp_path / "f"))
    again = factor.load(spark, str(tmp_path / "f"), m.penalty)
    assert value(again, weights) == pytest.approx(values[2])


def test_stop_rule():
    def stops(values, tol):
        return [em.settled(values[: i + 1], tol) for i in range(len(values))]

    assert stops([-100 + i * 0.1 for i in range(20)], 1.0).index(True) == 7
    assert not any(stops([-100.0 - i for i in range(20)], 1.0))  # keeps falling
    assert not any(stops([-1.0] * 20, 0.0))
    # a fall inside the slow stretch starts the count again
    assert stops([-1.0, *[-1.0 + i * 0.01 for i in range(4)], *[-1.5 + i * 0.01 for i in range(12)]], 1.0).index(True) == 12


def test_history_curve_and_moments(spark, hmm):
    rows = [(u, 0, t, int(x), 1) for u in range(12) for t, x in enumerate(RNG.integers(0, 37, 3 + u))]
    df = spark.createDataFrame(rows, "user_id long, chunk int, t long, item_ix int, n int")
    full = {r.user_id: r.log_c for r in estep.next_state(estep.sequences(df), hmm).collect()}
    curve = {r.last_n: r.log_lik for r in evaluate.history_curve(df, hmm, [1, 50]).collect()}
    assert curve[50] == pytest.approx(sum(full.values()))
    last = {}
    for u, _, _, x, _ in rows:
        last[u] = x
    assert curve[1] == pytest.approx(sum(np.log(hmm.dense[x] @ hmm.pi) for x in last.values()))
    pop, cov = states.moments(estep.sequences(df, 4), hmm)
    g = np.array(estep.posterior(estep.sequences(df), hmm).toPandas()["smooth"].to_list())
    assert pop == pytest.approx(g.mean(axis=0))
    assert np.allclose(cov, np.cov(g.T, bias=True))


def test_large_catalogues_are_reduced_to_what_can_be_best(spark, monkeypatch):
    from seqloom.operators import scoring
    from seqloom.operators.model import Model, emission_table

    r = np.random.default_rng(4)
    v = r.integers(0, 12, (6000, 3)) / 6000.0  # many equal rows and zeros
    model = Model(np.ones(3) / 3, np.eye(3), emission_table(spark, v[::-1].copy()))
    q = np.concatenate([r.dirichlet(np.ones(3), 40), np.eye(3), np.zeros((1, 3))])
    states = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(q)], "request_id long, q array<double>")
    got = {}
    for name, limit in (("reduced", 100), ("all", 10_000)):
        monkeypatch.setattr(scoring, "PRUNE_ITEMS", limit)
        for top in (None, 2):
            rows = scoring.recommend(states, model, 7, top_states=top).collect()
            got[name, top] = sorted((x.request_id, x["rank"], x.item_ix, round(x.score, 12)) for x in rows)
    assert got["reduced", None] == got["all", None] and got["reduced", 2] == got["all", 2]
    monkeypatch.setattr(scoring, "PRUNE_SLICE", 500)
    rows, left = scoring.contenders(model.emis, 7)
    assert rows.count() == left < 200


def test_states_are_made_before_scores(spark, hmm):
    """A task that makes states and scores at once would hold two Python workers."""
    rows = spark.createDataFrame([(u, 0, t, (u + t) % 37, 1) for u in range(5) for t in range(4)], "user_id long, chunk int, t long, item_ix int, n int")
    q = estep.next_state(estep.sequences(rows), hmm).selectExpr("user_id AS request_id", "next AS q")
    out = scoring.recommend(q, hmm, 3)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert out.count() == 15
