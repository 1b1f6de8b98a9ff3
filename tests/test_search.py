"""Pruned search next to scoring everything, matchings next to all orders, draws next to their distributions."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import draws, em, evaluate, scoring, states, topn
from seqloom.operators.model import Model, emission_table


def catalogue(spark, n, k, seed, sparse=0.05):
    """Items of which each state likes a few; many equal ones."""
    r = np.random.default_rng(seed)
    v = r.gamma(sparse, 1, (n, k)) + 1e-9
    v[n // 2 : n // 2 + 20] = v[n // 2]
    v /= v.sum(axis=0)
    return Model(np.full(k, 1 / k), np.eye(k), emission_table(spark, v))


def requests(spark, rows, k, seed):
    q = np.random.default_rng(seed).dirichlet(np.full(k, 0.3), rows)
    q[0], q[1] = 1 / k, np.eye(k)[0]
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "request_id long, q array<double>").repartition(3)


def listed(df):
    return sorted((r.request_id, r["rank"], r.item_ix, round(r.score, 12)) for r in df.collect())


@pytest.mark.parametrize("n,top_states,block", [(5, None, 16), (12, 2, 4), (300, None, 64)])
def test_pruned_search_equals_scoring_everything(spark, n, top_states, block):
    m = catalogue(spark, 260, 6, 1)
    q = requests(spark, 40, 6, 2)
    found, share = topn.search(q, m, n, top_states, topn.item_blocks(m, block))
    assert listed(found) == listed(scoring.recommend(q, m, n, top_states))
    s = share.first()
    assert s.requests == 40 and s["items"] == 260 and 0 < s.touched <= 1
    if n == 5:
        assert s.touched < 0.5


def test_search_in_small_and_empty_tables(spark):
    m = catalogue(spark, 41, 3, 3)
    q = requests(spark, 5, 3, 4)
    assert listed(topn.recommend(q, m, 3)) == listed(scoring.recommend(q, m, 3))
    assert topn.recommend(q.where("false"), m, 3).count() == 0
    blocks = topn.item_blocks(m, 10)
    assert blocks.n_items == 41 and blocks.items.groupBy("blk").count().agg(F.max("count")).first()[0] <= 10


def test_blocks_visited_by_many_requests_are_split(spark, monkeypatch):
    monkeypatch.setattr(topn, "REQUEST_ROWS", 7)
    m = catalogue(spark, 60, 3, 5)
    q = requests(spark, 50, 3, 6)
    assert listed(topn.recommend(q, m, 4, blocks=topn.item_blocks(m, 8))) == listed(scoring.recommend(q, m, 4))


def test_assignment_is_the_best_of_all_orders():
    r = np.random.default_rng(7)
    for k in (1, 2, 5, 6):
        for _ in range(10):
            cost = r.normal(size=(k, k)) if _ % 2 else r.integers(0, 4, (k, k)).astype(float)
            got = states.assignment(cost)
            assert sorted(got) == list(range(k))
            assert cost[np.arange(k), got].sum() == pytest.approx(min(cost[np.arange(k), list(p)].sum() for p in permutations(range(k))))


def test_one_to_one_matching_uses_no_state_twice(spark):
    truth = np.array([[0.5, 0.5, 0.0], [0.4, 0.4, 0.2], [0.1, 0.1, 0.8]]) + 0.01
    est = np.array([[0.6, 0.1, 0.0], [0.3, 0.1, 0.2], [0.1, 0.8, 0.8]]) + 0.01
    a, b = (emission_table(spark, x / x.sum(axis=0)) for x in (truth, est))
    assert any(r.duplicate for r in states.match_states(a, b).collect())
    found = states.match_states(a, b, one_to_one=True).orderBy("true_state").collect()
    assert sorted(r.fit_state for r in found) == [0, 1, 2] and not any(r.duplicate for r in found)


def test_draws_are_functions_of_their_counters():
    a = draws.uniform(3, np.arange(1000)[:, None], np.arange(50)[None, :])
    assert a.min() > 0 and a.max() < 1 and len(np.unique(a)) > 49_900
    assert draws.uniform(3, 7, 9) == a[7, 9] and abs(a.mean() - 0.5) < 0.01
    assert abs(np.corrcoef(a[:, 0], a[:, 1])[0, 1]) < 0.1 and abs(np.corrcoef(a[:-1, 0], a[1:, 0])[0, 1]) < 0.1
    for shape in (0.3, 1.0, 2.0, 2.5, 16.0, 40.0):
        g = draws.gamma(np.full(40_000, shape), 5, np.arange(40_000))
        assert g.mean() == pytest.approx(shape, rel=0.05) and g.var() == pytest.approx(shape, rel=0.1) and (g > 0).all()
        skew = ((g - g.mean()) ** 3).mean() / g.std() ** 3
        assert skew == pytest.approx(2 / np.sqrt(shape), abs=0.35)
    assert draws.gamma(np.zeros(3), 1, np.arange(3)).tolist() == [0, 0, 0]


def test_random_models_do_not_depend_on_the_partitioning(spark):
    items = spark.range(30).select(F.col("id").cast("int").alias("item_ix"))
    models = [em.random_model(items.repartition(n), 4, em.Prior(2, 2.5, 0.7), 3) for n in (1, 5)]
    assert np.array_equal(models[0].trans, models[1].trans) and np.allclose(models[0].dense, models[1].dense)
    assert np.allclose(models[0].dense.sum(axis=0), 1) and np.allclose(models[0].trans.sum(axis=1), 1)


def test_least_squares(spark):
    r = np.random.default_rng(8)
    x = np.c_[np.ones(200), r.normal(size=(200, 3)) * [1, 100, 0.01]]
    y = x @ [1.0, -2.0, 0.03, 40.0] + r.normal(size=200)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "row array<double>, y double").repartition(4)
    assert evaluate.least_squares(df) == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0])
    with pytest.raises(ValueError, match="no rows"):
        evaluate.least_squares(df.where("false"))
