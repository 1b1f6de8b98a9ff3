"""The distributed second-order fit next to numpy on one table."""

import numpy as np
import pytest

from seqloom.operators import em, estep, factor, solver
from seqloom.operators import vectors
from seqloom.operators.vectors import vector_sums, vector_total


def problem(spark, n=40, k=3, dim=2, penalty=0.01, seed=1, some=True):
    r = np.random.default_rng(seed)
    levels = r.integers(0, 4, n)
    par = np.c_[r.normal(size=(n, dim)), np.zeros(n)]
    x = r.poisson(r.gamma(1.0, 3.0, (n, k))) + 0.5
    items = spark.createDataFrame(
        [(i, par[i].tolist(), [int(levels[i])]) for i in range(n)], "item_ix int, par array<double>, levels array<int>"
    ).repartition(3)
    weights = spark.createDataFrame([(i, x[i].tolist()) for i in range(n) if i % 7 or not some], "item_ix int, vec array<double>")
    x[::7] *= not some
    fm = factor.FactorModel(r.normal(size=(k, dim)), [r.normal(size=(k, 4))], items, penalty)
    return fm, weights, par, levels, x


def plain_loss(states, effect, par, levels, x, penalty):
    c = effect - effect.mean(axis=1, keepdims=True)
    m = par[:, :-1] @ states.T + par[:, -1:] + c.T[levels]
    z = np.log(np.exp(m).sum(axis=0))
    s = states * par[:, :-1].std(axis=0, ddof=1)
    return x.sum(axis=0) @ z - (x * m).sum() + penalty * ((s - s.mean(axis=0)) ** 2).sum()


def test_gradient_is_the_slope_of_the_loss(spark):
    fm, weights, par, levels, x = problem(spark)
    items, (d_states, (d_effect,)), loss = solver.gradient(fm, weights)
    args = [fm.states, fm.effects[0], par]
    assert loss == pytest.approx(plain_loss(*args, levels, x, fm.penalty))
    assert loss == pytest.approx(factor.loss(fm, weights) + factor.penalty(fm))
    d_par = np.array([r.g for r in items.orderBy("item_ix").collect()])
    for which, d in enumerate((d_states, d_effect, d_par)):
        for at in ((0, 0), (2, 1), (1, 0)):
            ends = []
            for h in (1e-5, -1e-5):
                moved = [a.copy() for a in args]
                moved[which][at] += h
                ends.append(plain_loss(*moved, levels, x, fm.penalty))
            assert d[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-5)


def test_direction_equals_the_recursion_over_long_vectors():
    r = np.random.default_rng(2)
    changes = list(r.normal(size=(4, 30)))
    a = r.normal(size=(30, 30))
    turns = [a @ a.T @ s + s for s in changes]
    g = r.normal(size=30)
    q, kept = g.copy(), []
    for s, y in reversed(list(zip(changes, turns))):
        w = s @ q / (s @ y)
        kept.append(w)
        q -= w * y
    q *= changes[-1] @ turns[-1] / (turns[-1] @ turns[-1])
    for (s, y), w in zip(zip(changes, turns), reversed(kept)):
        q += (w - y @ q / (s @ y)) * s
    basis = np.stack([*changes, *turns, g])
    assert solver.two_loops(basis @ basis.T) @ basis == pytest.approx(-q)
    assert solver.two_loops(np.array([[4.0]])).tolist() == [-1.0]


def test_fit_ends_by_the_stop_rule_at_the_least_loss(spark):
    fm, weights, par, levels, x = problem(spark, n=24, some=False)
    fit = solver.solve(fm, weights, budget=120, tol=1e-5)
    assert fit.ended in ("settled", "no lower loss") and len(fit.losses) < 100
    assert all(b <= a for a, b in zip(fit.losses, fit.losses[1:]))
    assert fit.losses[-4] - fit.losses[-1] <= 3e-5 * fit.losses[-1]
    # the model holds enough parameters to give each state its own shares of the items, but for the penalty
    shares = (x + 1e-12) / (x + 1e-12).sum(axis=0)
    least = -(x * np.log(shares)).sum()
    assert least < fit.losses[-1] < plain_loss(fm.states, fm.effects[0], par, levels, x, fm.penalty)
    assert factor.loss(fit.model, weights) + factor.penalty(fit.model) == pytest.approx(fit.losses[-1])
    again, _, _ = solver.gradient(fit.model, weights)
    top = max(np.abs(r.g).max() for r in again.collect())
    assert top < 0.1 * np.abs(np.array([r.g for r in solver.gradient(fm, weights)[0].collect()])).max()


def test_more_memory_and_budget_never_end_higher(spark):
    fm, weights, *_ = problem(spark, penalty=0.0, seed=4)
    short = solver.solve(fm, weights, budget=4)
    assert short.ended == "budget" and len(short.losses) == 5
    assert solver.solve(fm, weights, budget=12).losses[:5] == pytest.approx(short.losses)


def test_empty_item_tables_are_refused(spark):
    fm, weights, *_ = problem(spark)
    none = factor.FactorModel(fm.states, fm.effects, fm.items.where("false"))
    with pytest.raises(ValueError, match="empty"):
        solver.solve(none, weights)


def test_vector_sums(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(500, 70))
    rows = [(i % 11, "ab"[i % 2], v[i].tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "ix int, kind string, vec array<double>").repartition(5)
    got = {(x.ix, x.kind): x.vec for x in vector_sums(df, ["ix", "kind"]).collect()}
    assert len(got) == 22
    for (ix, kind), vec in got.items():
        mine = [i for i in range(500) if (i % 11, "ab"[i % 2]) == (ix, kind)]
        assert vec == pytest.approx(v[mine].sum(axis=0))
    assert vector_total(df) == pytest.approx(v.sum(axis=0))
    assert vector_total(df.where("false")) is None and vector_sums(df.where("false"), ["ix"]).count() == 0


@pytest.mark.parametrize("fold, hold", [(1, 1), (7, 40), (1_000_000, 4_000_000)])
def test_vector_sums_in_parts(monkeypatch, fold, hold):
    """Sums that are passed on early, and those of sorted rows, are whole whatever is held at a time."""
    import pyarrow as pa

    monkeypatch.setattr(vectors, "FOLD", fold)
    monkeypatch.setattr(vectors, "HOLD", hold)
    r = np.random.default_rng(2)
    ix, v = r.integers(0, 30, 400), r.random((400, 3))
    kind = [None if i % 7 == 3 else f"k{i % 4}" for i in ix]
    table = pa.table({"ix": ix, "kind": kind, "vec": vectors.lists(v)})
    found, most = {}, 0
    fold_ = vectors._Fold(["ix", "kind"], "vec")
    for b in table.to_batches(max_chunksize=16):
        fold_.add(b)
        if fold_.full:
            rows = fold_.settle()
            most = max(most, fold_.numbers)
            if fold_.numbers > hold:
                fold_.keep(None)
                for x in rows.to_pylist():
                    found[x["ix"], x["kind"]] = found.get((x["ix"], x["kind"]), 0) + np.array(x["vec"])
    for x in fold_.settle().to_pylist() if fold_.parts else []:
        found[x["ix"], x["kind"]] = found.get((x["ix"], x["kind"]), 0) + np.array(x["vec"])
    assert {k: list(x) for k, x in found.items()} == {
        (i, k): pytest.approx(v[(ix == i)].sum(axis=0)) for i, k in zip(ix.tolist(), kind)
    }
    assert most <= hold + fold + 16 * 5


def test_rounds_of_a_small_factor_model_need_few_jobs(spark):
    """Item rows the driver may hold are solved without a job; the fit equals the one on tables."""
    rows = [(u, 0, t, (u * t + t) % 11, 1) for u in range(12) for t in range(3 + u % 4)]
    df = spark.createDataFrame(rows, "user_id long, chunk int, t long, item_ix int, n int")
    items = spark.createDataFrame([(i, [i % 3, i % 2]) for i in range(11)], "item_ix int, levels array<int>")
    seqs, prior = estep.sequences(df), em.Prior(3, 3, 3, diag=8)
    small = em.random_model(items, 2, prior, 5)

    def fit(rounds, held):
        models = [factor.start(items, 2, 3, 5, penalty=0.001)]
        hook = solver.emission_step(models, budget=2)
        if not held:
            del hook.held
        start = factor.initial_model(small.pi, small.trans, models[0])
        spark.sparkContext.setJobGroup(f"fit-{rounds}-{held}", "")
        new = em.fit(seqs, [start], prior, rounds, emission_step=hook)[0]
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{rounds}-{held}"))
        return new, jobs, {r.item_ix: r.par for r in models[0].items.collect()}

    (_, few, _), (new, more, par) = fit(1, True), fit(4, True)
    assert more - few <= 9
    old, _, want = fit(4, False)
    assert np.allclose([x for _, x in new.history], [x for _, x in old.history], rtol=1e-12)
    assert np.allclose(new.dense, old.dense, rtol=1e-7) and np.allclose(new.trans, old.trans, rtol=1e-9)
    assert set(par) == set(want) and all(np.allclose(par[i], want[i], atol=1e-7) for i in par)


def test_held_rows_end_where_the_table_does(spark):
    fm, weights, *_ = problem(spark)
    table = solver.solve(fm, weights, budget=8)
    models = [fm]
    hook = solver.emission_step(models, budget=8)
    assert hook.held.fits(0)
    counts = np.zeros((40, 3))
    for r in weights.collect():
        counts[r.item_ix] = r.vec
    out = hook.held(0, counts)
    want = {r.item_ix: r.vec for r in factor.emission(table.model).collect()}
    assert all(np.allclose(out[i], want[i], rtol=1e-6) for i in want)
    assert factor.loss(models[0], weights) + factor.penalty(models[0]) == pytest.approx(table.losses[-1])
