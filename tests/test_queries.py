import re

import pytest
from oracle_check import compare, connect

from seqloom.operators import em
from seqloom.plans import oracle, queries
from seqloom.plans.latent import BUDGET

SMALL = "/root/testdata/sf0.001"
FAMILIES = {"S": 6, "P": 13, "J": 9, "A": 18, "W": 14, "K": 6, "U": 1, "E": 9, "H": 26, "M": 9, "R": 6, "D": 13, "F": 8, "T": 4}
CHOSEN = """S2_ S3_ P6_ P8_ P11_ J3_ J9_ A5_ A8_ A15_ W5_ W7_ W10_ W13_ K1_ K6_ E3_ E4_ E5_ E8_ H7_ H13_ H14_ H21_
H24_ H25_ M2_ M5_ R2_ R4_ D1_ D7_ D11_""".split()


def test_every_operator_has_a_query():
    ids = {re.match(r"([A-Z]\d+)_", name).group(1) for name in queries()}
    assert ids == {f"{f}{i}" for f, n in FAMILIES.items() for i in range(1, n + 1)}
    assert set(oracle()) <= set(queries())


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", [n for n in queries() if any(n.startswith(c) for c in CHOSEN)])
def test_query_equals_sql(spark, con, name):
    assert compare(queries()[name](spark, SMALL), con, oracle()[name]) in ("", "no rows")


@pytest.mark.parametrize("name", ["H4_update_all", "H5_predict_all", "H6_backward_all"])
def test_one_step_forms_take_all_positions(spark, con, name):
    out = queries()[name](spark, SMALL)
    assert out.agg({"t": "max"}).first()[0] > 1
    assert compare(out, con, oracle()[name]) == ""


@pytest.mark.parametrize("name", ["D3_restarts", "D4_convergence", "H16_parallel_em"])
def test_fits_end_by_the_stop_rule(spark, name):
    traces = {}
    for r in sorted(queries()[f"{name}_to_the_end"](spark, SMALL).collect()):
        traces.setdefault(r.restart, []).append(r.log_lik)
    assert len(traces) == (1 if name == "D4_convergence" else 3)
    assert all(len(t) < BUDGET and em.settled(t, 5.0) for t in traces.values())
