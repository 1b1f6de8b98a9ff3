"""SQL fragments of the reference results: named steps that queries chain with `sql`."""

from __future__ import annotations

_STEPS: dict[str, tuple[str, tuple[str, ...]]] = {}


def step(name: str, body: str, *needs: str) -> None:
    _STEPS[name] = (body, needs)


def sql(body: str, *needs: str) -> str:
    """``WITH`` all steps the body needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in _STEPS[name][1]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    steps = ",\n".join(
        f"{n}({_COLUMNS[n]}) AS ({_STEPS[n][0]})" if n in _COLUMNS else f"{n} AS MATERIALIZED ({_STEPS[n][0]})"
        for n in order
    )
    return f"WITH RECURSIVE {steps}\n{body}" if steps else body


_COLUMNS: dict[str, str] = {}

step(
    "clicks",
    """SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS item_id,
    epoch_us(ts) AS us, event_type AS ad_type FROM events
    WHERE event_type IN ('view', 'click', 'purchase')""",
)


def click_steps(suffix: str, item: int, user: int, splits: int, chunk: int = 0) -> None:
    """Steps from clicks to sessions for one set of thresholds."""
    s = suffix
    step(
        f"item_ok{s}",
        f"""SELECT * FROM clicks WHERE item_id IN
        (SELECT item_id FROM clicks GROUP BY item_id HAVING count(*) > {item})""",
        "clicks",
    )
    step(
        f"user_ok{s}",
        f"""SELECT * FROM item_ok{s} WHERE user_id IN
        (SELECT user_id FROM item_ok{s} GROUP BY user_id HAVING count(*) > {user})""",
        f"item_ok{s}",
    )
    step(
        f"flagged{s}",
        f"""SELECT *, CASE WHEN delta_us > 21600000000 THEN 1 ELSE 0 END AS split FROM (
        SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS delta_us FROM user_ok{s})""",
        f"user_ok{s}",
    )
    step(
        f"numbered{s}",
        f"""SELECT *, CAST(sum(split) OVER (PARTITION BY user_id ORDER BY us) AS BIGINT) AS session_ix
        FROM flagged{s} WHERE user_id IN
        (SELECT user_id FROM flagged{s} GROUP BY user_id HAVING sum(split) > {splits})""",
        f"flagged{s}",
    )
    cut = f"CAST(session_ix // {chunk} AS INTEGER)" if chunk else "CAST(0 AS INTEGER)"
    step(f"cut{s}", f"SELECT *, {cut} AS chunk FROM numbered{s}", f"numbered{s}")
    keep = (
        f"WHERE (user_id, chunk) IN (SELECT (user_id, chunk) FROM cut{s} GROUP BY user_id, chunk "
        f"HAVING count(*) > {user})"
    )
    step(
        f"sess{s}",
        f"""SELECT user_id, chunk, session_ix, item_id, count(*) AS n FROM cut{s}
        {keep if chunk else ''} GROUP BY user_id, chunk, session_ix, item_id""",
        f"cut{s}",
    )
    step(
        f"dim{s}",
        f"""SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS item_ix
        FROM (SELECT DISTINCT item_id FROM sess{s})""",
        f"sess{s}",
    )
    step(
        f"seq{s}",
        f"""SELECT user_id, chunk, session_ix, item_ix, CAST(1 AS BIGINT) AS n, row_number() OVER
        (PARTITION BY user_id, chunk ORDER BY session_ix, item_ix) - 1 AS t
        FROM sess{s} JOIN dim{s} USING (item_id)""",
        f"sess{s}",
        f"dim{s}",
    )


click_steps("", 1, 10, 3)
click_steps("_strict", 55, 25, 20, 20)

step(
    "lab",
    """SELECT user_id, us AS ord, item_id,
    CASE ad_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS state FROM clicks""",
    "clicks",
)

# order lines
step(
    "order_lines",
    """SELECT user_id, session_ix, l_partkey AS item_id, l_linenumber AS line, ad_type FROM (
    SELECT o_custkey AS user_id, o_orderkey, o_orderstatus AS ad_type, row_number() OVER
    (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS session_ix FROM orders)
    JOIN lineitem ON l_orderkey = o_orderkey""",
)
step(
    "order_sess",
    """SELECT user_id, CAST(0 AS INTEGER) AS chunk, session_ix, item_id, count(*) AS n
    FROM order_lines GROUP BY user_id, session_ix, item_id""",
    "order_lines",
)
step(
    "order_dim",
    """SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS item_ix
    FROM (SELECT DISTINCT item_id FROM order_sess)""",
    "order_sess",
)
step(
    "order_seq",
    """SELECT user_id, chunk, session_ix, item_ix, n, dense_rank() OVER
    (PARTITION BY user_id, chunk ORDER BY session_ix) - 1 AS t FROM order_sess JOIN order_dim USING (item_id)""",
    "order_sess",
    "order_dim",
)
step(
    "order_items",
    """SELECT user_id, chunk, session_ix, item_ix, CAST(1 AS BIGINT) AS n, row_number() OVER
    (PARTITION BY user_id, chunk ORDER BY session_ix, item_ix) - 1 AS t
    FROM order_sess JOIN order_dim USING (item_id)""",
    "order_sess",
    "order_dim",
)
step(
    "order_lab",
    """SELECT user_id, session_ix * 1000 + line AS ord, item_id,
    CASE ad_type WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS state FROM order_lines""",
    "order_lines",
)


def model_steps(name: str, lab: str, dim: str, prior: float = 1.0) -> None:
    """Counting estimate of a three-state model: ``{name}_emis(item_ix, v0..v2)``, ``{name}`` with
    ``p0..p2`` and ``a00..a22`` in one row."""
    raw = ", ".join(f"{prior} + count(*) FILTER (state = {k}) AS c{k}" for k in range(3))
    step(
        f"{name}_emis",
        f"""SELECT item_ix, c0 / sum(c0) OVER () AS v0, c1 / sum(c1) OVER () AS v1,
        c2 / sum(c2) OVER () AS v2 FROM (SELECT item_ix, {raw} FROM {dim} LEFT JOIN {lab} USING (item_id)
        GROUP BY item_ix)""",
        lab,
        dim,
    )
    step(
        f"{name}_pair",
        f"SELECT lag(state) OVER (PARTITION BY user_id ORDER BY ord) AS i, state AS j FROM {lab}",
        lab,
    )
    first = ", ".join(
        f"({prior} + count(*) FILTER (i IS NULL AND j = {k})) / ({3 * prior} + count(*) FILTER (i IS NULL)) AS p{k}"
        for k in range(3)
    )
    cells = ", ".join(
        f"({prior} + count(*) FILTER (i = {i} AND j = {j})) / ({3 * prior} + count(*) FILTER (i = {i})) AS a{i}{j}"
        for i in range(3)
        for j in range(3)
    )
    step(name, f"SELECT {first}, {cells} FROM {name}_pair", f"{name}_pair")


model_steps("hmm", "lab", "dim")
model_steps("order_hmm", "order_lab", "order_dim")


def evidence_steps(name: str, seq: str, emis: str, sessions: bool) -> None:
    """``{name}(user_id, chunk, t, item_ix, f0..f2)``: likelihood of each position per state."""
    if sessions:
        body = f"""SELECT user_id, chunk, t, CAST(0 AS INTEGER) AS item_ix, exp(sum(n * ln(v0))) AS f0,
        exp(sum(n * ln(v1))) AS f1, exp(sum(n * ln(v2))) AS f2
        FROM {seq} JOIN {emis} USING (item_ix) GROUP BY user_id, chunk, t"""
    else:
        body = f"""SELECT user_id, chunk, t, item_ix, v0 AS f0, v1 AS f1, v2 AS f2
        FROM {seq} JOIN {emis} USING (item_ix)"""
    step(name, body, seq, emis)


def filter_steps(name: str, ev: str, model: str) -> None:
    """``{name}``: filtered q, predicted r, log normaliser c; ``{name}_g``: smoothed g and the
    successor ratios h; ``{name}_end``: last position with the state after it (n0..n2)."""
    share = "w{k} / (w0 + w1 + w2) AS q{k}"
    qs = ", ".join(share.format(k=k) for k in range(3))
    step(
        f"{name}_rec",
        f"""SELECT user_id, chunk, t, item_ix, r0, r1, r2, {qs}, ln(w0 + w1 + w2) AS c FROM (
          SELECT user_id, chunk, t, item_ix, p0 AS r0, p1 AS r1, p2 AS r2,
            p0 * f0 AS w0, p1 * f1 AS w1, p2 * f2 AS w2 FROM {ev}, {model} WHERE t = 0)
        UNION ALL
        SELECT user_id, chunk, t, item_ix, r0, r1, r2, {qs}, ln(w0 + w1 + w2) AS c FROM (
          SELECT *, r0 * f0 AS w0, r1 * f1 AS w1, r2 * f2 AS w2 FROM (
            SELECT e.user_id, e.chunk, e.t, e.item_ix, e.f0, e.f1, e.f2,
              b.q0 * a00 + b.q1 * a10 + b.q2 * a20 AS r0,
              b.q0 * a01 + b.q1 * a11 + b.q2 * a21 AS r1,
              b.q0 * a02 + b.q1 * a12 + b.q2 * a22 AS r2
            FROM {name}_rec b JOIN {ev} e ON e.user_id = b.user_id AND e.chunk = b.chunk AND e.t = b.t + 1,
            {model}))""",
        ev,
        model,
    )
    _COLUMNS[f"{name}_rec"] = "user_id, chunk, t, item_ix, r0, r1, r2, q0, q1, q2, c"
    step(name, f"SELECT * FROM {name}_rec", f"{name}_rec")
    step(
        f"{name}_end",
        f"""SELECT user_id, chunk, t, c, q0, q1, q2, q0 * a00 + q1 * a10 + q2 * a20 AS n0,
        q0 * a01 + q1 * a11 + q2 * a21 AS n1, q0 * a02 + q1 * a12 + q2 * a22 AS n2
        FROM {name}, {model} WHERE (user_id, chunk, t) IN
        (SELECT (user_id, chunk, max(t)) FROM {name} GROUP BY user_id, chunk)""",
        name,
        model,
    )
    gs = ", ".join(f"q{i} * (a{i}0 * h0 + a{i}1 * h1 + a{i}2 * h2)" for i in range(3))
    step(
        f"{name}_back",
        f"""SELECT user_id, chunk, t, q0, q1, q2, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM {name}_end
        UNION ALL
        SELECT user_id, chunk, t, {gs}, h0, h1, h2 FROM (
          SELECT p.user_id, p.chunk, p.t, p.q0, p.q1, p.q2,
            b.g0 / nx.r0 AS h0, b.g1 / nx.r1 AS h1, b.g2 / nx.r2 AS h2
          FROM {name}_back b
          JOIN {name} nx ON nx.user_id = b.user_id AND nx.chunk = b.chunk AND nx.t = b.t
          JOIN {name} p ON p.user_id = b.user_id AND p.chunk = b.chunk AND p.t = b.t - 1), {model}""",
        name,
        f"{name}_end",
        model,
    )
    _COLUMNS[f"{name}_back"] = "user_id, chunk, t, g0, g1, g2, h0, h1, h2"
    step(f"{name}_g", f"SELECT * FROM {name}_back", f"{name}_back")
    xi = " UNION ALL ".join(
        f"""SELECT 'trans' AS kind, {i} AS ix, sum(a{i}0 * q{i} * h0) AS v0, sum(a{i}1 * q{i} * h1) AS v1,
        sum(a{i}2 * q{i} * h2) AS v2 FROM {name}_g JOIN {name} USING (user_id, chunk, t), {model}"""
        for i in range(3)
    )
    step(
        f"{name}_small",
        f"""{xi} UNION ALL
        SELECT 'pi', 0, sum(g0), sum(g1), sum(g2) FROM {name}_g WHERE t = 0 UNION ALL
        SELECT 'lik', 0, sum(c), 0, 0 FROM {name}""",
        name,
        f"{name}_g",
        model,
    )


def emission_stats(name: str, out: str, seq: str) -> None:
    step(
        out,
        f"""SELECT item_ix, sum(n * g0) AS v0, sum(n * g1) AS v1, sum(n * g2) AS v2
        FROM {seq} JOIN {name}_g USING (user_id, chunk, t) GROUP BY item_ix""",
        seq,
        f"{name}_g",
    )


evidence_steps("ev", "seq", "hmm_emis", False)
filter_steps("fw", "ev", "hmm")
emission_stats("fw", "fw_emis", "seq")
evidence_steps("order_ev", "order_seq", "order_hmm_emis", True)
filter_steps("ofw", "order_ev", "order_hmm")
emission_stats("ofw", "ofw_emis", "order_seq")
evidence_steps("item_ev", "order_items", "order_hmm_emis", False)
filter_steps("ifw", "item_ev", "order_hmm")


def mstep_steps(name: str, small: str, emis: str, prior: float = 2.0) -> None:
    """``{name}`` (p, a) and ``{name}_emis`` from expected counts, flat prior."""
    add = prior - 1
    step(
        f"{name}_emis",
        f"""SELECT item_ix, {", ".join(f"(v{k} + {add}) / sum(v{k} + {add}) OVER () AS v{k}" for k in range(3))}
        FROM {emis}""",
        emis,
    )
    first = ", ".join(
        f"max((v{k} + {add}) / (v0 + v1 + v2 + 3 * {add})) FILTER (kind = 'pi') AS p{k}" for k in range(3)
    )
    cells = ", ".join(
        f"max((v{j} + {add}) / (v0 + v1 + v2 + 3 * {add})) FILTER (kind = 'trans' AND ix = {i}) AS a{i}{j}"
        for i in range(3)
        for j in range(3)
    )
    step(name, f"SELECT {first}, {cells} FROM {small}", small)


mstep_steps("ms", "fw_small", "fw_emis")


def em_steps(name: str, seq: str, model: str, rounds: int, sessions: bool) -> str:
    """EM unrolled: ``{name}{r}_small`` holds the likelihood of round r; returns the last model's name."""
    for r in range(rounds):
        evidence_steps(f"{name}{r}_ev", seq, f"{model}_emis", sessions)
        filter_steps(f"{name}{r}", f"{name}{r}_ev", model)
        emission_stats(f"{name}{r}", f"{name}{r}_sum", seq)
        mstep_steps(f"{name}{r}_ms", f"{name}{r}_small", f"{name}{r}_sum")
        model = f"{name}{r}_ms"
    return model


def trace_sql(names: list[str], rounds: int) -> tuple[str, ...]:
    """Likelihood per start and round, and the steps it needs."""
    parts = [
        f"""SELECT CAST({i} AS INTEGER) AS restart, CAST({r} AS INTEGER) AS iter, round(v0, 4) AS log_lik
        FROM {name}{r}_small WHERE kind = 'lik'"""
        for i, name in enumerate(names)
        for r in range(rounds)
    ]
    return (" UNION ALL ".join(parts), *[f"{name}{r}_small" for name in names for r in range(rounds)])


#: Priors of the counted models that restarts begin with.
START_PRIORS = (1.0, 2.0, 5.0)
ROUNDS = 4
for _i, _p in enumerate(START_PRIORS[1:], 1):
    model_steps(f"hmm_s{_i}", "lab", "dim", _p)
    model_steps(f"order_hmm_s{_i}", "order_lab", "order_dim", _p)
EM_LAST = em_steps("em_a", "seq", "hmm", ROUNDS, False)
em_steps("em_b", "seq", "hmm_s1", ROUNDS, False)
em_steps("em_c", "seq", "hmm_s2", ROUNDS, False)
em_steps("oem_a", "order_seq", "order_hmm", 2, True)
em_steps("oem_b", "order_seq", "order_hmm_s1", 2, True)


def r6(*names: str) -> str:
    """Columns rounded to six decimals."""
    return ", ".join(f"round({n}, 6) AS {n.split('.')[-1]}" for n in names)
