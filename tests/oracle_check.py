"""Run registered queries next to their SQL on the same parquet files.

``python tests/oracle_check.py [--sf 0.01] [name prefix ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, f"{v:.6f}") if v != 0 else (1, f"{0.0:.6f}")
    return (1, str(v))


def compare(df, con, sql: str) -> str:
    """Empty text if equal, else what differs."""
    table = con.execute(sql).to_arrow_table()
    spark = df.toArrow()
    names = sorted(spark.column_names)
    if names != sorted(table.column_names):
        return f"columns {names} != {sorted(table.column_names)}"
    kinds = [(n, str(spark.schema.field(n).type), str(table.schema.field(n).type)) for n in names]
    bad = [k for k in kinds if k[1].replace("large_", "") != k[2].replace("large_", "")]
    if bad:
        return f"types {bad}"

    def rows(t):
        cols = [t.column(n).to_pylist() for n in names]
        return sorted(tuple(_cell(v) for v in r) for r in zip(*cols))

    a, b = rows(spark), rows(table)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows; {a[:2]} {b[:2]}"
    for x, y in zip(a, b):
        if x != y:
            return f"{sum(p != q for p, q in zip(a, b))} of {len(a)} rows differ, first {x} != {y}"
    return "" if a else "no rows"


def main() -> None:
    from pyspark.sql import SparkSession

    from seqloom.plans import oracle, queries

    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    sqls = oracle()
    failed = 0
    for name, fn in queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                note = compare(df, con, sqls[name])
            else:
                n = len(df.toArrow())
                note = "" if n else "no rows"
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:3000]}"
        kind = "sql " if name in sqls else "rows"
        failed += bool(note)
        print(f"{'FAIL' if note else 'ok  '} {kind} {time.time() - t:6.2f}s {name} {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
