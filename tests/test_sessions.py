import random

import pytest
from pyspark.sql import functions as F

from seqloom import skew
from seqloom.operators import binning, evaluate, sessions

MIN = 60 * 1_000_000


def click_frame(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_id int, us long, ad_type string")


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_gap_is_strict(spark):
    at = [0, 10 * MIN, 40 * MIN, 70 * MIN + 1000]
    df = click_frame(spark, [(1, i, us, "a") for i, us in enumerate(at)])
    kept, blocks = sessions.user_blocks(df)
    flagged = sessions.gaps(kept, blocks)
    assert [r[1] for r in rows_of(flagged, "us", "split")] == [0, 0, 0, 1]
    out = sessions.timeline(kept, blocks)
    assert [r[1:] for r in rows_of(out, "us", "session_ix", "splits", "user_n")] == [(0, 1, 4)] * 3 + [(1, 1, 4)]
    for needed, left in ((0, 4), (1, 0)):
        out = sessions.sessionize(df, min_item=0, min_user=0, min_sessions=needed)
        assert out.count() == left


def test_filters_follow_each_other(spark):
    # the rare item goes first, which takes its user below the activity threshold
    df = click_frame(spark, [(1, 7, 1, "a"), (1, 8, 2, "a"), (2, 7, 1, "a"), (2, 7, 2, "a"), (2, 7, 3, "a")])
    out = sessions.sessionize(df, min_item=1, min_user=1, min_sessions=-1)
    assert {r.user_id for r in out.collect()} == {2}
    assert out.first().n == 3


@pytest.mark.parametrize("chunk", [0, 3])
def test_hot_users_give_the_same_sessions(spark, chunk):
    rng = random.Random(1)
    rows = []
    for _ in range(900):  # one user holds most rows, with ties in time and exact repeats
        rows.append((1, rng.randrange(6), rng.randrange(0, 3000) * MIN, "a"))
    rows += [(1, 3, 500 * MIN, "a")] * 200 + [(1, i, 700 * MIN, "a") for i in range(6)] * 5
    for u in range(2, 12):
        rows += [(u, rng.randrange(6), rng.randrange(0, 4000) * MIN, "a") for _ in range(rng.randrange(1, 40))]
    df = click_frame(spark, rows)
    args = dict(min_item=2, min_user=3, min_sessions=1, max_sessions=chunk)
    plain = sessions.sessionize(df, **args)
    cut = sessions.sessionize(df, hot_rows=25, **args)
    blocks = skew.find_blocks(df, ["user_id"], F.col("us"), 25)
    assert blocks.hot
    assert blocks.assign(df, F.col("us")).where("user_id = 1").select(skew.BLK).distinct().count() > 20
    cols = ["user_id", "chunk", "session_ix", "item_id", "n"]
    assert rows_of(plain, *cols) == rows_of(cut, *cols)
    enc = sessions.encode(plain, sessions.dictionary(plain))
    for f in (sessions.item_positions, sessions.session_positions):
        a, b = f(enc), f(enc, hot_rows=9)
        assert rows_of(a, *a.columns) == rows_of(b, *a.columns)


def test_many_block_edges(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("x"))
    blocks = skew.find_blocks(df, ["k"], F.col("x"), 50)
    out = skew.position(blocks.assign(df, F.col("x")), blocks, "x", "pos")
    assert out.where("pos <> x").count() == 0
    assert out.select(skew.BLK).distinct().count() > 64  # more than one stride of edges


def test_dictionary_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(x,) for x in ("b", "a", "d", "a", "c")], "item_id string")
    assert rows_of(sessions.dictionary(df), "item_id", "item_ix") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    many = sessions.dictionary(spark.range(0, 3000, 3).withColumnRenamed("id", "item_id").repartition(7))
    assert many.where("item_ix * 3 <> item_id").count() == 0


def test_reencode_drops_unknown_items_and_empty_sequences(spark):
    sess = spark.createDataFrame(
        [(1, 0, 0, 10, 1), (1, 0, 1, 20, 1), (2, 0, 0, 30, 1)],
        "user_id long, chunk int, session_ix long, item_id int, n long",
    )
    items = spark.createDataFrame([(20, "x"), (10, "y"), (99, "z")], "item_id int, make string")
    dim = sessions.dictionary(sess)
    known, out = sessions.reencode(sess, dim, items)
    assert rows_of(known, "item_id", "item_ix") == [(10, 0), (20, 1)]
    assert rows_of(out, "user_id", "item_ix") == [(1, 0), (1, 1)]
    counts = sessions.unmatched(items, dim).first()
    assert (counts.hits, counts.misses) == (2, 1)


def test_length_buckets_respect_the_limit(spark):
    sizes = spark.range(100).select(F.col("id").alias("user_id"), F.lit(0).alias("chunk"), (F.col("id") % 2).alias("len"))
    for hot in (None, 10):
        out = sessions.length_buckets(sizes, 8, hot).groupBy("len", "bucket").count().collect()
        assert sorted(r["count"] for r in out) == [2, 2] + [8] * 12


def test_numeric_bins_golden(spark):
    values = [1.0, 2.0, 3.0, 6.0, 7.0, 12.0, 13.0, 18.0, float("nan"), 99.0]
    df = spark.createDataFrame(list(enumerate(values)), "id int, x double")
    assert binning.bin_edges(df, "x", 0, 30, 2, 5) == [5, 10, 15]
    out = binning.bin_numeric(df, "x", 0, 30, 2, 5, "level")
    assert [r[1] for r in rows_of(out, "id", "level")] == [0, 0, 0, 1, 1, 2, 2, 3, 4, 4]


def one_by_one(values, lo, min_obs, split):
    """The rule, walked value by value."""
    edges, level = [], 0
    for i, x in enumerate(sorted(values)):
        if x > lo + (level + 1) * split:
            level += 1
            if i > min_obs:
                edges.append(lo + level * split)
    return edges


def test_numeric_bins_match_the_walk(spark):
    rng = random.Random(5)
    for _ in range(6):
        values = [float(rng.randrange(0, 60)) for _ in range(rng.randrange(1, 80))]
        min_obs, split = rng.randrange(0, 9), rng.choice([2.0, 5.0, 7.0])
        df = spark.createDataFrame([(x,) for x in values], "x double")
        assert binning.bin_edges(df, "x", 0.0, 60.0, min_obs, split) == one_by_one(values, 0.0, min_obs, split)


def test_categories_with_nulls(spark):
    rows = [("a",), ("A",), ("b",), ("b",), ("b",), ("rare",), (None,)]
    df = spark.createDataFrame(rows, "c string")
    out = binning.encode_category(df, "c", 2, "level")
    assert sorted((r.c or "", r.level) for r in out.collect()) == [
        ("", 2), ("A", 1), ("a", 1), ("b", 0), ("b", 0), ("b", 0), ("rare", 2)
    ]
    assert binning.encode_category(df.where("c = 'b'"), "c", 1, "level").select("level").distinct().first()[0] == 0


def test_rolling_mean_crosses_blocks(spark):
    import pandas as pd

    rng = random.Random(2)
    values = [rng.random() for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, x double")
    out = evaluate.rolling_mean(df, ["id"], "x", 10, block=17).orderBy("id").toPandas()["rolling"]
    want = pd.Series(values).rolling(10, center=True).mean()
    assert out.isna().tolist() == want.isna().tolist()
    assert out.dropna().tolist() == pytest.approx(want.dropna().tolist())
