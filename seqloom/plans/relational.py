"""Queries: scans, filters, joins, aggregates, windows, sorting, encoding, scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import skew, sources
from ..functions import scalars as fn
from ..operators import binning, em, evaluate, model, sessions
from ..operators.vectors import vector_sums
from ..operators.sessions import SEQ
from ..runtime import scratch_path
from .registry import GAP, TYPES, query
from .sql import r6, sql, step

DAY = 86_400_000_000
CHUNKED = dict(min_item=55, min_user=25, min_sessions=20, max_sessions=20)
SWITCH = 1_704_844_800  # 2024-01-10 as epoch seconds
LENGTHS = [1, 3, 5, 8, 10, 15, 20, 25, 30, 50, 100, 200]
COLS = "user_id, item_id, us, ad_type"


def text(col: Column) -> Column:
    return F.concat_ws(",", col.cast("array<string>"))


# ---- scans, sources, sinks ----------------------------------------------------------------------


@query("S1_scan_clicks", sql(f"SELECT {COLS} FROM clicks", "clicks"))
def _(v):
    return v.clicks


step(
    "published",
    """SELECT p_partkey AS item_id, p_brand AS make, p_type AS model, p_size AS size, p_retailprice AS price,
    published FROM part JOIN (SELECT l_partkey, min(l_shipdate) AS published FROM lineitem GROUP BY l_partkey)
    ON l_partkey = p_partkey""",
)
OPEN_TYPES = ["ECONOMY", "SMALL", "PROMO"]


def published(v) -> DataFrame:
    """Catalogue with a publishing date: the first shipment of the part."""
    first = v.table("lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(
        F.min("l_shipdate").alias("published")
    )
    return v.part.join(first, "item_id")


@query(
    "S2_scan_catalogue",
    sql(
        """SELECT item_id, make, model, size, price FROM published
        WHERE published >= TIMESTAMP '1995-02-01' AND model IN ('ECONOMY', 'SMALL', 'PROMO')""",
        "published",
    ),
)
def _(v):
    cols = ["item_id", "make", "model", "size", "price"]
    return sources.catalogue(v.spark, published(v), cols, "1995-02-01 00:00:00", OPEN_TYPES, type_col="model")


step(
    "dashboard",
    """SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS ts, 'm' || (user_id % 2) AS model,
    CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS in_screen,
    CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS clicks FROM events GROUP BY ALL""",
)


def dashboard_file(v) -> str:
    """The dashboard log as CSV with a header and a sub-header row, as its source writes it."""
    day = F.date_format(F.date_trunc("day", F.col("ts").cast("timestamp")), "yyyy-MM-dd")
    shown = F.count(F.when(F.col("event_type") == "view", 1)).cast("string")
    clicked = F.count(F.when(F.col("event_type") == "click", 1)).cast("string")
    log = v.events.groupBy(
        day.alias("day"), F.concat(F.lit("m"), (F.col("user_id") % 2).cast("string")).alias("model")
    ).agg(shown.alias("in_screen"), clicked.alias("clicks"))
    sub = v.spark.createDataFrame(
        [("level_0", "level_3", "sum", "sum")], "day string, model string, in_screen string, clicks string"
    )
    path = scratch_path(v.spark, "dashboard")
    sub.unionByName(log).write.option("header", True).csv(path)
    return path


def dashboard(v) -> DataFrame:
    return sources.dashboard_csv(v.spark, dashboard_file(v))


@query("S3_dashboard_csv", sql("SELECT ts, model, in_screen, clicks FROM dashboard", "dashboard"))
def _(v):
    return dashboard(v)




def test_user() -> Column:
    return F.col("user_id") % 5 == 0


TEST = "CASE WHEN user_id % 5 = 0 THEN 'test' ELSE 'train' END"
step("split_seq", f"SELECT *, {TEST} AS split FROM seq", "seq")
step(
    "split3_seq",
    "SELECT *, CASE user_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM seq",
    "seq",
)


@query(
    "S4_split_tables",
    sql(
        """SELECT split, count(*) AS rows, count(DISTINCT user_id) AS users, CAST(sum(item_ix) AS BIGINT) AS ix
        FROM split3_seq GROUP BY split""",
        "split3_seq",
    ),
)
def _(v):
    path = scratch_path(v.spark, "split")
    sources.save_split(evaluate.by_split(v.seq, test_user(), F.col("user_id") % 5 == 1), path)
    rows = [
        sources.load_split(v.spark, path, s).groupBy("split").agg(
            F.count("*").alias("rows"),
            F.count_distinct("user_id").alias("users"),
            F.sum("item_ix").alias("ix"),
        )
        for s in ("train", "validation", "test")
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


step(
    "hmm_long",
    """SELECT 'emis' AS part, item_ix AS a, 0 AS b, v0 AS p FROM hmm_emis
    UNION ALL SELECT 'emis', item_ix, 1, v1 FROM hmm_emis UNION ALL SELECT 'emis', item_ix, 2, v2 FROM hmm_emis
    UNION ALL SELECT 'pi', 0, 0, p0 FROM hmm UNION ALL SELECT 'pi', 1, 0, p1 FROM hmm
    UNION ALL SELECT 'pi', 2, 0, p2 FROM hmm """
    + " ".join(f"UNION ALL SELECT 'trans', {i}, {j}, a{i}{j} FROM hmm" for i in range(3) for j in range(3)),
    "hmm",
    "hmm_emis",
)


def long_model(m, digits: int = 6) -> DataFrame:
    """All parameters of a model as ``(part, a, b, p)``."""
    spark = m.emis.sparkSession
    pi = model.vector_table(spark, m.pi).select(F.lit("pi").alias("part"), F.col("state").alias("a"), F.lit(0).alias("b"), "p")
    trans = model.matrix_table(spark, m.trans).select(F.lit("trans").alias("part"), F.col("i").alias("a"), F.col("j").alias("b"), "p")
    emis = model.emission_long(m.emis).select(
        F.lit("emis").alias("part"), F.col("item_ix").alias("a"), F.col("state").alias("b"), F.col("v").alias("p")
    )
    return pi.unionByName(trans).unionByName(emis).withColumn("p", F.round("p", digits))


@query(
    "S5_model_store",
    sql(
        "SELECT part, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(p, 6) AS p FROM hmm_long "
        "UNION ALL SELECT 'prior', CAST(a AS INTEGER), CAST(0 AS INTEGER), CAST(p AS DOUBLE) "
        "FROM (VALUES (0, 3.0), (1, 2.0), (2, 1.5), (3, 8.0)) AS t(a, p)",
        "hmm_long",
    ),
)
def _(v):
    path = scratch_path(v.spark, "model")
    em.save(v.model, em.Prior(3.0, 2.0, 1.5, diag=8.0), path)
    again, prior = em.load(v.spark, path)
    rows = [("prior", i, 0, p) for i, p in enumerate((prior.pi, prior.trans, prior.emis, prior.diag))]
    stored = v.spark.createDataFrame(rows, "part string, a int, b int, p double")
    return long_model(again).unionByName(stored)


@query(
    "S6_store_result",
    sql("SELECT item_ix, CAST(sum(n) AS BIGINT) AS clicks FROM seq GROUP BY item_ix", "seq"),
)
def _(v):
    return sources.save_result(evaluate.popularity(v.seq), scratch_path(v.spark, "result"))


# ---- filters --------------------------------------------------------------------------------------


@query(
    "P1_event_kind",
    """SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS item_id, epoch_us(ts) AS us,
    event_type AS ad_type FROM events WHERE event_type = 'view'""",
)
def _(v):
    return sources.clicks(v.events, sub_category="view")


@query(
    "P2_whitelist",
    """SELECT ad_type, count(*) AS rows FROM (SELECT 'all' AS ad_type FROM events
    UNION ALL SELECT event_type FROM events WHERE event_type IN ('view', 'click', 'purchase')) GROUP BY ad_type""",
)
def _(v):
    everything = sources.clicks(v.events, None).select(F.lit("all").alias("ad_type"))
    chosen = sources.clicks(v.events, TYPES).select("ad_type")
    return everything.unionByName(chosen).groupBy("ad_type").agg(F.count("*").alias("rows"))


@query("P3_min_support", sql(f"SELECT {COLS} FROM item_ok_strict", "item_ok_strict"))
def _(v):
    return sessions.frequent_items(v.clicks, 55)


@query("P4_min_activity", sql(f"SELECT {COLS} FROM user_ok_strict", "user_ok_strict"))
def _(v):
    kept, blocks = sessions.user_blocks(sessions.frequent_items(v.clicks, 55))
    return sessions.active_users(kept, 25, blocks).select("user_id", "item_id", "us", "ad_type")


def strict_numbered(v):
    kept, blocks = sessions.user_blocks(sessions.frequent_items(v.clicks, 55))
    rows = sessions.timeline(kept, blocks, GAP)
    return rows.where((F.col("user_n") > 25) & (F.col("splits") > 20))


@query(
    "P5_min_sessions",
    sql("SELECT user_id, item_id, us, session_ix FROM numbered_strict", "numbered_strict"),
)
def _(v):
    return strict_numbered(v).select("user_id", "item_id", "us", "session_ix")


@query(
    "P6_min_chunk_activity",
    sql(
        """SELECT user_id, chunk, us FROM cut_strict WHERE (user_id, chunk) IN
        (SELECT (user_id, chunk) FROM cut_strict GROUP BY user_id, chunk HAVING count(*) > 8)""",
        "cut_strict",
    ),
)
def _(v):
    cut = sessions.chunk_sessions(strict_numbered(v), 20)
    return sessions.active_chunks(cut, 8).select("user_id", "chunk", "us")


@query(
    "P7_out_of_range",
    """SELECT p_partkey AS item_id, p_size < 10 OR p_size > 40 AS size_out,
    p_retailprice < 910 OR p_retailprice > 990 AS price_out FROM part""",
)
def _(v):
    return v.part.select(
        "item_id",
        binning.outside("size", 10, 40).alias("size_out"),
        binning.outside("price", 910, 990).alias("price_out"),
    )


step(
    "synced_dim",
    """SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS item_ix FROM (
    SELECT DISTINCT item_id FROM published WHERE published >= TIMESTAMP '1995-02-01'
    AND item_id IN (SELECT item_id FROM order_sess))""",
    "published",
    "order_sess",
)


def synced(v):
    """Order sessions reconciled with the parts published since a date."""
    items = published(v).where(F.col("published") >= F.lit("1995-02-01").cast("timestamp"))
    return sessions.reencode(v.order_sess, v.order_dim, items)


@query(
    "P8_drop_empty",
    sql(
        """SELECT user_id, chunk, count(*) AS len FROM order_sess JOIN synced_dim USING (item_id)
        GROUP BY user_id, chunk""",
        "order_sess",
        "synced_dim",
    ),
)
def _(v):
    return synced(v)[1].groupBy(*SEQ).agg(F.count("*").alias("len"))


step(
    "known_dim",
    """SELECT item_id, item_ix FROM dim WHERE item_id IN (SELECT item_id FROM sess GROUP BY item_id
    HAVING sum(n) > (SELECT avg(c) FROM (SELECT sum(n) AS c FROM sess GROUP BY item_id)))""",
    "dim",
    "sess",
)
step(
    "request",
    """SELECT user_id AS request_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS item_id FROM events""",
)


def known_dim(v) -> DataFrame:
    """Dictionary entries of items clicked more often than the average item."""
    counts = v.sess.groupBy("item_id").agg(F.sum("n").alias("c"))
    mean = counts.agg(F.avg("c")).first()[0]
    often = counts.where(F.col("c") > F.lit(mean))
    return v.dim.join(often.select("item_id"), "item_id", "left_semi")


def requests(v) -> DataFrame:
    """One request per user: all items of the event log in time order."""
    rows = v.events.select(
        F.col("user_id").alias("request_id"),
        F.get_json_object("props", "$.k").cast("int").alias("item_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "event_id",
    )
    blocks = skew.find_blocks(rows, ["request_id"], F.col("us"))
    rows = skew.position(blocks.assign(rows, F.col("us")), blocks, ["us", "event_id"], "pos")
    return rows.select("request_id", "pos", "item_id")


@query(
    "P9_drop_unknown",
    sql(
        "SELECT request_id, count(*) AS known FROM request JOIN known_dim USING (item_id) GROUP BY request_id",
        "request",
        "known_dim",
    ),
)
def _(v):
    from ..operators.scoring import known_history

    rows = known_history(requests(v), known_dim(v))
    return rows.groupBy(F.col("user_id").alias("request_id")).agg(F.count("*").alias("known"))


@query(
    "P10_long_sequences",
    sql(
        """SELECT user_id, chunk, len FROM (SELECT user_id, chunk, max(t) + 1 AS len FROM order_items
        GROUP BY user_id, chunk) WHERE len > 40 AND len IN (SELECT DISTINCT len FROM (
        SELECT max(t) + 1 AS len FROM order_items GROUP BY user_id, chunk) WHERE len > 40 ORDER BY len LIMIT 30)""",
        "order_items",
    ),
)
def _(v):
    return evaluate.long_sequences(v.order_items, 40, 30)


step(
    "session_size",
    "SELECT user_id, session_ix, CAST(sum(n) - 1 AS BIGINT) AS more FROM sess GROUP BY user_id, session_ix",
    "sess",
)


def session_size(v) -> DataFrame:
    return v.sess.groupBy("user_id", "session_ix").agg((F.sum("n") - 1).alias("more"))


@query(
    "P11_cut_at_zero",
    sql(
        """SELECT user_id, session_ix, more FROM (SELECT *,
        min(session_ix) OVER (PARTITION BY user_id) AS a,
        min(CASE WHEN more = 0 THEN session_ix END) OVER (PARTITION BY user_id) AS z FROM session_size)
        WHERE session_ix > a AND (z IS NULL OR session_ix < z)""",
        "session_size",
    ),
)
def _(v):
    return evaluate.cut_at_zero(session_size(v), ["user_id"], "session_ix", "more")


@query(
    "P12_dashboard_filter",
    sql(
        f"SELECT ts, model, in_screen, clicks FROM dashboard WHERE ts > {SWITCH} AND model = 'm1'", "dashboard"
    ),
)
def _(v):
    return dashboard(v).where((F.col("ts") > SWITCH) & (F.col("model") == "m1"))


@query(
    "P13_diagonal",
    sql(
        """SELECT i = j AS diagonal, count(*) AS cells, CAST(sum(n) AS BIGINT) AS n FROM (SELECT i, j, count(*) AS n FROM (
        SELECT lag(state) OVER (PARTITION BY user_id ORDER BY ord) AS i, state AS j FROM lab)
        WHERE i IS NOT NULL GROUP BY i, j) GROUP BY diagonal""",
        "lab",
    ),
)
def _(v):
    blocks = skew.find_blocks(v.labelled, ["user_id"], F.col("ord"))
    steps = skew.previous(blocks.assign(v.labelled, F.col("ord")), blocks, "ord", ["state"], "prev_")
    pairs = steps.where(F.col("prev_state").isNotNull()).groupBy("prev_state", "state").count()
    return pairs.groupBy((F.col("prev_state") == F.col("state")).alias("diagonal")).agg(
        F.count("*").alias("cells"), F.sum("count").alias("n")
    )


# ---- joins ------------------------------------------------------------------------------------------


@query("J1_clicks_dictionary", sql("SELECT user_id, us, item_ix FROM clicks JOIN dim USING (item_id)", "clicks", "dim"))
def _(v):
    return sessions.encode(v.clicks, v.dim).select("user_id", "us", "item_ix")


@query(
    "J2_pseudo_users",
    sql(
        "SELECT concat_ws('-', user_id, chunk) AS pseudo_user, session_ix, item_id, n FROM sess_strict",
        "sess_strict",
    ),
)
def _(v):
    rows = v.sessionize(**CHUNKED)
    return rows.select(
        fn.pseudo_user(F.col("user_id"), F.col("chunk")).alias("pseudo_user"), "session_ix", "item_id", "n"
    )


step("often_dim", "SELECT item_id FROM order_lines GROUP BY item_id HAVING count(*) > 30", "order_lines")


@query(
    "J3_catalogue_dictionary",
    sql(
        """SELECT count(o.item_id) AS hits, count(*) - count(o.item_id) AS misses
        FROM part LEFT JOIN often_dim o ON o.item_id = p_partkey""",
        "often_dim",
    ),
)
def _(v):
    often = sessions.frequent_items(v.order_lines, 30)
    return sessions.unmatched(v.part, sessions.dictionary(often))


@query(
    "J4_reindex",
    sql("SELECT user_id, session_ix, item_ix, n FROM order_sess JOIN synced_dim USING (item_id)", "order_sess", "synced_dim"),
)
def _(v):
    return synced(v)[1].select("user_id", "session_ix", "item_ix", "n")


@query(
    "J5_request_ids",
    sql(
        """SELECT request_id, pos, coalesce(item_ix, -1) AS item_ix
        FROM request LEFT JOIN known_dim USING (item_id)""",
        "request",
        "known_dim",
    ),
)
def _(v):
    return requests(v).join(known_dim(v), "item_id", "left").select(
        "request_id", "pos", F.coalesce("item_ix", F.lit(-1)).alias("item_ix")
    )


@query(
    "J6_item_labels",
    sql(
        """SELECT user_id, t, p_brand || ': ' || p_type AS item_label FROM order_items
        JOIN order_dim USING (item_ix) JOIN part ON p_partkey = item_id""",
        "order_items",
        "order_dim",
    ),
)
def _(v):
    named = v.part.join(v.order_dim, "item_id").select(
        "item_ix", fn.label(F.col("make"), F.col("model")).alias("item_label")
    )
    return v.order_items.join(named, "item_ix").select("user_id", "t", "item_label")


def spread(col: str, prefix: str, k: int = 3, digits: int = 6) -> list:
    """Vector entries as rounded columns."""
    return [F.round(F.col(col)[i], digits).alias(f"{prefix}{i}") for i in range(k)]


@query(
    "J7_emission_gather",
    sql(f"SELECT user_id, t, {r6('v0', 'v1', 'v2')} FROM seq JOIN hmm_emis USING (item_ix)", "seq", "hmm_emis"),
)
def _(v):
    return model.gather(v.seq, v.model.emis).select("user_id", "t", *spread("vec", "v"))


step(
    "brand_effect",
    "SELECT p_brand AS make, "
    + ", ".join(
        f"ln((1.0 + count(*) FILTER (ad_type = '{s}')) / (3 + count(*))) AS e{k}" for k, s in enumerate("FOP")
    )
    + " FROM order_lines JOIN part ON p_partkey = item_id GROUP BY p_brand",
    "order_lines",
)


def brand_effects(v) -> DataFrame:
    """Log share of each order status per brand."""
    rows = v.order_lines.join(v.part.select("item_id", "make"), "item_id").groupBy("make")
    counts = rows.agg(
        *[F.count(F.when(F.col("ad_type") == s, 1)).alias(f"c{k}") for k, s in enumerate("FOP")],
        F.count("*").alias("all"),
    )
    return counts.select(
        "make", *[F.ln((F.col(f"c{k}") + 1.0) / (F.col("all") + 3)).alias(f"e{k}") for k in range(3)]
    )


@query(
    "J8_effect_gather",
    sql(f"SELECT p_partkey AS item_id, {r6('e0', 'e1', 'e2')} FROM part JOIN brand_effect ON make = p_brand", "brand_effect"),
)
def _(v):
    rows = v.part.join(brand_effects(v), "make")
    return rows.select("item_id", *[F.round(f"e{k}", 6).alias(f"e{k}") for k in range(3)])


for _s, _c in (("train", "user_id % 5 <> 0"), ("test", "user_id % 5 = 0")):
    step(
        f"pairs_{_s}",
        f"""SELECT i, j, n / sum(n) OVER (PARTITION BY i) AS p FROM (SELECT i, j, count(*) AS n FROM (
        SELECT lag(state) OVER (PARTITION BY user_id ORDER BY ord) AS i, state AS j FROM lab WHERE {_c})
        WHERE i IS NOT NULL GROUP BY i, j)""",
        "lab",
    )


@query(
    "J9_parameters_side_by_side",
    sql(
        f"""SELECT i, j, round(a.p, 6) AS fitted, round(b.p, 6) AS observed
        FROM pairs_train a JOIN pairs_test b USING (i, j)""",
        "pairs_train",
        "pairs_test",
    ),
)
def _(v):
    models = [
        model.labelled_model(v.labelled.where(c), v.dim, 3, prior=0.0) for c in (~test_user(), test_user())
    ]
    pairs = evaluate.compare_transitions(v.spark, models[0].trans, models[1].trans)
    return pairs.select("i", "j", F.round("fitted", 6).alias("fitted"), F.round("observed", 6).alias("observed"))


# ---- aggregates ---------------------------------------------------------------------------------------


@query("A1_distinct_clicks", sql("SELECT DISTINCT user_id, session_ix, item_id FROM numbered", "numbered"))
def _(v):
    return v.sessionize().select("user_id", "session_ix", "item_id")


@query("A2_distinct_items", sql("SELECT DISTINCT item_id FROM clicks", "clicks"))
def _(v):
    return v.clicks.select("item_id").distinct()


@query(
    "A3_repeat_counts",
    sql("SELECT user_id, session_ix, item_id, count(*) AS n FROM numbered GROUP BY ALL", "numbered"),
)
def _(v):
    return v.sessionize().select("user_id", "session_ix", "item_id", "n")


step(
    "packed",
    """SELECT user_id, chunk, session_ix, list(item_ix ORDER BY item_ix) AS items,
    list(n ORDER BY item_ix) AS counts FROM order_sess JOIN order_dim USING (item_id)
    GROUP BY user_id, chunk, session_ix""",
    "order_sess",
    "order_dim",
)


def packed(v) -> DataFrame:
    return sessions.pack_sessions(sessions.encode(v.order_sess, v.order_dim))


@query(
    "A4_pack_sessions",
    sql(
        """SELECT user_id, session_ix, array_to_string(items, ',') AS items,
        array_to_string(counts, ',') AS counts FROM packed""",
        "packed",
    ),
)
def _(v):
    return packed(v).select("user_id", "session_ix", text(F.col("items")).alias("items"), text(F.col("counts")).alias("counts"))


@query(
    "A5_pack_user_sessions",
    sql(
        """SELECT user_id, CAST(session_ix // 16 AS INTEGER) AS seg, CAST(count(*) AS INTEGER) AS sessions,
        string_agg(array_to_string(items, ','), '|' ORDER BY session_ix) AS items FROM packed GROUP BY user_id, seg""",
        "packed",
    ),
)
def _(v):
    rows = sessions.pack_user_sessions(packed(v), 16)
    joined = F.transform("sessions", lambda s: text(s["items"]))
    return rows.select("user_id", "seg", F.size("sessions").alias("sessions"), F.concat_ws("|", joined).alias("items"))


@query(
    "A6_pack_items",
    sql(
        """SELECT user_id, CAST(t // 64 AS INTEGER) AS seg, CAST(count(*) AS INTEGER) AS len,
        string_agg(CAST(item_ix AS VARCHAR), ',' ORDER BY t) AS items FROM order_items GROUP BY user_id, seg""",
        "order_items",
    ),
)
def _(v):
    return sessions.pack_items(v.order_items, 64).select("user_id", "seg", "len", text(F.col("items")).alias("items"))


@query(
    "A7_max_array",
    sql("SELECT user_id, array_to_string(max(items), ',') AS items FROM packed GROUP BY user_id", "packed"),
)
def _(v):
    rows = packed(v).groupBy("user_id").agg(F.max("items").alias("items"))
    return rows.select("user_id", text(F.col("items")).alias("items"))


@query(
    "A8_popularity",
    sql(
        """SELECT split, d.item_ix, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS clicks
        FROM (SELECT 'all' AS split UNION ALL SELECT 'train' UNION ALL SELECT 'test') CROSS JOIN dim d
        LEFT JOIN (SELECT *, 'all' AS part FROM seq UNION ALL SELECT * FROM split_seq) s
        ON s.item_ix = d.item_ix AND s.part = split GROUP BY split, d.item_ix""",
        "dim",
        "split_seq",
    ),
)
def _(v):
    rows = evaluate.by_split(v.seq, test_user())
    parts = {"all": rows, "train": rows.where("split = 'train'"), "test": rows.where("split = 'test'")}
    out = [evaluate.popularity(r, v.dim).withColumn("split", F.lit(s)) for s, r in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


step("pop", "SELECT item_ix, sum(n) AS clicks FROM order_seq GROUP BY item_ix", "order_seq")


@query(
    "A9_smoothed_popularity",
    sql(
        """SELECT item_ix, round((clicks + 2) / sum(clicks + 2) OVER (), 9) AS p_sum_one,
        round((clicks + 1) / sum(clicks) OVER (), 9) AS p_open FROM pop""",
        "pop",
    ),
)
def _(v):
    pop = evaluate.popularity(v.order_seq, v.order_dim)
    a = evaluate.smoothed_popularity(pop).select("item_ix", F.round("p", 9).alias("p_sum_one"))
    b = evaluate.smoothed_popularity(pop, 1.0, False).select("item_ix", F.round("p", 9).alias("p_open"))
    return a.join(b, "item_ix")


@query("A10_category_counts", "SELECT upper(p_brand) AS category, count(*) AS count FROM part GROUP BY 1")
def _(v):
    return binning.category_counts(v.part, "make")


@query(
    "A11_click_through",
    sql(
        f"""SELECT model, CASE WHEN ts > {SWITCH} THEN 'after' ELSE 'before' END AS period,
        sum(in_screen) AS shown, sum(clicks) AS clicked, round(sum(clicks) / sum(in_screen), 6) AS ctr
        FROM dashboard GROUP BY model, period""",
        "dashboard",
    ),
)
def _(v):
    period = F.when(F.col("ts") > SWITCH, "after").otherwise("before")
    rows = evaluate.click_through(dashboard(v).withColumn("period", period), ["model", "period"])
    return rows.withColumn("ctr", F.round("ctr", 6))


@query(
    "A12_totals",
    sql("SELECT count(*) AS positions, CAST(sum(n) AS BIGINT) AS events FROM order_items", "order_items"),
)
def _(v):
    return v.order_items.agg(F.count("*").alias("positions"), F.sum("n").alias("events"))


@query(
    "A13_bands",
    sql(
        """SELECT ad_type, round(quantile_cont(c, 0.1), 6) AS p10, round(quantile_cont(c, 0.5), 6) AS p50,
        round(quantile_cont(c, 0.9), 6) AS p90 FROM (SELECT ad_type, user_id, CAST(count(*) AS DOUBLE) AS c
        FROM clicks GROUP BY ad_type, user_id) GROUP BY ad_type""",
        "clicks",
    ),
)
def _(v):
    counts = v.clicks.groupBy("ad_type", "user_id").agg(F.count("*").alias("c"))
    rows = evaluate.bands(counts, ["ad_type"], "c")
    return rows.select("ad_type", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])


@query(
    "A14_quantile_grid",
    sql(
        " UNION ALL ".join(
            f"SELECT CAST({q} AS DOUBLE) AS q, round(quantile_cont(CAST(clicks AS DOUBLE), {q}), 6) AS value FROM pop"
            for q in (0.0, 0.25, 0.5, 0.75, 1.0)
        ),
        "pop",
    ),
)
def _(v):
    rows = evaluate.quantile_grid(evaluate.popularity(v.order_seq), "clicks", [0.0, 0.25, 0.5, 0.75, 1.0])
    return rows.select("q", F.round("value", 6).alias("value"))


@query(
    "A15_histogram",
    """SELECT CAST(least(19, floor((value - lo) * 20 / (hi - lo))) AS INTEGER) AS bin, count(*) AS rows
    FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY bin""",
)
def _(v):
    return evaluate.histogram(v.events, "value", 20)


@query(
    "A16_mean_per_step",
    sql("SELECT session_ix, round(avg(more), 6) AS mean FROM session_size GROUP BY session_ix", "session_size"),
)
def _(v):
    return session_size(v).groupBy("session_ix").agg(F.round(F.avg("more"), 6).alias("mean"))


@query(
    "A17_entropy",
    sql(
        " UNION ALL ".join(
            f"SELECT CAST({k} AS INTEGER) AS state, round(-sum(v{k} * ln(v{k})), 6) AS entropy FROM order_hmm_emis"
            for k in range(3)
        ),
        "order_hmm_emis",
    ),
)
def _(v):
    from ..operators.states import entropy

    return entropy(v.order_model.emis).select("state", F.round("entropy", 6).alias("entropy"))


@query(
    "A18_vector_sum",
    """SELECT l_partkey AS item_id, round(sum(l_quantity), 4) AS s0, round(sum(l_discount), 4) AS s1,
    round(sum(l_tax), 4) AS s2 FROM lineitem GROUP BY l_partkey""",
)
def _(v):
    rows = v.table("lineitem").select(
        F.col("l_partkey").alias("item_id"), F.array("l_quantity", "l_discount", "l_tax").alias("vec")
    )
    out = vector_sums(rows.withColumn("vec", F.col("vec").cast("array<double>")), ["item_id"])
    return out.select("item_id", *[F.round(F.col("vec")[i], 4).alias(f"s{i}") for i in range(3)])


# ---- windows ------------------------------------------------------------------------------------------


@query(
    "W1_partition_counts",
    sql(
        """SELECT user_id, us, count(*) OVER (PARTITION BY item_id) AS item_n,
        count(*) OVER (PARTITION BY user_id) AS user_n, count(*) OVER (PARTITION BY user_id, chunk) AS chunk_n
        FROM cut_strict""",
        "cut_strict",
    ),
)
def _(v):
    """Counts are combined before the shuffle and joined back, so no hot key fills a window."""
    rows = sessions.chunk_sessions(strict_numbered(v).select("user_id", "item_id", "us", "session_ix"), 20)
    for keys, name in ((["item_id"], "item_n"), (["user_id"], "user_n"), (SEQ, "chunk_n")):
        rows = rows.join(rows.groupBy(*keys).agg(F.count("*").alias(name)), keys)
    return rows.select("user_id", "us", "item_n", "user_n", "chunk_n")


def all_gaps(v) -> DataFrame:
    return sessions.gaps(*sessions.user_blocks(v.clicks), GAP)


def whole_timeline(v) -> DataFrame:
    return sessions.timeline(*sessions.user_blocks(v.clicks), GAP)


step(
    "gap_all",
    """SELECT *, CASE WHEN d > 21600000000 THEN 1 ELSE 0 END AS split FROM (
    SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS d FROM clicks)""",
    "clicks",
)


@query("W2_time_since_previous", sql("SELECT user_id, us, coalesce(d, -1) AS delta_us FROM gap_all", "gap_all"))
def _(v):
    return all_gaps(v).select("user_id", "us", F.coalesce("delta_us", F.lit(-1)).alias("delta_us"))


@query("W3_split_flag", sql("SELECT user_id, us, split FROM gap_all", "gap_all"))
def _(v):
    return all_gaps(v).select("user_id", "us", "split")


@query(
    "W4_splits_per_user",
    sql("SELECT user_id, us, CAST(sum(split) OVER (PARTITION BY user_id) AS BIGINT) AS splits FROM gap_all", "gap_all"),
)
def _(v):
    return whole_timeline(v).select("user_id", "us", "splits")


@query(
    "W5_session_index",
    sql(
        """SELECT user_id, us, CAST(sum(split) OVER (PARTITION BY user_id ORDER BY us) AS BIGINT) AS session_ix
        FROM gap_all""",
        "gap_all",
    ),
)
def _(v):
    return whole_timeline(v).select("user_id", "us", "session_ix")


@query("W6_chunks", sql("SELECT user_id, us, session_ix, chunk FROM cut_strict", "cut_strict"))
def _(v):
    return sessions.chunk_sessions(strict_numbered(v), 20).select("user_id", "us", "session_ix", "chunk")


@query(
    "W7_repeat_count_per_row",
    sql(
        """SELECT user_id, session_ix, item_id, us, count(*) OVER (PARTITION BY user_id, session_ix, item_id) AS n
        FROM numbered""",
        "numbered",
    ),
)
def _(v):
    kept, blocks = sessions.user_blocks(sessions.frequent_items(v.clicks, 1))
    rows = sessions.timeline(kept, blocks, GAP).where((F.col("user_n") > 10) & (F.col("splits") > 3))
    keys = ["user_id", "session_ix", "item_id"]
    return rows.join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys).select(*keys, "us", "n")


@query(
    "W8_cumulative_lists",
    sql(
        """SELECT user_id, session_ix, item_ix, array_to_string(list(item_ix) OVER (
        PARTITION BY user_id, session_ix ORDER BY item_ix), ',') AS so_far
        FROM order_sess JOIN order_dim USING (item_id)""",
        "order_sess",
        "order_dim",
    ),
)
def _(v):
    """Prefixes are cut from the packed session, so no list is built twice."""
    rows = packed(v).select("user_id", "session_ix", "items", F.posexplode("items").alias("p", "item_ix"))
    return rows.select(
        "user_id", "session_ix", "item_ix", text(F.slice("items", 1, F.col("p") + 1)).alias("so_far")
    )


@query(
    "W9_rank_categories",
    """SELECT upper(p_brand) AS category, count(*) AS count,
    CAST(row_number() OVER (ORDER BY count(*) DESC, upper(p_brand)) - 1 AS BIGINT) AS rank FROM part GROUP BY 1""",
)
def _(v):
    return sessions.ordered_index(binning.category_counts(v.part, "make"), [F.desc("count"), "category"], "rank")


@query(
    "W10_rolling_mean",
    sql(
        """SELECT item_ix, row_number() OVER (ORDER BY clicks, item_ix) - 1 AS rank,
        coalesce(round(CASE WHEN count(*) OVER w = 1000 THEN avg(share) OVER w END, 6), -1) AS rolling
        FROM (SELECT item_ix, clicks, greatest(v0, v1, v2) / (v0 + v1 + v2) AS share
        FROM order_hmm_emis JOIN pop USING (item_ix))
        WINDOW w AS (ORDER BY clicks, item_ix ROWS BETWEEN 500 PRECEDING AND 499 FOLLOWING)""",
        "pop",
        "order_hmm_emis",
    ),
)
def _(v):
    from ..operators.states import concentration

    rows = concentration(v.order_model.emis, evaluate.popularity(v.order_seq))
    out = evaluate.rolling_mean(rows, ["clicks", "item_ix"], "concentration", 1000)
    return out.select("item_ix", "rank", F.coalesce(F.round("rolling", 6), F.lit(-1.0)).alias("rolling"))


@query(
    "W11_scale_to_ends",
    sql(
        """SELECT user_id, session_ix, more, coalesce(round(CASE WHEN l <> f THEN (more - f) / (l - f) END, 6), -99) AS scaled
        FROM (SELECT *, first_value(more) OVER w AS f, last_value(more) OVER w AS l FROM session_size WINDOW w AS
        (PARTITION BY user_id ORDER BY session_ix ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""",
        "session_size",
    ),
)
def _(v):
    out = evaluate.scale_to_ends(session_size(v), ["user_id"], "session_ix", "more")
    return out.withColumn("scaled", F.coalesce(F.round("scaled", 6), F.lit(-99.0)))


step("daily", f"SELECT ad_type, us // {DAY} AS day, count(*) AS clicks FROM clicks GROUP BY ALL", "clicks")


@query(
    "W12_difference",
    sql(
        """SELECT a.ad_type, a.day, a.clicks - r.clicks AS diff FROM daily a JOIN daily r ON r.day = a.day
        AND r.ad_type = 'view' WHERE a.ad_type <> 'view'""",
        "daily",
    ),
)
def _(v):
    daily = v.clicks.groupBy("ad_type", F.floor(F.col("us") / DAY).alias("day")).agg(F.count("*").alias("clicks"))
    return evaluate.difference(daily, "ad_type", "view", "day", "clicks")


step(
    "suffixes",
    f"""SELECT user_id, chunk, last_n, which, t - greatest(0, len - last_n) AS t, item_ix, n FROM (
    SELECT *, max(t) OVER (PARTITION BY user_id, chunk) + 1 AS len FROM seq),
    (SELECT unnest({LENGTHS}) AS last_n, unnest({list(range(len(LENGTHS)))}) AS which)
    WHERE t >= greatest(0, len - last_n)""",
    "seq",
)


@query("W13_last_n", sql("SELECT user_id, last_n, t, item_ix FROM suffixes", "suffixes"))
def _(v):
    return sessions.suffix(v.seq, LENGTHS).select("user_id", "last_n", "t", "item_ix")


@query("W14_positions", sql("SELECT user_id, t, session_ix, item_ix, n FROM order_items", "order_items"))
def _(v):
    return sessions.item_positions(sessions.encode(v.order_sess, v.order_dim)).select(
        "user_id", "t", "session_ix", "item_ix", "n"
    )


# ---- sorting, top-k, sets --------------------------------------------------------------------------------


@query(
    "K1_top_items",
    sql(
        "SELECT state, item_ix, rank FROM ("
        "SELECT state, item_ix, CAST(row_number() OVER (PARTITION BY state ORDER BY round(v, 12) DESC, item_ix) AS INTEGER) AS rank FROM ("
        + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS state, item_ix, v{k} AS v FROM order_hmm_emis" for k in range(3))
        + ")) WHERE rank <= 15",
        "order_hmm_emis",
    ),
)
def _(v):
    return evaluate.top_items(v.order_model.emis, 15).select("state", "item_ix", "rank")


@query(
    "K6_items_by_popularity",
    sql("SELECT item_ix, CAST(clicks AS BIGINT) AS clicks, row_number() OVER (ORDER BY clicks, item_ix) - 1 AS rank FROM pop", "pop"),
)
def _(v):
    return sessions.ordered_index(evaluate.popularity(v.order_seq), ["clicks", "item_ix"], "rank")


@query(
    "U1_pool_splits",
    sql("SELECT item_ix, CAST(sum(n) AS BIGINT) AS clicks FROM seq GROUP BY item_ix", "seq"),
)
def _(v):
    rows = evaluate.by_split(v.seq, test_user())
    part = F.when(F.col("split") == "test", "test").when(F.col("user_id") % 5 == 1, "validation").otherwise("train")
    rows = rows.withColumn("split", part)
    pooled = None
    for s in ("train", "validation", "test"):
        one = rows.where(F.col("split") == s).drop("split")
        pooled = one if pooled is None else pooled.unionByName(one)
    return evaluate.popularity(pooled)


# ---- encoding ------------------------------------------------------------------------------------------


@query("E1_dictionary", sql("SELECT item_id, item_ix FROM order_dim", "order_dim"))
def _(v):
    return sessions.dictionary(v.order_lines)


@query("E2_redensify", sql("SELECT item_id, item_ix FROM synced_dim", "synced_dim"))
def _(v):
    return synced(v)[0].select("item_id", "item_ix")


@query(
    "E3_sync",
    sql(
        """SELECT user_id, session_ix, item_ix, n, p_brand AS make, p_size AS size FROM order_sess
        JOIN synced_dim USING (item_id) JOIN part ON p_partkey = item_id""",
        "order_sess",
        "synced_dim",
    ),
)
def _(v):
    items, rows = synced(v)
    return rows.join(items.select("item_ix", "make", "size"), "item_ix").select(
        "user_id", "session_ix", "item_ix", "n", "make", "size"
    )


step(
    "bin_walk",
    """SELECT i, lag(s, 1, 0) OVER (ORDER BY i) AS before, s AS done FROM (
    SELECT i, least(i + 1, i + min(b - i) OVER (ORDER BY i)) AS s FROM (
    SELECT row_number() OVER (ORDER BY x) - 1 AS i,
    greatest(0, CAST(ceil((x - 905) / 4.0) AS BIGINT) - 1) AS b
    FROM (SELECT p_retailprice AS x FROM part) WHERE x >= 905 AND x <= 990))""",
)
step("bin_edge", "SELECT 905 + (before + 1) * 4.0 AS e FROM bin_walk WHERE done > before AND i > 12", "bin_walk")


@query(
    "E4_numeric_bins",
    sql(
        """SELECT p_partkey AS item_id, CAST(CASE WHEN p_retailprice < 905 OR p_retailprice > 990
        THEN (SELECT count(*) FROM bin_edge) + 1
        ELSE (SELECT count(*) FROM bin_edge WHERE e <= p_retailprice) END AS INTEGER) AS level FROM part""",
        "bin_edge",
    ),
)
def _(v):
    return binning.bin_numeric(v.part, "price", 905.0, 990.0, 12, 4.0, "level").select("item_id", "level")


@query(
    "E5_categories",
    """WITH c AS (SELECT upper(p_brand) AS category, count(*) AS n FROM part GROUP BY 1),
    kept AS (SELECT category, row_number() OVER (ORDER BY n DESC, category) - 1 AS level FROM c
      WHERE n >= (SELECT CAST(count(*) // 25 AS BIGINT) FROM part))
    SELECT p_partkey AS item_id, CAST(coalesce(level, (SELECT count(*) FROM kept)) AS INTEGER) AS level
    FROM part LEFT JOIN kept ON category = upper(p_brand)""",
)
def _(v):
    limit = v.part.count() // 25
    return binning.encode_category(v.part, "make", limit, "level").select("item_id", "level")


step("order_len", "SELECT user_id, chunk, max(t) + 1 AS len FROM order_items GROUP BY user_id, chunk", "order_items")


def order_len(v) -> DataFrame:
    return v.order_items.groupBy(*SEQ).agg((F.max("t") + 1).alias("len"))


@query(
    "E6_length_buckets",
    sql(
        """SELECT len, CAST(r // 10 AS INTEGER) AS bucket, count(*) AS sequences FROM (
        SELECT len, row_number() OVER (PARTITION BY len ORDER BY user_id, chunk) - 1 AS r FROM order_len)
        GROUP BY len, bucket""",
        "order_len",
    ),
)
def _(v):
    return sessions.length_buckets(order_len(v), 10).groupBy("len", "bucket").agg(F.count("*").alias("sequences"))


@query(
    "E7_dense_blocks",
    sql(
        """SELECT len, CAST(r // 10 AS INTEGER) AS bucket, seg, CAST(count(*) AS INTEGER) AS height,
        CAST(count(*) * least(4096, len - seg * 4096) AS BIGINT) AS cells FROM (SELECT *,
        CAST(unnest(range((len + 4095) // 4096)) AS INTEGER) AS seg FROM (
        SELECT len, row_number() OVER (PARTITION BY len ORDER BY user_id, chunk) - 1 AS r FROM order_len))
        GROUP BY len, bucket, seg""",
        "order_len",
    ),
)
def _(v):
    """Equal-length sequences stacked, one dense block per 4096 positions."""
    import numpy as np

    rows = sessions.length_buckets(order_len(v), 10).select(*SEQ, F.col("len").alias("whole"), "bucket")
    packed_rows = sessions.pack_items(v.order_items, 4096).select(*SEQ, "seg", "items")

    def stack(pdf):
        block = np.stack(pdf["items"].to_list())
        head = pdf.iloc[:1][["whole", "bucket", "seg"]].rename(columns={"whole": "len"})
        return head.assign(height=np.int32(block.shape[0]), cells=np.int64(block.size))

    return rows.join(packed_rows, SEQ).groupBy("whole", "bucket", "seg").applyInPandas(
        stack, "len bigint, bucket int, seg int, height int, cells bigint"
    )


FLAGSHIP_SQL = """SELECT user_id, chunk, CAST(t // 4096 AS INTEGER) AS seg, CAST(count(*) AS INTEGER) AS len,
string_agg(CAST(item_ix AS VARCHAR), ',' ORDER BY t) AS items FROM {seq} GROUP BY user_id, chunk, seg"""


def flagship(v, **kw) -> DataFrame:
    """Click log to packed item sequences: sessionize, encode, number, pack."""
    from ..runtime import settle

    sess = settle(v.sessionize(**kw))
    seq = sessions.item_positions(sessions.encode(sess, sessions.dictionary(sess)))
    return sessions.pack_items(seq, 4096)


@query("E8_sessionize", sql(FLAGSHIP_SQL.format(seq="seq"), "seq"))
def _(v):
    return flagship(v).withColumn("items", text(F.col("items")))


@query("E8_sessionize_strict", sql(FLAGSHIP_SQL.format(seq="seq_strict"), "seq_strict"))
def _(v):
    return flagship(v, **CHUNKED).withColumn("items", text(F.col("items")))


@query(
    "E9_session_sets",
    sql(
        """SELECT user_id, chunk, session_ix, array_to_string(list(item_ix ORDER BY item_ix), ',') AS items,
        array_to_string(list(n ORDER BY item_ix), ',') AS counts FROM sess_strict JOIN dim_strict USING (item_id)
        GROUP BY user_id, chunk, session_ix""",
        "sess_strict",
        "dim_strict",
    ),
)
def _(v):
    from ..runtime import settle

    sess = settle(v.sessionize(**CHUNKED))
    rows = sessions.pack_sessions(sessions.encode(sess, sessions.dictionary(sess)))
    return rows.withColumn("items", text(F.col("items"))).withColumn("counts", text(F.col("counts")))


# ---- scalar functions --------------------------------------------------------------------------------------


@query(
    "F1_conditionals",
    """SELECT event_id, event_type IN ('view', 'click') AS shown, event_type = 'view' AS viewed, user_id % 7 AS slot,
    CASE WHEN value > 20 THEN 1 ELSE 0 END AS high FROM events""",
)
def _(v):
    return v.events.select(
        "event_id",
        F.col("event_type").isin("view", "click").alias("shown"),
        (F.col("event_type") == "view").alias("viewed"),
        (F.col("user_id") % 7).alias("slot"),
        F.when(F.col("value") > 20, 1).otherwise(0).alias("high"),
    )


@query(
    "F2_concat",
    """SELECT p_partkey AS item_id, p_brand || ': ' || p_type AS item_label,
    p_partkey || '-' || p_size AS pair FROM part""",
)
def _(v):
    return v.part.select(
        "item_id",
        fn.label(F.col("make"), F.col("model")).alias("item_label"),
        fn.pseudo_user(F.col("item_id"), F.col("size")).alias("pair"),
    )


@query("F3_upper", "SELECT p_partkey AS item_id, upper(p_name) AS name FROM part")
def _(v):
    return v.table("part").select(F.col("p_partkey").alias("item_id"), F.upper("p_name").alias("name"))


@query(
    "F4_digitize",
    """SELECT p_partkey AS item_id, CAST((p_size >= 5)::INT + (p_size >= 20)::INT + (p_size >= 45)::INT AS INTEGER)
    AS level FROM part""",
)
def _(v):
    return v.part.select("item_id", fn.digitize(F.col("size"), [5.0, 20.0, 45.0]).alias("level"))


@query(
    "F5_dates",
    """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds,
    CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS since FROM events""",
)
def _(v):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    start = F.unix_timestamp(F.to_timestamp(F.lit("2024-01-01"), "yyyy-MM-dd"))
    return v.events.select("event_id", seconds.alias("seconds"), (seconds - start).alias("since"))


@query(
    "F6_math",
    """SELECT event_id, round(CASE WHEN value > 0 THEN ln(value) ELSE 0 END, 6) AS log_value,
    round(exp(-value / 100), 6) AS decay, round(sqrt(abs(value)), 6) AS root,
    round(CASE WHEN value > 0 THEN -value * ln(value) ELSE 0 END, 4) AS self_info FROM events""",
)
def _(v):
    x = F.col("value")
    return v.events.select(
        "event_id",
        F.round(F.when(x > 0, F.ln(x)).otherwise(0.0), 6).alias("log_value"),
        F.round(F.exp(-x / 100), 6).alias("decay"),
        F.round(F.sqrt(F.abs(x)), 6).alias("root"),
        F.round(fn.neg_xlogx(x), 4).alias("self_info"),
    )


@query(
    "F7_arrays",
    sql(
        """SELECT user_id, session_ix, items[1] AS head, array_to_string(items[-2:], ',') AS tail,
        array_to_string(list_concat(items, items), ',') AS twice,
        CAST(len(list_distinct(items)) AS INTEGER) AS kinds FROM packed""",
        "packed",
    ),
)
def _(v):
    items = F.col("items")
    start = F.greatest(F.lit(1), F.size(items) - 1)
    return packed(v).select(
        "user_id",
        "session_ix",
        F.element_at(items, 1).alias("head"),
        text(F.slice(items, start, F.lit(2))).alias("tail"),
        text(F.concat(items, items)).alias("twice"),
        F.size(F.array_distinct(items)).alias("kinds"),
    )


@query(
    "F8_pair_lists",
    sql(
        """SELECT user_id, session_ix, array_to_string(items, ',') || '|' || array_to_string(counts, ',') AS pair
        FROM packed""",
        "packed",
    ),
)
def _(v):
    both = fn.pair_lists(F.col("items").cast("array<bigint>"), F.col("counts"))
    return packed(v).select("user_id", "session_ix", both.alias("p")).select(
        "user_id", "session_ix", F.concat_ws("|", F.transform("p", text)).alias("pair")
    )
