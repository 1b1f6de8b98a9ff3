"""From a click log to numbered sessions and dense-encoded sequences.

Row forms used from here on:

* sessions  ``(user_id, chunk, session_ix, item_id, n)``: an item seen ``n`` times in a session
* sequence  ``(user_id, chunk, t, item_ix, n)``: the position ``t`` counts items (item mode) or
  sessions (session mode) inside one sequence; a sequence is one ``(user_id, chunk)``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import skew
from ..runtime import broadcast_if_small, settle

SEQ = ["user_id", "chunk"]
HALF_HOUR = 30 * 60 * 1_000_000
SESSION_SHIFT = 1 << 31


def frequent_items(clicks: DataFrame, min_item: int) -> DataFrame:
    """Clicks on items with more than ``min_item`` clicks; counts are combined before the shuffle.

    The kept items are counted: as far as they fit they are sent to the clicks, which then are not shuffled by item.
    """
    keep = settle(clicks.groupBy("item_id").count().where(F.col("count") > min_item).select("item_id"))
    return clicks.join(broadcast_if_small(keep, 64), "item_id", "left_semi")


def active_users(clicks: DataFrame, min_user: int, blocks: skew.Blocks) -> DataFrame:
    """Clicks of users with more than ``min_user`` clicks, with the count kept as ``user_n``."""
    return skew.totals(clicks, blocks, {"user_n": F.count("*")}, "us").where(F.col("user_n") > min_user)


def user_blocks(clicks: DataFrame, hot_rows: int | None = None) -> tuple[DataFrame, skew.Blocks]:
    """Cut the users that hold too many clicks into blocks along time."""
    blocks = skew.find_blocks(clicks, ["user_id"], F.col("us"), hot_rows)
    return blocks.assign(clicks, F.col("us")), blocks


def weighted_blocks(
    clicks: DataFrame, everything: DataFrame, hot_rows: int | None
) -> tuple[DataFrame, skew.Blocks]:
    """Blocks over clicks with a weight ``w``.

    Hot users are looked for among all clicks, before any item is filtered out: that count reads
    the user column only.

    A block cannot split clicks of one user at one instant.  When there are hot users, equal clicks
    are therefore counted into one row first (combined before the shuffle), which leaves at most
    one row per item for any instant.
    """
    blocks = skew.find_blocks(everything, ["user_id"], F.col("us"), hot_rows)
    if blocks.hot:
        rows = clicks.groupBy("user_id", "item_id", "us").agg(F.count("*").alias("w"))
    else:
        rows = clicks.withColumn("w", F.lit(1).cast("bigint"))
    return blocks.assign(rows, F.col("us")), blocks


def gaps(clicks: DataFrame, blocks: skew.Blocks, gap_us: int = HALF_HOUR) -> DataFrame:
    """Time since the previous click of the user and the split flag (strictly above the gap)."""
    out = skew.previous(clicks, blocks, "us", ["us"], "prev_")
    out = out.withColumn("delta_us", F.col("us") - F.col("prev_us")).drop("prev_us")
    return out.withColumn("split", F.when(F.col("delta_us") > gap_us, 1).otherwise(0))


def timeline(clicks: DataFrame, blocks: skew.Blocks, gap_us: int = HALF_HOUR, size=None) -> DataFrame:
    """All per-user columns in one go: ``user_n, delta_us, split, splits, session_ix``.

    Splits are counted over the whole user, ``session_ix`` is their running sum (clicks at one
    instant share it).  For hot users the blocks are summed up once: a block's first click is a
    split if it lies a gap after the last click of the block before, so totals and offsets follow
    from one row per block.
    """
    size = F.count("*") if size is None else size
    w = blocks.window("us")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = clicks.withColumn("_prev", F.lag("us").over(w))
    if blocks.hot:
        rows = rows.join(F.broadcast(_block_edges(rows, blocks, gap_us, size)), ["user_id", skew.BLK], "left")
        rows = rows.withColumn("_prev", F.coalesce("_prev", "_last"))
    rows = rows.withColumn("delta_us", F.col("us") - F.col("_prev"))
    rows = rows.withColumn("split", F.when(F.col("delta_us") > gap_us, 1).otherwise(0))
    user_n, splits, index = size.over(whole), F.sum("split").over(whole), F.sum("split").over(so_far)
    if blocks.hot:
        user_n, splits = F.coalesce("_n", user_n), F.coalesce("_splits", splits)
        index = index + F.coalesce("_before", F.lit(0))
    out = rows.select("*", user_n.alias("user_n"), splits.alias("splits"), index.alias("session_ix"))
    return out.drop("_prev", "_last", "_n", "_splits", "_before")


def _block_edges(rows: DataFrame, blocks: skew.Blocks, gap_us: int, size) -> DataFrame:
    """Per block of a hot user: last click before it, splits before it, totals of the user."""
    inside = F.sum(F.when(F.col("us") - F.col("_prev") > gap_us, 1).otherwise(0))
    per_block = blocks.carried(
        rows, {"_c": size, "_from": F.min("us"), "_to": F.max("us"), "_inside": inside}
    )
    along = Window.partitionBy("user_id").orderBy(skew.BLK)
    per_block = per_block.withColumn("_last", F.lag("_to").over(along))
    opens = F.when(F.col("_from") - F.col("_last") > gap_us, 1).otherwise(0)
    per_block = per_block.withColumn("_all", F.col("_inside") + opens)
    user = Window.partitionBy("user_id")
    return per_block.select(
        "user_id",
        skew.BLK,
        "_last",
        F.sum("_c").over(user).alias("_n"),
        F.sum("_all").over(user).alias("_splits"),
        F.sum("_all").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
    )


def chunk_sessions(df: DataFrame, max_sessions: int) -> DataFrame:
    """Cut a long history into pseudo-users of ``max_sessions`` sessions (0: no cut)."""
    chunk = F.floor(F.col("session_ix") / max_sessions) if max_sessions > 0 else F.lit(0)
    return df.withColumn("chunk", chunk.cast("int"))


def sessionize(
    clicks: DataFrame,
    gap_us: int = HALF_HOUR,
    min_item: int = 1,
    min_user: int = 10,
    min_sessions: int = 5,
    max_sessions: int = 0,
    hot_rows: int | None = None,
) -> DataFrame:
    """Clicks to sessions.  One exchange on the user serves all windows and the final grouping.

    Clicks without a user are nobody's sequence and are dropped.
    """
    clicks = clicks.select("user_id", "item_id", "us").where(F.col("user_id").isNotNull())
    kept, blocks = weighted_blocks(frequent_items(clicks, min_item), clicks, hot_rows)
    out = timeline(kept, blocks, gap_us, F.sum("w"))
    out = out.where((F.col("user_n") > min_user) & (F.col("splits") > min_sessions))
    out = chunk_sessions(out, max_sessions)
    if max_sessions > 0:
        out = active_chunks(out, min_user, F.sum("w"))
    return out.groupBy(*SEQ, "session_ix", "item_id").agg(F.sum("w").alias("n"))


def active_chunks(df: DataFrame, min_user: int, size=None) -> DataFrame:
    """Drop chunks with at most ``min_user`` clicks.

    The counts are combined before their shuffle and joined back, so a hot user's chunks never
    meet in one task as they would in a window.
    """
    size = F.count("*") if size is None else size
    keep = df.groupBy(*SEQ).agg(size.alias("_c")).where(F.col("_c") > min_user).select(*SEQ)
    return df.join(keep, SEQ, "left_semi")


def ordered_index(df: DataFrame, order: list, ix_col: str) -> DataFrame:
    """Add a dense 0..N-1 index along ``order`` (a total order), without a one-task sort.

    The rows are range-sorted over all tasks and stored once; the offset of a partition is the
    number of rows before it, a table with one row per partition.
    """
    rows = settle(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_mid", 33)
    sizes = rows.groupBy(part.alias("_part")).count().collect()
    offset, table = 0, []
    for r in sorted(sizes, key=lambda r: r["_part"]):
        table.append((r["_part"], offset))
        offset += r["count"]
    offsets = df.sparkSession.createDataFrame(table, "_part bigint, _off bigint")
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(ix_col, F.col("_off") + local)
        .drop("_part", "_off", "_mid")
    )


def dictionary(df: DataFrame, id_col: str = "item_id", ix_col: str = "item_ix") -> DataFrame:
    """Dense 0..N-1 index of the distinct ids, in id order."""
    ids = ordered_index(df.select(id_col).distinct(), [id_col], ix_col)
    return ids.withColumn(ix_col, F.col(ix_col).cast("int"))


def encode(df: DataFrame, item_dim: DataFrame) -> DataFrame:
    """Replace the item id by its dense index; rows without a dictionary entry are dropped."""
    return df.join(broadcast_if_small(item_dim), "item_id").drop("item_id")


def item_positions(encoded: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Item mode: one position per (session, item), ordered by session, then item.

    A position counts as one click here, however often the item came up in the session.
    """
    order = F.col("session_ix").cast("long") * SESSION_SHIFT + F.col("item_ix")
    df = encoded.withColumn("_ord", order)
    blocks = skew.find_blocks(df, SEQ, F.col("_ord"), hot_rows)
    df = skew.position(blocks.assign(df, F.col("_ord")), blocks, "_ord", "t")
    one = F.lit(1).cast("bigint").alias("n")
    return df.select(*SEQ, "t", "session_ix", "item_ix", one)


def session_positions(encoded: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Session mode: one position per session that still has items.

    Sessions are ranked on the rows themselves, which are exchanged once; rows without a sequence or session go.
    """
    known = encoded.dropna(subset=[*SEQ, "session_ix"])
    blocks = skew.find_blocks(known, SEQ, F.col("session_ix"), hot_rows)
    ranked = skew.rank(blocks.assign(known, F.col("session_ix")), blocks, "session_ix", "t")
    return ranked.select(*SEQ, "t", "session_ix", "item_ix", "n")


def pack_sessions(encoded: DataFrame) -> DataFrame:
    """One row per session: items and their counts as parallel arrays, ordered by item."""
    pairs = F.array_sort(F.collect_list(F.struct("item_ix", "n")))
    return (
        encoded.groupBy(*SEQ, "session_ix")
        .agg(pairs.alias("_p"))
        .select(
            *SEQ,
            "session_ix",
            F.col("_p.item_ix").alias("items"),
            F.col("_p.n").alias("counts"),
        )
    )


def pack_items(seq: DataFrame, segment: int) -> DataFrame:
    """One row per sequence segment of at most ``segment`` positions, items in order."""
    return (
        seq.withColumn("seg", F.floor(F.col("t") / segment).cast("int"))
        .groupBy(*SEQ, "seg")
        .agg(F.array_sort(F.collect_list(F.struct("t", "item_ix"))).alias("_p"))
        .select(*SEQ, "seg", F.size("_p").alias("len"), F.col("_p.item_ix").alias("items"))
    )


def pack_user_sessions(packed: DataFrame, segment: int) -> DataFrame:
    """Sessions of a sequence in order, at most ``segment`` sessions per row."""
    return (
        packed.withColumn("seg", F.floor(F.col("session_ix") / segment).cast("int"))
        .groupBy(*SEQ, "seg")
        .agg(F.array_sort(F.collect_list(F.struct("session_ix", "items", "counts"))).alias("sessions"))
    )


def suffix(seq: DataFrame, lengths: list[int]) -> DataFrame:
    """The last n positions of every sequence for each n, renumbered from 0.

    The length of a sequence is pre-aggregated and joined back, which needs no window.
    """
    size = seq.groupBy(*SEQ).agg((F.max("t") + 1).alias("len"))
    last_n = F.explode(F.array(*[F.lit(n) for n in lengths]))
    # what no suffix reaches goes before a row is copied once per length
    near = seq.join(size, SEQ).where(F.col("t") >= F.col("len") - max(lengths))
    out = near.select("*", last_n.alias("last_n"))
    start = F.greatest(F.lit(0), F.col("len") - F.col("last_n"))
    return out.where(F.col("t") >= start).select(
        *SEQ, "last_n", (F.col("t") - start).alias("t"), "item_ix", "n"
    )


def length_buckets(sizes: DataFrame, limit: int = 10_000, hot_rows: int | None = None) -> DataFrame:
    """Bucket number per sequence: equal length, at most ``limit`` sequences per bucket.

    Which of the equal-length sequences share a bucket does not matter, so they are numbered in
    hash order; a length that very many sequences have is numbered block by block.
    """
    df = sizes.withColumn("_ord", F.xxhash64(*SEQ))
    blocks = skew.find_blocks(df, ["len"], F.col("_ord"), hot_rows)
    df = skew.position(blocks.assign(df, F.col("_ord")), blocks, "_ord", "_r")
    return df.withColumn("bucket", F.floor(F.col("_r") / limit).cast("int")).drop("_r", "_ord", skew.BLK)


def reencode(seq_ids: DataFrame, item_dim: DataFrame, items: DataFrame):
    """Reconcile sequences and catalogue.

    Returns the catalogue with new dense indexes, and the rows of ``seq_ids`` re-indexed to it;
    clicks on items without a catalogue row are dropped, and sequences left empty vanish with them.
    """
    known = items.join(item_dim.select("item_id"), "item_id", "left_semi")
    new_dim = dictionary(known)
    return known.join(broadcast_if_small(new_dim), "item_id"), encode(seq_ids, new_dim)


def unmatched(items: DataFrame, item_dim: DataFrame) -> DataFrame:
    """How many catalogue rows were observed, and how many were not."""
    seen = item_dim.select("item_id", F.lit(1).alias("_s"))
    return items.join(seen, "item_id", "left").agg(
        F.count("_s").alias("hits"), (F.count("*") - F.count("_s")).alias("misses")
    )


