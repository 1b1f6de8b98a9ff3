"""Line dedup over overlapping windows of three lines.

A window is three consecutive lines of one document that hold something other than white space (blank lines are
stepped over and always kept). Windows are hashed to 128 bits and counted over all documents; of a window found more
than once the first occurrence, by document and position, stays, and every later one is covered. Covered positions of
overlapping windows are merged, and the lines they cover removed.

Documents with fewer than three such lines, null and empty texts are unchanged (a null text stays null). Rows count as
one document if both key and text are equal, so repeated rows never remove each other and get the same result; null
keys sort first. A window that very many documents share is one row after the first, map-side aggregate; the join back
is an equi-join whose large partitions Spark splits. Cost per document is linear in its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import shifted

WIDTH = 3


def _content(lines: Column) -> Column:
    """(index, line) of the lines that are not blank."""
    return F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
        lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"),
    )


def _prepared(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    id_ = F.struct(F.col(key).alias("k"), F.xxhash64(t).alias("t"))
    return docs.withColumn("_id", id_).withColumn("_lines", F.split(t, "\n"))


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id``, ``pos`` (number of the first line among those not blank), ``h1``, ``h2``; one row per window."""
    rows = _prepared(docs.select(F.col(key), F.col(text)), key, text).select("_id", _content(F.col("_lines")).alias("_c"))
    zipped = F.arrays_zip(*(shifted(F.col("_c"), k, WIDTH) for k in range(WIDTH)))
    parts = lambda z: [z[str(k)]["x"] for k in range(WIDTH)]
    hashed = F.transform(
        zipped, lambda z: F.struct(F.xxhash64(*parts(z)).alias("h1"), F.xxhash64(F.lit(1), *parts(z)).alias("h2"))
    )
    each = rows.select("_id", F.posexplode(hashed).alias("pos", "h"))
    return each.select("_id", "pos", "h.h1", "h.h2")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id`` and ``starts``: the positions of windows that occurred before."""
    found = windows(docs, key, text)
    at = F.struct("_id", "pos")
    first = found.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = found.join(first, ["h1", "h2"]).filter(~at.eqNullSafe(F.col("first")))
    return later.groupBy("_id").agg(F.collect_set("pos").alias("starts"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", into: str = "text") -> DataFrame:
    """The columns of ``docs`` with the kept lines in ``into``, and ``n_lines`` and ``n_removed`` (lines not blank)."""
    names = [c for c in docs.columns if c not in (into, "n_lines", "n_removed")]
    whole = F.struct(*[F.col(c) for c in names], F.lit(None)).alias("_row")
    rows = _prepared(docs.select(whole, F.col(key).alias("_key"), F.col(text).alias("_text")), "_key", "_text")
    gone = repeated(docs, key, text).select(F.col("_id").alias("_gone"), "starts")
    same = F.col("_id.k").eqNullSafe(F.col("_gone.k")) & (F.col("_id.t") == F.col("_gone.t"))
    rows = rows.join(gone, same, "left").withColumn("_at", F.transform(_content(F.col("_lines")), lambda s: s["i"]))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (WIDTH - 1)))))
    rows = rows.withColumn("_covered", F.transform(covered, lambda o: F.element_at("_at", o + 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_covered"))
    kept = F.array_join(F.transform(left, lambda i: F.element_at("_lines", i + 1)), "\n")
    out = F.struct(
        F.when(F.col("starts").isNull(), F.col("_text")).otherwise(kept).alias("text"),
        F.size("_at").cast("long").alias("n"),
        F.when(F.col("starts").isNull(), 0).otherwise(F.size("_covered")).cast("long").alias("gone"),
    )
    # two steps: names of the caller's columns must not meet those used above
    return rows.select("_row", out.alias("_out")).select(
        *[F.col("_row")[c].alias(c) for c in names],
        F.col("_out.text").alias(into),
        F.col("_out.n").alias("n_lines"),
        F.col("_out.gone").alias("n_removed"),
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
content AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS o
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
win AS (
  SELECT doc_id, o, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c
  FROM content WINDOW w AS (PARTITION BY doc_id ORDER BY o)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, o) AS r FROM win WHERE c IS NOT NULL),
covered AS (SELECT DISTINCT doc_id, o + unnest([0, 1, 2]) AS o FROM ranked WHERE r > 1),
gone AS (SELECT doc_id, i FROM content JOIN covered USING (doc_id, o))
SELECT doc_id,
       (SELECT count(*) FROM content c WHERE c.doc_id = d.doc_id)::BIGINT AS n_lines,
       (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id)::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept
  FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id) k USING (doc_id)
"""
