"""How filters interact: what each removes, and what others would have removed, for every order of applying them.

A document is the set of filters it fails. Documents are counted by part and set with map-side aggregates, so that at
most 2^filters counts a part remain. A mask matrix (0 where a set holds a filter, infinity elsewhere) is combined with
the matrix of the filters' positions in each order (inverse permutations) by a min-plus product: the result is the step
at which documents of a set go in an order. Counts are scattered to those steps; a filter at a later step that
the set holds too finds the documents gone, and is redundant for them.

The five filters of ``failures``: A under 50 words; B fewer than 65 distinct words in 100; C more than 5 capitals A-Z in
100 code points; D a character of ``#$%&*|``; E the text of a document with a smaller key, removed or not. Words are the
runs of characters other than space, tab, \\n, \\v, \\f and \\r, and differ by case. Null texts are empty; texts are told
apart by 128 bits. A null part counts as the empty string. A null key is smaller than none, none is smaller than it, and
it has no labels. Repeated rows count each; they do not fail E through each other. A document labelled more than once
is good or toxic if any of its labels says so. An empty table gives no rows. A text or key that very many rows hold is
one row of each task after the first aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SPACE

FILTERS = "ABCDE"
_BLANKS = " \t\n\x0b\x0c\r"
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _own(text) -> dict:
    """What the text alone decides: bits of A to D."""
    distinct, caps = F.size(F.array_distinct("_w")), F.regexp_count(text, F.lit("[A-Z]"))
    words = F.size("_w")
    return {
        "A": words < 50,
        "B": F.lit(100) * distinct < F.lit(65) * words,
        "C": F.lit(100) * caps > F.lit(5) * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part``, ``mask`` (bit i: fails the i-th filter), ``n``, ``good`` and ``toxic``: counts of documents."""
    rows = docs.select(
        F.col(key).alias("_k"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("_t")
    )
    bare = F.btrim("_t", F.lit(_BLANKS))
    rows = rows.withColumn("_w", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)))
    bits = [c.cast("int") * (1 << i) for i, c in enumerate(_own(F.col("_t")).values())]
    hashes = [F.xxhash64("_t").alias("_h"), F.xxhash64(F.lit(1), "_t").alias("_g")]
    rows = rows.select("_k", "part", sum(bits[1:], bits[0]).alias("_m"), *hashes)
    rows = rows.groupBy("_k", "part", "_m", "_h", "_g").agg(F.count("*").alias("n"))
    known = rows.filter("_k IS NOT NULL")
    # each text passes E under its smallest key: a join on the key and the text, which no group of copies makes hot
    first = known.groupBy("_h", "_g").agg(F.min("_k").alias("_k")).withColumn("_first", F.lit(0))
    known = known.join(first, ["_k", "_h", "_g"], "left")
    said = labels.select(F.col(key).alias("_k"), *[F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)).alias(c) for c in ("quality", "toxic")])
    said = said.filter("_k IS NOT NULL").groupBy("_k").agg(F.max("quality").alias("_q"), F.max("toxic").alias("_x"))
    known = known.join(said, "_k", "left").select(
        "part", (F.col("_m") + F.coalesce("_first", F.lit(1 << 4))).alias("mask"), "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("_q", "_x")]
    )
    free = rows.filter("_k IS NULL").select("part", F.col("_m").alias("mask"), "n", F.lit(0).alias("_q"), F.lit(0).alias("_x"))
    return known.unionByName(free).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_q")).alias("good"), F.sum(F.col("n") * F.col("_x")).alias("toxic")
    )


def orders(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders (order x step -> filter) and their inverses (filter x order -> step)."""
    each = np.array(list(permutations(range(n))))
    return each, np.argsort(each, axis=1).T


def removal_steps(masks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Mask x order -> step at which a document with that mask goes; the number of filters if at none.

    The min-plus product of the masks' costs and the positions.
    """
    n = len(positions)
    cost = np.where(masks[:, None] >> np.arange(n) & 1, 0, n)
    return np.minimum((cost[:, :, None] + positions[None, :, :]).min(axis=1), n)


def tallies(counts: np.ndarray, n: int = len(FILTERS)) -> np.ndarray:
    """Counts (3 kinds x mask) -> order x step x the columns of ``_COUNTS``."""
    each, positions = orders(n)
    masks = np.arange(1 << n)
    steps = removal_steps(masks, positions)
    lost = np.zeros((3, len(each), n + 1), np.int64)
    for kind in range(3):
        np.add.at(lost[kind], (np.arange(len(each)), steps), counts[kind][:, None])
    fails = masks[:, None] >> np.arange(n) & 1
    out = np.zeros((len(each), n, len(_COUNTS)), np.int64)
    removed = lost[0, :, :n]
    out[..., 0] = counts[0].sum() - removed.cumsum(axis=1)
    out[..., 1] = removed
    out[..., 2] = (counts[0] @ fails)[each] - removed  # a document that fails the filter of a step goes there or before
    out[..., 3] = counts[0][1 << np.arange(n)][each]
    out[..., 4:6] = np.moveaxis(lost[1:, :, :n], 0, -1)
    shapley = np.bincount(each.ravel(), removed.ravel(), minlength=n).astype(np.int64)
    out[..., 6] = shapley[each]
    return out


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part``, ``filter_order``, ``step`` (from 1) and the counts of each part, order and step."""
    n = len(FILTERS)
    counted = failures(docs, labels, key, text, part)
    # at most 2^5 rows a part
    per = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))
    names = ["".join(FILTERS[f] for f in order) for order in orders(n)[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, cells in zip(b.column(0), b.column(1)):
                counts = np.zeros((3, 1 << n), np.int64)
                for c in cells.as_py():
                    counts[:, c["mask"]] += (c["n"], c["good"], c["toxic"])
                out = tallies(counts).reshape(len(names) * n, -1)
                columns = [
                    pa.array([name.as_py()] * len(out), pa.string()),
                    pa.array(np.repeat(names, n)),
                    pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(names))),
                    *[pa.array(out[:, i]) for i in range(len(_COUNTS))],
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *_COUNTS])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)
    return per.mapInArrow(run, schema)


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(
    string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
flags AS (
  SELECT w.doc_id, part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad, [
    len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws),
    100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), w.doc_id > min(w.doc_id) OVER (PARTITION BY t)] AS f
  FROM w LEFT JOIN labels USING (doc_id)),
letter AS (SELECT unnest(range(1, 6)) AS i),
ord AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
gone AS (
  SELECT part, good, bad, f, o, list_position(list_transform(o, lambda i: f[i]), true) AS s FROM flags, ord),
step AS (
  SELECT part, o, k, count(*) FILTER (s IS NULL OR s > k) AS kept, count(*) FILTER (s = k) AS removed,
         count(*) FILTER (s < k AND f[o[k]]) AS redundant,
         count(*) FILTER (f[o[k]] AND len(list_filter(f, lambda x: x)) = 1) AS unique_fails,
         count(*) FILTER (s = k AND good) AS good_lost, count(*) FILTER (s = k AND bad) AS toxic_lost
  FROM gone, (SELECT unnest(range(1, 6)) AS k) GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, k::INT AS step,
       kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, o[k]))::BIGINT AS shapley
FROM step
"""
