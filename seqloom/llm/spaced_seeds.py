"""Benchmark decontamination by spaced seeds.

Texts become lower-case runs of letters and digits. A document is contaminated by an item if ``percent`` of the tokens
of some stretch of ``window`` tokens (of the whole item, if that is shorter) agree, compared one by one without gaps.
To find all such stretches, a stretch is cut into more equal blocks than tokens may differ, so that some blocks are
untouched in every leak: each choice of that many blocks is a mask (``masks``), and the hashes of the masked tokens of
items and documents are joined. Masks that differ only by their place are one shape. Around each hit every stretch that
holds the seed is compared, so no leak is missed, whatever the length of the item, and the best stretch is the best of
all.

Null and empty texts on either side find nothing; an item of four tokens or less is found where it stands word by word. An item or
document id that comes more than once is reported once, with its best stretch; documents without an id are told apart
by a hash of their text. ``clean`` judges every row by its own text, whatever its id. The benchmark's seeds are sent to
all tasks only after they were counted (``broadcast_if_small``); then no document is shuffled at all. A larger
benchmark is met by an equi-join of hashes, and only documents with a hit are read again to be compared.
"""

from __future__ import annotations

import json
import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES
from .text import stored

#: Of the SQL counterpart, which finds a part of the leaks only.
MASKS = ("110110101101", "111010011011", "101110110011")
SPAN = 12

#: Tokens a mask should hold at least, and at most.
LIGHT, HEAVY = 6, 12
_MASKS = "array<struct<shape int, first int, span int, o array<int>>>"


def masks(length: int, percent: int) -> list[tuple[int, ...]]:
    """Places in a stretch; two stretches of which ``percent`` agree are equal at all places of one mask at least."""
    if percent <= 0:
        raise ValueError("percent must be positive")
    wrong = length * (100 - percent) // 100
    best: list[tuple[int, ...]] = []
    for kept in range(1, length - wrong + 1):
        if math.comb(wrong + kept, kept) > 1000 and best:
            break
        size = min(length // (wrong + kept), -(-HEAVY // kept))
        if not best or kept * size > len(best[0]):
            chosen = combinations(range(wrong + kept), kept)
            best = [tuple(k * size + i for k in c for i in range(size)) for c in chosen]
        if len(best[0]) >= LIGHT:
            break
    return best


def shapes(lengths: list[int], percent: int) -> dict[tuple[int, ...], int]:
    """A number for each mask of these lengths, moved to start at 0."""
    found = {tuple(o - m[0] for o in m) for n in lengths for m in masks(n, percent)}
    return {m: k for k, m in enumerate(sorted(found))}


def _literal(rows: list[tuple[int, int, tuple[int, ...]]]) -> Column:
    made = [{"shape": k, "first": first, "span": m[-1] + 1, "o": m} for k, first, m in rows]
    return F.from_json(F.lit(json.dumps(made)), _MASKS)


def _seed(tokens: str, weight: int) -> Column:
    """Hash of the tokens that mask ``_m`` holds at ``at``; places a lighter mask lacks are null and not hashed."""
    held = [F.get(F.col(tokens), F.col("at") + F.get(F.col("_m.o"), F.lit(k))) for k in range(weight)]
    return F.xxhash64(F.col("_m.shape"), *held)


def _tokens(text: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, tokens: str, found: dict[tuple[int, ...], int]) -> DataFrame:
    """All columns plus ``at`` (start of a mask) and ``seed`` (hash of its tokens and its shape)."""
    size = F.size(tokens)
    shortest = min(m[-1] + 1 for m in found)
    # a condition on the size would be moved before the tokens and compute them twice
    starts = F.when(size >= shortest, F.sequence(F.lit(0), size - shortest))
    spans = rows.select("*", F.explode(starts).alias("at"))
    each = spans.select("*", F.explode(_literal([(k, 0, m) for m, k in found.items()])).alias("_m"))
    seed = F.when(F.col("at") + F.col("_m.span") <= size, _seed(tokens, max(map(len, found))))
    return each.select(*spans.columns, seed.alias("seed"))


def _benchmark_seeds(items: DataFrame, lengths: list[int], found: dict[tuple[int, ...], int], percent: int) -> DataFrame:
    """Seeds of rows of ``_item``, ``_b`` and ``_len`` with the tokens as far as a stretch around the seed can reach."""
    each = F.lit(None).cast(_MASKS)
    for n in lengths:
        moved = [(m[0], tuple(o - m[0] for o in m)) for m in masks(n, percent)]
        each = F.when(F.col("_len") == n, _literal([(found[m], first, m) for first, m in moved])).otherwise(each)
    rows = items.select("*", F.explode(each).alias("_m"))
    first = F.col("_m.first")
    rows = rows.select("*", F.explode(F.sequence(first, F.size("_b") - F.col("_len") + first)).alias("at"))
    low = F.greatest(F.lit(0), F.col("at") + F.col("_m.span") - F.col("_len"))
    high = F.least(F.size("_b"), F.col("at") + F.col("_len"))
    made = rows.select(
        "_item",
        _seed("_b", max(map(len, found))).alias("seed"),
        "_len",
        (F.col("at") - low).alias("_off"),
        F.slice("_b", low + 1, high - low).alias("_near"),
    )
    return made.distinct()  # masks of one shape meet at the same places


def _beside(hits: DataFrame) -> DataFrame:
    """Hits with ``_part``, the document's tokens beside ``_near``; ``_lead`` of these lie before the document.

    The cut is taken right behind the join, in the same generated code, so that no exploded row holds a whole text.
    Grouping keeps the comparison, which is no part of that code, from being moved into the join.
    """
    start = F.col("at") - F.col("_off")
    low = F.greatest(start, F.lit(0))
    high = F.least(F.size("_t"), start + F.size("_near"))
    cut = hits.select(
        "_key", "_id", "_item", start.alias("_from"), "_len", "_near", (low - start).alias("_lead"), F.slice("_t", low + 1, high - low).alias("_part")
    )
    names = ["_near", "_lead", "_part"]
    # one place of a document may lie beside several places of an item: these differ in ``_near``
    place = F.xxhash64("_near").alias("_place")
    return cut.groupBy("_key", "_id", "_item", "_from", "_len", place).agg(*[F.first(c).alias(c) for c in names])


def _compared(hits: DataFrame, percent: int) -> DataFrame:
    """``_best``: tokens that agree and negated start in the document, of the best stretch around each hit."""
    same = lambda s: F.size(
        F.filter(
            F.sequence(F.lit(0), F.col("_len") - 1),
            lambda k: F.get(F.col("_part"), s + k - F.col("_lead")) == F.get(F.col("_near"), s + k),
        )
    )
    tried = F.transform(
        F.sequence(F.lit(0), F.size("_near") - F.col("_len")),
        lambda s: F.when(
            (s >= F.col("_lead")) & (s + F.col("_len") - F.col("_lead") <= F.size("_part")),
            F.struct(same(s).cast("long").alias("n"), (-(F.col("_from") + s)).cast("long").alias("at")),
        ),
    )
    out = hits.withColumn("_best", F.array_max(tried))
    return out.filter(100 * F.col("_best.n") >= percent * F.col("_len"))


def _found(
    docs: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str, window: int, percent: int
) -> DataFrame:
    """``_best`` and ``_len`` of each document (``_key``, ``_id``), item and place that is a leak."""
    tokens = items.select(F.col(item).alias("_item"), _tokens(F.col(item_text)).alias("_b"))
    tokens = tokens.select("*", F.least(F.size("_b"), F.lit(window)).alias("_len"))
    lengths = sorted(r[0] for r in tokens.select("_len").distinct().collect() if r[0])
    found = shapes(lengths or [window], percent)
    test = stored(_benchmark_seeds(tokens, lengths, found, percent))
    limit = BROADCAST_BYTES // (128 + 16 * window)  # a seed carries fewer than 2 * window tokens
    small = test.limit(limit + 1).count() <= limit
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_id"), F.col(text).alias("_x"))
    held = rows.select("_key", "_id", _tokens(F.col("_x")).alias("_t"))
    if small:
        hits = seeds(held, "_t", found).join(F.broadcast(test), "seed")
    else:
        bare = seeds(held, "_t", found).select("_key", "_id", "at", "seed").join(test, "seed")
        same = F.col("a._key").eqNullSafe(F.col("b._key")) & (F.col("a._id") == F.col("b._id"))
        hits = bare.alias("a").join(rows.alias("b"), same).select("a.*", _tokens(F.col("b._x")).alias("_t"))
    return _compared(_beside(hits), percent)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 24,
    percent: int = 80,
) -> DataFrame:
    """``key``, ``item``, ``n_matched`` of ``n_compared`` tokens and ``start`` (token in the document) of each leak."""
    one = F.when(F.col("_key").isNull(), F.col("_id")).alias("_one")
    best = _found(docs, items, key, text, item, item_text, window, percent).groupBy("_key", one, "_item").agg(
        F.max(F.struct("_best.n", "_best.at", "_len")).alias("best")
    )
    return best.select(
        F.col("_key").alias(key),
        F.col("_item").alias(item),
        F.col("best.n").alias("n_matched"),
        F.col("best._len").cast("long").alias("n_compared"),
        (-F.col("best.at")).alias("start"),
    )


def clean(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 24,
    percent: int = 80,
) -> DataFrame:
    """The rows of ``docs`` no item leaks into, unchanged."""
    bad = _found(docs, items, key, text, item, item_text, window, percent).select("_key", "_id").distinct()
    same = F.col(f"d.{key}").eqNullSafe(F.col("bad._key")) & (F.xxhash64(F.col(f"d.{text}")) == F.col("bad._id"))
    return docs.alias("d").join(bad.alias("bad"), same, "left_anti")


def _sql() -> str:
    def picked(mask: str) -> str:
        return ", ".join(f"t[p + {o + 1}]" for o, c in enumerate(mask) if c == "1")

    def seeded(source: str) -> str:
        return " UNION ALL ".join(
            f"SELECT id, p, {k} AS m, [{picked(mask)}] AS seed FROM {source}" for k, mask in enumerate(MASKS)
        )

    def tokens(table: str, key: str) -> str:
        return (
            f"SELECT {key} AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), "
            f"lambda w: w <> '') AS t FROM {table}"
        )

    def spans(source: str) -> str:
        return f"SELECT id, t, unnest(range(len(t) - {SPAN} + 1)) AS p FROM {source} WHERE len(t) >= {SPAN}"

    return f"""
WITH d AS ({tokens("documents", "doc_id")}), b AS ({tokens("benchmark", "item_id")}),
ds AS ({spans("d")}), bs AS ({spans("b")}),
hits AS (
  SELECT DISTINCT x.id AS doc_id, y.id AS item_id, x.p AS dp, y.p AS bp
  FROM ({seeded("ds")}) x JOIN ({seeded("bs")}) y USING (m, seed)),
stretch AS (
  SELECT doc_id, item_id, d.t AS dt, b.t AS bt, dp - bp AS shift, least(len(b.t), 24) AS n,
         unnest(range(greatest(0, bp + {SPAN} - least(len(b.t), 24)), least(bp, len(b.t) - least(len(b.t), 24)) + 1)) AS s
  FROM hits JOIN d ON d.id = doc_id JOIN b ON b.id = item_id),
tried AS (
  SELECT doc_id, item_id, n, s + shift AS place,
         len(list_filter(range(n), lambda k: dt[s + shift + k + 1] = bt[s + k + 1])) AS same
  FROM stretch WHERE s + shift >= 0 AND s + shift + n <= len(dt))
SELECT doc_id, item_id, same::BIGINT AS n_matched, n::BIGINT AS n_compared, place::BIGINT AS start
FROM tried WHERE 100 * same >= 80 * n
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY same DESC, place) = 1
"""


SQL = _sql()
