"""Quality rules learned as a decision list.

Sequential covering: threshold conjunctions are grown on two thirds of the labelled documents (the condition with
the highest information gain first), pruned on the remaining third, and kept in order while the pruned rule is
precise. Each step of the search is one small aggregate over a table of binned statistics; the driver sees counts per
feature and bin only. The finished list is one ordered ``CASE WHEN`` over the statistics. No Python runs on executors.

Null and empty texts have no words: they fail the base rule. Labels without a document, null labels and documents
without a label take no part in learning; of contradicting labels the lower one counts. Without labels of both classes
the list is empty and only the base rule decides. Rows that repeat a document get the same verdict each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import settle
from .text import shifted, words

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Condition:
    """``feature >= cut`` or, with ``below``, ``feature < cut``."""

    feature: str
    below: bool
    cut: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value < F.lit(self.cut) if self.below else value >= F.lit(self.cut)


Rule = tuple[Condition, ...]


def repeated_words(w: Column) -> tuple[dict[str, Column], ...]:
    """Steps of columns that end in ``n_repeat_words``: word positions inside a 3-word window that occurs again.

    Windows are sorted by hash within the document, equal neighbours give the repeated starts, and the starts are
    merged into covered positions; the cost is n log n for any text.
    """
    key = F.transform(
        F.arrays_zip(*(shifted(w, k, 3) for k in range(3))),
        lambda x, i: F.struct(F.xxhash64(x["0"], x["1"], x["2"]).alias("h"), i.alias("i")),
    )
    twins = F.filter(
        F.arrays_zip(shifted(F.col("_keys"), 0, 2), shifted(F.col("_keys"), 1, 2)),
        lambda x: x["0"]["h"] == x["1"]["h"],
    )
    starts = F.flatten(F.transform(twins, lambda x: F.array(x["0"]["i"], x["1"]["i"])))
    covered = F.aggregate(
        F.col("_starts"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(
            (p + 3).alias("end"), (a["n"] + (p + 3 - F.greatest(a["end"], p)).cast("long")).alias("n")
        ),
        lambda a: a["n"],
    )
    return (
        {"_keys": F.sort_array(key)},
        {"_starts": F.sort_array(F.array_distinct(starts))},
        {"n_repeat_words": covered},
    )


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus the base statistics and the ratios the rules are learned from, one row per document."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*keep, t.alias("_t")).withColumn("_w", words(F.col("_t")))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_l", lines)

    def without(chars: str) -> Column:
        return F.length("_t") - F.length(F.translate(F.col("_t"), chars, ""))

    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": without("#*$%&|<>").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_n_lines": F.size("_l"),
            "_upper": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "_digits": without("0123456789"),
            "_marks": without("!?"),
            "_distinct": F.size(F.array_distinct("_w")),
        }
    )
    for step in repeated_words(F.col("_w")):
        df = df.withColumns(step)
    n, c = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    ratios = {
        "f_words": F.col("n_words") / 1.0,
        "f_word_length": F.col("word_chars") / n,
        "f_symbols": F.col("n_symbols") / n,
        "f_marks": F.col("_marks") / n,
        "f_upper": F.col("_upper") / c,
        "f_digits": F.col("_digits") / c,
        "f_distinct": F.col("_distinct") / n,
        "f_line_words": F.col("n_words") / F.greatest(F.col("_n_lines"), F.lit(1)),
        "f_dup_lines": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
        "f_repeat": F.col("n_repeat_words") / n,
    }
    return df.select(*keep, *BASE, *[v.alias(k) for k, v in ratios.items()])


def base_failed(min_words: int = 50, max_repeat_pct: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """Information gain of narrowing a rule from (p0, n0) to (p1, n1) bad and good documents."""
    if not p1:
        return -1.0
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


def _counts(rows: DataFrame) -> dict[tuple[int, int, int, int], int]:
    """Documents by feature, bin, fold and class."""
    each = rows.select("fold", "bad", F.posexplode("bins").alias("feature", "bin"))
    found = each.groupBy("feature", "bin", "fold", "bad").count().collect()
    return {(r.feature, r.bin, r.fold, r.bad): r["count"] for r in found}


def learn(
    stats: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.9,
    min_support: int = 3,
    n_cuts: int = 19,
) -> list[Rule]:
    """Ordered rules, each of which rejects; learned from all labelled documents.

    A rule is accepted if at least ``min_support`` of the pruning documents it covers are bad and at least
    ``min_precision`` of them are.
    """
    features = [c for c in stats.columns if c.startswith("f_")]
    lab = labels.filter(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key)
    lab = lab.agg((F.min("quality") == 0).cast("int").alias("bad"))
    rows = settle(stats.select(key, *features).join(lab, key))
    cuts = rows.approxQuantile(features, [k / (n_cuts + 1) for k in range(1, n_cuts + 1)], 0.002)
    if not any(cuts):
        return []
    cuts = [sorted(set(c)) for c in cuts]
    bins = [sum((F.when(F.col(f) >= x, 1).otherwise(0) for x in c), F.lit(0)) for f, c in zip(features, cuts)]
    fold = (F.crc32(F.col(key).cast("string")) % 3 == 0).cast("int").alias("fold")
    left = settle(rows.select(fold, "bad", F.array(*bins).alias("bins")))

    def test(c: tuple[int, bool, int]) -> Column:
        value = F.col("bins")[c[0]]
        return value < c[2] if c[1] else value >= c[2]

    rules: list[Rule] = []
    while len(rules) < max_rules:
        chosen: list[tuple[int, bool, int]] = []
        scores: list[tuple[int, int]] = []
        rest = left
        while len(chosen) < max_conditions:
            n = _counts(rest)
            best, best_gain, best_pruned = None, 1e-9, (0, 0)
            for f, c in enumerate(cuts):
                at = lambda fold, bad, lo, hi, f=f: sum(n.get((f, b, fold, bad), 0) for b in range(lo, hi))
                total = [at(0, 1, 0, len(c) + 1), at(0, 0, 0, len(c) + 1)]
                for b in range(1, len(c) + 1):
                    for below, span in ((True, (0, b)), (False, (b, len(c) + 1))):
                        gain = _gain(*total, at(0, 1, *span), at(0, 0, *span)) if total[0] else -1.0
                        if gain > best_gain:
                            best, best_gain = (f, below, b), gain
                            best_pruned = (at(1, 1, *span), at(1, 0, *span))
            if best is None:
                break
            chosen.append(best)
            scores.append(best_pruned)
            rest = rest.filter(test(best))
        worth = [(p - m) / (p + m) if p + m else -1.0 for p, m in scores]
        if not worth:
            break
        keep = max(range(len(worth)), key=lambda k: (worth[k], -k))
        p, m = scores[keep]
        if p < min_support or p < min_precision * (p + m):
            break
        chosen = chosen[: keep + 1]
        rules.append(tuple(Condition(features[f], below, cuts[f][b - 1]) for f, below, b in chosen))
        covered = F.lit(True)
        for c in chosen:
            covered = covered & test(c)
        left = left.filter(~covered)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the first rule that fits rejects, a document none fits is kept."""
    out = None
    for rule in rules:
        fits = F.lit(True)
        for c in rule:
            fits = fits & c.column()
        out = F.when(fits, F.lit(False)) if out is None else out.when(fits, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``key``, base statistics, ``base_failed`` and ``kept`` for every row of ``docs``."""
    stats = settle(statistics(docs, keep=(key,)))
    rules = learn(stats, labels, key, **options)
    out = stats.withColumn("base_failed", base_failed())
    return out.select(key, *BASE, "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))


def passed(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that pass the base rule and the list, unchanged.

    The statistics are computed beside the rows twice, once to learn and once to judge, so no text is shuffled.
    """
    rules = learn(statistics(docs, text, (key,)), labels, key, **options)
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(c) for c in names]).alias("_row"), F.col(text).alias("_text"))
    # a filter would be moved below the statistics and compute them once for each mention
    stays = F.when(~base_failed() & verdict(rules), F.array("_row"))
    judged = statistics(whole, "_text", ("_row",)).select(F.explode(stays).alias("_row"))
    return judged.select(*[F.col("_row")[c].alias(c) for c in names])
