"""Documents to encoded training text: quality rules, dedup of lines and documents, decontamination, encoding.

``STAGES`` are applied in order, each to the Parquet table the one before wrote. Stages but the last return the columns
of ``documents``; their decisions are in the rows and texts they return:

* ``quality_rules`` keeps the documents that pass the base rule and the learned decision list,
* ``line_dedup`` removes the later occurrences of repeated three-line windows from the texts (``n_chars`` follows),
* ``near_dedup`` keeps one document of each group of near-duplicates (word 5-grams, similarity 0.8 or more),
* ``decontaminate`` drops the documents a benchmark item leaks into,
* ``encode`` returns the number and a digest of each text's pieces, and whether decoding gives the text back.

Null, empty and very long texts, repeated rows, ties and empty tables have the results the operators define.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import decision_list, line_windows, signature_join, spaced_seeds
from seqloom.llm.queries import encoded_digest
from seqloom.llm.text import stored, table
from seqloom.runtime import prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decision_list.passed(docs, table(prepare(spark), sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    names = docs.columns
    out = line_windows.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(c) for c in names])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return signature_join.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spaced_seeds.clean(docs, table(prepare(spark), sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return encoded_digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: Neither the learned list nor the pieces of a text can be expressed in SQL; tests hold the stages to plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
