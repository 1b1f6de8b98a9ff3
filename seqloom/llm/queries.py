"""Registered queries of this folder, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import prepare
from . import (
    decision_list,
    line_windows,
    piece_viterbi,
    removal_ranks,
    signature_join,
    spaced_seeds,
    span_doubling,
    string_kernel,
    subvector_codes,
    suffix_radix,
    tag_paths,
    token_resync,
    url_models,
)
from .text import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepare(spark), folder)

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle() -> dict[str, str]:
    return dict(_SQL)


@query("op5_quality_rules")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return decision_list.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_token_counts")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    counts = token_resync.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def encoded_digest(docs: DataFrame) -> DataFrame:
    """Pieces, byte pieces and a digest of the ids of each text, and whether decoding gives the text back."""
    import public_tokenizers

    pieces = piece_viterbi.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rows = piece_viterbi.encode(docs, pieces, decoded=True)
    low, high = min(pieces.bytes_ids.values()), max(pieces.bytes_ids.values())
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.size(F.filter("ids", lambda i: i.between(low, high))).cast("long").alias("n_byte_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


@query("op10_sentencepiece")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return encoded_digest(table(spark, folder, "documents"))


@query("op1_html_extraction")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return tag_paths.extract(table(spark, folder, "pages"))


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query("op6_url_filter")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return url_models.judge(table(spark, folder, "pages"), URL_RULES)


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    # a null doc_id has no remainder; such rows are not learned from
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = string_kernel.fit(docs.filter(~held_out))
    return string_kernel.predict(docs, model, held_out)


@query("op3_line_dedup", line_windows.SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    out = line_windows.dedup(table(spark, folder, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return out.select("doc_id", "n_lines", "n_removed", digest)


@query("op9_benchmark_leaks", spaced_seeds.SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return spaced_seeds.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_substring_dedup", span_doubling.SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    out = span_doubling.dedup(table(spark, folder, "documents"), width=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_near_duplicates", signature_join.SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return signature_join.near_duplicates(table(spark, folder, "documents"), width=2, percent=80)


@query("op11_filter_interactions", removal_ranks.SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return removal_ranks.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op12_suffix_dedup", suffix_radix.SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_radix.dedup(table(spark, folder, "documents"), width=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_centroid_clusters", subvector_codes.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    out = subvector_codes.cluster(table(spark, folder, "embeddings"), k=40, rounds=5)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest)
