"""Column expressions over texts, shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import stored  # noqa: F401

SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """The maximal runs of characters other than space, tab, \\n, \\v, \\f and \\r; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, everything else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shifted(array: Column, by: int, width: int) -> Column:
    """The array without its first ``by`` items, cut so that all shifts below ``width`` have one length."""
    return F.slice(array, by + 1, F.greatest(F.size(array) - (width - 1), F.lit(0)))
