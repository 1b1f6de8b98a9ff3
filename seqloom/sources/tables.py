"""Scans and sinks: click log, item catalogue, dashboard log, split tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DASHBOARD_SCHEMA = "day STRING, model STRING, in_screen STRING, clicks STRING"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def clicks(
    events: DataFrame,
    types: Sequence[str] | None = None,
    sub_category: str | None = None,
    sub_category_col: str = "event_type",
) -> DataFrame:
    """Click rows ``(user_id, item_id, us, ad_type)`` from the event log.

    Both filters sit on plain scan columns, so they reach the parquet reader.
    """
    out = events
    if types is not None:
        out = out.where(F.col("event_type").isin(list(types)))
    if sub_category is not None:
        out = out.where(F.col(sub_category_col) == F.lit(sub_category))
    return out.select(
        "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("item_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("event_type").alias("ad_type"),
    )


def catalogue(
    spark: SparkSession,
    items: DataFrame,
    columns: Sequence[str],
    published_after: str,
    ad_types: Sequence[str],
    published_col: str = "published",
    type_col: str = "ad_type",
) -> DataFrame:
    """Attributes of items published since a date, of the given types (bound parameters)."""
    cols = ", ".join(f"`{c}`" for c in columns)
    marks = ", ".join(f":type{i}" for i in range(len(ad_types)))
    return spark.sql(
        f"SELECT {cols} FROM {{items}} "
        f"WHERE `{published_col}` >= CAST(:since AS TIMESTAMP) AND `{type_col}` IN ({marks})",
        args={"since": published_after, **{f"type{i}": t for i, t in enumerate(ad_types)}},
        items=items,
    )


def parts_as_items(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_brand").alias("make"),
        F.col("p_type").alias("model"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
    )


def dashboard_csv(spark: SparkSession, path: str) -> DataFrame:
    """Dashboard log: header row, one sub-header row to drop, day as text, counts as text."""
    raw = spark.read.csv(path, header=True, schema=DASHBOARD_SCHEMA)
    day = F.try_to_timestamp("day", F.lit("yyyy-MM-dd"))
    return raw.where(day.isNotNull()).select(
        F.unix_timestamp(day).alias("ts"),
        "model",
        F.col("in_screen").cast("double").alias("in_screen"),
        F.col("clicks").cast("double").alias("clicks"),
    )


def save_split(df: DataFrame, path: str) -> None:
    """Write a table with a ``split`` column, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return out if split is None else out.where(F.col("split") == split)


def save_result(df: DataFrame, path: str) -> DataFrame:
    """Persist an experiment result and hand back the stored table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
