"""Structured Streaming over answers as they arrive: the per-page checks that need no
other row run unchanged on a stream; a deadline watermark bounds what a join waits for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import checks

ARRIVED = f"{schema.MODEL_PAGES}, source_text string, arrived timestamp"


def read_answers(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A stream of JSON-lines files of pages with their answer and source text."""
    return spark.readStream.schema(ARRIVED).option("maxFilesPerTrigger", per_trigger).json(path)


def page_measures(answers: DataFrame) -> DataFrame:
    """Per page, as it arrives: status, blocks, coverage and whether it is enough."""
    rows = answers.select(
        *schema.KEY,
        "arrived",
        "source_text",
        F.from_json("json", "struct<blocks: array<struct<kind: string, text: string, header: array<string>, rows: array<array<string>>>>>")["blocks"].alias("blocks"),
    )
    made = rows.withColumn("produced", F.when(F.col("blocks").isNotNull(), checks.produced_text(F.col("blocks"))))
    found = checks.coverage(made, "source_text", "produced")
    return found.select(
        *schema.KEY,
        "arrived",
        F.when(F.col("blocks").isNull(), "failed").otherwise("ok").alias("status"),
        F.coalesce(F.size("blocks"), F.lit(0)).alias("n_blocks"),
        F.when(F.col("blocks").isNotNull(), F.bround("coverage", 6)).alias("coverage"),
        F.when(F.col("blocks").isNotNull(), F.col("coverage") >= checks.COVERAGE).alias("enough"),
    )


def failures_by_window(measures: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Pages, failures and low coverage per window of arrival; late pages count up to ``late``."""
    kept = measures.withWatermark("arrived", late)
    return kept.groupBy(F.window("arrived", window).alias("w")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(~F.coalesce("enough", F.lit(True))).alias("low"),
    ).select(F.col("w.start").alias("start"), "pages", "failed", "low")
