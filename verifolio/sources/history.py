"""The history of benchmark runs: JSON in, change against the run before, append out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUNS = (
    "label string, when string, dpi int, page int, processor string, wall_s double, load_s double, prompt_tokens int, prompt_s double, "
    "prompt_tps double, out_tokens int, gen_s double, gen_tps double, blocks int, tables int, table_rows int"
)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of JSON lines, or of files that are one array."""
    return spark.read.schema(RUNS).option("multiLine", "true").json(path)


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def rate(amount: Column, seconds: Column) -> Column:
    """Per second; 0 where no time passed."""
    return F.when(F.coalesce(seconds, F.lit(0.0)) == 0, 0.0).otherwise(amount / seconds)


def processor(status: Column, model: Column) -> Column:
    """From a process listing: the share that is on a processor, and its name, of the
    model's line; else unknown."""
    line = F.get(F.filter(F.split(status, "\n"), lambda x: F.contains(x, model)), F.lit(0))
    found = F.regexp_extract(line, r"(\S*%\S*\s+\S+)", 1)
    return F.when(F.length(found) > 0, F.regexp_replace(found, r"\s+", " ")).otherwise("unknown")


def deltas(runs: DataFrame, order: str, measures: list[str], by: list[str]) -> DataFrame:
    """Adds to each run the percent change of its measures against the run before it of the
    same series (``by``); null for the first, and where the value before is 0 or null."""
    before = Window.partitionBy(*by).orderBy(order)
    change = {}
    for m in measures:
        last = F.lag(m).over(before)
        change[f"{m}_pct"] = F.when(F.coalesce(last, F.lit(0)) != 0, (F.col(m) - last) / last * 100)
    return runs.withColumns(change)


def changed_content(runs: DataFrame, order: str, by: list[str], content: str = "blocks") -> DataFrame:
    """Adds warning: a run whose content differs from the run before it, as a gain in time that
    loses content is none; null where nothing changed, and for the first."""
    last = F.lag(content).over(Window.partitionBy(*by).orderBy(order))
    said = F.concat(F.lit(f"{content} changed from "), last.cast("string"), F.lit(" to "), F.col(content).cast("string"))
    return runs.withColumn("warning", F.when(last != F.col(content), said))
