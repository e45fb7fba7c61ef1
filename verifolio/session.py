"""Session and table helpers shared by queries, tests and the bench."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session with the settings the engine is tested with."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("verifolio")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows, and bytes, that Spark hands to Python at once, where the session has Spark's default.
#: Rows alone bound nothing where texts are long; a batch ends with the row that passes the bytes.
ARROW_ROWS = 2048
ARROW_BYTES = 1 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, as one archive for the whole application, where they
    are not in the driver's own process; and bounds the texts that a worker holds at once,
    where the session has Spark's default for that (a setting of its own stays)."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = Path(__file__).resolve().parent
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        archive = Path(tempfile.mkdtemp(prefix="verifolio-")).resolve() / "verifolio.zip"
        archive.write_bytes(out.getvalue())
        context.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; only Spark's reader touches the path."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """In a local session, a scan that fills less than the cores, dealt out over them: a small
    file is one split. On a cluster a scan stays as its splits are, and nothing is shuffled."""
    context = df.sparkSession.sparkContext
    if not context.master.startswith("local["):
        return df
    return df.repartition(context.defaultParallelism) if df.rdd.getNumPartitions() < context.defaultParallelism else df
