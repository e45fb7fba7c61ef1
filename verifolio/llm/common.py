"""Helpers of the training-data operators: staged tables, row ids, Arrow access."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

UID = "__vf_uid"
_staged: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local session (tests)
    gets a temporary one; a cluster has no folder that all executors see, and raises."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="verifolio-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stage(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage is cut,
    and the rows survive the loss of any executor. ``codec`` is the session's, or the one given."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/verifolio/{uuid.uuid4().hex}-{label}"
    df.write.parquet(path, compression=codec)
    _staged[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._vf_path = path
    return out


def as_table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """The driver's columns as a table. Rows given as tuples would be read by Python workers of
    another kind than those of the operators: a second daemon, and a second worker for each core."""
    return spark.createDataFrame(pa.table(columns))


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_vf_path", None)
        if path and (spark := _staged.pop(path, None)) is not None:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes the shuffle files of an action when the action has ended, as
    nothing reads them again once its rows are staged; the session's setting comes back."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def staged_paths() -> set[str]:
    """Staged tables that are still there."""
    return set(_staged)


def drop_unread(paths: set[str], *readers: DataFrame) -> None:
    """Delete those staged tables that no reader reads."""
    read = "\n".join(f for df in readers for f in df.inputFiles())
    for path in paths:
        if path.rpartition("/")[2] not in read and (spark := _staged.pop(path, None)) is not None:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all() -> None:
    for path in list(_staged):
        try:
            spark = _staged.pop(path)
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended before the interpreter
            return


atexit.register(_drop_all)


def clean_up(spark: SparkSession) -> None:
    """Delete every staged table of this engine in the shared folder: those of the results
    that this session still holds, and those that a killed driver left behind."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/verifolio")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _staged.clear()


def with_uid(df: DataFrame) -> DataFrame:
    """Add a row id for what is staged next, in the one pass that also reads the ids.

    Another evaluation of df may deal its rows in another way and number them anew: what
    reads the rows again later needs ``identified``."""
    return df if UID in df.columns else df.withColumn(UID, F.monotonically_increasing_id())


def identified(df: DataFrame) -> DataFrame:
    """df staged with a row id beside each row, which every later scan finds there, whatever
    number of cores or splits it has. Rows that come from ``identified`` stay as they are."""
    if UID in df.columns and getattr(df, "_vf_path", None):
        return df
    return stage(with_uid(df), "rows")


#: Decisions on rows that are few enough are broadcast, so that whole rows stay in place.
#: A decision is two numbers at most, some 64 bytes in a hash table, so this is 64 MB.
BROADCAST_ROWS = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """df (narrow rows of numbers), to be broadcast if it was counted to have few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def decided(rows: DataFrame, decisions: DataFrame, how: str) -> DataFrame:
    """Rows (with __vf_uid, staged) joined with staged decisions (with __vf_k and what else
    is needed): the few by a broadcast, more by a shuffle."""
    return rows.join(few(decisions), F.col(UID) == F.col("__vf_k"), how)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def binaries(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bound what Python holds at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


_LIBC = ctypes.CDLL(None)
_cache: dict = {}
_cache_owner: str | None = None


def worker_cache(owner: str | None) -> dict:
    """What an operator keeps in a Python worker from task to task. A worker keeps one
    operator's things at a time, so that memory is bounded by the largest of them."""
    global _cache, _cache_owner
    if owner != _cache_owner:
        _cache, _cache_owner = {}, owner
        trim()
    return _cache


def trim() -> None:
    """Give memory that a Python worker no longer uses back to the system: workers outlive
    the operator that filled them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def append_columns(
    docs: DataFrame, keep: dict[str, Column], text: Column, columns: str, make: Callable[[], Callable[[pa.Array], list]], owner: str | None = None
) -> DataFrame:
    """The columns named in ``keep`` and those of the DDL in ``columns``, row by row.

    ``make`` runs once in each task and gives a function from an Arrow array of texts to
    the new columns, as sequences in the DDL's order. ``owner`` names the worker cache that
    it uses."""
    rows = docs.select(*(c.alias(k) for k, c in keep.items()), text.alias("__vf_text"))
    new = T._parse_datatype_string(columns)
    schema = T.StructType(rows.schema.fields[: len(keep)] + new.fields)
    names, kinds, n = schema.names, to_arrow_schema(new).types, len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(owner)
        of = make()
        for batch in sliced(batches):
            if batch.num_rows:
                made = [pa.array(x, k) for x, k in zip(of(batch.column(n)), kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *made], names)

    return rows.mapInArrow(run, schema)
