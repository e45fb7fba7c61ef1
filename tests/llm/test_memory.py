"""What operators hold in an executor beside their own work."""

import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from verifolio import session
from verifolio.llm import common, mixing, toxicity

_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_for_python_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    before = spark.conf.get(_BYTES, None)
    try:
        spark.conf.unset(_BYTES)
        session.ship(spark)
        longest = 5 << 20
        texts = spark.range(0, 3000, 1, 1).select(F.expr(f"repeat('x', if(id = 700, {longest}, 3000))").alias("text"))
        found = texts.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in found) == 3000
        big = [r for r in found if r.size > 2 * session.ARROW_BYTES]
        assert len(big) == 1 and big[0].size < longest + 2 * session.ARROW_BYTES
        spark.conf.set(_BYTES, "12345678")
        session.ship(spark)
        assert spark.conf.get(_BYTES) == "12345678"
    finally:
        spark.conf.unset(_BYTES)
        if before is not None:
            spark.conf.set(_BYTES, before)


@pytest.mark.parametrize("most", [256, 1])
def test_mixing_starts_no_other_python_workers(spark, odd, sf, monkeypatch, most):
    """Rows that the driver hands over as tuples are read by a second pool of workers."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    monkeypatch.setattr(mixing, "MAX_SOURCES", most)

    def refused(*_, **__):
        raise AssertionError("rows of the driver go through Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    found = mixing.fit_rates(odd, labels, source_weights={"s": 1.0, "other": 2.0}).collect()
    assert len(found) == odd.count() and {r.source for r in found} == {"s", None}


def test_table_of_the_driver(spark):
    given = common.as_table(spark, {"name": pa.array(["a", None], pa.string()), "s": pa.array([0, 1], pa.int32())})
    assert given.dtypes == [("name", "string"), ("s", "int")] and [tuple(r) for r in given.collect()] == [("a", 0), (None, 1)]
    assert common.as_table(spark, {"name": pa.array([], pa.string())}).count() == 0


def test_learning_lets_go_of_another_operators_cache():
    common.worker_cache("another")["model"] = object()
    assert list(toxicity._token_counts(iter([]))) == []
    assert "model" not in common._cache
