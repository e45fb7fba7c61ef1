"""Rows keep their ids, and filters their decisions, however later scans deal the rows."""

from contextlib import contextmanager

import pytest

from verifolio.llm import common, exact_dedup, mixing, simhash, toxicity


@contextmanager
def splits(spark, n):
    names = ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in zip(names, (str(n), "1024")):
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def files(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.read.parquet(f"{sf}/documents.parquet").repartition(3).write.mode("overwrite").parquet(path)
    return path


FILTERS = {
    "toxic": lambda docs, labels: toxicity.drop_toxic(docs, labels),
    "exact": lambda docs, labels: exact_dedup.drop_exact_copies(docs),
    "near": lambda docs, labels: simhash.drop_similar(docs),
    "mixed": lambda docs, labels: mixing.mixed(docs, labels),
}


@pytest.mark.parametrize("name", FILTERS)
def test_other_splits_between_decision_and_use(spark, sf, files, name):
    found = []
    for n in (8, 1):
        with splits(spark, 1):
            docs = spark.read.parquet(files)
            out = FILTERS[name](docs, spark.read.parquet(f"{sf}/labels.parquet"))
        with splits(spark, n):
            found.append(sorted(tuple(r) for r in out.select("doc_id", "text").collect()))
    assert found[0] == found[1] and found[0]


def test_ids_stay_with_their_rows(spark, files):
    with splits(spark, 1):
        rows = common.identified(spark.read.parquet(files))
        first = {r[common.UID]: r.doc_id for r in rows.collect()}
    with splits(spark, 8):
        assert {r[common.UID]: r.doc_id for r in rows.collect()} == first


def test_a_cluster_without_a_shared_folder_raises(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_clean_up(spark):
    left = common.stage(spark.range(3).toDF("k"), "left")
    common.clean_up(spark)
    assert not common._staged
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        left.collect()
