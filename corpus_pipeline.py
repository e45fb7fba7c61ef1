"""The corpus pipeline: toxicity filter, exact dedup, near-dedup, source mix, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and
returns a DataFrame, which ``run`` writes as Parquet and reads back as the next stage's
documents. A stage that begins deletes what the stages before it had staged, unless its
documents read it: by then they are written. All but the last return the columns of documents.
Nulls, empty texts, ties,
repeated rows, empty tables and extra columns give what the operators' docstrings say.

The stages cannot be put in SQL (learned models, near copies, sub-word pieces), so
``ORACLE_SQL`` is None and tests compare each stage with a brute-force version.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verifolio.llm import exact_dedup, mixing, piece_transducer, simhash, toxicity
from verifolio.llm.common import drop_staged, drop_unread, stage, staged_paths
from verifolio.session import ship, table


_left: set[str] = set()


def _tidy(step):
    """The stage, after what earlier ones left behind has gone."""

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_unread(_left, docs)
        before = staged_paths()
        out = step(spark, docs, sf_dir)
        _left.intersection_update(before)
        _left.update(staged_paths() - before)
        return out

    return run


@_tidy
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    ship(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@_tidy
def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest id."""
    ship(spark)
    return exact_dedup.drop_exact_copies(docs)


@_tidy
def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash candidates, then a Jaccard similarity
    of five-word shingles of 0.8 or more): the one with the smallest id."""
    ship(spark)
    return simhash.drop_similar(docs)


@_tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources and quality classes asks."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


@_tidy
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the pieces' ids, and whether they decode to the text."""
    ship(spark)
    keep = {"doc_id": F.col("doc_id"), "lang": F.col("lang"), "source": F.col("source")}
    return piece_transducer.encode_documents(docs, keep)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact),
    ("SimHash near-dedup", drop_near),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        last = docs
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
            drop_staged(last)
    return docs
