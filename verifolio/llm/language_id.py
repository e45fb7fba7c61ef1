"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter 1-, 2- and 3-grams, by rank.
A document is ranked the same way, and the out-of-place distance to a profile sums how
far each of its n-grams stands from its place there (a missing one counts the full list).
The language with the smallest distance wins; equal distances go to the smaller name.

Text is lower-cased; every run of characters that are not letters is one boundary mark,
also put at both ends. Counting for profiles covers all training rows: each Arrow batch
is counted with numpy, Spark adds the counts up and ranks them per language.

Score: (worst - best) / worst distance over the learned languages, between 0 and 1; with
a single language, one minus its relative distance. Defined results: null text, or text
without a letter, gives ``und`` with score 0; rows with null lang teach nothing; without
any training row every result is ``und``; more than ``MAX_LANGUAGES`` languages raise
``ValueError``, as profiles are held by every task; ties in n-gram counts go to the smaller n-gram;
other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import append_columns, crc_mod

PROFILE = 400
#: More languages than that are no languages; profiles of so many are 32 MB.
MAX_LANGUAGES = 10_000
UNDETERMINED = "und"
#: Places of a shorter n-gram that hold no character; above every code point.
_NONE = np.uint64(0x1FFFFF)
_FLUSH = 1 << 22


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray | None:
    """Sorted keys of all 1-, 2- and 3-grams, 21 bits a character; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    marked = np.zeros(len(points) + 2, np.uint64)
    marked[1:-1] = np.where(letter, points, 0)
    mark = marked == 0
    marked = marked[~(mark & np.concatenate(([False], mark[:-1])))]
    two = (marked[:-1] << np.uint64(21)) | marked[1:]
    three = (marked[:-2] << np.uint64(42)) | two[1:]
    one = marked[marked > 0] | (_NONE << np.uint64(42)) | (_NONE << np.uint64(21))
    keys = np.concatenate((one, two | (_NONE << np.uint64(42)), three))
    keys.sort()
    return keys


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and their counts."""
    starts = np.concatenate(([0], np.nonzero(keys[1:] != keys[:-1])[0] + 1))
    return keys[starts], np.diff(np.concatenate((starts, [len(keys)])))


def ranked(keys: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys, most frequent first, equal counts by key."""
    distinct, counts = _runs(keys)
    if len(distinct) > size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= floor
        distinct, counts = distinct[keep], counts[keep]
    return distinct[np.argsort(-counts, kind="stable")][:size]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows to (lang, gram, n), added up over what one task reads."""
    held: dict[str, list[np.ndarray]] = defaultdict(list)
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def fold(lang: str) -> None:
        keys, n = _runs(np.sort(np.concatenate(held.pop(lang))))
        if lang in sums:
            keys, back = np.unique(np.concatenate((sums[lang][0], keys)), return_inverse=True)
            n = np.bincount(back, np.concatenate((sums[lang][1], n))).astype(np.int64)
        sums[lang] = keys, n

    def rows():
        for lang in list(held):
            fold(lang)
        for lang, (keys, n) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
            )
        sums.clear()

    size: dict[str, int] = defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if (keys := grams(text)) is not None:
                held[lang].append(keys)
                size[lang] += len(keys)
                if size[lang] > _FLUSH:
                    fold(lang)
                    size[lang] = 0
        if len(sums) + len(held) > 256 or sum(len(k) for k, _ in sums.values()) > _FLUSH:
            yield from rows()
            size.clear()
    yield from rows()


def learn_profiles(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> dict[str, np.ndarray]:
    """Language to its ranked n-gram keys, at most ``size`` for each language."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col))
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    known = rows.select(F.col(lang_col)).distinct().limit(MAX_LANGUAGES + 1).count()
    if known > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has over {MAX_LANGUAGES} values")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for row in counts.withColumn("place", place).where(F.col("place") <= size).collect():
        found[row.lang].append((row.place, row.gram))
    return {k: np.array([g for _, g in sorted(v)], np.int64).view(np.uint64) for k, v in sorted(found.items())}


class RankOrder:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = list(profiles), size
        self.keys = np.unique(np.concatenate(list(profiles.values()))) if profiles else np.zeros(0, np.uint64)
        self.places = np.full((len(self.names), len(self.keys) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            self.places[i, np.searchsorted(self.keys, profiles[name])] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or (keys := grams(text)) is None:
            return UNDETERMINED, 0.0
        top = ranked(keys, self.size)
        at = np.searchsorted(self.keys, top)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != top)] = len(self.keys)
        places = self.places[:, at]
        off = np.where(places < 0, self.size, np.abs(places - np.arange(len(top))))
        distance = off.sum(1)
        best = int(distance.argmin())
        worst = int(distance.max()) if len(self.names) > 1 else self.size * len(top)
        return self.names[best], float((worst - distance[best]) / worst) if worst else 0.0


def predict_languages(docs: DataFrame, profiles: dict[str, np.ndarray], keep: dict[str, Column], text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """The columns named in ``keep``, then lang_pred and score, for every row."""
    def make():
        model = RankOrder(profiles, size)
        return lambda texts: list(zip(*map(model.predict, texts.to_pylist())))

    return append_columns(docs, keep, F.col(text_col), "lang_pred string, score double", make)


def language_id(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows that are not held out."""
    out = crc_mod("doc_id", modulus) == held
    profiles = learn_profiles(docs.where(~out))
    return predict_languages(docs, profiles, {"doc_id": F.col("doc_id"), "held_out": out})
