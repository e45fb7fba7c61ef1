"""Language-model scoring with a weighted backoff automaton over all n-grams.

Tokens are words of the lower-cased (A-Z) text between the characters
``[\\x20\\x09-\\x0D]``, then one end. A state of the automaton is a context that training
texts hold: up to ``order - 1`` words, or the beginning of a text and what follows it. From
a state of n words an arc leads on for each word seen there; its weight is log10 of

    P(w | context) = (c(context w) + prior * P(w | shorter context)) / (c(context) + prior)

and the failure arc, log10 of prior / (c(context) + prior), leads to the state without the
first word (a hierarchical Dirichlet model; ``priors`` has one for contexts of one word, of
two words and so on). The root has the words by absolute discounting, and the discounted
mass is the unknown class. So every state is a distribution over all words, end and the
unknown class, and all weights follow from counts of n-grams. A text is scored in one
traversal from left to right that carries the state.

No n-gram is left out: the automaton is as large as the corpus makes it, so no task holds it
whole. Texts are dealt into blocks of ``BLOCK`` bytes, staged with their texts packed, so
that Spark handles one short row a block and only workers hold texts. A block lists
its distinct n-grams as sorted keys with its own training counts; keys are dealt by
range to buckets, each of which adds up the counts of a range and answers every block
that asked, in the order of its keys. A block then has all arcs that its texts can take.
The counts of one n-gram come added up from each block, so a frequent one makes no bucket
large, and buckets grow in number with the input's bytes. Only the totals reach the driver.

A 62-bit hash stands for a word; of a billion distinct words 0.1 pairs are expected to share
one, and would share their counts. Hashes of longer n-grams have 20 bits more than the
logarithm of the input's bytes, so that one in a million shares its counts at any size.

Defined results: null and empty texts are the end alone; without training rows base and
model score are those of an empty count table (log10 of 1/(0+1*(0+1)) = 0 a token);
repeated ids keep their rows; a null training mark counts as false; other columns are
ignored. A text of any length is one block at least; it is split into words in pieces.
Sorting and arcs work on a part of a block at a time, which bounds what a worker holds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binaries, crc_mod, shuffles_freed, sliced, stage, trim, worker_cache

ORDER = 3
#: Prior strength of contexts of one word, of two words.
PRIORS = (100.0, 30.0)
#: Bytes of text in a block and behind a bucket, and words whose hashes a worker holds.
BLOCK = 6 << 20
BUCKET = 8 << 20
HELD_WORDS = 100_000
_PIECE = 1 << 20
_STRIDE = 1 << 14
#: Keys that are sorted at a time, and tokens whose arcs are held at a time.
_SORTED = 1 << 20
_STRETCH = 1 << 16
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_TAG = np.uint64(3)  # the lowest bits of a key hold the order; 0 is the beginning
_BEGIN = np.uint64(0x9E3779B97F4A7C14)
_END = b""


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word) & ~3 | 1
        return value


def _hashes() -> _Hashes:
    return worker_cache(__name__).setdefault("hashes", _Hashes())


def _words(text: bytes, hashes: _Hashes) -> list[np.ndarray]:
    """Keys of the text's words, taken in pieces that end between words, and of the end."""
    out, at = [], 0
    while at < len(text):
        gap = _GAP.search(text, at + _PIECE)
        stop = gap.start() if gap else len(text)
        found = text[at:stop].lower().split()
        out.append(np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)))
        at = stop
    out.append(np.array([hashes[_END]], np.uint64))
    return out


def _longer(context: np.ndarray, word: np.ndarray, order: int) -> np.ndarray:
    """Keys of n-grams from those of their context and their last word."""
    x = context ^ (word * np.uint64(0xC2B2AE3D27D4EB4F))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(32)
    return x & ~_TAG | np.uint64(order)


@dataclass
class _Grams:
    """The n-grams of a block: its distinct keys, sorted, and for each order the places of
    the n-grams that end at each token, -1 where a text has too few tokens before it.
    Tokens of all texts stand in one row, each text after a mark of its beginning."""

    keys: np.ndarray
    starts: np.ndarray  # of each text's mark; then the end of the row
    places: list[np.ndarray]

    def stretches(self) -> Iterator[_Grams]:
        """Its texts in turn, as many at a time as have ``_STRETCH`` tokens, one at least."""
        first = 0
        while first + 1 < len(self.starts):
            at = self.starts[first]
            last = max(int(np.searchsorted(self.starts, at + _STRETCH, "right")) - 1, first + 1)
            yield _Grams(self.keys, self.starts[first : last + 1] - at, [p[at : self.starts[last]] for p in self.places])
            first = last


def _distinct(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the place of each key, by ranges: sorting all at once
    would take several times the keys' memory."""
    n = min(len(flat) // _SORTED + 1, 16)
    if n == 1:
        distinct, inverse = np.unique(flat, return_inverse=True)
        return distinct, inverse.astype(np.int32)
    low, high = int(flat.min()), int(flat.max())
    edges = [np.uint64(low + (high - low) * k // n) for k in range(n)]
    inverse, found, size = np.empty(len(flat), np.int32), [], 0
    for k, edge in enumerate(edges):
        inside = flat >= edge
        if k + 1 < n:
            inside &= flat < edges[k + 1]
        distinct, place = np.unique(flat[inside], return_inverse=True)
        inverse[inside] = place + size
        found.append(distinct)
        size += len(distinct)
    return np.concatenate(found), inverse


def _grams(texts: list[bytes], order: int, width: int = 62) -> _Grams:
    hashes = _hashes()
    parts: list[np.ndarray] = []
    starts = [0]
    for text in texts:
        found = _words(text, hashes)
        parts.append(np.array([_BEGIN]))
        parts.extend(found)
        starts.append(starts[-1] + 1 + sum(map(len, found)))
    row = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    del parts
    bounds = np.array(starts, np.int64)
    there = [np.ones(len(row), bool)]
    for _ in range(2, order + 1):
        whole = np.zeros(len(row), bool)
        # a mark ends no longer n-gram, and one before the mark has no text
        whole[1:] = there[-1][:-1]
        whole[bounds[:-1]] = False
        there.append(whole)
    cut = ~np.uint64((1 << 64 - width) - 1) | _TAG
    sizes = np.cumsum([0, *(int(t.sum()) for t in there)]).tolist()
    flat = np.empty(sizes[-1], np.uint64)
    flat[: sizes[1]] = last = row
    for k in range(1, order):
        longer = np.zeros(len(row), np.uint64)
        longer[1:] = _longer(last[:-1], row[1:], k + 1)
        flat[sizes[k] : sizes[k + 1]] = longer[there[k]]
        flat[sizes[k] : sizes[k + 1]] &= cut
        last = longer
    row = last = longer = None
    distinct, inverse = _distinct(flat)
    del flat
    places = []
    for k, t in enumerate(there):
        place = np.full(len(t), -1, np.int32)
        place[t] = inverse[sizes[k] : sizes[k + 1]]
        places.append(place)
    return _Grams(distinct, bounds, places)


def _own_counts(grams: _Grams, training: list[bool]) -> np.ndarray:
    """How often each n-gram stands in the block's training texts."""
    counts = np.zeros(len(grams.keys), np.int64)
    mark = np.repeat(np.array(training, bool), np.diff(grams.starts))
    for place in grams.places:
        counts += np.bincount(place[mark & (place >= 0)], minlength=len(counts))
    return counts


@lru_cache(1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def _pack(counts: np.ndarray) -> bytes:
    """A byte for each count; those of 255 and more follow in full."""
    packed = np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()
    return _zstd()[0].compress(packed)


def _unpack(packed: bytes, size: int) -> np.ndarray:
    packed = _zstd()[1].decompress(packed)
    counts = np.frombuffer(packed, np.uint8, size).astype(np.int64)
    counts[counts == 255] = np.frombuffer(packed, "<i8", offset=size)
    return counts


def _pack_keys(keys: np.ndarray) -> bytes:
    """Gaps between sorted keys, the first byte of all, the second byte of all and so on:
    the upper bytes are few and shrink."""
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return _zstd()[0].compress(np.ascontiguousarray(planes).tobytes())


def _unpack_keys(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(_zstd()[1].decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


_TEXTS = "block long, texts binary"


def _pack_texts(rows: pa.Table) -> bytes:
    """Rows (id, training, text) as a compressed Arrow stream."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
        stream.write_table(rows)
    return out.getvalue().to_pybytes()


def _unpack_texts(packed: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(packed.as_buffer()).read_all()


def _dealer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deals a task's texts into blocks, one row each, so that no later scan splits one; a
    block ends before its texts exceed its bytes."""
    block, size = TaskContext.get().partitionId() << 32, 0
    held: list[pa.RecordBatch] = []

    def row():
        packed = _pack_texts(pa.Table.from_batches(held).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed], pa.binary())], ["block", "texts"])

    for batch in sliced(batches):
        first = 0
        for i, length in enumerate(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()):
            if size and size + length > BLOCK:
                if i > first:
                    held.append(batch.slice(first, i - first))
                yield row()
                held.clear()
                first, size, block = i, 0, block + 1
            # an empty text takes up room as well
            size += length + 1
        if batch.num_rows > first:
            held.append(batch.slice(first))
    if held:
        yield row()


_ASKED = "block long, bucket int, keys binary, counts binary"


def _asker(bits: int, order: int, width: int):
    """For a block's texts a row for each bucket that holds n-grams of the block, with their
    keys and training counts."""

    def ask(block: int, texts: pa.Table) -> pa.RecordBatch:
        trim()
        grams = _grams(binaries(texts.column("text")), order, width)
        counts = _own_counts(grams, texts.column("training").to_pylist())
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        cuts = [*np.searchsorted(grams.keys, edges).tolist(), len(grams.keys)]
        spans = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        made = [
            pa.array([block] * len(spans), pa.int64()),
            pa.array([k for k, _, _ in spans], pa.int32()),
            pa.array([_pack_keys(grams.keys[a:b]) for _, a, b in spans], pa.binary()),
            pa.array([_pack(counts[a:b]) for _, a, b in spans], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(made, [x.split()[0] for x in _ASKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(__name__)
        for batch in batches:
            for block, texts in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield ask(block, _unpack_texts(texts))

    return run


_ANSWERS = "block long, bucket int, size long, counts binary, n long, v long, once long, twice long"


def _answer(asked: pa.Table) -> pa.Table:
    """Adds up the counts of a bucket's n-grams over all blocks, and answers each of them;
    a row without block has the bucket's totals of words."""
    trim()
    keys = list(map(_unpack_keys, asked.column("keys").to_pylist()))
    cuts = np.cumsum([0, *map(len, keys)]).tolist()
    counts = np.concatenate([_unpack(x, len(k)) for x, k in zip(asked.column("counts").to_pylist(), keys)])
    distinct, inverse = _distinct(flat := np.concatenate(keys))
    del keys, flat
    # whole numbers up to 2**53 are exact in bincount's weights
    sums = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
    words = sums[distinct & _TAG == 1]
    packed = [_pack(sums[inverse[a:b]]) for a, b in zip(cuts, cuts[1:])]
    zero, totals = [0] * len(packed), [int(words.sum()), int((words > 0).sum()), int((words == 1).sum()), int((words == 2).sum())]
    bucket = asked.column("bucket").to_pylist()
    columns = [[*asked.column("block").to_pylist(), None], [*bucket, bucket[0]], [*np.diff(cuts).tolist(), 0], [*packed, None], *([*zero, t] for t in totals)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
    return pa.table([pa.array(x, k) for x, k in zip(columns, kinds)], [x.split()[0] for x in _ANSWERS.split(", ")])


@dataclass
class Totals:
    """Training tokens, distinct ones, and the discount of the root's arcs."""

    n: int
    v: int
    discount: float

    @classmethod
    def of(cls, n: int, v: int, once: int, twice: int) -> Totals:
        """The discount is n1 / (n1 + 2 n2), the usual estimate; a half where there is none."""
        return cls(n, v, min(max(once / (once + 2 * twice), 0.1), 0.9) if once and twice else 0.5)


@dataclass
class Arcs:
    """For each token of a block, by the number of words k of a state: the weight of the
    arc that takes the token (nan: there is none) and of the failure arc (nan: no such
    state), and the words of the state after it, which are fewer than the order."""

    arc: list[np.ndarray]
    fail: list[np.ndarray]
    after: np.ndarray

    def traverse(self, start: int, stop: int) -> float:
        """Log10 weight of the path over the tokens from ``start`` up to ``stop``."""
        total, state = 0.0, int(self.after[start - 1])
        rows = zip(*(x[start:stop].tolist() for x in (*self.arc, *self.fail, self.after)))
        orders = len(self.arc)
        for row in rows:
            while (weight := row[state]) != weight:  # no arc here
                total += row[orders + state]
                state -= 1
            total += weight
            state = row[-1]
        return total


def _arcs(grams: _Grams, counts: np.ndarray, totals: Totals, priors: tuple[float, ...]) -> Arcs:
    """The arcs that a block's tokens can take, from the counts of its n-grams."""
    seen = [np.where(place >= 0, counts[place], 0) for place in grams.places]
    n = max(totals.n, 1)
    unknown = totals.discount * totals.v / n if totals.n else 1.0
    lower = np.where(seen[0] > 0, np.maximum(seen[0] - totals.discount, 1e-300) / n, unknown)
    arc, fail = [np.log10(lower)], [np.full(len(lower), np.nan)]
    after = np.where(seen[0] > 0, 1, 0) if len(seen) > 1 else np.zeros(len(lower), np.int64)
    for k, prior in zip(range(1, len(seen)), priors):
        # c(context): the n-gram of k words that ends before the token
        context = np.concatenate([[0], seen[k - 1][:-1]])
        share = (seen[k] + prior * lower) / (context + prior)
        arc.append(np.where(seen[k] > 0, np.log10(share), np.nan))
        fail.append(np.where(context > 0, np.log10(prior / (context + prior)), np.nan))
        lower = np.where(context > 0, share, lower)
        if k + 1 < len(seen):
            after = np.where(seen[k] > 0, k + 1, after)
    return Arcs(arc, fail, after)


def _scorer(totals: Totals, order: int, width: int, priors: tuple[float, ...]):
    size = totals.n + totals.v + 1

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        worker_cache(__name__)
        trim()
        texts = _unpack_texts(texts.column("texts")[0])
        grams = _grams(binaries(texts.column("text")), order, width)
        own = texts.select(["id", "training"])
        del texts
        # buckets are ranges of keys, so that answers by bucket follow the sorted keys
        given = sorted(zip(*(answers.column(x).to_pylist() for x in ("bucket", "size", "counts"))))
        counts = np.concatenate([_unpack(packed, n) for _, n, packed in given])
        if len(counts) != len(grams.keys):
            raise ValueError("a block's answers do not match its n-grams")
        del given
        columns: list[list] = [[], [], [], []]
        for part in grams.stretches():
            arcs = _arcs(part, counts, totals, priors)
            words = counts[part.places[0]]
            base = np.log10((words + 1) / size)
            for a, b in zip((part.starts[:-1] + 1).tolist(), part.starts[1:].tolist()):
                score = sum(arcs.traverse(i, min(i + _STRIDE, b)) for i in range(a, b, _STRIDE))
                for column, value in zip(columns, (b - a, int((words[a:b] > 0).sum()), float(base[a:b].sum()), score)):
                    column.append(value)
        made = [pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        return pa.table([*own.columns, *made], ["id", "training", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, priors: tuple[float, ...] = PRIORS) -> DataFrame:
    """id, training, n_tokens, n_known, train_tokens, base_score, score of every row, under
    the model of the rows marked as training. ``order`` is 1, 2 or 3."""
    if not 1 <= order <= 3 or len(priors) < order - 1 or min(priors, default=1) <= 0:
        raise ValueError("order must be 1, 2 or 3, with a positive prior for each order above 1")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(training, F.lit(False)).alias("training"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(math.ceil(math.log2(max(size / BUCKET, 1))), 4), 30)
    width = min(max(math.ceil(math.log2(max(size, 1))) + 20, 40), 62)
    texts = stage(rows.mapInArrow(_dealer, _TEXTS), "lm-texts", "none")
    asked = texts.mapInArrow(_asker(bits, order, width), _ASKED)
    with shuffles_freed(docs.sparkSession):
        answers = stage(asked.groupBy("bucket").applyInArrow(_answer, _ANSWERS), "lm-answers")
    sums = answers.where("block is null").agg(*(F.sum(x) for x in ("n", "v", "once", "twice"))).first()
    totals = Totals.of(*(x or 0 for x in sums))
    answers = answers.where("block is not null").select("block", "bucket", "size", "counts")
    found = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scorer(totals, order, width, tuple(priors)), "id long, training boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return found.select("id", "training", "n_tokens", "n_known", F.lit(totals.n).cast("long").alias("train_tokens"), "base_score", "score")


def lm_scores(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    found = score(docs, crc_mod("doc_id", modulus) != held)
    return found.select(F.col("id").alias("doc_id"), (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
