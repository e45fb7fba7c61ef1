"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Machines are compiled from a model as states and arcs, and composed lazily with each input:

* the normaliser (``Rewriter``): the model's character map, or rules that are given, as a trie
  whose final states emit their replacement (leftmost, longest), an arc that copies any other
  character, and two states that tell blanks after a blank, where extra ones are removed; then
  the dummy prefix, and U+2581 for blanks;
* the pieces (``PieceMachine``): the pieces' trie; a final state gives the piece and returns;
* byte fallback: an arc for a character without a piece, which gives its bytes' ids (or
  ``<unk>``);
* for BPE models, the pair acceptor: its states are pieces, and the arc from one to the next
  weighs 0 if merging the text of both gives that very pair, else infinity. Arcs are made when
  they are first taken.

The result is the shortest path through the composition in the tropical semiring: states are
relaxed from a queue until the final one has its least weight. For a unigram model a piece
weighs minus its score, a state is a place, and places leave the queue in order. For a BPE
model a state is a place with the last piece. A sequence whose neighbours are all allowed is
the merge result of the whole text, and there is only one, so the one path of finite weight is
what merging gives. Finite weights are all 0, the least there is: the queue is last in, first
out, longest piece first, and ends at the first final state.

Where no piece holds U+2581 after another character, no merge crosses a blank, so the machine
is in its start state there and each word is composed by itself; the same goes for line ends
that no piece holds. Paths of words seen before are looked up, up to a bound in bytes.

Defined results: null and empty text give no pieces; decoding gives the normalised text
back exactly, the text itself unless it holds U+2581 or the model rewrites; ids that are not
text pieces, or no ids of the model, decode to nothing. Models with user-defined pieces, or
with blanks behind words, raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, worker_cache

BLANK = "▁"
#: Bytes of looked-up words (twice: older and newer ones), and pairs, that a worker holds.
_WORD_BYTES = 24 << 20
_WORD_COST = 200
_PAIRS_HELD = 200_000
#: Beyond the worst score of a model, as the library weighs unknown characters.
_UNKNOWN = 10.0


def model_path() -> str:
    """Where the public tokenizers' SentencePiece model is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def character_map(compiled: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double array of 32-bit units, whose leaves
    give places in a list of replacements."""
    size = int.from_bytes(compiled[:4], "little")
    units = np.frombuffer(compiled[4 : 4 + size], np.uint32).astype(np.int64)
    texts = compiled[4 + size :]
    labels = units & 0x800000FF
    bytes_ = np.arange(1, 256)

    def offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)

    rules: dict[str, str] = {}
    todo = [(offset(int(units[0])), b"")]
    while todo:
        at, key = todo.pop()
        near = at ^ bytes_
        near = np.where(near < len(units), near, 0)
        for byte in bytes_[labels[near] == bytes_].tolist():
            unit = int(units[at ^ byte])
            below = at ^ byte ^ offset(unit)
            if unit >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                rules[(key + bytes((byte,))).decode()] = texts[start : texts.index(b"\0", start)].decode()
            todo.append((below, key + bytes((byte,))))
    return rules


class Trie:
    """States by character arcs; ``final`` has what a state accepts, or None."""

    def __init__(self, entries):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list = [None]
        for text, value in entries:
            state = 0
            for char in text:
                state = self._child(state, char)
            self.final[state] = value

    def _child(self, state: int, char: str) -> int:
        to = self.arcs[state].get(char)
        if to is None:
            to = self.arcs[state][char] = len(self.arcs)
            self.arcs.append({})
            self.final.append(None)
        return to


class Rewriter:
    """The normaliser: rewriting rules, then blanks."""

    def __init__(self, rules: dict[str, str], prefix: bool, extra: bool, escape: bool):
        self.trie, self.prefix, self.extra, self.escape = Trie(rules.items()), prefix, extra, escape
        self.copies = not rules

    def rewritten(self, text: str) -> str:
        """The path of the rules' transducer; its default arc copies a character."""
        if self.copies:
            return text
        arcs, final, out, at, n = self.trie.arcs, self.trie.final, [], 0, len(text)
        while at < n:
            state, to, end, made = 0, at, at + 1, text[at]
            while to < n and (state := arcs[state].get(text[to], 0)):
                to += 1
                if final[state] is not None:
                    end, made = to, final[state]
            out.append(made)
            at = end
        return "".join(out)

    def __call__(self, text: str) -> str:
        text = self.rewritten(text)
        if self.extra:
            # one state after a blank (or at the start) drops blanks, the other keeps one
            text = " ".join(x for x in text.split(" ") if x)
        if text and self.prefix:
            text = " " + text
        return text.replace(" ", BLANK) if self.escape else text


class PieceMachine:
    """Pieces with byte fallback, and the shortest path of a text through them.

    A piece is numbered by its id plus 1, another character behind all ids, the start by 0."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], size: int, unigram: bool):
        self.scores, self.unigram, self.behind = scores, unigram, size + 1
        self.trie = Trie((piece, i + 1) for piece, i in ids.items())
        self.text = {i + 1: piece for piece, i in ids.items()}
        self.worst = min(scores.values(), default=0.0) - _UNKNOWN
        self.pairs: dict[int, bool] = {}

    def arcs(self, text: str, at: int) -> list[tuple[int, int]]:
        """(place reached, piece) of the arcs from a place, shortest first; the character
        itself where no piece is as short."""
        steps, final, found, state, to = self.trie.arcs, self.trie.final, [], 0, at
        for char in text[at:]:
            state = steps[state].get(char)
            if state is None:
                break
            to += 1
            if (piece := final[state]) is not None:
                found.append((to, piece))
        if not found or found[0][0] > at + 1:
            found.insert(0, (at + 1, self.behind + ord(text[at])))
        return found

    def spelled(self, piece: int) -> str:
        return self.text[piece] if piece < self.behind else chr(piece - self.behind)

    def merged(self, text: str) -> list[str]:
        """Merging by best score, leftmost first; used on a pair of pieces."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def allowed(self, last: int, piece: int) -> bool:
        """Makes the pair acceptor's arc: whether it weighs 0."""
        if len(self.pairs) > _PAIRS_HELD:
            self.pairs.clear()
        right = self.spelled(piece)
        left = self.spelled(last) if last else ""
        found = self.pairs[last << 22 | piece] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def shortest(self, text: str) -> list[int]:
        """The pieces on the path of least weight."""
        return self._by_places(text) if self.unigram else self._by_pairs(text)

    def _by_pairs(self, text: str) -> list[int]:
        """States (place, last piece), last in, first out; weights are 0 or infinite."""
        n, pairs, arcs, path = len(text), self.pairs.get, self.arcs, []
        queue = [(0, 0, arcs(text, 0))]
        done: set[tuple[int, int]] = set()
        while queue:
            at, last, left = queue[-1]
            while left:
                to, piece = left.pop()
                weightless = pairs(last << 22 | piece)
                if weightless is None:
                    weightless = self.allowed(last, piece)
                if weightless and (not done or (to, piece) not in done):
                    path.append(piece)
                    if to == n:
                        return path
                    queue.append((to, piece, arcs(text, to)))
                    break
            else:
                # no path of finite weight leads on from here
                queue.pop()
                done.add((at, last))
                if path:
                    path.pop()
        raise AssertionError("merging always has a result")

    def _by_places(self, text: str) -> list[int]:
        """States are places, which leave the queue in order; weights are minus the scores."""
        n = len(text)
        cost, back = [0.0] + [float("inf")] * n, [(0, 0)] * (n + 1)
        for at in range(n):
            for to, piece in self.arcs(text, at):
                weight = cost[at] - (self.scores[self.text[piece]] if piece < self.behind else self.worst)
                if weight < cost[to]:
                    cost[to], back[to] = weight, (at, piece)
        path, at = [], n
        while at:
            at, piece = back[at]
            path.append(piece)
        return path[::-1]


class PieceTransducer:
    """The composition, with what it emits and the way back."""

    def __init__(self, model: bytes, rules: dict[str, str] | None = None):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        kinds, spec = proto.SentencePiece, proto.normalizer_spec
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("blanks behind words are not supported")
        if rules is None and spec.precompiled_charsmap:
            rules = character_map(spec.precompiled_charsmap)
        self.prefix = spec.add_dummy_prefix
        self.normalise = Rewriter(rules or {}, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        scores = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.machine = PieceMachine(scores, ids, len(proto.pieces), proto.trainer_spec.model_type == proto.trainer_spec.UNIGRAM)
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.bytes_of = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.surface = [b""] * len(proto.pieces)
        for piece, i in ids.items():
            self.surface[i] = piece.replace(BLANK, " ").encode()
        for value, i in self.bytes_of.items():
            self.surface[i] = bytes((value,))
        self.surface[self.unknown] = proto.trainer_spec.unk_surface.encode()
        inner = any(BLANK in piece.lstrip(BLANK) for piece in ids) or not spec.escape_whitespaces
        line = any("\n" in piece for piece in ids)
        self.words = re.compile("(?s).+" if inner else f"{BLANK}*[^{BLANK}]+|{BLANK}+" if line else f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _emit(self, path: list[int]) -> list[int]:
        out: list[int] = []
        behind = self.machine.behind
        for piece in path:
            if piece < behind:
                out.append(piece - 1)
            elif self.bytes_of:
                out.extend(self.bytes_of[b] for b in chr(piece - behind).encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _word(self, word: str) -> bytes:
        """The ids of a word, four bytes each."""
        found = self.older.get(word)
        if found is None:
            found = np.array(self._emit(self.machine.shortest(word)), np.int32).tobytes()
        cost = _WORD_COST + 5 * len(word)
        if cost < _WORD_BYTES >> 6:
            self.known[word] = found
            self.held += cost
        return found

    def encode_array(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if self.held > _WORD_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
        known, make = self.known.get, self._word
        return np.frombuffer(b"".join([known(w) or make(w) for w in self.words.findall(self.normalise(text))]), np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_array(text).tolist()

    def decode(self, ids: list[int]) -> str:
        n = len(self.surface)
        return self.spelled([i for i in ids if 0 <= i < n])

    def spelled(self, ids: list[int]) -> str:
        """The text of ids that are all ids of the model."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _loaded(path: str | None) -> bytes:
    with open(path or model_path(), "rb") as file:
        return file.read()


def _transducer(model: bytes, rules: tuple | None) -> PieceTransducer:
    """Compiled once a worker, with its caches."""
    cache = worker_cache(__name__)
    key = (hashlib.sha256(model).digest(), rules)
    if key not in cache:
        cache.clear()
        cache[key] = PieceTransducer(model, None if rules is None else dict(rules))
    return cache[key]


def encode_documents(docs: DataFrame, keep: dict[str, Column], text_col: str = "text", path: str | None = None, rules: dict[str, str] | None = None) -> DataFrame:
    """The columns named in ``keep``, then ids, n_pieces, decoded_sha256, and whether
    decoding gives the text back. The driver reads the model, each worker compiles it once."""
    raw, fixed = _loaded(path), None if rules is None else tuple(sorted(rules.items()))
    PieceTransducer(raw, rules)  # what it can't support fails here

    def make():
        model = _transducer(raw, fixed)

        def of(texts: pa.Array) -> list:
            values = [x or "" for x in texts.to_pylist()]
            ids = [model.encode_array(x) for x in values]
            decoded = [model.spelled(x.tolist()) for x in ids]
            sizes = list(map(len, ids))
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            return [lists, sizes, [hashlib.sha256(x.encode()).hexdigest() for x in decoded], [a == b for a, b in zip(decoded, values)]]

        return of

    return append_columns(docs, keep, F.col(text_col), "ids array<int>, n_pieces long, decoded_sha256 string, exact boolean", make, __name__)


def decode_documents(rows: DataFrame, keep: dict[str, Column], ids_col: str = "ids", path: str | None = None, rules: dict[str, str] | None = None) -> DataFrame:
    """The columns named in ``keep``, then the text that each list of ids decodes to."""
    raw, fixed = _loaded(path), None if rules is None else tuple(sorted(rules.items()))

    def make():
        model = _transducer(raw, fixed)
        return lambda ids: [[model.decode(x or []) for x in ids.to_pylist()]]

    return append_columns(rows, keep, F.col(ids_col), "text string", make, __name__)


def sentencepiece(docs: DataFrame) -> DataFrame:
    """doc_id, ids, n_pieces, decoded_sha256, exact for every row of docs."""
    return encode_documents(docs, {"doc_id": F.col("doc_id")})
