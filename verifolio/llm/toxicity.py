"""Toxicity scoring with Levenshtein automata over a learned lexicon trie.

Learning (from a bounded sample of labelled rows, see ``MAX_FIT_ROWS``): token document
counts per class give a lexicon of terms that mark toxic documents; the terms form a trie.
The Levenshtein automata of all terms are intersected with the trie and determinised step
by step, so that one pass over a token's characters tells every term within the edit
bound. A form found this way is weighed by its own class counts, with the pooled counts
of variants that a lexicon had not seen as its prior: a common harmless word one letter
away from a term gets a negative weight, an unseen misspelling the pooled one.

Scoring: every hit is read in a window of tokens. A hit between quotation marks (paired
over the whole text), or near a reporting verb or a word about words, counts as quotation and is discounted; hits that
stand close together or address someone raise each other. A document's hits become five
features (strongest and summed evidence, unquoted and quoted, and density), and a logistic
model maps them to a score. Its training features come from the half of the sample that
did not teach the lexicon, halves being split by text so that copies stay together.

Defined results: null and empty text have no hit and get the model's base score; ids,
languages, sources and labels are never read by the score; labels other than 0 and 1, and
null ones, teach nothing; of several labels of one id the largest counts; a sample without
both classes gives score 0 for all; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, crc_mod, drop_staged, stage, worker_cache

#: Labelled rows used for fitting: those with the smallest hash of their id.
MAX_FIT_ROWS = 20_000
MAX_EDITS = 1
#: Shorter terms must match exactly.
FUZZY_LENGTH = 5
WINDOW = 6
THRESHOLD = 0.7
_TOKENS_HELD = 250_000
_STATES_HELD = 100_000
_STRIP = "\"'`.,;:!?()[]{}<>|#$%&*+-=/\\_~«»“”„‘’‹›…"
_OPEN, _CLOSE = "\"“„«‹", "\"”“»›"
_MARKS = frozenset(_OPEN + _CLOSE)
#: What may stand outside a quotation mark.
_OUTSIDE = "'`.,;:!?()[]{}*_-…"
#: Words that report speech or speak about words, in English, French, German and Spanish.
_REPORTS = frozenset(
    "said says wrote writes quote quoted quotes called term word cited dit écrit cite citation mot sagte schrieb zitat zitiert wort dijo escribió cita palabra".split()
)
#: Words that address someone, in the same languages.
_ADDRESS = frozenset("you your you're u tu te toi vous du dich dir sie ihr tú usted vosotros eres".split())


class TermAutomaton:
    """All terms within ``edits`` of a token, by the determinised product of trie and automata.

    A state is a set of (trie node, edits so far); only the fewest edits of a node are kept.
    Transitions are made when first taken and kept up to a bound."""

    def __init__(self, terms: list[str], edits: int = MAX_EDITS, fuzzy_length: int = FUZZY_LENGTH):
        self.edits, self.fuzzy_length = edits, fuzzy_length
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.fuzzy: list[bool] = [False]  # some term below may differ
        for term in terms:
            node = 0
            for char in term:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.fuzzy.append(False)
                self.fuzzy[node] |= len(term) >= fuzzy_length
                node = self.children[node][char]
            self.fuzzy[node] |= len(term) >= fuzzy_length
            self.term[node] = term
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {frozenset(): 0}
        self.states: list[dict[int, int]] = [{}]
        self.steps: list[dict[str, int]] = [{}]
        self.start = self._id(self._closed({0: 0}))

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """Adds the nodes reached by leaving characters of the term out."""
        todo = list(state.items())
        while todo:
            node, used = todo.pop()
            if used >= self.edits or state.get(node, used) < used:
                continue
            for child in self.children[node].values():
                if self.fuzzy[child] and state.get(child, self.edits + 1) > used + 1:
                    state[child] = used + 1
                    todo.append((child, used + 1))
        return state

    def _id(self, state: dict[int, int]) -> int:
        key = frozenset(state.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return self.ids[key]

    def _step(self, at: int, char: str) -> int:
        made: dict[int, int] = {}

        def put(node: int, used: int) -> None:
            if made.get(node, self.edits + 1) > used:
                made[node] = used

        for node, used in self.states[at].items():
            for c, child in self.children[node].items():
                if c == char:
                    put(child, used)
                elif used < self.edits and self.fuzzy[child]:
                    put(child, used + 1)
            if used < self.edits and self.fuzzy[node]:
                put(node, used + 1)
        self.steps[at][char] = to = self._id(self._closed(made))
        return to

    def match(self, token: str) -> list[tuple[str, int]]:
        """(term, edits) of every term within reach, by edits and then term."""
        if len(self.states) > _STATES_HELD:
            self._reset()
        at = self.start
        for char in token:
            to = self.steps[at].get(char)
            at = self._step(at, char) if to is None else to
            if not at:
                return []
        found = ((self.term[node], used) for node, used in self.states[at].items())
        return sorted(((t, e) for t, e in found if t is not None and (e == 0 or len(t) >= self.fuzzy_length)), key=lambda x: (x[1], x[0]))


def form(token: str) -> str:
    return token.strip(_STRIP)


def quotations(tokens: list[str]) -> list[tuple[int, int]]:
    """First and last token of every quotation, in order. Marks are paired over the whole
    text, however far apart; a mark without a partner opens nothing."""
    out, begun = [], None
    for i, token in enumerate(tokens):
        if _MARKS.isdisjoint(token):
            continue
        head, tail = token.lstrip(_OUTSIDE)[:1], token.rstrip(_OUTSIDE)[-1:]
        opens, closes = head != "" and head in _OPEN, tail != "" and tail in _CLOSE
        if begun is None:
            if opens and closes and len(token.strip(_OUTSIDE)) > 1:
                out.append((i, i))
            elif opens:
                begun = i
        elif closes:
            out.append((begun, i))
            begun = None
        elif opens and head in _CLOSE:
            # a mark of one shape at the front of a word: what was open had no partner
            begun = i
    return out


@dataclass
class Lexicon:
    """Terms, the weights of known forms, and the weight of an unseen variant."""

    terms: list[str]
    weights: dict[str, float]
    unseen: float
    coefficients: list[float] = field(default_factory=list)
    usable: bool = True

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def weight(self, raw: str) -> float:
        """Evidence of a raw token; 0 for one that no term reaches."""
        memo = self.__dict__.setdefault("_memo", {})
        if raw in memo:
            return memo[raw]
        if "_automaton" not in self.__dict__:
            self._automaton = TermAutomaton(self.terms)
        token = form(raw)
        value = self.weights.get(token)
        if value is None:
            value = self.unseen if token and self._automaton.match(token) else 0.0
        memo[raw] = value = max(value, 0.0)
        return value

    def features(self, text: str) -> tuple[float, float, float, float, float]:
        """Strongest and summed unquoted evidence, the same quoted, and the hits' density."""
        memo = self.__dict__.setdefault("_memo", {})
        if len(memo) > _TOKENS_HELD:
            memo.clear()
        tokens = text.lower().split()
        get = memo.get
        hits = [(i, w) for i, t in enumerate(tokens) if (w := get(t, -1.0)) and (w > 0 or (w := self.weight(t)) > 0)]
        if not hits:
            return (0.0,) * 5
        best, total = [0.0, 0.0], [0.0, 0.0]
        places = [i for i, _ in hits]
        spans = quotations(tokens)
        for k, (i, weight) in enumerate(hits):
            quoted, factor = self._context(tokens, i, spans)
            close = sum(0 < abs(places[j] - i) <= WINDOW for j in (k - 1, k + 1) if 0 <= j < len(places))
            value = weight * factor * (1 + 0.1 * close)
            best[quoted] = max(best[quoted], value)
            total[quoted] += value
        return best[0], math.log1p(total[0]), best[1], math.log1p(total[1]), math.log1p(100 * len(hits) / len(tokens))

    @staticmethod
    def _context(tokens: list[str], i: int, spans: list[tuple[int, int]]) -> tuple[bool, float]:
        """Whether the hit at i is quotation, and what its window makes of its weight."""
        at = bisect_right(spans, (i, len(tokens))) - 1
        if at >= 0 and spans[at][1] >= i:
            return True, 0.3
        words = {form(t) for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1]}
        if words & _REPORTS:
            return True, 0.6
        return False, 1.15 if words & _ADDRESS else 1.0

    def score(self, text: str | None) -> float:
        if not self.usable:
            return 0.0
        z = self.coefficients[0] + sum(a * b for a, b in zip(self.coefficients[1:], self.features(text or "")))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, toxic, text) rows to documents per form: clean and toxic, in either fold."""
    worker_cache(None)
    counts: dict[str, list[int]] = {}

    def flush():
        forms = list(counts)
        out = [pa.array(forms, pa.string())] + [pa.array([counts[f][k] for f in forms], pa.int64()) for k in range(4)]
        counts.clear()
        return pa.RecordBatch.from_arrays(out, ["form", "c0", "t0", "c1", "t1"])

    for batch in batches:
        for fold, toxic, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for token in {form(t) for t in (text or "").lower().split()}:
                counts.setdefault(token, [0, 0, 0, 0])[2 * fold + toxic] += 1
        if len(counts) > _TOKENS_HELD:
            yield flush()
    if counts:
        yield flush()


def _select_terms(counts: DataFrame, toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> list[str]:
    """The terms whose documents are toxic far beyond chance, strongest first. Each stands in
    four documents of the bounded sample or more, which bounds their number."""
    rate = n_toxic / (n_toxic + n_clean)
    surprise = toxic * F.log(toxic / ((toxic + clean) * rate)) + F.when(clean > 0, clean * F.log(clean / ((toxic + clean) * (1 - rate)))).otherwise(0.0)
    ratio = ((toxic + 0.5) / (n_toxic + 1)) / ((clean + 0.5) / (n_clean + 1))
    found = counts.where((toxic >= 4) & (F.length("form") >= 3) & (ratio >= 12) & (2 * surprise >= 16)).select("form", surprise.alias("s"))
    return [r.form for r in found.orderBy(F.desc("s"), "form").collect()]


def _lexicon(terms: list[str], forms: dict[str, tuple[int, int]], share: float, n_toxic: int, n_clean: int) -> Lexicon:
    def weight(toxic: float, clean: float) -> float:
        return math.log((toxic + share) / n_toxic) - math.log((clean + 1 - share) / n_clean)

    return Lexicon(terms, {f: weight(t, c) for f, (t, c) in forms.items()}, weight(0, 0))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> list[float]:
    """Newton's method with a ridge on all but the constant; the ridge keeps coefficients
    of features without variation at 0."""
    design = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.diag([1e-6] + [penalty] * x.shape[1])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -60, 60)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_FIT_ROWS) -> Lexicon:
    """Lexicon and logistic model from the labelled rows of docs.

    The sample, at most ``max_rows`` ids, is the only thing that is broadcast."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y"))
    picked = known.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("text")).join(F.broadcast(picked), "k")
    # one text of an id, so that repeated ids leave the sample as small as it was asked for
    rows = rows.groupBy("k").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    sample = stage(rows.select(F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"), "y", "text"), "toxic-sample")
    size = {(r.fold, r.y): r["count"] for r in sample.groupBy("fold", "y").count().collect()}
    n = [[size.get((f, y), 0) for y in (0, 1)] for f in (0, 1)]
    if not all(a + b for a, b in zip(*n)):
        drop_staged(sample)
        return Lexicon([], {}, 0.0, usable=False)
    sums = [F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")]
    counts = stage(sample.mapInArrow(_token_counts, "form string, c0 long, t0 long, c1 long, t1 long").groupBy("form").agg(*sums), "toxic-forms")
    c0, t0, c1, t1 = (F.col(c) for c in ("c0", "t0", "c1", "t1"))
    whole = (n[0][1] + n[1][1], n[0][0] + n[1][0])
    both = _select_terms(counts, t0 + t1, c0 + c1, *whole)
    halves = [_select_terms(counts, t, c, max(n[f][1], 1), max(n[f][0], 1)) for f, (t, c) in enumerate(((t0, c0), (t1, c1)))]
    terms = sorted({*both, *halves[0], *halves[1]})

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(None)
        automaton = TermAutomaton(terms)
        for batch in batches:
            yield batch.filter(pa.array([bool(x) and bool(automaton.match(x)) for x in batch.column(0).to_pylist()], pa.bool_()))

    forms = {r.form: (r.c0, r.t0, r.c1, r.t1) for r in counts.mapInArrow(reached, counts.schema).collect()}
    # how often variants that one half's lexicon had not seen stand in toxic documents of the other half
    fresh = [0.5, 0.5]
    for f in (0, 1):
        automaton, o = TermAutomaton(halves[f]), 1 - f
        for token, c in forms.items():
            if not c[2 * f] and not c[2 * f + 1] and (c[2 * o] or c[2 * o + 1]) and automaton.match(token):
                fresh[0] += c[2 * o] / max(n[o][0], 1)
                fresh[1] += c[2 * o + 1] / max(n[o][1], 1)
    unit = 0.5 / min(max(n[0][1], 1), max(n[1][1], 1))
    share = (fresh[1] - 0.5 + unit) / (fresh[0] - 0.5 + fresh[1] - 0.5 + 2 * unit)
    model = _lexicon(both, {f: (c[1] + c[3], c[0] + c[2]) for f, c in forms.items()}, share, *whole)
    crossed = [
        _lexicon(halves[f], {t: (c[2 * f + 1], c[2 * f]) for t, c in forms.items() if c[2 * f] or c[2 * f + 1]}, share, max(n[f][1], 1), max(n[f][0], 1))
        for f in (0, 1)
    ]
    for lexicon in (model, *crossed):
        automaton = TermAutomaton(lexicon.terms)
        lexicon.weights = {t: w for t, w in lexicon.weights.items() if automaton.match(t)}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(None)
        for batch in batches:
            fold, y, text = (batch.column(i).to_pylist() for i in range(3))
            found = [crossed[1 - f].features(t or "") for f, t in zip(fold, text)]
            columns = [pa.array(y, pa.int32())] + [pa.array(c, pa.float64()) for c in (zip(*found) if found else [()] * 5)]
            yield pa.RecordBatch.from_arrays(columns, ["y", *(f"f{i}" for i in range(5))])

    seen = np.array(sample.mapInArrow(featured, "y int, f0 double, f1 double, f2 double, f3 double, f4 double").collect(), float)
    model.coefficients = _logistic(seen[:, 1:], seen[:, 0])
    drop_staged(sample, counts)
    return model


def score_documents(docs: DataFrame, model: Lexicon, keep: dict[str, Column], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns named in ``keep``, then score and predicted, for every row."""
    def make():
        def of(texts: pa.Array) -> list:
            score = [model.score(x) for x in texts.to_pylist()]
            return [score, [int(s >= threshold) for s in score]]

        return of

    return append_columns(docs, keep, F.col(text_col), "score double, predicted int", make)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from labels of rows that are not held out."""
    model = fit(docs, labels.where(crc_mod("doc_id", modulus) != held))
    return score_documents(docs, model, {"doc_id": F.col("doc_id"), "held_out": crc_mod("doc_id", modulus) == held})


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold.

    A deployed filter learns from every label it has; rows are judged by their text only,
    and each passes or goes in the one scan that scores it."""
    keep = {f"__vf_{i}": docs[c] for i, c in enumerate(docs.columns)}
    scored = score_documents(docs, fit(docs, labels), keep, text_col)
    return scored.where("predicted = 0").select(*(F.col(f"__vf_{i}").alias(c) for i, c in enumerate(docs.columns)))
