"""Toxicity scores from a learned lexicon, misspellings included, and the context of each hit.

Terms and term stems that occur in toxic texts and hardly elsewhere are learned from labelled rows.
They form a trie, which is intersected with Levenshtein automata: a state is the set of trie nodes
that a word's letters so far can stand for within the edits allowed, and states are built when first
met. A hit between quotation marks or near a verb of reporting counts as quoted. Counts of exact,
stem, misspelled and quoted hits and their density go into a logistic model fitted here.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, materialize, pick, place, tidied

WORD = re.compile(r"[^\W\d_]+|[\"“”„«»]")
MARKS = frozenset("\"“”„«»")
#: Verbs that report what somebody else said, in the languages of the corpus.
REPORTING = frozenset("said says wrote called quote quoted reported sagte schrieb nannte zitiert dit écrit appelé cité dijo escribió llamó citado".split())


@dataclass(frozen=True)
class Params:
    """fit_toxic, fit_other: most labelled rows of either kind that the lexicon and the model are
    fitted on. least_rows, least_odds: toxic rows a term must occur in, and its log odds. max_terms:
    most lexicon entries (the model's size). fuzzy_from: letters from which one edit is allowed.
    stem: letters of a stem. window: words around a hit that its context is read from. threshold:
    of the prediction."""

    fit_toxic: int = 10_000
    fit_other: int = 20_000
    least_rows: int = 6
    least_odds: float = 3.0
    max_terms: int = 20_000
    fuzzy_from: int = 5
    stem: tuple[int, int] = (4, 6)
    window: int = 8
    threshold: float = 0.3


class Lexicon:
    """The trie of terms and stems, run against words as a lazily built automaton."""

    def __init__(self, terms: list[str], stems: list[str], known: frozenset[str], fuzzy_from: int):
        self.fuzzy_from, self.known = fuzzy_from, known
        self.next: list[dict[str, int]] = [{}]
        self.term: list[int] = [0]  # length of the term that ends in the node
        self.stem: list[bool] = [False]
        self.fuzzy: list[bool] = [False]  # a term long enough for an edit goes on from here
        for text, is_stem in [*((t, False) for t in terms), *((s, True) for s in stems)]:
            at = 0
            for k, letter in enumerate([*text, ""]):
                if not is_stem and len(text) >= fuzzy_from:
                    self.fuzzy[at] = True
                if k < len(text):
                    if letter not in self.next[at]:
                        self.next[at][letter] = len(self.next)
                        self.next.append({})
                        self.term.append(0)
                        self.stem.append(False)
                        self.fuzzy.append(False)
                    at = self.next[at][letter]
            if is_stem:
                self.stem[at] = True
            else:
                self.term[at] = len(text)
        self._reset()

    def _reset(self) -> None:
        start = self._closed({(0, 0)})
        self.ids, self.states, self.moves, self.accept, self.stemmed = {start: 0}, [start], [{}], [self._value(start)], [False]

    def _closed(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With what is reached by leaving out a letter of the term."""
        more = {(n, 1) for node, edits in items if not edits for n in self.next[node].values() if self.fuzzy[n]}
        return frozenset(items | more)

    def _step(self, state: frozenset[tuple[int, int]], letter: str) -> frozenset[tuple[int, int]]:
        out = set()
        for node, edits in state:
            if (n := self.next[node].get(letter)) is not None and (not edits or self.fuzzy[n]):
                out.add((n, edits))
            if not edits and self.fuzzy[node]:
                out.add((node, 1))  # the word has a letter more
                out.update((n, 1) for n in self.next[node].values() if self.fuzzy[n])  # another letter
        return self._closed(out)

    def _value(self, state: frozenset[tuple[int, int]]) -> int:
        """1: a term. 3: a term within an edit. Stems are flags of their own, seen on the way."""
        if any(self.term[n] and not e for n, e in state):
            return 1
        return 3 if any(self.term[n] >= self.fuzzy_from and e for n, e in state) else 0

    def kind(self, word: str) -> int:
        """0: no hit, 1: a term, 2: it starts with a stem, 3: a misspelled term."""
        if len(self.states) > 10_000:
            self._reset()
        state, stem = 0, False
        for letter in word:
            moves = self.moves[state]
            to = moves.get(letter)
            if to is None:
                items = self._step(self.states[state], letter)
                to = self.ids.get(items)
                if to is None:
                    to = self.ids[items] = len(self.states)
                    self.states.append(items)
                    self.moves.append({})
                    self.accept.append(self._value(items))
                    self.stemmed.append(any(self.stem[n] and not e for n, e in items))
                moves[letter] = to
            state = to
            stem = stem or self.stemmed[state]
            if not self.states[state]:
                break
        value = self.accept[state]
        if value == 1 or stem:
            return 1 if value == 1 else 2
        return 3 if value == 3 and word not in self.known else 0


class Scorer:
    """Features of texts, given a lexicon; remembers words' kinds in bounded tables."""

    def __init__(self, lexicon: Lexicon, p: Params, limit: int = 300_000):
        self.lexicon, self.p, self.limit = lexicon, p, limit
        self.clean: set[str] = set()
        self.hits: dict[str, int] = {}

    def features(self, text: str | None) -> list[float]:
        words = WORD.findall((text or "").lower())
        distinct = {*words}
        if len(self.clean) + len(self.hits) > self.limit:
            self.clean.clear()
            self.hits.clear()
        new = distinct - self.clean
        found = False
        for w in new:
            kind = self.hits.get(w)
            if kind is None:
                kind = self.lexicon.kind(w)
                if kind:
                    self.hits[w] = kind
                else:
                    self.clean.add(w)
            found = found or kind > 0
        count = [0.0] * 4
        if found:
            marks = [k for k, w in enumerate(words) if w in MARKS]
            reports = [k for k, w in enumerate(words) if w in REPORTING]
            for k, w in enumerate(words):
                if kind := self.hits.get(w, 0) if w in new else 0:
                    count[0 if self._quoted(k, marks, reports) else kind] += 1
        return [math.log1p(c) for c in (count[1], count[2], count[3], count[0])] + [min(1.0, 20 * (count[1] + count[2] + count[3]) / (len(words) + 20)), float(count[1] + count[2] > 0)]

    def _quoted(self, at: int, marks: list[int], reports: list[int]) -> bool:
        """By the nearest marks and verbs alone, found by bisection, so that long texts take little."""
        near, k = self.p.window, bisect_left(marks, at)
        if k % 2 and marks[k - 1] >= at - near and k < len(marks) and marks[k] <= at + near:
            return True
        r, reach = bisect_left(reports, at), near // 2
        return r < len(reports) and reports[r] - at <= reach or r > 0 and at - reports[r - 1] <= reach


@dataclass(frozen=True)
class Model:
    terms: list[str]
    stems: list[str]
    known: frozenset[str]
    weights: np.ndarray
    p: Params

    def scorer(self) -> Scorer:
        return Scorer(Lexicon(self.terms, self.stems, self.known, self.p.fuzzy_from), self.p)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[1:] + self.weights[0], -40, 40)))


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights, the constant first, by Newton's method with an L2 penalty."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _term_counts(rows: DataFrame, p: Params) -> DataFrame:
    """Toxic and other rows that each word and stem occurs in; counted within a task first."""
    low, high = p.stem

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            terms = sorted({*counts[0], *counts[1]})
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (counts[1], counts[0]))], names=["term", "n_toxic", "n_other"])
            counts[0].clear(), counts[1].clear()
            return out

        for batch in batches(stream, 500):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in WORD.findall((text or "").lower()) if w not in MARKS}
                stems = {w[:n] + "*" for w in words for n in range(low, min(high, len(w)) + 1)}
                counts[1 if toxic else 0].update(words | stems)
            if len(counts[0]) + len(counts[1]) > 100_000:
                yield flush()
        yield flush()

    found = rows.select("text", "toxic").mapInArrow(tidied(run), "term string, n_toxic long, n_other long")
    return found.groupBy("term").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_other").alias("n_other"))


def _features(docs: DataFrame, model: Model, extra: tuple[str, ...]) -> DataFrame:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches(stream, 2000):
            x = np.asarray([scorer.features(t) for t in batch.column(0).to_pylist()]).reshape(batch.num_rows, 6)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), *batch.columns[1:]], names=["features", *extra])

    kinds = dict(docs.dtypes)
    return docs.select("text", *extra).mapInArrow(tidied(run), ", ".join(["features array<double>", *(f"{c} {kinds[c]}" for c in extra)]))


def fit(docs: DataFrame, labels: DataFrame, p: Params | None = None) -> Model:
    """Learn lexicon and model from a bounded, fixed sample of labelled rows that aren't held out.

    Labels that are null, or of no document, teach nothing; of rows that repeat an id the least text
    does. Columns that only differ by case from those used, and others, are ignored. Without any toxic label the lexicon is
    empty and every score is the share of toxic rows among the labelled, 0 if there are none.
    """
    p = p or Params()
    given = pick(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    given = given.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = given.where("toxic = 1").orderBy(*order).limit(p.fit_toxic).union(given.where("toxic <> 1").orderBy(*order).limit(p.fit_other))
    chosen, _ = materialize(chosen, "chosen")  # at most fit_toxic + fit_other ids
    texts = pick(docs, "doc_id", "text")
    # of rows that repeat an id one counts, so that the sample is bounded in rows
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample, _ = materialize(sample.select("text", "toxic"), "sample")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = n.get(1, 0), sum(v for k, v in n.items() if k != 1)

    counts, _ = materialize(_term_counts(sample, p), "terms")
    odds = F.log((F.col("n_toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("n_other") + 0.5) / (other + 1.0))
    strong = counts.where(F.col("n_toxic") >= p.least_rows).withColumn("odds", odds).where(F.col("odds") >= p.least_odds)
    entries = [r["term"] for r in strong.orderBy(F.desc("odds"), "term").limit(p.max_terms).collect()]
    terms, stems = [t for t in entries if t[-1] != "*"], [t[:-1] for t in entries if t[-1] == "*"]

    def alike(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms, stems, frozenset(), p.fuzzy_from)
        for batch in stream:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if lexicon.kind(w) == 3], pa.string())], names=["term"])

    # words of other rows that look like a misspelling; they are near a lexicon of bounded size
    usual = counts.where("n_other > 0 and term not like '%*'").select("term").mapInArrow(tidied(alike), "term string")
    model = Model(terms, stems, frozenset(r["term"] for r in usual.collect()), np.zeros(7), p)
    if not toxic or not other:
        share = toxic / (toxic + other) if toxic + other else 0.0
        constant = math.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share else -40.0)
        return Model(terms, stems, model.known, np.asarray([constant] + [0.0] * 6), p)
    rows = _features(sample, model, ("toxic",)).collect()  # at most fit_toxic + fit_other rows
    x, y = np.asarray([r["features"] for r in rows]), np.asarray([float(r["toxic"] == 1) for r in rows])
    return Model(terms, stems, model.known, _fit_logistic(x, y), p)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null text is scored as an empty one.

    Repeated rows are scored alike, a null id stays null and is not held out, other columns are ignored,
    and an empty table gives an empty one.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches(stream, 2000):
            x = np.asarray([scorer.features(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = pick(docs, "doc_id", "text").mapInArrow(tidied(run), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= model.p.threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs``, with all their columns, that the model doesn't reject.

    A null text is judged as an empty one, repeated rows alike; an empty table stays empty. Of columns
    whose names differ by case the one named ``text`` is read.
    """
    at = place(docs.columns, "text")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches(stream, 2000):
            x = np.asarray([scorer.features(t) for t in batch.column(at).to_pylist()]).reshape(batch.num_rows, 6)
            yield batch.filter(pa.array(model.score(x) < model.p.threshold))

    return docs.mapInArrow(tidied(run), docs.schema)
