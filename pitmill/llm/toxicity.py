"""Toxicity by a learned lexicon, matched with spelling errors, and scored by the words around each match.

The lexicon is learned from labelled rows: words, and beginnings of words, that
occur in toxic documents far more than chance and others allow. It is held as a
trie. A word is run through the intersection of that trie with the Levenshtein
automata of its terms: a state is the set of trie nodes within reach and the
errors spent on each, and states are made deterministic as words ask for them,
so that a word costs one table lookup a character. Terms of 5 letters allow one
error, of 9 two; a beginning allows one from 6 letters on.

Each match is weighted by its window: inside quotation marks, which one pass over
the whole text pairs line by line, or next to words of reporting it counts as
quoted, next to words of address as aimed at someone.
A logistic model over the sums of both kinds, fitted on at most ``TRAIN_ROWS``
labelled rows, gives the score; every document is scored on its whole text.

A null or empty text has no match. Without labels of both kinds every score is
the share of toxic labels, or 0.5. A score equal to the threshold is toxic. Repeated rows give repeated results. Other
columns of the input are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .labelled import held_out, training_rows

#: So many labelled rows at most are learned from, which bounds the lexicon: each of its terms is in ``MIN_DOCS`` of them.
TRAIN_ROWS = 20_000
MIN_EVIDENCE, MIN_ODDS, MIN_DOCS, MAX_NEAR = 18.0, 20.0, 6, 0.0005
STEMS = range(4, 9)
WINDOW = 6
THRESHOLD = 0.5
WORD = re.compile(r"\w+")
#: Words of reporting and of address around a match, in English, German, French and Spanish. Fixed values.
REPORTING = frozenset("""said says say wrote writes called calls quote quoted quotes word words term termed insult slur alleged reported
sagte sagt schrieb schreibt nannte nennt zitat zitiert wort beleidigung angeblich berichtet
dit disait écrit écrivait appelle appelait citation cite mot terme insulte injure rapporté
dijo dice escribió escribe llamó llama cita citó palabra término insulto presuntamente""".split())
ADDRESS = frozenset("""you your yours yourself u ur he she they him her them are is
du dich dir dein deine ihr euch euer sie bist seid er ihn
tu toi ton vous votre il elle êtes es
tú usted ustedes eres ti él ella""".split())
#: What closes an opening mark of quotation. Fixed values.
CLOSING = {'"': '"', "“": "”", "„": "“”", "”": "”", "«": "»", "»": "«", "‘": "’"}
MARK = re.compile("[\"“”„«»‘’\n]")


@dataclass
class Lexicon:
    """A trie of terms, and its intersection with their Levenshtein automata, built as words need it."""

    #: Whole words map to True, beginnings of words to False.
    terms: dict[str, bool]
    #: Terms without tolerance, as their near forms are common in documents that are not toxic.
    strict: frozenset[str] = frozenset()
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    word: list[str | None] = field(default_factory=lambda: [None])
    stem: list[str | None] = field(default_factory=lambda: [None])
    budget: list[int] = field(default_factory=lambda: [0])
    known: dict[str, tuple[str, int] | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for term, whole in sorted(self.terms.items()):
            node, allowed = 0, self._allowed(term, whole)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.budget.append(0)
                self.budget[node] = max(self.budget[node], allowed)
                node = self.children[node][c]
            self.budget[node] = max(self.budget[node], allowed)
            (self.word if whole else self.stem)[node] = term
        self._reset()

    def _allowed(self, term: str, whole: bool) -> int:
        return 0 if term in self.strict else errors_allowed(term, whole)

    def _reset(self) -> None:
        self.states: list[dict[int, int]] = []
        self.number: dict[tuple, int] = {}
        self.next: list[dict[str, int]] = []
        self.ends: list[tuple[str, int] | None] = []
        self.begins: list[tuple[str, int] | None] = []
        self.first = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes.items())
        while todo:  # terms may have letters that the word lacks
            node, e = todo.pop()
            if e < self.budget[node]:
                for child in self.children[node].values():
                    if nodes.get(child, 9) > e + 1:
                        nodes[child] = e + 1
                        todo.append((child, e + 1))
        key = tuple(sorted(nodes.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(nodes)
            self.next.append({})
            self.ends.append(self._accepted(nodes, self.word, True))
            self.begins.append(self._accepted(nodes, self.stem, False))
        return self.number[key]

    def _accepted(self, nodes: dict[int, int], at: list[str | None], whole: bool) -> tuple[str, int] | None:
        found = [(e, at[n]) for n, e in nodes.items() if at[n] is not None and e <= self._allowed(at[n], whole)]
        return min(found)[::-1] if found else None

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.states[state].items():
            child = self.children[node].get(c)
            if child is not None and out.get(child, 9) > e:
                out[child] = e
            if e < self.budget[node]:
                for other in (node, *self.children[node].values()):
                    if out.get(other, 9) > e + 1:
                        out[other] = e + 1
        out = {n: e for n, e in out.items() if e <= self.budget[n]}
        self.next[state][c] = found = self._state(out) if out else -1
        return found

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, errors) of the closest term, or None."""
        state, best = self.first, None
        for c in word:
            state = self.next[state].get(c, -2)
            if state == -2:
                return self._slow(word)
            if state < 0:
                return best
            hit = self.begins[state]
            if hit and (best is None or hit[1] < best[1]):
                best = hit
        hit = self.ends[state]
        return hit if hit and (best is None or hit[1] <= best[1]) else best

    def _slow(self, word: str) -> tuple[str, int] | None:
        if len(self.states) > 50_000:
            self._reset()
        state = self.first
        for c in word:
            following = self.next[state].get(c, -2)
            state = self._step(state, c) if following == -2 else following
            if state < 0:
                break
        return self.match(word)

    def find(self, word: str) -> tuple[str, int] | None:
        got = self.known.get(word, 0)
        if got == 0:
            if len(self.known) > 300_000:
                self.known.clear()
            got = self.known[word] = self.match(word)
        return got


def errors_allowed(term: str, whole: bool) -> int:
    if not whole:
        return int(len(term) >= 6)
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


FEATURES = 7


def quotations(text: str) -> tuple[list[int], list[int]]:
    """Places of a text from which on it is in so many open quotations; a line break ends all of them.

    An apostrophe closes a quotation that its counterpart has opened and nothing else.
    """
    places, depths, stack = [-1], [0], []
    for m in MARK.finditer(text):
        c = m.group()
        if c == "\n":
            stack.clear()
        elif stack and c in CLOSING[stack[-1]]:
            stack.pop()
        elif c in CLOSING:
            stack.append(c)
        places.append(m.start())
        depths.append(len(stack))
    return places, depths


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Sums over the matches of a text: exact ones that are plain, aimed or quoted, misspelled ones that are plain or quoted, the number of terms, and their share of the words."""
    if not text:
        return [0.0] * FEATURES
    low = text.lower()
    words = WORD.findall(low)
    hits = [(k, got) for k, w in enumerate(words) if (got := lexicon.find(w))]
    if not hits:
        return [0.0] * FEATURES
    wanted = {k for k, _ in hits}
    places = {k: m.start() for k, m in enumerate(WORD.finditer(low)) if k in wanted}
    marks, depths = quotations(low)
    out = [0.0] * FEATURES
    for k, (_, errors) in hits:
        inside = depths[bisect_right(marks, places[k]) - 1] > 0
        around = words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]
        quoted = inside or any(w in REPORTING for w in around)
        if errors:
            out[4 if quoted else 2] += 1
            continue
        out[3 if quoted else 0] += 1
        if not quoted and any(w in ADDRESS for w in around):
            out[1] += 1
    out[5] = float(len({term for _, (term, errors) in hits if not errors}))
    return [float(np.log1p(x)) for x in out[:6]] + [float(np.log1p(100 * sum(not e for _, (_, e) in hits) / len(words)))]


def candidates(text: str | None) -> set[str]:
    """Words (ending in ``$``) and beginnings of words of a text."""
    words = set(WORD.findall((text or "").lower()))
    return {w + "$" for w in words if len(w) >= 3} | {w[:n] for w in words for n in STEMS if len(w) > n}


def learn_lexicon(rows: DataFrame, min_evidence: float = MIN_EVIDENCE, min_odds: float = MIN_ODDS) -> Lexicon:
    """From (doc_id, text, label): candidates are counted by label, and those with enough evidence go to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                seen: Counter[str] = Counter()
                for text in part.column(0):
                    seen.update(candidates(text.as_py()))
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    def counts(label: int) -> DataFrame:
        return rows.where(F.col("label") == label).select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({})
    found = staged(counts(1).where(F.col("n") >= MIN_DOCS), "candidates")
    # of a beginning's documents, how many the most frequent word with it explains
    explained = found.where("endswith(term, '$')").select(F.explode(F.array(*(F.when(F.length("term") > k, F.substring("term", 1, k)) for k in STEMS))).alias("term"), "n").groupBy("term").agg(F.max("n").alias("explained"))
    n, m, share = F.col("n"), F.col("m"), toxic / (toxic + clean)
    odds = (n + 0.5) / (toxic + 1) / ((m + 0.5) / (clean + 1))
    p = n / (n + m)
    evidence = n * F.log(p / share) + F.when(m > 0, m * F.log((1 - p) / (1 - share))).otherwise(0.0)
    both = found.join(counts(0).withColumnRenamed("n", "m"), "term", "left").withColumn("m", F.coalesce("m", F.lit(0))).withColumn("evidence", evidence)
    kept = both.where((F.col("evidence") >= min_evidence) & (odds >= min_odds)).join(explained, "term", "left")
    terms = choose([(r.term, r.n, r.m, r.evidence, r.explained or 0) for r in kept.collect()])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(terms)
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch.column(0):
                seen.update({got[0] for w in set(WORD.findall((text.as_py() or "").lower())) if (got := own.find(w)) and got[1]})
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    common = rows.where(F.col("label") == 0).select("text").mapInArrow(near, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return Lexicon(terms, frozenset(r.term for r in common if r.n > max(1, MAX_NEAR * clean)))


def choose(scored: list[tuple[str, int, int, float, int]]) -> dict[str, bool]:
    """Terms from (term, toxic documents, others, evidence, documents that one word explains).

    A beginning replaces the words that it covers, unless one word explains most of it.
    """
    found = {term: n for term, n, *_ in scored}
    kept: list[str] = []
    stems: set[str] = set()
    for term, n, _, _, explained in sorted(scored, key=lambda x: (x[2] > 0, -x[3], -len(x[0]), x[0])):
        bare = term.rstrip("$")
        if any(bare[:k] in stems for k in STEMS):
            continue
        if term.endswith("$"):
            kept.append(term)
        elif explained < 0.6 * n and not any(k.startswith(term) and found[k] >= 0.9 * n for k in stems):
            kept.append(term)
            stems.add(term)
    return {t.rstrip("$"): t.endswith("$") for t in kept if not any(t.rstrip("$")[:k] in stems and t != t.rstrip("$")[:k] for k in STEMS)}


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 0.1, rounds: int = 60) -> np.ndarray:
    """Weights, the bias last, by Newton's method."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y) or not x.any():
        clipped = min(max(share, 1e-3), 1 - 1e-3)
        return np.append(np.zeros(x.shape[1]), np.log(clipped / (1 - clipped)))
    z = np.column_stack([x, np.ones(len(x))])
    theta = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        hessian = (z.T * (p * (1 - p))) @ z + decay * np.eye(z.shape[1])
        theta = theta - np.clip(np.linalg.solve(hessian, z.T @ (p - y) + decay * theta), -2, 2)
    return theta


def with_features(docs: DataFrame, lexicon: Lexicon, columns: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shared.value
            found = [features(t.as_py(), own) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], [*columns, "features"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, "text").mapInArrow(run, f"{kinds}, features array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = TRAIN_ROWS) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the logistic model, from at most ``limit`` labelled rows; ``FEATURES`` numbers a row go to the driver."""
    rows = training_rows(docs, labels, label, limit).persist()
    try:
        lexicon = learn_lexicon(rows)
        got = sorted((r.label, tuple(r.features)) for r in with_features(rows, lexicon, ["label"]).collect())
    finally:
        rows.unpersist()
    return lexicon, fit_logistic(np.array([f for _, f in got], float).reshape(-1, FEATURES), np.array([k for k, _ in got], float))


def score(docs: DataFrame, model: tuple[Lexicon, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    lexicon, theta = model
    margin = F.lit(float(theta[-1]))
    for k in range(FEATURES):
        margin = margin + F.col("features")[k] * float(theta[k])
    out = with_features(docs, lexicon, ["doc_id"]).withColumn("score", 1 / (1 + F.exp(-margin)))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
