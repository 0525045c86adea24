"""A log-bilinear language model, trained with noise-contrastive estimation, and an add-one unigram baseline.

The model predicts the class of a token and then the token within its class. The
``SINGLES`` most frequent tokens are classes of their own; the other tokens that
occur at least ``MODELLED_COUNT`` times, whose number grows with the corpus, are
dealt by rank into ``GROUPS`` classes. All rarer tokens, unknown ones too, belong to one of ``TAILS`` classes by
their last two bytes, so endings, and with them languages and punctuation, are predicted for every token.
The classes of the ``CONTEXT`` tokens before
give a vector each, which passes a matrix for its place; the sum's product with a
target vector plus a bias is the score of a class, and likewise, with vectors of
their own, of the tokens of a group. Within a tail each token
has its add-one share of the tail's counts, with one place for unknown tokens.

Training goes in ``ROUNDS``: in each, every shard of the round's documents trains from the same start, against
noise from the unigram distribution, and the shards' changes are averaged by the tokens they have seen. Shards
hold about ``SHARD_TOKENS`` tokens, are dealt and put in order by a hash of id and text and do not depend on how
Spark partitions the table (but for rows without an id, which are spread by their place). For scoring, batched
matrix products give the scores of all classes for each distinct context, and of
all tokens of a group, so that log-probabilities are normalised exactly.

Counts cover all training documents. A token's count comes from a table of the
most frequent ones (at most ``HEAD_TOKENS``, broadcast) or, for the others, by a
join; tokens are told apart by 64-bit hashes.

A null or empty text has only its end token. Repeated rows count repeatedly, and
rows that share an id or have none are scored each by its own tokens. A null id is never held out. Without training documents every count is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, ints, lists, lower_ascii, mix, slices, span_hashes, staged, table, text_bytes, word_spans

TAILS, SINGLES, GROUPS, CONTEXT, WIDTH = 128, 192, 192, 2, 24
#: Tokens with a vector of their own: occurrences that it takes to learn one, and the bound of the model's size.
MODELLED_COUNT, MODELLED_TOKENS = 256, 3 << 14
NOISE, BATCH, RATE, LARGEST_STEP, ROUNDS = 64, 4096, 0.5, 0.1, 4
SHARD_TOKENS = 1_000_000
CHUNK = 4096
HEAD_TOKENS = 1 << 18
COUNT_BLOCK, SCORE_BLOCK, TRAIN_BLOCK = 3_000_000, 1_000_000, 200_000
END = np.uint64(0x656E64206F662074)


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text followed by its end token, the number of tokens of each text, and each token's tail."""
    raw, offsets = text_bytes(column)
    starts, ends, first = word_spans(raw, offsets)
    n = np.diff(first) + 1
    out = np.full(int(n.sum()), END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(n) - 1] = False
    raw = lower_ascii(raw)
    out[inside] = span_hashes(raw, starts, ends)
    tail = np.zeros(len(out), np.int64)
    last = raw[ends - 1].astype(np.uint64) if len(ends) else np.empty(0, np.uint64)
    before = np.where(ends - starts > 1, raw[np.maximum(ends - 2, 0)], 32).astype(np.uint64) if len(ends) else last
    tail[inside] = (mix(before * np.uint64(256) + last) % np.uint64(TAILS)).astype(np.int64)
    return out, n, tail


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, tail, n) over all of ``docs``; counts are combined within a task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token, at, n = np.unique(np.concatenate([t for t, _ in held]), return_index=True, return_counts=True)
            tail = np.concatenate([t for _, t in held])[at]
            return pa.RecordBatch.from_arrays([ints(token, pa.int64()), pa.array(tail.astype(np.int32)), pa.array(n.astype(np.int64))], ["token", "tail", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                found, _, tail = tokens(part.column(0))
                held.append((found, tail.astype(np.uint8)))
                size += len(found)
                if size >= COUNT_BLOCK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "token long, tail int, n long").groupBy("token").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass
class Counts:
    """What the tasks need of the counts: totals, and the frequent tokens sorted by hash with their counts, classes and places in the list of all groups' tokens (-1: none).

    The first ``TAILS`` classes are the tails.
    """

    total: int
    distinct: int
    #: Of each tail, the counts of its tokens plus one for each of them and for the unknown ones.
    tail_total: np.ndarray
    token: np.ndarray
    count: np.ndarray
    label: np.ndarray
    member: np.ndarray
    #: Of the classes the share of the tokens.
    noise: np.ndarray
    #: Of the groups' tokens in order, the share among them all; and the first of each class (classes + 1).
    share: np.ndarray
    first: np.ndarray

    def places(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each token among the frequent ones, and whether it is one."""
        if not len(self.token):
            return np.zeros(len(found), np.int64), np.zeros(len(found), bool)
        at = np.minimum(np.searchsorted(self.token, found), len(self.token) - 1)
        return at, self.token[at] == found

    def classes(self, at: np.ndarray, known: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each token, and its place among the groups' tokens (-1: none)."""
        if not len(self.token):
            return tail, np.full(len(at), -1)
        return np.where(known, self.label[at], tail), np.where(known, self.member[at], -1)


def frequent(counts: DataFrame, limit: int = HEAD_TOKENS, singles: int = SINGLES, groups: int = GROUPS, modelled_count: int = MODELLED_COUNT, modelled: int = MODELLED_TOKENS) -> Counts:
    """Totals and the tokens above the lowest count that at most ``limit`` tokens reach."""
    tails = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()  # at most TAILS rows
    total, distinct = sum(r.n for r in tails), sum(r.distinct for r in tails)
    level = F.floor(F.log2("n") * 8).cast("int")
    steps = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)  # a few hundred rows
    lowest, have = None, 0
    for step in steps:
        if have + step["count"] > limit:
            break
        lowest, have = step["level"], have + step["count"]
    rows = counts.where(level >= lowest).toPandas() if lowest is not None else None
    token = rows["token"].to_numpy(np.int64).view(np.uint64) if rows is not None else np.empty(0, np.uint64)
    count = rows["n"].to_numpy(np.int64) if rows is not None else np.empty(0, np.int64)
    tail = rows["tail"].to_numpy(np.int64) if rows is not None else np.empty(0, np.int64)
    best = np.lexsort((token, -count, token != END))  # the end token is always a class
    own = best[:singles]
    grouped = best[singles:modelled]
    grouped = grouped[count[grouped] >= modelled_count]
    label, member = tail.copy(), np.full(len(token), -1)
    label[own] = TAILS + np.arange(len(own))
    group = np.arange(len(grouped)) * groups // max(1, len(grouped))  # by rank, so that no group is much larger
    label[grouped] = TAILS + singles + group
    member[grouped] = np.arange(len(grouped))
    modelled_tokens = np.concatenate([own, grouped])
    mass = np.bincount(label[modelled_tokens], weights=count[modelled_tokens], minlength=TAILS + singles + groups)
    left = np.zeros(TAILS)
    for r in tails:
        mass[r.tail], left[r.tail] = r.n, r.distinct
    mass[:TAILS] -= np.bincount(tail[modelled_tokens], weights=count[modelled_tokens], minlength=TAILS)
    left -= np.bincount(tail[modelled_tokens], minlength=TAILS)
    share = count[grouped] / max(1, count[grouped].sum())
    first = np.searchsorted(label[grouped], np.arange(len(mass) + 1))
    noise = (mass + 1) / (mass + 1).sum()
    order = np.argsort(token)
    return Counts(int(total), int(distinct), mass[:TAILS] + left + 1, token[order], count[order], label[order], member[order], noise, share, first)


@dataclass
class Model:
    context: np.ndarray  # a vector for each class, and for what is before the text
    target: np.ndarray
    matrices: np.ndarray
    bias: np.ndarray
    word: np.ndarray  # target vectors of the groups' tokens
    word_bias: np.ndarray

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.context, self.target, self.matrices, self.bias, self.word, self.word_bias

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self.parts()])

    def like(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for x in self.parts():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(*out)

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        return sum(self.context[contexts[:, j]] @ self.matrices[j] for j in range(contexts.shape[1]))


def start_model(noise: np.ndarray, share: np.ndarray, width: int = WIDTH, context: int = CONTEXT, seed: int = 3) -> Model:
    """Small vectors, and the unigram distribution as biases."""
    rng = np.random.default_rng(seed)
    n = len(noise)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return Model(draw(n + 1, width), draw(n, width), np.stack([np.eye(width, dtype=np.float32)] * context) + draw(context, width, width), np.log(noise).astype(np.float32), draw(len(share), width), np.log(share).astype(np.float32))


def contexts_of(label: np.ndarray, n: np.ndarray, before: int, context: int = CONTEXT) -> np.ndarray:
    """The classes of the tokens before each token of its text; ``before`` stands for none."""
    place = np.arange(len(label)) - np.repeat(np.cumsum(n) - n, n)
    out = np.full((len(label), context), before, np.int64)
    for j in range(context):
        out[j + 1 :, j] = label[: len(label) - j - 1]
        out[place <= j, j] = before
    return out


def _sums(index: np.ndarray, scale: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of ``index`` (under 2^16), and the sums of their rows times ``scale``, and of ``scale``."""
    order = np.argsort(index.astype(np.uint16), kind="stable")
    ordered, scale = index[order], scale[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[first], np.add.reduceat(rows[order] * scale[:, None], first, axis=0), np.add.reduceat(scale, first)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """Noise-contrastive estimation in minibatches, with steps scaled by past gradients.

    Classes are told from noise classes, and the groups' tokens from noise tokens of
    all groups; within a group these scores give the conditional probabilities.
    """

    def __init__(self, model: Model, counts: Counts, seed: int):
        self.model, self.rng = Model(*(x.copy() for x in model.parts())), np.random.default_rng(seed)
        self.past = Model(*(np.full(x.shape, 1e-2, np.float32) for x in model.parts()))
        self.noise = [(np.cumsum(p) / p.sum(), np.log(NOISE * p).astype(np.float32)) if len(p) else None for p in (counts.noise, counts.share)]

    def learn(self, contexts: np.ndarray, label: np.ndarray, member: np.ndarray) -> None:
        order = self.rng.permutation(len(label))
        for at in range(0, len(label), BATCH):
            chosen = order[at : at + BATCH]
            self._step(contexts[chosen], label[chosen], member[chosen])

    def _move(self, name: str, index, gradient: np.ndarray) -> None:
        x, past = getattr(self.model, name), getattr(self.past, name)
        scale = past[index] + gradient * gradient
        past[index] = scale
        x[index] += np.clip(RATE * gradient / np.sqrt(scale), -LARGEST_STEP, LARGEST_STEP)

    def _contrast(self, q: np.ndarray, true: np.ndarray, vectors: str, bias: str, noise: tuple[np.ndarray, np.ndarray], n: np.float32) -> np.ndarray:
        """Tell true outputs from noise, which all rows share; moves the outputs and returns the gradient of ``q``."""
        v, b, (upto, log_noise) = getattr(self.model, vectors), getattr(self.model, bias), noise
        drawn = np.minimum(np.searchsorted(upto, self.rng.random(NOISE)), len(b) - 1)
        own, other = v[true], v[drawn]
        up = _logistic(log_noise[true] - b[true] - np.einsum("nd,nd->n", q, own)) / n  # gradient of the log-likelihood for the true ones
        down = -_logistic(q @ other.T + (b[drawn] - log_noise[drawn])) / n
        dq = up[:, None] * own + down @ other
        index, gradient, shift = _sums(true, up, q)
        more, gradient_more, _ = _sums(drawn, np.ones(NOISE, np.float32), np.column_stack([down.T @ q, down.sum(0)]))
        self._move(vectors, index, gradient)
        self._move(bias, index, shift)
        self._move(vectors, more, gradient_more[:, :-1])
        self._move(bias, more, gradient_more[:, -1])
        return dq

    def _step(self, contexts: np.ndarray, label: np.ndarray, member: np.ndarray) -> None:
        m, n = self.model, np.float32(len(label))
        inputs = [m.context[contexts[:, j]] for j in range(contexts.shape[1])]
        q = sum(x @ w for x, w in zip(inputs, m.matrices, strict=True))
        dq = self._contrast(q, label, "target", "bias", self.noise[0], n)
        inside = np.flatnonzero(member >= 0)
        if len(inside):
            dq[inside] += self._contrast(q[inside], member[inside], "word", "word_bias", self.noise[1], n)
        one = np.ones(len(label), np.float32)
        moves = [_sums(contexts[:, j], one, dq @ m.matrices[j].T)[:2] for j in range(len(inputs))]
        self._move("matrices", slice(None), np.stack([x.T @ dq for x in inputs]))
        for index, gradient in moves:
            self._move("context", index, gradient)


def coded(docs: DataFrame, counts: Counts, rounds: int) -> DataFrame:
    """(round, shard, place, codes) of every document: its tokens as numbers of classes or, beyond these, of groups' tokens."""
    known = docs.sparkSession.sparkContext.broadcast(counts)
    shards = max(1, round(counts.total / (rounds * SHARD_TOKENS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = known.value
        for batch in batches:
            for part in slices(batch, "text"):
                found, n, tail = tokens(part.column(3))
                label, member = counts.classes(*counts.places(found), tail)
                codes = np.where(member >= 0, len(counts.noise) + member, label).astype(np.int32)
                offsets = pa.py_buffer((np.append(0, np.cumsum(n)) * 4).astype(np.int32))
                column = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(codes)])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), column], ["round", "shard", "place", "codes"])

    place = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id()), "text")
    rows = docs.select(F.pmod(place, F.lit(rounds)).cast("int").alias("round"), F.pmod(F.shiftrightunsigned(place, 16), F.lit(shards)).cast("int").alias("shard"), place.alias("place"), "text")
    return rows.mapInArrow(run, "round int, shard int, place long, codes binary")


def train(docs: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Model:
    """In each round every shard trains by itself; the changes are averaged by the tokens seen, chunk by chunk on the executors.

    The driver gets the model's parameters, whose number has a fixed bound, once a round.
    """
    model = start_model(counts.noise, counts.share)
    numbered = staged(coded(docs, counts, rounds), "coded")
    for k in range(rounds):
        model = train_round(numbered.where(F.col("round") == k), counts, model, k)
    drop_staged(numbered)
    return model


def train_round(rows: DataFrame, counts: Counts, start: Model, seed: int) -> Model:
    """One round over ``rows`` (shard, place, codes)."""
    shared = rows.sparkSession.sparkContext.broadcast((counts, start))
    group = np.repeat(np.arange(len(counts.noise)), np.diff(counts.first))  # of each group's token, its class

    def changes(trainer: Trainer, start: Model, seen: int) -> pa.RecordBatch:
        change = (trainer.model.flat() - start.flat()).astype(np.float16)
        chunks = [(k, change[at : at + CHUNK]) for k, at in enumerate(range(0, len(change), CHUNK))]
        chunks = [(k, c.tobytes()) for k, c in chunks if not k or c.any()]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in chunks], pa.int32()), pa.array([float(seen)] * len(chunks)), pa.array([c for _, c in chunks], pa.binary())], ["chunk", "weight", "change"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, start = shared.value
        classes = len(counts.noise)
        of, trainer, seen, held, size = None, None, 0, [], 0

        def learn() -> None:
            codes, n = np.concatenate(held), np.array([len(c) for c in held])
            member = np.where(codes >= classes, codes - classes, -1)
            label = np.where(member >= 0, group[member], codes) if len(group) else codes
            trainer.learn(contexts_of(label, n, classes, len(start.matrices)), label, member)

        for batch in batches:
            for shard, codes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != of:
                    if held:
                        learn()
                    if trainer:
                        yield changes(trainer, start, seen)
                    of, trainer, seen, held, size = shard, Trainer(start, counts, 17 + seed), 0, [], 0
                held.append(np.frombuffer(codes.as_buffer(), np.int32))
                seen, size = seen + len(held[-1]), size + len(held[-1])
                if size >= TRAIN_BLOCK:
                    learn()
                    held, size = [], 0
        if held:
            learn()
        if trainer:
            yield changes(trainer, start, seen)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight: dict[int, float] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, w, c in zip(*(batch.column(i) for i in range(3)), strict=True):
                k, w = k.as_py(), w.as_py()
                total[k] = total.get(k, 0.0) + w * np.frombuffer(c.as_py(), np.float16).astype(np.float64)
                weight[k] = weight.get(k, 0.0) + w
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([weight[k] for k in total]), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "weight", "change"])

    schema = "chunk int, weight double, change binary"
    ordered = rows.select("shard", "codes", "place").repartition("shard").sortWithinPartitions("shard", "place").select("shard", "codes")
    sums = {r.chunk: r for r in ordered.mapInArrow(run, schema).repartition("chunk").mapInArrow(add, schema).collect()}
    shared.unpersist()
    if not sums:
        return start
    flat = start.flat().astype(np.float64)
    for k, r in sums.items():
        flat[k * CHUNK : (k + 1) * CHUNK] += np.frombuffer(r.change, np.float64) / sums[0].weight
    return start.like(flat)


def _log_softmax_at(scores: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Log-softmax of the rows of ``scores`` at (row, column); ``scores`` are used up."""
    scores -= scores.max(1, keepdims=True)
    picked = scores[row, column].astype(np.float64)
    np.exp(scores, out=scores)
    return picked - np.log(scores.sum(1))[row]


def token_scores(model: Model, contexts: np.ndarray, label: np.ndarray, member: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Normalised natural log-probability of each token: of its class, and within its group."""
    base = len(model.context)
    code = contexts[:, 0]
    for j in range(1, contexts.shape[1]):
        code = code * base + contexts[:, j]
    _, at_first, which = np.unique(code, return_index=True, return_inverse=True)
    distinct = contexts[at_first]
    order = np.argsort(which, kind="stable")
    bounds = np.searchsorted(which[order], np.arange(0, len(distinct) + 2048, 2048))
    out, q = np.empty(len(label)), np.empty((len(distinct), model.target.shape[1]), np.float32)
    for k, at in enumerate(range(0, len(distinct), 2048)):
        q[at : at + 2048] = model.predicted(distinct[at : at + 2048])
        scores = q[at : at + 2048] @ model.target.T
        scores += model.bias
        mine = order[bounds[k] : bounds[k + 1]]
        out[mine] = _log_softmax_at(scores, which[mine] - at, label[mine])
    inside = np.flatnonzero(member >= 0)
    inside = inside[np.argsort(label[inside], kind="stable")]
    edges = np.append(np.flatnonzero(np.append(True, np.diff(label[inside]) != 0)), len(inside)) if len(inside) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        g = int(label[inside[a]])
        words, bias = model.word[first[g] : first[g + 1]], model.word_bias[first[g] : first[g + 1]]
        for at in range(a, b, 8192):
            mine = inside[at : min(at + 8192, b)]
            scores = q[which[mine]] @ words.T
            scores += bias
            out[mine] += _log_softmax_at(scores, np.arange(len(mine)), member[mine] - first[g])
    return out


def score(docs: DataFrame, counts: Counts, table_of_counts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((counts, model))
    names = ["doc_id", "n_tokens", "n_known", "logs", "rare_norm", "rare_logs", "classes", "tail", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, model = shared.value
        logs_of = np.log10(counts.count + 1.0)
        norm_of = np.append(np.log10(counts.tail_total), 0.0)
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            (label, member), n = (np.concatenate([h[1][c] for h in held]) for c in (0, 1)), np.concatenate([h[2] for h in held])
            value = token_scores(model, contexts_of(label, n, len(counts.noise), len(model.matrices)), label, member, counts.first) / np.log(10)
            at = 0
            for ids, (label, _), n, found, places, known in held:
                begin = np.cumsum(n) - n
                add = lambda x: np.add.reduceat(x, begin)  # noqa: B023, E731
                logs = np.where(known, logs_of[places] if len(logs_of) else 0.0, 0.0)
                tail, times = [], []
                for a, size in zip(begin, n, strict=True):
                    t, m = np.unique(found[a : a + size][~known[a : a + size]], return_counts=True)
                    tail.append(t)
                    times.append(m.astype(np.int32))
                each = np.array([len(t) for t in tail])
                columns = [ids, pa.array(n.astype(np.int64)), pa.array(add(known.astype(np.int64))), pa.array(add(logs)), pa.array(add(norm_of[np.minimum(label, TAILS)])), pa.array(add(np.where(label < TAILS, logs, 0.0))), pa.array(add(value[at : at + len(label)])), lists(np.concatenate(tail), each, pa.int64()), lists(np.concatenate(times), each, pa.int32())]
                at += len(label)
                yield pa.RecordBatch.from_arrays(columns, names)

        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                found, n, tail = tokens(part.column(1))
                places, known = counts.places(found)
                held.append((part.column(0), counts.classes(places, known, tail), n, found, places, known))
                size += len(found)
                if size >= SCORE_BLOCK:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    schema = "doc_id long, n_tokens long, n_known long, logs double, rare_norm double, rare_logs double, classes double, tail array<long>, times array<int>"
    rows = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    tail = rows.select("row", F.explode(F.arrays_zip("tail", "times")).alias("e")).select("row", F.col("e.tail").alias("token"), F.col("e.times").alias("times"))
    tail = tail.join(table_of_counts, "token").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    out = rows.drop("tail", "times").join(tail, "row", "left")
    more, more_logs = F.coalesce("more", F.lit(0)), F.coalesce("more_logs", F.lit(0.0))
    base = F.col("logs") + more_logs - F.col("n_tokens") * float(np.log10(counts.total + counts.distinct + 1))
    full = F.col("classes") + F.col("rare_logs") + more_logs - F.col("rare_norm")
    return out.select("doc_id", "n_tokens", (F.col("n_known") + more).alias("n_known"), base.alias("base_score"), full.alias("score"))


def score_texts(docs: DataFrame) -> DataFrame:
    """Train on what is not held out, and score everything."""
    training = docs.where(~held_out("doc_id"))
    counted = staged(count_tokens(training), "counts")
    counts = frequent(counted)
    model = train(training, counts)
    out = score(docs, counts, counted, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(counts.total).cast("long").alias("train_tokens"), "base_score", "score")


def op8_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
