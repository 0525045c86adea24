"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The segmentation maximises the sum of the model's piece scores, as a unigram
model does; of equal sums the one whose last piece starts earlier wins. A
character without a piece costs ``UNKNOWN_PENALTY`` more than the worst piece
and is written as byte pieces, so that every text can be decoded exactly.

The search goes through every text in one direction. Only as many places as the
longest piece has characters are open at a time; back pointers are kept from the
last committed boundary on, and whenever the paths to all open places have gone
through one boundary, the ids up to it are committed. Where no piece has a blank
after another character, the paths converge before each blank, so the ids of the
stretches between blanks are cached.

The vocabulary at ``MODEL`` was made for BPE merges, so its ids, though valid and
decoded exactly, differ from those that the library's merges give.

A null text has null ids; an empty one has none. Repeated rows give repeated
results. A literal U+2581, which the model uses for a blank, is written as bytes.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK, UNKNOWN_PENALTY = "▁", 10.0
#: Stretches shorter than ``CACHED`` characters are kept, so many of them; longer ones are fed in parts.
CACHE_ENTRIES, CACHED, FEED = 200_000, 64, 4096
#: Blanks with what follows up to the next blank; valid if no piece has a blank after another character.
CHUNK = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


@dataclass
class Pieces:
    """A model's vocabulary, as small tables that go to the tasks."""

    #: Piece -> (id, score).
    search: dict[str, tuple[int, float]]
    #: The pieces as a trie: character -> (what may follow, id or -1, score).
    trie: dict[str, tuple]
    bytes_of: list[bytes]
    byte_ids: list[int]
    longest: int
    unknown: float
    blanks_lead: bool
    #: Characters that are pieces.
    single: frozenset[str] = frozenset()
    cache: dict[str, bytes] = field(default_factory=dict)
    #: The generation before; what is asked for again moves on.
    older: dict[str, bytes] = field(default_factory=dict)


def build_trie(search: dict[str, tuple[int, float]]) -> dict[str, tuple]:
    root: dict[str, tuple] = {}
    for piece, (k, score) in search.items():
        node = root
        for c in piece[:-1]:
            node = node.setdefault(c, ({}, -1, 0.0))[0]
        node[piece[-1]] = (node.get(piece[-1], ({},))[0], k, score)
    return root


def load_pieces(path: str = MODEL) -> Pieces:
    """Read a model file on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    search: dict[str, tuple[int, float]] = {}
    bytes_of, byte_ids, inner, worst = [b""] * len(model), [-1] * 256, set(), 0.0
    for k in range(len(model)):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            bytes_of[k] = bytes([int(piece[3:-1], 16)])
            byte_ids[bytes_of[k][0]] = k
        elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
            bytes_of[k] = piece.replace(BLANK, " ").encode("utf-8")
            worst = min(worst, model.get_score(k))
            search[piece] = (k, model.get_score(k))
            inner.update(piece[i : i + 2] for i in range(len(piece) - 1))
    if min(byte_ids) < 0:
        raise ValueError("the model has no byte pieces, so not every text could be decoded")
    blanks_lead = not any(x[1] == BLANK != x[0] for x in inner)
    return Pieces(search, build_trie(search), bytes_of, byte_ids, max(map(len, search)), worst - UNKNOWN_PENALTY, blanks_lead, frozenset(p for p in search if len(p) == 1))


class StreamingViterbi:
    """Takes characters piecemeal and gives ids as soon as no later character can change them.

    ``text`` and the lists begin at one place, ``base`` characters into what was
    fed. Places before ``committed`` have given their ids; what was committed is
    dropped in blocks of a few windows.
    """

    def __init__(self, pieces: Pieces):
        self.pieces, self.window = pieces, 4 * pieces.longest
        self._restart()

    def _restart(self) -> None:
        self.text, self.base = "", 0
        self.scores, self.sizes, self.ids = [0.0], [0], [-1]  # of the last piece on the best path to each place; id -1: a character without piece
        self.done = self.far = self.committed = self.checked = 0  # searched from; furthest place reached; ids given; last looked for a shared boundary

    def feed(self, text: str) -> list[int]:
        self._extend(text)
        out: list[int] = []
        self._search(len(self.text) - self.pieces.longest + 1, out)
        return out

    def finish(self, text: str = "") -> list[int]:
        """The ids of what is left, and of ``text``; the search can then begin anew."""
        if text:
            self._extend(text)
        out: list[int] = []
        self._search(len(self.text), out)
        self._commit(len(self.text), out)
        self._restart()
        return out

    def _extend(self, text: str) -> None:
        n = len(text)
        self.text += text
        self.scores += [-1e300] * n
        self.sizes += [0] * n
        self.ids += [-1] * n

    def _search(self, until: int, out: list[int]) -> None:
        """Search from all places before ``until``, and commit what later characters cannot change."""
        trie, longest, unknown, text, scores, sizes, ids = self.pieces.trie, self.pieces.longest, self.pieces.unknown, self.text, self.scores, self.sizes, self.ids
        single, far = self.pieces.single, self.far
        for at in range(self.done, until):
            if far == at:  # the only open place: all paths have converged here
                self._commit(at, out)
            elif at - max(self.committed, self.checked) >= self.window:
                self.checked = at
                self._commit(self._shared(at, far), out)
            score, node, end = scores[at], trie, at
            for c in text[at : at + longest]:
                found = node.get(c)
                if found is None:
                    break
                node, k, gain = found
                end += 1
                if k >= 0:
                    gain += score
                    if gain > scores[end]:
                        scores[end], sizes[end], ids[end] = gain, end - at, k
                        if end > far:
                            far = end
            if text[at] not in single and score + unknown > scores[at + 1]:
                scores[at + 1], sizes[at + 1], ids[at + 1] = score + unknown, 1, -1
                if at >= far:
                    far = at + 1
        self.done, self.far = max(self.done, until), far
        if self.committed >= self.window:
            self._drop()

    def _shared(self, at: int, far: int) -> int:
        """The last boundary that the best paths to all open places (``at`` to ``far``) share."""
        places = {p for p in range(at, far + 1) if self.scores[p] > -1e300}
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(last - self.sizes[last])
        return places.pop()

    def _commit(self, boundary: int, out: list[int]) -> None:
        """Give the ids from the last committed boundary to this one."""
        place, stop = boundary, self.committed
        if place <= stop:
            return
        found: list[int] = []
        while place > stop:
            at, k = place - self.sizes[place], self.ids[place]
            if k >= 0:
                found.append(k)
            else:
                found += [self.pieces.byte_ids[b] for b in reversed(self.text[at:place].encode("utf-8"))]
            place = at
        found.reverse()
        out += found
        self.committed = boundary

    def _drop(self) -> None:
        n = self.committed
        self.text, self.base = self.text[n:], self.base + n
        del self.scores[:n], self.sizes[:n], self.ids[:n]
        self.done, self.far, self.checked, self.committed = self.done - n, self.far - n, max(0, self.checked - n), 0


def encode_stream(parts: Iterable[str], pieces: Pieces) -> Iterator[int]:
    """Ids of a text of any length that comes in parts (already with ``BLANK`` for blanks)."""
    search = StreamingViterbi(pieces)
    for part in parts:
        yield from search.feed(part)
    yield from search.finish()


def _ids(chunk: str, pieces: Pieces, search: StreamingViterbi) -> bytes:
    """Ids of a stretch of text that no piece crosses at its ends, so that the search has converged there."""
    ids = array("i", search.finish(chunk)).tobytes() if len(chunk) <= FEED else b"".join(_parts(chunk, search))
    if len(chunk) < CACHED:
        pieces.cache[chunk] = ids
    return ids


def _parts(chunk: str, search: StreamingViterbi) -> Iterator[bytes]:
    for at in range(0, len(chunk), FEED):
        yield array("i", search.feed(chunk[at : at + FEED])).tobytes()
    yield array("i", search.finish()).tobytes()


def encode(text: str, pieces: Pieces) -> np.ndarray:
    """Ids of a text, with the blank that the model puts in front of one."""
    if not text:
        return np.empty(0, np.int32)
    cache, found, search = pieces.cache, [], StreamingViterbi(pieces)
    if len(cache) > CACHE_ENTRIES // 2:
        pieces.older, pieces.cache = cache, {}
        cache = pieces.cache
    for k, part in enumerate(text.split(BLANK)):
        if k:
            found.append(array("i", [pieces.byte_ids[b] for b in BLANK.encode("utf-8")]).tobytes())
        part = (BLANK if not k else "") + part.replace(" ", BLANK)
        for chunk in CHUNK.findall(part) if pieces.blanks_lead else [part]:
            ids = cache.get(chunk)
            if ids is None:
                ids = pieces.older.get(chunk)
                if ids is None:
                    ids = _ids(chunk, pieces, search)
                else:
                    cache[chunk] = ids
            found.append(ids)
    return np.frombuffer(b"".join(found), np.int32)


def decode(ids: Iterable[int], pieces: Pieces) -> str:
    return b"".join(map(pieces.bytes_of.__getitem__, ids))[1:].decode("utf-8")


def encode_texts(docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """(key, n_tokens, ids, round_trip) of each text, and the text as decoded if ``keep_text``."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    names = [key, *(["text"] if keep_text else []), "n_tokens", "ids", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(1).to_pylist()
                ids = [encode(t, own) if t is not None else None for t in texts]
                back = [decode(x.tolist(), own) if x is not None else None for x in ids]
                size = [0 if x is None else len(x) for x in ids]
                flat = pa.array(np.concatenate([np.empty(0, np.int32), *(x for x in ids if x is not None)]))
                offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32), mask=np.array([x is None for x in ids] + [False]))
                columns = [part.column(0), *([pa.array(back, pa.string())] if keep_text else []), pa.array([None if x is None else len(x) for x in ids], pa.int32()), pa.ListArray.from_arrays(offsets, flat), pa.array([a == b for a, b in zip(texts, back, strict=True)])]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {'text string, ' if keep_text else ''}n_tokens int, ids array<int>, round_trip boolean"
    return docs.select(key, text).mapInArrow(run, schema)


def decode_ids(tokens: DataFrame, pieces: Pieces, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from (key, ids)."""
    shared = tokens.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(x, shared.value) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return tokens.select(key, ids).mapInArrow(run, f"{key} {tokens.schema[key].dataType.simpleString()}, text string")


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), load_pieces())
