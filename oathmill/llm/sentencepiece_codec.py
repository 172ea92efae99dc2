"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice has a state per code point; an arc is a piece. For unigram models the
best path is the one with the largest sum of scores. For BPE models an arc may
follow another only if BPE itself would leave the two pieces side by side; of the
paths that obey this exactly one reaches each state, and it is the BPE encoding
of the prefix, so the same search gives the model's own ids. One search serves all
texts. It reads a text in slices of bounded size, and only the states of the last
``longest piece`` code points stay open. Whenever the backpointer paths of all open
states run through one boundary, the ids before it are committed and forgotten.

A boundary that no piece spans (before a space mark that follows another character,
around a character of no longer piece) is such a point, so what lies between two of
them has ids of its own; the ids of short runs are remembered in a table of bounded
size, which spares repeated searches and changes nothing else.

Ties: of unigram paths with one score, the one whose last piece is longest; BPE merges
of one score go left to right, as in the library. Characters without a piece become
byte pieces, or the unknown id where the model has none. Null and empty texts have no
ids. Beside the text itself and the ids that a caller keeps, memory does not depend on
a text's length; ``digests`` keeps none. The space mark U+2581 in a text stands for a
space, as in the format; all else comes back exactly. Repeated rows repeat their ids; a
null doc_id is kept; columns other than doc_id and text are left out; an empty table
gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from oathmill import reach_workers

from .shared import batched

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Limits of the tables of remembered runs and pairs, and of the runs in them (code points).
MEMO_RUNS, MEMO_PAIRS, MEMO_LENGTH = 200_000, 500_000, 48
#: Code points of a text that are read at once, and ids that are handed on at once.
SLICE = 65_536
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            at += n
            yield tag >> 3, raw[at - n : at]


class Model:
    """The pieces of a model file and the few settings that matter here."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.bpe, self.dummy_prefix = False, True
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                self.dummy_prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models that leave texts as they are")
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        self.scores = [s for _, s, _ in self.pieces]
        self.longest = max(map(len, self.ids))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown_score = min(s for p, s, k in self.pieces if k == NORMAL) - 10.0
        self.out = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, k in self.pieces]
        longer = [p for p in self.ids if len(p) > 1]
        inside = {c for p in longer for c in p}
        #: White space that stands in no longer piece: it parts the text on both sides.
        self.alone = "".join(c for c in "\n\t\r\x0b\x0c" if c not in inside)
        #: Whether the space mark can follow another character within a piece.
        self.spans = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in longer)


class Encoder:
    def __init__(self, model: Model):
        self.model = model
        self._pairs: dict[tuple[int, int], bool] = {}
        alone = re.escape(model.alone)
        self._runs = re.compile(rf"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if not model.spans else None
        self._boundary = re.compile(rf"[^ {SPACE}](?=[ {SPACE}])")
        self._arcs = ahocorasick.Automaton()
        for p, i in model.ids.items():
            self._arcs.add_word(p, (len(p), i))
        self._arcs.make_automaton()
        self._ends: dict[int, tuple[list, list] | None] = {}
        encoder = self

        class Memo(dict):
            """Two generations: when the young one is full it becomes the old one."""

            old: dict[str, tuple[int, ...]] = {}

            def __missing__(self, run: str) -> tuple[int, ...]:
                ids = self.old.get(run)
                if ids is None:
                    ids = tuple(encoder.viterbi([run]))
                if len(run) <= MEMO_LENGTH:
                    if len(self) >= MEMO_RUNS:
                        self.old = dict(self)
                        self.clear()
                    self[run] = ids
                return ids

        self._memo = Memo()

    def merge(self, text: str) -> list[int]:
        """Plain BPE of a short string whose characters all have pieces."""
        return [self.model.ids[p] for p in self._merges(text)[0]]

    def _merges(self, text: str) -> tuple[list[str], str]:
        """The pieces, and the left half of the last merge."""
        ids, scores = self.model.ids, self.model.scores
        parts, left = list(text), ""
        while len(parts) > 1:
            best, where = -float("inf"), -1
            for i in range(len(parts) - 1):
                found = ids.get(parts[i] + parts[i + 1])
                if found is not None and scores[found] > best:
                    best, where = scores[found], i
            if where < 0:
                break
            left = parts[where]
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts, left

    def _edges(self, piece: int) -> tuple[list, list] | None:
        """How a piece grows on its right and left edge: (part, score of the merge that swallows it), smallest part first.

        None where a part's score is not above its whole's, as merges then don't come in the order of scores.
        """
        if piece not in self._ends:
            model, inf = self.model, -float("inf")
            text = model.pieces[piece][0]
            if len(text) == 1:
                self._ends[piece] = [(text, inf)], [(text, inf)]
            else:
                _, left = self._merges(text)
                a, b, s = model.ids[left], model.ids[text[len(left) :]], model.scores[piece]
                inner = [self._edges(a), self._edges(b)]
                if None in inner or any(len(model.pieces[x][0]) > 1 and model.scores[x] <= s for x in (a, b)):
                    self._ends[piece] = None
                else:
                    self._ends[piece] = [*inner[1][0][:-1], (inner[1][0][-1][0], s), (text, inf)], [*inner[0][1][:-1], (inner[0][1][-1][0], s), (text, inf)]
        return self._ends[piece]

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether BPE leaves piece b after piece a: no merge across comes before those that build the two."""
        right, left = self._edges(a), self._edges(b)
        if right is None or left is None:
            return self.merge(self.model.pieces[a][0] + self.model.pieces[b][0]) == [a, b]
        ids, scores = self.model.ids, self.model.scores
        x, y, i, j = right[0], left[1], 0, 0
        while True:
            across = ids.get(x[i][0] + y[j][0])
            after, before = x[i][1], y[j][1]  # scores of the next merges on the two sides; the left one goes first on ties
            if across is not None and scores[across] > after and scores[across] >= before:
                return False
            if after == before == -float("inf"):
                return True
            if after >= before:
                i += 1
            else:
                j += 1

    def _learn(self, a: int, b: int) -> bool:
        if len(self._pairs) >= MEMO_PAIRS:
            self._pairs.clear()
        found = self._pairs[a, b] = self.side_by_side(a, b)
        return found

    def viterbi(self, slices: Iterable[str]) -> Iterator[int]:
        """Ids of a text with space marks, read slice by slice, committed as paths converge."""
        model, pairs, bpe, longest = self.model, self._pairs, self.model.bpe, self.model.longest
        # Of each state that is still held, state ``done`` first: the piece that ends there (-1: a character without
        # one, -2: none), where it begins, its path's score. ``text`` begins at state ``done``.
        done, text, piece, back, score = 0, "", [-2], [0], [0.0]

        def path(upto: int) -> Iterator[int]:
            out = []
            while upto > done:
                p, begin = piece[upto - done], back[upto - done]
                out.append([p] if p >= 0 else [model.bytes[b] for b in text[begin - done : upto - done].encode("utf-8", "replace")] if model.bytes else [model.unknown])
                upto = begin
            return chain.from_iterable(reversed(out))

        def close(end: int) -> int:
            """Give state ``end`` its unknown character if no piece ends there; find where all open paths meet."""
            nonlocal found
            if found is None or (not bpe and text[end - 1 - done] not in model.ids and score[end - 1 - done] + model.unknown_score > found[2]):
                found = (-1, end - 1, score[end - 1 - done] + model.unknown_score)
            piece.append(found[0])
            back.append(found[1])
            score.append(found[2])
            found = None
            if end - done < 4 * longest:
                return done
            open_states = set(range(end - longest + 1, end + 1))
            while len(open_states) > 1:  # step back from the farthest until the paths meet
                far = max(open_states)
                open_states.remove(far)
                open_states.add(back[far - done] if far > done else done)
            return open_states.pop()

        found, end, size, tail = None, 1, 0, ""
        for part in slices:
            text += part
            before, size = size, size + len(part)
            start, seen = before - len(tail), tail + part
            tail = seen[-longest:]
            for last, (length, p) in self._arcs.iter(seen):  # by end, the longest first
                last += start
                if last < before:
                    continue
                while end <= last:
                    meet = close(end)
                    if meet > done:
                        yield from path(meet)
                        piece, back, score, text, done = piece[meet - done :], back[meet - done :], score[meet - done :], text[meet - done :], meet
                    end += 1
                begin = last + 1 - length
                if begin < done:
                    continue
                if bpe:
                    if found is None:
                        q = piece[begin - done]
                        if q >= 0:
                            ok = pairs.get((q, p))
                            if not (self._learn(q, p) if ok is None else ok):
                                continue
                        found = (p, begin, 0.0)
                else:
                    s = score[begin - done] + model.scores[p]
                    if found is None or s > found[2]:
                        found = (p, begin, s)
            while end < size:  # arcs into the last state may still come
                meet = close(end)
                if meet > done:
                    yield from path(meet)
                    piece, back, score, text, done = piece[meet - done :], back[meet - done :], score[meet - done :], text[meet - done :], meet
                end += 1
        if size:
            close(size)
            yield from path(size)

    def stream(self, text: str) -> Iterator[int]:
        """Ids of a text; of the text no more than a slice is copied at once."""
        if not text:
            return
        prefix, at, size = SPACE * self.model.dummy_prefix, 0, len(text)
        if self._runs is None:
            yield from self.viterbi(chain([prefix], (text[i : i + SLICE].replace(" ", SPACE) for i in range(0, size, SLICE))))
            return
        while at < size:
            end = size
            if size - at > SLICE:
                m = self._boundary.search(text, at + SLICE - 1)
                end = m.end() if m else size
            if end - at <= 2 * SLICE:
                yield from chain.from_iterable(map(self._memo.__getitem__, self._runs(prefix + text[at:end].replace(" ", SPACE))))
            else:  # no boundary in sight
                yield from self.viterbi(chain([prefix], (text[i : min(i + SLICE, end)].replace(" ", SPACE) for i in range(at, end, SLICE))))
            prefix, at = "", end

    def encode(self, text: str) -> list[int]:
        return list(self.stream(text))

    def texts(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of ids, in parts."""
        out, ids = codecs.getincrementaldecoder("utf-8")("replace"), iter(ids)
        first, more = self.model.dummy_prefix, True
        while more:
            raw = b"".join(map(self.model.out.__getitem__, islice(ids, SLICE)))
            more = bool(raw)
            part = out.decode(raw, final=not more)
            if first and part:
                part, first = part[part.startswith(" ") :], False
            if part:
                yield part

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.texts(ids))


_OPEN: dict[str, Encoder] = {}


def opened(raw: bytes) -> Encoder:
    """One encoder for each model and worker."""
    name = hashlib.sha256(raw).hexdigest()
    if name not in _OPEN:
        _OPEN[name] = Encoder(Model(raw))
    return _OPEN[name]


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """Read by Spark, so the path can be in any store that it reads."""
    return bytes(spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").first()["content"])


def _over(spark: SparkSession, model: str, row):
    """An Arrow function that gives ``row(encoder, text)`` for each text, after its doc_id."""
    reach_workers(spark)
    raw = spark.sparkContext.broadcast(model_bytes(spark, model))  # a model's size does not depend on the documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = opened(raw.value)
        for batch in batches:
            made = [row(encoder, t.as_py() or "") for t in batch.column("text")]
            columns = [pa.array([m[name] for m in made], kind) for name, kind in row.columns]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", *(name for name, _ in row.columns)])

    return run


def _with_ids(encoder: Encoder, text: str) -> dict:
    return {"ids": np.array(encoder.encode(text), dtype=np.int32)}


def _with_digests(encoder: Encoder, text: str) -> dict:
    n, at, same, told, back = 0, 0, True, hashlib.sha256(), hashlib.sha256()

    def counted() -> Iterator[int]:
        nonlocal n
        ids = encoder.stream(text)
        while part := list(islice(ids, SLICE)):
            n += len(part)
            told.update(np.array(part, dtype="<i4").tobytes())
            yield from part

    for part in encoder.texts(counted()):
        back.update(part.encode())
        same = same and part == text[at : at + len(part)].replace(SPACE, " ")
        at += len(part)
    return {"n_tokens": n, "ids_sha256": told.hexdigest(), "decoded_sha256": back.hexdigest(), "round_trip": same and at == len(text)}


_with_ids.columns = [("ids", pa.list_(pa.int32()))]
_with_digests.columns = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())]


def encode(spark: SparkSession, docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids array<int>."""
    return docs.select("doc_id", "text").mapInArrow(batched(_over(spark, model, _with_ids), 64), "doc_id long, ids array<int>")


def decode(spark: SparkSession, tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text, from doc_id, ids (null: no ids). Ids outside the model fail."""
    raw = spark.sparkContext.broadcast(model_bytes(spark, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = opened(raw.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([encoder.decode(x.as_py() or []) for x in batch.column("ids")], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(batched(run), "doc_id long, text string")


def digests(spark: SparkSession, docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of 4-byte little-endian ids), decoded_sha256, round_trip."""
    return docs.select("doc_id", "text").mapInArrow(batched(_over(spark, model, _with_digests), 64), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
