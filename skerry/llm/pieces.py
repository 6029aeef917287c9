"""SentencePiece encoding and decoding with weighted transducers.

Three parts of a model file are compiled to arcs (state, label, target, output, weight):

- the normaliser: its character map as a trie that rewrites the longest match, with an arc that copies any
  other character; then blanks are folded and marked as the model says;
- the pieces: a trie over characters whose piece-ending states lead back to the start with the piece's id as
  output and its weight (the negative score of a unigram model);
- the byte fallback: one arc from the start for any character that is no piece, with the ids of its bytes as
  output and a weight beyond all pieces.

Composed with an input, pieces and fallback give a lattice, built place by place while the shortest path in
the tropical semiring is looked for (weights add along a path, the least path wins). BPE models have no
additive scores: there a path is the encoding exactly if every two neighbouring symbols are, alone, the
encoding of their joined text. So the state of the composition is the last symbol too, and a transition
between symbols weighs 0 if that holds and infinity otherwise, which leaves one finite path for every prefix.
Of these weights only those that inputs ask for are compiled, by the model's merges.

No piece of these models goes on over the start of a run of blanks or over a character outside all
pieces, so normalised inputs are cut there and each distinct cut of a batch is composed once.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, slices, text_bytes

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Entries that a worker keeps of its caches (whole cuts; cuts without their last character where no
#: piece spans it, such as a full stop); beyond, each is encoded once for each batch.
CACHE = 200_000
STEMS = 500_000
PAIRS = 1_000_000


def wire(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message; messages and strings as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        match key & 7:
            case 0:
                value = varint()
            case 1:
                value, at = data[at : at + 8], at + 8
            case 2:
                size = varint()
                value, at = data[at : at + size], at + size
            case 5:
                value, at = struct.unpack_from("<f", data, at)[0], at + 4
            case other:
                raise ValueError(f"wire type {other}")
        yield key >> 3, value


WIDTH = 0x110000  # code points


class Arcs:
    """A transducer as arrays over its states: the arcs of each by label, and the arc without a label that leads
    from its end back to the start, with its output (None: there is none) and weight."""

    def __init__(self):
        self.step: list[dict[str, int]] = [{}]
        self.output: list[object] = [None]
        self.weight: list[float] = [0.0]

    def add(self, labels: str, output: object, weight: float = 0.0) -> None:
        """A path from the start, sharing the arcs that are there, and the way back from its end."""
        state = 0
        for label in labels:
            target = self.step[state].get(label)
            if target is None:
                target = self.step[state][label] = len(self.step)
                self.step.append({})
                self.output.append(None)
                self.weight.append(0.0)
            state = target
        if self.output[state] is None:
            self.output[state], self.weight[state] = output, weight

    def longest(self, text: str, at: int) -> tuple[int, object]:
        """(end, output) of the longest path along ``text`` from ``at`` on; end is ``at`` if there is none."""
        state, end, found = 0, at, None
        for i in range(at, len(text)):
            state = self.step[state].get(text[i])
            if state is None:
                break
            if self.output[state] is not None:
                end, found = i + 1, self.output[state]
        return end, found


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a precompiled character map: a double-array trie over UTF-8 bytes, then the texts that its
    values point into."""
    (size,) = struct.unpack_from("<I", blob)
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    out, stack, labels = {}, [(int(offset(units[0])), b"")], np.arange(1, 256)
    while stack:
        base, key = stack.pop()
        places = base ^ labels
        there = places < len(units)
        there[there] = units[places[there]] & 0x800000FF == labels[there]
        for label, place in zip(labels[there].tolist(), places[there].tolist(), strict=True):
            unit = int(units[place])
            below = place ^ offset(unit)
            if unit & 256:
                at = int(units[below]) & 0x7FFFFFFF
                out[(key + bytes([label])).decode("utf-8", "replace")] = texts[at : texts.index(b"\0", at)].decode("utf-8", "replace")
            stack.append((below, key + bytes([label])))
    return out


class Transducer:
    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        normaliser: dict = {}
        for number, value in wire(model):
            if number == 1:
                piece = dict(wire(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer |= dict(wire(value))
            elif number == 3:
                normaliser |= dict(wire(value))
        self.bpe = trainer.get(3, UNIGRAM) == BPE
        if trainer.get(3, UNIGRAM) not in (UNIGRAM, BPE) or trainer.get(24, 0) or not normaliser.get(5, 1):
            raise ValueError("the model needs rules that are not compiled here: words or characters as pieces, blanks behind words or unmarked")
        kinds = list(zip(self.pieces, self.kinds, strict=True))
        self.prefix = " " if normaliser.get(3, 1) else ""
        self.folds = bool(normaliser.get(4, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(kinds) if k == NORMAL or k == USER and not self.bpe}
        self.bytes_of = {int(p[3:5], 16): i for i, (p, k) in enumerate(kinds) if k == BYTE}
        self.output = [self._written(p, k) for p, k in kinds]
        if any(BLANK in p.lstrip(BLANK) for p, k in kinds if k in (NORMAL, USER)):
            raise ValueError("pieces with inner blanks are not compiled here")
        users = [p for p, k in kinds if k == USER]
        normal = [s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL]
        self.least, most = min(normal, default=0.0) - 10, max(0.0, *normal) if normal else 0.0  # as in the library, no less than 0
        # The transducers.
        self.rewriter = Arcs()
        for key, text in (character_map(normaliser[2]) if normaliser.get(2) else {}).items():
            self.rewriter.add(key, text)
        # Inputs are rewritten between blanks, unless a rule goes on over one.
        self.whole = any(" " in arcs for arcs in self.rewriter.step[1:])
        self.machine = Arcs()
        for p, k in self.ids.items():
            score = len(p) * most - 0.1 if self.kinds[k] == USER else self.scores[k]
            self.machine.add(p, k, 0.0 if self.bpe else -score)
        self.symbols = Arcs()
        for p in users:
            self.symbols.add(p.replace(BLANK, " "), self.pieces.index(p))
        self.split = re.compile("(" + "|".join(re.escape(p.replace(BLANK, " ")) for p in sorted(users, key=len, reverse=True)) + ")") if users else None
        alphabet = {c for p in self.ids for c in p}
        # Cuts: blanks with what follows them; line breaks alone, unless pieces or runs of unknown characters have them.
        self.cut = re.compile(" *[^ \n]+| +|\n" if "\n" not in alphabet and self.bytes_of else " *[^ ]+| +").findall
        self.cuts: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.chunks: dict[str, str] = {}
        self.inside = {p[i : i + 2].replace(BLANK, " ") for p in self.ids for i in range(len(p) - 1)}
        self.pairs: dict[int, bool] = {}

    @staticmethod
    def _written(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(BLANK, " ").encode()

    # Normaliser

    def rewritten(self, text: str) -> str:
        """The output of the character map's transducer; user-defined symbols go through as they are."""
        out, at = [], 0
        while at < len(text):
            end, _ = self.symbols.longest(text, at)
            if end > at:
                out.append(text[at:end])
            else:
                end, found = self.rewriter.longest(text, at)
                if end > at:
                    out.append(found)
                else:
                    out.append(text[at])
                    end = at + 1
            at = end
        return "".join(out)

    def normalised(self, text: str) -> str:
        """The text that is cut, blanks as spaces; empty for one without anything to encode."""
        if not text:
            return ""
        if len(self.rewriter.step) > 1:
            parts = [text] if self.whole or self.split else re.split("( +)", text)
            for i, part in enumerate(parts):
                known = self.chunks.get(part)
                if known is None:
                    known = self.rewritten(part)
                    if len(self.chunks) < CACHE and len(part) < 64:
                        self.chunks[part] = known
                parts[i] = known
            text = "".join(parts)
        if self.folds:
            text = re.sub(" +", " ", text).strip(" ")
        text = self.prefix + text.replace(BLANK, " ")
        return text.rstrip(" ") if self.folds else text

    # Composition and shortest path

    def merged(self, text: str) -> list[str]:
        """The merges of a BPE model, best score first and leftmost among equals."""
        parts = list(text)
        ids, scores = self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def symbol(self, k: int) -> str:
        """The text of a symbol: a piece, or (below -1) a character that is none."""
        return self.pieces[k] if k >= 0 else chr(-k - 2) if k < -1 else ""

    def finite(self, left: int, right: int) -> bool:
        """Whether the transition between two symbols weighs 0; -1 is the start."""
        key = (left + WIDTH + 2 << 32) + right + WIDTH + 2
        known = self.pairs.get(key)
        if known is None:
            a, b = self.symbol(left), self.symbol(right)
            known = self.merged(a + b) == ([a, b] if a else [b])
            if len(self.pairs) < PAIRS:
                self.pairs[key] = known
        return known

    def path(self, text: str) -> list[int]:
        """Symbols of the shortest path through the lattice of ``text`` (blanks as U+2581)."""
        return self._finite(text) if self.bpe else self._additive(text)

    def shortest(self, text: str) -> list[int]:
        """Ids of the shortest path; a character that is no piece comes out as its bytes, or a run of such
        characters as the unknown piece."""
        out: list[int] = []
        before = 0
        for k in self.path(text):
            if k >= 0:
                out.append(k)
            elif self.bytes_of:
                out += [self.bytes_of[b] for b in chr(-k - 2).encode("utf-8", "surrogatepass")]
            elif before >= 0 or not out:
                out.append(self.unknown)
            before = k
        return out

    def _finite(self, text: str) -> list[int]:
        """Weights are 0 or infinity, and every prefix has one finite path at most: the lattice is composed in
        the order of places, and each place keeps the last symbol of its path."""
        step, output, pairs, finite, ids = self.machine.step, self.machine.output, self.pairs, self.finite, self.ids
        n, base, start = len(text), WIDTH + 2, self.machine.step[0]
        last: list[int | None] = [-1] + [None] * n
        came = [0] * (n + 1)
        for at in range(n):
            left = last[at]
            if left is None:
                continue
            state, end, high = start.get(text[at]), at + 1, (left + base << 32) + base
            while state is not None:
                k = output[state]
                if k is not None and last[end] is None:
                    known = pairs.get(high + k)
                    if known or known is None and finite(left, k):
                        last[end], came[end] = k, at
                if end == n:
                    break
                state, end = step[state].get(text[end]), end + 1
            if last[at + 1] is None and text[at] not in ids and finite(left, -ord(text[at]) - 2):
                last[at + 1], came[at + 1] = -ord(text[at]) - 2, at
        path = []
        while n:
            if last[n] is None:
                raise ValueError(f"no path through {text!r}")
            path.append(last[n])
            n = came[n]
        return path[::-1]

    def _additive(self, text: str) -> list[int]:
        """The least sum of weights to every place."""
        step, output, cost = self.machine.step, self.machine.output, self.machine.weight
        n = len(text)
        weight, last, came = [0.0] + [float("inf")] * n, [-1] * (n + 1), [0] * (n + 1)
        for at in range(n):
            state, single = 0, False
            for end in range(at, n):
                state = step[state].get(text[end])
                if state is None:
                    break
                if output[state] is not None:
                    single = single or end == at
                    if weight[at] + cost[state] < weight[end + 1]:
                        weight[end + 1], last[end + 1], came[end + 1] = weight[at] + cost[state], output[state], at
            if not single and weight[at] - self.least < weight[at + 1]:
                weight[at + 1], last[at + 1], came[at + 1] = weight[at] - self.least, -ord(text[at]) - 2, at
        path = []
        while n:
            path.append(last[n])
            n = came[n]
        return path[::-1]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        split = []
        for t in texts:
            t = self.normalised(t)
            if self.split and self.bpe:
                split.append([x for k, part in enumerate(self.split.split(t)) if part for x in ([("", part)] if k % 2 else self.cut(part))])
            else:
                split.append(self.cut(t))
        distinct = set().union(*split)
        found = {c: self.cuts[c] for c in distinct if c in self.cuts}
        missing = distinct.difference(found)
        new = {c: np.array([self.symbols.longest(c[1], 0)[1]], "<u4").tobytes() for c in missing if isinstance(c, tuple)}
        # No merge joins two characters that no piece has side by side, so a cut can be split there.
        parts = {c: (c[:-1], c[-1]) if len(c) > 1 and c[-2:] not in self.inside and (self.bytes_of or c[-1] in self.ids) else (c, "") for c in missing.difference(new)}
        stems = {"": b""}
        for stem in {x for pair in parts.values() for x in pair if x}:
            ids = self.stems.get(stem)
            if ids is None:
                ids = np.array(self.shortest(stem.replace(" ", BLANK)), "<u4").tobytes()
                if len(self.stems) < STEMS:
                    self.stems[stem] = ids
            stems[stem] = ids
        new |= {c: stems[a] + stems[b] for c, (a, b) in parts.items()}
        room = CACHE - len(self.cuts)
        if room > 0:
            self.cuts.update(list(new.items())[:room])
        found.update(new)
        return [np.frombuffer(b"".join(map(found.__getitem__, cuts)), "<u4") for cuts in split]

    def decode(self, ids: list[int]) -> str:
        out = list(map(self.output.__getitem__, ids))
        if self.prefix or self.folds:  # the blank before the first word; where blanks are folded, all before it
            for i, piece in enumerate(out):
                if piece.startswith(b" ") and self.kinds[ids[i]] in (NORMAL, USER):
                    out[i] = piece[1:]
                    if not self.folds:
                        break
                if out[i]:
                    break
        return b"".join(out).decode("utf-8", "replace")


def transducer(path: str) -> Transducer:
    """The last one that a worker process used stays in it, with its caches, while the stage lasts."""

    def compiled() -> Transducer:
        with open(path, "rb") as f:
            return Transducer(f.read())

    return held(("transducer", path), compiled)


def listed(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))


def _encode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = transducer(path)
    for b in slices(batches):
        ids = t.batch([x or "" for x in b.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), listed(ids)], ["doc_id", "ids"])


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text of ``docs`` (doc_id, text).

    A null or empty text has no ids; repeated rows each give a row; other columns are ignored; an
    empty table gives no rows. Nothing is shuffled. As in the library, a U+2581 counts as a blank.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_encode, model), "doc_id long, ids array<int>")


def _decode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = transducer(path)
    for b in slices(batches, "ids"):
        texts = [t.decode(x or []) for x in b.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of ids; a null or empty list is an empty text, a broken byte run has U+FFFD."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, model), "doc_id long, text string")


def _trip(path: str, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = transducer(path)
    for b in slices(batches):
        raw = text_bytes(b.column("text"))
        texts = [x.decode("utf-8", "replace") for x in raw]
        ids = t.batch(texts)
        same = [t.decode(i.tolist()) == x.replace(BLANK, " ") for i, x in zip(ids, texts, strict=True)]
        sums = [zlib.crc32(i.tobytes()) for i in ids]
        columns = [b.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())]
        names = ["doc_id", "n_pieces", "ids_crc32", "round_trip"]
        if with_ids:
            columns.append(listed(ids))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def round_trip(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text in one pass: doc_id, n_pieces, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers) and whether decoding gives the text back (blanks as the
    model writes them), with the ids themselves if asked for. Empty cases as in ``encode``."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return rows.mapInArrow(partial(_trip, model, with_ids), schema)
