"""Token ids in length-delimited binary files.

File format. A record is: body length (uint64), masked CRC-32 of that length (uint32), body, masked
CRC-32 of the body (uint32), all little-endian; a checksum c is stored as rotate-right(c, 15) +
0xA282EAD8. The body is doc_id (int64), number of ids (uint32), bytes an id takes (uint32: 2 or 4),
ids. A document without doc_id has 0 there and the highest bit of the last field set. Beside each file
lies an index with (doc_id, offset, number of ids) for every record, where a document without doc_id
has 0 and -1 - offset, so a shuffled reader seeks to any record at once. Files follow each other in doc_id order, and the
manifest has their order and totals, from which every document's place in the whole stream follows.
"""

from __future__ import annotations

import json
import os
import string
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, held, partitions, slices, work_path

HEAD = struct.Struct("<QI")
BODY = struct.Struct("<qII")
TAIL = struct.Struct("<I")
NAMELESS = 1 << 31
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("n", "<i8")])
#: Entries that a worker keeps of its caches (words, and the parts they consist of); beyond, each is
#: encoded once for each batch.
WORDS = 200_000
PARTS = 300_000
#: Punctuation that may stand behind the letters of a simple word; an apostrophe has rules of its own.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of text that are encoded together.
SLICE = 4 << 20
#: Characters that go to the tokenizer in a call; its records of a token take far more room than the ids.
CALL = 1 << 14
MANIFEST = "part long, file string, index_file string, docs long, ids long, bytes long"


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


#: The rules of tokenizer files whose texts may be encoded word by word (fixed values): white space is dropped,
#: no rule goes across it, and letters, single digits and runs of other characters are pre-tokens.
WORD_RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def by_words(config: dict) -> bool:
    """Whether a tokenizer file has the rules that make a text's ids those of its words in order."""
    model = config.get("model", {})
    marks = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("ignore_merges")
    plain = not any(t.get(k) for t in config.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized"))
    spaced = any(c.isspace() for t in config.get("added_tokens", []) for c in t["content"])
    return marks and plain and not spaced and not config.get("truncation") and not config.get("padding") and all(config.get(k) == v for k, v in WORD_RULES.items())


def calls(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, in runs of CALL characters; a longer text is a run of its own."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > CALL:
            yield texts[first:i]
            first, size = i, 0
        size += len(text)
    if texts:
        yield texts[first:]


class Encoder:
    """The tokenizers library's ids. Where the file's rules are WORD_RULES, a text's ids are those of its words in
    order and each distinct word of a batch is encoded once; texts with separators that Python and the tokenizer
    class differently are encoded whole, and so is every text with any other file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_words = by_words(json.load(f))
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for p, i in vocab.items() if p.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for some in calls(texts):
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            out.extend(np.array(x.ids, self.dtype).tobytes() for x in found)
        return out

    @staticmethod
    def _simple(word: str) -> tuple[str, str] | None:
        """(letters in lower case, ASCII punctuation behind them) if the word is just that. Letters that are more
        than letters in lower case, as a dotted capital I with its combining dot, are not: their marks go with
        the punctuation."""
        core = word.rstrip(MARKS)
        if core.isalpha() and (core.isascii() or (unicodedata.is_normalized("NFC", core) and max(core) < "ɐ")):
            low = core.lower()
            if len(low) == len(core) and low.isalpha():
                return low, word[len(core) :]
        return None

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens, those that are not known many in a call; a pre-token's last id is the only
        one with a word end."""
        out = list(map(self.parts.get, parts))
        places = [i for i, x in enumerate(out) if x is None]
        if places:
            new = [parts[i] for i in places]
            found: list[bytes] = []
            for some in calls(new):
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) == len(some):
                    data, at = ids.astype(self.dtype).tobytes(), 0
                    for end in (cuts * self.dtype.itemsize).tolist():
                        found.append(data[at:end])
                        at = end
                else:
                    found += self.whole(some)
            for i, x in zip(places, found, strict=True):
                out[i] = x
            room = max(0, PARTS - len(self.parts))
            self.parts.update(zip(new[:room], found[:room], strict=True))
        return out

    def _encode_words(self, distinct: list[str]) -> list[bytes]:
        """Ids of distinct words of any kind, one by one."""
        known = {w: self.words[w] for w in self.words.keys() & set(distinct)}
        simple, hard = {}, []
        for w in distinct:
            if w in known:
                continue
            if s := self._simple(w):
                simple[w] = s
            else:
                hard.append(w)
        names = list({p for s in simple.values() for p in s})
        parts = dict(zip(names, self._encode_parts(names), strict=True))
        new = {w: parts[a] + parts[b] for w, (a, b) in simple.items()}
        if hard:
            new.update(zip(hard, self.whole(hard), strict=True))
        room = WORDS - len(self.words)
        if room > 0:
            self.words.update(list(new.items())[:room])
        known.update(new)
        return [known[w] for w in distinct]

    def _encoded(self, distinct: pa.Array) -> pa.Array:
        """Ids of distinct words. ASCII letters with punctuation behind them are taken apart by Arrow, as _simple
        does it; the other words go through _encode_words."""
        core = pc.ascii_rtrim(distinct, MARKS)
        easy = pc.ascii_is_alpha(core)
        low = pc.ascii_lower(core.filter(easy)).dictionary_encode()
        tail = pc.ascii_ltrim(distinct.filter(easy), string.ascii_letters).dictionary_encode()
        ids = [pa.array(self._encode_parts(x.dictionary.to_pylist()), pa.large_binary()).take(x.indices) for x in (low, tail)]
        plain = pc.binary_join_element_wise(*ids, pa.scalar(b"", pa.large_binary()))
        other = pa.array(self._encode_words(distinct.filter(pc.invert(easy)).to_pylist()), pa.large_binary())
        first = easy.to_numpy(zero_copy_only=False)
        place = np.where(first, np.cumsum(first) - 1, len(plain) + np.cumsum(~first) - 1)
        return pa.concat_arrays([plain, other]).take(pa.array(place))

    def batch(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text, null as empty."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.by_words:
            return self.whole(column.to_pylist())
        odd = pc.match_substring_regex(column, "[\x1c-\x1f]")
        split = pc.utf8_split_whitespace(pc.if_else(odd, "", column))
        words = split.flatten().dictionary_encode()
        flat = self._encoded(words.dictionary).take(words.indices)
        cuts = split.offsets.to_numpy() - split.offsets[0].as_py() + flat.offset
        ends = np.frombuffer(flat.buffers()[1], np.int64)[cuts].tolist() if len(flat) else [0] * len(cuts)
        data = memoryview(flat.buffers()[2] or b"")
        out = [bytes(data[a:b]) for a, b in pairwise(ends)]
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        if whole:
            for i, ids in zip(whole, self.whole([column[i].as_py() for i in whole]), strict=True):
                out[i] = ids
        return out


def encoder(path: str) -> Encoder:
    """One for each worker process, for the stage that encodes."""
    return held(("encoder", path), partial(Encoder, path))


def _write(folder: str, tokenizer: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc, fs, base = encoder(tokenizer), *filesystem(folder)
    part = TaskContext.get().partitionId()
    leaf = f"{part:06d}-{uuid.uuid4().hex}"
    out, index, at, total = None, [], 0, 0
    end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
    for b in slices(batches, limit=SLICE):
        if out is None:
            fs.create_dir(base, recursive=True)
            out = fs.open_output_stream(f"{base}/{leaf}.ids.tmp", compression=None, buffer_size=1 << 20)
        for doc, ids in zip(b.column("doc_id").to_pylist(), enc.batch(b.column("text")), strict=True):
            ids += end
            n = len(ids) // width
            body = (BODY.pack(0, n, width | NAMELESS) if doc is None else BODY.pack(doc, n, width)) + ids
            size = len(body).to_bytes(8, "little")
            out.write(size + TAIL.pack(masked(zlib.crc32(size))) + body + TAIL.pack(masked(zlib.crc32(body))))
            index.append((0, -1 - at, n) if doc is None else (doc, at, n))
            at += len(body) + 16
            total += n
    if out is None:
        return
    out.close()
    with fs.open_output_stream(f"{base}/{leaf}.idx.tmp", compression=None) as f:
        f.write(np.array(index, INDEX).tobytes())
    for kind in ("idx", "ids"):
        fs.move(f"{base}/{leaf}.{kind}.tmp", f"{base}/{leaf}.{kind}")
    yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{folder}/{leaf}.ids"], "index_file": [f"{folder}/{leaf}.idx"], "docs": [len(index)], "ids": [total], "bytes": [at]})


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encodes every whole text of ``docs`` (doc_id, text), appends ``end_id`` to each document and
    writes the ids in ascending doc_id order; returns the manifest, a row for each file.

    A null text counts as empty: its document is the end id alone. Rows that repeat a doc_id follow
    each other in the order of their texts. Rows without doc_id come first, in the order of their texts,
    and are read back without one. An empty table gives an empty manifest; other columns are ignored.
    The manifest's rows, one a task that succeeded, come to the driver, which writes them as one file.
    """
    spark = docs.sparkSession
    folder = folder or work_path(spark, "token-files")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    path = f"{folder}/manifest"
    fs, base = filesystem(path)
    if fs.get_file_info(base).type != FileType.NotFound:
        raise FileExistsError(path)
    found = ordered.mapInArrow(partial(_write, folder, tokenizer, end_id), MANIFEST).toArrow().sort_by("part")
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/_part.parquet", compression=None) as f:  # a name that readers skip
        pq.write_table(found, f)
    fs.move(f"{base}/_part.parquet", f"{base}/part-00000.parquet")
    return spark.read.schema(MANIFEST).parquet(path)


def records(data: bytes, offsets: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the records at these offsets of a file's bytes, each checked."""
    for at in offsets.tolist():
        size, crc = HEAD.unpack_from(data, at)
        if masked(zlib.crc32(data[at : at + 8])) != crc:
            raise ValueError("a length is damaged")
        body = data[at + 12 : at + 12 + size]
        if masked(zlib.crc32(body)) != TAIL.unpack_from(data, at + 12 + size)[0]:
            raise ValueError("a record is damaged")
        doc, n, width = BODY.unpack_from(body)
        yield None if width & NAMELESS else doc, np.frombuffer(body, f"<u{width & ~NAMELESS}", n, BODY.size)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "file"):
        for file, index_file, base in zip(*(b.column(c).to_pylist() for c in ("file", "index_file", "base")), strict=True):
            fs, path = filesystem(file)
            with fs.open_input_stream(filesystem(index_file)[1], compression=None) as f:
                index = np.frombuffer(f.read(), INDEX)
            offsets = np.where(index["offset"] < 0, -1 - index["offset"], index["offset"])
            names = [d if o >= 0 else None for d, o in zip(index["doc_id"].tolist(), index["offset"].tolist(), strict=True)]
            starts = base + np.concatenate([[0], np.cumsum(index["n"])])
            with fs.open_input_file(path) as f:
                size = f.size()
                at = 0
                while at < len(index):  # about 8 MB of records at a time
                    first = int(offsets[at])
                    to = int(np.searchsorted(offsets, first + (8 << 20)))
                    stop = int(offsets[to]) if to < len(index) else size
                    f.seek(first)
                    docs, sums = [], []
                    for doc, ids in records(f.read(stop - first), offsets[at:to] - first):
                        docs.append(doc)
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    if docs != names[at:to]:
                        raise ValueError("the index does not match its file")
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts[at:to], pa.int64()), pa.array(index["n"][at:to], pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    at = to


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, all from the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = manifest.select("file", "index_file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    n = partitions(manifest.sparkSession)
    return placed.repartition(n, "file").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "file"):
        for file, index_file in zip(b.column("file").to_pylist(), b.column("index_file").to_pylist(), strict=True):
            fs, path = filesystem(index_file)
            with fs.open_input_stream(path, compression=None) as f:
                index = np.frombuffer(f.read(), INDEX)
            for at in range(0, len(index), 100_000):
                part = index[at : at + 100_000]["offset"]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(np.where(part < 0, -1 - part, part))], ["file", "offset"])


def _seeks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records in the order of the rows, each with a seek of its own; a few files stay open."""
    held: dict[str, object] = {}
    try:
        for b in batches:
            out, size = [], 0
            for order, file, at in zip(*(b.column(c).to_pylist() for c in ("position", "file", "offset")), strict=True):
                if file not in held:
                    while len(held) > 31:
                        held.pop(next(iter(held))).close()
                    fs, path = filesystem(file)
                    held[file] = fs.open_input_file(path)
                f = held[file]
                f.seek(at)
                head = f.read(HEAD.size)
                ((doc, ids),) = records(head + f.read(HEAD.unpack(head)[0] + TAIL.size), np.array([0]))
                out.append((order, doc, ids.astype(np.int32)))
                size += len(ids)
                if size > 1 << 20:
                    yield _drawn(out)
                    out, size = [], 0
            if out:
                yield _drawn(out)
    finally:
        for f in held.values():
            f.close()


def _drawn(rows: list[tuple]) -> pa.RecordBatch:
    position, docs, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(position, pa.int64()), pa.array(docs, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["position", "doc_id", "ids"])


def read_shuffled(manifest: DataFrame, seed: int = 0) -> DataFrame:
    """position, doc_id and ids of every document in an order that ``seed`` draws: by a hash of the record's place,
    position being the hash. Only index entries are shuffled; each record is then read by a seek to its offset."""
    n = partitions(manifest.sparkSession)
    index = manifest.select("file", "index_file").repartition(n, "file").mapInArrow(_index, "file string, offset long")
    # The file's name is drawn anew with each writing; its part number and the offset are not.
    place = F.xxhash64(F.lit(seed), F.regexp_extract("file", "([0-9]+)-[^/]*$", 1), "offset")
    drawn = index.withColumn("position", place).repartitionByRange(n, "position").sortWithinPartitions("position")
    return drawn.mapInArrow(_seeks, "position long, doc_id long, ids array<int>")
