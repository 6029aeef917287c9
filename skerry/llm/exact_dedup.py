"""Exact dedup over a cuckoo-filter index of live digests.

Texts are equal when they are identical after lower-casing A-Z only. Every text becomes a key (its
SHA-256 and its byte length). Keys are dealt into buckets by their first bytes; each bucket has a
cuckoo filter in front of its content. A key that the filter has not seen is inserted; a hit is
verified against the bucket's content, so a false positive of the filter never merges two texts.
When an insertion finds no free slot the filter doubles and is filled again from the stored keys.
Digests can be deleted again ("forget"), which frees their slots.

Rows of one group are pre-aggregated before they are dealt out, so a text that makes up a third of
the corpus costs one row for each mapped batch, not one for each copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, slices, spread_join, text_bytes, written

SLOTS = 4
MAX_KICKS = 200


class CuckooFilter:
    """Partial-key cuckoo filter over byte keys whose first bytes are uniform (digests)."""

    def __init__(self, buckets: int = 1 << 8):
        self.mask = buckets - 1
        self.table: list[list[int]] = [[] for _ in range(buckets)]
        self.size = 0

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") or 1

    def _places(self, key: bytes) -> tuple[int, int, int]:
        f = self._print(key)
        i = int.from_bytes(key[10:16], "little") & self.mask
        return f, i, self._other(i, f)

    def _other(self, i: int, f: int) -> int:
        return (i ^ (f * 0x5BD1E995)) & self.mask

    def __contains__(self, key: bytes) -> bool:
        f, i, j = self._places(key)
        return f in self.table[i] or f in self.table[j]

    def insert(self, key: bytes) -> bool:
        """False when the table overflows; the caller then resizes from its stored keys."""
        f, i, j = self._places(key)
        for at in (i, j):
            if len(self.table[at]) < SLOTS:
                self.table[at].append(f)
                self.size += 1
                return True
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            f, self.table[j][slot] = self.table[j][slot], f
            j = self._other(j, f)
            if len(self.table[j]) < SLOTS:
                self.table[j].append(f)
                self.size += 1
                return True
        return False

    def delete(self, key: bytes) -> bool:
        f, i, j = self._places(key)
        for at in (i, j):
            if f in self.table[at]:
                self.table[at].remove(f)
                self.size -= 1
                return True
        return False


class LiveIndex:
    """Live keys with their payload, behind a cuckoo filter."""

    def __init__(self):
        self.filter = CuckooFilter()
        self.content: dict[bytes, list] = {}

    def _insert(self, key: bytes) -> None:
        if not self.filter.insert(key):
            buckets = (self.filter.mask + 1) * 2
            while True:
                grown = CuckooFilter(buckets)
                if all(grown.insert(k) for k in self.content):
                    break
                buckets *= 2
            self.filter = grown

    def add(self, key: bytes, doc_id: int | None, n: int) -> None:
        """Adds ``n`` copies of which ``doc_id`` is the largest id."""
        if key in self.filter and (entry := self.content.get(key)) is not None:
            entry[1] += n
            if entry[0] is None or (doc_id is not None and doc_id > entry[0]):
                entry[0] = doc_id
            return
        self.content[key] = [doc_id, n]
        self._insert(key)

    def forget(self, key: bytes) -> bool:
        if key in self.filter and self.content.pop(key, None) is not None:
            return self.filter.delete(key)
        return False


def normalised(text: bytes) -> bytes:
    """bytes.lower() maps A-Z alone."""
    return text.lower()


def key_of(text: bytes) -> bytes:
    low = normalised(text)
    return hashlib.sha256(low).digest() + len(low).to_bytes(8, "little")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        keys = [key_of(t) for t in text_bytes(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("plain"), pa.array(keys, pa.binary())], ["doc_id", "plain", "key"])


def digests(docs: DataFrame) -> DataFrame:
    """A written table of doc_id, plain (a hash of the text as it is) and key of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), plain(docs).alias("plain"))
    return written(rows.mapInArrow(_keys, "doc_id long, plain long, key binary"), "digests")


def plain(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of a batch: its largest id and its count."""
    for b in batches:
        best: dict[bytes, list] = {}
        for doc, key in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), strict=True):
            if (e := best.get(key)) is None:
                best[key] = [doc, 1]
            else:
                e[1] += 1
                if e[0] is None or (doc is not None and doc > e[0]):
                    e[0] = doc
        yield _packed(best)


def _packed(entries: dict[bytes, list]) -> pa.RecordBatch:
    values = list(entries.values())
    arrays = [pa.array(list(entries), pa.binary()), pa.array([x[0] for x in values], pa.int64()), pa.array([x[1] for x in values], pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["key", "keep_id", "group_size"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, gone = LiveIndex(), []
    for b in batches:
        for key, doc, n in zip(*(b.column(c).to_pylist() for c in ("key", "keep_id", "group_size")), strict=True):
            if n:
                index.add(key, doc, n)
            else:
                gone.append(key)  # to forget, once all copies are in
    for key in gone:
        index.forget(key)
    yield _packed(index.content)


def live_index(rows: DataFrame, forget: DataFrame | None = None) -> DataFrame:
    """key, keep_id and group_size of every live digest of ``rows`` (doc_id, key)."""
    state = "key binary, keep_id long, group_size long"
    parts = rows.select("doc_id", "key").mapInArrow(_combined, state)
    if forget is not None:
        parts = parts.unionByName(forget.select("key", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size")))
    return parts.repartition(partitions(rows.sparkSession), "key").mapInArrow(_indexed, state)


def exact_dedup(docs: DataFrame, forget: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. A null text counts as empty; a null doc_id
    is smaller than any other; rows that repeat a doc_id and text all count in group_size, and are
    all kept when theirs is the largest id. Other columns are ignored; an empty table gives no rows.
    ``forget``: a table with a column key (SHA-256 and length, as ``key_of`` makes it) of digests to
    delete from the index; rows of these texts come back with a null keep_id and kept false.
    """
    rows = digests(docs)
    kept = F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("group_size").isNotNull(), F.lit(False))
    sha256 = F.lower(F.hex(F.substring("key", 1, 32)))
    joined = spread_join(rows.select("doc_id", "key"), live_index(rows, forget), "key", "doc_id")
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), sha256.alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns: of equal texts one, of the largest doc_id (none is smaller
    than any). Rows that share a doc_id are judged by their own texts; of rows equal in both one stays.

    Rows meet the kept ones by doc_id and a hash of the text, so the copies of one text are spread by their
    ids, and texts are streamed past a table of numbers, not sorted."""
    rows = digests(docs)
    index = live_index(rows).withColumnRenamed("key", "live")
    kept = rows.join(index, (rows["key"] == index["live"]) & rows["doc_id"].eqNullSafe(index["keep_id"]))
    # Texts that differ in case alone can share the largest doc_id too: one of them stays.
    kept = kept.groupBy("key", "plain").agg(F.first("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("rows"))
    stays = kept.groupBy("key").agg(F.min(F.struct("plain", "keep_id", "rows")).alias("one"))
    stays = written(stays.select(F.col("one.plain").alias("_stay_plain"), F.col("one.keep_id").alias("_stay_id"), F.col("one.rows").alias("_stay_rows")), "stays")
    met = (plain(docs) == stays["_stay_plain"]) & docs["doc_id"].cast("long").eqNullSafe(stays["_stay_id"])
    out = docs.join(stays.hint("shuffle_hash"), met)
    if stays.where("_stay_rows > 1").limit(1).count():
        again = out.where("_stay_rows > 1").withColumn("_stay_plain", plain(docs))
        out = out.where("_stay_rows = 1").unionByName(again.dropDuplicates(["_stay_plain", "_stay_id"]))
    return out.select(*(f"`{c}`" for c in docs.columns))
