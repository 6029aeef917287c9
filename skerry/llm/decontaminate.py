"""Benchmark decontamination by the q-gram lemma.

A region of a document that matches a benchmark item of length m within e edits shares at least
m - q + 1 - q * e of the item's q-grams with it, on diagonals that differ by 2 e at most. Shared
q-grams (found with rolling hashes over whole texts) are counted in overlapping diagonal bands, each
wide enough to hold any such region; bands that meet the bound are verified by banded alignment.
Texts are compared in lower case with runs of white space as one space. Items shorter than q have no
q-gram and no edit to spend: they are looked up whole, by the hash of as many characters.

The distinct items are written as a table of blocks, dealt by hash, and each task reads the block of its
pass from there; neither the driver nor the plan holds benchmark texts.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, held, partitions, slices, text_bytes, where_texts, work_path, written

Q = 8
#: Edits that a match may have, as a share of the item's length.
ERROR = 0.08
#: Characters, about, of benchmark items that one pass over the documents holds; more items take more passes.
BLOCK = 4 << 20
#: Bytes of text that are searched together.
SLICE = 1 << 19
PRIME = 0x9E3779B97F4A7C15 | 1
BITS = 21


def normalised(text: str) -> str:
    return " ".join(text.lower().replace("\x00", " ").split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """The rolling hash of the q-gram at each place."""
    if len(c) < q:
        return np.zeros(0, np.uint64)
    h, p, n = c * np.uint64(PRIME) ^ (c >> np.uint64(3)), PRIME, 1
    while n < q:
        step = min(n, q - n)  # a last step that is no doubling overlaps, and is a hash of the same characters still
        h = h[: len(h) - step] * np.uint64(p) + h[step:]
        p = p * p & 0xFFFFFFFFFFFFFFFF
        n += step
    return h


def budget(m: int, error: float = ERROR, q: int = Q) -> tuple[int, int]:
    """(edits, shared q-grams at least): as many edits as leave the bound at one or more."""
    edits = int(m * error)
    while edits and m - q + 1 - q * edits < 1:
        edits -= 1
    return edits, m - q + 1 - q * edits


def aligned(item: str, text: str, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """Banded alignment: (distance, start, end) of the best match of the whole ``item`` in ``text`` with
    diagonals (place in text less place in item) from ``low`` to ``high``, if within ``edits``."""
    at = text.find(item, max(0, low), max(0, high + len(item)))
    if at >= 0:
        return 0, at, at + len(item)
    m, width = len(item), high - low + 1
    a, t = codes(item), codes(text)
    far = m + edits + 1
    steps = np.arange(width)
    rows = np.empty((m + 1, width), np.int64)
    rows[0] = np.where((low + steps >= 0) & (low + steps <= len(t)), 0, far)
    for i in range(1, m + 1):
        j = low + steps + i  # column of each diagonal in row i
        inside = (j >= 1) & (j <= len(t))
        differs = np.ones(width, np.int64)
        differs[inside] = t[j[inside] - 1] != a[i - 1]
        best = rows[i - 1] + differs
        best[~inside] = far
        best[:-1] = np.minimum(best[:-1], rows[i - 1][1:] + 1)  # a character of the item is missing
        best[(j < 0) | (j > len(t))] = far
        rows[i] = np.minimum.accumulate(best - steps) + steps  # the text has one more
        if not i % 8 and rows[i].min() > edits:  # the least of a row never falls again
            return None
    end = int(rows[m].argmin())
    distance = int(rows[m][end])
    if distance > edits:
        return None
    i, k = m, end
    while i:  # back to the start
        j = low + k + i
        if 1 <= j <= len(t) and rows[i][k] == rows[i - 1][k] + (t[j - 1] != a[i - 1]):
            i -= 1
        elif k + 1 < width and rows[i][k] == rows[i - 1][k + 1] + 1:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return distance, low + k, low + end + m


class Items:
    """Benchmark items with the q-grams of all in one sorted list, and those shorter than q by length."""

    def __init__(self, items: list[tuple[int, str]], error: float):
        self.short: list[tuple[int, np.ndarray, np.ndarray]] = []  # (length, sorted hashes, numbers of the items)
        for m in sorted({len(t) for _, t in items if len(t) < Q}):
            numbers = np.array([k for k, (_, t) in enumerate(items) if len(t) == m], np.int64)
            h = np.array([int(grams(codes(items[k][1]), m)[0]) for k in numbers.tolist()], np.uint64)
            order = np.argsort(h, kind="stable")
            self.short.append((m, h[order], numbers[order]))
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        sizes = np.array([len(t) for t in self.texts], np.int64)
        limits = [budget(m, error) for m in sizes.tolist()]
        self.edits = np.array([e for e, _ in limits], np.int64)
        self.least = np.array([n for _, n in limits], np.int64)
        self.half = 2 * self.edits + 1  # a region's diagonals span 2 e + 1; bands are twice that
        hashes = [grams(codes(t)) for t in self.texts]
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(items)), [len(x) for x in hashes])
        place = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else owner
        order = np.argsort(h, kind="stable")
        h, self.owner, self.place = h[order], owner[order].astype(np.int64), place[order].astype(np.int64)
        self.grams, self.first = np.unique(h, return_index=True)
        self.count = np.diff(np.append(self.first, len(h)))
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(self.grams >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def whole(self, c: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, place in it) of the occurrences of each short item in each text, from left to right without
        overlaps."""
        for m, hashes, numbers in self.short:
            h = grams(c, m)
            low = np.searchsorted(hashes, h)
            at = np.flatnonzero((low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == h))
            doc = np.searchsorted(starts, at, "right") - 1
            done: dict[tuple[int, int], int] = {}  # where the last occurrence ends
            for a, d in zip(at.tolist(), doc.tolist(), strict=True):
                k = int(low[a])
                while k < len(hashes) and hashes[k] == h[a]:
                    item = int(numbers[k])
                    if a >= done.get((d, item), 0) and np.array_equal(c[a : a + m], codes(self.texts[item])):
                        done[d, item] = a + m
                        yield d, item, a - int(starts[d])
                    k += 1

    def hits(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in text, item, place in item) of every shared q-gram."""
        h = grams(c)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        real = self.grams[k] == h[at]
        at, k = at[real], k[real]
        n = self.count[k]
        offsets = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[k], n)
        return np.repeat(at, n), self.owner[offsets], self.place[offsets]


def matches(items: Items, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(number of the text, number of the item, start, end, distance) of every region that matches: of regions of
    one pair that overlap the best one, the leftmost of equals."""
    joined = codes("\x00".join(texts))
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    for d, i, start in items.whole(joined, starts):
        yield d, i, start, start + len(items.texts[i]), 0
    if not len(items.grams):
        return
    at, item, place = items.hits(joined)
    if not len(at):
        return
    half = items.half[item]
    least = items.least[item]
    diagonal = at - place + (1 << 20)
    doc = np.searchsorted(starts, at, "right") - 1
    regions: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
    seen: set[tuple[int, int, int]] = set()
    for shift in (0, 1):  # bands of 2 * half, each overlapping the next by half
        band = (diagonal // half + shift) // 2
        key = (doc * len(items.ids) + item) * (int(band.max()) + 1) + band
        _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        for f in first[count >= least[first]].tolist():
            d, i = int(doc[f]), int(item[f])
            h = int(half[f])
            low = (2 * int(band[f]) - shift) * h - (1 << 20) - int(starts[d])
            if (d, i, low) in seen:
                continue
            seen.add((d, i, low))
            e = int(items.edits[i])
            found = aligned(items.texts[i], texts[d], low - e, low + 2 * h + e, e)
            if found:
                regions.setdefault((d, i), set()).add(found)
    for (d, i), all_found in sorted(regions.items()):
        starts, kept = [], []
        for distance, start, end in sorted(all_found):
            # Matches that begin or end in one another are one region, seen through neighbouring bands.
            k = bisect(starts, start)
            if (k == 0 or kept[k - 1][1] <= start) and (k == len(kept) or end <= starts[k]):
                starts.insert(k, start)
                kept.insert(k, (start, end, distance))
        for region in kept:
            yield d, i, *region


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = [normalised(x.decode("utf-8", "replace")) for x in text_bytes(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(texts, pa.string())], ["item_id", "text"])


def blocks(benchmark: DataFrame, limit: int = BLOCK) -> tuple[str, int]:
    """Writes the distinct normalised items, the smallest item_id for each text, as a table of blocks of about
    ``limit`` characters: its place and the number of blocks."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_normal, "item_id long, text string")
    items = written(items.where("text <> ''").groupBy("text").agg(F.min("item_id").alias("item_id")), "items")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    number = -(-size // limit)
    path = work_path(spark, "blocks")
    if number:
        items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(number))).repartition(min(number, partitions(spark)), "block").write.partitionBy("block").parquet(path)
    return path, number


def block_items(path: str, block: int, error: float) -> Items:
    """The items of one block; a worker process holds the last one it used while the stage lasts."""

    def read() -> Items:
        fs, base = filesystem(f"{path}/block={block}")
        files = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        rows: list[tuple[int, str]] = []
        for f in sorted(x.path for x in files if x.path.endswith(".parquet")):
            rows += zip(*pq.read_table(f, filesystem=fs, columns=["item_id", "text"]).to_pydict().values(), strict=True)
        return Items(sorted(rows, key=lambda r: (r[0] is None, r)), error)

    return held(("items", path, block, error), read)


def _search(path: str, block: int, error: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "item_id", "start", "end", "distance"]
    for b in slices(batches, limit=SLICE):
        items = block_items(path, block, error)
        texts = [normalised(x.decode("utf-8", "replace")) for x in text_bytes(b.column("text"))]
        docs = b.column("doc_id").to_pylist()
        found = [(docs[d], items.ids[i], s, e, n) for d, i, s, e, n in matches(items, texts)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)


def find_contamination(docs: DataFrame, benchmark: DataFrame, error: float = ERROR, limit: int = BLOCK) -> DataFrame:
    """A row for each region of a document that matches a benchmark item: doc_id, item_id, start, end (code points
    of the normalised text), distance (edits). Of overlapping regions of one item the best counts.

    Every whole text is searched for every item. Items with the same normalised text count once, under
    the smallest item_id; items of less than Q characters match without edits;
    empty and null items match nothing, and neither do null texts. Repeated rows
    each give their matches; other columns are ignored; empty tables give no rows. The benchmark (a
    stated query set) is taken in blocks of about ``limit`` characters, so what a task holds does not grow with it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, start long, end long, distance long"
    path, number = blocks(benchmark, limit)
    out = spark.createDataFrame([], schema)
    for k in range(number):
        found = rows.mapInArrow(partial(_search, path, k, error), schema)
        out = found if k == 0 else out.unionByName(found)
    return out


def _clean(path: str, block: int, error: float, texts: list[bytes]) -> list[bool]:
    found = {x[0] for x in matches(block_items(path, block, error), [normalised(t.decode("utf-8", "replace")) for t in texts])}
    return [k not in found for k in range(len(texts))]


def decontaminate(docs: DataFrame, benchmark: DataFrame, error: float = ERROR, limit: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` (with all their columns) that hold no benchmark item. Each row is judged by its own
    text where it lies: nothing is shuffled. Null texts hold none; items as in ``find_contamination``."""
    path, number = blocks(benchmark, limit)
    for k in range(number):
        docs = where_texts(docs, partial(_clean, path, k, error), SLICE)
    return docs
