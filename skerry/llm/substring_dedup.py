"""Substring dedup over prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of one document; a word goes if a window over it starts
anywhere else too. Indexing every suffix would multiply the corpus, so trees are built for the suffixes
that can have a deep internal node at all, in three steps:

1. Every window has an anchor, the smallest of the hashed ``PREFIX``-word sequences that start in it, so
   equal windows have equal anchors at the same offset. Anchors are dealt out by hash, and only those
   that occur again survive: a suffix tree has no node below an unrepeated prefix.
2. The suffixes of surviving anchors, with the words before them that windows of theirs reach, are dealt
   out by prefix into groups that fit in memory: by the anchor, and where an anchor has more runs than a
   group holds (the reduce side of step 1 counts them), by all ``WINDOW`` words, with the anchor and its
   offset. A map task sends one of equal runs, or of equal windows, only.
3. In each group the suffixes are ordered by prefix doubling. Neighbours in that order that agree to
   depth ``WINDOW`` are leaves below one internal node of the group's suffix tree of at least that depth:
   maximal repeats. Nothing above these nodes and nothing below them is built. A prefix of ``WINDOW`` words
   is such a node itself, and its leaves are counted. The windows go back to their documents, that are cut
   by them in the last step.

The number of groups' buckets follows from the bytes of all texts, so that what a task holds does not grow
with the input.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, slices, text_bytes, with_row

WINDOW = 35
SLICE = 6 << 20
#: Words of one group of suffixes that are ordered at a time.
GROUP = 400_000
#: Bytes of text for each bucket that prefixes are dealt into.
BUCKET = 32 << 20
P = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def pack(*arrays: np.ndarray) -> bytes:
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        out += [struct.pack("<2sQ", a.dtype.str[1:].encode(), a.nbytes), a.tobytes()]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<B", data), 1, []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sQ", data, at)
        out.append(np.frombuffer(data, "<" + kind.decode(), size // int(kind[1:]), at + 10))
        at += 10 + size
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, first word of each text and the end)."""
    split = [t.split() for t in texts]  # bytes.split knows space and \t..\r alone
    distinct = list(set().union(*split)) if split else []
    number = dict(zip(distinct, range(len(distinct)), strict=True))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
    index = np.empty(int(bounds[-1]), np.int64)
    for words, a, b in zip(split, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        index[a:b] = np.fromiter(map(number.__getitem__, words), np.int64, b - a)
    return hashes[index] if len(index) else np.zeros(0, np.uint64), bounds


def sequences(h: np.ndarray, length: int) -> np.ndarray:
    """The hash of the ``length`` words from each place on, in a logarithmic number of steps."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, power_of = None, 0, h, {1: int(P)}
    size, bits = 1, length
    while bits:
        if bits & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else out * np.uint64(power_of[size]) + part
            done += size
        bits >>= 1
        if bits:
            power = power[: len(power) - size] * np.uint64(power_of[size]) + power[size:]
            power_of[size * 2] = power_of[size] ** 2 & 0xFFFFFFFFFFFFFFFF
            size *= 2
    return mixed(out)


def runs(h: np.ndarray, bounds: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with a common anchor: (hash of the anchor, text, first window, windows), places
    counted in all texts together."""
    span = window - prefix + 1
    g = sequences(h, prefix)
    if len(g) < span:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    low, at, size = g, np.arange(len(g)), 1
    want = span
    # The leftmost minimum over ``span`` places, by doubling and one overlapping step.
    while size * 2 <= want:
        right = low[size:] < low[:-size]
        at = np.where(right, at[size:], at[:-size])
        low = np.where(right, low[size:], low[:-size])
        size *= 2
    if size < want:
        step = want - size
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(at)]
    real = np.arange(len(at)) + window <= bounds[1:][doc]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~real[:-1]
    first = np.flatnonzero(new & real)
    if not len(first):
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    total = np.add.reduceat(real.astype(np.int64), first)  # a run ends before the next, or where windows do
    return g[at[first]], doc[first], first, total


def _dealt(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of the keys of each bucket."""
    bucket = (keys >> np.uint64(32)) % np.uint64(n)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])


def _anchors(window: int, prefix: int, n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, map side. Of anchors that repeat within the slice one is dealt by hash; the others are known
    to survive and are spread evenly. The one dealt has the number of them, as far as 16 bits hold it."""
    for b in slices(batches, limit=SLICE):
        h, bounds = word_hashes(text_bytes(b.column("text")))
        key, text, first, count = runs(h, bounds, window, prefix)
        if not len(key):
            continue
        docs = b.column("row").to_numpy()[text]
        start = (first - bounds[text]).astype(np.int32)
        _, where, inverse, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        leads = np.zeros(len(key), bool)
        leads[where] = True
        spread = np.where(leads, key, mixed(docs.view(np.uint64) * P + start.astype(np.uint64)))
        total = np.where(leads, np.minimum(times[inverse], 0xFFFF), 0).astype(np.uint16)
        sure = (again & ~leads).astype(np.uint8) + (again & leads) * np.uint8(2)
        yield _blobs([(k, pack(key[i], docs[i], start[i], total[i], sure[i].astype(np.uint8))) for k, i in _dealt(spread, n)])


def _gathered(batches: Iterator[pa.RecordBatch]) -> list[bytes]:
    return [x for b in batches for x in b.column("blob").to_pylist()]


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, reduce side: the runs whose anchor occurs again."""
    blobs = _gathered(batches)
    if not blobs:
        return
    key, docs, start, _, sure = (np.concatenate(c) for c in zip(*map(unpack, blobs), strict=True))
    del blobs
    dealt = sure != 1
    _, inverse, times = np.unique(key[dealt], return_inverse=True, return_counts=True)
    keep = ~dealt
    keep[dealt] = (times[inverse] > 1) | (sure[dealt] == 2)
    at = np.flatnonzero(keep)
    for i in range(0, len(at), 100_000):
        j = at[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(key[j].view(np.int64)), pa.array(docs[j]), pa.array(start[j])], ["key", "row", "start"])


def _crowded(limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, reduce side: the anchors of more than ``limit`` runs."""
    blobs = _gathered(batches)
    if not blobs:
        return
    key, total = (np.concatenate(c) for c in zip(*((x[0], x[3]) for x in map(unpack, blobs)), strict=True))
    key, total = key[total > 0], total[total > 0]
    keys, inverse = np.unique(key, return_inverse=True)
    many = np.bincount(inverse, total, len(keys)) > limit
    yield pa.RecordBatch.from_arrays([pa.array(keys[many].view(np.int64))], ["crowd"])


def _suffixes(window: int, prefix: int, n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: the surviving runs of each document, with their words, dealt by prefix; those of crowded
    anchors (places given as -1 - place) as windows. Rows of one id share their places, so a place can be
    of both kinds, and is sent as both."""
    for b in slices(batches, limit=SLICE):
        kept = [i for i, x in enumerate(b.column("runs").is_valid().to_pylist()) if x]
        if not kept:
            continue
        b = b.take(pa.array(kept))
        h, bounds = word_hashes(text_bytes(b.column("text")))
        key, text, first, count = runs(h, bounds, window, prefix)
        docs = b.column("row").to_numpy()
        found = b.column("runs")
        flat = found.flatten()
        owner = np.repeat(np.arange(len(kept)), np.diff(found.offsets.to_numpy()))
        flat = flat.to_numpy(zero_copy_only=False).astype(np.int64)
        crowd = flat < 0
        places = np.where(crowd, -1 - flat, flat) + bounds[owner]
        rows = []
        live = np.isin(first, places[crowd])
        if live.any():
            rows += _windows(h, bounds, window, prefix, n, docs, key[live], text[live], first[live], count[live])
        live = np.isin(first, places[~crowd])
        key, text, first, count = key[live], text[live], first[live], count[live]
        if not len(key):
            if rows:
                yield _blobs(rows)
            continue
        # Equal runs of the slice: one is sent, and the windows of all are repeats already.
        whole = np.zeros(len(key), np.uint64)
        for c in np.unique(count).tolist():
            same = np.flatnonzero(count == c)
            whole[same] = sequences(h, c + window - 1)[first[same]] + np.uint64(c)
        _, lead, inverse, times = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[inverse] > 1)
        start = (first - bounds[text]).astype(np.int32)
        for k, i in _dealt(mixed(docs[text[again]].view(np.uint64) + start[again].astype(np.uint64)), n):
            i = again[i]
            rows.append((k, pack(docs[text[i]], start[i], (start[i] + count[i] + window - 1).astype(np.int32))))
        for k, i in _dealt(key[lead], n):
            i = lead[i]
            sizes = count[i] + window - 1
            words = h[np.repeat(first[i] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            names, codes = np.unique(words, return_inverse=True)
            rows.append((k, pack(key[i], docs[text[i]], start[i], count[i].astype(np.int16), names, codes.astype(np.uint16 if len(names) < 1 << 16 else np.uint32))))
        yield _blobs(rows)


def _windows(h: np.ndarray, bounds: np.ndarray, window: int, prefix: int, n: int, docs: np.ndarray, key: np.ndarray, text: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[tuple[int, bytes]]:
    """The windows of runs, dealt by their words: of equal windows of the slice one is sent, and all of
    them are repeats already. Equal windows have their anchor at the same offset, which is hashed too."""
    run = np.repeat(np.arange(len(key)), count)
    at = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    # The anchor is the leftmost of its hash in the window.
    g = sequences(h, prefix)
    offset = np.full(len(at), window - prefix)
    for d in range(window - prefix, -1, -1):
        offset[g[at + d] == key[run]] = d
    whole = mixed(sequences(h, window)[at] + offset.astype(np.uint64) * P)
    order = np.lexsort((whole, key[run]))
    new = np.ones(len(order), bool)
    new[1:] = (whole[order][1:] != whole[order][:-1]) | (key[run][order][1:] != key[run][order][:-1])
    times = np.diff(np.append(np.flatnonzero(new), len(order)))
    again = np.zeros(len(at), bool)
    again[order] = np.repeat(times > 1, times)
    doc, start = docs[text[run]], (at - bounds[text[run]]).astype(np.int32)
    lead, rows = order[new], []
    i = np.flatnonzero(again)
    if len(i):
        breaks = np.flatnonzero((np.diff(i) != 1) | (np.diff(run[i]) != 0))
        a, z = i[np.concatenate([[0], breaks + 1])], i[np.concatenate([breaks, [len(i) - 1]])]
        for k, j in _dealt(mixed(doc[a].view(np.uint64) + start[a].astype(np.uint64)), n):
            rows.append((k, pack(doc[a[j]], start[a[j]], (start[z[j]] + window).astype(np.int32))))
    for k, j in _dealt(whole[lead], n):
        j = lead[j]
        rows.append((k, pack(key[run[j]], whole[j], doc[j], start[j])))
    return rows


def _nodes(window: int, blobs: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The windows, of those of crowded anchors in one bucket, that several slices have."""
    key, whole, doc, start = map(np.concatenate, zip(*blobs, strict=True))
    order = np.lexsort((whole, key))
    same = (whole[order][1:] == whole[order][:-1]) & (key[order][1:] == key[order][:-1])
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    if out.any():
        yield _ranges(doc[out], start[out], start[out] + window)


def deep_nodes(words: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The internal nodes of depth ``window`` or more, and of less above them, of the suffix tree of the runs
    (``sizes`` words each, one behind the other): (suffixes in order, first and last leaf of each node in it).
    Suffixes of less than ``window`` words have no place in it.

    Prefix doubling: the rank of a suffix to depth 2 d follows from its ranks to depth d at its start and
    d words on. Suffixes of equal rank at depth ``window`` are the leaves below one node."""
    total = len(words)
    ends = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(total)
    real = place + window <= ends
    _, rank = np.unique(words, return_inverse=True)
    depth = 1
    while depth < window:
        step = min(depth, window - depth)  # the last step overlaps, as ranks to ``depth`` are known everywhere
        further = np.minimum(place + step, total - 1)
        pair = rank.astype(np.int64) * total + rank[further]
        _, rank = np.unique(pair, return_inverse=True)
        depth += step
    at = place[real]
    order = at[np.argsort(rank[at], kind="stable")]
    if not len(order):
        return order, order, order
    first = np.flatnonzero(np.append(True, rank[order[1:]] != rank[order[:-1]]))
    last = np.append(first[1:], len(order)) - 1
    inner = last > first
    return order, first[inner], last[inner]


def repeated_windows(words: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """Whether the window at each place of the runs starts at another place too: the leaves below deep nodes."""
    order, first, last = deep_nodes(words, sizes, window)
    below = np.zeros(len(order) + 1, np.int64)
    below[first] += 1
    below[last + 1] -= 1
    out = np.zeros(len(words), bool)
    out[order[np.cumsum(below[:-1]) > 0]] = True
    return out


def _trees(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: the repeats of one bucket of prefixes, as ranges of words."""
    keys, docs, starts, counts, words, nodes = [], [], [], [], [], []
    for blob in _gathered(batches):
        parts = unpack(blob)
        if len(parts) == 3:
            yield _ranges(*parts)
            continue
        if len(parts) == 4:
            nodes.append(parts)
            continue
        key, doc, start, count, names, codes = parts
        keys.append(key)
        docs.append(doc)
        starts.append(start)
        counts.append(count.astype(np.int64))
        words.append((names, codes))
    if nodes:
        yield from _nodes(window, nodes)
        del nodes
    if not keys:
        return
    key, doc, start, count = map(np.concatenate, (keys, docs, starts, counts))
    sizes = count + window - 1
    text = np.concatenate([names[codes] for names, codes in words])
    del words
    begin = np.cumsum(sizes) - sizes
    cuts = max(1, int(sizes.sum() // GROUP))
    group = mixed(key) % np.uint64(cuts)
    for g in range(cuts):
        i = np.flatnonzero(group == g)
        if len(i) < 2:
            continue
        size = sizes[i]
        local = np.cumsum(size) - size
        taken = text[np.repeat(begin[i] - local, size) + np.arange(size.sum())]
        again = repeated_windows(taken, size, window)
        at = np.flatnonzero(again)
        if not len(at):
            continue
        run = np.searchsorted(local, at, "right") - 1
        breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(run) != 0))
        first, last = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])]
        run = run[np.concatenate([[0], breaks + 1])]
        j = i[run]
        low = start[j] + (first - local[run])
        yield _ranges(doc[j], low, low + (last - first) + window)


def _ranges(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["row", "low", "high"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out = []
        for text, ranges in zip(text_bytes(b.column("text")), b.column("ranges").to_pylist(), strict=True):
            words = text.split()
            n = len(words)
            if ranges:
                gone = np.zeros(n + 1, np.int32)
                # Rows that share an id can be shorter than its ranges.
                np.add.at(gone, [min(r["low"], n) for r in ranges], 1)
                np.add.at(gone, [min(r["high"], n) for r in ranges], -1)
                stay = np.cumsum(gone[:n]) == 0
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            kept = b" ".join(words)
            out.append((n, n - len(words), kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True))
        arrays = [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_text, kept_sha256.

    Words are what ASCII white space leaves of a text, unchanged; kept_text has the kept ones with one
    space between. All windows are judged on the input. A null text has no words. Every row is a
    document of its own, also those without a doc_id or with one that others have. Other columns are ignored; an empty table gives no rows. Two
    different windows are taken for one only if 64-bit hashes of words collide.
    """
    size = docs.agg(F.sum(F.octet_length(docs["text"].cast("string")))).first()[0] or 0
    n = max(partitions(docs.sparkSession), -(-size // BUCKET))
    prefix = max(1, window - 15)
    docs, key = with_row(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")))
    docs = docs.withColumnRenamed(key, "row")
    dealt = docs.mapInArrow(partial(_anchors, window, prefix, n), "bucket int, blob binary").repartition(n, "bucket")
    crowded = dealt.mapInArrow(partial(_crowded, GROUP // (2 * window - prefix)), "crowd long")
    live = dealt.mapInArrow(_survivors, "key long, row long, start int")
    # An anchor in GROUP words or so can be crowded, so the list is short.
    live = live.join(F.broadcast(crowded), F.col("key") == F.col("crowd"), "left").select("row", F.when(F.col("crowd").isNull(), F.col("start")).otherwise(-1 - F.col("start")).alias("start"))
    live = live.groupBy("row").agg(F.collect_list("start").alias("runs"))
    # Both joins read the texts from the same exchange, so both take the same columns of it, and stream them past
    # the numbers of a bucket instead of sorting them.
    keyed = docs.repartition(n, "row")
    dealt = keyed.join(live.hint("shuffle_hash"), "row", "left").select("doc_id", "row", "text", "runs").mapInArrow(partial(_suffixes, window, prefix, n), "bucket int, blob binary")
    ranges = dealt.repartition(n, "bucket").mapInArrow(partial(_trees, window), "row long, low int, high int")
    ranges = ranges.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    return keyed.join(ranges.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "ranges").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
