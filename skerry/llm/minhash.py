"""Near-duplicate components by bottom-k sketches of one hash function.

A document's set is hashed once; the k smallest hashes are its sketch. Runs of neighbouring retained
values (four in a row, fewer for small sets) are the terms of inverted lists, so that two documents
meet in a list only where their sketches overlap. At a similarity of 0.8 a union sketch of 64 values
is without a common run of four with a probability of about 0.8 ** 64 < 1e-6; sets that the sketch
holds whole always have one. Documents with the same set form a class first, and its smallest doc_id stands for it.

Pairs are not made out of whole lists. A link takes two steps:

1. In each list every member meets the list's head, the member whose own lists are the longest in all
   (the text that the others were copied from, as a rule). Union sketches estimate the similarity of
   such a pair, and the exact Jaccard of the full sets confirms a link.
2. What the links leave apart is looked for among the lists of one head. With D(x) the symmetric
   difference of the sets of member x and head, two members differ by |D(x)| + |D(y)| - 2 |D(x) & D(y)|
   shingles, so a link of members that are not both linked to the head takes a number of common
   differences that their sizes tell. Differences are put in the order of how many members have them,
   rarest first; the first common one of a linked pair stands early enough in both for the rest to hold
   that number, and only pairs that meet in such a place are candidates. Edits that members made on
   their own are in one difference alone and make none. Candidates go through sketches and the exact
   check like the pairs of step 1.

Both steps take every pair of a list into account, so no link between components is lost, and a group
of thousands of copies costs one comparison for each member and head.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, slices, spread_join, text_bytes, with_row, written

K = 64
#: A pair is dropped unread if its estimate is this many standard deviations below the threshold.
DEVIATIONS = 5.0
#: Members that one group of the exact check holds; larger groups are split, with their leader in each part.
SPLIT = 256
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * C
    h = (h ^ (h >> np.uint64(29))) * A
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (int64) of each text; with fewer words than ``width`` the whole
    sequence is one shingle; no words, no shingles. bytes.lower and bytes.split know ASCII alone."""
    split = [t.lower().split() for t in texts]
    distinct = list(set().union(*split))
    number = dict(zip(distinct, range(len(distinct)), strict=True))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    out = []
    for words in split:
        n = len(words)
        if not n:
            out.append(np.zeros(0, np.int64))
            continue
        h = hashes[np.fromiter(map(number.__getitem__, words), np.int64, n)]
        w = min(width, n)
        s = np.full(n - w + 1, np.uint64(w), np.uint64)
        for k in range(w):
            s = mixed(s * B + h[k : n - w + 1 + k])
        out.append(np.unique(s.view(np.int64)))
    return out


def _sketches(width: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = shingle_sets(text_bytes(b.column("text")), width)
        sizes = pa.array([len(s) for s in sets], pa.int64())
        prints = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
        kept = [s[:k] for s in sets]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
        sketch = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, prints, sketch], ["doc_id", "n_shingles", "print", "sketch"])


def _sets(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = shingle_sets(text_bytes(b.column("text")), width)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("part"), b.column("b"), pa.array([s.tobytes() for s in sets], pa.binary())], ["a", "part", "b", "set"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (a, part, b), the set of a itself (b is null) first in each part."""
    at, leader = None, None
    for batch in batches:
        out, differ = [], []
        for a, part, b, data in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "set")), strict=True):
            own = np.frombuffer(data, np.int64)
            if b is None:
                at, leader = (a, part), own
            elif at == (a, part):
                apart = np.setxor1d(leader, own, assume_unique=True)
                either = (len(leader) + len(own) + len(apart)) // 2
                out.append((a, b, either - len(apart), either))
                differ.append(apart)
        if out:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(differ, pa.list_(pa.int64()))], ["a", "b", "both", "either", "differ"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b): the smallest node that each reaches.

    Labels go along the edges and jump to the label of their label, so long chains take a logarithmic
    number of rounds; every round is a written table.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        stepped = labels.join(seen, "node", "left").select("node", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        new = written(stepped, "labels")
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = written(new.join(jump, "component", "left").select("node", F.coalesce(F.least("component", "further"), "component").alias("component"), "before"), "labels")
        changed = jumped.where("component <> before").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels


def _confirmed(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(a, b, both, either, differ) of the full sets: sizes of intersection and union, and the members of one
    of the two alone. Groups of one leader are split into parts of bounded size."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts"))
    members = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    leaders = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    wanted = members.unionByName(leaders).withColumn("doc_id", F.coalesce("b", "a"))
    # Texts are streamed past the wanted numbers, not sorted.
    rows = docs.join(wanted.hint("shuffle_hash"), "doc_id").select("a", "part", "b", "text")
    sets = rows.mapInArrow(partial(_sets, width), "a long, part int, b long, set binary")
    n = partitions(docs.sparkSession)
    return sets.repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(_compared, "a long, b long, both long, either long, differ array<long>")


def _met(families: DataFrame, differ: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of step 2. ``families``: head, size (of its set), rep, n, component; ``differ``:
    (a, b, differ) of all heads and members.

    With c = (100 - percent) / (100 + percent), x and y are linked if they differ by c (|x| + |y|) at most,
    so |D(x) & D(y)| is (|D(x)| + |D(y)| - c (|x| + |y|)) / 2 at least. All tests are in whole numbers."""
    more, less = F.lit(100 + percent), F.lit(100 - percent)
    rows = families.join(differ.select(F.col("a").alias("head"), F.col("b").alias("rep"), "differ"), ["head", "rep"])
    elements = written(rows.select("head", "rep", F.explode("differ").alias("element")), "differences")
    often = elements.groupBy("head", "element").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    # What no other member has comes first in the order, and needs no place of its own.
    ordered = elements.join(often, ["head", "element"]).groupBy("head", "rep").agg(F.sort_array(F.collect_list(F.struct("times", "element"))).alias("common"))
    rows = rows.join(ordered, ["head", "rep"]).withColumn("d", F.size("differ").cast("long"))
    rows = rows.withColumn("alone", more * F.col("d") > less * (F.col("n") + F.col("size")))  # not linked to the head
    spread = rows.select("head", "rep", "n", "size", "component", "d", "alone", F.size("common").alias("shared"), F.posexplode("common"))
    spread = spread.withColumn("rest", (F.col("shared") - F.col("pos")).cast("long"))  # this place and all behind it
    # The least that any partner asks for: of a member that is alone, (|D| - c (n + size)) / (1 + c).
    early = F.when(F.col("alone"), 200 * F.col("rest") >= more * F.col("d") - less * (F.col("n") + F.col("size"))).otherwise(
        2 * more * F.col("rest") >= more * F.col("d") + less * (F.col("size") - F.col("n"))
    )
    places = written(spread.where(early).select("head", F.col("col.element").alias("element"), "rep", "n", "d", "rest", "alone", "component"), "places")
    # Of the members in the commonest component of a place only those of other components are partners.
    main = places.groupBy("head", "element", "component").agg(F.count(F.lit(1)).alias("times"))
    main = main.groupBy("head", "element").agg(F.max(F.struct("times", "component")).alias("main"), F.count(F.lit(1)).alias("components"))
    places = places.join(main.where("components > 1").select("head", "element", F.col("main.component").alias("main")), ["head", "element"])
    others = places.where("component <> main").select("head", "element", *(F.col(c).alias(f"{c}1") for c in ("rep", "n", "d", "rest", "alone", "component")))
    fits = more * (2 * F.least("rest", "rest1") - F.col("d") - F.col("d1")) + less * (F.col("n") + F.col("n1")) >= 0
    close = 100 * F.least("n", "n1") >= percent * F.greatest("n", "n1")
    once = (F.col("component") == F.col("main")) | (F.col("rep") < F.col("rep1"))
    pairs = places.join(others, ["head", "element"]).where((F.col("component") != F.col("component1")) & (F.col("alone") | F.col("alone1")) & once & close & fits)
    return pairs.select(F.least("rep", "rep1").alias("a"), F.greatest("rep", "rep1").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    A-Z are lower-cased, words are what ASCII white space leaves, and a document's set holds its
    distinct shingles of ``width`` words (with fewer words the whole sequence). Documents with
    100 * |intersection| >= percent * |union| are linked; component_id is the smallest doc_id that a
    document reaches, and it is kept if that is its own. Null and empty texts have no shingles and no
    links. Rows that repeat a doc_id are one node (its texts should be equal) and come back each; a
    null doc_id links with nothing, has a null component and is kept. Other columns are ignored; an
    empty table gives no rows. ``percent`` below 80 raises the risk of a missed run; use a larger ``k``.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = written(docs.mapInArrow(partial(_sketches, width, k), "doc_id long, n_shingles long, print binary, sketch array<long>"), "sketches")
    linkable = F.col("print").isNotNull() & F.col("doc_id").isNotNull()
    classes = rows.where(linkable).groupBy("print").agg(F.min("doc_id").alias("rep"))
    named = spread_join(rows.where(linkable), classes, "print", "doc_id").select("doc_id", "rep", "n_shingles", F.when(F.col("doc_id") == F.col("rep"), F.col("sketch")).alias("sketch"))
    unlinked = rows.where(~linkable).select("doc_id", "n_shingles")
    rows = written(named, "classes")
    reps = rows.where("sketch is not null").select("rep", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["rep"])
    # Inverted lists, of two members at least. The kinds of runs overlap in sizes, so any two linked sets share
    # a kind; a union of more than 15 (5, 1) values of which 80 % are common has a common run of 4 (3, 2).
    runs = F.expr("""concat(
        if(n >= 16, transform(sequence(0, size(sketch) - 4), i -> xxhash64(sketch[i], sketch[i + 1], sketch[i + 2], sketch[i + 3])), array()),
        if(n between 6 and 19, transform(sequence(0, size(sketch) - 3), i -> xxhash64(sketch[i], sketch[i + 1], sketch[i + 2])), array()),
        if(n between 2 and 7, transform(sequence(0, size(sketch) - 2), i -> xxhash64(sketch[i], sketch[i + 1])), array()))""")
    postings = reps.select(F.explode(runs).alias("term"), "rep", "n")
    sizes = postings.groupBy("term").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    lists = written(postings.join(sizes, "term"), "lists")
    ids = written(lists.groupBy("rep").agg(F.sum("members").alias("score")), "members")
    sketches = written(reps.join(ids.select("rep"), "rep").select("rep", "sketch"), "member_sketches")
    texts = docs.join(ids.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    scored = lists.join(ids, "rep")
    heads = scored.groupBy("term").agg(F.max(F.struct("score", (-F.col("rep")).alias("order"), "rep", "n")).alias("head"))
    stars = lists.join(heads, "term").where(F.col("rep") != F.col("head.rep"))
    stars = written(stars.groupBy(F.col("head.rep").alias("head"), "rep").agg(F.first("head.n").alias("size"), F.first("n").alias("n")), "stars")
    floor = percent / 100 - DEVIATIONS * (percent / 100 * (1 - percent / 100) / k) ** 0.5

    def likely(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose union sketch does not exclude a link."""
        s, t = sketches.toDF("a", "sa"), sketches.toDF("b", "sb")
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
        common = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
        return pairs.join(s, "a").join(t, "b").where(common >= F.lit(floor) * F.size(union)).select("a", "b")

    confirmed = 100 * F.col("both") >= percent * F.col("either")
    close = 100 * F.least("n", "size") >= percent * F.greatest("n", "size")
    first = written(likely(stars.where(close).select(F.col("head").alias("a"), F.col("rep").alias("b"))), "pairs")
    checked = written(_confirmed(texts, first, width), "checked")
    labels = components(checked.where(confirmed).select("a", "b"))
    # Families of a head whose members are not all of its component: what may still be linked is in these.
    of = labels.select(F.col("node").alias("rep"), "component")
    placed = stars.join(of, "rep", "left").join(of.toDF("head", "over"), "head", "left")
    placed = written(placed.select("head", "size", "rep", "n", F.coalesce("component", "rep").alias("component"), F.coalesce("over", "head").alias("over")), "placed")
    mixed_heads = placed.groupBy("head").agg(F.count(F.lit(1)).alias("members"), F.max(F.col("component") != F.col("over")).alias("apart")).where("members > 1 AND apart").select("head")
    families = written(placed.join(mixed_heads, "head").drop("over"), "families")
    pairs = families.select(F.col("head").alias("a"), F.col("rep").alias("b"))
    rest = written(pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    differ = checked.select("a", "b", "differ").join(pairs, ["a", "b"], "left_semi").unionByName(_confirmed(texts, rest, width).select("a", "b", "differ"))
    second = written(likely(_met(families, written(differ, "differ"), percent)), "pairs")
    more = written(_confirmed(texts, second, width).where(confirmed).select("a", "b"), "links")
    if more.limit(1).count():
        # The components of step 1 are the nodes now.
        ends = more.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left")
        joined = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b"))
        lone = joined.join(labels.select("node"), "node", "left_anti")
        over = joined.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = labels.join(over, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
        labels = moved.unionByName(lone)
    linked = spread_join(rows, labels.toDF("rep", "component"), "rep", "doc_id").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    linked = linked.withColumn("kept", F.col("component_id") == F.col("doc_id"))
    return linked.unionByName(unlinked.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def without_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, but for those that are linked with a smaller doc_id.

    Every row is judged by its own text: a row without doc_id, or with one that rows of other texts have
    too, counts as a document of a larger id than all others (rows equal in both are judged as one)."""
    rows, key = with_row(docs)
    gone = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), width, percent).where("not kept").select(F.col("doc_id").alias("_copy")).distinct()
    gone = written(gone, "copies")  # a table, so that Spark knows its size: no text is shuffled where it is small
    return rows.join(gone, rows[key] == gone["_copy"], "left_anti").select(*docs.columns)
