"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic scores.

Each whole text becomes a short vector of statistics (lengths, shares of kinds of characters, how much
repeats). Standardised, these pass through random Fourier features that approximate a Gaussian kernel;
every partition sums its part of the normal equations, the sums are added in two steps, and the driver
solves one system of fixed size. Raw scores of rows that the regression has not seen are counted in bins,
and pool-adjacent-violators over the bins gives a monotone map to a calibrated score between 0 and 1.
Neither labels nor doc_id, lang and source are inputs of a score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes, where_texts, written

FEATURES = 256
RIDGE = 1e-3
BINS = 1000
SEED = 20240101
FOLDS = 5
#: The fold held out of everything, and the one that calibrates.
HELD_OUT, CALIBRATES = 0, 4

CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (32,),
    "break": (9, 10, 11, 12, 13),
    "stop": b".,;:?'\"-()",
    "shout": b"!",
    "symbol": b"#$%&*+/<=>@[]\\^_`{|}~",
    "wide": range(128, 256),
    "control": [*range(9), *range(14, 32), 127],
}
MEMBERS = np.array([[b in set(members) for b in range(256)] for members in CLASSES.values()], np.float64).T
N_STATS = len(CLASSES) + 14


def statistics(text: bytes) -> list[float]:
    """Statistics of a whole text; all zeros for an empty one."""
    n = len(text)
    words = text.split()
    if not words:
        return [math.log1p(n)] + [0.0] * (N_STATS - 1)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = histogram[histogram > 0] / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    distinct = len(counts)
    m = len(words)
    letters = max(1.0, float(histogram[65:91].sum() + histogram[97:123].sum()))
    tail = Counter(w[-1] for w in words)
    return [
        math.log1p(n),
        *(histogram @ MEMBERS / n).tolist(),
        math.log1p(m),
        (n - m) / m,
        distinct / m,
        math.log(distinct) / math.log(m + 1),
        max(counts.values()) / m,
        len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        -float(shares @ np.log2(shares)),
        len(zlib.compress(text, 1)) / n,
        float(histogram[65:91].sum()) / letters,
        sum(tail[c] for c in b"#$%&*!@^~|<>") / m,
        sum(1 for w in words if len(w) > 24) / m,
        sum(map(eq, words, words[1:])) / m,
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = [statistics(t) for t in text_bytes(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    cuts: np.ndarray | None = None  # raw scores, ascending
    levels: np.ndarray | None = None  # calibrated scores at them
    base: float = 0.5

    def lifted(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features; the frequencies follow from the seed alone."""
        draw = np.random.default_rng(SEED)
        frequencies = draw.normal(size=(N_STATS, FEATURES)) / math.sqrt(N_STATS)
        phases = draw.uniform(0, 2 * math.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = math.sqrt(2 / FEATURES) * np.cos(x @ frequencies + phases)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.base)
        return np.clip(self.lifted(stats) @ self.weights, 0, 1)

    def scores(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        if self.cuts is None or not len(self.cuts):
            return raw
        return np.clip(np.interp(raw, self.cuts, self.levels), 0, 1)


def _normal(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's sums of z z' and z y, as one row."""
    d = FEATURES + 1
    total = np.zeros((d, d + 1))
    for b in slices(batches, "stats", 8 << 20):
        z = model.lifted(matrix(b.column("stats")))
        y = b.column("quality").to_numpy(zero_copy_only=False).astype(float)
        total += z.T @ np.hstack([z, y[:, None]])
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for raw in b.column("sums").to_pylist():
            part = np.frombuffer(raw)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _binned(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = model.raw(matrix(b.column("stats")))
        bins = np.minimum((raw * BINS).astype(np.int64), BINS - 1)
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(raw), b.column("quality")], ["bin", "raw", "quality"])


def _scored(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(matrix(b.column("stats"))))], ["doc_id", "score"])


def isotonic(x: list[float], y: list[float], weight: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean x and level of each pool, both ascending. Levels are pulled towards the
    middle by half a row on either side, so a score of 0 or 1 is never certain."""
    pools: list[list[float]] = []  # weighted x, weighted y, weight
    for a, b, w in zip(x, y, weight, strict=True):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Fits on all labelled rows outside the held-out fold: doc_id, stats; labels: doc_id, quality."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    truth = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    truth = truth.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    rows = stats.join(truth, "doc_id").withColumn("fold", fold).where(F.col("fold") != HELD_OUT)
    rows = written(rows.select("stats", "quality", "fold"), "labelled")
    train = rows.where(F.col("fold") != CALIBRATES)
    columns = [f(F.col("stats")[i]) for i in range(N_STATS) for f in (F.avg, F.stddev_pop)]
    *moments, n, mean = train.agg(*columns, F.count(F.lit(1)), F.avg("quality")).first()
    if not n:
        return Model(np.zeros(N_STATS), np.ones(N_STATS))
    model = Model(np.array(moments[::2]), np.maximum(np.array(moments[1::2]), 1e-6), base=float(mean))
    sums = train.select("stats", "quality").mapInArrow(partial(_normal, model), "sums binary")
    sums = sums.repartition(8).mapInArrow(_added, "sums binary").collect()  # eight rows at most, of fixed size
    total = sum(np.frombuffer(r.sums) for r in sums).reshape(FEATURES + 1, FEATURES + 2)
    gram = total[:, :-1] + RIDGE * n * np.diag([*np.full(FEATURES, 1.0 / FEATURES), 0.0]) + 1e-9 * np.eye(FEATURES + 1)
    weights = np.linalg.solve(gram, total[:, -1])
    model.weights = weights
    rest = rows.where(F.col("fold") == CALIBRATES).select("stats", "quality").mapInArrow(partial(_binned, model), "bin long, raw double, quality int")
    bins = rest.groupBy("bin").agg(F.avg("raw"), F.avg("quality"), F.count(F.lit(1))).orderBy("bin").collect()  # BINS rows at most
    if bins:
        model.cuts, model.levels = isotonic(*(list(map(float, c)) for c in list(zip(*bins, strict=True))[1:]))
    return model


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats of every whole text; a null text counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_statistics, "doc_id long, stats array<double>")


def score_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Learns from ``labels`` (doc_id, quality 0 or 1) outside the held-out fold (crc32 of the doc_id as text,
    modulo 5, is 0). Labels that are null or neither 0 nor 1 are ignored, and so are those of a doc_id whose
    labels differ; equal ones count once.
    Without labels every score is 0.5. Null, empty and very long texts are scored like any other; a null
    doc_id is scored and not held out; repeated rows each give a row; other columns are ignored.
    """
    stats = written(document_statistics(docs), "statistics")
    model = fit(stats, labels)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    return stats.mapInArrow(partial(_scored, model), "doc_id long, score double").select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does not reject, each judged by its
    own text. The model is fitted on statistics alone and then goes to the rows, that are filtered where they
    lie: no text is shuffled or stored. Nulls, repeats and empty cases as in ``score_quality``."""
    model = fit(written(document_statistics(docs), "statistics"), labels)
    return where_texts(docs, lambda texts: (model.scores(np.array([statistics(t) for t in texts])) >= least).tolist())
