"""What the operators share: the shared work folder, written tables, packing and text rules."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir

Held = TypeVar("Held")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    ship(spark)
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What the operators ask of Arrow batches where the session does not say: bounded bytes, as texts can be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches where it has no setting of its own, and sends this package to the
    executors where neither PYTHONPATH nor the working folder has it."""
    for name, value in BATCHES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    on_path = os.environ.get("PYTHONPATH", "").split(":")
    if root in map(os.path.abspath, filter(None, on_path)) or os.path.abspath(os.getcwd()) == root:
        return
    if getattr(spark.sparkContext, "_skerry_shipped", False):
        return
    import shutil

    at = tempfile.mkdtemp(prefix="skerry-zip-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{at}/skerry", "zip", root, "skerry"))
    spark.sparkContext._skerry_shipped = True


def row_id(docs: DataFrame) -> Column:
    """A 64-bit hash of doc_id and text: rows share it only if they are equal in both (or hashes collide), so
    what follows from a text holds for all of them."""
    return F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.coalesce(docs["text"].cast("string"), F.lit("")))


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: doc_id where one text alone has it; rows without a doc_id,
    and all but one of the texts that share one, have a hash of both beyond 2 ** 62 in its place."""
    key = f"_row_{uuid.uuid4().hex[:8]}"
    text = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    other = F.lit(1 << 62) + F.pmod(row_id(docs), F.lit(1 << 62))
    texts = docs.select(docs["doc_id"].cast("long").alias("named"), text.alias("text")).where("named is not null").distinct()
    shared = written(texts.groupBy("named").agg(F.min("text").alias("own"), F.count(F.lit(1)).alias("n")).where("n > 1").select("named", "own"), "shared-ids")
    if not shared.limit(1).count():
        return docs.withColumn(key, F.coalesce(docs["doc_id"].cast("long"), other)), key
    rows = docs.join(shared, docs["doc_id"].cast("long") == shared["named"], "left")
    named = F.when(shared["own"].isNull() | (shared["own"] == text), docs["doc_id"].cast("long"))
    return rows.select(*(docs[c] for c in docs.columns), F.coalesce(named, other).alias(key)), key


def where_texts(docs: DataFrame, stays: Callable[[list[bytes]], Iterable[bool]], limit: int = 1 << 20) -> DataFrame:
    """The rows of ``docs`` whose text (null as empty) passes; whole texts in slices of about ``limit`` bytes,
    nothing is shuffled."""
    at = docs.columns.index("text")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices([b], at, limit):
                yield part.filter(pa.array(stays(text_bytes(part.column(at))), pa.bool_()))

    return docs.mapInArrow(over, docs.schema)


def spread_join(rows: DataFrame, values: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` left-joined with ``values``, that has one row for each ``key``, without a task that gets all
    rows of one key: they are dealt by the key and a hash of ``by`` into as many parts as there are partitions."""
    part = F.pmod(F.xxhash64(F.col(by)), F.lit(partitions(rows.sparkSession)))
    rows = rows.withColumn("_part", part)
    places = rows.select(key, "_part").distinct().join(values, key)
    return rows.join(places, [key, "_part"], "left").drop("_part")


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partition count."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """pyarrow's file system of a URI (file, hdfs, s3, gs), and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else re.sub(r"^(file:)?/+", "file:///", uri))


def text_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_HELD: dict[object, object] = {}
_HELD_FOR: int | None = None


def held(key: object, make: Callable[[], Held]) -> Held:
    """What ``make`` gives. A worker process keeps the last such object for the tasks of a stage, and until a
    task of another stage needs something else."""
    global _HELD_FOR
    task = TaskContext.get()
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    _HELD_FOR = task.stageId() if task is not None else None
    return _HELD[key]


def let_go() -> None:
    """Drops what this process holds; workers live on from stage to stage, so its memory goes back to the machine."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.system_memory_pool().release_unused()


def slices(batches: Iterable[pa.RecordBatch], column: str | int = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` holds about ``limit`` bytes in each; bounds Python's memory. In a worker
    it also drops what tasks of other stages have left there."""
    task = TaskContext.get()
    if task is not None:  # in a worker: memory that is free goes back to the machine
        pa.set_memory_pool(pa.system_memory_pool())
        if task.stageId() != _HELD_FOR:
            let_go()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        each = max(1, int(limit / max(1, batch.column(column).nbytes / n)))
        for at in range(0, n, each):
            yield batch.slice(at, each)
