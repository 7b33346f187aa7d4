"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How many characters of text one step of a Python worker holds at a time.
SLICE_CHARS = 1_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset and the master is local a temporary folder is made and set once; on a
    cluster, whose machines don't share such a folder, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="echofold-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/echofold/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A staged table of at most so many bytes (by its rows and the lengths of its texts) is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 20_000_000


def few(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if one aggregation shows that they are small."""
    wide = [F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)) for f in ids.schema if f.dataType.simpleString() in ("string", "binary")]
    n, *lengths = ids.agg(F.count(F.lit(1)), *wide).first()
    size = n * 8 * len(ids.schema) + sum(lengths)
    return F.broadcast(ids) if size <= BROADCAST_BYTES else ids


def spare_name(df: DataFrame, name: str) -> str:
    """name, or it with as many underscores before it as keep it apart from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def commonest(counts: DataFrame, c: str, n: int) -> DataFrame:
    """The rows of the largest counts, at most n in all: those at or above a bound that a histogram gives.

    Rows that tie at the edge are left out together.  The histogram has at most some 60,000 rows, and no
    task sends more than what is kept.
    """
    level = F.when(F.col(c) < 1024, F.col(c)).otherwise(F.floor(F.log2(c) * 1024)).cast("bigint")
    rows = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, bound = 0, None
    for value, some in rows:
        total += some
        if total > n:
            break
        bound = value
    return counts.where(F.lit(False) if bound is None else level >= bound)


def slices(batch: pa.RecordBatch, text: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice stay near so many bytes; a longer text stands alone."""
    lengths = [n or 0 for n in pc.binary_length(batch.column(text)).to_pylist()]
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def small_batches(df: DataFrame) -> DataFrame:
    """df; where the session has the default of 64 MB a batch, batches for Python are of 4 MB from here on.

    A batch is held several times over, in the JVM and the worker, by each task of an executor.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, "67108864b") == "67108864b":
        conf.set(_BATCH, "4194304b")
    return df


def give_back() -> None:
    """Return freed memory to the system, which else stays with an idle worker."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def by_slice(make: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text", chars: int = SLICE_CHARS):
    """A mapInArrow function that applies make to bounded slices of each batch."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, chars):
                out = make(part)
                if out is not None and out.num_rows:
                    yield out
        give_back()

    return run
