"""Shared plumbing: column picking, lineage cuts in the shared folder, size-checked joins."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is broadcast only below this many rows (of a few dozen bytes each).
BROADCAST_ROWS = 20_000
# Rows of two hashes, of which a broadcast holds more: some 16 MB.
BROADCAST_HASHES = 250_000

# Arrow batches of whole texts hold about this much; a batch is in memory several times, in the JVM and in Python.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.execution.arrow.maxRecordsPerBatch": "4000"}


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Select columns by exact name (``out=source``); the first exact match wins.

    Goes by position, so extra columns whose names differ only in case, or repeat, do no harm.
    """
    places = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(places))])
    missing = [source for source in wanted.values() if source not in places]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {places}")
    return flat.select(*[F.col(f"c{places.index(source)}").alias(out) for out, source in wanted.items()])


def tagged(df: DataFrame, **wanted: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """All columns under safe names, plus ``wanted`` copies; returns the frame and (safe, original) names."""
    names = [(f"in{i}", name) for i, name in enumerate(df.columns)]
    flat = df.toDF(*[safe for safe, _ in names])
    for out, source in wanted.items():
        flat = flat.withColumn(out, F.col(names[df.columns.index(source)][0]))
    return flat, names


def untagged(df: DataFrame, names: list[tuple[str, str]], *added: str) -> DataFrame:
    """Restore the original columns; a computed column replaces an input column of its name."""
    clash = {x.lower() for x in added}
    return df.select(*[F.col(safe).alias(name) for safe, name in names if name.lower() not in clash], *added)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; set here only where it is unset on a single machine.

    A cluster without that setting is an error: a folder of one machine is no place for tables that executors read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracewarden-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: ends the lineage and survives lost executors.

    The files are removed when the driver's JVM exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewarden/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove the files of tables that ``cut`` made and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.cut_path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(f):
    """Runs ``f(docs, ...)`` with Arrow batches of bounded bytes. The bounds stay set in the session, since plans that
    ``f`` returns run later; bounds that are already smaller stay as they are."""

    @functools.wraps(f)
    def run(docs: DataFrame, *args, **kwargs):
        conf = docs.sparkSession.conf
        for key, value in BATCH.items():
            if _number(conf.get(key)) <= 0 or _number(conf.get(key)) > _number(value):
                conf.set(key, value)
        return f(docs, *args, **kwargs)

    return run


def lean(run):
    """``run`` over the batches of a task; afterwards the worker, which goes on to other tasks, gives freed memory back."""

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can't trim
            ctypes.CDLL(None).malloc_trim(0)

    return task


def _number(value: str) -> int:
    digits = re.match(r"-?\d+", value)[0]
    return int(digits) << {"k": 10, "m": 20, "g": 30}.get(value[len(digits) : len(digits) + 1].lower(), 0)


def lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys``: broadcasts ``small`` only after counting it, else leaves a skew-split shuffle join."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, keys, how)


def row_hashes(columns: list[str]) -> list[F.Column]:
    """Two 64-bit hashes (row, row2) of a whole row."""
    return [F.xxhash64(*columns).alias("row"), F.xxhash64(F.lit(1), *columns).alias("row2")]


def text_key(column: str, null_last: bool = False) -> F.Column:
    """A non-null string form of a nullable string column; null differs from every text."""
    mark = "\U0010ffff\U0010ffff" if null_last else ""
    return F.when(F.col(column).isNull(), F.lit(mark)).otherwise(F.concat(F.lit("="), F.col(column)))
