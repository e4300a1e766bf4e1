"""Helpers shared by the training-data operators.

Executors and the driver share no local folder. Whatever one task writes and
another reads goes to the folder named by ``spark.checkpoint.dir``, through
Spark's own writers or through ``pyarrow.fs`` opened on that folder's URI.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Keys that hold more than this part of all rows are few enough to broadcast, whatever the table's size.
HOT = 256


def shared_dir(spark: SparkSession, name: str) -> str:
    """URI of a fresh, not yet created folder that all executors can reach.

    It lies in ``spark.checkpoint.dir`` or the session's checkpoint folder; in
    local mode, where one process does everything, a temporary folder serves.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base and context.master.split("[")[0] == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="assaybook-"))
        base = context.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, bucket_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives a lost executor.

    ``bucket_by`` lays the rows out by that column's hash, in as many buckets as
    shuffles have partitions, so that joins on it needn't move them again.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    if bucket_by:
        table = "bucketed_" + path.rsplit("-", 1)[1]
        df.write.option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), bucket_by).sortBy(bucket_by).saveAsTable(table)
        out = spark.table(table)
        out.schema  # resolved: the folder is known, and its name in the catalog is needed no more
        spark.sql(f"DROP TABLE {table}")
    else:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``stored`` that no later plan reads."""
    for df in tables:
        spark, at = df.sparkSession, getattr(df, "_stored_at", None)
        if at:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Equi-join of ``rows`` with ``table``, which has one row a key and in ``weight`` how many of ``rows`` have it.

    A key with more than 1 / ``HOT`` of the rows would make one task long. There
    are less than ``HOT`` such keys, so they are broadcast; the others are
    shuffled. ``how`` is inner or left; ``table`` should be stored, it is read twice.
    """
    least = (table.agg(F.sum(weight)).first()[0] or 0) / HOT
    hot, rest = table.filter(F.col(weight) > least).drop(weight), table.filter(F.col(weight) <= least).drop(weight)
    if hot.isEmpty():
        return rows.join(rest, keys, how)
    common = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return common.unionByName(others)


def filesystem(uri: str):
    """The pyarrow file system and path of a URI (or of a plain local path)."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, name: str, payload_writer) -> str:
    """Write a file under a temporary name and rename it, so that a retried task replaces, never mixes.

    ``payload_writer(stream)`` writes the bytes. Returns the final path's name.
    """
    system, root = filesystem(uri)
    system.create_dir(root, recursive=True)
    temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary, compression=None) as stream:
        payload_writer(stream)
    system.move(temporary, f"{root}/{name}")
    return name


def give_back() -> None:
    """Return memory that this process has freed to the system.

    Python workers wait for the next stage's tasks, which may need none of
    them: what they keep for themselves is missing elsewhere on the executor.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def tidy_map(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that gives memory back at the end of its task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """An ``applyInArrow`` function that gives memory back after each group of more than a megabyte."""

    def tidied(table: pa.Table) -> pa.Table:
        out, large = run(table), table.nbytes > 1 << 20
        if large:
            give_back()
        return out

    return tidied


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def utf8(text) -> bytes:
    """UTF-8 of a text; null is empty and a lone surrogate becomes a question mark."""
    return b"" if text is None else text.encode("utf-8", "replace")


_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (wraps modulo 2**64)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: One random 64-bit value for each byte, from the finaliser.
BYTE_VALUE = mix64(np.arange(256, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def text_bytes_total(df: DataFrame, column: str) -> int:
    """Bytes of text in all rows: sizes the number of groups, never which rows take part."""
    return int(df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0)
