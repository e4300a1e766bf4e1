"""An append-only store of Parquet tables with one atomic commit for each crawl.

A crawl's rows go to folders that readers don't list. The commit is the rename
of one manifest file that names those folders: before it nothing of the crawl
is visible, after it all of it is. Writers take turns by an exclusively
created lock file.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaybook.sources.schemas import TABLES, VERSION


class StoreBusy(RuntimeError):
    """Another writer holds the store."""


class Store:
    """Tables under a folder of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    def _write(self, path: str, text: str, overwrite: bool) -> None:
        out = self._fs.create(self._path(path), overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    @contextmanager
    def writer(self):
        """Exclusive right to write; raises ``StoreBusy`` at once if another has it."""
        lock = f"{self.root}/lock"
        try:
            self._write(lock, str(uuid.uuid4()), False)
        except Exception as e:
            if self._fs.exists(self._path(lock)):
                raise StoreBusy(self.root) from e
            raise
        try:
            yield self
        finally:
            self._fs.delete(self._path(lock), False)

    def manifests(self) -> list[dict]:
        """Committed manifests, oldest first; a store of another version is refused."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest")))
        out = []
        for name in (n for n in names if n.endswith(".json")):
            stream = self._fs.open(self._path(f"{self.root}/manifest/{name}"))
            try:
                found = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            if found["version"] != VERSION:
                raise ValueError(f"{name}: store version {found['version']}, this code reads {VERSION}")
            out.append(found)
        return out

    def next_crawl(self) -> int:
        return 1 + max((m["crawl_id"] for m in self.manifests()), default=0)

    def commit(self, crawl_id: int, tables: dict[str, DataFrame]) -> None:
        """Write all tables of a crawl, then make them visible together. Repeating a committed crawl changes nothing."""
        if any(m["crawl_id"] == crawl_id for m in self.manifests()):
            return
        folders = {}
        for name, df in tables.items():
            wanted = self.spark.createDataFrame([], TABLES[name]).schema
            rows = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
            folders[name] = f"{name}/crawl={crawl_id}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{folders[name]}")
        text = json.dumps({"version": VERSION, "crawl_id": crawl_id, "folders": folders})
        hidden, final = f"{self.root}/manifest/.{crawl_id:012d}", f"{self.root}/manifest/{crawl_id:012d}.json"
        self._write(hidden, text, True)
        if not self._fs.rename(self._path(hidden), self._path(final)):
            raise RuntimeError(f"crawl {crawl_id} could not be committed")

    def table(self, name: str) -> DataFrame:
        """All committed rows of a table."""
        folders = [f"{self.root}/{m['folders'][name]}" for m in self.manifests() if name in m["folders"]]
        reader = self.spark.read.schema(TABLES[name])
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], TABLES[name])

    def latest(self, name: str, key: list[str], order: str) -> DataFrame:
        """Latest row of each key: what an upsert would have left."""
        newest = Window.partitionBy(*key).orderBy(F.col(order).desc())
        return self.table(name).withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")

    def vantage(self) -> DataFrame:
        """Each resource's last known provider: a sweep that did not complete adopts none, and leaves the old one."""
        known = Window.partitionBy("adapter_id", "resource_id").orderBy("crawl_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return self.table("resource").select("adapter_id", "resource_id", F.last("provider_id", ignorenulls=True).over(known).alias("provider_id")).distinct()
