"""Versioned tables: a version is written beside the old ones, then a pointer is switched.

Spark can't overwrite a path that it is reading; and readers of an old version
keep it. All files go through Hadoop's file systems, so any store that Spark
reads will do.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from gridsmith.functions.scalar import fingerprint


def shared_folder(spark: SparkSession) -> str:
    """A folder that all machines see: the one of spark.checkpoint.dir, one of our own only on a single machine that names none."""
    context = spark.sparkContext
    set_dir = context._jsc.sc().getCheckpointDir()
    named = set_dir.get() if set_dir.isDefined() else context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{(named or f'file:///tmp/checkpoints/{os.getuid()}').rstrip('/')}/gridsmith"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def put(self, path: str, text: str | bytes) -> None:
        """Written under another name and renamed over the old one in one step: readers see the old text or the new, also after a crash."""
        new = f"{path}.new"
        out = self._fs(path).create(self._path(new), True)
        try:
            out.write(bytearray(text.encode() if isinstance(text, str) else text))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path(new), self._path(path), options)

    def get(self, path: str) -> str | None:
        if not self.exists(path):
            return None
        stream = self._fs(path).open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_table(self, name: str, frame: DataFrame, facts: Mapping, partition_by: tuple[str, ...] = ()) -> str:
        """Writes the version that facts fingerprint, points the table at it and returns its path. Zero rows keep their columns."""
        mark = fingerprint(facts)
        path = f"{self.root}/{name}/version={mark}"
        frame.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
        self.put(f"{self.root}/{name}/current.json", json.dumps({"version": mark, "facts": dict(facts)}, sort_keys=True))
        return path

    def pointer(self, name: str) -> dict | None:
        """The pointer, or None where it is missing or corrupt."""
        try:
            return json.loads(self.get(f"{self.root}/{name}/current.json") or "null")
        except ValueError:
            return None

    def current(self, name: str, facts: Mapping) -> bool:
        """Whether the table is of these very facts."""
        at = self.pointer(name)
        return bool(at) and at.get("version") == fingerprint(facts) and self.exists(f"{self.root}/{name}/version={at['version']}")

    def read_table(self, name: str) -> DataFrame:
        at = self.pointer(name)
        if not at:
            raise FileNotFoundError(f"table {name} has no current version under {self.root}")
        return self.spark.read.parquet(f"{self.root}/{name}/version={at['version']}")

    def ensure(self, name: str, facts: Mapping, make, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """The current table, made anew if its facts have changed."""
        if not self.current(name, facts):
            self.write_table(name, make(), facts, partition_by)
        return self.read_table(name)

    def require(self, *names: str) -> None:
        missing = [n for n in names if not self.pointer(n)]
        if missing:
            raise FileNotFoundError(f"missing tables: {', '.join(missing)}")

    def write_report(self, name: str, report: Mapping) -> None:
        self.put(f"{self.root}/reports/{name}.json", json.dumps(report, indent=2, sort_keys=True))
