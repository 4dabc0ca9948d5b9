"""Folders on whatever file system a path names: the few calls that sinks need besides reading and writing rows."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder in one step; False where the target is there already."""
    fs, p = _at(spark, source)
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    if fs.exists(to):
        return False
    fs.mkdirs(to.getParent())
    return fs.rename(p, to)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written aside and renamed, so a reader sees a whole text or none."""
    folder, _, _ = path.rpartition("/")
    fs, aside = _at(spark, f"{folder}/_{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    remove(spark, path)
    move(spark, str(aside), path)


class Ledger:
    """One small text a batch, of which the last few are kept: what a job has to know of the batches before."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        self.spark, self.path, self.keep = spark, path, keep

    def batches(self) -> list[int]:
        return sorted(int(n[2:]) for n in children(self.spark, self.path) if n.startswith("v="))

    def get(self, below: int | None = None) -> str | None:
        """The text of the last batch before ``below``, or of the last one."""
        done = [b for b in self.batches() if below is None or b < below]
        if not done:
            return None
        return read_text(self.spark, f"{self.path}/v={done[-1]}")

    def put(self, batch: int, text: str) -> None:
        write_text(self.spark, f"{self.path}/v={batch}", text)
        for old in [b for b in self.batches() if b <= batch][: -self.keep]:
            remove(self.spark, f"{self.path}/v={old}")
