"""Folders that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str = "run") -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``; under one of our own only where that is unset, as in tests."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear, spark)
    _made.append(path)
    return path


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The same rows, computed once and read from files in the shared folder."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


_made: list[str] = []


def _clear(spark: SparkSession) -> None:
    """When the driver ends, its folders go, as far as there still is a JVM to delete them."""
    try:
        conf = spark._jvm.org.apache.hadoop.conf.Configuration()
        for path in _made:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM or the folder may be gone
        pass




def shared(spark: SparkSession) -> str:
    """The setting's folder, else the one given to ``setCheckpointDir``; a folder of this machine only where executors are in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own()


@functools.lru_cache(maxsize=1)
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="rillflow-")
