"""What the operators share: folders for cut lineage, batches of rows, tables of a folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..folders import scratch
from ..workers import importable
from .wordtable import slices


FILE_BYTES, MOST_PARTS = 8 << 20, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, few: bool = False) -> DataFrame:
    """The same rows read from files in the shared folder: no lineage behind them, and nothing kept on executors.

    With ``few``, for tables derived from other cut ones, there are as many
    files as what it reads has megabytes, eight each, but not fewer than cores;
    texts are always read in the scan's own tasks.  The files stay until the
    driver ends, as a lost executor's tasks may read them at any time.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    if few:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        read = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
        parts = max(spark.sparkContext.defaultParallelism, -(-read // FILE_BYTES))
        df = df.coalesce(parts) if parts < MOST_PARTS else df
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows that hold whole texts go to Python in batches of few rows, so that buffers on both sides stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def _parts(it: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i, j in slices(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist(), most):
            yield batch.slice(i, j - i)


def filter_texts(df: DataFrame, keep: Callable[[list], np.ndarray], text: str = "text", most: int = 1_000_000) -> DataFrame:
    """The rows, with all their columns, whose texts ``keep`` marks; column names may clash or repeat."""
    importable(df.sparkSession)
    _small_batches(df.sparkSession)
    names = df.columns
    plain = [f"c{k}" for k in range(len(names))]
    first = plain[names.index(text)]
    order = [first, *(c for c in plain if c != first)]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(it, most):
            yield part.filter(pa.array(keep(part.column(0).to_pylist()), pa.bool_()))

    renamed = df.toDF(*plain).select(*order)
    return renamed.mapInArrow(batches, renamed.schema).select(*plain).toDF(*names)


def map_texts(df: DataFrame, run: Callable[[list, list[list]], pa.RecordBatch], schema: str, text: str = "text", most: int = 1_000_000) -> DataFrame:
    """``run(texts, other columns)`` over slices of about ``most`` characters of the partitions' rows.

    ``df`` has the text column first; the others follow in order.  Batches are
    cut by characters so that memory follows the longest text, not the rows.
    """
    importable(df.sparkSession)
    _small_batches(df.sparkSession)
    columns = [text, *(c for c in df.columns if c != text)]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(it, most):
            out = run(part.column(0).to_pylist(), [part.column(k) for k in range(1, part.num_columns)])
            if out.num_rows:
                yield out

    return df.select(*columns).mapInArrow(batches, schema)


class Rows:
    """A table's rows under column names of our own, so that none of its names can clash, with a number of their own in ``_row``.

    The number is the doc_id where that tells every row apart (``by_id``).
    Else the first row of each doc_id has that id, and repeated and null ids
    get numbers above all ids.
    """

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.plain = [f"c{k}" for k in range(len(self.names))]
        rows = docs.toDF(*self.plain)
        doc_id = F.col(self.of("doc_id")).cast("long")
        self.by_id = rows.groupBy(doc_id.alias("_id")).agg(F.count("*").alias("_n")).where("_id is null or _n > 1").isEmpty()
        if self.by_id:
            self.rows = rows.withColumn("_row", doc_id)
            return
        rows = cut(rows.withColumn("_at", F.monotonically_increasing_id()))  # kept in files, as numbers may change when computed again
        first = rows.where(doc_id.isNotNull()).groupBy(doc_id.alias("_id")).agg(F.min("_at").alias("_at"))
        above = rows.agg((F.coalesce(F.greatest(F.max(doc_id), F.lit(-1)), F.lit(-1)) + 1).alias("_above"))
        found = rows.join(first, "_at", "left").join(F.broadcast(above), F.lit(True))  # one row
        self.rows = found.withColumn("_row", F.coalesce("_id", F.col("_above") + F.col("_at"))).select(*self.plain, "_row")

    def of(self, name: str) -> str:
        return self.plain[self.names.index(name)]

    def documents(self, *names: str) -> DataFrame:
        """The rows' numbers as doc_id, and the named columns."""
        return self.rows.select(F.col("_row").alias("doc_id"), *[F.col(self.of(n)).alias(n) for n in names])

    def restored(self, rows: DataFrame) -> DataFrame:
        """Some of the rows with the table's columns alone, under their own names."""
        return rows.select(*self.plain).toDF(*self.names)


def smallest(rows: DataFrame, n: int, key: Column, *ties: str) -> DataFrame:
    """The ``n`` rows of smallest 64-bit hash ``key``, ties by the named columns.

    A bound on the hash, from the number of rows, leaves little more than ``n``
    rows to be sorted, however many tasks read the table.
    """
    total = rows.count()
    share = (n + 8 * n**0.5 + 100) / max(total, 1)
    if share < 1:
        some = rows.where(key < F.lit(int(share * 2**64) - 2**63))
        if some.limit(n).count() >= n:  # else equal ids were dealt unevenly
            rows = some
    return rows.orderBy(key, *ties).limit(n)


def ordered_documents(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else a table carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
