"""What the operators of this subpackage share: stage tables, text expressions, Arrow helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Temporary folders of local applications that name no shared one. Executors of ``local[n]`` are this machine.
_MADE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    name = spark.sparkContext.applicationId
    if name not in _MADE:
        _MADE[name] = "file://" + tempfile.mkdtemp(prefix="geoloom-")
    return _MADE[name]


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000):
    """While a stage table is written, Arrow batches have so many rows at most: texts and blobs are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before) if int(before) > 0 else rows)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Stages:
    """Tables written between the stages of one operator; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.kept: list[str] = []

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        with small_batches(self.spark):
            out = df.write.option("compression", "zstd")
            (out.partitionBy(by) if by else out).parquet(path)
        self.kept.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that later stages no longer read, and lets the JVM free their shuffle files."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.sweep()

    def drop_all_but(self, *names: str) -> None:
        self.drop(*(x for x in self.kept if x not in names))

    def sweep(self) -> None:
        self.spark.sparkContext._jvm.System.gc()


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def utf8(col: str = "text") -> Column:
    """The text's UTF-8 bytes; a null text has none."""
    return F.encode(whole_text(col), "utf-8")


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with state that ``make`` builds once per task."""

    def run(batches):
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, col: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of ``col``; a longer row makes a slice of its own."""
    lengths = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(col)]
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
