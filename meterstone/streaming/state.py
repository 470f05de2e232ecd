"""State of a stream as tables: written per batch, read by key bucket, gathered while running."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BatchState:
    """The newest row of every key, under ``folder``.

    A batch adds the new state of the keys it touched, partitioned by a hash of the
    key, and reads the buckets that its keys fall into. Every ``gather`` batches the
    state of all batches before is gathered into one base; what a base covers is
    deleted when the next one stands, so a batch that is repeated still finds what
    lay before it.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        schema: T.StructType,
        keys: list[str],
        buckets: int = 32,
        gather: int = 20,
    ) -> None:
        self.spark, self.folder, self.schema, self.keys = spark, folder, schema, keys
        self.buckets, self.gather = buckets, gather

    def bucket(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def _numbers(self, kind: str) -> Iterator[int]:
        """Batch numbers of the finished tables of one kind."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        top = path(f"{self.folder}/{kind}")
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for entry in files.listStatus(top) if files.exists(top) else []:
            if files.exists(path(entry.getPath(), "_SUCCESS")):
                yield int(entry.getPath().getName())

    def _read(self, tables: list[str], buckets: list[int] | None) -> DataFrame:
        stored = T.StructType(
            [*self.schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())]
        )
        parts = self.spark.createDataFrame([], stored)
        for table in tables:
            rows = self.spark.read.schema(stored).parquet(f"{self.folder}/{table}")
            if buckets is not None:
                rows = rows.filter(F.col("bucket").isin(buckets))
            parts = parts.unionByName(rows)
        names = [f.name for f in self.schema if f.name not in self.keys]
        newest = parts.groupBy(*self.keys).agg(F.max_by(F.struct(*names, "batch"), "batch").alias("s"))
        return newest.select(*self.keys, *[F.col(f"s.{c}").alias(c) for c in (*names, "batch")])

    def _tables(self, number: int) -> tuple[list[str], int]:
        """Tables that hold the state before a batch: the last base and the batches after it."""
        base = max((n for n in self._numbers("base") if n < number), default=-1)
        later = sorted(n for n in self._numbers("batch") if base < n < number)
        return [f"base/{base}"] * (base >= 0) + [f"batch/{n}" for n in later], base

    def before(self, number: int, touched: DataFrame | None = None) -> DataFrame:
        """State of the keys before a batch; with ``touched`` of their buckets only."""
        # Bounded by the number of buckets.
        buckets = (
            None if touched is None else [r[0] for r in touched.select(self.bucket()).distinct().collect()]
        )
        return self._read(self._tables(number)[0], buckets).drop("batch")

    def put(self, number: int, rows: DataFrame) -> None:
        """Write what a batch leaves behind; a repeated batch replaces itself."""
        named = rows.select(*self.schema.fieldNames(), F.lit(number).cast("long").alias("batch"))
        self._write(named, f"batch/{number}")
        if number and number % self.gather == 0:
            self.compact(number)

    def _write(self, rows: DataFrame, table: str) -> None:
        # A bucket is one file or a few, however many tasks there were.
        split = rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
        # As one table: only that leaves the mark of a finished one.
        split.option("partitionOverwriteMode", "static").parquet(f"{self.folder}/{table}")

    def compact(self, number: int) -> None:
        """Gather the state before a batch, then delete what the base before covers."""
        tables, old = self._tables(number)
        if len(tables) < 2:
            return
        self._write(self._read(tables, None), f"base/{number - 1}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for kind in ("base", "batch"):
            for n in list(self._numbers(kind)):
                if n < old or (kind == "batch" and n <= old):
                    gone = path(f"{self.folder}/{kind}/{n}")
                    gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)
