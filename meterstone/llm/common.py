"""Shared helpers: staged tables, short fixed expressions, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word of the contracts, that is, anything between white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What Python workers are sent at once in ``small_batches``, in bytes; a longer row goes alone.
BATCH_BYTES = "4m"


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, from ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder, which it keeps;
    on a cluster the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="meterstone-work-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, split_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the work folder and read it back.

    Cuts the lineage: a lost executor costs no more than the tasks it ran. The
    table goes when the driver's JVM ends. With ``split_by`` the table is
    partitioned by that column.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    writer = df.write.option("compression", "zstd")
    if split_by:
        writer = writer.partitionBy(split_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """For jobs that run inside: Python workers get whole rows in batches of bounded bytes, not by their number alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(docs: DataFrame) -> Column:
    """All columns as one struct ``doc``, so that no helper column can clash with them."""
    return F.struct(*map(column, docs.columns)).alias("doc")


def unboxed(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` out of ``doc``, some of them changed."""
    return [changed.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns]


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucket_of(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; NULL for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % buckets


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an edge table: ``node``, ``component`` (its least node).

    Alternating large-star and small-star steps: every node passes its neighbours
    the least node it knows, so long chains halve each round. Each step is an
    aggregate and a join on the node; the edge table is staged between rounds, and
    only two sums reach the driver. Self links and repeated edges are harmless;
    NULL ends are ignored.
    """
    links = stage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    last = None
    for _ in range(rounds):
        # Large star: every larger neighbour links to the least neighbour.
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        # Small star: every smaller neighbour, and the node, link to the least.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        links = stage(
            large.join(small, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        mark = links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"no fixed point in {rounds} rounds")
    nodes = links.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select(F.col("u").alias("node"), "component").union(
        nodes.select(F.col("component").alias("node"), "component").distinct()
    )
