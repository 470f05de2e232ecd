"""Changed-file detection.

A file counts as known only with the same size, modification time and price
version; everything else is read again as a whole. That covers appended,
truncated and rewritten files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterstone.sources.files import list_tree, mounted, read_listed
from meterstone.sources.logs import decoded_path, read_lines

MANIFEST = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("price_version", T.StringType()),
    ]
)
STAMP = ["file_path", "size", "modified", "price_version"]


def list_files(spark: SparkSession, root: str, glob: str, price_version: str) -> DataFrame:
    """Files below ``root`` with their stamp. Only metadata is read, no content."""
    path = mounted(spark, root)
    if path is not None:
        return list_tree(spark, path, glob).withColumn("price_version", F.lit(price_version))
    try:
        listing = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob)
            .load(root)
        )
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], MANIFEST)
    return listing.select(
        decoded_path(F.col("_metadata.file_path")).alias("file_path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.lit(price_version).alias("price_version"),
    )


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files the manifest does not know in this state."""
    return listing.join(manifest.select(*STAMP), STAMP, "left_anti")


def update_manifest(manifest: DataFrame, seen: DataFrame) -> DataFrame:
    """Manifest after the files in ``seen`` were processed."""
    kept = manifest.join(seen.select("file_path"), "file_path", "left_anti")
    return kept.select(*STAMP).unionByName(seen.select(*STAMP))


def forget(manifest: DataFrame, prefix: str) -> DataFrame:
    """Drop every entry below a path, so that it is read again."""
    return manifest.filter(~F.col("file_path").startswith(prefix))


def read_changed(spark: SparkSession, root: str, glob: str, changed: DataFrame) -> DataFrame:
    """Lines of the changed files only.

    Where files can be opened by their path, tasks read the changed ones. Else
    everything modified since the oldest change is scanned and matched by path on
    the cluster. A file that has gone since it was listed gives no lines; the others
    are read all the same.
    """
    if mounted(spark, root) is not None:
        return read_listed(spark, changed, missing=True)
    # The bound excludes its own second, so it is set one second earlier.
    oldest = changed.agg(F.min("modified") - F.expr("INTERVAL 2 SECONDS")).first()[0]
    if oldest is None:
        return read_lines(spark, root, glob).limit(0)
    lines = read_lines(
        spark,
        root,
        glob,
        modifiedAfter=oldest.strftime("%Y-%m-%dT%H:%M:%S"),
        timeZone=spark.conf.get("spark.sql.session.timeZone"),
        ignoreMissingFiles="true",
    )
    return lines.join(changed.select("file_path"), "file_path", "left_semi")


def read_files(seen: DataFrame, files: DataFrame) -> DataFrame:
    """Of the files set out to be read those that gave lines (empty files are not listed)."""
    found = files.select("file_path").distinct()
    return seen.join(found, "file_path", "left_semi").select(*STAMP)
