"""Session settings the engine wants, the shared work folder, and the one way to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    # The JVM does not compile methods beyond 8000 bytes of code; a stage that
    # would need one runs operator by operator instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

#: What opening a log counts for when files are dealt to tasks, in bytes.
OPEN_COST_BYTES = "131072"
#: Tables of a sync that are broadcast have no more than that, packed.
BROADCAST_BYTES = "524288"


def build_session(app: str = "meterstone", master: str | None = None, **conf) -> SparkSession:
    """Return a session with the engine's defaults; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_files(spark: SparkSession):
    """For scans that run inside: logs are small and many, so that a task reads hundreds, not some tens."""
    return setting(spark, "spark.sql.files.openCostInBytes", OPEN_COST_BYTES)


def small_broadcasts(spark: SparkSession):
    """For joins that run inside: paths and ids of logs pack so well that a table below the usual bound takes the
    driver hundreds of megabytes to broadcast. A lower bound of the session's own stays."""
    bound = min(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold(), int(BROADCAST_BYTES))
    return setting(spark, "spark.sql.autoBroadcastJoinThreshold", str(bound))


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, from ``spark.checkpoint.dir``.

    A local session that names none gets a temporary folder and keeps it; on a
    cluster the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="meterstone-work-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the work folder that nobody uses; it goes when the driver's JVM ends."""
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Stage ``df`` as Parquet in the work folder and read it back.

    Runs its job at once, so a failure shows here. What reads the table sees its
    columns only, with statistics, and a lost executor costs no more than its tasks.
    """
    path = new_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
