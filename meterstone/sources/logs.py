"""Log scans.

Lines keep their order as ``(chunk, pos)``: the byte offset of the split they
come from and a number that ascends inside the split. Files stay splittable, and
a split is the bounded chunk the ordered operators work on.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterstone.schemas import INDEX_ENTRIES
from meterstone.sources.files import list_tree, mounted, read_listed

LINES = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("value", T.StringType()),
    ]
)


def decoded_path(uri: Column) -> Column:
    """Plain path of a file URI: scheme dropped, escapes decoded."""
    plain = F.regexp_replace(uri, "^file:/+", "/")
    return F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)


def read_lines(
    spark: SparkSession, root: str, glob: str = "*.jsonl", **options
) -> DataFrame:
    """Every line of the matching files below ``root``; a missing root gives no lines.

    With ``options``, or where only Hadoop reaches the files, Spark's own source reads them.
    """
    path = None if options else mounted(spark, root)
    if path is not None:
        return read_listed(spark, list_tree(spark, path, glob))
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    for name, value in options.items():
        reader = reader.option(name, value)
    try:
        text = reader.text(root)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LINES)
    return text.select(
        decoded_path(F.col("_metadata.file_path")).alias("file_path"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )


def read_agent_a(spark: SparkSession, root: str, **options) -> DataFrame:
    """Logs ``<root>/<project>/**/*.jsonl``; files directly below the root are no logs."""
    lines = read_lines(spark, root, "*.jsonl", **options)
    return lines.filter(F.instr(below(root, F.col("file_path")), "/") > 0)


def read_agent_b(spark: SparkSession, root: str, **options) -> DataFrame:
    """Logs ``<root>/**/rollout-*.jsonl``."""
    return read_lines(spark, root, "rollout-*.jsonl", **options)


def below(root: str, path: Column) -> Column:
    """Path relative to the scan root."""
    plain = root.removeprefix("file://").rstrip("/")
    return F.when(
        path.startswith(plain + "/"), F.substring(path, len(plain) + 2, 1 << 30)
    ).otherwise(F.regexp_replace(path, "^/", ""))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.jsonl$", "")


def session_id_a(root: str, path: Column) -> Column:
    """File stem, or ``parent:stem`` for a log in a ``subagents`` folder."""
    rel = below(root, path)
    parent = F.regexp_extract(rel, r"^[^/]+/(?:.*/)?([^/]+)/subagents/[^/]+$", 1)
    stem = file_stem(path)
    return F.when(parent != "", F.concat(parent, F.lit(":"), stem)).otherwise(stem)


def project_dir(root: str, path: Column) -> Column:
    """The project folder of a log: the fallback project path."""
    plain = root.removeprefix("file://").rstrip("/")
    return F.concat(F.lit(plain + "/"), F.substring_index(below(root, path), "/", 1))


def read_session_index(spark: SparkSession, root: str) -> DataFrame:
    """S3: entries of ``<root>/*/sessions-index.json`` with an id; unreadable files give none."""
    schema = T.StructType([T.StructField("entries", T.ArrayType(INDEX_ENTRIES))])
    try:
        documents = (
            spark.read.schema(schema)
            .option("multiLine", "true")
            .option("mode", "PERMISSIVE")
            .json(f"{root.rstrip('/')}/*/sessions-index.json")
        )
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], INDEX_ENTRIES)
    entries = documents.select(F.inline("entries"))
    return entries.filter(F.coalesce(F.col("sessionId"), F.lit("")) != "")


def index_sessions(entries: DataFrame, agent: str = "claude_code") -> DataFrame:
    """Session rows of the index; NULL means the index says nothing about a column."""
    text = {
        "project_path": "projectPath",
        "git_branch": "gitBranch",
        "started_at": "created",
        "ended_at": "modified",
        "summary": "summary",
    }
    # An index may list one session more than once: the newest entry counts.
    newest = entries.groupBy("sessionId").agg(
        F.max_by(
            F.struct(*[F.col(c) for c in (*text.values(), "messageCount")]),
            F.struct(F.coalesce("modified", F.lit("")), F.coalesce("created", F.lit(""))),
        ).alias("e")
    )
    return newest.select(
        F.col("sessionId").alias("session_id"),
        F.lit(agent).alias("agent_type"),
        *[F.col(f"e.{source}").alias(name) for name, source in text.items()],
        F.col("e.messageCount").alias("message_count"),
    )
