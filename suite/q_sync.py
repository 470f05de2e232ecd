"""Whole syncs over real log files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meterstone.functions.measures import dollars
from meterstone.operators.merge import STORAGE
from meterstone.plans.sync import sync_history
from meterstone.session import cut_lineage, new_folder
from meterstone.sources.logs import file_stem, index_sessions, read_agent_a, read_session_index
from meterstone.sources.registry import LogSource, agent_a, agent_b
from meterstone.sources.tables import TableStore
from suite.logfiles import write_files
import suite.q_logs  # noqa: F401  its oracles serve here too
from suite.queries import REGISTRY, query
from suite.sqlbase import BASE
from suite.views import AS_OF, lines_a, lines_b, requests, stamp

CUT = "2024-01-26"
#: Folders over which the sessions of a project are spread, each with an index of its own.
INDEX_FOLDERS = 256


def broken(lines, as_of, book):
    raise ValueError("this source cannot be read")


def synced(spark, sf) -> tuple[TableStore, str]:
    """The tables after two syncs: one over the logs as they stood on a day, one after
    they have grown. A third source is broken both times."""
    base = new_folder(spark, "logs")
    rows = requests(spark, sf)
    store = TableStore(spark, f"{base}/store", key_buckets=8)
    sources = [
        agent_a(f"{base}/a"),
        LogSource("broken", f"{base}/b", "rollout-*.jsonl", broken),
        agent_b(f"{base}/b"),
    ]
    name = F.substring_index("file_path", "/", -1)
    before = F.col("ts") < CUT
    grown = rows.filter(~before).select("session_id").distinct()
    for part in (rows.filter(before), rows.join(grown, "session_id", "left_semi")):
        write_files(lines_a(part).withColumn("file", F.concat(F.lit("proj/"), name)), f"{base}/a")
        write_files(lines_b(part).withColumn("file", F.concat(F.lit("2024/"), name)), f"{base}/b")
        result = sync_history(store, sources, AS_OF)
        if list(result.failed) != ["broken"]:
            raise RuntimeError(f"sources failed: {result.failed}")
    return store, base


def project(base: str):
    """Project paths that fall back to a folder, as if the logs lay in /logs."""
    folder = f"{base.removeprefix('file://')}/a"
    return F.when(
        F.col("project_path").startswith(folder),
        F.concat(F.lit("/logs"), F.substring("project_path", len(folder) + 1, 1000)),
    ).otherwise(F.col("project_path"))


@query("s01_sync_usage", REGISTRY["n16_buckets"][1])
def sync_usage_query(spark, sf):
    """The usage table after two syncs."""
    store, base = synced(spark, sf)
    return (
        store.usage()
        .withColumn("cost_usd", dollars(F.col("cost_micro")))
        .withColumn("project_path", project(base))
        .drop("cost_micro", "cost_is_explicit")
    )


@query("s02_sync_sessions", REGISTRY["n19_sessions"][1])
def sync_sessions_query(spark, sf):
    """The session table after two syncs."""
    store, base = synced(spark, sf)
    return (
        store.sessions()
        .withColumn("cost_usd", dollars(F.col("cost_micro")))
        .withColumn("project_path", project(base))
        .drop("cost_micro", "summary", "started_date", "started_hour", *STORAGE)
    )


@query(
    "s03_session_index",
    f"""WITH {BASE} SELECT session_id, 'claude_code' AS agent_type,
    concat('/p/', max(user_id % 7)) AS project_path, concat('b', max(user_id % 5)) AS git_branch,
    strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS started_at,
    strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS ended_at, concat('sum ', session_id) AS summary,
    CAST(count(*) AS BIGINT) AS message_count FROM ev GROUP BY session_id""",
)
def index_query(spark, sf):
    """S3: session indexes of all projects, each listing a session twice, old entry last."""
    sessions = requests(spark, sf).groupBy("session_id").agg(
        F.max(F.col("user_id") % 7).alias("p"),
        F.max(F.col("user_id") % 5).alias("b"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
        F.count("*").alias("n"),
    )

    def entry(summary, modified, n):
        return F.struct(
            F.col("session_id").alias("sessionId"),
            F.concat(F.lit("/p/"), F.col("p").cast("string")).alias("projectPath"),
            F.concat(F.lit("b"), F.col("b").cast("string")).alias("gitBranch"),
            n.alias("messageCount"),
            stamp(F.col("first")).alias("created"),
            stamp(modified).alias("modified"),
            summary.alias("summary"),
        )

    stale = entry(F.lit("stale"), F.col("last") - F.expr("INTERVAL 1 HOUR"), F.lit(0).cast("long"))
    fresh = entry(F.concat(F.lit("sum "), F.col("session_id")), F.col("last"), F.col("n"))
    document = F.to_json(F.struct(F.flatten(F.collect_list(F.array(fresh, stale))).alias("entries")))
    spread = F.pmod(F.xxhash64("session_id"), F.lit(INDEX_FOLDERS)).alias("folder")
    files = sessions.groupBy("p", spread).agg(document.alias("value")).select(
        F.concat_ws("", F.lit("p"), "p", F.lit("-"), "folder", F.lit("/sessions-index.json")).alias("file"),
        F.lit(0).alias("pos"),
        "value",
    )
    base = new_folder(spark, "index")
    write_files(files, f"{base}/a")
    return index_sessions(read_session_index(spark, f"{base}/a"))


@query(
    "s06_line_order",
    f"""WITH {BASE} SELECT session_id, event_id, CAST(row_number() OVER
    (PARTITION BY session_id ORDER BY event_id) AS BIGINT) AS line
    FROM ev WHERE agent_type = 'claude_code'""",
)
def line_order_query(spark, sf):
    """The order of lines as the reader gives it, over files that fall into several splits."""
    base = new_folder(spark, "order")
    mine = lines_a(requests(spark, sf)).filter(F.col("pos") % 2 == 1)
    # Lines carry the event they tell of: two events of a session may share their second.
    event = F.floor(F.col("pos") / 2).cast("string")
    tagged = F.concat(F.lit('{"uuid":"'), event, F.lit('",'), F.substring("value", 2, 1 << 30))
    mine = mine.withColumn("value", tagged)
    name = F.substring_index("file_path", "/", -1)
    write_files(mine.withColumn("file", F.concat(F.lit("proj/"), name)), f"{base}/a")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_agent_a(spark, f"{base}/a")
        order = Window.partitionBy("file_path").orderBy("chunk", "pos")
        placed = lines.withColumn("line", F.row_number().over(order)).select(
            file_stem(F.col("file_path")).alias("session_id"),
            F.get_json_object("value", "$.uuid").cast("bigint").alias("event_id"),
            F.col("line").cast("bigint").alias("line"),
        )
        # Staged here, while the setting holds.
        return cut_lineage(placed)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
