"""Logs listed and read by tasks, for roots on a file system that is mounted everywhere.

Spark's own file sources hold every file and every split of a scan on the driver. Logs are
many and small, so here both stay in tables: tasks walk the folders, the files found are dealt to
tasks by their size, and a task cuts what it got into splits as it reads.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterstone.session import OPEN_COST_BYTES, cut_lineage, setting

#: Entries after which a task that lists hands the folders it has not seen yet to others.
WALK_ENTRIES = 50_000
#: What a task reads, files counted with their cost of opening, and the longest split.
TASK_BYTES, SPLIT_BYTES = 128 << 20, 32 << 20
#: Lines handed on together, and what is read at once to find where a line ends.
BATCH_BYTES, STEP_BYTES = 4 << 20, 1 << 12

LISTED = "file_path string, size long, modified_ms long"
READ = "file_path string, modified_ms long, chunk long, pos long, value string"
END = re.compile(rb"\r\n?|\n")
#: What a file may begin with to say that it is UTF-8.
MARK = b"\xef\xbb\xbf"
GLOB = set("{}[]*?\\")


def mounted(spark: SparkSession, root: str) -> str | None:
    """The path of a root that every task can open as a file; None if only Hadoop can."""
    if GLOB & set(root):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    where = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return where.getPath() if where.getScheme() == "file" else None


def own_splits(spark: SparkSession):
    """For reading listings inside: the setting for the splits of logs is not meant for them."""
    return setting(spark, "spark.sql.files.maxPartitionBytes", str(TASK_BYTES))


# ── listing ──────────────────────────────────────────────────────────────


def hidden(name: str) -> bool:
    """Names that Spark's file sources pass over."""
    if name.startswith("_"):
        return "=" not in name and not name.startswith(("_common_metadata", "_metadata"))
    return name.startswith(".") or name.endswith("._COPYING_")


def named(name: str) -> bool:
    """False for names that are no text; Hadoop does not list them either."""
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def _walk(folder: str, most: int) -> Iterator[tuple[str, int | None, int | None]]:
    """Files below a folder; beyond ``most`` entries also folders, without a size, that are left to others."""
    if os.path.isfile(folder):
        stat = os.stat(folder)
        yield folder, stat.st_size, stat.st_mtime_ns // 1_000_000
        return
    left, seen = [folder], 0
    while left:
        here = left.pop()
        if seen > most:
            yield here, None, None
            continue
        try:
            entries = os.scandir(here)
        except FileNotFoundError:
            continue
        with entries:
            for entry in entries:
                if hidden(entry.name) or not named(entry.name):
                    continue
                seen += 1
                try:
                    if entry.is_dir():
                        left.append(entry.path)
                    elif entry.is_file():
                        stat = entry.stat()
                        yield entry.path, stat.st_size, stat.st_mtime_ns // 1_000_000
                except FileNotFoundError:
                    continue


def _lister(pattern: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    wanted = re.compile(pattern, re.DOTALL)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        paths, sizes, times = zip(*rows, strict=True)
        arrays = [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(times, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["file_path", "size", "modified_ms"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for folders in batches:
            for folder in folders.column("folder").to_pylist():
                for row in _walk(folder, most):
                    # Empty files have no lines and are not listed, as by Spark.
                    if row[1] is None or (row[1] and wanted.fullmatch(os.path.basename(row[0]))):
                        rows.append(row)
                    if len(rows) >= 10_000:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return write


def list_tree(spark: SparkSession, path: str, glob: str, most: int = WALK_ENTRIES) -> DataFrame:
    """``file_path, size, modified`` of the matching files below a mounted path, staged; a missing path has none.

    The folders are seen round by round: one task begins, and what it leaves over is spread.
    """
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    lister = _lister(pattern, most)
    tasks = spark.sparkContext.defaultParallelism
    folders, rounds = spark.range(0, 1, 1, 1).select(F.lit(path).alias("folder")), []
    while True:
        rounds.append(cut_lineage(folders.mapInArrow(lister, LISTED)))
        left = rounds[-1].filter(F.col("size").isNull())
        with own_splits(spark):
            if left.isEmpty():
                break
        folders = left.select(F.col("file_path").alias("folder")).repartition(tasks)
    found = reduce(lambda a, b: a.unionByName(b), rounds).filter(F.col("size").isNotNull())
    return found.select("file_path", "size", F.timestamp_millis("modified_ms").alias("modified"))


# ── reading ──────────────────────────────────────────────────────────────


def _rest(file: BinaryIO, last: bytes) -> bytes:
    """What follows up to the end of the line, when ``last`` is its last byte so far."""
    if last == b"\r":
        return b"\n" if file.read(1) == b"\n" else b""
    data, step = b"", STEP_BYTES
    while True:
        block = file.read(step)
        seen = len(data)
        data += block
        end = END.search(data, seen)
        if not block:
            return data
        if end:
            return data[: end.end()]  # as one end, whether or not a line feed follows
        step = min(2 * step, BATCH_BYTES)


def lines_between(file: BinaryIO, start: int, stop: int) -> bytes:
    """The lines that begin in ``[start, stop)``, each with a line feed as its end.

    Lines end as they do for Hadoop: with a line feed, a carriage return, or both.
    """
    at = max(start - 1, 0)
    file.seek(at)
    data = file.read(stop - at)
    if start:
        # A line that began before belongs to the split before.
        end = END.search(data)
        if not end:
            return b""
        data = data[end.end() :]
    if not data:
        return b""
    if not data.endswith(b"\n"):
        data += _rest(file, data[-1:])
    if not start and data.startswith(MARK):
        data = data[len(MARK) :]
        if not data:
            return b""
    if b"\r" in data:
        data = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    return data if data.endswith(b"\n") else data + b"\n"


class _Held:
    """Lines of many splits, until they are a batch."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.blocks, self.counts, self.paths, self.times, self.chunks, self.size = [], [], [], [], [], 0

    def add(self, path: str, modified: int, chunk: int, block: bytes) -> None:
        self.blocks.append(block)
        self.counts.append(block.count(b"\n"))
        self.paths.append(path)
        self.times.append(modified)
        self.chunks.append(chunk)
        self.size += len(block)

    def batch(self) -> pa.RecordBatch:
        data = b"".join(self.blocks)
        counts = np.array(self.counts, np.int64)
        lines = int(counts.sum())
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        # Without the line feeds every end moves by the lines before it.
        offsets = np.zeros(lines + 1, np.int32)
        offsets[1:] = ends - np.arange(lines)
        value = pa.StringArray.from_buffers(lines, pa.py_buffer(offsets), pa.py_buffer(data.replace(b"\n", b"")))
        split = np.repeat(np.arange(len(counts)), counts)
        pos = np.arange(lines) - np.repeat(np.cumsum(counts) - counts, counts)
        columns = [
            pa.array(self.paths, pa.string()).take(pa.array(split)),
            pa.array(np.array(self.times, np.int64)[split]),
            pa.array(np.array(self.chunks, np.int64)[split]),
            pa.array(pos),
            value,
        ]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, names=["file_path", "modified_ms", "chunk", "pos", "value"])


def _reader(piece: int, missing: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for path, modified, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    file = open(path, "rb")
                except FileNotFoundError:
                    if missing:
                        continue
                    raise
                with file:
                    for at in range(start, stop, piece):
                        block = lines_between(file, at, min(at + piece, stop))
                        if block:
                            held.add(path, modified, at, block)
                        if held.size >= BATCH_BYTES:
                            yield held.batch()
        if held.size:
            yield held.batch()

    return read


def read_listed(spark: SparkSession, files: DataFrame, missing: bool = False) -> DataFrame:
    """Lines ``(file_path, modified, chunk, pos, value)`` of the listed files, up to the size they have there.

    With ``missing``, a file that has gone gives no lines. Splits are no longer than Spark's setting for them.
    """
    opening = int(OPEN_COST_BYTES)
    weight = F.col("size") + opening
    splits = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    with own_splits(spark):
        total = files.agg(F.sum(weight)).first()[0] or 0
    share = max(opening, total // spark.sparkContext.defaultParallelism)
    task = min(TASK_BYTES, share)
    piece = min(SPLIT_BYTES, task, splits)
    # What a task opens a file for: as many splits as make a long one.
    stretch = piece * max(1, min(SPLIT_BYTES, task) // piece)
    parts = files.filter(F.col("size") > 0).select(
        "file_path",
        F.unix_millis("modified").alias("modified_ms"),
        F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(stretch))).alias("start"),
        F.col("size"),
    )
    dealt = parts.select(
        "file_path", "modified_ms", "start", F.least(F.col("start") + stretch, F.col("size")).alias("stop")
    ).repartition(max(1, -(-total // task)))
    return dealt.mapInArrow(_reader(piece, missing), READ).select(
        "file_path", F.timestamp_millis("modified_ms").alias("modified"), "chunk", "pos", "value"
    )
