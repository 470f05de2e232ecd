"""Growing logs as a stream of lines (L1).

A streaming source of log files to which lines are still being added. Its offset
holds, for every file, the byte after the last line end, so a trigger reads what has
come since the one before and nothing else; a line without an end waits until it has one. Ranges
are cut into pieces that tasks read on their own. What Spark has planned and not finished is
read again from the same bytes after a restart.

    spark.dataSource.register(LogTail)
    lines = spark.readStream.format("log_tail").option("path", "/logs/a").load()
"""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file read as one piece at most, and bytes looked at in one step.
PIECE_BYTES, STEP_BYTES = 64 << 20, 4 << 20
#: Tasks that a batch is spread over, unless they would read less than this each, or more than that.
SPREAD, SMALL_BYTES, TASK_BYTES = 64, 1 << 20, 64 << 20
#: Reading a file costs a task as much as so many bytes.
OPEN_BYTES = 1 << 15
#: Lines handed on together, and files looked at side by side.
BATCH_LINES, OPENERS = 1 << 13, 16

TAIL_LINES = "file_path string, head long, pos long, value string"


@dataclass
class Piece:
    """Lines that begin in ``[start, stop)`` of a file of which all from ``since`` is new."""

    path: str
    head: int
    since: int
    start: int
    stop: int


@dataclass
class Pieces(InputPartition):
    """What one task reads: a part of a large file, or many small ones."""

    pieces: list[Piece]


def packed(pieces: list[Piece], most: int, opening: int = 0) -> list[Pieces]:
    """Neighbouring pieces together, up to about ``most`` bytes; a file counts ``opening`` bytes more."""
    out, held = [], most
    for piece in pieces:
        size = piece.stop - piece.start + opening
        if held + size > most:
            out.append(Pieces([]))
            held = 0
        out[-1].pieces.append(piece)
        held += size
    return out


class Files:
    """The files below a root, on any file system that pyarrow knows."""

    def __init__(self, root: str, glob: str):
        self.system, self.root = afs.FileSystem.from_uri(root) if "://" in root else (afs.LocalFileSystem(), root)
        if "://" not in root and root.startswith("file:"):
            self.root = root.removeprefix("file:")
        self.glob = glob

    def sizes(self) -> Iterator[tuple[str, int, int]]:
        chosen = afs.FileSelector(self.root, allow_not_found=True, recursive=True)
        for info in self.system.get_file_info(chosen):
            if info.type == afs.FileType.File and fnmatch.fnmatch(info.base_name, self.glob):
                yield info.path, info.size, info.mtime_ns or 0

    def complete(self, path: str, size: int) -> tuple[int, int]:
        """The byte after the last line end below ``size``, and a checksum of the first line."""
        with self.system.open_input_file(path) as file:
            stop, block = size, b""
            while stop:
                start = max(0, stop - (1 << 16))
                block = file.read_at(stop - start, start)
                at = block.rfind(b"\n")
                if at >= 0:
                    break
                stop = start
            else:
                return 0, 0
            # A short file has been read already.
            first = b"" if start else block
            at_first = len(first)
            while b"\n" not in first:
                first += file.read_at(1 << 12, at_first)
                at_first = len(first)
            return start + at + 1, zlib.crc32(first[: first.index(b"\n")])


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("log_tail needs a path")
        self.path, self.glob = options["path"], options.get("pathGlobFilter", "*.jsonl")
        self.piece = int(options.get("pieceBytes", PIECE_BYTES))
        #: What is known of files that have not changed since.
        self.known: dict[str, tuple[int, int, int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files = Files(self.path, self.glob)

        def look(found: tuple[str, int, int]) -> tuple[int, int, int, int] | None:
            path, size, modified = found
            was = self.known.get(path)
            if was is None or was[:2] != (size, modified):
                try:
                    return size, modified, *files.complete(path, size)
                except FileNotFoundError:
                    return None
            return was

        listed = list(files.sizes())
        # Threads wait for a remote system together; a local one does not let them wait.
        local = isinstance(files.system, afs.LocalFileSystem)
        with ThreadPoolExecutor(1 if local else OPENERS) as openers:
            # Runs of files, as one file is too little to hand over.
            runs = [listed[k : k + 256] for k in range(0, len(listed), 256)]
            states = chain.from_iterable(openers.map(lambda run: [look(found) for found in run], runs))
            seen = {found[0]: was for found, was in zip(listed, states, strict=True) if was is not None}
        self.known = seen
        return {path: {"end": end, "head": head} for path, (_, _, end, head) in seen.items() if end}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        pieces = []
        for path, now in end.items():
            was = start.get(path, {"end": 0, "head": now["head"]})
            # Cut short or begun anew: read from the start.
            since = was["end"] if was["head"] == now["head"] and was["end"] <= now["end"] else 0
            for at in range(since, now["end"], self.piece):
                pieces.append(Piece(path, now["head"], since, at, min(at + self.piece, now["end"])))
        # Small backlogs are still spread over some tasks; small pieces and files share one.
        total = sum(p.stop - p.start + OPEN_BYTES for p in pieces)
        return packed(pieces, min(TASK_BYTES, max(total // SPREAD + 1, SMALL_BYTES)), OPEN_BYTES)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        system = Files(self.path, self.glob).system
        held, rows, size = [], 0, 0
        for piece in partition.pieces:
            for lines in self.lines(system, piece):
                held.append(lines)
                rows, size = rows + lines.num_rows, size + lines.nbytes
                if rows >= BATCH_LINES or size >= STEP_BYTES:
                    yield pa.concat_batches(held)
                    held, rows, size = [], 0, 0
        if held:
            yield pa.concat_batches(held)

    def lines(self, system: afs.FileSystem, p: Piece) -> Iterator[pa.RecordBatch]:
        try:
            file = system.open_input_file(p.path)
        except FileNotFoundError:
            # Gone since it was listed: its lines are gone, those of others are not.
            return
        with file:
            # A line that began in the piece before belongs to that one.
            at = p.start if p.start == p.since else p.start - 1
            skipping, rest, begin, step = p.start != p.since, b"", at, 1 << 12
            while begin < p.stop:
                # The piece, and of what is behind it only as much as its last line takes.
                block = file.read_at(min(STEP_BYTES, max(p.stop - at, step)), at)
                step *= 2
                if not block:
                    break
                at += len(block)
                lines = (rest + block).split(b"\n")
                rest = lines.pop()
                places, values = [], []
                for line in lines:
                    if skipping:
                        skipping = False
                    elif begin < p.stop:
                        places.append(begin)
                        values.append(line.decode("utf-8", "replace"))
                    begin += len(line) + 1
                if places:
                    n = len(places)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p.path] * n), pa.array([p.head] * n, pa.int64()), pa.array(places, pa.int64()), pa.array(values)],
                        names=["file_path", "head", "pos", "value"],
                    )


class LogTail(DataSource):
    """``file_path, head, pos, value``: ``pos`` is the byte at which a line begins, so it
    ascends in a file; ``head`` is a checksum of the file's first line, and another one for a file begun anew.

    Options: ``path``, a folder looked through to the bottom that need not be there yet, ``pathGlobFilter`` (``*.jsonl``), ``pieceBytes``. The offset has an entry
    for every file, so logs that have ended should leave the folder in time.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return TAIL_LINES

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_lines(spark: SparkSession, root: str, glob: str = "*.jsonl", **options) -> DataFrame:
    """L1: the lines of the files below ``root``, as a stream; every complete line once."""
    spark.dataSource.register(LogTail)
    reader = spark.readStream.format("log_tail").option("path", root).option("pathGlobFilter", glob)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()
