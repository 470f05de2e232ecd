"""The tables as log files on disk, for the queries that read logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as afs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, memoryview]]:
    """Neighbouring lines of one file, as the bytes to be written."""
    file, value, whole = (batch.column(c) for c in ("file", "value", "whole"))
    end, nothing = (pa.scalar(text, pa.large_string()) for text in ("\n", ""))
    ended = pc.binary_join_element_wise(value.cast(pa.large_string()), nothing, end)
    ends = np.frombuffer(ended.buffers()[1], np.int64, len(ended) + 1, 8 * ended.offset)
    data = memoryview(ended.buffers()[2])
    done = whole.to_numpy(zero_copy_only=False)
    codes = file.dictionary_encode().indices.to_numpy()
    # A run ends where another file begins, and after a line that is still being written.
    cut = np.flatnonzero((codes[1:] != codes[:-1]) | ~done[:-1]) + 1
    for start, stop in zip([0, *cut], [*cut, len(codes)], strict=True):
        part = data[ends[start] : ends[stop]]
        if not done[stop - 1]:
            # Half of it, and no end.
            last = ends[stop] - ends[stop - 1] - 1
            part = part[: len(part) - 1 - (last - last // 2)]
        yield file[int(start)].as_py(), part


def _writer(root: str):
    """Files arrive whole and in order; each is written anew, so a task may be repeated."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = afs.FileSystem.from_uri(root) if "://" in root else (afs.LocalFileSystem(), root.removeprefix("file:"))
        name, out, names, sizes, folders = None, None, [], [], set()
        for batch in batches:
            if not batch.num_rows:
                continue
            for file, part in _runs(batch):
                if file != name:
                    if out:
                        out.close()
                    path = f"{base}/{file}"
                    folder = path.rsplit("/", 1)[0]
                    if folder not in folders:
                        system.create_dir(folder, recursive=True)
                        folders.add(folder)
                    name, out = file, system.open_output_stream(path)
                    names.append(file)
                    sizes.append(0)
                sizes[-1] += out.write(part)
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["file", "bytes"])

    return write


def write_files(lines: DataFrame, root: str) -> None:
    """Write ``lines(file, pos, value)`` as the files ``<root>/<file>``, lines in order.

    Tasks write them, each the files that fall to it. With a column ``whole``, lines for
    which it is false are left unfinished; they must be the last ones of their files.
    """
    whole = F.col("whole") if "whole" in lines.columns else F.lit(True).alias("whole")
    tasks = 2 * lines.sparkSession.sparkContext.defaultParallelism
    dealt = lines.select("file", "pos", "value", whole).repartition(tasks, "file").sortWithinPartitions("file", "pos")
    dealt.drop("pos").mapInArrow(_writer(root), "file string, bytes long").agg(F.sum("bytes")).collect()
