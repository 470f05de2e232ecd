"""L1: how growing logs are dealt to tasks, and log files written for the suite."""

import pyarrow as pa

from meterstone.sources.tail import TailReader
from suite.logfiles import _writer


def test_small_pieces_share_a_task_and_a_batch(tmp_path):
    """Tasks grow with the bytes, however short the pieces and however many the files."""
    for k in range(300):
        (tmp_path / f"{k:03d}.jsonl").write_text(f"{k}\n" * 3)
    (tmp_path / "long.jsonl").write_text("word\n" * 20_000)
    reader = TailReader({"path": str(tmp_path), "pieceBytes": "1000"})
    tasks = reader.partitions({}, reader.latestOffset())
    assert sum(len(t.pieces) for t in tasks) == 400 and len(tasks) < 20
    batches = [list(reader.read(t)) for t in tasks]
    assert sum(map(len, batches)) < 30
    values = [v for task in batches for b in task for v in b["value"].to_pylist()]
    assert values.count("word") == 20_000 and values.count("7") == 3 and len(values) == 20_900


def test_a_line_much_longer_than_its_piece(tmp_path):
    (tmp_path / "a.jsonl").write_text("a\n" + "b" * 300_000 + "\nc\n")
    reader = TailReader({"path": str(tmp_path), "pieceBytes": "10"})
    tasks = reader.partitions({}, reader.latestOffset())
    assert [len(v) for t in tasks for b in reader.read(t) for v in b["value"].to_pylist()] == [1, 300_000, 1]


def test_lines_as_files(tmp_path):
    """Files over several batches, lines that are no ASCII, and the half of a line without its end."""
    rows = [("p/a", "é1", True), ("p/a", "", True), ("p/a", "é2é", False), ("p/b", "x", True), ("p/b", "yy", True), ("q/c", "half", False)]

    def batch(part):
        return pa.RecordBatch.from_pylist([dict(zip(("file", "value", "whole"), r, strict=True)) for r in part])

    for cut in range(len(rows) + 1):
        root = tmp_path / str(cut)
        parts = [batch(part) for part in (rows[:cut], rows[cut:]) if part]
        # A slice of a batch has offsets of its own.
        parts[-1] = pa.concat_batches([parts[-1], parts[-1]]).slice(parts[-1].num_rows)
        (written,) = _writer(str(root))(iter(parts))
        found = {f: (root / f).read_bytes() for f in ("p/a", "p/b", "q/c")}
        assert found == {"p/a": "é1\n\né".encode(), "p/b": b"x\nyy\n", "q/c": b"ha"}
        assert written.to_pydict() == {"file": ["p/a", "p/b", "q/c"], "bytes": [len(b) for b in found.values()]}
