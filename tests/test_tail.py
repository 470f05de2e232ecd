"""L1: logs that grow while they are read."""

import json

from pyspark.sql import functions as F

from logs import reply, usage, user
from meterstone.sources.tail import LogTail, Piece, Pieces, TailReader, packed, tail_lines
from meterstone.streaming.changes import drain_snapshots, line_snapshots, summed_changes
from meterstone.streaming.hourly import run_available


def add(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("ab") as file:
        file.write(text if isinstance(text, bytes) else text.encode())


def run(spark, root, out, **options):
    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/lines/batch={number}")

    run_available(tail_lines(spark, str(root), **options), write, "append", str(out))
    rows = spark.read.parquet(f"{out}/lines").collect()
    return sorted((r.file_path.rsplit("/", 1)[-1], r.batch, r.pos, r.value) for r in rows)


def test_growing_files(spark, tmp_path):
    """Every complete line once, over runs that start again from the checkpoint."""
    root, out = tmp_path / "logs", tmp_path / "out"
    add(root / "p" / "a.jsonl", "one\ntwo\nthr")
    add(root / "p" / "b.jsonl", "no end")
    add(root / "p" / "c.txt", "not a log\n")
    first = [("a.jsonl", 0, 0, "one"), ("a.jsonl", 0, 4, "two")]
    assert run(spark, root, out) == first
    add(root / "p" / "a.jsonl", "ee\n\nfour\nfi")
    add(root / "q" / "d.jsonl", "new é\n")
    second = [("a.jsonl", 1, 8, "three"), ("a.jsonl", 1, 14, ""), ("a.jsonl", 1, 15, "four"), ("d.jsonl", 1, 0, "new é")]
    assert run(spark, root, out) == first + second
    assert run(spark, root, out) == first + second
    add(root / "p" / "b.jsonl", "\n")
    assert run(spark, root, out) == sorted([*first, *second, ("b.jsonl", 2, 0, "no end")])


def test_a_file_begun_anew_is_read_anew(spark, tmp_path):
    root, out = tmp_path / "logs", tmp_path / "out"
    add(root / "a.jsonl", "old 1\nold 2\n")
    run(spark, root, out)
    (root / "a.jsonl").write_text("new 1\nnew 2\nnew 3\n")
    run(spark, root, out)
    (root / "a.jsonl").write_text("new 1\n")
    got = run(spark, root, out)
    assert [v for _, b, _, v in got if b == 1] == ["new 1", "new 2", "new 3"]
    assert [v for _, b, _, v in got if b == 2] == ["new 1"]
    (root / "a.jsonl").unlink()
    assert run(spark, root, out) == got


def test_a_missing_folder_has_no_lines_yet(spark, tmp_path):
    root, out = tmp_path / "later", tmp_path / "out"
    run_available(tail_lines(spark, str(root)), lambda batch, number: None, "append", str(out))
    add(root / "a.jsonl", "x\n")
    assert [v for *_, v in run(spark, root, out)] == ["x"]


def read(reader, start, end):
    rows = []
    for piece in reader.partitions(start, end):
        for batch in reader.read(piece):
            rows += zip(batch["pos"].to_pylist(), batch["value"].to_pylist(), strict=True)
    return rows


def test_pieces_cut_anywhere_give_the_same_lines(tmp_path):
    lines = ["", "a", "bb" * 9, "", "c" * 40, "é", "x"]
    add(tmp_path / "a.jsonl", "\n".join(lines) + "\n" + "rest")
    whole = None
    for size in (1, 2, 3, 7, 16, 1000):
        reader = TailReader({"path": str(tmp_path), "pieceBytes": str(size)})
        got = read(reader, {}, reader.latestOffset())
        whole = whole or got
        assert got == whole and [v for _, v in got] == lines
    # From any line on.
    end = reader.latestOffset()
    (path,) = end
    for at, (pos, _) in enumerate(whole):
        start = {path: {"end": pos, "head": end[path]["head"]}}
        reader.piece = 5
        assert read(reader, start, end) == whole[at:]


def test_bytes_that_are_no_text(tmp_path):
    add(tmp_path / "a.jsonl", b"ok\n\xff\xfe\n" + b"long" * 40_000 + b"\n")
    reader = TailReader({"path": str(tmp_path)})
    got = [v for _, v in read(reader, {}, reader.latestOffset())]
    assert got[0] == "ok" and got[1] == "��" and len(got[2]) == 160_000


def test_only_changed_files_are_opened(tmp_path, monkeypatch):
    from meterstone.sources import tail

    for k in range(5):
        add(tmp_path / f"{k}.jsonl", f"{k}\n")
    reader, opened, complete = TailReader({"path": str(tmp_path)}), [], tail.Files.complete
    monkeypatch.setattr(tail.Files, "complete", lambda self, path, size: opened.append(path) or complete(self, path, size))
    reader.latestOffset()
    add(tmp_path / "3.jsonl", "more\n")
    reader.latestOffset()
    assert len(opened) == 6 and opened[-1].endswith("3.jsonl")


def test_a_file_that_goes_before_it_is_read(tmp_path):
    reader = TailReader({"path": str(tmp_path)})
    assert list(reader.read(Pieces([Piece(str(tmp_path / "gone.jsonl"), 0, 0, 0, 9)]))) == []
    assert LogTail.name() == "log_tail"


def test_lines_to_buckets(spark, tmp_path):
    """Growing agent-A logs through snapshots to priced buckets."""
    root, out = tmp_path / "logs", str(tmp_path / "out")

    def say(*entries):
        add(root / "proj" / "s.jsonl", "".join(json.dumps(e) + "\n" for e in entries))
        stream = line_snapshots(tail_lines(spark, str(root)), str(root))
        rows = summed_changes(drain_snapshots(stream, out, slots=2)).collect()
        return {(r.usage_hour, r.model): (r.input_tokens, r.output_tokens, r.cost_micro) for r in rows}

    assert say(user("q"), reply("m1", usage(100, 1)), {"type": "other"}) == {(10, "claude-opus-4-7"): (100, 1, 525)}
    moved = reply("m1", usage(200, 2), ts="2026-04-20T11:30:00Z")
    assert say(moved, reply("m2", None)) == {(11, "claude-opus-4-7"): (200, 2, 1050)}
    named = reply("", usage(1, 0, hour=0))
    both = say(named, named, "text", reply("m3", usage(7), model="nobody"))
    assert both[(10, "claude-opus-4-7")][:2] == (2, 0) and both[(10, "nobody")] == (7, 0, None)
    total = spark.read.parquet(f"{out}/changes").agg(F.sum("sign")).first()[0]
    assert total == 4


def test_small_files_share_a_task():
    pieces = [Piece(str(k), 0, 0, 0, size) for k, size in enumerate([5, 5, 20, 1, 1, 9])]
    assert [[int(p.path) for p in task.pieces] for task in packed(pieces, 10)] == [[0, 1], [2], [3, 4], [5]]
    assert packed([], 10) == []
