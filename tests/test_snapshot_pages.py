"""State of snapshots: messages share pages, so that calls for state are few."""

import random
from collections import Counter
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import functions as F

from meterstone.schemas import TOKEN_COLS
from meterstone.streaming.changes import COUNTS, KEY, VALUES, NewestSnapshot, drain_snapshots

DAY = date(2026, 4, 20)


class Held:
    """A state in memory that counts its calls and forgets nothing."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def called(self, result=None):
        self.calls += 1
        return result

    def getMapState(self, *_):
        return self

    getValueState = lambda self, *_: Held()

    def exists(self):
        return self.called(() in self.rows)

    def get(self):
        return self.called(self.rows[()])

    def update(self, value):
        self.called(self.rows.update({(): value}))

    def containsKey(self, key):
        return self.called(key in self.rows)

    def getValue(self, key):
        return self.called(self.rows[key])

    def updateValue(self, key, value):
        self.called(self.rows.update({key: value}))

    def removeKey(self, key):
        self.called(self.rows.pop(key))

    def getCurrentProcessingTimeInMs(self):
        return self.now


def turn(processor, held, rows, now):
    """Signed rows of a batch of (message, seq, tokens)."""
    held.now = now
    full = [(m * 2654435761 % (1 << 32) - (1 << 31), "a", "s", f"m{m}", seq, 20000, 1, "gpt", n, *[0] * (len(COUNTS) - 1)) for m, seq, n in rows]
    frame = pd.DataFrame(full, columns=["cell", *KEY, *VALUES])
    parts = [frame.iloc[i : i + 700] for i in range(0, len(frame), 700)]
    out = pd.concat([pd.DataFrame(columns=["sign", *KEY, *VALUES]), *processor.handleInputRows((0,), iter(parts), held)])
    return Counter(zip(out["sign"], out["msg_id"], out["seq"], out["input_tokens"], strict=True))


def test_calls_for_state_are_far_fewer_than_messages():
    """Batches of new, repeated, older and ended messages; changes are those of a dictionary."""
    kept, dice = 1000, random.Random(7)
    processor, held, known = NewestSnapshot(kept), Held(), {}
    processor.init(held)
    for number, (size, of) in enumerate([(40, 30), (3000, 2500), (9000, 8000), (9000, 8000), (5, 8000), (6000, 20000)]):
        now = number * 300
        rows = [(dice.randrange(of), number * 1000 + dice.randrange(-1500, 1000), dice.randrange(99)) for _ in range(size)]
        last, want = {}, Counter()
        for m, seq, n in rows:
            if m not in last or seq > last[m][0]:
                last[m] = seq, n
        for m, new in last.items():
            old = known.get(m)
            old = old[0] if old and now < old[1] + kept else None
            if old is None or new[0] > old[0]:
                want[1, f"m{m}", *new] += 1
                if old:
                    want[-1, f"m{m}", *old] += 1
                known[m] = new, now
        before = held.calls
        assert turn(processor, held, rows, now) == want
        # A page is asked for, read and written, those that it is split into are written.
        assert held.calls - before <= 4 * min(len(last), 4 * max(1, len(known) // 64))
    assert len(held.rows) >= len(known) // 64


def test_a_batch_reads_its_own_pages_only():
    """What a batch costs does not grow with the messages of the past."""
    processor, held = NewestSnapshot(None), Held()
    processor.init(held)
    turn(processor, held, [(m, 1, 1) for m in range(20000)], 0)
    before = held.calls
    assert turn(processor, held, [(7, 2, 5)], 1) == {(1, "m7", 2, 5): 1, (-1, "m7", 1, 1): 1}
    assert held.calls - before <= 3


def test_pages_over_runs_of_a_stream(spark, tmp_path):
    """As many messages as make pages split, in the stream's own state."""
    into, out = str(tmp_path / "in"), str(tmp_path / "out")
    dice, newest = random.Random(3), {}
    types = "msg_id string, seq long, usage_date date, usage_hour int, model string, agent_type string, session_id string, "
    types += ", ".join(f"{c} long" for c in TOKEN_COLS)
    for number, size in enumerate((50, 1500, 900)):
        rows = []
        for _ in range(size):
            m, seq = f"m{dice.randrange(900)}", number * 100000 + dice.randrange(-50000, 100000)
            seq = seq * 10 + len(rows) % 10
            while any(r[0] == m and r[1] == seq for r in rows) or newest.get(m, (None,))[0] == seq:
                seq += 10
            rows.append((m, seq, DAY + timedelta(days=dice.randrange(40)), dice.randrange(24), "gpt-5.4", "codex", "s", dice.randrange(999), 0, 0, 0))
        for m, *value in rows:
            if m not in newest or value[0] > newest[m][0]:
                newest[m] = value
        spark.createDataFrame(rows, types).write.mode("append").parquet(into)
        changes = drain_snapshots(spark.readStream.schema(types).parquet(into), out, slots=2)
    place = ["agent_type", "session_id", "usage_date", "usage_hour", "model"]
    net = changes.groupBy(*place).agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("input_tokens")).alias("i")).where("n <> 0")
    want = Counter()
    tokens = Counter()
    for _, day, hour, model, agent, session, i, *_ in newest.values():
        want[agent, session, day, hour, model] += 1
        tokens[agent, session, day, hour, model] += i
    assert {tuple(r)[:5]: (r.n, r.i) for r in net.collect()} == {k: (n, tokens[k]) for k, n in want.items()}
