import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meterstone.llm.brown_lm import SHAPES, ClassModel, _neighbours, _pairs, _scored
from meterstone.llm.common import small_batches

LISTED, CLASSES = 500, 40


def long_batch():
    """A batch as Spark hands it on: ten thousand texts, two million codes."""
    rng = np.random.default_rng(3)
    codes = rng.integers(0, LISTED + SHAPES, 2_000_000).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 2_000_001, 200, dtype=np.int32)), pa.array(codes))
    rows = pa.array(np.arange(10_000))
    return pa.RecordBatch.from_arrays([rows, rows, lists], names=["row", "id", "codes"])


class Shared:
    def __init__(self, value):
        self.value = value


def test_a_task_looks_at_little_of_a_batch_at_once():
    n = LISTED + SHAPES + 2
    class_of, asked = np.arange(n) % CLASSES, np.arange(n) < LISTED
    model = ClassModel([], class_of, np.zeros((CLASSES, CLASSES)), np.zeros(n), np.zeros(n), 1, 1, 0.5)
    batch = long_batch()
    for step in (
        _pairs(class_of, CLASSES),
        _neighbours(class_of, asked, CLASSES),
        _scored(Shared(model), True, ["row", "id"]),
    ):
        tracemalloc.start()
        rows = sum(part.num_rows for part in step(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows
        # 8 bytes a code and array: a dozen arrays of a quarter of a million codes.
        assert peak < 48e6, peak


def test_workers_get_texts_in_batches_of_bounded_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], type=pa.int64()), pa.array([batch.num_rows], type=pa.int64())], names=["bytes", "n"])

    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with small_batches(spark):
        got = texts.mapInArrow(sizes, "bytes long, n long").collect()
    assert sum(r.n for r in got) == 3000
    assert max(r.bytes for r in got) < 5e6
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
