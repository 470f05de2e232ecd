import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterstone.operators.chunked import chunk_of, running


def test_chunked_state_equals_one_window(spark):
    pick = random.Random(7)
    rows = [
        (
            "hot" if pick.random() < 0.5 else f"k{pick.randrange(4)}",
            i,
            pick.choice([None, pick.randrange(100)]),
            pick.randrange(-5, 6),
            pick.choice([None, f"m{pick.randrange(3)}"]),
        )
        for i in range(600)
    ]
    frame = spark.createDataFrame(rows, "k string, n long, a long, b long, m string")
    cut = frame.withColumn("c", chunk_of(F.col("n"), 16))
    got = running(cut, ["k"], "c", "n", last=["a", "m"], total=["b"], prev=True).drop("c")
    peak = running(cut, ["k"], "c", "n", peak=["a"]).select("n", F.col("a_run").alias("a_peak"))
    w = W.partitionBy("k").orderBy("n")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    want = frame.withColumns(
        {
            "a_run": F.last("a", True).over(upto),
            "a_prev": F.last("a", True).over(before),
            "m_run": F.last("m", True).over(upto),
            "m_prev": F.last("m", True).over(before),
            "b_run": F.sum("b").over(upto),
            "a_peak": F.max("a").over(upto),
        }
    )
    joined = got.join(peak, "n").select(*want.columns)
    assert sorted(map(str, joined.collect())) == sorted(map(str, want.collect()))
