"""Hard negatives by threshold joins over a pruned inverted index (after L2AP).

Vectors are integer. Dimensions are taken in one order, those of most energy first,
and a vector's last ones are left out of the index as long as their norm times that of
the longest anchor stays below the threshold: a pair that reaches the threshold then
shares an indexed dimension. A join accumulates scores over the postings, panel by panel,
drops a pair once its score so far and the norms of what remains cannot reach the
threshold, and adds the dimensions left out for the pairs that last.

A join asks for the best rows of each window of scores. It starts with high thresholds and
lowers them until the windows are full or the thresholds have come to their ends; windows that are
full leave. Anchors and rows are cut into blocks, and each pair of blocks meets in a task,
which keeps a window's best only and raises its threshold by them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterstone.llm.common import column, stage

#: Rows and anchors that meet in a task at most, about, and rows looked at in one step.
BLOCK_ROWS, BLOCK_ANCHORS, STEP_ROWS = 1 << 16, 2048, 1024
#: Dimensions accumulated between two prunings.
PANEL = 16
#: Share of pairs below which those left are followed one by one.
SPARSE = 0.05
#: Thresholds of positives, as shares of the greatest possible score; then all rows.
POSITIVE_STEPS = (0.5, 0.25)
#: Thresholds of negatives, as shares of the window counted from its upper end.
NEGATIVE_STEPS = (0.125, 0.5, 1.0)
#: Scores must stay below this, so that percents of them are exact in doubles.
MOST = 1 << 40


@dataclass(frozen=True)
class Mining:
    """``positives`` rows of an anchor's label, and for each the first ``negatives`` rows of
    others whose score is from ``low`` to ``high`` percent of the positive's."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


class Postings:
    """Rows by dimension, without the dimensions that suffix norms cover."""

    def __init__(self, vectors: np.ndarray, reach: float):
        """``reach``: the least threshold over the longest anchor's norm."""
        squares = np.cumsum((vectors * vectors)[:, ::-1], axis=1)[:, ::-1]
        self.suffix = np.sqrt(np.concatenate((squares, np.zeros((len(vectors), 1))), axis=1))
        # The suffix norm falls along the row: the first place where it is below reach ends the index.
        indexed = (self.suffix >= reach).sum(axis=1)
        indexed = np.minimum(-(-indexed // PANEL) * PANEL, vectors.shape[1])
        self.rows = np.argsort(-indexed, kind="stable")
        self.indexed = indexed[self.rows]
        self.vectors = vectors[self.rows]
        self.suffix = self.suffix[self.rows]

    def reaching(self, anchors: np.ndarray, suffix: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and score of all pairs of at least ``least`` (by anchor)."""
        width = self.vectors.shape[1]
        active = int((self.indexed > 0).sum())
        score = np.zeros((len(anchors), active))
        for at in range(0, width, PANEL):
            to = min(at + PANEL, width)
            holds = int((self.indexed > at).sum())
            if not holds:
                break
            score[:, :holds] += anchors[:, at:to] @ self.vectors[:holds, at:to].T
            # Of the rows whose index goes on: what remains beyond this panel; of others, beyond theirs.
            ends = np.minimum(self.indexed[:active], to)
            rest = suffix[:, ends] * self.suffix[np.arange(active), ends]
            alive = score + rest + 1 >= least[:, None]
            if to < width and alive.mean() < SPARSE:
                a, r = np.nonzero(alive)
                return self._followed(anchors, suffix, least, a, r, score[a, r], to)
        a, r = np.nonzero(score + suffix[:, self.indexed[:active]] * self.suffix[np.arange(active), self.indexed[:active]] + 1 >= least[:, None])
        return self._followed(anchors, suffix, least, a, r, score[a, r], width)

    def _followed(self, anchors, suffix, least, a, r, score, done):
        """The pairs ``a, r``, whose score holds their row's indexed dimensions below ``done``."""
        width = self.vectors.shape[1]
        for at in range(0, width, PANEL):
            to = min(at + PANEL, width)
            # A panel is still to be added if it was left out of the index or comes after ``done``.
            need = np.flatnonzero((self.indexed[r] <= at) | (at >= done))
            if not len(need):
                continue
            score[need] += np.einsum("ij,ij->i", anchors[a[need], at:to], self.vectors[r[need], at:to])
            if at >= done:
                lasts = score + suffix[a, to] * self.suffix[r, to] + 1 >= least[a]
                a, r, score = a[lasts], r[lasts], score[lasts]
        reached = score >= least[a]
        return a[reached], self.rows[r[reached]], score[reached]


def _first_of(group: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group, by score downwards, then name."""
    order = np.lexsort((name, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, dtype=int)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return order[rank < k]


class _Block:
    """Windows of a block of anchors and the best rows found for them."""

    def __init__(self, rows: list[dict], same: bool, k: int):
        self.same, self.k = same, k
        self.window = np.array([r["window"] for r in rows], dtype=np.int64)
        self.row = np.array([r["row"] for r in rows], dtype=np.int64)
        self.label = np.array([r["label"] for r in rows], dtype=np.int64)
        self.low = np.array([r["low"] for r in rows], dtype=np.float64)
        self.high = np.array([r["high"] for r in rows], dtype=np.float64)
        # Windows of one anchor share its scores.
        _, first, self.anchor = np.unique(self.row, return_index=True, return_inverse=True)
        self.vectors = np.array([rows[i]["vector"] for i in first], dtype=np.float64)
        self.anchor_row, self.anchor_label = self.row[first], self.label[first]
        squares = np.cumsum((self.vectors * self.vectors)[:, ::-1], axis=1)[:, ::-1]
        self.suffix = np.sqrt(np.concatenate((squares, np.zeros((len(first), 1))), axis=1))
        self.best = [np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)]
        self.by_anchor = np.argsort(self.anchor, kind="stable")
        self.first_window = np.searchsorted(self.anchor[self.by_anchor], np.arange(len(first) + 1))

    def take(self, rows: np.ndarray, labels: np.ndarray, names: np.ndarray, vectors: np.ndarray) -> None:
        least = np.full(len(self.vectors), np.inf)
        np.minimum.at(least, self.anchor, self.low)
        reach = float(least.min()) / max(float(self.suffix[:, 0].max()), 1e-300) - 1e-9
        a, r, score = Postings(vectors, reach).reaching(self.vectors, self.suffix, least)
        fits = (labels[r] == self.anchor_label[a]) == self.same
        fits &= rows[r] != self.anchor_row[a]
        a, r, score = a[fits], r[fits], score[fits]
        # One line for each window of the pair's anchor.
        times = np.diff(self.first_window)[a]
        turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        w = self.by_anchor[np.repeat(self.first_window[a], times) + turn]
        r, score = np.repeat(r, times), np.repeat(score, times)
        inside = (score >= self.low[w]) & (score <= self.high[w])
        group = np.concatenate((self.best[0], w[inside]))
        score = np.concatenate((self.best[1], score[inside]))
        name = np.concatenate((self.best[2], names[r[inside]]))
        keep = _first_of(group, score, name, self.k)
        self.best = [group[keep], score[keep], name[keep]]
        # A full window takes nothing below its last row.
        full = np.flatnonzero(np.bincount(self.best[0], minlength=len(self.low)) == self.k)
        last = np.full(len(self.low), np.inf)
        np.minimum.at(last, self.best[0], self.best[1])
        self.low[full] = last[full]

    def found(self) -> pa.RecordBatch:
        w, score, name = self.best
        return pa.RecordBatch.from_arrays(
            [pa.array(self.window[w]), pa.array(name), pa.array(score.astype(np.int64))], names=["window", "name", "score"]
        )


def _meeting(same: bool, k: int):
    """Cells arrive whole and in order, windows first; each gives its windows' best."""

    def vectors_of(batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column("vector")
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, block = None, [], None
        for batch in batches:
            ids = batch.column("cell").to_numpy()
            is_row = batch.column("window").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (is_row[1:] != is_row[:-1])) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                part = batch.slice(start, stop - start)
                if ids[start] != cell:
                    if block:
                        yield block.found()
                    cell, waiting, block = ids[start], [], None
                if not is_row[start]:
                    waiting += part.to_pylist()
                    continue
                if waiting and not block:
                    block = _Block(waiting, same, k)
                if block:
                    for at in range(0, len(part), STEP_ROWS):
                        step = part.slice(at, STEP_ROWS)
                        block.take(*(step.column(c).to_numpy() for c in ("row", "label", "name")), vectors_of(step))
        if block:
            yield block.found()

    return rows


def best_in_windows(windows: DataFrame, rows: DataFrame, n: int, same: bool, k: int) -> DataFrame:
    """``window, name, score, place``: the first ``k`` rows of each window.

    ``windows(window, row, label, vector, low, high)``; ``rows(row, label, name, vector)``, ``n`` of them. ``same``: rows of the
    anchor's label, else those of all others. Cells are pairs of blocks; the windows of a
    block go to every block of rows, and rows to every block of windows.
    """
    spark = rows.sparkSession
    anchors = windows.agg(F.count_distinct("row")).first()[0]
    over_rows = max(-(-n // BLOCK_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-n // STEP_ROWS)), 1)
    over_anchors = max(1, -(-anchors // BLOCK_ANCHORS))

    def blocks(of: Column, count: int) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(count))

    def all_of(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    no = F.lit(None)
    asked = windows.select(
        "window", "row", "label", no.cast("long").alias("name"), "vector", "low", "high",
        blocks(F.col("row"), over_anchors).alias("a"), all_of(over_rows).alias("r"),
    )
    given = rows.select(
        no.cast("long").alias("window"), "row", "label", "name", "vector", no.cast("long").alias("low"), no.cast("long").alias("high"),
        all_of(over_anchors).alias("a"), blocks(F.col("row"), over_rows).alias("r"),
    )
    cells = asked.union(given).withColumn("cell", F.col("a") * over_rows + F.col("r")).drop("a", "r")
    met = (
        cells.repartition(over_rows * over_anchors, "cell")
        .sortWithinPartitions("cell", F.col("window").isNull())
        .mapInArrow(_meeting(same, k), "window long, name long, score long")
    )
    order = Window.partitionBy("window").orderBy(F.col("score").desc(), "name")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def filled(windows: DataFrame, rows: DataFrame, n: int, same: bool, k: int, lows: list[Column]) -> DataFrame:
    """``best_in_windows`` with thresholds lowered to each of ``lows`` in turn.

    The last of ``lows`` must be the lower end of the windows. A window is done when it is full.
    """
    out = None
    for turn, low in enumerate(lows):
        if out is not None and windows.isEmpty():
            break
        found = stage(best_in_windows(windows.withColumn("low", low.cast("long")), rows, n, same, k))
        full = found.groupBy("window").count().where(F.col("count") == k).select("window")
        # An unfilled window is sought anew as a whole, from a lower threshold.
        done = found if turn == len(lows) - 1 else found.join(full, "window", "left_semi")
        out = done if out is None else out.union(done)
        windows = windows.join(full, "window", "left_anti")
    return out


def integer_vectors(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; NULL if the vector or any component is NULL or not finite."""
    wide = vector.cast("array<double>")
    whole = F.transform(wide, lambda x: F.floor(x * scale))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.coalesce(sound, F.lit(False)), whole)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    mining: Mining = Mining(),
    scale: int = 256,
) -> DataFrame:
    """Return ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` and ``label`` are expressions over ``vectors``. Scores are integer inner
    products of the components times ``scale``, rounded down. Rows without id, with a NULL
    label or vector, or with a component that is NULL or not finite take no part. Vectors
    shorter than the longest count as if filled up with zeros. Ties go to the smaller id;
    rows of one id are rows of their own, so an anchor's twin may be its positive. Without rows
    of its label, or of others in the window, an anchor returns nothing. Scores
    must stay below 2**40, else it is an error.
    """
    sound = stage(
        vectors.select(
            F.monotonically_increasing_id().alias("row"),
            column(id_col).cast("long").alias("name"),
            label.cast("long").alias("label"),
            integer_vectors(column(vector_col), scale).alias("vector"),
            F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
        ).where("name IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    )
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    width, longest, n = sound.agg(
        F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(F.max(F.sqrt(square)), F.lit(0.0)), F.count("*")
    ).first()
    if longest * longest >= MOST:
        raise ValueError("scores may exceed 2**40; take a smaller scale")
    # Dimensions of most energy first: a sum for each of them.
    energy = (
        sound.select(F.posexplode("vector").alias("dim", "x"))
        .groupBy("dim")
        .agg(F.sum(F.col("x").cast("double") * F.col("x")).alias("energy"))
        .orderBy(F.desc("energy"), "dim")
        .collect()
    )
    order = [r.dim for r in energy] or [0]
    rows = stage(
        sound.withColumn(
            "vector",
            F.transform(
                F.array(*map(F.lit, order)), lambda d: F.coalesce(F.try_element_at("vector", d + 1), F.lit(0)).cast("long")
            ),
        )
    )
    anchors = rows.where("is_anchor").select("row", "label", "vector", F.col("name").alias("anchor_id"))
    anchors = anchors.withColumn("norm", F.sqrt(square))
    most = math.ceil(longest) + 1
    seeking = anchors.select(F.col("row").alias("window"), "row", "label", "vector", "norm", F.lit(most * most).alias("high"))
    steps = [F.ceil(F.col("norm") * longest * share) for share in POSITIVE_STEPS]
    positives = filled(
        seeking, rows, n, True, mining.positives, [*steps, F.lit(-most * most)]
    )
    # A window for each positive; windows are numbered by anchor and place.
    sought = stage(
        positives.join(anchors, positives["window"] == anchors["row"]).select(
            (F.col("row") * mining.positives + F.col("place") - 1).alias("window"),
            "row",
            "label",
            "vector",
            "anchor_id",
            F.col("name").alias("positive_id"),
            F.col("score").alias("positive_score"),
            F.ceil(F.col("score") * mining.low / 100.0).alias("end"),
            F.floor(F.col("score") * mining.high / 100.0).alias("high"),
        )
    )
    windows = sought.where(F.col("end") <= F.col("high"))
    down = [F.floor(F.col("high") - (F.col("high") - F.col("end")) * share) for share in NEGATIVE_STEPS]
    found = filled(
        windows.select("window", "row", "label", "vector", "end", "high"), rows, n, False, mining.negatives, [*down[:-1], F.col("end")]
    )
    return found.join(windows, "window").select(
        "anchor_id",
        "positive_id",
        F.col("place").cast("int").alias("rank"),
        F.col("name").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
