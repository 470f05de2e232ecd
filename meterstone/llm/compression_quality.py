"""Quality by compression: which of two zstandard dictionaries fits a text better.

One dictionary is built from good labelled texts, one from bad ones. A text is
compressed in blocks with each; the normalised difference of the two sizes, next
to how well it compresses without a dictionary, is turned into a probability by a logistic fit
on labelled texts that built no dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fit:
    """Bounds of the labelled sample, and sizes of what is learned from it."""

    #: Labelled rows taken for each of the two labels, in the order of a hash of the id.
    rows_per_label: int = 2000
    #: The most that one sampled text gives to the fit (scoring always takes whole texts).
    text_bytes: int = 16_384
    dictionary_bytes: int = 112 * 1024
    block_bytes: int = 512
    level: int = 3


def blocks(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def dictionary(texts: list[bytes], fit: Fit) -> bytes:
    """A trained dictionary; of too few blocks, the blocks themselves."""
    samples = [b for t in texts for b in blocks(t, 2048)]
    try:
        return zstandard.train_dictionary(fit.dictionary_bytes, samples, level=fit.level).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-fit.dictionary_bytes :]


def compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content)
    held.precompute_compress(level=level)
    return zstandard.ZstdCompressor(
        level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
    )


class Measure:
    """The two inputs of the score: size difference, and size against length.

    The latter comes without a dictionary: what a dictionary holds is not repetition, and texts that it
    was built from must look like any other.
    """

    def __init__(self, good: bytes, bad: bytes, fit: Fit) -> None:
        self.good, self.bad = compressor(good, fit.level), compressor(bad, fit.level)
        self.plain = zstandard.ZstdCompressor(level=fit.level, write_content_size=False, write_checksum=False)
        self.block = fit.block_bytes

    def __call__(self, text: bytes) -> tuple[float, float]:
        good = bad = plain = 0
        for block in blocks(text, self.block):
            good += len(self.good.compress(block))
            bad += len(self.bad.compress(block))
            plain += len(self.plain.compress(block))
        return (bad - good) / (bad + good), float(np.log(plain / len(text)))


def inputs(measured: np.ndarray) -> np.ndarray:
    """Intercept, difference, compressibility, and their curves."""
    d, r = measured[:, 0], measured[:, 1]
    return np.column_stack([np.ones(len(d)), 20 * d, r, 20 * d * r, r * r])


def logistic(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50, ridge: float = 1e-2
) -> np.ndarray:
    """Newton steps of a logistic fit of weighted rows with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(bend, slope)
        w += move
        if np.abs(move).max() < 1e-9:
            break
    return w


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float
    fit: Fit

    def scorer(self):
        """A function from a text to its score: for an empty text, and without both labels,
        the share of good labels."""
        if not self.weights:
            return lambda text: self.prior
        measure, w = Measure(self.good, self.bad, self.fit), np.array(self.weights)

        def score(text: bytes | None) -> float:
            if not text:
                return self.prior
            z = float((inputs(np.array([measure(text)])) @ w)[0])
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def learn(
    rows: list[tuple[bytes, int]], fit: Fit = Fit(), totals: tuple[int, int] | None = None
) -> QualityModel:
    """Learn from ``(text, label)`` rows: every other row of a label builds its
    dictionary, the rest calibrate.

    ``totals`` are the numbers of bad and good rows that the sample was taken from. The
    prior and the weights of the labels follow them, whatever the sample has of each.
    """
    of = {label: [t for t, y in rows if y == label and t] for label in (0, 1)}
    bad_rows, good_rows = totals or (len(of[0]), len(of[1]))
    prior = (good_rows + 1) / (bad_rows + good_rows + 2)
    if not of[0] or not of[1]:
        return QualityModel(b"", b"", (), prior, fit)
    bad, good = (dictionary(of[label][::2], fit) for label in (0, 1))
    rest = [(t, label) for label in (0, 1) for t in (of[label][1::2] or of[label])]
    measure = Measure(good, bad, fit)
    x = inputs(np.array([measure(t) for t, _ in rest]))
    y = np.array([y for _, y in rest], dtype=float)
    # As many rows in all as there are, of each label its share of the totals.
    share = good_rows / (bad_rows + good_rows)
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum())) * len(y)
    w = logistic(x, y, weight)
    return QualityModel(good, bad, tuple(w.tolist()), prior, fit)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    training: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fit: Fit = Fit(),
) -> QualityModel:
    """Learn from a bounded sample of the labelled rows (see ``Fit``), and from the numbers
    of good and bad rows in all of them.

    ``training`` is a condition on the id, given as a column named ``id``. Labels
    other than 0 and 1, rows without an id and rows without text teach nothing.
    Of repeated labels of an id each counts. The sample is chosen by a hash of the
    id, so that it does not depend on the order of rows.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isin(0, 1)
    )
    if training is not None:
        known = known.where(training)
    order = F.xxhash64("id")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text != ''")
    # The rows that could teach: of each id those with a text, times its labels.
    held = texts.groupBy("id").agg(F.count("*").alias("n"))
    given = known.groupBy("id", "label").agg(F.count("*").alias("times"))
    counted = {
        r.label: r.n
        for r in given.join(held, "id").groupBy("label").agg(F.sum(F.col("n") * F.col("times")).alias("n")).collect()
    }
    picked = [
        known.where(F.col("label") == label).orderBy(order, "id").limit(fit.rows_per_label)
        for label in (0, 1)
    ]
    chosen = F.broadcast(picked[0].union(picked[1]))
    rows = (
        texts.join(chosen, "id")
        .select("id", "label", F.substring("text", 1, fit.text_bytes).alias("text"))
        .orderBy(order, "id", "text")
        .limit(2 * fit.rows_per_label)
        .collect()
    )
    # Taken in steps of the stated bound, so that the sample fits the driver.
    sample = [(r.text.encode()[: fit.text_bytes], r.label) for r in rows]
    return learn(sample, fit, (counted.get(0, 0), counted.get(1, 0)))


def quality_score(docs: DataFrame, model: QualityModel, text_col: str = "text", to: str = "score") -> DataFrame:
    """Add ``to``, the probability that a row's whole text is good (0 to 1).

    NULL and empty texts get the share of good labels.
    All other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = shared.value.scorer()
        for batch in batches:
            yield pa.array([of(text) for text in batch.to_pylist()], type=pa.float64())

    return docs.withColumn(to, score(F.col(text_col).cast("binary")))
