"""Quality rules under weak supervision: rules vote or abstain, EM weighs the votes.

One pass measures every text. Each rule turns the figures into a vote for good, a
vote for bad, or no vote. Documents with the same votes are alike to the label
model, so expectation-maximisation runs on counts of vote patterns, of which there
are at most ``3 ** len(RULES)``, however many documents there are. It estimates how
each rule votes on good and on bad texts; a document's posterior decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.llm.common import stage

FIGURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_lower",
    "n_distinct",
    "n_ended",
)
_BLANKS = bytes([0x20, *range(0x09, 0x0E)])
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_CAPITALS, _SMALL = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))


def repeated_words(codes: np.ndarray) -> int:
    """Words within a three-word window that the text holds twice or more."""
    if len(codes) < 4:
        return 0
    n = int(codes.max()) + 1
    pairs = np.unique(codes[:-1].astype(np.int64) * n + codes[1:], return_inverse=True)[1]
    _, which, count = np.unique(
        pairs[:-1].astype(np.int64) * n + codes[2:], return_inverse=True, return_counts=True
    )
    again = count[which] > 1
    covered = np.zeros(len(codes), dtype=bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def figures(text: bytes | None) -> tuple[int, ...]:
    """The figures of one text, in the order of ``FIGURES``; zeros for NULL."""
    if not text:
        return (0,) * len(FIGURES)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    return (
        len(words),
        len(text.translate(None, _BLANKS + _CONTINUED)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(codes),
        len(lines),
        len(text) - len(text.translate(None, _CAPITALS)),
        len(text) - len(text.translate(None, _SMALL)),
        len(ids),
        sum(line.rstrip()[-1:] in b".!?:;\"'" for line in lines),
    )


def _share(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part).cast("double"), F.col(whole))


def rules() -> dict[str, Column]:
    """The voting rules over the figures, by name: 0 no vote, 1 good, 2 bad.

    Most look for one fault and else say nothing; being free of one fault is no
    sign of quality. Two vote for good as well.
    """

    def bad(condition: Column, good: Column | None = None) -> Column:
        vote = F.when(condition, 2)
        return (vote if good is None else vote.when(good, 1)).otherwise(0)

    length = _share("word_chars", "n_words")
    symbols = _share("n_symbols", "n_words")
    repeats = _share("n_repeat_words", "n_words")
    capitals = F.try_divide(F.col("n_upper").cast("double"), F.col("n_upper") + F.col("n_lower"))
    ended = _share("n_ended", "n_lines")
    prose = length.between(2.5, 12) & (symbols < 0.1) & (repeats < 0.3)
    return {
        "word_length": bad((length < 2) | (length > 14)),
        "symbols": bad(symbols > 0.1),
        "repeated_lines": bad(_share("n_dup_lines", "n_lines") > 0.3),
        "repeated_words": bad(repeats > 0.3),
        "capitals": bad(capitals > 0.4),
        "variety": bad((_share("n_distinct", "n_words") < 0.1) & (F.col("n_words") < 2000)),
        "line_ends": bad((ended < 0.2) & (F.col("n_lines") > 3), ended > 0.6),
        "prose": bad(F.lit(False), prose & F.coalesce(capitals < 0.4, F.lit(True))),
    }


def expectation_maximisation(
    votes: np.ndarray, counts: np.ndarray, rounds: int = 500
) -> tuple[np.ndarray, float, np.ndarray]:
    """Return the posterior of good per pattern, the share of good texts, and
    ``P(vote | class)`` as an array (rule, class, vote).

    ``votes`` holds 0, 1 or 2 by pattern and rule, ``counts`` the documents per
    pattern. The start takes a vote to be right far more often than wrong.
    """
    n_rules = votes.shape[1]
    chance = np.empty((n_rules, 2, 3))
    chance[:, 1] = (0.5, 0.45, 0.05)
    chance[:, 0] = (0.5, 0.05, 0.45)
    good, posterior = 0.8, np.zeros(len(votes))
    for _ in range(rounds):
        logs = np.log([1 - good, good])[None, :] + np.stack(
            [np.log(chance[np.arange(n_rules), c, votes]).sum(axis=1) for c in (0, 1)], axis=1
        )
        now = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        for c, weight in ((0, counts * (1 - now)), (1, counts * now)):
            for v in range(3):
                # One text more for every outcome keeps chances off zero.
                chance[:, c, v] = ((votes == v) * weight[:, None]).sum(axis=0) + 1
            chance[:, c] /= chance[:, c].sum(axis=1, keepdims=True)
        good = (float((counts * now).sum()) + 1) / (float(counts.sum()) + 2)
        moved = np.abs(now - posterior).max(initial=0)
        posterior = now
        if moved < 1e-10:
            break
    return posterior, good, chance


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """Return per row its id as ``doc_id``, the figures, ``votes`` (one digit per rule:
    0 none, 1 good, 2 bad), ``posterior`` of being good, ``base_failed`` and ``kept``.

    ``kept`` asks for a posterior of ``threshold`` and for the base rules: 50 words,
    and at most half of them in repeated windows. NULL and empty texts have no words
    and fail. Repeated rows are judged alike; an empty table gives an empty result.
    """

    @F.arrow_udf("struct<" + ", ".join(f"{name}: bigint" for name in FIGURES) + ">")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = np.array([figures(t) for t in batch.to_pylist()], dtype=np.int64)
            rows = rows.reshape(-1, len(FIGURES))
            yield pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(column)) for column in rows.T], names=list(FIGURES)
            )

    measured = docs.select(
        F.col(id_col).alias("doc_id"), measure(F.col(text_col).cast("binary")).alias("of")
    ).select("doc_id", "of.*")
    voted = stage(measured.withColumn("votes", F.concat(*(v.cast("string") for v in rules().values()))))
    # Bounded: one row for each vote pattern.
    patterns = voted.groupBy("votes").count().orderBy("votes").collect()
    votes = np.array([[int(v) for v in r.votes] for r in patterns], dtype=int)
    posterior = (
        expectation_maximisation(votes, np.array([r["count"] for r in patterns], dtype=float))[0]
        if patterns
        else []
    )
    table = docs.sparkSession.createDataFrame(
        [(r.votes, float(p)) for r, p in zip(patterns, posterior, strict=True)],
        "votes string, posterior double",
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.join(F.broadcast(table), "votes", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
        .select("doc_id", *FIGURES, "votes", "posterior", "base_failed", "kept")
    )
