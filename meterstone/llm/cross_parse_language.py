"""Language by cross-parsing: how few phrases of known text does a text fall into.

The labelled text of a language makes a suffix automaton. A text is parsed
greedily into the longest pieces that occur in it; the language needing the fewest
phrases, each weighed by the bits that point to one, wins. All blocks of a batch
walk through an automaton side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.llm.common import stage

UNKNOWN = "und"
#: Up to so many languages their rates are broadcast; beyond, Spark joins them.
BROADCAST_LANGUAGES = 10_000

#: ASCII letters stay (lower-cased), all other ASCII becomes a blank.
_LETTERS = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256)
)


@dataclass(frozen=True)
class Fit:
    """Bounds of the labelled sample."""

    #: Normalised text per language that makes its automaton.
    sample_bytes: int = 24_000
    #: Labelled rows looked at per language, about.
    sample_rows: int = 200
    #: All automata together take no more; with many languages each gets less text.
    table_bytes: int = 256 * 1024 * 1024
    block_bytes: int = 512


def normalised(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_LETTERS)


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions by state; state 0 is the root, which nothing leads back to."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text:
        now = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in nexts[at]:
            nexts[at][symbol] = now
            at = link[at]
        if at >= 0:
            to = nexts[at][symbol]
            if length[to] == length[at] + 1:
                link[now] = to
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and nexts[at].get(symbol) == to:
                    nexts[at][symbol] = twin
                    at = link[at]
                link[to] = link[now] = twin
        last = now
    return nexts


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: Column of each byte value in the tables; the last columns: unseen byte, padding.
    columns: np.ndarray
    tables: tuple[np.ndarray, ...]
    bits: tuple[float, ...]
    block_bytes: int

    def phrases(self, lanes: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Phrases of each lane; ``lanes`` holds columns, one row per position."""
        state = np.zeros(lanes.shape[1], dtype=np.int32)
        count = np.zeros(lanes.shape[1], dtype=np.int32)
        for symbols in lanes:
            to = table[state, symbols]
            stuck = np.flatnonzero((to == 0) & (symbols != len(table[0]) - 1))
            if len(stuck):
                again = table[0, symbols[stuck]]
                # The phrase so far ends; a byte never seen is a phrase of its own.
                count[stuck] += (state[stuck] != 0).astype(np.int32) + (again == 0)
                to[stuck] = again
            state = to
        return count + (state != 0)

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """Bits by text and language."""
        size = self.block_bytes
        parts = [max(1, -(-len(t) // size)) for t in texts]
        cells = np.full((sum(parts), size), len(self.columns), dtype=np.int64)
        flat, at = cells.reshape(-1), 0
        pad = self.tables[0].shape[1] - 1
        flat[:] = pad
        for text, n in zip(texts, parts, strict=True):
            flat[at : at + len(text)] = self.columns[np.frombuffer(text, dtype=np.uint8)]
            at += n * size
        lanes = np.ascontiguousarray(cells.T)
        firsts = np.concatenate(([0], np.cumsum(parts)[:-1]))
        return np.column_stack(
            [
                np.add.reduceat(self.phrases(lanes, table), firsts) * bits
                for table, bits in zip(self.tables, self.bits, strict=True)
            ]
        )

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        todo = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        while todo:
            some, size = [], 0
            while todo and size < 1 << 21:
                some.append(todo.pop())
                size += len(texts[some[-1]])
            costs = self.costs([normalised(texts[i]) for i in some])
            best = costs.argmin(axis=1)
            shares = np.exp2(-(costs - costs.min(axis=1)[:, None]) / 8)
            scores = 1 / shares.sum(axis=1)
            for i, k, score in zip(some, best, scores, strict=True):
                out[i] = (self.languages[k], float(score))
        return out


def learn(samples: dict[str, list[str]], fit: Fit = Fit()) -> LanguageModel:
    """Automata of the sampled texts; languages in code-point order, which breaks ties."""
    width = 66  # about the columns a table needs, for the bound
    most = min(fit.sample_bytes, max(256, fit.table_bytes // (8 * width * max(1, len(samples)))))
    texts = {}
    for language in sorted(samples):
        text = b" ".join(map(normalised, samples[language]))[:most]
        if text.strip():
            texts[language] = text
    seen = sorted(set(b"".join(texts.values())))
    columns = np.full(256, len(seen), dtype=np.int64)
    columns[seen] = np.arange(len(seen))
    tables = []
    for text in texts.values():
        nexts = suffix_automaton(text)
        table = np.zeros((len(nexts), len(seen) + 2), dtype=np.int32)
        for state, to in enumerate(nexts):
            for symbol, target in to.items():
                table[state, columns[symbol]] = target
        table[:, -1] = np.arange(len(nexts))
        tables.append(table)
    bits = tuple(float(np.log2(len(t) + 1)) for t in texts.values())
    return LanguageModel(tuple(texts), columns, tuple(tables), bits, fit.block_bytes)


def fit_language(
    docs: DataFrame,
    training: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fit: Fit = Fit(),
) -> LanguageModel:
    """Learn from a bounded sample of the rows with a language (see ``Fit``).

    ``training`` is a condition on a column named ``id``. Rows are sampled by a hash
    against a rate per language, so that a language holding most rows meets nowhere;
    texts are taken whole until the bound is reached, where the last one is cut.
    """
    known = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where(F.col("lang").isNotNull() & (F.col("text") != ""))
    if training is not None:
        known = known.where(training)
    counts = stage(known.groupBy("lang").count())
    rate = counts.select("lang", (F.lit(float(fit.sample_rows)) / F.col("count")).alias("rate"))
    if counts.count() <= BROADCAST_LANGUAGES:
        rate = F.broadcast(rate)
    mark = F.xxhash64("id", "text")
    rows = (
        known.join(rate, "lang")
        .withColumn("mark", mark)
        .where(F.pmod("mark", F.lit(1 << 30)) < F.col("rate") * (1 << 30))
        .select("lang", "mark", F.substring("text", 1, fit.sample_bytes).alias("text"))
        .collect()
    )
    samples: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.mark, r.text)):
        samples.setdefault(row.lang, []).append(row.text)
    return learn(samples, fit)


def language(docs: DataFrame, model: LanguageModel, text_col: str = "text", to: str = "language") -> DataFrame:
    """Add ``to``: struct of ``lang`` (``und`` for a NULL text, one without a letter, or
    where nothing was learned) and ``score`` (0 to 1; 0 with ``und``). Ties go to the
    language that comes first by code point. All other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang: string, score: double>")
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            found = model.predict(batch.to_pylist())
            yield pa.array([{"lang": k, "score": s} for k, s in found], type=kind)

    return docs.withColumn(to, parse(text_col))
