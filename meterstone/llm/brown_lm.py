"""Class-based bigram scoring with exchange clustering.

Words are counted over all training text. The most frequent ones are clustered: each
in turn moves to the class that raises the likelihood of the class bigrams most, until
none moves. Every other shared word with evidence enough then takes the class that suits the classes
of its neighbours, all over the corpus, best. Rare and unseen words belong to a class of
their shape. A text scores by the transitions of its classes and by the words' shares
of their classes.

Texts are read twice, to count words and to code them; all that follows runs on the
codes. Counting, and looking up the counts of rare words, are Spark jobs over
everything; the model itself has a size that does not depend on the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.llm.common import small_batches, stage

#: Stands for the end of a text; no word is empty.
END = b""
#: Classes by shape: a bucket of the first non-ASCII letter, and the last character.
SHAPES = 32
#: Tokens that a task looks at together, and unlisted words whose shapes it remembers, about.
STEP_TOKENS, REMEMBERED = 1 << 18, 1 << 18
#: Longer words are not shared with all tasks, whatever their rank.
LONGEST_SHARED = 64


@dataclass(frozen=True)
class Size:
    """Sizes of the model; none of them bounds what is counted or scored."""

    #: Words that exchange clustering assigns to classes, the most frequent ones.
    clustered: int = 1024
    classes: int = 64
    #: Words whose counts all tasks hold; the counts of others are joined.
    shared: int = 200_000
    rounds: int = 10
    #: Words that occur so often take a class by their neighbours; rarer ones keep that of their shape.
    evidence: int = 20
    #: Added to the count of a word within its shape.
    smoothing: float = 0.5


def tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def shape(word: bytes) -> int:
    bucket = 0
    if not word.isascii():
        at = next(i for i, b in enumerate(word) if b >= 0x80)
        bucket = 1 + word[min(at + 1, len(word) - 1)] % 7
    last = word[-1:]
    end = 1 if last in b".!?" else 2 if last in b",;:" else 0 if last.isalpha() or last >= b"\x80" else 3
    return bucket * 4 + end


class Codes(dict):
    """Numbers of listed words; all others get ``first + shape`` and are remembered."""

    def __init__(self, words: list[bytes]) -> None:
        super().__init__((w, i) for i, w in enumerate(words))
        self.first = len(words)

    def __missing__(self, word: bytes) -> int:
        code = self[word] = self.first + shape(word)
        return code


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter[bytes] = Counter()
        for text in batch.column("text").to_pylist():
            found.update(tokens(text))
        found[END] = batch.num_rows
        words = list(found)
        for at in range(0, len(words), 1 << 16):
            part = words[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, type=pa.binary()),
                    pa.array([found[w] for w in part], type=pa.int64()),
                    pa.array([shape(w) if w else -1 for w in part], type=pa.int32()),
                ],
                names=["word", "n", "shape"],
            )


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, shape, count`` of all tokens of ``texts(text binary)``; the end has shape -1."""
    return (
        texts.mapInArrow(_counted, "word binary, n long, shape int")
        .groupBy("word", "shape")
        .agg(F.sum("n").alias("count"))
    )


CODED = "codes array<int>, rare array<binary>, times array<int>"


def _coded(words: list[bytes], kept: list[str]):
    """The ``kept`` columns and, per text, the codes of its words: numbers of shared words, then shapes; and its
    other words with their numbers of times."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(words)
        for batch in batches:
            columns: list[list] = [[], [], []]
            for text in batch.column("text").to_pylist():
                line = tokens(text)
                ids = [codes[w] for w in line]
                rare = Counter(w for w, i in zip(line, ids, strict=True) if i >= codes.first)
                for column, value in zip(columns, (np.array(ids, dtype=np.int32), list(rare), list(rare.values())), strict=True):
                    column.append(value)
            # What a batch has remembered beyond the list goes with it.
            if len(codes) > codes.first + REMEMBERED:
                codes = Codes(words)
            types = (pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(c, type=t) for c, t in zip(columns, types, strict=True))],
                names=[*kept, "codes", "rare", "times"],
            )

    return rows


def coded(texts: DataFrame, words: list[bytes]) -> DataFrame:
    """``texts(text binary, ...)`` with codes in place of the text."""
    kept = [c for c in texts.columns if c != "text"]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in texts.schema if f.name != "text")
    return texts.select(*kept, "text").mapInArrow(_coded(words, kept), fields + CODED)


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut so that about ``STEP_TOKENS`` are looked at together; a longer text is taken alone."""
    for batch in batches:
        stops = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("codes")), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            before = int(stops[at - 1]) if at else 0
            stop = max(int(np.searchsorted(stops, before + STEP_TOKENS, side="right")), at + 1)
            yield batch.slice(at, stop - at)
            at = stop


def in_a_row(lists: pa.Array, start: int, end: int) -> np.ndarray:
    """The codes of all texts, each between ``start`` and ``end``."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    n = len(size)
    out = np.empty(int(size.sum()) + 2 * n, dtype=np.int64)
    stops = np.cumsum(size)
    out[stops - size + 2 * np.arange(n)] = start
    out[stops + 2 * np.arange(n) + 1] = end
    out[np.arange(int(size.sum())) + 2 * np.repeat(np.arange(n), size) + 1] = lists.flatten().to_numpy()
    return out


def _pairs(number_of: np.ndarray, size: int):
    """``pair, n``: neighbouring tokens by their numbers, of which there are ``size``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = len(number_of) - 1
        for batch in parts_of(batches):
            codes = in_a_row(batch.column("codes"), last, last - 1)
            ids = number_of[codes]
            pair = (ids[:-1] * size + ids[1:])[codes[1:] != last]
            pair, n = np.unique(pair, return_counts=True)
            for at in range(0, len(pair), 1 << 17):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[at : at + (1 << 17)]), pa.array(n[at : at + (1 << 17)].astype(np.int64))], names=["pair", "n"]
                )

    return rows


def pair_grid(texts: DataFrame, number_of: np.ndarray, size: int) -> np.ndarray:
    """How often each number follows each, over all coded ``texts``; at most ``size`` squared cells."""
    table = (
        texts.select("codes").mapInArrow(_pairs(number_of, size), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    ).toArrow()
    grid = np.zeros(size * size)
    grid[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    return grid.reshape(size, size)


def _neighbours(class_of: np.ndarray, asked: np.ndarray, total: int):
    """``word, slot, n``: classes after (from slot 0) and before (from ``total``) the ``asked`` words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = len(class_of) - 1
        for batch in parts_of(batches):
            codes = in_a_row(batch.column("codes"), last, last - 1)
            at = np.flatnonzero(asked[codes])
            word, near = codes[at], class_of[codes]
            key = np.concatenate((word * (2 * total) + near[at + 1], word * (2 * total) + total + near[at - 1]))
            key, n = np.unique(key, return_counts=True)
            for cut in range(0, len(key), 1 << 17):
                piece = slice(cut, cut + (1 << 17))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key[piece] // (2 * total)).astype(np.int32)), pa.array((key[piece] % (2 * total)).astype(np.int32)), pa.array(n[piece].astype(np.int64))],
                    names=["word", "slot", "n"],
                )

    return rows


def best_class(
    counts: np.ndarray, times: np.ndarray, of_shape: np.ndarray, transitions: np.ndarray, sizes: np.ndarray, classes: int
) -> np.ndarray:
    """The class, of the learned ones and the word's shape, under which its neighbours are likeliest.

    ``counts``: per word its neighbours after and before by class. A word shares its class with
    those in it (``sizes``); of equal classes the first one is taken.
    """
    total = len(transitions)
    after, before = counts[:, :total], counts[:, total:]
    gain = after @ transitions.T + before @ transitions
    own = np.arange(len(counts)), of_shape
    gain = gain - times[:, None] * np.log10(sizes + times[:, None])
    # The sizes of shapes have the word in them.
    gain[own] += times * (np.log10(sizes[of_shape] + times) - np.log10(np.maximum(sizes[of_shape], 1)))
    allowed = np.zeros_like(gain, dtype=bool)
    allowed[:, :classes] = True
    allowed[own] = True
    return np.where(allowed, gain, -np.inf).argmax(axis=1)


def _assigned(times: np.ndarray, of_shape: np.ndarray, transitions: np.ndarray, sizes: np.ndarray, classes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column("word").to_numpy()
            near = batch.column("near")
            owner = np.repeat(np.arange(len(word)), pc.list_value_length(near).to_numpy())
            slot, n = (near.flatten().field(c).to_numpy() for c in ("slot", "n"))
            for at in range(0, len(word), 1 << 13):
                mine = (owner >= at) & (owner < at + (1 << 13))
                part = word[at : at + (1 << 13)]
                counts = np.zeros((len(part), 2 * len(transitions)))
                np.add.at(counts, (owner[mine] - at, slot[mine]), n[mine])
                of = best_class(counts, times[part], of_shape[part], transitions, sizes, classes)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(of.astype(np.int32))], names=["word", "class"])

    return rows


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, clustered: int, classes: int, rounds: int) -> np.ndarray:
    """Class of every number. The first ``clustered`` words are exchanged between
    ``classes`` classes; the numbers after them keep classes of their own."""
    n = len(bigrams)
    of = np.concatenate((np.arange(clustered) % classes, classes + np.arange(n - clustered)))
    total = classes + n - clustered
    turned = np.ascontiguousarray(bigrams.T)
    grid = np.zeros((total, total))
    np.add.at(grid, (of[:, None], of[None, :]), bigrams)
    for _ in range(rounds):
        moved = 0
        for w in range(clustered):
            own, twice = of[w], bigrams[w, w]
            after = np.bincount(of, bigrams[w], total)
            before = np.bincount(of, turned[w], total)
            after[own] -= twice
            before[own] -= twice
            grid[own] -= after
            grid[:, own] -= before
            grid[own, own] -= twice
            rows, columns = grid[:classes], grid[:, :classes].T
            gain = (_xlogx(rows + after) - _xlogx(rows)).sum(axis=1)
            gain += (_xlogx(columns + before) - _xlogx(columns)).sum(axis=1)
            k = np.arange(classes)
            inner, right, left = grid[k, k], after[:classes], before[:classes]
            gain += (
                _xlogx(inner + right + left + twice)
                - _xlogx(inner + right)
                - _xlogx(inner + left)
                + _xlogx(inner)
            )
            out, into = rows.sum(axis=1), columns.sum(axis=1)
            gain -= _xlogx(out + after.sum() + twice) - _xlogx(out)
            gain -= _xlogx(into + before.sum() + twice) - _xlogx(into)
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-6:
                best = int(own)
            moved += best != own
            of[w] = best
            grid[best] += after
            grid[:, best] += before
            grid[best, best] += twice
        if not moved:
            break
    return of


@dataclass(frozen=True)
class ClassModel:
    """What all tasks share. Numbers: shared words, then shapes, end, start."""

    words: list[bytes]
    class_of: np.ndarray
    #: log10 P(class | class before), by the class before.
    transitions: np.ndarray
    #: log10 share of its class, for shared words; for shapes minus the log10 of the
    #: denominator, to which the count of the word is added.
    emissions: np.ndarray
    #: log10 (count + 1) of shared words and the end; 0 for shapes.
    base: np.ndarray
    n_tokens: int
    n_words: int
    smoothing: float


def frequent(counts: DataFrame, size: Size) -> tuple[list[bytes], list[int], list[int]]:
    """The shared words, most frequent first, with shape and count.

    They are all words above a count, the least one that no more than ``size.shared``
    words reach. It comes from a histogram of counts in steps of a sixteenth of a
    doubling, so no task sees more of the words than its own part.
    """
    words = counts.where((F.col("shape") >= 0) & (F.octet_length("word") <= LONGEST_SHARED))
    step = F.floor(F.log2("count") * 16)
    room, cut = size.shared, None
    for r in sorted(words.groupBy(step.alias("step")).count().collect(), reverse=True):
        if r["count"] > room:
            break
        room, cut = room - r["count"], r.step
    if cut is None:
        return [], [], []
    top = words.where(step >= cut).select("word", "shape", "count").toArrow().to_pylist()
    top.sort(key=lambda r: (-r["count"], r["word"]))
    return [r["word"] for r in top], [r["shape"] for r in top], [r["count"] for r in top]


def smoothed(seen: np.ndarray) -> np.ndarray:
    """log10 of class transitions. Witten-Bell: as much weight for the plain share as different
    classes have followed."""
    share = (seen.sum(axis=0) + 1) / (seen.sum() + len(seen))
    weight = np.maximum((seen > 0).sum(axis=1), 1)[:, None]
    return np.log10((seen + weight * share) / (seen.sum(axis=1)[:, None] + weight))


def fit_model(texts: DataFrame, counts: DataFrame, size: Size = Size()) -> ClassModel:
    """Learn from ``texts(text binary)`` and their ``counts``, which are staged."""
    vocabulary = frequent(counts, size)
    return fit_coded(stage(coded(texts.select("text"), vocabulary[0])), counts, vocabulary, size)


def fit_coded(
    texts: DataFrame, counts: DataFrame, vocabulary: tuple[list[bytes], list[int], list[int]], size: Size
) -> ClassModel:
    """Learn from the codes of the training texts, staged, under a ``vocabulary`` of shared words."""
    summed = counts.groupBy("shape").agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect()
    n_tokens, n_words = sum(r.n for r in summed), sum(r.v for r in summed)
    ends = sum(r.n for r in summed if r["shape"] < 0)
    words, shapes, count = vocabulary
    listed, of_shape, times = len(words), np.array(shapes, dtype=np.int64), np.array(count, dtype=float)
    k = min(size.clustered, listed)
    # The core has numbers of its own, all other words that of their shape; then end and start.
    core = np.concatenate((np.arange(k), k + of_shape[k:], np.arange(k, k + SHAPES + 2))).astype(np.int64)
    grid = pair_grid(texts, core, k + SHAPES + 2)
    classes = min(size.classes, max(k, 1))
    of = exchange(grid, k, classes, size.rounds)
    total = int(of.max()) + 1
    class_of = of[core]
    seen = np.zeros((total, total))
    np.add.at(seen, (of[:, None], of[None, :]), grid)
    shapes_n, shapes_v = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in summed:
        if r["shape"] >= 0:
            shapes_n[r["shape"]], shapes_v[r["shape"]] = r.n, r.v
    asked = np.zeros(len(class_of), dtype=bool)
    asked[k:listed] = times[k:] >= size.evidence
    if k and asked.any():
        settled = np.bincount(of[:k], times[:k], total)
        settled[classes : classes + SHAPES] = shapes_n
        np.subtract.at(settled, classes + of_shape[:k], times[:k])
        near = (
            texts.select("codes")
            .mapInArrow(_neighbours(class_of, asked, total), "word int, slot int, n long")
            .groupBy("word", "slot")
            .agg(F.sum("n").alias("n"))
            .groupBy("word")
            .agg(F.collect_list(F.struct("slot", "n")).alias("near"))  # two for each class at most
        )
        found = near.mapInArrow(
            _assigned(times, classes + of_shape, smoothed(seen), settled, classes), "word int, class int"
        ).toArrow()
        class_of[found.column("word").to_numpy()] = found.column("class").to_numpy()
        seen = pair_grid(texts, class_of, total)
    learned = class_of[:listed] < classes
    np.subtract.at(shapes_n, of_shape[learned], times[learned])
    np.subtract.at(shapes_v, of_shape[learned], 1)
    below = np.log10(shapes_n + size.smoothing * (shapes_v + 1))
    sizes = np.bincount(class_of[:listed][learned], times[learned], classes)
    emissions = np.concatenate((np.zeros(listed), -below, [0.0, 0.0]))
    emissions[:listed] = np.where(
        learned,
        np.log10(times / np.maximum(sizes[np.where(learned, class_of[:listed], 0)], 1)),
        np.log10(times + size.smoothing) - below[of_shape],
    )
    base = np.concatenate((np.log10(times + 1), np.zeros(SHAPES), [np.log10(ends + 1), 0.0]))
    return ClassModel(words, class_of, smoothed(seen), emissions, base, n_tokens, n_words, size.smoothing)


LOCAL = "n_tokens long, n_known long, base double, score double"


def _scored(shared, has_end: bool, kept: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ClassModel = shared.value
        last, listed = len(model.class_of) - 1, len(model.class_of) - SHAPES - 2
        for batch in parts_of(batches):
            lists = batch.column("codes")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            codes = in_a_row(lists, last, last - 1)
            text = np.repeat(np.arange(len(size)), size + 2)
            classes = model.class_of[codes]
            inside = codes != last
            place, of = np.flatnonzero(inside), text[inside]
            ids = codes[place]
            steps = model.transitions[classes[place - 1], classes[place]] + model.emissions[ids]

            def summed(values: np.ndarray) -> np.ndarray:
                return np.bincount(of, values, len(size))

            # Neither start nor end is a word.
            known = summed((ids < listed).astype(float)).astype(np.int64) + has_end
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept),
                    pa.array(size.astype(np.int64) + 1),
                    pa.array(known),
                    pa.array(summed(model.base[ids])),
                    pa.array(summed(steps)),
                ],
                names=[*kept, "n_tokens", "n_known", "base", "score"],
            )

    return rows


def score_texts(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: Size = Size(),
) -> DataFrame:
    """Return per row ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, perplexity``.

    ``training`` is a condition on a column named ``id``; where it is NULL the row is
    learned from. ``base_score`` is the log10 probability under add-one unigrams,
    ``score`` under the class model, both of the words and the end of the text. NULL
    and empty texts consist of the end only. Repeated rows count and are scored each;
    without any training row all words are unknown.
    """
    learns = F.coalesce(training, F.lit(True))
    texts = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).cast("binary").alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    kept = ["row", "id"]
    fields = "row long, id " + texts.schema["id"].dataType.simpleString() + ", " + LOCAL
    with small_batches(docs.sparkSession):
        counts = stage(word_counts(texts.where(learns).select("text")))
        vocabulary = frequent(counts, size)
        lines = stage(coded(texts, vocabulary[0]))
        model = fit_coded(lines.where(learns), counts, vocabulary, size)
        shared = docs.sparkSession.sparkContext.broadcast(replace(model, words=[]))
        # Staged, so that Python workers and the joins below do not need memory at once.
        local = stage(lines.select(*kept, "codes").mapInArrow(_scored(shared, model.n_tokens > 0, kept), fields))
    asked = lines.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "row", F.col("r.rare").alias("word"), F.col("r.times").alias("times")
    )
    n = F.coalesce("count", F.lit(0))
    looked_up = (
        asked.join(counts.where("shape >= 0").select("word", "count"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log10(n + 1)).alias("more_base"),
            F.sum(F.col("times") * F.log10(n + F.lit(size.smoothing))).alias("more_score"),
        )
    )

    def plus(name: str, more: str) -> Column:
        return F.col(name) + F.coalesce(more, F.lit(0))

    below = float(np.log10(model.n_tokens + model.n_words + 1))
    score = plus("score", "more_score")
    return local.join(looked_up, "row", "left").select(
        F.col("id").alias("doc_id"),
        (~learns).alias("held_out"),
        "n_tokens",
        plus("n_known", "more_known").cast("long").alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (plus("base", "more_base") - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
