"""Substring dedup: words of long passages that an earlier document has too.

Recompression gives every window of words a key, one of its inner symbols, which is
the same wherever the window stands. Symbols that only one document has cannot be in
a repeated window; they are most, and drop out at once. Windows with a shared symbol
are then named as a whole, and the least document of each name is found.

Every batch of documents keeps only its least document per symbol and per window for
the shuffle and settles the others itself, so a passage that a third of all documents
share sends one row per batch. Equal texts are settled by one name for the whole.

A document is told by a name of its id and text together, so that rows that share an
id, or have none, are judged each for itself; the id only says which is the smaller.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterstone.llm.common import stage
from meterstone.llm.recompression import anchors
from meterstone.llm.wordhash import Words, chunks, mixed, rolled, words_of

_U = np.uint64
#: Rounds of pairs: symbols of three to five words, rare enough to tell passages apart.
ROUNDS = 3
#: Up to so many units are broadcast to pick texts before they are joined by id.
BROADCAST_IDS = 2_000_000
#: Documents without an id come after all others.
LAST = 2**63 - 1
NOTHING = hashlib.sha256(b"").hexdigest()


def whole_names(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and two names of each text's word sequence."""
    firsts = words.firsts()
    counts = np.diff(firsts)
    place = (np.arange(len(words.hash)) - np.repeat(firsts[:-1], counts)).astype(np.uint64)
    out = []
    for seed in (0x51, 0x1337):
        values = mixed(words.hash + mixed(place + _U(seed)))
        running = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)))
        out.append((running[firsts[1:]] - running[firsts[:-1]]).view(np.int64))
    return counts, out[0], out[1]


class Padded:
    """Words of several texts in a row, with a border between texts that nothing equals."""

    def __init__(self, words: Words, width: int) -> None:
        n = len(words.hash) + words.n_texts + 1
        self.place = np.arange(len(words.hash)) + words.text + 1
        self.words = mixed(np.arange(n).astype(np.uint64) ^ _U(0xB0BDE7))
        self.words[self.place] = words.hash
        border = np.ones(n, dtype=np.int64)
        border[self.place] = 0
        self.text = np.zeros(n, dtype=np.int64)
        self.text[self.place] = words.text
        sums = np.concatenate(([0], np.cumsum(border)))
        #: Places where a window of one text starts.
        self.starts = np.flatnonzero(sums[width:] == sums[:-width]) if n >= width else np.zeros(0, np.int64)
        self.width = width

    def symbols(self) -> np.ndarray:
        return anchors(self.words, self.width, ROUNDS)[self.starts]

    def windows(self) -> np.ndarray:
        return rolled(self.words, self.width)[self.starts]


def _distinct(keys: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs sorted by key and unit; which are the first of their key, and
    which keys more than one unit has."""
    order = np.lexsort((units, keys))
    keys, units = keys[order], units[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (units[1:] != units[:-1])
    keys, units = keys[new], units[new]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    size = np.diff(np.append(np.flatnonzero(first), len(keys)))
    return keys, units, first, np.repeat(size > 1, size)


def _pieces(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for at in range(0, n, 1 << 17):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(c[at : at + (1 << 17)])) for c in columns.values()],
            names=list(columns),
        )


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in chunks(batch.column("text")):
            counts, one, two = whole_names(words_of(data, offsets, lower=False))
            part = batch.slice(at, len(offsets) - 1)
            shas = [
                hashlib.sha256(b" ".join((text or b"").split())).hexdigest()
                for text in part.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("unit"),
                    pa.array(counts),
                    pa.array(one),
                    pa.array(two),
                    pa.array(shas),
                ],
                names=["doc_id", "unit", "n_words", "h1", "h2", "sha"],
            )


def _symbol_rows(width: int):
    """``key, unit, sure``: symbols of the documents. Sure ones are shared already; of
    the others the key decides. Texts that the batch has under a lesser id are left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [], []
            ids, units = batch.column("doc").to_numpy(), batch.column("unit").to_numpy()
            least: dict[int, int] = {}
            for at, data, offsets in chunks(batch.column("text")):
                words = words_of(data, offsets, lower=False)
                name = whole_names(words)[1]
                mine = ids[at : at + words.n_texts]
                skip = np.zeros(words.n_texts, dtype=bool)
                for i, (of, doc) in enumerate(zip(name.tolist(), mine.tolist(), strict=True)):
                    skip[i] = least.get(of, LAST + 1) < doc
                    least[of] = min(least.get(of, doc), doc)
                padded = Padded(words, width)
                symbol, text = padded.symbols(), padded.text[padded.starts]
                # Neighbouring windows mostly share their symbol.
                use = np.ones(len(symbol), dtype=bool)
                use[1:] = (symbol[1:] != symbol[:-1]) | (text[1:] != text[:-1])
                use &= ~skip[text]
                keys.append(symbol[use].view(np.int64))
                owners.append(units[at + text[use]])
            key, unit, first, shared = _distinct(np.concatenate(keys), np.concatenate(owners))
            yield from _pieces({"key": key[first], "unit": unit[first], "sure": np.zeros(first.sum(), bool)})
            yield from _pieces({"key": key[shared], "unit": unit[shared], "sure": np.ones(shared.sum(), bool)})

    return rows


def _window_rows(width: int):
    """``name, doc, unit, sure`` of windows with a shared symbol; sure ones are repeats of
    a lesser document of the batch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, owners = [], []
            ids, units = batch.column("doc").to_numpy(), batch.column("unit").to_numpy()
            lists = batch.column("shared")
            values = lists.flatten().to_numpy()
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
            for at, data, offsets in chunks(batch.column("text")):
                words = words_of(data, offsets, lower=False)
                padded = Padded(words, width)
                text = padded.text[padded.starts]
                # A symbol counts for the text that it was found shared for.
                n = words.n_texts
                of = np.repeat(np.arange(n), np.diff(ends[at : at + n + 1])).astype(np.uint64)
                held = mixed(values[ends[at] : ends[at + n]].view(np.uint64) + mixed(of))
                use = np.isin(mixed(padded.symbols() + mixed(text.astype(np.uint64))), held)
                names.append(padded.windows()[use].view(np.int64))
                owners.append(at + text[use])
            name, owner = np.concatenate(names), np.concatenate(owners)
            order = np.lexsort((units[owner], ids[owner], name))
            name, doc, unit = name[order], ids[owner][order], units[owner][order]
            new = np.ones(len(name), dtype=bool)
            new[1:] = (name[1:] != name[:-1]) | (unit[1:] != unit[:-1])
            name, doc, unit = name[new], doc[new], unit[new]
            first = np.ones(len(name), dtype=bool)
            first[1:] = name[1:] != name[:-1]
            sure = doc > doc[np.flatnonzero(first)][np.cumsum(first) - 1] if len(name) else first
            for of in (~sure, sure):
                yield from _pieces({"name": name[of], "doc": doc[of], "unit": unit[of], "sure": sure[of]})

    return rows


KEPT = (
    "doc_id long, n_words long, n_removed long, kept_sha256 string, "
    "spans array<struct<start: long, end: long>>"
)


def _cut_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("doc_id", pa.int64()),
                ("n_words", pa.int64()),
                ("n_removed", pa.int64()),
                ("kept_sha256", pa.string()),
                ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ]
        )
        for batch in batches:
            out = []
            for doc, text, repeated in zip(
                *(batch.column(c).to_pylist() for c in ("doc_id", "text")),
                batch.column("repeated"),
                strict=True,
            ):
                text = text or b""
                data = np.frombuffer(text, dtype=np.uint8)
                found = words_of(data, np.array([0, len(data)]), lower=False)
                n = len(found.hash)
                edges = np.zeros(n + 1, dtype=np.int64)
                if n >= width:
                    hit = np.flatnonzero(
                        np.isin(rolled(found.hash, width).view(np.int64), repeated.values.to_numpy())
                    )
                    np.add.at(edges, hit, 1)
                    np.add.at(edges, hit + width, -1)
                gone = np.cumsum(edges[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                kept = b" ".join(compress(text.split(), (~gone).tolist()))
                out.append(
                    {
                        "doc_id": doc,
                        "n_words": n,
                        "n_removed": int(gone.sum()),
                        "kept_sha256": hashlib.sha256(kept).hexdigest(),
                        "spans": [
                            {"start": int(a), "end": int(b)}
                            for a, b in zip(turns[::2], turns[1::2], strict=True)
                        ],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows


def _picked(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the given units; few are broadcast first, to spare the others the shuffle."""
    if ids.count() <= BROADCAST_IDS:
        return texts.join(F.broadcast(ids.select("unit")), "unit", "left_semi")
    return texts


def repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13
) -> DataFrame:
    """Return per row ``doc_id, n_words, n_removed, kept_sha256, spans``.

    Removed is every word covered by a window of ``width`` words that also starts in a
    document with a smaller id; ``spans`` are its half-open word ranges and
    ``kept_sha256`` is the hash of the other words, joined by one space. Windows are
    judged on the input. NULL and empty texts have no words; texts shorter than a
    window lose nothing. Rows of equal id are no smaller than each other. Rows without
    an id come after all others. Windows are told apart by 64-bit names.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"),
        F.col(text_col).cast("binary").alias("text"),
    ).withColumn("unit", F.xxhash64("doc", "text"))
    known = stage(
        texts.select("doc_id", "unit", "text").mapInArrow(
            _known, "doc_id long, unit long, n_words long, h1 long, h2 long, sha string"
        )
    ).withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    # Units whose text stands under a smaller id as well.
    first = known.where(F.col("n_words") >= width).groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    copies = stage(
        known.join(first, ["h1", "h2"]).where("first < doc").select("unit").distinct()
    )

    at = ["key", "sure"]
    symbols = texts.select("doc", "unit", "text").mapInArrow(
        _symbol_rows(width), "key long, unit long, sure boolean"
    )
    others = F.count("*").over(Window.partitionBy("place", "sure"))
    shared = (
        # Sure rows need no company; their document spreads them.
        symbols.withColumn("place", F.when(F.col("sure"), F.xxhash64(*at, "unit")).otherwise(F.col("key")))
        .withColumn("others", others)
        .where(F.col("sure") | (F.col("others") > 1))
        .select("unit", "key")
        .join(copies, "unit", "left_anti")
        .groupBy("unit")
        .agg(F.collect_set("key").alias("shared"))
    )
    shared = stage(shared)
    windows = (
        _picked(texts.select("doc", "unit", "text"), shared)
        .join(shared, "unit")
        .mapInArrow(_window_rows(width), "name long, doc long, unit long, sure boolean")
    )
    least = F.min("doc").over(Window.partitionBy("place", "sure"))
    repeated = stage(
        windows.withColumn(
            "place", F.when(F.col("sure"), F.xxhash64("name", "unit")).otherwise(F.col("name"))
        )
        .withColumn("least", least)
        .where(F.col("sure") | (F.col("least") < F.col("doc")))
        .groupBy("unit")
        .agg(F.collect_set("name").alias("repeated"))
    )
    cut = (
        _picked(texts, repeated)
        .join(repeated, "unit")
        .select("doc_id", "text", "repeated")
        .mapInArrow(_cut_rows(width), KEPT)
    )
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    none = F.lit(None).cast("array<struct<start: long, end: long>>")
    copied = F.col("copy").isNotNull()
    rest = (
        known.join(repeated.select("unit"), "unit", "left_anti")
        .join(copies.withColumn("copy", F.lit(True)), "unit", "left")
        .select(
            "doc_id",
            "n_words",
            F.when(copied, F.col("n_words")).otherwise(0).alias("n_removed"),
            F.when(copied, NOTHING).otherwise(F.col("sha")).alias("kept_sha256"),
            F.when(copied, whole).otherwise(F.coalesce(none, F.array().cast("array<struct<start: long, end: long>>"))).alias("spans"),
        )
    )
    return rest.union(cut)
