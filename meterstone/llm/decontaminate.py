"""Benchmark decontamination: document windows looked up in the test set's n-grams.

Both sides are cut into the same normalised words. The windows of the test items
make a hash set which all tasks share; a document window is looked up as soon as
all its words are known words of the test set, and the lookup compares the words
themselves, so a hit is a verified hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.llm.common import boxed, stage, unboxed

#: Up to so many words of test items the hash set is broadcast (some 100 bytes each);
#: a larger test set is joined by its windows instead.
BROADCAST_WORDS = 2_000_000

#: Bytes that belong to words, lower-cased; all others become blanks.
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32
    for b in range(256)
)

HITS = (
    "struct<n_words: bigint, spans: array<struct<start: bigint, end: bigint>>, items: array<string>, "
    "clean_text: string>"
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_LETTERS).split() if text else []


class NgramSet:
    """Windows of the test items, by their length, with the items they belong to."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], width: int) -> None:
        self.ids: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, set[str | None]]] = {}
        for item, text in items:
            codes = np.array(
                [self.ids.setdefault(w, len(self.ids)) for w in words(text)], dtype=np.int32
            )
            if not len(codes):
                continue
            size = min(width, len(codes))
            found = self.windows.setdefault(size, {})
            for i in range(len(codes) - size + 1):
                found.setdefault(codes[i : i + size].tobytes(), set()).add(item)

    def scan(self, tokens: list[bytes]) -> tuple[np.ndarray, set[str | None]]:
        """Which words are hit, and the items with occurring windows."""
        known = self.ids.get
        codes = np.array([known(w, -1) for w in tokens], dtype=np.int32)
        hit = np.zeros(len(codes) + 1, dtype=np.int64)
        items: set[str | None] = set()
        strange = np.concatenate(([0], np.cumsum(codes < 0)))
        for size, found in self.windows.items():
            if len(codes) < size:
                continue
            for i in np.flatnonzero(strange[size:] == strange[:-size]).tolist():
                of = found.get(codes[i : i + size].tobytes())
                if of is not None:
                    items |= of
                    hit[i] += 1
                    hit[i + size] -= 1
        return np.cumsum(hit[:-1]) > 0, items


def ranges(hit: np.ndarray) -> list[dict]:
    """Runs of hit words as half-open ranges."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def cut(text: bytes, spans: list[dict]) -> str:
    """The text without the words of ``spans``, together with what stands between them."""
    cover = np.frombuffer(text.translate(_LETTERS), dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], cover.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : starts[span["start"]]])
        at = int(ends[span["end"] - 1])
    kept.append(text[at:])
    return b"".join(kept).decode()


def _hits(text: bytes | None, tokens: list[bytes], hit: np.ndarray, items: set) -> dict:
    spans = ranges(hit) if hit.any() else []
    return {
        "n_words": len(tokens),
        "spans": spans,
        "items": sorted(x for x in items if x is not None),
        "clean_text": cut(text, spans) if spans else None,
    }


def _by_broadcast(docs: DataFrame, items: DataFrame, text: Column, width: int, to: str) -> DataFrame:
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(
        NgramSet([(r.item, bytes(r.text) if r.text is not None else None) for r in items.collect()], width)
    )

    @F.arrow_udf(HITS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        kind = pa.struct(
            [
                ("n_words", pa.int64()),
                ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ("items", pa.list_(pa.string())),
                ("clean_text", pa.string()),
            ]
        )
        for batch in batches:
            rows = []
            for value in batch.to_pylist():
                tokens = words(value)
                rows.append(_hits(value, tokens, *index.scan(tokens)))
            yield pa.array(rows, type=kind)

    return docs.withColumn(to, scan(text.cast("binary")))


def _by_join(docs: DataFrame, items: DataFrame, text: Column, width: int, to: str) -> DataFrame:
    """The same result for a test set of any size: windows meet in a join on their words."""
    plain = "struct<n: int, windows: array<struct<at: int, key: binary>>>"

    def windowed(sizes: list[int] | None):
        @F.arrow_udf(plain)
        def cutting(batch: pa.Array) -> pa.Array:
            rows = []
            for value in batch.to_pylist():
                tokens = words(value)
                lengths = sizes if sizes is not None else [min(width, len(tokens))] * bool(tokens)
                rows.append(
                    {
                        "n": len(tokens),
                        "windows": [
                            {"at": i, "key": b" ".join(tokens[i : i + size])}
                            for size in lengths
                            for i in range(len(tokens) - size + 1)
                        ],
                    }
                )
            return pa.array(
                rows,
                type=pa.struct(
                    [
                        ("n", pa.int32()),
                        ("windows", pa.list_(pa.struct([("at", pa.int32()), ("key", pa.binary())]))),
                    ]
                ),
            )

        return cutting

    cut_items = stage(items.withColumn("w", windowed(None)("text")))
    sizes = sorted(
        r[0] for r in cut_items.select(F.least("w.n", F.lit(width))).where("w.n > 0").distinct().collect()
    )
    grams = cut_items.select("item", F.explode("w.windows.key").alias("key")).distinct()
    numbered = stage(
        docs.select(boxed(docs), text.cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    )
    found = (
        numbered.select("row", F.explode(windowed(sizes)("text")["windows"]).alias("w"))
        .select("row", "w.at", "w.key")
        .join(grams, "key")
        .groupBy("row")
        .agg(
            F.collect_set(F.struct("at", "key")).alias("at"), F.array_sort(F.collect_set("item")).alias("items")
        )
    )

    @F.arrow_udf(HITS)
    def gather(texts: pa.Array, at: pa.Array, items_of: pa.Array) -> pa.Array:
        rows = []
        for value, places, names in zip(
            texts.to_pylist(), at.to_pylist(), items_of.to_pylist(), strict=True
        ):
            tokens = words(value)
            hit = np.zeros(len(tokens), dtype=bool)
            for place in places or []:
                hit[place["at"] : place["at"] + place["key"].count(b" ") + 1] = True
            rows.append(_hits(value, tokens, hit, set(names or [])))
        return pa.array(
            rows,
            type=pa.struct(
                [
                    ("n_words", pa.int64()),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ("items", pa.list_(pa.string())),
                    ("clean_text", pa.string()),
                ]
            ),
        )

    kept = [c for c, name in zip(unboxed(docs), docs.columns, strict=True) if name.lower() != to.lower()]
    return numbered.join(found, "row", "left").select(
        *kept, gather("text", F.col("at"), F.col("items")).alias(to)
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 13,
    to: str = "hits",
    broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """Add ``to``: ``n_words``, ``spans`` of hit words (half-open, by word), the
    ``items`` with occurring windows (ids as text, sorted) and, where something is
    hit, the ``clean_text`` without those words.

    A window is ``width`` consecutive words of an item; an item with fewer words is
    one window. NULL and empty texts have no words and no hits, an empty test set
    hits nothing. Repeated items count once; an item with a NULL id hits words but
    names nothing. All columns of ``docs`` stay, whatever they are called (``to``
    replaces one of its own name).
    """
    items = benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("binary").alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    way = _by_broadcast if size <= 2 * broadcast_words else _by_join
    return way(docs, items, F.col(text_col), width, to)


def n_hit(hits: Column) -> Column:
    return F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def contaminated(hits: Column, share: int = 20) -> Column:
    """Whether one word of ``share``, or more, is hit."""
    return (n_hit(hits) > 0) & (n_hit(hits) * share >= hits["n_words"])
