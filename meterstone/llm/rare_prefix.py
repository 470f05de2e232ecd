"""Candidates of the Jaccard join below 0.9: prefixes in the order of document frequency.

A set's elements stand in one order for all sets: first those that no other set has,
then those of few sets before those of many. Similar sets share an element
of their prefixes, which for most texts hold nothing that another text has. Lines that many
texts share come last, so they make candidates of nothing but what consists of them.

The order looks at one half of the elements, drawn by their hash; the other half
follows by hash alone. Elements are counted in buckets of bounded size, packed; each batch of texts
sends an element of several of its sets once, with their number.

Sets with an element in common that few have make pairs, those with one that
many have are linked to the least of them; pairs whose sizes and parity sketches
rule them out go before anything else is known of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.llm.common import stage
from meterstone.llm.wordhash import mixed

_U = np.uint64

#: Elements of a bucket, about.
BUCKET_ELEMENTS = 2_000_000
#: An element of more prefixes than this links them to the least set instead of making pairs.
PAIRED = 32

#: What a row says of its key and node: ``ONCE``, the one set of a batch that has it; ``MANY``, several sets
#: of a batch do, the least of which is the node; ``SURE``, each of those sets. ``NEED``: the key is the length of the
#: prefix less all early elements. ``LATE``: an element for a prefix longer than they are. ``TOTAL``: how often
#: an element was counted, all batches together.
ONCE, MANY, SURE, NEED, LATE, TOTAL = range(6)
PACKED = "bucket int, kind byte, keys binary, nodes binary, counts binary"
COUNTED = "kind byte, key long, node long, count long"

#: Of a batch's texts: text number and element of every distinct element, and per text its size, its name and
#: whether it is the first of its name.
SetsOf = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


def is_early(element: np.ndarray) -> np.ndarray:
    return (mixed(element ^ _U(0x5EED)) & _U(1)) == 0


def _packed(kind: int, bucket: np.ndarray, key: np.ndarray, node: np.ndarray, count: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(bucket, kind="stable")
    bucket, key, node, count = bucket[order], key[order], node[order], count[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for start, stop in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
        if start < stop:
            counted = count[start:stop].astype(np.int32).tobytes() if kind == MANY else None
            yield int(bucket[start]), kind, key[start:stop].tobytes(), node[start:stop].tobytes(), counted


def _sent(sets_of: SetsOf, prefix_of: Callable[[np.ndarray], np.ndarray], buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("keys", pa.binary()), ("nodes", pa.binary()), ("counts", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes, rest = [], [], []
            for text, element, size, node, first in sets_of(batch):
                use = first[text]
                text, element = text[use], element[use]
                early = is_early(element)
                keys.append(element[early])
                nodes.append(node[text[early]])
                need = prefix_of(size) - np.bincount(text[early], minlength=len(node))
                rest.append((NEED, need[first].astype(np.uint64), node[first]))
                late, of = element[~early], text[~early]
                # Elements are sorted within the text.
                begins = np.searchsorted(of, np.arange(len(node)))
                beyond = np.arange(len(of)) - begins[of] < need[of]
                rest.append((LATE, late[beyond], node[of[beyond]]))
            key, node = np.concatenate(keys), np.concatenate(nodes)
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
            times = np.diff(np.append(starts, len(key)))
            by_key = (mixed(key[starts]) % _U(buckets)).astype(np.int64)
            several = times > 1
            ones = np.ones(len(key), dtype=np.int64)
            out = [*_packed(ONCE, by_key[~several], key[starts][~several], node[starts][~several], times[~several])]
            out += _packed(MANY, by_key[several], key[starts][several], node[starts][several], times[several])
            sure = np.repeat(several, times)
            rest.append((SURE, key[sure], node[sure]))
            for kind, k, n in rest:
                spread = (mixed(k ^ mixed(n)) % _U(buckets)).astype(np.int64)
                out += _packed(kind, spread, k, n, ones[: len(k)] if len(k) <= len(ones) else np.ones(len(k)))
            for at in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*out[at : at + 64], strict=True), schema, strict=True)], schema=schema
                )

    return rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets arrive whole and in order: the elements that several sets have, and the rows that pass."""

    def out(kind: int, key: np.ndarray, node: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(key), 1 << 17):
            cut = slice(at, at + (1 << 17))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(key[cut]), kind, dtype=np.int8)),
                    *(pa.array(np.ascontiguousarray(c[cut]).view(np.int64)) for c in (key, node, count)),
                ],
                names=["kind", "key", "node", "count"],
            )

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        key, node, count, many = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((node, key))
        key, node, count, many = key[order], node[order], count[order], many[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        times = np.diff(np.append(starts, len(key)))
        total = np.add.reduceat(count, starts)
        met = np.maximum.reduceat(many, starts)
        shared = np.repeat(met | (node[starts] != node[starts + times - 1]), times)
        yield from out(ONCE, key[shared & ~many], node[shared & ~many], np.repeat(total, times)[shared & ~many])
        yield from out(TOTAL, key[starts][met], node[starts][met], total[met])

    held, now = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                yield from flush(held)
                held, now = [], row["bucket"]
            key, node = (np.frombuffer(row[c], dtype=np.uint64) for c in ("keys", "nodes"))
            if row["kind"] in (ONCE, MANY):
                many = row["kind"] == MANY
                count = np.frombuffer(row["counts"], dtype=np.int32).astype(np.int64) if many else np.ones(len(key), dtype=np.int64)
                held.append((key, node, count, np.full(len(key), many)))
            else:
                yield from out(row["kind"], key, node, np.zeros(len(key), dtype=np.int64))
    yield from flush(held)


def prefixes(texts: DataFrame, elements: int, sets_of: SetsOf, prefix_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``node, key``: the elements of each set's prefix that other sets have too.

    ``elements``: how many there are in all, to choose the number of buckets.
    """
    buckets = max(2 * texts.sparkSession.sparkContext.defaultParallelism, elements // 2 // BUCKET_ELEMENTS + 1)
    sent = texts.mapInArrow(_sent(sets_of, prefix_of, buckets), PACKED)
    counted = stage(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_counted, COUNTED))

    def of(kind: int) -> DataFrame:
        return counted.where(F.col("kind") == kind)

    # Elements that sets of one batch share may be those of a third of all sets: adaptive joins split them.
    sure = of(SURE).select("key", "node").join(of(TOTAL).select("key", "count"), "key")
    early = of(ONCE).select("node", "key", "count").union(sure.select("node", "key", "count"))
    none = F.lit(None).cast("long")
    by_node = (
        early.select("node", F.struct("count", "key").alias("early"), none.alias("need"), none.alias("late"))
        .union(of(NEED).select("node", F.lit(None), F.col("key"), none))
        .union(of(LATE).select("node", F.lit(None), none, F.col("key")))
        .groupBy("node")
        .agg(
            F.max("need").alias("need"),
            F.sort_array(F.collect_set("early")).alias("early"),
            F.collect_set("late").alias("late"),
        )
        .withColumn("left", F.greatest(F.col("need") + F.size("early"), F.lit(0)).cast("int"))
        .where("left > 0")
    )
    return by_node.select("node", F.explode(F.concat(F.slice("early", F.lit(1), F.col("left"))["key"], "late")).alias("key"))


def apart(one: Column, two: Column) -> Column:
    """Bits in which two sketches differ."""
    bits = F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda s, x: s + x)


def candidates(keyed: DataFrame, marks: DataFrame, part: int, whole: int) -> DataFrame:
    """Edges ``a, b`` such that any two sets that link are connected, most others are not.

    ``keyed(node, key)`` are prefixes; ``marks(node, size, marks)`` has a row for every set.
    """
    keyed = stage(keyed)
    shared = keyed.groupBy("key").agg(F.count("*").alias("sets"), F.min("node").alias("least")).where("sets > 1")
    shared = stage(shared)
    linked = keyed.join(shared.where(F.col("sets") > PAIRED), "key").where("node != least")
    groups = keyed.join(shared.where(F.col("sets") <= PAIRED).select("key"), "key").groupBy("key").agg(F.collect_list("node").alias("nodes"))
    pairs = (
        groups.select(F.explode("nodes").alias("a"), "nodes")
        .select("a", F.explode("nodes").alias("b"))
        .where("a < b")
        .distinct()
    )
    # One row for each set before anything is joined: copies of one text may be a third of all rows.
    sets = marks.groupBy("node").agg(F.any_value("size").alias("size"), F.any_value("marks").alias("marks"))
    sized = stage(sets.join(keyed.select("node").distinct(), "node", "left_semi"))

    def named(end: str) -> DataFrame:
        return sized.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("marks").alias(f"marks_{end}"))

    together = F.col("size_a") + F.col("size_b")
    similar = (
        pairs.join(named("a"), "a")
        .join(named("b"), "b")
        .where(F.least("size_a", "size_b") * whole >= F.greatest("size_a", "size_b") * part)
        .where(apart(F.col("marks_a"), F.col("marks_b")) * (whole + part) <= together * (whole - part))
    )
    return similar.select("a", "b").union(linked.select(F.col("least").alias("a"), F.col("node").alias("b")))
