"""N-gram Jaccard join with PartEnum signatures.

A text is the set of its word shingles. Sets are put into bands of similar size; in
a band, two sets similar enough differ in at most ``k`` elements. The domain is cut
into ``n1`` parts so that in one of them they differ in at most one element, and each
part again into three, two of which must then agree in full: a signature is made for
every pair of thirds, and similar sets share one. Sets that share signatures fall
into candidate clusters, in which all pairs are compared exactly.

Equal sets are one class throughout, and every batch of texts sends a signature on
only once, so large groups of copies shrink before they are shuffled. A cluster is
cut into blocks of bounded size; its blocks meet in pairs, each in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterstone.llm.common import boxed, components, stage, unboxed
from meterstone.llm.rare_prefix import candidates, prefixes
from meterstone.llm.wordhash import Words, chunks, mixed, rolled, words_of

_U = np.uint64

#: A block holds about so many shingles and sets at most; two blocks meet in a task.
BLOCK_SHINGLES, BLOCK_SETS = 2_000_000, 512
#: Up to so many ids of candidates are broadcast to pick their texts; beyond, texts are
#: joined by id.
BROADCAST_IDS = 2_000_000
#: Bits of the parity sketches that spare exact comparisons.
SKETCH = 1024
THIRDS = 3


@dataclass(frozen=True)
class Join:
    """Two sets link when ``whole * intersection >= part * union``."""

    shingle: int = 3
    part: int = 90
    whole: int = 100

    def band_ends(self, most: int) -> np.ndarray:
        """The largest size of each band, up to the band after the one of ``most``."""
        ends = [0]
        while True:
            ends.append((ends[-1] + 1) * self.whole // self.part)
            if len(ends) > 2 and ends[-2] >= most:
                return np.array(ends, dtype=np.int64)

    def differ(self, together: np.ndarray) -> np.ndarray:
        """The most elements in which linked sets of ``together`` elements differ."""
        return together * (self.whole - self.part) // (self.whole + self.part)


@dataclass
class Sets:
    """Distinct shingle hashes of each text, sorted within the text."""

    text: np.ndarray
    element: np.ndarray
    size: np.ndarray

    def sums(self, values: np.ndarray) -> np.ndarray:
        """64-bit sums by text; 0 for empty sets."""
        running = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)))
        ends = np.cumsum(self.size)
        return running[ends] - running[ends - self.size]


def shingle_sets(words: Words, width: int) -> Sets:
    firsts = words.firsts()
    counts = np.diff(firsts)
    texts, elements = [], []
    if len(words.hash) >= width:
        inside = words.text[: len(words.hash) - width + 1] == words.text[width - 1 :]
        texts.append(words.text[: len(inside)][inside])
        elements.append(rolled(words.hash, width)[inside])
    for short in range(1, width):
        of = np.flatnonzero(counts == short)
        if len(of):
            texts.append(of)
            elements.append(rolled(words.hash, short, seed=short)[firsts[of]])
    if not texts:
        none = np.zeros(0, dtype=np.int64)
        return Sets(none, none.astype(np.uint64), np.zeros(words.n_texts, dtype=np.int64))
    text, element = np.concatenate(texts), np.concatenate(elements)
    order = np.lexsort((element, text))
    text, element = text[order], element[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (element[1:] != element[:-1])
    text, element = text[new], element[new]
    return Sets(text, element, np.bincount(text, minlength=words.n_texts))


def class_keys(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes that together name a set."""
    size = sets.size.astype(np.uint64)
    return (
        mixed(sets.sums(mixed(sets.element ^ _U(0xA5A5)))) + size,
        mixed(sets.sums(mixed(sets.element ^ _U(0x5A5A5A)))) ^ size,
    )


def signatures(sets: Sets, chosen: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """Text and signature pairs of the ``chosen`` texts (a mask; empty sets have none)."""
    keep = chosen[sets.text]
    text, element = sets.text[keep], sets.element[keep]
    if not len(text):
        return text, element
    ends = join.band_ends(int(sets.size.max()))
    own = np.searchsorted(ends, sets.size)
    low, high = (element & _U(0xFFFFFFFF)).astype(np.float64), (element >> _U(32)).astype(np.float64)
    spread = mixed(element ^ _U(0x1234567))
    out_text, out_key = [], []
    for band in (own, own + 1):
        differ = join.differ(2 * ends[band])
        # In one of n1 parts the sets differ in one element at most.
        n1 = np.where(chosen & (sets.size > 0), (differ + 2) // 2, 0)
        first = np.concatenate(([0], np.cumsum(n1 * THIRDS)))
        part = (spread >> _U(8)) % n1[text].astype(np.uint64)
        third = (spread & _U(0xFF)) % _U(THIRDS)
        cell = first[text] + (part * _U(THIRDS) + third).astype(np.int64)
        cells = int(first[-1])
        # Sums of 32-bit halves are exact in doubles for any set of under 2 ** 21 elements
        # in a cell, and equal sets give equal sums in any case.
        held = mixed(
            np.bincount(cell, low, cells).astype(np.uint64) * _U(0x9E3779B97F4A7C15)
            + mixed(np.bincount(cell, high, cells).astype(np.uint64))
        ).reshape(-1, THIRDS)
        owner = np.repeat(np.arange(len(n1)), n1)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n1) - n1, n1)
        name = mixed((band[owner].astype(np.uint64) << _U(32)) + place.astype(np.uint64))
        exact = differ[owner] == 0
        for left_out in range(THIRDS):
            a, b = held[:, (left_out + 1) % THIRDS], held[:, (left_out + 2) % THIRDS]
            key = mixed(a * _U(3) + mixed(b) + name + _U(left_out))
            # Where sets must be equal, one signature of the whole is enough.
            whole = mixed(mixed(a) + mixed(b + _U(1)) + held[:, left_out] + name)
            use = ~exact | (left_out == 0)
            out_key.append(np.where(exact, whole, key)[use])
            out_text.append(owner[use])
    return np.concatenate(out_text), np.concatenate(out_key)


def prefix_length(size: np.ndarray, join: Join) -> np.ndarray:
    """So many first elements of a set include one of any set it links to (0 for empty sets)."""
    least = -(-size * join.part // join.whole)
    return np.where(size > 0, size - least + 1, 0)


def _doc_rows(join: Join, marked: bool):
    """Per row its size and its class; if ``marked``, its parity sketch too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in chunks(batch.column("text")):
                sets = shingle_sets(words_of(data, offsets, lower=True), join.shingle)
                one, two = class_keys(sets)
                part = batch.slice(at, len(offsets) - 1)
                columns = {
                    "row": part.column("row"),
                    "doc_id": part.column("doc_id"),
                    "n_shingles": pa.array(sets.size.astype(np.int64)),
                    "h1": pa.array(one.view(np.int64)),
                    "h2": pa.array(two.view(np.int64)),
                }
                if marked:
                    ends = np.cumsum(sets.size)
                    held = sketches([sets.element[e - n : e] for e, n in zip(ends, sets.size, strict=True)])
                    columns["marks"] = pa.array(list(held.view(np.int64)), type=pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    return rows


def _signature_rows(join: Join):
    """Per batch: ``signature, node, seen``; ``seen`` rows link two nodes of the batch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes = [], []
            known = np.zeros(0, dtype=np.int64)
            for _, data, offsets in chunks(batch.column("text")):
                sets = shingle_sets(words_of(data, offsets, lower=True), join.shingle)
                node = class_keys(sets)[0].view(np.int64)
                # A set that the batch has had already adds nothing.
                first = np.zeros(len(node), dtype=bool)
                first[np.unique(node, return_index=True)[1]] = True
                first &= ~np.isin(node, known)
                known = np.concatenate((known, node[first]))
                text, key = signatures(sets, first, join)
                keys.append(key.view(np.int64))
                nodes.append(node[text])
            yield from _sent(np.concatenate(keys), np.concatenate(nodes))

    return rows


def _prefix_sets(join: Join):
    """The sets of a batch, for prefixes; a set that the batch has had already is marked as not the first."""

    def sets_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        known = np.zeros(0, dtype=np.uint64)
        for _, data, offsets in chunks(batch.column("text")):
            sets = shingle_sets(words_of(data, offsets, lower=True), join.shingle)
            node = class_keys(sets)[0]
            first = np.zeros(len(node), dtype=bool)
            first[np.unique(node, return_index=True)[1]] = True
            first &= ~np.isin(node, known) & (sets.size > 0)
            known = np.concatenate((known, node[first]))
            yield sets.text, sets.element, sets.size, node, first

    return sets_of


def _in_pieces(
    key: np.ndarray, node: np.ndarray, mark: np.ndarray, key_name: str, mark_name: str
) -> Iterator[pa.RecordBatch]:
    for cut in range(0, len(key), 1 << 17):
        piece = slice(cut, cut + (1 << 17))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(c[piece])) for c in (key, node, mark)],
            names=[key_name, "node", mark_name],
        )


def _sent(key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``signature, node, seen`` of a batch: each signature with its least node, and the
    other nodes of the batch linked to it."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    least = node[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(key) else node
    linked = np.unique(np.column_stack((least, node))[node != least], axis=0)
    for a, b, seen in ((key[fresh], node[fresh], False), (linked[:, 0], linked[:, 1], True)):
        yield from _in_pieces(a, b, np.full(len(a), seen), "signature", "seen")


def sketches(elements: list[np.ndarray]) -> np.ndarray:
    """Parity of the elements by hash: sets differ in at least as many elements as bits."""
    out = np.zeros((len(elements), SKETCH // 64), dtype=np.uint64)
    for i, e in enumerate(elements):
        odd = np.bincount((e % _U(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
        out[i] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    return out


def compare(
    elements: list[np.ndarray], weights: np.ndarray, left: np.ndarray, right: np.ndarray, join: Join
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """All links between a set of ``left`` and one of ``right`` (masks; a set in both
    meets every other once). Returns a spanning forest, and per set the summed
    weights of the sets it links to."""
    m = len(elements)
    sizes = np.array([len(e) for e in elements])
    order = np.argsort(sizes, kind="stable")
    marks = sketches(elements)
    ids = np.unique(np.concatenate(elements), return_inverse=True)[1]
    stops = np.cumsum(sizes)
    codes = [ids[stop - size : stop] for stop, size in zip(stops, sizes, strict=True)]
    seen = np.zeros(int(ids.max(initial=0)) + 1, dtype=bool)
    parent, links, forest = list(range(m)), np.zeros(m, dtype=np.int64), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ordered = sizes[order]
    for k, a in enumerate(order):
        # The other set is at least as large; beyond this size it cannot be similar.
        stop = np.searchsorted(ordered, sizes[a] * join.whole // join.part, side="right")
        others = order[k + 1 : stop]
        others = others[(left[a] & right[others]) | (right[a] & left[others])]
        if not len(others):
            continue
        apart = np.bitwise_count(marks[others] ^ marks[a]).sum(axis=1)
        others = others[apart <= join.differ(sizes[others] + sizes[a])]
        if not len(others):
            continue
        seen[codes[a]] = True
        firsts = np.concatenate(([0], np.cumsum(sizes[others])[:-1]))
        common = np.add.reduceat(seen[np.concatenate([codes[b] for b in others])].astype(np.int64), firsts)
        seen[codes[a]] = False
        good = join.whole * common >= join.part * (sizes[others] + sizes[a] - common)
        for b in others[good].tolist():
            links[a] += weights[b]
            links[b] += weights[a]
            x, y = root(int(a)), root(b)
            if x != y:
                parent[x] = y
                forest.append((int(a), b))
    return forest, links


LINKS = "h1 long, h2 long, g1 long, g2 long, links long"


def _compared(join: Join):
    """Groups arrive whole and in order: ``group, side, h1, h2, weight, elements``."""

    def flush(rows: list[dict]) -> pa.RecordBatch:
        unique = {(r["h1"], r["h2"]): r for r in rows}
        kept = list(unique.values())
        elements = [np.frombuffer(r["elements"], dtype=np.uint64) for r in kept]
        side = np.array([r["side"] for r in kept])
        forest, links = compare(
            elements, np.array([r["weight"] for r in kept]), side != 2, side != 1, join
        )
        out = [(kept[a]["h1"], kept[a]["h2"], kept[b]["h1"], kept[b]["h2"], 0) for a, b in forest]
        out += [(r["h1"], r["h2"], None, None, int(n)) for r, n in zip(kept, links, strict=True) if n]
        return pa.RecordBatch.from_pylist(
            [dict(zip(("h1", "h2", "g1", "g2", "links"), row, strict=True)) for row in out],
            schema=pa.schema([(c, pa.int64()) for c in ("h1", "h2", "g1", "g2", "links")]),
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[-1]["group"] != row["group"]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return rows


def _elements(join: Join):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                sets = shingle_sets(words_of(data, offsets, lower=True), join.shingle)
                one, two = class_keys(sets)
                ends = np.cumsum(sets.size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        pa.array(
                            [sets.element[e - n : e].tobytes() for e, n in zip(ends, sets.size, strict=True)],
                            type=pa.binary(),
                        ),
                    ],
                    names=["h1", "h2", "elements"],
                )

    return rows


SENT = "signature long, node long, seen boolean"


def by_signature(texts: DataFrame, join: Join) -> DataFrame:
    return texts.select("text").mapInArrow(_signature_rows(join), SENT)


def by_prefix(texts: DataFrame, known: DataFrame, join: Join) -> DataFrame:
    """Edges ``a, b`` by shared elements of prefixes, in place of signatures."""
    elements = known.agg(F.sum("n_shingles")).first()[0] or 0
    keyed = prefixes(texts.select("text"), elements, _prefix_sets(join), lambda size: prefix_length(size, join))
    marks = known.select(F.col("h1").alias("node"), F.col("n_shingles").alias("size"), "marks")
    return candidates(keyed, marks, join.part, join.whole)


def linked_rows(rows: DataFrame, join: Join = Join()) -> DataFrame:
    """``rows(row, doc_id, text)``: return ``row, doc_id, n_shingles, component_id, n_links``
    and ``component``, which names the component also where ids are shared or missing."""
    texts = rows.select("row", "doc_id", F.col("text").cast("binary").alias("text"))
    by_signatures = join.part * 10 >= join.whole * 9
    more = "" if by_signatures else ", marks array<long>"
    known = stage(
        texts.mapInArrow(
            _doc_rows(join, not by_signatures), "row long, doc_id long, n_shingles long, h1 long, h2 long" + more
        )
    )
    if by_signatures:
        least = F.min("node").over(Window.partitionBy("signature", "seen"))
        edges = (
            by_signature(texts, join)
            .withColumn("least", F.when(F.col("seen"), F.col("signature")).otherwise(least))
            .where("node != least")
            .select(F.col("least").alias("a"), F.col("node").alias("b"))
        )
    else:
        edges = by_prefix(texts, known, join)
    clusters = components(edges)
    classes = stage(
        known.where("n_shingles > 0")
        .groupBy("h1", "h2", "n_shingles")
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("weight"))
    )
    # Candidates: one text of each class in a cluster, and the block it goes to.
    in_cluster = stage(
        classes.join(clusters.select(F.col("node").alias("h1"), "component"), "h1").select(
            "h1", "h2", "n_shingles", "weight", F.col("doc_id").alias("id"), "component"
        )
    )
    cut = in_cluster.groupBy("component").agg(
        F.greatest(
            F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)
        ).alias("blocks")
    )
    wanted = in_cluster.select("id").distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    picked = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
    block = F.pmod(F.xxhash64("h1", "h2"), F.col("blocks"))
    sent_to = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    placed = (
        picked.mapInArrow(_elements(join), "h1 long, h2 long, elements binary")
        .join(in_cluster.drop("n_shingles", "id"), ["h1", "h2"])
        .join(cut, "component")
        .withColumn("own", block)
        .withColumn("other", sent_to)
        .select(
            F.concat_ws(
                "/", "component", F.least("own", "other"), F.greatest("own", "other")
            ).alias("group"),
            # Within one block all meet; of two blocks, those of one meet those of the other.
            F.when(F.col("own") == F.col("other"), 0)
            .when(F.col("own") < F.col("other"), 1)
            .otherwise(2)
            .alias("side"),
            "h1",
            "h2",
            "weight",
            "elements",
        )
    )
    found = stage(
        placed.repartition("group").sortWithinPartitions("group").mapInArrow(_compared(join), LINKS)
    )
    node = F.concat_ws("/", "h1", "h2")
    joined = components(
        found.where("g1 IS NOT NULL").select(node.alias("a"), F.concat_ws("/", "g1", "g2").alias("b"))
    )
    counts = found.where("g1 IS NULL").groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    by_class = (
        classes.withColumn("node", node)
        .join(joined, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    firsts = by_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    outcome = (
        by_class.join(firsts, "component")
        .join(counts, ["h1", "h2"], "left")
        .select(
            "h1",
            "h2",
            "component",
            "component_id",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        )
    )
    return known.drop("marks").join(outcome, ["h1", "h2"], "left").select(
        "row",
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "component",
    )


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()
) -> DataFrame:
    """Return per row ``doc_id, n_shingles, component_id, n_links``.

    ``component_id`` is the least id that links lead to, the row's own included;
    ``n_links`` counts the rows that a row is linked to itself. NULL and empty texts
    have an empty set and no links. Rows of equal id are rows of their own; equal
    sets link whatever their ids. A NULL id is passed over when the least is sought,
    and is the result where a component has no other.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
    )
    return linked_rows(rows, join).drop("row", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """``docs`` with one row of each component: the one of least id, then the first.

    Rows without words are linked with nothing and stay. All columns stay.
    """
    numbered = stage(docs.select(boxed(docs), F.monotonically_increasing_id().alias("row")))
    doc = F.col("doc")
    linked = linked_rows(
        numbered.select(
            "row", doc.getField(id_col).cast("long").alias("doc_id"), doc.getField(text_col).alias("text")
        ),
        join,
    )
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]
    with_words = linked.where("n_shingles > 0").groupBy("component").agg(first.alias("row"))
    kept = with_words.select("row").union(linked.where("n_shingles = 0").select("row"))
    return numbered.join(kept, "row", "left_semi").select(*unboxed(docs))
