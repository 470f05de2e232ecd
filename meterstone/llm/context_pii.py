"""Personal data by pattern, and by the contexts that the patterns' finds stand in.

Base finds come from regular expressions and checks. They are the seeds of a
bootstrap: the words around them make lexical patterns, other tokens in the same
contexts are candidates, and the graph of patterns and values is scored in rounds.
A pattern is as sure as the share of known values in it; a candidate is as sure as
its patterns taken together; sure candidates count as known in the next round.
Secrets (tokens, keys, passwords) have no base pattern: what looks like one and is called
one, as in ``token = "..."``, is a seed, and contexts reveal others by the same rounds.
Everything is DataFrame work: the text is marked by ``regexp_replace``, split at the
marks, and positions are running sums of the lengths of the pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterstone.llm.common import boxed, stage, unboxed

#: What the base patterns find, and what the method may find.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")

# What a secret is called right before it.
NAMES = (
    "token", "secret", "password", "passwd", "pwd", "passphrase", "credential", "credentials", "auth",
    "api key", "access key", "secret key", "private key",
)
_NAME = "|".join(NAMES).replace(" ", "[ _-]?")
CALLED = rf"""(?:^|[^a-z])(?:(?:{_NAME})["']?\s?(?:=|:|:=|=>|is)|bearer)$"""

#: The marks between pieces; where a text holds the first it is read as the second,
#: which no pattern tells apart.
MARK, OTHER = "\u0001", "\u0002"

# Each pattern starts where its leading run starts, or where the last find ended, and
# never gives back what it has taken: that finds the same as trying every position,
# in one pass over long runs.
_TOKEN = r"\x20\x09-\x0D"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": rf"(?<![^{_TOKEN}])[^0-9@{_TOKEN}]*+[0-9@][^{_TOKEN}]*+",
}

#: Characters of context kept on either side of a find.
CONTEXT = 48

#: A candidate longer than this goes by its digest among the values; it is no number.
LONG = 64


@dataclass(frozen=True)
class Bootstrap:
    rounds: int = 3
    #: Distinct known values that a pattern needs before it is believed at all.
    support: int = 3
    #: Certainty that a candidate needs.
    accept: float = 0.8
    #: Weight of values that nothing is known about, among those of a pattern.
    unknown: float = 0.25


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check."""
    turned = F.reverse(number)

    def add(total: Column, at: Column) -> Column:
        digit = F.substr(turned, at, F.lit(1)).cast("int")
        double = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(at % 2 == 0, double).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """The checks of the base kinds; every token is a candidate so far."""
    small = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    number = digits(value)
    size = F.length(number)
    return (
        F.when(kind == "ip", value.rlike(rf"^{small}(?:\.{small}){{3}}$"))
        .when(kind == "card", F.when(size.between(12, 19), luhn(number)).otherwise(False))
        .when(kind == "phone", size.between(9, 15))
        .otherwise(True)
    )


def looks_like(kind: Column, value: Column) -> Column:
    """Whether a candidate could be one of ``kind`` at all."""
    size = F.length(digits(value))
    return (
        F.when(kind == "email", value.rlike("^[^@]*[a-z0-9][^@]*@[^@]*[a-z0-9]"))
        .when(kind == "ip", (size >= 4) & value.rlike("[.:]"))
        .when(kind == "secret", F.length(value) >= 8)
        .when(kind == "card", (size >= 12) & (F.length(value) <= LONG))
        .otherwise((size >= 7) & (F.length(value) <= LONG))
    )


def secret_seed(value: Column, before: Column) -> Column:
    """Whether a candidate looks like a secret and is called one by the words before it."""
    shape = value.rlike(r"^(?=.*[a-z])[a-z0-9_+/=.~-]{16,}$")
    return F.coalesce(shape & F.array_join(before, " ").rlike(CALLED), F.lit(False))


def pieces(text: Column) -> Column:
    """By kind: the pieces of the text between marks, odd ones being finds.

    Only lengths, finds and, of tokens, the ends of what stands between them are kept, and
    only for kinds that found something.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), MARK, OTHER)

    def of(kind: str) -> Column:
        parts = F.split(F.regexp_replace(clean, PATTERNS[kind], f"{MARK}$0{MARK}"), MARK, -1)
        token = F.lit(kind == "token")
        small = F.transform(
            parts,
            lambda part, at: F.struct(
                F.length(part).alias("size"),
                F.when(at % 2 == 1, part).alias("value"),
                F.when(token & (at % 2 == 0), F.right(part, F.lit(CONTEXT))).alias("tail"),
                F.when(token & (at % 2 == 0), F.left(part, F.lit(CONTEXT))).alias("head"),
            ),
        )
        return F.struct(F.lit(kind).alias("kind"), small.alias("parts"))

    return F.filter(F.array(*map(of, PATTERNS)), lambda x: F.size(x["parts"]) > 1)


def finds(found: DataFrame) -> DataFrame:
    """``row, kind, start, stop, value, before, after, seed`` of what passes the checks.

    Every find begins and ends in a token, a word with a digit or an @. The words around
    it come from there, whatever its kind: what the token holds beside the find, and what
    stands around the token. The windows run within one text.
    """
    exploded = found.select("row", F.explode("found").alias("f")).select(
        "row", "f.kind", F.posexplode("f.parts").alias("at", "part")
    )
    order = Window.partitionBy("row", "kind").orderBy("at")
    token = F.col("kind") == "token"

    def near(name: str, by: int) -> Column:
        part = F.col(f"part.{name}")
        cut = part if name != "value" else (F.right if by < 0 else F.left)(part, F.lit(CONTEXT))
        return F.coalesce(F.lag(cut, -by).over(order) if by < 0 else F.lead(cut, by).over(order), F.lit(""))

    # Two words before, and one after, reach no further than the next two tokens, and one.
    left = F.concat(near("value", -4), near("tail", -3), near("value", -2), near("tail", -1))
    right = F.concat(near("head", 1), near("value", 2))
    placed = (
        exploded.select(
            "row",
            "kind",
            F.col("part.value").alias("value"),
            F.sum("part.size").over(order).alias("stop"),
            F.col("part.size").alias("size"),
            F.when(token, F.right(left, F.lit(CONTEXT))).alias("left"),
            F.when(token, F.left(right, F.lit(CONTEXT))).alias("right"),
        )
        .where("value IS NOT NULL")
        .where(valid(F.col("kind"), F.col("value")))
        .withColumn("begin", F.col("stop") - F.col("size"))
    )
    word = F.when(token, F.struct("begin", "stop", "value", "left", "right"))
    by = Window.partitionBy("row")
    rank_ = F.when(token, 0).otherwise(1)
    last = F.when(token, F.col("begin")).otherwise(F.col("stop") - 1)
    until = (Window.unboundedPreceding, Window.currentRow)
    # A candidate loses the punctuation around it, and the name that it is set to.
    opening = r"^(?:[\"'(\[{<]*[A-Za-z_][A-Za-z_.-]*+=(?=[^=]))?+[\"'(\[{<]*+"
    lead = F.length(F.regexp_extract("value", opening, 0))
    # Between quotes it ends with them, whatever follows.
    body = r"((?<=[\"'])[^\"']+(?=[\"'])|.*?(?=[\"')\]}>.,;:!?]*$))"
    core = F.regexp_extract("value", "(?s)" + opening + body, 1)
    cut = (
        placed.withColumn("first", F.last(word, ignorenulls=True).over(by.orderBy("begin", rank_).rowsBetween(*until)))
        .withColumn("final", F.last(word, ignorenulls=True).over(by.orderBy(last, rank_).rowsBetween(*until)))
        .select(
            "row",
            "kind",
            (F.col("begin") + F.when(token, lead).otherwise(0)).alias("start"),
            F.when(token, F.col("begin") + lead + F.length(core)).otherwise(F.col("stop")).alias("stop"),
            F.lower(F.when(token, core).otherwise(F.col("value"))).alias("value"),
            "first",
            "final",
        )
    )

    def words(text: Column) -> Column:
        """Words of a context: numbers and addresses as such, quotes on their own left out."""
        spaced = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), "(?<![=!<>:])=(?![=>])", " = ")
        parts = F.filter(F.split(spaced, rf"[{_TOKEN}]+"), lambda w: ~w.rlike("^[\"'`]*$"))
        return F.transform(parts, lambda w: F.when(w.contains("@"), "@").otherwise(w))

    inside = F.left(F.col("first.value"), (F.col("start") - F.col("first.begin")).cast("int"))
    rest = F.right(F.col("final.value"), (F.col("final.stop") - F.col("stop")).cast("int"))
    before = words(F.right(F.concat("first.left", inside), F.lit(CONTEXT)))
    after = words(F.left(F.concat(rest, "final.right"), F.lit(CONTEXT)))
    two = F.slice(before, F.greatest(F.size(before) - 1, F.lit(1)), F.lit(2))
    named = F.concat(F.lit("sha256 "), F.sha2("value", 256))
    return cut.where(
        ~token
        | (
            (F.length("value") >= 6)
            & ((F.length(digits(F.col("value"))) >= 4) | F.col("value").contains("@"))
        )
    ).select(
        "row",
        "kind",
        "start",
        "stop",
        F.when(token & (F.length("value") > LONG), named).otherwise(F.col("value")).alias("value"),
        two.alias("before"),
        F.try_element_at(after, F.lit(1)).alias("after"),
        (token & secret_seed(F.col("value"), two)).alias("seed"),
    )


def without_overlap(spans: DataFrame) -> DataFrame:
    """Drop candidates that overlap a base find of their text, by running bounds."""
    base = F.col("kind") != "token"
    order = Window.partitionBy("row").orderBy("start", F.when(base, 0).otherwise(1), "stop")
    ended = F.max(F.when(base, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return (
        spans.withColumn("ended", ended)
        .withColumn("begins", begins)
        .where(
            base
            | (
                (F.coalesce("ended", F.lit(0)) <= F.col("start"))
                & (F.coalesce(F.col("begins") >= F.col("stop"), F.lit(True)))
            )
        )
        .drop("ended", "begins")
    )


def edges_of(spans: DataFrame) -> DataFrame:
    """Pattern and value pairs, each once, with the kind that the value is seed of or NULL.

    A pattern is the two words before a find, or the word before and the word after.
    """
    before = F.col("before")
    near = F.array_join(before, " ")
    pattern = F.array(
        F.when(F.size(before) == 2, F.concat(F.lit("b "), near)),
        F.concat(F.lit("a "), F.try_element_at(before, F.lit(-1)), F.lit(" _ "), F.coalesce("after", F.lit(""))),
    )
    return (
        spans.withColumn("pattern", F.explode(pattern))
        .where("pattern IS NOT NULL")
        .groupBy("pattern", "value")
        .agg(F.min(F.when(F.col("seed"), "secret").when(F.col("kind") != "token", F.col("kind"))).alias("kind"))
    )


def discovered(spans: DataFrame, how: Bootstrap) -> DataFrame:
    """``value, kind`` of the candidates that the bootstrap accepts, seeds among them."""
    edges = stage(edges_of(spans).withColumnRenamed("kind", "base"))
    kinds = F.explode(F.array(*map(F.lit, KINDS)))
    known: DataFrame | None = None
    for _ in range(how.rounds):
        named = edges.select("*", F.col("base").alias("kind"), F.when(F.col("base").isNotNull(), 1.0).alias("sure"))
        if known is not None:
            more = known.select("value", F.col("kind").alias("found"), F.col("sure").alias("found_sure"))
            named = edges.join(more, "value", "left").select(
                "pattern",
                "value",
                "base",
                F.coalesce("base", "found").alias("kind"),
                F.when(F.col("base").isNotNull(), 1.0).otherwise(F.col("found_sure")).alias("sure"),
            )
        # Patterns that enough known values of one kind stand in, those of the round
        # before among them; only their edges matter.
        believed = (
            named.where("kind IS NOT NULL")
            .groupBy("pattern", "kind")
            .count()
            .where(F.col("count") >= how.support)
            .select("pattern")
            .distinct()
        )
        graph = stage(named.join(believed, "pattern", "left_semi"))
        own = F.col("of") == F.col("kind")
        patterns = (
            graph.withColumn("of", kinds)
            .groupBy("pattern", "of")
            .agg(
                F.sum(F.when(own, F.col("sure")).otherwise(0.0)).alias("pro"),
                F.count(F.when(own, 1)).alias("known"),
                F.sum(
                    F.when(own, 0.0)
                    .when(F.col("kind").isNotNull() | ~looks_like(F.col("of"), F.col("value")), 1.0)
                    .otherwise(how.unknown)
                ).alias("contra"),
            )
            .where(F.col("known") >= how.support)
            .select("pattern", "of", (F.col("pro") / (F.col("pro") + F.col("contra") + 0.5)).alias("trust"))
        )
        scored = (
            graph.where("base IS NULL")
            .join(patterns, "pattern")
            .where(looks_like(F.col("of"), F.col("value")))
            .groupBy("value", "of")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("sure"))
            .where(F.col("sure") >= how.accept)
            # One kind for a value: the surest, then the first in order.
            .groupBy("value")
            .agg(F.max(F.struct("sure", (-F.array_position(F.array(*map(F.lit, KINDS)), F.col("of"))).alias("o"), "of")).alias("m"))
            .select("value", F.col("m.of").alias("kind"), F.col("m.sure").alias("sure"))
        )
        known = stage(scored)
    # A value is a seed wherever it stands, also where nothing calls it a secret.
    seeds = spans.where("seed").select("value", F.lit("secret").alias("kind")).distinct()
    return seeds.union(known.select("value", "kind").join(seeds, "value", "left_anti"))


def rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def all_spans(found: DataFrame, how: Bootstrap) -> DataFrame:
    """``row, kind, start, stop, base`` of base and added finds."""
    spans = stage(without_overlap(finds(found.where(F.size("found") > 0))))
    added = (
        spans.where("kind = 'token'")
        .drop("kind")
        .join(discovered(spans, how), "value")
        .select("row", "kind", "start", "stop", F.lit(False).alias("base"))
    )
    base = spans.where("kind != 'token'")
    return base.select("row", "kind", "start", "stop", F.lit(True).alias("base")).union(added)


def find_pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Bootstrap = Bootstrap()
) -> DataFrame:
    """Return per row its id as ``doc_id`` and ``spans``: array of ``start, rank, kind,
    stop, base`` in order; positions are code points, ``stop`` is exclusive.

    A candidate has six characters or more, among them four digits or an @, at any length.
    Finds of different kinds may overlap; added ones overlap no base find. NULL and
    empty texts have none. Repeated rows are searched each for themselves; in the
    bootstrap a value counts once per pattern, however often it is repeated. An empty
    table gives an empty result.
    """
    rows = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("doc_id"),
            pieces(F.col(text_col)).alias("found"),
        )
    )
    listed = (
        all_spans(rows.select("row", "found"), how)
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", rank(F.col("kind")).alias("rank"), "kind", "stop", "base"))).alias("spans"))
    )
    return (
        rows.select("row", "doc_id")
        .join(listed, "row", "left")
        .select("doc_id", F.coalesce("spans", F.expr("array()").cast(listed.schema["spans"].dataType)).alias("spans"))
    )


def mask_pii(docs: DataFrame, text_col: str = "text", how: Bootstrap = Bootstrap()) -> DataFrame:
    """Return ``docs`` with every find in ``text_col`` replaced by its kind, as ``[EMAIL]``.

    Overlapping finds become one, named after the first. Texts without finds, NULL
    ones among them, stay as they are, and so do all other columns.
    """
    numbered = stage(docs.select(boxed(docs), F.monotonically_increasing_id().alias("row")))
    text = F.col("doc").getField(text_col)
    found = stage(numbered.select("row", pieces(text).alias("found")))
    order = Window.partitionBy("row").orderBy("start", rank(F.col("kind")), "stop")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = (
        all_spans(found, how)
        .withColumn("new", (F.col("start") >= F.coalesce(reached, F.lit(0))).cast("int"))
        .withColumn("part", F.sum("new").over(order))
        .groupBy("row", "part")
        .agg(
            F.min("start").alias("start"),
            F.max("stop").alias("stop"),
            F.min(F.struct("start", rank(F.col("kind")), "kind"))["kind"].alias("kind"),
        )
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("masks"))
    )
    masks = F.col("masks")

    def upto(mask: Column, at: Column) -> Column:
        last = F.when(at == 0, 0).otherwise(F.try_element_at(masks, at.cast("int"))["stop"]).cast("int")
        return F.concat(
            F.substr(text, last + 1, (mask["start"] - last).cast("int")),
            F.concat(F.lit("["), F.upper(mask["kind"]), F.lit("]")),
        )

    rest = F.substr(text, (F.try_element_at(masks, F.lit(-1))["stop"] + 1).cast("int"))
    masked = F.when(masks.isNull(), text).otherwise(
        F.concat(F.array_join(F.transform(masks, upto), ""), rest)
    )
    return numbered.join(parts, "row", "left").select(*unboxed(docs, **{text_col: masked}))
