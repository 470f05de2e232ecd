"""The price book and the Column expressions it compiles to.

A book is configuration: tens of rules, never data. It becomes constant maps
inside the generated code of the scan stage, so pricing a request needs no join,
no broadcast and no shuffle, whatever the number of distinct models in the facts.
Of a user's list of more than ``INLINE_LIMIT`` model prices, tiers or 1h rates the rules are
rows instead, joined by name or by the first parts of the name, because constant maps
are searched entry by entry. The generated code is the same for any number of them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.functions.fixed_prices import (
    ALIASES,
    SYNTHETIC,
    UNPRICED_FAMILIES,
    Prices,
    builtin_models,
    builtin_tiers,
)
from meterstone.schemas import MONEY, PRICE, PRICES_TYPE, TOKENS

INLINE_LIMIT = 300
BROADCAST_LIMIT = 50_000
#: Tiers of one prefix that are tried one after the other in generated code; longer lists are filtered.
UNROLLED_TIERS = 8
RULES_VERSION = 1
MICRO = Decimal("0.000001")


def as_price(value) -> Decimal:
    """A price in USD per million tokens; more than six decimals cannot be kept."""
    given = Decimal(str(value))
    kept = given.quantize(MICRO)
    if kept != given:
        raise ValueError(f"a price has six decimals at most: {value}")
    return kept


def as_prices(values: Iterable) -> Prices:
    """Four non-missing numbers."""
    out = tuple(as_price(v) for v in values)
    if len(out) != 4:
        raise ValueError("a price is a list of four numbers")
    return out


def as_tiers(tiers: Iterable) -> tuple[tuple[int, Prices], ...]:
    """Tiers as (threshold, prices), ascending, thresholds not negative."""
    out = sorted((int(t), as_prices(p)) for t, p in tiers)
    if any(t < 0 for t, _ in out):
        raise ValueError("a tier threshold must not be negative")
    return tuple(out)


def canonical_name(model: str) -> str:
    return ALIASES.get(model, model)


def canonical(model: Column) -> Column:
    """Replace the known other names of a model."""
    name = F.coalesce(model, F.lit(""))
    out = F.when(name == next(iter(ALIASES)), ALIASES[next(iter(ALIASES))])
    for alias, target in list(ALIASES.items())[1:]:
        out = out.when(name == alias, target)
    return out.otherwise(name)


class Name:
    """A model name and its first n dash-separated parts, as expressions or columns."""

    def __init__(self, whole: Column, parts: dict[int, Column] | None = None) -> None:
        self.whole = whole
        self._parts = parts or {}

    @classmethod
    def of(cls, model: Column) -> Name:
        return cls(canonical(model))

    def first(self, count: int) -> Column:
        known = self._parts.get(count)
        return F.substring_index(self.whole, "-", count) if known is None else known


def by_part_count(prefixes: Iterable[str]) -> dict[int, list[str]]:
    """Prefixes grouped by their number of parts, most parts first."""
    groups: dict[int, list[str]] = {}
    for prefix in sorted(prefixes):
        groups.setdefault(prefix.count("-") + 1, []).append(prefix)
    return dict(sorted(groups.items(), reverse=True))


def any_boundary(name: Name, prefixes: Iterable[str]) -> Column:
    """One of the prefixes itself, or one followed by ``-``.

    A prefix of n parts can only match the first n parts of a name, so every
    test is an equality.
    """
    out = F.lit(False)
    for count, group in by_part_count(prefixes).items():
        out = out | F.array_contains(constant(group, "array<string>"), name.first(count))
    return out


def unpriced_family(name: Name) -> Column:
    return any_boundary(name, UNPRICED_FAMILIES)


def micro_price(price: Decimal) -> int:
    """A price in whole micro-dollars per million tokens, that is pico-dollars per token."""
    return int(price.scaleb(6))


def price_value(prices: Prices) -> dict[str, int]:
    return {n: micro_price(p) for n, p in zip(PRICES_TYPE.fieldNames(), prices, strict=True)}


PRICES_DDL = PRICES_TYPE.simpleString()
TIERS_DDL = f"array<struct<threshold:bigint,prices:{PRICES_DDL}>>"
RULE_DDL = f"struct<tiers:{TIERS_DDL},excluded:array<string>>"


def constant(value, ddl: str) -> Column:
    """A nested constant as one JSON literal, which the optimizer folds into a value."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def tier_values(tiers: Iterable[tuple[int, Prices]]) -> list[dict]:
    """Tiers of one prefix, highest threshold first."""
    return [
        {"threshold": threshold, "prices": price_value(prices)}
        for threshold, prices in sorted(tiers, reverse=True)
    ]


def prefix_lookup(name: Name, table: dict[str, object], ddl: str) -> list[Column]:
    """Values of the matching prefixes in a constant map, longest prefix first."""
    return [
        F.try_element_at(
            constant({prefix: table[prefix] for prefix in group}, f"map<string,{ddl}>"),
            name.first(count),
        )
        for count, group in by_part_count(table).items()
    ]


def longest_prefix(name: Name, prefixes: Iterable[str]) -> Column:
    """The longest of the prefixes that matches, NULL if none does."""
    levels = [
        F.when(F.array_contains(constant(group, "array<string>"), name.first(count)), name.first(count))
        for count, group in by_part_count(prefixes).items()
    ]
    return F.coalesce(*levels)


def no_price() -> Column:
    return F.lit(None).cast(PRICES_TYPE)


def exceeded(tiers: Column, most: int, total_input: Column) -> Column:
    """Prices of the highest threshold that ``total_input`` strictly exceeds."""
    if most > UNROLLED_TIERS:
        return F.get(F.filter(tiers, lambda tier: total_input > tier["threshold"]), F.lit(0))["prices"]
    steps = []
    for i in range(most):
        tier = F.get(tiers, F.lit(i))
        steps.append(F.when(total_input > tier["threshold"], tier["prices"]))
    return F.coalesce(*steps)


def in_dollars(price: Column) -> Column:
    """A looked-up price in USD per million tokens."""
    return (price.cast("decimal(19,0)") * F.lit(MICRO).cast("decimal(7,6)")).cast(PRICE)


@dataclass(frozen=True)
class PriceBook:
    """Built-in rules plus the user's own prices, tiers, 1h rates and switches."""

    models: dict[str, Prices] = field(default_factory=dict)
    tiers: dict[str, tuple[tuple[int, Prices], ...]] = field(default_factory=dict)
    write_1h: dict[str, Decimal] = field(default_factory=dict)
    disabled: frozenset[str] = frozenset()

    @classmethod
    def of(cls, models=None, tiers=None, write_1h=None, disabled=()) -> PriceBook:
        """Build a book from plain numbers; keys may be other names of a model."""
        return cls(
            {canonical_name(m): as_prices(p) for m, p in (models or {}).items()},
            {canonical_name(m): as_tiers(t) for m, t in (tiers or {}).items()},
            {canonical_name(m): as_price(v) for m, v in (write_1h or {}).items()},
            frozenset(canonical_name(m) for m in disabled),
        )

    @property
    def rule_count(self) -> int:
        tiers = sum(len(t) for t in self.tiers.values())
        return len(self.models) + tiers + len(self.write_1h) + len(self.disabled)

    @property
    def version(self) -> str:
        """Stamp that changes whenever a rule, built in or user's, changes."""
        payload = {
            "rules": RULES_VERSION,
            "aliases": sorted(ALIASES.items()),
            "builtin": sorted((m, list(map(str, p))) for m, p in builtin_models().items()),
            "builtin_tiers": sorted(
                (p, t, list(map(str, v)), list(x)) for p, t, v, x in builtin_tiers()
            ),
            "unpriced": sorted(UNPRICED_FAMILIES),
            "models": sorted((m, list(map(str, p))) for m, p in self.models.items()),
            "tiers": sorted(
                (m, [[t, list(map(str, p))] for t, p in rows]) for m, rows in self.tiers.items()
            ),
            "write_1h": sorted((m, str(v)) for m, v in self.write_1h.items()),
            "disabled": sorted(self.disabled),
        }
        text = json.dumps(payload, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()

    # ── lookups ──────────────────────────────────────────────────────────

    def base_price(self, model: Column) -> Column:
        """Price struct of a model, NULL when it has none."""
        name = Name.of(model)
        return self._base_price(name, longest_prefix(name, builtin_models()), unpriced_family(name))

    def _base_price(
        self, name: Name, prefix: Column, unpriced: Column, own_price: Column | None = None
    ) -> Column:
        builtin = {m: price_value(p) for m, p in builtin_models().items()}
        inherited = F.try_element_at(constant(builtin, f"map<string,{PRICES_DDL}>"), prefix)
        free = constant(price_value(as_prices((0, 0, 0, 0))), PRICES_DDL)
        price = F.when(name.whole == SYNTHETIC, free).when(~unpriced, inherited)
        if own_price is not None:
            return F.coalesce(own_price, price)
        if not self.models:
            return price
        own = {m: price_value(p) for m, p in self.models.items() if m != SYNTHETIC}
        exact = F.try_element_at(constant(own, f"map<string,{PRICES_DDL}>"), name.whole)
        return F.coalesce(exact, price)

    def is_priced(self, model: Column) -> Column:
        """P4."""
        return self.base_price(model).isNotNull()

    def label(self, model: Column) -> Column:
        """What a report shows for a model id."""
        name = F.coalesce(model, F.lit(""))
        return (
            F.when(name == "", "(unknown)")
            .when(~self.is_priced(name), "Unknown")
            .otherwise(name)
        )

    def tier_price(self, model: Column, total_input: Column) -> Column:
        """Request-size price above a threshold, NULL when no tier applies.

        User rules come first, longest prefix first, and win over the unpriced
        families; a rule none of whose thresholds is exceeded lets the next
        shorter one try.
        """
        name = Name.of(model)
        own, rule = self._own_rules(name), self._builtin_rule(name)
        return self._tier_price(name, own, rule, unpriced_family(name), total_input)

    def _own_rules(self, name: Name) -> list[Column]:
        """Tiers of the matching user prefixes, longest first."""
        table = {p: tier_values(rows) for p, rows in self.tiers.items()}
        return prefix_lookup(name, table, TIERS_DDL)

    def _builtin_rule(self, name: Name) -> Column:
        """Tiers and exceptions of the matching built-in prefix; these prefixes never nest."""
        table: dict[str, dict] = {}
        for prefix, threshold, prices, excluded in builtin_tiers():
            if prefix not in self.disabled:
                rule = table.setdefault(prefix, {"tiers": [], "excluded": list(excluded)})
                rule["tiers"] = tier_values([(threshold, prices)]) + rule["tiers"]
        if not table:
            return F.lit(None).cast(RULE_DDL)
        key = longest_prefix(name, table)
        return F.try_element_at(constant(table, f"map<string,{RULE_DDL}>"), key)

    def _tier_price(
        self, name: Name, own: list[Column], rule: Column, unpriced: Column, total_input: Column
    ) -> Column:
        rules = builtin_tiers()
        most_own = max((len(rows) for rows in self.tiers.values()), default=0)
        most = max(sum(r[0] == prefix for r in rules) for prefix in {r[0] for r in rules})
        skip = unpriced
        for count in by_part_count(x for r in rules for x in r[3]):
            skip = skip | F.array_contains(rule["excluded"], name.first(count))
        inherited = F.when(~skip, exceeded(rule["tiers"], most, total_input))
        return F.coalesce(*[exceeded(tiers, most_own, total_input) for tiers in own], inherited)

    def write_1h_price(self, model: Column, input_price: Column) -> Column:
        """The user's 1h rate of the longest prefix, else twice the input price in force."""
        return self._write_1h_price(Name.of(model), input_price)

    def _write_1h_price(self, name: Name, input_price: Column) -> Column:
        twice = input_price * F.lit(2)
        if not self.write_1h:
            return twice
        own = {p: micro_price(v) for p, v in self.write_1h.items()}
        return F.coalesce(*prefix_lookup(name, own, "bigint"), twice)

    def part_counts(self) -> list[int]:
        """How many leading parts of a name any rule looks at."""
        names = [*builtin_models(), *UNPRICED_FAMILIES, *self.tiers, *self.write_1h]
        for prefix, _, _, excluded in builtin_tiers():
            names += [prefix, *excluded]
        return list(by_part_count(names))

    def _own_prices(self, df: DataFrame, step: dict[str, str]) -> DataFrame:
        """The user's model prices as rows; broadcast up to a checked number."""
        rows = [
            (m, tuple(price_value(p).values())) for m, p in self.models.items() if m != SYNTHETIC
        ]
        ddl = f"{step['name']} string, {step['own']} {PRICES_DDL}"
        frame = df.sparkSession.createDataFrame(rows, ddl)
        return F.broadcast(frame) if len(rows) <= BROADCAST_LIMIT else frame

    def _long_rules(
        self, df: DataFrame, name: Name, table: dict[str, object], ddl: str, target: str
    ) -> tuple[DataFrame, list[Column]]:
        """``df`` with the values of the matching prefixes of a long table, and these, longest first.

        A prefix of n parts can only match the first n parts of a name: one equi-join for
        every number of parts. Tables are broadcast up to a checked number of rows; beyond, joins are
        Spark's own, which split hot models.
        """
        found = []
        for count, group in by_part_count(table).items():
            key, value = f"__{target}_key{count}", f"__{target}_value{count}"
            text = df.sparkSession.createDataFrame([(p, json.dumps(table[p])) for p in group], f"{key} string, text string")
            rules = text.select(key, F.from_json("text", f"struct<v:{ddl}>")["v"].alias(value))
            if len(group) <= BROADCAST_LIMIT:
                rules = F.broadcast(rules)
            df = df.join(rules, name.first(count) == F.col(key), "left").drop(key)
            found.append(F.col(value))
        return df, found

    def with_cost(
        self,
        df: DataFrame,
        target: str,
        model: Column,
        input_tokens: Column,
        output_tokens: Column,
        cache_read_tokens: Column,
        cache_creation_tokens: Column,
        cache_creation_1h_tokens: Column | None = None,
        *,
        long_context: bool | Column = True,
    ) -> DataFrame:
        """Add the exact cost in micro-dollars; 0 for no usage, NULL when unpriced.

        ``long_context`` says whether request-size rates apply; a column says so
        row by row.

        Works in steps, each a column the next one uses several times. The
        optimizer keeps such steps apart, so every row is looked up once, and the
        generated methods stay small enough for the JVM to compile.
        """
        step = {
            k: f"__{target}_{k}"
            for k in ("name", "own", "unpriced", "prefix", "rule", "total", "rate", "quick")
        }
        counts = {n: f"__{target}_first{n}" for n in self.part_counts()}
        name = Name(F.col(step["name"]), {n: F.col(c) for n, c in counts.items()})
        rate = F.col(step["rate"])
        long_write = F.lit(0) if cache_creation_1h_tokens is None else cache_creation_1h_tokens
        idle = (
            (input_tokens <= 0)
            & (output_tokens <= 0)
            & (cache_read_tokens <= 0)
            & (cache_creation_tokens <= 0)
            & (long_write <= 0)
        )
        parts = [
            (input_tokens, rate["input"]),
            (output_tokens, rate["output"]),
            (cache_read_tokens, rate["cache_read"]),
        ]
        out = df.withColumn(step["name"], canonical(model)).withColumns(
            {c: F.substring_index(name.whole, "-", n) for n, c in counts.items()}
        )
        joined: list[Column] = []
        if cache_creation_1h_tokens is None:
            parts.append((cache_creation_tokens, rate["cache_write"]))
        else:
            hour = F.greatest(F.least(long_write, cache_creation_tokens), F.lit(0))
            parts.append((cache_creation_tokens - hour, rate["cache_write"]))
            if len(self.write_1h) > INLINE_LIMIT:
                rates = {p: {"v": micro_price(v)} for p, v in self.write_1h.items()}
                out, hourly = self._long_rules(out, name, rates, "bigint", f"{target}_1h")
                joined += hourly
                parts.append((hour, F.coalesce(*hourly, rate["input"] * F.lit(2))))
            else:
                parts.append((hour, self._write_1h_price(name, rate["input"])))
        # Whole pico-dollars in 64 bits. They are NULL when that overflows, which
        # only sums over very many requests can do: then the decimal form steps in.
        quick = None
        wide = None
        for count, price in parts:
            count = count.cast("bigint")
            product = F.try_multiply(count, price)
            quick = product if quick is None else F.try_add(quick, product)
            exact = count.cast(TOKENS) * price.cast("decimal(18,0)")
            wide = exact if wide is None else wide + exact
        unit = F.lit(MICRO).cast("decimal(7,6)")
        amount = F.when(idle, F.lit(0).cast(MONEY)).otherwise(
            F.coalesce(
                (F.col(step["quick"]).cast("decimal(19,0)") * unit).cast(MONEY),
                (wide.cast("decimal(31,0)") * unit).cast(MONEY),
            )
        )
        total_input = input_tokens + cache_read_tokens + cache_creation_tokens
        countable = (
            (input_tokens >= 0) & (cache_read_tokens >= 0) & (cache_creation_tokens >= 0)
        )
        out = out.withColumn(step["unpriced"], unpriced_family(name))
        unpriced = F.col(step["unpriced"])
        own_price = None
        if len(self.models) > INLINE_LIMIT:
            out = out.join(self._own_prices(df, step), step["name"], "left")
            own_price = F.col(step["own"])
        found = {step["prefix"]: longest_prefix(name, builtin_models())}
        base = self._base_price(name, F.col(step["prefix"]), unpriced, own_price)
        if long_context is not False:
            if isinstance(long_context, Column):
                countable = countable & long_context
            if len(self.tiers) > INLINE_LIMIT:
                table = {p: {"v": tier_values(rows)} for p, rows in self.tiers.items()}
                out, own = self._long_rules(out, name, table, TIERS_DDL, f"{target}_tiers")
                joined, mine = [*joined, *own], {}
            else:
                mine = {f"__{target}_own{i}": r for i, r in enumerate(self._own_rules(name))}
                own = [F.col(c) for c in mine]
            tier = self._tier_price(
                name, own, F.col(step["rule"]), unpriced, F.col(step["total"])
            )
            found |= {
                **mine,
                step["rule"]: self._builtin_rule(name),
                step["total"]: F.when(countable, total_input),
            }
            out = out.withColumns(found).withColumn(step["rate"], F.coalesce(tier, base))
        else:
            out = out.withColumns(found).withColumn(step["rate"], base)
        return (
            out.withColumn(step["quick"], quick)
            .withColumn(target, amount)
            .drop(*joined)
            .drop(*step.values(), *counts.values(), *found)
        )


BUILTIN = PriceBook()
