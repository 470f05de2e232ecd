"""Built-in price rules. All values in this module are fixed values."""

from __future__ import annotations

from decimal import Decimal

# USD per one million tokens, as (input, output, cache read, cache write).
MODEL_PRICES = {
    "claude-opus-4-7": ("5.0", "25.0", "0.50", "6.25"),
    "claude-opus-4-6": ("5.0", "25.0", "0.50", "6.25"),
    "claude-opus-4-5": ("5.0", "25.0", "0.50", "6.25"),
    "claude-opus-4-1": ("15.0", "75.0", "1.50", "18.75"),
    "claude-opus-4": ("15.0", "75.0", "1.50", "18.75"),
    "claude-sonnet-4-6": ("3.0", "15.0", "0.30", "3.75"),
    "claude-sonnet-4-5": ("3.0", "15.0", "0.30", "3.75"),
    "claude-sonnet-4": ("3.0", "15.0", "0.30", "3.75"),
    "claude-sonnet-3-7": ("3.0", "15.0", "0.30", "3.75"),
    "claude-3-7-sonnet": ("3.0", "15.0", "0.30", "3.75"),
    "claude-3-5-sonnet": ("3.0", "15.0", "0.30", "3.75"),
    "claude-haiku-4-5": ("1.0", "5.0", "0.10", "1.25"),
    "claude-haiku-3-5": ("0.80", "4.0", "0.08", "1.00"),
    "claude-3-5-haiku": ("0.80", "4.0", "0.08", "1.00"),
    "claude-3-opus": ("15.0", "75.0", "1.50", "18.75"),
    "claude-3-haiku": ("0.25", "1.25", "0.03", "0.30"),
    "gpt-5.5": ("5.0", "30.0", "0.50", "0.0"),
    "gpt-5.4-mini": ("0.75", "4.5", "0.075", "0.0"),
    "gpt-5.4-nano": ("0.20", "1.25", "0.02", "0.0"),
    "gpt-5.4": ("2.5", "15.0", "0.25", "0.0"),
    "gpt-5.2-codex": ("1.75", "14.0", "0.175", "0.0"),
    "gpt-5.2-chat-latest": ("1.75", "14.0", "0.175", "0.0"),
    "gpt-5.2": ("1.75", "14.0", "0.175", "0.0"),
    "gpt-5.1-codex-max": ("1.25", "10.0", "0.125", "0.0"),
    "gpt-5.1-codex": ("1.25", "10.0", "0.125", "0.0"),
    "gpt-5.1-chat-latest": ("1.25", "10.0", "0.125", "0.0"),
    "gpt-5.1": ("1.25", "10.0", "0.125", "0.0"),
    "gpt-5-codex": ("1.25", "10.0", "0.125", "0.0"),
    "gpt-5-chat-latest": ("1.25", "10.0", "0.125", "0.0"),
    "gpt-5": ("1.25", "10.0", "0.125", "0.0"),
    "gpt-5.3-codex": ("1.75", "14.0", "0.175", "0.0"),
    "gpt-5.3-chat-latest": ("1.75", "14.0", "0.175", "0.0"),
    "gpt-5.3": ("1.75", "14.0", "0.175", "0.0"),
    "gemini-3.1-pro": ("2.00", "12.00", "0.20", "0.0"),
    "gemini-3.1-flash-lite": ("0.25", "1.50", "0.025", "0.0"),
    "gemini-3-pro": ("2.00", "12.00", "0.20", "0.0"),
    "gemini-3-flash": ("0.50", "3.00", "0.05", "0.0"),
    "gemini-2.5-pro": ("1.25", "10.00", "0.125", "0.0"),
    "gemini-2.5-flash": ("0.30", "2.50", "0.03", "0.0"),
    "gemini-2.5-flash-lite": ("0.10", "0.40", "0.01", "0.0"),
    "gemini-2.0-flash": ("0.10", "0.40", "0.025", "0.0"),
    "gemini-2.0-flash-lite": ("0.075", "0.30", "0.0", "0.0"),
}

# Request-size rates, applied above the threshold:
# (prefix, threshold, (input, output, cache read, cache write), prefixes they are not for).
LONG_CONTEXT = (
    ("gpt-5.5", 272_000, ("10.0", "45.0", "1.0", "0.0"), ()),
    ("gpt-5.4", 272_000, ("5.0", "22.5", "0.50", "0.0"), ("gpt-5.4-mini", "gpt-5.4-nano")),
    ("gemini-3.1-pro", 200_000, ("4.0", "18.0", "0.40", "0.0"), ()),
    ("gemini-2.5-pro", 200_000, ("2.5", "15.0", "0.25", "0.0"), ()),
    ("claude-sonnet-4", 200_000, ("6.0", "22.5", "0.60", "7.5"), ("claude-sonnet-4-5", "claude-sonnet-4-6")),
)

# Other names of priced models.
ALIASES = {
    "claude-4.5-sonnet-thinking": "claude-sonnet-4-5",
    "claude-4.5-opus-high-thinking": "claude-opus-4-5",
    "codex-auto-review": "gpt-5.3-codex",
}

# Placeholder model that is never billed.
SYNTHETIC = "<synthetic>"

# Families that must not inherit the price of their base model.
UNPRICED_FAMILIES = (
    "gpt-5.5-pro",
    "gpt-5.4-pro",
    "gpt-5.3-pro",
    "gpt-5.2-pro",
    "gpt-5.1-pro",
    "gpt-5-pro",
)

Prices = tuple[Decimal, Decimal, Decimal, Decimal]


def builtin_models() -> dict[str, Prices]:
    return {name: tuple(map(Decimal, prices)) for name, prices in MODEL_PRICES.items()}


def builtin_tiers() -> list[tuple[str, int, Prices, tuple[str, ...]]]:
    """Rows of (prefix, threshold, prices, excluded prefixes)."""
    return [(prefix, least, tuple(map(Decimal, prices)), skip) for prefix, least, prices, skip in LONG_CONTEXT]
