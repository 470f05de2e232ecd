"""Prompt text and model-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space in a prompt.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Prompts that open with these are client noise.
NOISE_OPENINGS = ("Caveat:", "login")
NOISE_LINES = ("Caveat:", "login", "init")

PROMPT_LENGTH = 80


def strip_space(text: Column) -> Column:
    """Strip white space of every kind, not only blanks, in linear time."""
    return F.btrim(text, F.lit(WHITESPACE))


def starts_with_any(text: Column, words: tuple[str, ...]) -> Column:
    matched = F.lit(False)
    for word in words:
        matched = matched | text.startswith(word)
    return matched


def strip_tags(text: Column) -> Column:
    """Drop ``<...>`` tags.

    Text behind the last ``>`` cannot hold a tag, so the pattern only sees the
    part before it: there every ``<`` finds its end and matching stays linear.
    """
    tail = F.substring_index(text, ">", -1)
    head = F.left(text, F.length(text) - F.length(tail))
    return F.concat(F.regexp_replace(head, "<[^>]+>", ""), tail)


def clean_prompt(content: Column) -> Column:
    """The human part of a prompt, cut to the stored length."""
    clean = strip_space(strip_tags(content))
    lines = F.transform(F.split(clean, "\n"), strip_space)
    useful = F.filter(
        lines, lambda line: (F.length(line) > 2) & ~starts_with_any(line, NOISE_LINES)
    )
    first_useful = F.coalesce(F.try_element_at(useful, F.lit(1)), F.lit(""))
    noisy = starts_with_any(clean, NOISE_OPENINGS)
    return F.left(F.when(noisy, first_useful).otherwise(clean), F.lit(PROMPT_LENGTH))


def clean_message(message: Column) -> Column:
    """Stripped and cut, no tag handling."""
    return F.left(strip_space(message), F.lit(PROMPT_LENGTH))


def dash_prefixes(name: Column) -> Column:
    """Every prefix of ``name`` that ends at a ``-`` boundary, and the name itself."""
    parts = F.split(name, "-")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "-"),
    )


def nonempty(text: Column) -> Column:
    """``NULL`` for the empty string, so that aggregates and coalesce skip it."""
    return F.when(text != "", text)
