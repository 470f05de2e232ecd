"""JSON lines, strictly: a line is one object and nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_object(lines: DataFrame, schema: str, to: str) -> DataFrame:
    """Add ``to``: the object that ``value`` holds, NULL where it holds anything else.

    A parser stops behind the first value and would not see what follows it. As the
    only element of an array, a line followed by more does not parse, or gives two
    elements. A line that closes that array itself is caught as a member of an
    object; only lines with ``}]`` in them can be such, and are read twice. Most have
    no ``]`` at all, which is cheaper to see than the pattern.
    """
    wrapped = F.concat(F.lit("["), F.col("value"), F.lit("]"))
    member = F.concat(F.lit('{"x":'), F.col("value"), F.lit("}"))
    whole = F.from_json(member, "struct<x:struct<type:string>>")["x"].isNotNull()
    items, value = f"{to}_items", F.col("value")
    return (
        lines.withColumn(items, F.from_json(wrapped, f"array<{schema}>"))
        .withColumn(to, F.when(F.size(items) == 1, F.col(items)[0]))
        .withColumn(to, F.when(~(value.contains("]") & value.rlike(r"\}\s*\]")) | whole, F.col(to)))
        .drop(items)
    )


def is_number_or_flag(value: Column, path: str, text: Column) -> Column:
    """Whether the member at the dotted ``path`` is a bare number, true or false.

    Only ``text``, its value as text, that looks like one is read again.
    """

    def as_type(kind: str) -> Column:
        for name in reversed(path.split(".")):
            kind = f"struct<{name}:{kind}>"
        found = F.from_json(value, kind)
        for name in path.split("."):
            found = found[name]
        return found.isNotNull()

    bare = text.rlike(r"^(?:-?[0-9][0-9.eE+-]*|true|false)$")
    return bare & (as_type("double") | as_type("boolean"))


def whole_number(text: Column) -> Column:
    """A count as it may be written: ``12``, ``12.0``, ``"12"``; NULL for anything else.

    Without a point it is read at once, which is the same number in less time. (Only whole
    numbers may have a DEL around them.)
    """
    plain = F.when(~(text.contains(".") | text.contains("\x7f")), text.try_cast("bigint"))
    return F.coalesce(plain, text.try_cast("decimal(38,6)").try_cast("bigint"))
