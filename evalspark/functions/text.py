"""Column expressions for the spelling rules that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The characters with Unicode's property White_Space.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(column: Column) -> Column:
    """Without surrounding white space of any Unicode kind (Spark's trim alone knows only the blank)."""
    return F.btrim(column, F.lit(WHITE_SPACE))


def folded(column: Column) -> Column:
    return F.lower(strip(column))


def number_text(column: Column) -> Column:
    """A number stored as text: stripped, without leading zeros; blank becomes null."""
    text = folded(column)
    bare = F.ltrim(text, F.lit("0"))
    return F.when(bare != "", bare).when(text != "", F.lit("0"))


def whole_number(column: Column) -> Column:
    """The bigint such a text holds, else null."""
    return F.when(strip(column).rlike(r"^[0-9]{1,18}$"), strip(column).cast("bigint"))


def label(column: Column) -> Column:
    """A name that is spelled in several ways: lower case, runs of blanks and hyphens as one underscore."""
    text = F.regexp_replace(folded(column), r"(?U)[\s\-]+", "_")
    return F.when(text != "", text)
