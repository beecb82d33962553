"""Numbers and money out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotbook.functions.text import col, strip

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(c: Column | str) -> Column:
    """Text to double: blanks and commas dropped; empty or malformed text is null.

    The pattern guards the cast because Spark alone would also accept forms such
    as a trailing type letter.
    """
    cleaned = F.replace(strip(c), F.lit(","), F.lit(""))
    return F.when(cleaned.rlike(_NUMBER), cleaned.try_cast("double"))


def parse_integer(c: Column | str) -> Column:
    return parse_number(c).try_cast("int")


def money_total(c: Column | str) -> Column:
    """First dollar amount as ``$1,234``; empty when there is none."""
    return _dollars(F.regexp_extract(col(c), r"\$\s*([0-9,]+)", 1))


def money_before(c: Column | str, word: str) -> Column:
    """Dollar amount directly before ``word``; empty when there is none."""
    return _dollars(F.regexp_extract(col(c), rf"\$\s*([0-9,]+)\s+{word}", 1))


def _dollars(digits: Column) -> Column:
    return F.when(digits != "", F.concat(F.lit("$"), digits)).otherwise(F.lit(""))


def money_value(c: Column | str) -> Column:
    """``$1,234.00`` as a double."""
    return parse_number(F.replace(strip(c), F.lit("$"), F.lit("")))


def numeric_or_text(c: Column | str) -> Column:
    """A number where the text is only digits and points, else null.

    Pair it with the text itself: a document keeps whichever is not null.
    """
    c = col(c)
    return F.when(c.rlike(r"^[0-9.]*[0-9][0-9.]*$"), c.try_cast("double"))


def number_text(c: Column | str) -> Column:
    """A double as plain decimal text, ``250000.0`` rather than ``2.5E5``; null is empty."""
    c = col(c)
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    digits = F.rtrim(c.cast("string").cast("decimal(38,12)").cast("string"), F.lit("0"))
    return F.when(c.isNull(), F.lit("")).when(
        whole, F.concat(c.cast("bigint").cast("string"), F.lit(".0"))
    ).otherwise(digits)
