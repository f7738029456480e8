"""Text helpers with the same meaning in Spark and in SQL engines without Unicode word classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's float() takes, in ASCII digits.
FLOAT = r"^[+-]?(inf|infinity|nan|(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?)$"


def is_float(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike(FLOAT)


def whole_number(text: Column) -> Column:
    """The number that a text of digits alone says, else null."""
    return F.when(F.trim(text).rlike(r"^\p{Nd}+$"), F.trim(text).try_cast("long"))


def last_word(text: Column) -> Column:
    """The last white-space-delimited word without other than word characters, in lower case."""
    word = F.element_at(F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+"), -1)
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}_]", ""))


def natural_order(text: Column) -> list[Column]:
    """Sort keys: numbers by value first, then other texts."""
    number = whole_number(text)
    return [number.isNull().cast("int"), F.coalesce(number, F.lit(0)), F.when(number.isNull(), text).otherwise(F.lit(""))]


def derived_id(*parts: Column) -> Column:
    """An id that a repeated task makes again: the hash of what names the row."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
