"""Text helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every Unicode white space character.
WHITE_SPACE = (
    " \t\n\v\f\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def clean(value: Column) -> Column:
    """Trim every kind of white space on both ends."""
    return F.trim(value, F.lit(WHITE_SPACE))


def non_empty(value: Column, fallback: Column) -> Column:
    """Trimmed value, or ``fallback`` where nothing is left."""
    return F.coalesce(F.nullif(clean(value), F.lit("")), fallback)


def slug(value: Column) -> Column:
    """Runs of anything but a-z and 0-9 become one underscore; never empty."""
    word = F.regexp_replace(F.regexp_replace(value, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(word == "", F.lit("schedule")).otherwise(word)


def truncate_note(value: Column, limit: int) -> Column:
    """Cut long text to ``limit`` characters and say how much was cut."""
    length = F.char_length(value)
    cut = F.concat(
        F.substring(value, 1, limit), F.lit("… ("), (length - limit).cast("string"), F.lit(" chars truncated)")
    )
    return F.when(length <= limit, value).otherwise(cut)


def label(display_name: Column, key: Column) -> Column:
    return F.coalesce(F.nullif(display_name, F.lit("")), key)


def same_words(left: Column, right: Column) -> Column:
    """Equal after lower-casing and folding everything but letters and digits to single blanks."""

    def words(value: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))

    return words(left) == words(right)


def contains_any_case(needle: str, *haystack: Column) -> Column:
    """Case-blind substring search over the columns joined by blanks; a blank needle matches all."""
    wanted = needle.strip().lower()
    if not wanted:
        return F.lit(True)
    joined = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in haystack])
    return F.contains(F.lower(joined), F.lit(wanted))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
