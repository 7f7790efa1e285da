"""Dictionary terms in texts, by a hashed index of their first letters.

A text is cut once, by one regular expression, into the windows that start at each of its letters. Windows
whose first letters aren't those of any term are dropped at once, by a bit set of fixed size over the hashed
beginnings; the rest meet the terms by an equi-join on the beginning, and a term is there if the window starts with it. The cost of a
text doesn't grow with the number of terms, and the dictionary is a table of any size: nothing of it but the bit
set is sent to tasks as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a beginning; a shorter term is its own beginning.
BEGINNING = 6
#: 64-bit words of the bit set.
WORDS = 1 << 15


def _place(beginning: Column) -> Column:
    return F.pmod(F.xxhash64(beginning), F.lit(WORDS * 64))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def _bit_set(beginnings: DataFrame) -> Column:
    """All words of the bit set as one array."""
    set_ = beginnings.select(F.floor(_place(F.col("beginning")) / 64).alias("word"), _bit(_place(F.col("beginning"))).alias("bit"))
    words = set_.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = beginnings.sparkSession.range(WORDS).withColumnRenamed("id", "word").join(words, "word", "left")
    packed = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(F.transform(packed, lambda x: x["bits"]).alias("words")).scalar()


def terms_in(texts: DataFrame, terms: DataFrame, key: str, text: str = "body") -> DataFrame:
    """(key, term): every term of the stored table ``terms`` (term) that a text contains, case-sensitive, once per text.

    Null texts contain nothing; null and empty terms are none. ``key`` tells texts apart.
    """
    filled = terms.select("term").filter("term <> ''").distinct().withColumn("beginning", F.substring("term", 1, BEGINNING))
    bounds = filled.agg(F.max(F.length("term")).alias("most"), F.collect_set(F.length("beginning")).alias("lengths")).first()
    if bounds.most is None:
        return texts.select(key, F.lit("").alias("term")).limit(0)
    bits = _bit_set(filled.select("beginning").distinct())
    held = texts.select(key, text).withColumn("_bits", bits)

    def known(window: Column) -> Column:
        """Beginnings of the window that a term may have."""
        starts = F.array(*[F.substring(window, 1, n) for n in sorted(bounds.lengths)])
        return F.filter(starts, lambda b: F.get(F.col("_bits"), F.floor(_place(b) / 64).cast("int")).bitwiseAND(_bit(_place(b))) != 0)

    windows = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{bounds.most}}}))"), 1))
    some = held.select(key, F.explode(F.filter(F.transform(windows, lambda w: F.struct(w.alias("window"), known(w).alias("starts"))), lambda s: F.size(s["starts"]) > 0)).alias("s"))
    met = some.select(key, "s.window", F.explode("s.starts").alias("beginning")).join(filled, "beginning")
    return met.filter(F.startswith("window", "term")).select(key, "term").distinct()

