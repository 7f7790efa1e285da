"""Benchmark decontamination by templates, in DataFrame functions only.

A text becomes a template: numbers, names (capitalised words, not in capitals throughout, inside a sentence) and units after numbers turn
into typed placeholders, other words are lower-cased and signs dropped. Windows of five template words are
hashed and joined to the windows of the benchmark. A document leaks an item when it holds at least 0.8 of the
item's windows whose slots are consistent: within one alignment each value of the item stands for one value in
the document, else the windows that cover it don't count, but for those with the item's own values. So a question
with other numbers or names is caught and a text that merely has slots at the same places, filled at odds, is not.

Defined results: null texts and items hold no windows; an item with fewer than five words, or without a
window of at least two plain words, can't be told from chance and matches nothing; a window that an item holds
several times counts at each place; rows that share an id are one document, and rows without id can't be reported;
repeated rows change nothing; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowledger.llm.id_filter import listed, maybe_listed, unlisted
from flowledger.session import materialize

WINDOW = 5
COVERAGE = 0.8
LEAST_PLAIN = 2
NAME, NUMBER, UNIT = "", "", ""

# Common units, longest first where one begins another.
UNITS = (
    "kilometers kilometres kilometer kilometre centimeters centimetres meters metres meter metre miles mile inches inch feet foot yards yard "
    "kilograms kilogram grams gram tonnes tons ton pounds pound ounces ounce liters litres liter litre gallons gallon "
    "seconds second minutes minute hours hour days day weeks week months month years year "
    "dollars dollar euros euro cents cent percent degrees degree km cm mm kg mg lb oz ml mph kmh hz mhz ghz kb mb gb tb usd eur"
).split()
_NUMBER = r"\p{N}+(?:[.,:/]\p{N}+)*"
_WORD = r"[\p{L}\p{M}]+"


def _spaced(text: Column) -> Column:
    """A unit that is written onto its number becomes a word of its own; signs of the text that equal a placeholder part words as any sign does."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), rf"(\p{{N}})(?=\p{{L}})|[{NAME}-{UNIT}]", "$1 ")


def template(text: Column) -> Column:
    """The words of the template."""
    named = F.regexp_replace(_spaced(text), r"(?<=[\p{L}\p{N},;:]\s)\p{Lu}\p{M}*\p{Ll}[\p{L}\p{M}]*", NAME)
    numbered = F.lower(F.regexp_replace(named, _NUMBER, NUMBER))
    units = F.regexp_replace(numbered, rf"(?<={NUMBER}\s)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{M}}])", UNIT)
    return F.regexp_extract_all(units, F.lit(rf"[{NAME}-{UNIT}]|{_WORD}"), F.lit(0))


def values(text: Column) -> Column:
    """The words themselves, one for each of the template's."""
    return F.regexp_extract_all(F.lower(_spaced(text)), F.lit(rf"{_NUMBER}|{_WORD}"), F.lit(0))


def windows(rows: DataFrame, key: str) -> DataFrame:
    """key, place, window: the hashes of the windows with enough plain words."""
    cut = rows.select(key, template(F.col("text")).alias("t")).filter(F.size("t") >= WINDOW)
    shifted = [F.slice("t", i + 1, F.size("t")).alias(f"w{i}") for i in range(WINDOW)]
    each = cut.select(key, F.posexplode(F.arrays_zip(*shifted)).alias("place", "w"))
    plain = sum(F.when(F.col(f"w.w{i}") < NAME, 1).otherwise(F.when(F.col(f"w.w{i}") > UNIT, 1).otherwise(0)) for i in range(WINDOW))
    return each.filter(F.col(f"w.w{WINDOW - 1}").isNotNull() & (plain >= LEAST_PLAIN)).select(
        key, "place", F.xxhash64(*[f"w.w{i}" for i in range(WINDOW)]).alias("window")
    )


def slots(rows: DataFrame, key: str) -> DataFrame:
    """key, place, kind, value of every placeholder."""
    both = rows.select(key, F.posexplode(F.arrays_zip(template(F.col("text")).alias("kind"), values(F.col("text")).alias("value"))).alias("place", "s"))
    return both.filter(F.col("s.kind").between(NAME, UNIT)).select(key, "place", "s.kind", "s.value")


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, kind ("exact" or "template") of every leak."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull())
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter(F.col("item_id").isNotNull())
    wanted = materialize(windows(items, "item_id").distinct(), "benchmark-windows")
    sizes = wanted.groupBy("item_id").agg(F.countDistinct("place").alias("of"))
    enough = F.col("n") >= F.ceil(F.lit(coverage) * F.col("of"))

    likely = windows(rows, "doc_id").filter(maybe_listed(wanted, "window"))
    met = likely.join(wanted.withColumnRenamed("place", "item_place"), "window").select("doc_id", "item_id", "item_place", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    met = materialize(met, "benchmark-hits")

    def covered(hits: DataFrame) -> DataFrame:
        distinct = hits.select("doc_id", "item_id", "item_place").distinct()
        return distinct.groupBy("doc_id", "item_id").agg(F.count("*").alias("n")).join(sizes, "item_id").filter(enough)

    candidates = materialize(covered(met).select("doc_id", "item_id"), "leak-candidates")
    aligned = met.join(candidates, ["doc_id", "item_id"], "left_semi")
    # the slots of both sides, place by place of each alignment
    item_slots = slots(items.join(candidates.select("item_id").distinct(), "item_id", "left_semi"), "item_id").distinct()
    doc_slots = slots(listed(rows, candidates, "doc_id"), "doc_id").distinct()
    places = aligned.select("doc_id", "item_id", "shift", F.explode(F.sequence("item_place", F.col("item_place") + (WINDOW - 1))).alias("place")).distinct()
    filled = places.join(item_slots.withColumnRenamed("value", "asked"), ["item_id", "place"]).withColumn("at", F.col("place") + F.col("shift"))
    filled = filled.join(doc_slots.select("doc_id", F.col("place").alias("at"), "kind", "value"), ["doc_id", "at", "kind"])
    alignment = ["doc_id", "item_id", "shift"]
    at_odds = filled.groupBy(*alignment, "asked").agg((F.min("value") != F.max("value")).alias("odd"))
    # rows that share an id may fill one place several times; one of them with the item's own value is enough
    per_place = filled.groupBy(*alignment, "place", "asked").agg((~F.bool_or(F.col("value") == F.col("asked"))).alias("changed"))
    per_place = per_place.join(at_odds, [*alignment, "asked"]).select(*alignment, "place", "odd", "changed")
    covers = aligned.withColumn("place", F.explode(F.sequence("item_place", F.col("item_place") + (WINDOW - 1))))
    judged = covers.join(per_place, [*alignment, "place"]).groupBy(*alignment, "item_place").agg(F.bool_or("odd").alias("odd"), F.bool_or("changed").alias("changed"))
    judged = materialize(judged, "leak-slots")
    consistent = aligned.join(judged.filter("odd and changed"), [*alignment, "item_place"], "left_anti")
    changed = judged.filter("changed and not odd").select("doc_id", "item_id").distinct().withColumn("changed", F.lit(True))
    return covered(consistent).join(changed, ["doc_id", "item_id"], "left").select(
        "doc_id", "item_id", (F.col("n") / F.col("of")).alias("coverage"), F.when(F.col("changed"), "template").otherwise("exact").alias("kind")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that leak an item."""
    gone = materialize(leaks(docs, benchmark, doc_id, text).select(F.col("doc_id").alias(doc_id)).distinct(), "leaking")
    return unlisted(docs, gone, doc_id)
