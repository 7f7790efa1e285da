"""Content and order pipelines: pages to index records, orders to daily revenue, events to features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowledger.functions.params import partition_key

UNTITLED = "Untitled"
DAY_SECONDS = 86_400


def page_title(body: Column) -> Column:
    """Text of the first title tag, or ``Untitled``."""
    found = F.trim(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(UNTITLED))


def page_entities(body: Column, base: Sequence[str], terms: Sequence[str]) -> Column:
    """The base entities, then every dictionary term the body contains, case-sensitive, in given order."""
    always = F.array(*[F.lit(b) for b in base]).cast("array<string>")
    known = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    return F.concat(always, F.filter(known, lambda term: F.contains(body, term)))


def page_links(url: Column, body: Column, extra: Sequence[str] = ()) -> Column:
    """The page's own URL, then its href values in order, then the given ones."""
    hrefs = F.regexp_extract_all(body, F.lit(r'(?i)href="([^"]*)"'), F.lit(1))
    return F.concat(F.array(url), hrefs, F.array(*[F.lit(e) for e in extra]).cast("array<string>"))


def index_records(pages: DataFrame, base: Sequence[str], terms: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Index entry of each page and how many records it stands for. One pass over each whole body."""
    body = F.col("body")
    parts = pages.select(
        "url",
        page_title(body).alias("title"),
        page_entities(body, base, terms).alias("entities"),
        page_links(F.col("url"), body, extra).alias("links"),
    )
    titled = F.when(F.col("title") != "", F.lit(1)).otherwise(F.lit(0))
    return parts.withColumn("records", (F.size("entities") + F.size("links") + titled).cast("long"))


def letter_counts(body: Column) -> tuple[Column, Column]:
    """ASCII vowels and consonants of the text outside tags."""
    text = F.lower(F.regexp_replace(body, "<[^>]*>", ""))
    vowels = F.regexp_count(text, F.lit("[aeiou]")).cast("long")
    consonants = F.regexp_count(text, F.lit("[b-df-hj-np-tv-z]")).cast("long")
    return vowels, consonants


def _usable(status: Sequence[str]) -> Column:
    return F.coalesce((F.col("o_totalprice") > 0) & F.col("o_orderstatus").isin(*status), F.lit(False))


def clean_orders(orders: DataFrame, status: Sequence[str] = ("F", "O")) -> tuple[DataFrame, DataFrame]:
    """Orders with a price and a known status, and the dropped rest."""
    return orders.filter(_usable(status)), orders.filter(~_usable(status))


def order_counts(orders: DataFrame, status: Sequence[str] = ("F", "O")) -> DataFrame:
    """Ingested, cleaned and dropped orders; the last two add up to the first."""
    return orders.agg(
        F.count(F.lit(1)).alias("records_ingested"),
        F.count_if(_usable(status)).alias("records_cleaned"),
        F.count_if(~_usable(status)).alias("dropped_records"),
    )


def daily_revenue(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("revenue")
    )


def import_customers(items: DataFrame, payload: Column) -> tuple[DataFrame, DataFrame]:
    """Imported customers with their external id and metadata, and items without a customer id."""
    parsed = items.withColumn("p", F.from_json(payload, "customer_id string, batch_id string"))
    key = partition_key(F.col("p.customer_id"))
    good = (
        parsed.filter(key.isNotNull())
        .withColumns(
            {
                "partition_key": key,
                "customer_id": F.col("p.customer_id"),
                "batch_id": F.coalesce("p.batch_id", F.lit("")),
                "external_id": F.concat(F.lit("crm:"), "p.customer_id"),
            }
        )
        .withColumn(
            "metadata",
            F.create_map(
                F.lit("batch_id"), F.col("batch_id"), F.lit("customer_id"), F.col("customer_id"),
                F.lit("external_id"), F.col("external_id"),
            ),
        )
        .drop("p")
    )
    bad = parsed.filter(key.isNull()).drop("p").withColumn("error", F.lit("customer_id is required"))
    return good, bad


def trailing_day_features(events: DataFrame) -> DataFrame:
    """Events and value of the same user in the 24 hours up to each event, in whole seconds.

    The sum is today's running total plus what yesterday had after the same second, so every window
    is a running total over one (user, day): linear in its rows, and a busy user is spread over as
    many tasks as there are days. Yesterday is asked by a probe row at the same second of the day.
    """
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    timed = events.select(
        "event_id",
        "user_id",
        F.floor(at / DAY_SECONDS).alias("day"),
        F.pmod(at, F.lit(DAY_SECONDS)).alias("second"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )
    keys = ["user_id", "day", "second"]
    seconds = timed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    none = F.lit(0).cast("long")
    probes = seconds.select("user_id", (F.col("day") - 1).alias("day"), "second", none.alias("n"), none.alias("cents"))
    whole = Window.partitionBy("user_id", "day")
    so_far = whole.orderBy("second").rangeBetween(Window.unboundedPreceding, 0)
    running = (
        seconds.withColumn("probe", F.lit(False))
        .unionByName(probes.withColumn("probe", F.lit(True)))
        .withColumns({f"{c}_so_far": F.sum(c).over(so_far) for c in ("n", "cents")})
        .withColumns({f"{c}_after": F.sum(c).over(whole) - F.col(f"{c}_so_far") for c in ("n", "cents")})
    )
    today = running.filter("not probe").select(*keys, "n_so_far", "cents_so_far")
    yesterday = running.filter("probe").select(
        "user_id", (F.col("day") + 1).alias("day"), "second", "n_after", "cents_after"
    )
    totals = today.join(yesterday, keys).select(
        *keys,
        (F.col("n_so_far") + F.col("n_after")).alias("events_24h"),
        (F.col("cents_so_far") + F.col("cents_after")).alias("cents_24h"),
    )
    return timed.join(totals, keys).select("event_id", "user_id", "events_24h", "cents_24h")
