"""Cron expressions as Columns: parsing, matching, local time and inferred schedule keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowledger.functions.text import all_of, clean, slug

# Descriptor names and the five fields they stand for.
DESCRIPTORS = {
    "@yearly": "0 0 1 1 *",
    "@annually": "0 0 1 1 *",
    "@monthly": "0 0 1 * *",
    "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *",
    "@midnight": "0 0 * * *",
    "@hourly": "0 * * * *",
}
# Schedule keys of the descriptors.
DESCRIPTOR_KEYS = {
    "@yearly": "yearly",
    "@annually": "yearly",
    "@monthly": "monthly",
    "@weekly": "weekly",
    "@daily": "daily",
    "@midnight": "daily",
    "@hourly": "hourly",
}
WEEKDAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# Lowest and highest value of each field, and the names it accepts.
FIELDS = {
    "minute": (0, 59, {}),
    "hour": (0, 23, {}),
    "dom": (1, 31, {}),
    "month": (1, 12, {name: i + 1 for i, name in enumerate(MONTHS)}),
    "dow": (0, 6, {name: i for i, name in enumerate(WEEKDAYS)}),
}


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def _number(word: Column) -> Column:
    text = F.trim(word)
    return F.when(text.rlike(r"^\+?[0-9]{1,9}(\.0*)?$"), text.cast("double").cast("int"))


def _value(word: Column, kind: str) -> Column:
    """One field value: a number or a name. Sunday may be written 7."""
    number = _number(word)
    if kind == "dow":
        number = F.when(number == 7, F.lit(0)).otherwise(number)
    names = FIELDS[kind][2]
    return F.coalesce(_lookup(names, F.lower(F.trim(word))), number) if names else number


def _bind(value: Column, body) -> Column:
    """``body`` of a value computed once, so nested parsing does not repeat its inputs."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _ends(base: Column, kind: str) -> Column:
    """First and last value of ``*``, ``a`` or ``a-b``."""
    low, high, _ = FIELDS[kind]

    def of(values: Column) -> Column:
        return F.when(F.size(values) == 1, F.array(F.get(values, F.lit(0)), F.get(values, F.lit(0)))).when(
            F.size(values) == 2, values
        )

    return F.when(base == "*", F.array(F.lit(low), F.lit(high))).otherwise(
        _bind(F.transform(F.split(base, "-"), lambda word: _value(word, kind)), of)
    )


def _token(token: Column, kind: str) -> Column:
    """Values of one comma-separated part (``*``, ``a``, ``a-b``, each with ``/step``); NULL if malformed."""
    low, high, _ = FIELDS[kind]

    def expand(parts: Column) -> Column:
        step = F.when(F.size(parts) == 1, F.lit(1)).when(F.size(parts) == 2, _number(F.get(parts, F.lit(1))))
        span = F.struct(_ends(F.trim(F.get(parts, F.lit(0))), kind).alias("ends"), step.alias("step"))

        def sequence(s: Column) -> Column:
            first, last = F.get(s["ends"], F.lit(0)), F.get(s["ends"], F.lit(1))
            fits = (first >= low) & (last <= high) & (first <= last) & (s["step"] > 0)
            return F.when(fits, F.sequence(first, last, s["step"]))

        return _bind(span, sequence)

    return _bind(F.split(token, "/"), expand)


def _field(field: Column, kind: str) -> Column:
    """Allowed values of one field in order; NULL if any part is malformed."""
    tokens = F.filter(F.transform(F.split(field, ","), lambda t: F.trim(t)), lambda t: t != "")

    def merged(values: Column) -> Column:
        whole = (F.size(values) > 0) & F.forall(values, lambda v: v.isNotNull())
        return F.when(whole, F.array_sort(F.array_distinct(F.flatten(values))))

    return _bind(F.transform(tokens, lambda t: _token(t, kind)), merged)


def cron_spec(expr: Column) -> Column:
    """Allowed values per field, and whether day-of-month and weekday are unrestricted.

    ``valid`` is false for a wrong number of fields or any value out of range.
    """

    def of_fields(fields: Column) -> Column:
        parsed = F.struct(*[_field(F.get(fields, F.lit(i)), kind).alias(kind) for i, kind in enumerate(FIELDS)])
        return _bind(
            parsed,
            lambda p: F.struct(
                ((F.size(fields) == 5) & all_of(*[p[kind].isNotNull() for kind in FIELDS])).alias("valid"),
                *[p[kind].alias(kind) for kind in FIELDS],
                _unrestricted(F.get(fields, F.lit(2))).alias("dom_any"),
                _unrestricted(F.get(fields, F.lit(4))).alias("dow_any"),
            ),
        )

    text = F.lower(clean(F.coalesce(expr, F.lit(""))))
    return _bind(_bind(text, lambda t: F.split(F.coalesce(_lookup(DESCRIPTORS, t), t), r"\s+")), of_fields)


def _unrestricted(field: Column) -> Column:
    return F.coalesce(F.regexp_replace(field, ",", "") == "*", F.lit(False))


def day_matches(spec: Column, local: Column) -> Column:
    """Month matches, and so does the day: day-of-month or weekday where both are restricted."""
    by_date = F.array_contains(spec["dom"], F.dayofmonth(local))
    by_weekday = F.array_contains(spec["dow"], F.dayofweek(local) - 1)
    day = (
        F.when(spec["dom_any"] & spec["dow_any"], F.lit(True))
        .when(spec["dom_any"], by_weekday)
        .when(spec["dow_any"], by_date)
        .otherwise(by_date | by_weekday)
    )
    return F.array_contains(spec["month"], F.month(local)) & day


def cron_matches(spec: Column, local: Column) -> Column:
    return (
        F.array_contains(spec["minute"], F.minute(local))
        & F.array_contains(spec["hour"], F.hour(local))
        & day_matches(spec, local)
    )


# Names of the time zone database without an area.
PLAIN_ZONES = (
    "CET CST6CDT Cuba EET EST EST5EDT Egypt Eire GB GB-Eire GMT GMT+0 GMT-0 GMT0 Greenwich HST Hongkong Iceland Iran Israel "
    "Jamaica Japan Kwajalein Libya MET MST MST7MDT NZ NZ-CHAT Navajo PRC PST8PDT Poland Portugal ROC ROK Singapore Turkey UCT "
    "UTC Universal W-SU WET Zulu"
).split()


def zone_known(timezone: Column) -> Column:
    """Whether the zone name can be used; a blank one means UTC."""
    return zone_text(timezone).isNotNull()


def zone_text(timezone: Column) -> Column:
    """The name of a zone of the time zone database, UTC for a blank one, else null.

    Such a name has an area before a slash or is one of the few without. Offsets and abbreviations are none.
    """
    name = clean(F.coalesce(timezone, F.lit("")))
    probe = F.concat(F.lit("2020-01-01 00:00:00 "), name).try_cast("timestamp")
    named = name.rlike(r"^[A-Z][A-Za-z]+/[A-Z]") | name.isin(*PLAIN_ZONES)
    return F.when(name == "", F.lit("UTC")).when(named & probe.isNotNull(), name)


def zone_or_utc(timezone: Column) -> Column:
    return F.coalesce(zone_text(timezone), F.lit("UTC"))


def local_time(tick: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(tick, zone)


def _digits(word: Column) -> Column:
    return word.rlike("^[0-9]+$")


def _two(word: Column) -> Column:
    return F.when(F.length(word) >= 2, word).otherwise(F.concat(F.lit("0"), word))


def schedule_key(expr: Column) -> Column:
    """Readable key of a cron expression: ``every_5_minutes``, ``daily_at_06_30``, else ``cron_...``."""
    text = F.lower(clean(F.coalesce(expr, F.lit(""))))

    def named(word: Column) -> Column:
        fixed = F.when(word == "", F.lit("schedule")).otherwise(_lookup(DESCRIPTOR_KEYS, word))
        return F.coalesce(fixed, _bind(F.split(word, r"\s+"), lambda fields: _key_of_fields(word, fields)))

    return _bind(text, named)


def _key_of_fields(text: Column, fields: Column) -> Column:
    minute, hour, dom, month, dow = (F.get(fields, F.lit(i)) for i in range(5))
    weekday_names = {str(i): name for i, name in enumerate(WEEKDAYS)} | {"7": "sun"} | {w: w for w in WEEKDAYS}
    weekday = _lookup(weekday_names, dow)
    minute_step = F.regexp_extract(minute, r"^\*/([0-9]+)$", 1)
    hour_step = F.regexp_extract(hour, r"^\*/([0-9]+)$", 1)
    any_day = (dom == "*") & (month == "*") & (dow == "*")
    at_hour = F.concat(_two(hour), F.lit("_"), _two(minute))
    midnight = (minute == "0") & (hour == "0")
    other = F.concat(F.lit("cron_"), slug(text))
    return (
        F.when(F.size(fields) != 5, other)
        .when(any_day & (minute == "*") & (hour == "*"), F.lit("every_minute"))
        .when(any_day & (minute_step != "") & (hour == "*"), F.concat(F.lit("every_"), minute_step, F.lit("_minutes")))
        .when(any_day & (minute == "0") & (hour == "*"), F.lit("hourly"))
        .when(any_day & _digits(minute) & (hour == "*"), F.concat(F.lit("hourly_at_"), _two(minute)))
        .when(
            any_day & _digits(minute) & (hour_step != ""),
            F.concat(F.lit("every_"), hour_step, F.lit("_hours_at_"), _two(minute)),
        )
        .when(any_day & midnight, F.lit("daily"))
        .when(any_day & _digits(minute) & _digits(hour), F.concat(F.lit("daily_at_"), at_hour))
        .when(
            _digits(minute) & _digits(hour) & (dom == "*") & (month == "*") & weekday.isNotNull(),
            F.concat(F.lit("weekly_on_"), weekday, F.lit("_at_"), at_hour),
        )
        .when(midnight & (dom == "1") & (month == "*") & (dow == "*"), F.lit("monthly"))
        .when(
            _digits(minute) & _digits(hour) & _digits(dom) & (month == "*") & (dow == "*"),
            F.concat(F.lit("monthly_on_"), dom, F.lit("_at_"), at_hour),
        )
        .otherwise(other)
    )
