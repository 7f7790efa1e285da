"""Schedule keys in declaration order, given out by joins and running counts; no task sees a whole job.

An inferred key takes the first free one of base, base_2, base_3 at its place in the order. What can stand in
its way are *claims*: names of that form that an explicit key takes, or another base that happens to
look like one. The nth row of a base would get the number n; a claim that was made before the row came that
would take its number is skipped, and all later rows move up by one.

Which claims are skipped depends on those before them, so it is found in rounds: assume an answer, see which
row would arrive at each claim, judge again, until nothing changes. Each round settles at least the first
claim that was still wrong, and usually nearly all. Where bases claim names of one another, keys and claims
are worked out in turn in the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowledger.functions.cron import schedule_key
from flowledger.functions.text import clean
from flowledger.operators.ranking import rank_within, total_before
from flowledger.session import discard, materialize

BASE = ["job_key", "base"]
NUMBERED = r"^(.*)_([1-9][0-9]{0,17})$"


def _slots(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(job_key, name, ...) read as first key of a base, and as a later one: base, n."""
    first = names.withColumns({"base": F.col("name"), "n": F.lit(1).cast("long")})
    later = names.withColumns({"base": F.regexp_extract("name", NUMBERED, 1), "n": F.regexp_extract("name", NUMBERED, 2).try_cast("long")})
    return first, later.filter("n >= 2")


def _skipped(claims: DataFrame, inferred: DataFrame) -> DataFrame:
    """job_key, base, n, arrives of the skipped claims (job_key, base, n, taken); ``arrives`` is the place of the first row that skips it."""
    state = materialize(claims.withColumn("skipped", F.lit(True)), "key-claims")
    places = inferred.select(*BASE, F.col("place").alias("arrives"), "sort_index")
    while True:
        before = total_before(state.withColumn("one", F.col("skipped").cast("long")), BASE, [F.col("n").asc()], "one", "before")
        judged = before.withColumn("arrives", F.col("n") - F.col("before")).join(places, [*BASE, "arrives"], "left")
        skipped = F.coalesce(F.col("sort_index") > F.col("taken"), F.lit(False))
        then = materialize(judged.select(*BASE, "n", "taken", "arrives", F.col("skipped").alias("was"), skipped.alias("skipped")), "key-claims")
        discard(state)
        if then.filter("was <> skipped").isEmpty():
            return then.filter("skipped").select(*BASE, "n", "arrives")
        state = then.drop("was", "arrives")


def _numbered(inferred: DataFrame, skipped: DataFrame) -> DataFrame:
    """``inferred`` with ``number``: the place among the rows of its base and the claims they skipped."""
    bases = skipped.select(*BASE).distinct()
    plain = inferred.join(bases, BASE, "left_anti").withColumn("number", F.col("place"))
    rows = inferred.join(bases, BASE, "left_semi").withColumns({"arrives": F.col("place"), "n": F.lit(0).cast("long"), "row": F.lit(True)})
    steps = rows.unionByName(skipped.withColumn("row", F.lit(False)), allowMissingColumns=True)
    ranked = rank_within(steps, BASE, [F.col("arrives").asc(), F.col("row").asc(), F.col("n").asc()], "number")
    return plain.unionByName(ranked.filter("row").drop("arrives", "n", "row"))


def _given(numbered: DataFrame) -> DataFrame:
    return numbered.withColumn("given", F.when(F.col("number") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("number"))))


def resolved_keys(declared: DataFrame) -> DataFrame:
    """``declared`` (job_key, schedule_key, cron_expr, sort_index, ...) with each schedule's key: the explicit one, or the inferred one made unique.

    ``sort_index`` is the order of declaration, unique within a job. Explicit keys stay as they are, repeated or not.
    """
    columns = declared.columns
    rows = declared.withColumns({"explicit": clean(F.coalesce("schedule_key", F.lit(""))), "base": schedule_key(F.col("cron_expr"))})
    explicit = rows.filter("explicit <> ''")
    inferred = materialize(rank_within(rows.filter("explicit = ''"), BASE, [F.col("sort_index").asc()], "place"), "inferred-keys")
    bases = materialize(inferred.select(*BASE).distinct(), "key-bases")

    named = explicit.groupBy("job_key", F.col("explicit").alias("name")).agg(F.min("sort_index").alias("taken"))
    fixed = reduce(DataFrame.unionByName, _slots(named)).join(bases, BASE, "left_semi").select(*BASE, "n", "taken")
    fixed = materialize(fixed, "explicit-claims")
    looks = _slots(bases.select("job_key", F.col("base").alias("name")))[1]
    contested = materialize(looks.join(bases, BASE, "left_semi").select(*BASE, "n", "name"), "contested-keys")

    def given(claims: DataFrame) -> DataFrame:
        return materialize(_given(_numbered(inferred, _skipped(claims, inferred))), "given-keys")

    crossing = not contested.isEmpty()
    now = _given(inferred.withColumn("number", F.col("place"))) if fixed.isEmpty() else given(fixed)
    while crossing:
        takes = now.select("job_key", "base", F.col("number").alias("n"), F.col("sort_index").alias("taken"))
        firsts = takes.filter("n = 1").select("job_key", F.col("base").alias("name"), "taken")
        by_first = contested.join(firsts, ["job_key", "name"]).select(*BASE, "n", "taken")
        by_later = contested.join(takes, [*BASE, "n"]).select("job_key", F.col("name").alias("base"), F.lit(1).cast("long").alias("n"), "taken")
        claims = fixed.union(by_first).union(by_later).groupBy(*BASE, "n").agg(F.min("taken").alias("taken"))
        then = given(claims)
        place = ["job_key", "base", "place"]
        crossing = not then.join(now.select(*place, F.col("given").alias("was")), place).filter("given <> was").isEmpty()
        now = then
    keyed = now.withColumn("schedule_key", F.col("given")).select(*columns)
    return keyed.unionByName(explicit.withColumn("schedule_key", F.col("explicit")).select(*columns))
