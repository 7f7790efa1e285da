"""Secret scan with a trigram inverted index, in DataFrame functions only.

Each rule is a regex. From its mandatory literals follow Boolean trigram queries, an OR of ANDs. The
index holds (trigram, document) postings for the trigrams that occur in those queries. A document is
a candidate of a rule when, for one AND, postings of all its trigrams name it; only candidates are
matched against the regex. A rule without mandatory trigrams is matched against every text.

Defined results: a null text is empty; candidates are joined back by id, so rows that
share an id (or have none) are matched against the rules of all of them, each over its own text, and
that changes no result; repeated rows give a row each; further columns are ignored; an empty table gives an empty result. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowledger.llm.id_filter import maybe_listed
from flowledger.session import materialize


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Each inner tuple lists literals that a match holds together; a match satisfies one of them. Empty: scan all.
    literals: tuple[tuple[str, ...], ...] = ()
    #: Of the group to be measured, and its least length.
    group: int = 0
    least: int = 1


# The three base kinds in their order, then kinds with published formats.
RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        (("password",), ("passwd",), ("secret",), ("token",), ("api", "key")),
        group=2,
        least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}", (("AKIA",),)),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", (("-----BEGIN ", "PRIVATE KEY-----"),)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", (("ghp_",), ("gho_",), ("ghu_",), ("ghs_",), ("ghr_",))),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", (("xoxa-",), ("xoxb-",), ("xoxp-",), ("xoxr-",), ("xoxs-",))),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", (("AIza",),)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", (("eyJ", ".eyJ"),)),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<start:long,rank:int,kind:string,end:long>>"


def trigrams(literal: str) -> list[str]:
    folded = literal.lower()
    return sorted({folded[i : i + 3] for i in range(len(folded) - 2)})


def queries(rule: Rule) -> list[list[str]]:
    """The rule's trigram query as an OR of ANDs; empty if some alternative has no trigram."""
    ands = [sorted({t for literal in together for t in trigrams(literal)}) for together in rule.literals]
    return ands if all(ands) else []


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """The index: one row (trigram, doc_id) for each of ``terms`` that the folded text holds."""
    held = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.col("folded"), t))
    return docs.select("doc_id", F.lower("text").alias("folded")).select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Distinct (doc_id, kind) whose postings satisfy the rule's query."""
    spark = docs.sparkSession
    wanted = [(t, r.kind, i, len(q)) for r in rules for i, q in enumerate(queries(r)) for t in q]
    terms = spark.createDataFrame(wanted, "trigram string, kind string, query int, size int")
    index = postings(docs, sorted({w[0] for w in wanted})).distinct()
    hits = index.join(terms, "trigram").groupBy("doc_id", "kind", "query").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return hits.filter("n = size").select("doc_id", "kind").distinct()


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, rank, kind, end) of the leftmost non-overlapping matches that are long enough.

    The texts between matches and the matches themselves alternate, so their lengths add up to positions.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    rank = [r.kind for r in RULES].index(rule.kind) if rule in RULES else len(RULES)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["between"])
        end = start + F.length(x["whole"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    zipped = F.arrays_zip(whole.alias("whole"), part.alias("part"), F.slice(between, F.lit(1), F.size(whole)).alias("between"))
    found = F.aggregate(zipped, zero, step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, pattern), found).otherwise(zero["out"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text, ``row`` (all columns) and ``found``: all spans (start, rank, kind, end), by start and then kind as listed."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    indexed = tuple(r for r in rules if queries(r))
    free = [r for r in rules if not queries(r)]
    found = materialize(candidates(rows, indexed).groupBy("doc_id").agg(F.collect_set("kind").alias("kinds")), "secret-candidates")
    none = F.array().cast(SPANS)
    always = F.concat(none, *[spans(F.col("text"), r) for r in free])
    likely = maybe_listed(found, "doc_id")
    by_kind = [F.when(F.array_contains("kinds", r.kind), spans(F.col("text"), r)).otherwise(none) for r in indexed]
    matched = F.col("doc_id").eqNullSafe(F.col("for_id"))
    hits = rows.filter(likely).join(found.withColumnRenamed("doc_id", "for_id"), matched, "left").select("doc_id", "text", "row", F.concat(always, *by_kind).alias("found"))
    rest = rows.filter(~likely).select("doc_id", "text", "row", always.alias("found"))
    return hits.unionByName(rest).select("doc_id", "text", "row", F.array_sort("found").alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base_sha256 and the spans as text."""
    found = scan(docs, doc_id, text)
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with ``mark`` in place of every run of overlapping spans, and ``n_chars`` (if there) counted anew where that is so."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        apart = (s["start"] >= acc["at"]) & ((s["start"] > acc["at"]) | (acc["at"] == 0))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    hit = F.size("found") > 0
    rows = scan(docs, doc_id, text).select("row", "text", hit.alias("hit"), F.when(hit, F.aggregate("found", zero, step, rest)).alias("clean"))
    kinds = {f.name: f.dataType for f in docs.schema}
    own = lambda c: F.col("row")[c]
    out = {c: own(c) for c in docs.columns}
    out[text] = F.when(F.col("hit"), F.col("clean")).otherwise(own(text))
    if n_chars in out:
        out[n_chars] = F.when(F.col("hit"), F.length("clean")).otherwise(own(n_chars)).cast(kinds[n_chars])
    return rows.select(*[v.alias(c) for c, v in out.items()])
