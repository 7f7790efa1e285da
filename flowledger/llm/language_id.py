"""Language identification by fusing evidence.

Each language's posterior combines the likelihood of the text (hashed character trigrams, counted per
declared language over all labelled texts), the declared markup language, the suffix of the address, and a
prior for the host. Host priors are smoothed hierarchically: host towards its domain, the domain towards all
hosts. All tables of counts are grouped aggregates; only the trigram table, whose size is fixed per language,
reaches the driver. A language counts as known from a share of the declared texts on, which bounds the number of languages.

Defined results: a null text is empty; a text without letters has no evidence of its own, gets the language
"und" and is rejected; without declared languages every text is; an unknown or null declared language, suffix or host says nothing;
rows are independent, so repeated rows give a row each; ties go to the first language in alphabetical order; further
columns are ignored; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowledger.llm.id_filter import unlisted
from flowledger.llm.memory import tidy
from flowledger.session import materialize

SLOTS = 1 << 16
#: A declared language with a smaller share of the labelled texts isn't known; there are at most its inverse of them.
LEAST_SHARE = 0.005
#: Trigrams of a text overlap and repeat, so their log-likelihoods count by this factor.
TEMPER = 0.2
#: How often a declared language is right, the weight of the parent in smoothing, and the least posterior.
TRUST, SMOOTHING, LEAST_POSTERIOR = 0.9, 20.0, 0.5
PIECE = 1_000_000
UNKNOWN = "und"


def slots(text: str) -> Iterator[np.ndarray]:
    """Hash slots of the trigrams of lower-cased letters, with one space for all else between words."""
    for lo in range(0, len(text), PIECE):
        part = text[lo : lo + PIECE + 2].lower()
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        letter = ((code >= 97) & (code <= 122)) | (code >= 0xC0)
        code = np.where(letter, code, np.uint64(32))
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        code = code[keep]
        if letter.any() and len(code) > 2:
            mixed = (code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:]
            yield ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def evidence_rows(docs: DataFrame, doc_id: str, text: str, declared: str | None = None, address: str | None = None, host: str | None = None) -> DataFrame:
    """doc_id, text, declared, suffix, host, domain, from whatever columns there are."""
    some = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    markup = F.regexp_extract(F.col("text"), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    primary = lambda c: F.nullif(F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]{2,3})\b", 1)), F.lit(""))
    place = some(address)
    in_path = F.regexp_extract(place, r"^[a-z+]+://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1)
    top = F.regexp_extract(place, r"^[a-z+]+://[^/?#:]*\.([a-z]{2,})(?:[:/?#]|$)", 1)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(some(text), F.lit("")).alias("text"), some(declared).alias("declared"), place.alias("address"), some(host).alias("host")
    )
    named = F.coalesce(F.col("host"), F.nullif(F.lower(F.regexp_extract(F.col("address"), r"^[a-zA-Z+]+://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")))
    return rows.select(
        "doc_id",
        "text",
        F.coalesce(F.nullif(F.lower(markup), F.lit("")), primary(F.col("declared"))).alias("declared"),
        F.nullif(F.coalesce(F.nullif(F.regexp_extract("address", r"^[a-z+]+://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1), F.lit("")), F.regexp_extract("address", r"^[a-z+]+://[^/?#:]*\.([a-z]{2,})(?:[:/?#]|$)", 1)), F.lit("")).alias("suffix"),
        named.alias("host"),
        F.regexp_extract(named, r"([^.]+(?:\.[^.]+)?)$", 1).alias("domain"),
    )


def known_languages(rows: DataFrame, least_share: float = LEAST_SHARE) -> list[str]:
    """Declared languages with a large enough share; at most 1 / ``least_share`` of them."""
    counts = rows.filter(F.col("declared").isNotNull()).groupBy("declared").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return sorted(r["declared"] for r in counts.filter(F.col("n") >= least_share * total).collect())


def trigram_table(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Logarithm of each slot's probability by language, with every labelled text counted."""
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), SLOTS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column("declared").to_pylist(), batch.column("text"), strict=True):
                if (i := place.get(lang)) is not None:
                    for at in slots(text.as_py()):
                        counts[i] += np.bincount(at, minlength=SLOTS)
        i, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[i, at])], names=["lang", "slot", "n"])

    got = rows.select("declared", "text").mapInArrow(tidy(run), "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((SLOTS, len(languages)), 0.5)
    table[got.column("slot").to_numpy(), got.column("lang").to_numpy()] += got.column("n").to_numpy()
    return np.log(table / table.sum(axis=0)).astype(np.float32)


def text_evidence(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """The rows with ``by_text`` (log-likelihood per language) and ``trigrams`` instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, sizes = [], []
            for text in batch.column("text"):
                total, n = np.zeros(table.shape[1]), 0
                for at in slots(text.as_py()):
                    total += table[at].sum(axis=0, dtype=np.float64)
                    n += len(at)
                sums.append(total)
                sizes.append(n)
            ends = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * table.shape[1])
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sums) if sums else np.empty(0)))
            names = ["doc_id", "declared", "suffix", "host"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists, pa.array(sizes, pa.int64())], names=[*names, "by_text", "trigrams"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "declared", "suffix", "host").mapInArrow(tidy(run), f"doc_id {kind}, declared string, suffix string, host string, by_text array<double>, trigrams long")


def _vector(languages: list[str]) -> Column:
    return F.array(*[F.sum(F.when(F.col("declared") == x, F.col("n")).otherwise(0)).cast("double") for x in languages])


def _smoothed(own: str, parent: str, smoothing: float) -> Column:
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, parent, lambda x, p: (x + smoothing * p) / (total + smoothing))


def host_priors(rows: DataFrame, languages: list[str], smoothing: float = SMOOTHING) -> tuple[DataFrame, list[float]]:
    """(host, prior), and the prior over all hosts. A host's counts are smoothed towards its domain's, those towards all."""
    counts = rows.filter(F.col("declared").isin(languages)).groupBy("host", "domain", "declared").agg(F.count("*").alias("n"))
    counts = materialize(counts, "language-counts")
    seen = {r["declared"]: r["n"] for r in counts.groupBy("declared").agg(F.sum("n").alias("n")).collect()}  # a row per known language
    overall = [(seen.get(x, 0) + 1.0) / (sum(seen.values()) + len(languages)) for x in languages]
    everywhere = F.array(*map(F.lit, overall))
    domain = counts.groupBy("domain").agg(_vector(languages).alias("own")).select("domain", _smoothed("own", everywhere, smoothing).alias("parent"))
    host = counts.filter(F.col("host").isNotNull()).groupBy("host", "domain").agg(_vector(languages).alias("own"))
    return host.join(domain, "domain").select("host", _smoothed("own", "parent", smoothing).alias("prior")), overall


def suffix_likelihoods(rows: DataFrame, languages: list[str], overall: list[float], smoothing: float = SMOOTHING) -> DataFrame:
    """(suffix, by_suffix): logarithm of the language's share under the suffix over its share everywhere."""
    counts = rows.filter(F.col("declared").isin(languages) & F.col("suffix").isNotNull()).groupBy("suffix", "declared").agg(F.count("*").alias("n"))
    everywhere = F.array(*map(F.lit, overall))
    shares = counts.groupBy("suffix").agg(_vector(languages).alias("own")).select("suffix", _smoothed("own", everywhere, smoothing).alias("share"))
    return shares.select("suffix", F.zip_with("share", everywhere, lambda s, p: F.log(s / p)).alias("by_suffix"))


def identify(rows: DataFrame, least_share: float = LEAST_SHARE, least_posterior: float = LEAST_POSTERIOR) -> DataFrame:
    """Per row of :func:`evidence_rows`: doc_id, lang, posterior, accepted."""
    languages = known_languages(rows, least_share)
    if not languages:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    table = trigram_table(rows, languages)
    prior, overall = host_priors(rows, languages)
    # stored, so that the planner knows whether they are small
    prior = materialize(prior, "host-priors")
    suffixes = materialize(suffix_likelihoods(rows, languages, overall), "suffix-likelihoods")
    everywhere, nothing = F.array(*map(F.lit, overall)), F.array(*[F.lit(0.0)] * len(languages))
    wrong = (1 - TRUST) / max(1, len(languages) - 1)
    by_declared = F.when(F.col("declared").isin(languages), F.array(*[F.log(F.when(F.col("declared") == x, TRUST).otherwise(max(wrong, 1e-9))) for x in languages])).otherwise(nothing)
    joined = text_evidence(rows, table).join(prior, "host", "left").join(suffixes, "suffix", "left")
    parts = F.arrays_zip(
        F.col("by_text").alias("t"), F.transform(F.coalesce("prior", everywhere), lambda p: F.log(p)).alias("p"), F.coalesce("by_suffix", nothing).alias("s"), by_declared.alias("d")
    )
    scored = joined.select("doc_id", "trigrams", F.transform(parts, lambda x: x["t"] * TEMPER + x["p"] + x["s"] + x["d"]).alias("total")).withColumn("best", F.array_max("total"))
    known = F.col("trigrams") > 0
    posterior = F.when(known, 1 / F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))).otherwise(0.0)
    lang = F.when(known, F.get(F.array(*map(F.lit, languages)), (F.array_position("total", F.col("best")) - 1).cast("int"))).otherwise(UNKNOWN)
    return scored.select("doc_id", lang.alias("lang"), posterior.alias("posterior")).withColumn("accepted", F.col("posterior") >= least_posterior)


def documents_evidence(docs: DataFrame) -> DataFrame:
    """Documents: the declared language is ``lang`` or markup in the text, the source stands for the host."""
    return evidence_rows(docs, "doc_id", "text", "lang", None, "source")


def pages_evidence(pages: DataFrame) -> DataFrame:
    """Pages: the markup declares the language, the URL gives suffix and host; the markup itself is no text."""
    rows = evidence_rows(pages, "page_id", "html", None, "url")
    bare = F.regexp_replace(F.regexp_replace("text", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return rows.withColumn("text", bare)


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose language can't be told; rows without id stay, as they can't be named."""
    found = identify(documents_evidence(docs))
    gone = found.filter(~F.col("accepted") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return unlisted(docs, materialize(gone, "language-rejected"), "doc_id")
