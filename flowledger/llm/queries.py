"""The registered queries of the training-data operators, and the SQL that checks those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowledger.llm import decontamination, embedding_dedup, html_extraction, language_id, lm_scoring, minhash, nearest, secret_scan, sentencepiece_codec, spelling, token_counts, warc, whitening
from flowledger.session import materialize, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are installed; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op2_decontamination")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_minhash_near_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query("op4_sentencepiece")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query(
    "op5_embedding_near_dedup",
    """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
       ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
              AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
       p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
             WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
       r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
       n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY 1),
       c AS (SELECT a AS vec_id, min(b) AS low FROM r GROUP BY 1)
       SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
              vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
       FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)""",
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


@query("op6_language_id")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(language_id.documents_evidence(table(spark, folder, "documents")))


def _spans_sql() -> str:
    """Per rule the matches that are long enough, with the lengths of what lies before them added up."""
    parts = []
    for rank, rule in enumerate(secret_scan.RULES):
        p = rule.pattern.replace("'", "''")
        parts.append(
            f"SELECT row, doc_id, {rank} AS rank, '{rule.kind}' AS kind, whole, part, starts FROM (SELECT row, doc_id, "
            f"unnest(whole) AS whole, unnest(part) AS part, unnest(list_transform(range(1, len(whole) + 1), "
            f"lambda i: list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0))) AS starts "
            f"FROM (SELECT row, doc_id, regexp_extract_all(text, '{p}') AS whole, regexp_extract_all(text, '{p}', {rule.group}) AS part, "
            f"string_split_regex(text, '{p}') AS between FROM docs WHERE regexp_matches(text, '{p}'))) WHERE length(part) >= {rule.least}"
        )
    return (
        "WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), spans AS ("
        + " UNION ALL ".join(parts)
        + "), found AS (SELECT row, kind, rank, starts, kind || ':' || CAST(starts AS BIGINT) || ':' || CAST(starts + length(whole) AS BIGINT) AS span FROM spans) "
        "SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, "
        "sha256(coalesce(string_agg(span, ',' ORDER BY starts, rank) FILTER (rank < 3), '')) AS base_sha256, "
        "coalesce(string_agg(span, ',' ORDER BY starts, rank), '') AS spans FROM docs LEFT JOIN found USING (row) GROUP BY row, doc_id"
    )


@query("op7_secret_scan", _spans_sql())
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, folder, "documents"))


@query("op8_html_extraction")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.main_text(table(spark, folder, "pages"))


@query("op9_lm_scoring")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query(
    "op10_warc",
    "WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size FROM pages), "
    "f AS (SELECT *, CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p) "
    "SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, "
    "CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, "
    "CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f",
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_archives(warc.mark_revisits(table(spark, folder, "pages")), scratch_path(spark, "warc"))
    return warc.page_records(warc.read_archives(materialize(archives, "warc-manifest")))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(table(spark, folder, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long")).withColumn("component", F.col("component").cast("int"))


@query(
    "op12_nearest_neighbours",
    """WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL),
       ok AS (SELECT * FROM v WHERE len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x)))
              AND list_bool_or(list_transform(e, lambda x: x <> 0))),
       s AS (SELECT q.vec_id AS query_id, q.e, c.vec_id, list_inner_product(q.e, c.e) AS score FROM ok q JOIN ok c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id
             WHERE q.vec_id % 20 = 0)
       SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
       FROM (SELECT *, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


#: Runs of letters with a checksum by a table of 256 entries, near words by the words without each of their letters.
_SPELLING_SQL = """WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
         lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
       runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{7,}')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
       each AS (SELECT id, run, count(*) AS n, flatten(list_transform(string_split(id || ':' || run, ''),
         lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes FROM runs GROUP BY id, run),
       sums AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(bytes, lambda x: CAST(x AS BIGINT))),
         lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)]))) AS h FROM each, t),
       cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM sums),
       v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
       less AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
       one AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
               UNION SELECT less.word, v.word FROM less JOIN v ON less.rest = v.word UNION SELECT v.word, less.word FROM less JOIN v ON less.rest = v.word),
       best AS (SELECT one.a AS word, count(*) AS n_near, arg_min(one.b, (-v.n, one.b)) AS near, max(v.n) AS near_n FROM one JOIN v ON v.word = one.b GROUP BY 1),
       formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form,
                  CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
       walk AS (SELECT word, word AS here, 0 AS steps FROM formed UNION ALL SELECT w.word, f.form, steps + 1 FROM walk w JOIN formed f ON f.word = w.here WHERE f.form IS NOT NULL)
       SELECT f.*, w.root FROM formed f JOIN (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY 1) w USING (word)"""


@query("op13_spelling_variants", _SPELLING_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))
