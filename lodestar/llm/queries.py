"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, exact, jaccard, media, mixing, pivots, quality, tokenfiles, warc
from lodestar.llm.common import table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files of this installation are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.suffix_dedup(table(spark, sf_dir, "documents"), keep_first=False, with_text=False)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenizer_digests(table(spark, sf_dir, "documents"), tokenizer_file())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.window_dedup(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(table(spark, sf_dir, "documents"))
    return media.read_media(stored).drop("error")


#: The mixture of op9: languages by given shares, sources and topics tempered; four fifths of the tokens stay.
MIXTURE = mixing.Targets(given={"lang": {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}})


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIXTURE, keep=["doc_id", "source", "lang"])


def op10_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(table(spark, sf_dir, "documents"), tokenizer_file())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_suffix_array_dedup, op2_quality_classifier, op3_ngram_jaccard_join, op4_warc, op5_bpe, op6_substring_dedup, op7_pivot_top_k, op8_media_jpeg, op9_mixing, op10_repair_token_files]
    return {f.__name__: f for f in own}


#: Words as the contracts define them.
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_array_dedup": """
            WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
            parts AS MATERIALIZED (SELECT doc_id, k, substr(h, CAST(2000 * k + 1 AS BIGINT), 2398) AS g FROM (SELECT doc_id, h, unnest(range(len(h) // 2000 + 1)) AS k FROM h)),
            w AS MATERIALIZED (SELECT doc_id, 1000 * k + i AS p, md5_number(substr(g, CAST(2 * i + 1 AS BIGINT), 400)) AS x FROM (SELECT doc_id, k, g, unnest(range(len(g) // 2 - 199)) AS i FROM parts)),
            again AS (SELECT x FROM w GROUP BY x HAVING count(*) > 1),
            c AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w WHERE x IN (SELECT x FROM again)),
            runs AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c),
            spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY doc_id, run),
            cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM spans),
            kept AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS tail,
                     string_agg(substr(h, CAST(2 * kept_from + 1 AS BIGINT), CAST(2 * (a - kept_from) AS BIGINT)), '' ORDER BY a) AS k FROM cuts JOIN h USING (doc_id) GROUP BY doc_id)
            SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
                   sha256(unhex(CASE WHEN k IS NULL THEN h ELSE k || substr(h, CAST(2 * tail + 1 AS BIGINT)) END)) AS kept_sha256
            FROM h LEFT JOIN kept USING (doc_id)""",
        "op3_ngram_jaccard_join": f"""
            WITH RECURSIVE t AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
            s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM t),
            u AS MATERIALIZED (SELECT doc_id, md5_number(unnest(s)) AS x FROM s),
            both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
            e AS MATERIALIZED (SELECT a, b FROM both_ JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
            e2 AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
            c AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT c.doc_id, e2.b FROM c JOIN e2 ON c.other = e2.a)
            SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM c GROUP BY doc_id) USING (doc_id)""",
        "op6_substring_dedup": f"""
            WITH t AS MATERIALIZED (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
            v AS MATERIALIZED (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 19], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t)),
            later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM v) WHERE k > 1),
            gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
            words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM t),
            kept AS (SELECT doc_id, count(g.j) AS n_removed, string_agg(x, ' ' ORDER BY j) FILTER (WHERE g.j IS NULL) AS k FROM words LEFT JOIN gone g USING (doc_id, j) GROUP BY doc_id)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)""",
        "op7_pivot_top_k": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS DOUBLE)) AS code FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.code, c.code) AS BIGINT) AS score
                  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.code) = len(c.code) WHERE q.vec_id % 20 = 0),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op4_warc": """
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
            h AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
            r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM h)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
            FROM r""",
    }
