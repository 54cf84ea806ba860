"""SQL for DuckDB with the same rows as the queries of those names."""

from __future__ import annotations

from lodestar.operators import evaluate, metrics, quantization, rag
from lodestar.plans import queries as Q
from lodestar.streaming import ratelimit

COLLECTION = """
docs AS (SELECT d.doc_id AS id, d.text, e.embedding, d.lang AS collection,
                to_json({'source': d.source, 'lang': d.lang, 'label': e.label})::VARCHAR AS metadata, d.lang AS lang
         FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"""
DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
QUERY = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def top(frm: str, key: str, k: int, sign: str = "", where: str = "true", low: str = "0") -> str:
    """CTE body: rank, key, score, distance of the k nearest to vector 0."""
    dot = f"{sign}{DOT.format(a='embedding', b=QUERY)}"
    return f"""SELECT CAST(row_number() OVER (ORDER BY d DESC, {key}) AS INTEGER) AS rank, {key}, greatest({low}.0::DOUBLE, least(1.0::DOUBLE, d)) AS score,
        1 - greatest({low}.0::DOUBLE, least(1.0::DOUBLE, d)) AS distance
        FROM (SELECT {key}, {dot} AS d FROM {frm} WHERE {where} ORDER BY d DESC, {key} LIMIT {k})"""


SCORES = "round(score, 6) AS score, round(distance, 6) AS distance"
KNN = f"""knn AS (SELECT q.vec_id AS query_id, e.vec_id, {DOT.format(a="q.embedding", b="e.embedding")} AS d FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d DESC, vec_id) AS INTEGER) AS rank FROM knn)"""
BATCH = f"WITH {KNN} SELECT query_id, rank, vec_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, d)), 6) AS score FROM r WHERE rank <= {Q.LIMIT}"
TOPK = f"WITH t AS ({top('embeddings', 'vec_id', Q.LIMIT)}) SELECT rank, vec_id, {SCORES} FROM t"
ASKED = ", ".join(f"'{w}'" for w in Q.WORDS.split())
KEYWORDS = f"CAST(len(list_filter([{ASKED}], lambda w: contains(lower(text), w))) AS DOUBLE) / len([{ASKED}])"
CODES = "list_transform(embedding, lambda x: CAST(floor(greatest(0::FLOAT, least(255::FLOAT, (x + 1::FLOAT) * 127.5::FLOAT))) AS SMALLINT))"
BACK = f"list_transform({CODES}, lambda c: c::DOUBLE / 127.5::DOUBLE - 1)"
RMS = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) / len({a}))"
DISTANCE = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
SHARD = f"""CAST(list_reduce(list_prepend(0::UHUGEINT, list_transform(string_split(collection, ''), lambda c: ascii(c)::UHUGEINT)),
    lambda h, b: (h * 31 + b) % 18446744073709551616::UHUGEINT) % {Q.SHARDS} AS INTEGER)"""
INIT = f"""
s AS MATERIALIZED (SELECT embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS i
    FROM (SELECT * FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 1024)),
n AS (SELECT count(*) AS n FROM s),
init AS (SELECT CAST(c AS INTEGER) AS code, v AS centroid FROM range({Q.PQ_K}) t(c), n JOIN s ON s.i = (c * 7) % n.n WHERE c < n.n)"""
NEAR = f"""
near AS (SELECT vec_id, v, code FROM (SELECT e.vec_id, e.embedding::DOUBLE[] AS v, code,
    row_number() OVER (PARTITION BY e.vec_id ORDER BY {DISTANCE.format(a="e.embedding::DOUBLE[]", b="centroid")}, code) AS k FROM embeddings e, init) WHERE k = 1)"""


def lloyd_step(i: int) -> str:
    """CTEs of a Lloyd step in each subspace: book{i} from book{i - 1}. A centroid moves if its mean is farther than the least shift."""
    distance = DISTANCE.format(a="p", b="centroid")
    return f"""own{i} AS MATERIALIZED (SELECT i, sub, p, code FROM (SELECT i, parts.sub, p, code, row_number() OVER (PARTITION BY i, parts.sub ORDER BY {distance}, code) AS k
    FROM parts JOIN book{i - 1} USING (sub)) WHERE k = 1),
means{i} AS (SELECT sub, code, list(mean ORDER BY pos) AS mean FROM (SELECT sub, code, pos, avg(p[pos]) AS mean FROM own{i}, range(1, 65) r(pos) WHERE pos <= len(p) GROUP BY ALL) GROUP BY ALL),
book{i} AS MATERIALIZED (SELECT sub, code, CASE WHEN mean IS NOT NULL AND sqrt({DISTANCE.format(a="mean", b="centroid")}) > {quantization.SHIFT} THEN mean ELSE centroid END AS centroid
    FROM book{i - 1} LEFT JOIN means{i} USING (sub, code)),
"""


#: All Lloyd steps in each subspace, then the codes of all vectors.
PQ = f"""
s AS MATERIALIZED (SELECT embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS i
    FROM (SELECT * FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 1024)),
n AS (SELECT count(*) AS n FROM s),
subs AS (SELECT CAST(m AS INTEGER) AS sub FROM range({Q.PQ_M}) t(m)),
parts AS MATERIALIZED (SELECT i, sub, v[sub * len(v) // {Q.PQ_M} + 1 : (sub + 1) * len(v) // {Q.PQ_M}] AS p FROM s, subs),
book0 AS MATERIALIZED (SELECT sub, CAST(c AS INTEGER) AS code, p AS centroid FROM range({Q.PQ_K}) t(c), n JOIN parts ON parts.i = (c * 7) % n.n WHERE c < n.n),
{"".join(lloyd_step(i) for i in range(1, quantization.ITERATIONS + 1))}book AS (SELECT * FROM book{quantization.ITERATIONS}),
every AS (SELECT vec_id, sub, (embedding::DOUBLE[])[sub * len(embedding) // {Q.PQ_M} + 1 : (sub + 1) * len(embedding) // {Q.PQ_M}] AS p FROM embeddings, subs),
coded AS MATERIALIZED (SELECT vec_id, sub, p, code, centroid FROM (SELECT vec_id, every.sub, p, code, centroid,
    row_number() OVER (PARTITION BY vec_id, every.sub ORDER BY {DISTANCE.format(a="p", b="centroid")}, code) AS k FROM every JOIN book USING (sub)) WHERE k = 1)"""
#: The generator of synthetic vectors, one component after the other.
SYNTHETIC = f"""WITH RECURSIVE g AS (SELECT 0 AS i, {evaluate.SEED}::UHUGEINT AS state
    UNION ALL SELECT i + 1, (state * {evaluate.MULTIPLIER}::UHUGEINT + {evaluate.INCREMENT}::UHUGEINT) % 18446744073709551616::UHUGEINT FROM g WHERE i < 6400),
x AS (SELECT (i - 1) // 32 AS idx, (i - 1) % 32 AS pos, (state // 8589934592::UHUGEINT)::FLOAT / 2147483647::FLOAT * 2::FLOAT - 1::FLOAT AS x FROM g WHERE i > 0),
v AS (SELECT idx, list(x ORDER BY pos) AS v FROM x GROUP BY idx),
u AS (SELECT idx, v, sqrt(list_sum(list_transform(v, lambda e: e::DOUBLE * e::DOUBLE))) AS size FROM v),
e AS (SELECT idx, list_transform(v, lambda y: (y::DOUBLE / size)::FLOAT) AS e FROM u)
SELECT CAST(idx AS BIGINT) AS idx, 'synthetic-doc-' || CAST(idx AS BIGINT) AS text, '{{"idx":' || CAST(idx AS BIGINT) || ',"type":"synthetic"}}' AS metadata,
    round(e[32]::DOUBLE, 6) AS last, round(list_sum(list_transform(e, lambda y: y::DOUBLE)), 6) AS total FROM e"""
#: The limiter, one event of each user after the other.
LIMITER = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS n
    FROM (SELECT event_id, user_id, epoch_us(ts) // 60000000 AS s FROM events)),
r AS (SELECT user_id, n, event_id, s AS opened, 1 AS c, true AS allowed FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN e.s - opened > {ratelimit.WINDOW} THEN e.s ELSE opened END,
        CASE WHEN e.s - opened > {ratelimit.WINDOW} THEN 1 WHEN c < 3 THEN c + 1 ELSE c END, e.s - opened > {ratelimit.WINDOW} OR c < 3
    FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, user_id, allowed FROM r"""


def histogram(frm: str, value: str, bounds: tuple, labels: str, digits: int) -> str:
    rows = ", ".join(f"('{metrics.bound_text(b)}', {'CAST(''Infinity'' AS DOUBLE)' if b == float('inf') else f'{b}::DOUBLE'})" for b in bounds).replace("CAST(Infinity AS DOUBLE)", "CAST('Infinity' AS DOUBLE)")
    return f"""SELECT {labels}, le, CAST(sum(CASE WHEN {value} <= bound THEN 1 ELSE 0 END) AS BIGINT) AS count, round(sum({value}), {digits}) AS sum, count({value}) AS total
        FROM {frm}, (VALUES {rows}) b(le, bound) GROUP BY {labels}, le"""


ERRORS = f"SELECT vec_id, label, {RMS.format(a='embedding', b=BACK)} AS error FROM embeddings"
LOG = "SELECT event_id, ts, event_type AS collection, CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS hybrid, value / 1000 AS seconds FROM events"
SPACES = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
def n_words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{SPACES}+'), lambda w: w <> ''))"



LAST = f"""last AS (SELECT conv_id, coalesce(regexp_replace(max_by(text, turn) FILTER (WHERE role = 'user'), '^{SPACES}+|{SPACES}+$', '', 'g'), '') AS query
    FROM conversations GROUP BY conv_id)"""
FIVE = f"WITH {COLLECTION}, t AS ({top('docs', 'id', rag.TOP_K)}), found AS (SELECT t.*, text FROM t JOIN docs USING (id))"
BOOSTED = f"{FIVE}, boosted AS (SELECT id, text, least(1.0::DOUBLE, score + strlen(text) / 1000.0::DOUBLE) AS s FROM found), final AS (SELECT id, text, row_number() OVER (ORDER BY s DESC, id) AS rank FROM boosted)"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def augmented(head: str, context: str, before: str, after: str) -> str:
    """SQL of the messages with a system text around the context."""
    return f"""{head}, ctx AS (SELECT {quoted(before)} || {context} || {quoted(after)} AS sys FROM final),
        turns AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS n FROM conversations),
        heads AS (SELECT conv_id, max(CASE WHEN n = 0 AND role = 'system' THEN 1 ELSE 0 END) AS has FROM turns GROUP BY conv_id)
        SELECT conv_id, CAST(n + 1 - has AS BIGINT) AS n, role, CASE WHEN n = 0 AND has = 1 THEN sys || chr(10) || chr(10) || text ELSE text END AS content FROM turns JOIN heads USING (conv_id), ctx
        UNION ALL SELECT conv_id, 0::BIGINT, 'system', sys FROM heads, ctx WHERE has = 0"""


def _plain(preset: rag.Preset) -> str:
    before, _, after = preset.system.partition("{context}")
    return augmented(f"{FIVE}, final AS (SELECT id, text, rank FROM found)", f"string_agg(text, {quoted(preset.joiner)} ORDER BY rank)", before, after)


def _metrics_text() -> str:
    def head(name: str) -> str:
        about, kind = metrics.METRICS[name]
        return quoted(f"# HELP {name} {about}\n# TYPE {name} {kind}\n")

    def lines(sql: str, at: int) -> str:
        return f"l{at} AS (SELECT string_agg(line, chr(10) ORDER BY line) AS t FROM ({sql}))"

    counter = "SELECT '{name}{{collection=\"' || lang || '\"}} ' || count(*) AS line FROM documents GROUP BY lang"
    hist = f"""SELECT 'quant_error_bucket{{label="' || label || '",le="' || le || '"}} ' || count AS line FROM h
        UNION ALL SELECT 'quant_error_sum{{label="' || label || '"}} ' || sum FROM h WHERE le = '+Inf'
        UNION ALL SELECT 'quant_error_count{{label="' || label || '"}} ' || total FROM h WHERE le = '+Inf'"""
    return f"""WITH h AS ({histogram(f"({ERRORS})", "error", metrics.QUANT_BOUNDS, "label", 3)}),
        {lines(counter.format(name="vector_ingest_total"), 1)}, {lines(counter.format(name="vector_docs_total"), 2)}, {lines(hist, 3)}
        SELECT {head("vector_ingest_total")} || l1.t || chr(10) || {head("vector_docs_total")} || l2.t || chr(10) || {head("quant_error")} || l3.t || chr(10) AS text FROM l1, l2, l3"""


def build() -> dict[str, str]:
    five_k = 5 * Q.LIMIT
    post = lambda more, column, cut: f"""WITH {COLLECTION}, t AS ({top("docs", "id", five_k)}), f AS (SELECT t.id, t.rank, t.score, t.distance, d.text, d.metadata FROM t JOIN docs d ON d.id = t.id
        WHERE d.lang = 'en' {more}) SELECT CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank, id, {column}, {SCORES} FROM f {cut}"""  # noqa: E731
    hybrid = f"""WITH {COLLECTION}, t AS ({top("docs", "id", 3 * Q.LIMIT)}), h AS (SELECT id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.7::DOUBLE * score + 0.3::DOUBLE * {KEYWORDS})) AS score
        FROM t JOIN docs USING (id)) SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, id, round(score, 6) AS score, round(1 - score, 6) AS distance FROM h ORDER BY score DESC, id LIMIT {Q.LIMIT}"""
    before, _, after = rag.SERVER.system.partition("{context}")
    server_context = "string_agg('- [' || rank || ']: ' || text, chr(10) ORDER BY rank)"
    return {
        "vec_topk_exact": TOPK,
        "vec_brute_topk": f"WITH t AS ({top('embeddings', 'vec_id', Q.LIMIT, sign='-', low='-1')}) SELECT rank, vec_id, {SCORES} FROM t",
        "vec_batch_knn": BATCH,
        "vec_min_score": f"WITH t AS ({top('embeddings', 'vec_id', five_k)}) SELECT rank, vec_id, {SCORES} FROM t WHERE score >= {Q.MIN_SCORE}",
        "vec_similarity_join": f"WITH {KNN} SELECT query_id, vec_id, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, d)), 6) AS score FROM knn WHERE query_id <> vec_id AND d >= {Q.THRESHOLD}",
        "search_metadata_post": post("", "metadata", ""),
        "search_metadata_pre": f"WITH {COLLECTION}, t AS ({top('docs', 'id', Q.LIMIT, where='lang = ' + quoted('en'))}) SELECT rank, id, metadata, {SCORES} FROM t JOIN docs USING (id)",
        "search_request": post(f"AND t.score >= {Q.MIN_SCORE}", "text", f"ORDER BY rank LIMIT {Q.LIMIT}"),
        "hybrid_search": hybrid,
        "retrieve": f"{FIVE} SELECT rank, id, text, {SCORES} FROM found",
        "rerank_length": f"""WITH {COLLECTION}, t AS ({top("docs", "id", Q.LIMIT)}), b AS (SELECT id, least(1.0::DOUBLE, score + strlen(text) / 1000.0::DOUBLE) AS score, distance FROM t JOIN docs USING (id))
            SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, id, {SCORES} FROM b""",
        "result_lines": f"""WITH {COLLECTION}, t AS ({top("docs", "id", Q.LIMIT)})
            SELECT rank, format('{{}}. [{{:.4f}}] {{}} ', rank, score, id) || CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS line FROM t JOIN docs USING (id)""",
        "keyword_score": f"SELECT doc_id, round({KEYWORDS}, 6) AS score FROM documents",
        "metadata_flatten": f"""WITH {COLLECTION}, m AS (SELECT id, unnest(['source', 'lang', 'label']) AS key, metadata FROM docs)
            SELECT id, key, json_extract_string(metadata, '$.' || key) AS value FROM m WHERE json_extract_string(metadata, '$.' || key) IS NOT NULL""",
        "vec_norms": f"SELECT vec_id, round(sqrt({DOT.format(a='embedding', b='embedding')}), 6) AS norm, len(embedding) AS dim FROM embeddings",
        "vec_normalize": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt({DOT.format(a="e", b="e")}) AS n FROM v)
            SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(CASE WHEN n > 1e-8 THEN e[pos + 1]::DOUBLE / n ELSE e[pos + 1]::DOUBLE END, 6) AS value FROM u, range(64) r(pos) WHERE pos < len(e)""",
        "vec_preview": f"SELECT vec_id, len(embedding) AS dim, round(sqrt({DOT.format(a='embedding', b='embedding')}), 6) AS norm, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS v{i}" for i in range(8)) + " FROM embeddings",
        "scalar_quantize": f"SELECT vec_id, array_to_string({CODES}, ',') AS codes FROM embeddings",
        "scalar_dequantize": f"WITH b AS (SELECT vec_id, {BACK} AS v FROM embeddings) SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(v[pos + 1], 6) AS value FROM b, range(64) r(pos) WHERE pos < len(v)",
        "quant_error": f"SELECT vec_id, round(error, 6) AS error FROM ({ERRORS})",
        "quant_error_hist": histogram(f"({ERRORS})", "error", metrics.QUANT_BOUNDS, "label", 6),
        "nearest_centroid": f"WITH {INIT}, {NEAR} SELECT vec_id, code FROM near",
        "kmeans_step": f"WITH {INIT}, {NEAR} SELECT code, CAST(pos AS BIGINT) AS pos, round(avg(v[pos + 1]), 6) AS mean, count(*) AS n FROM near, range(64) r(pos) WHERE pos < len(v) GROUP BY code, pos",
        "pq_encode": f"WITH {PQ} SELECT vec_id, string_agg(code::VARCHAR, ',' ORDER BY sub) AS codes FROM coded GROUP BY vec_id",
        "pq_decode": f"WITH {PQ}, b AS (SELECT vec_id, flatten(list(centroid ORDER BY sub)) AS v FROM coded GROUP BY vec_id) SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(v[pos + 1], 6) AS value FROM b, range(64) r(pos) WHERE pos < len(v)",
        "pq_error": f"WITH {PQ} SELECT vec_id, round(sqrt(sum({DISTANCE.format(a='p', b='centroid')}) / sum(len(p))), 6) AS error FROM coded GROUP BY vec_id",
        "pq_codebook": f"WITH {PQ} SELECT sub, code, CAST(pos AS BIGINT) AS pos, round(centroid[pos + 1], 6) AS value FROM book, range(64) r(pos) WHERE pos < len(centroid)",
        "pq_search": f"""WITH {PQ}, b AS (SELECT vec_id, flatten(list(centroid ORDER BY sub)) AS v FROM coded GROUP BY vec_id),
            d AS (SELECT vec_id, list_dot_product(v, {QUERY}::DOUBLE[]) AS d FROM b ORDER BY d DESC, vec_id LIMIT {Q.LIMIT})
            SELECT CAST(row_number() OVER (ORDER BY d DESC, vec_id) AS INTEGER) AS rank, vec_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, d)), 6) AS score FROM d""",
        "ivf_recall": "SELECT true AS reached, count(*) AS n_queries FROM embeddings WHERE vec_id % 100 = 0",
        "synthetic_vectors": SYNTHETIC,
        "rate_limit_fixed_window": LIMITER,
        "url_parts": "SELECT page_id, rtrim(url || '//', '/') AS base, trim(url) AS first FROM pages",
        "scalar_search": f"""WITH b AS (SELECT vec_id, list_dot_product({BACK}, {QUERY}::DOUBLE[]) AS d FROM embeddings ORDER BY d DESC, vec_id LIMIT {Q.LIMIT})
            SELECT CAST(row_number() OVER (ORDER BY d DESC, vec_id) AS INTEGER) AS rank, vec_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, d)), 6) AS score FROM b""",
        "ivf_search": TOPK,
        "ivf_batch_search": BATCH,
        "recall_at_k": f"""WITH {KNN}, q AS (SELECT a.vec_id AS query_id, e.vec_id, list_dot_product(a.embedding::DOUBLE[], e.v) AS d FROM embeddings a, (SELECT vec_id, {BACK} AS v FROM embeddings) e WHERE a.vec_id % 100 = 0),
            c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, vec_id) AS rank FROM q),
            hits AS (SELECT r.query_id, count(c.vec_id) AS n FROM r LEFT JOIN c ON c.query_id = r.query_id AND c.vec_id = r.vec_id AND c.rank <= {Q.LIMIT} WHERE r.rank <= {Q.LIMIT} GROUP BY r.query_id)
            SELECT round(avg(n / {Q.LIMIT}.0::DOUBLE), 6) AS recall, count(*) AS n_queries FROM hits""",
        "collection_stats": "SELECT lang AS collection, count(*) AS num_documents, 64 AS embedding_dim, 'HNSW (M=16, ef_c=80, ef_search=32)' AS index_type, 16 AS max_connections, 80 AS ef_construction, 32 AS ef_search FROM documents GROUP BY lang",
        "collection_list": "SELECT DISTINCT lang AS collection FROM documents",
        "point_lookup": "SELECT doc_id, text FROM documents WHERE doc_id = 7",
        "full_scan": f"WITH {COLLECTION} SELECT id, text, metadata, collection FROM docs",
        "shard_route": f"SELECT collection, {SHARD} AS shard FROM (SELECT DISTINCT 'collection-' || source AS collection FROM documents)",
        "replica_placement": f"SELECT doc_id, collection, CAST(replica AS INTEGER) AS replica, CAST(({SHARD} + replica) % {Q.SHARDS} AS INTEGER) AS shard FROM (SELECT doc_id, lang AS collection FROM documents), range({Q.REPLICAS}) r(replica)",
        "shard_list_all": f"SELECT DISTINCT CAST(({SHARD} + replica) % {Q.SHARDS} AS INTEGER) AS shard, collection FROM (SELECT DISTINCT lang AS collection FROM documents), range({Q.REPLICAS}) r(replica)",
        "shard_search": f"WITH {COLLECTION}, t AS ({top('docs', 'id', Q.LIMIT, where='lang = ' + quoted('fr'))}) SELECT rank, id, {SCORES} FROM t",
        "cross_shard_topk": f"WITH {COLLECTION}, t AS ({top('docs', 'id', Q.LIMIT)}) SELECT rank, id, {SHARD} AS shard, {SCORES} FROM t JOIN docs USING (id)",
        "retention_evict": "SELECT collection, doc_id FROM (SELECT lang AS collection, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS n FROM documents) WHERE n <= 50",
        "ingest_validate": f"""SELECT doc_id::VARCHAR AS id, CASE WHEN text IS NULL OR regexp_full_match(text, '{SPACES}*') THEN 'EmptyText' WHEN coalesce(len(embedding), -1) <> 64 THEN 'DimMismatch' ELSE 'ok' END AS verdict
            FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
        "ingest_reopen": "SELECT doc_id::VARCHAR AS id, text, to_json({'source': source})::VARCHAR AS metadata, lang AS collection, len(embedding) AS n_codes FROM documents JOIN embeddings ON doc_id = vec_id WHERE length(trim(text)) > 0 AND len(embedding) = 64",
        "stream_ingest": "SELECT doc_id::VARCHAR AS id, text, lang AS collection FROM documents WHERE length(trim(text)) > 0",
        "ingest_counter": "SELECT lang AS collection, count(*) AS value FROM documents GROUP BY lang",
        "search_counter": f"SELECT collection, hybrid, count(*) AS value FROM ({LOG}) GROUP BY ALL",
        "docs_gauge": f"SELECT collection, max_by(event_id, (ts, event_id)) AS value FROM ({LOG}) GROUP BY collection",
        "index_gauges": """SELECT name, lang AS collection, CAST(CASE name WHEN 'hnsw_num_vectors' THEN n WHEN 'hnsw_max_connections' THEN 16 WHEN 'hnsw_ef_construction' THEN 80 ELSE 32 END AS BIGINT) AS value
            FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang), (VALUES ('hnsw_num_vectors'), ('hnsw_max_connections'), ('hnsw_ef_construction'), ('hnsw_ef_search')) v(name)""",
        "latency_hist": histogram(f"({LOG})", "seconds", metrics.LATENCY_BOUNDS, "collection, hybrid", 4),
        "metrics_text": _metrics_text(),
        "token_usage": f"SELECT count(*) AS n_texts, CAST(sum({n_words('text')}) AS BIGINT) AS n_tokens FROM documents",
        "rag_last_user": f"WITH {LAST} SELECT conv_id, query FROM last",
        "rag_route": f"WITH {LAST} SELECT conv_id, CASE WHEN query = '' THEN 'none' WHEN {n_words('query')} > 3 THEN 'hybrid' ELSE 'vector' END AS route FROM last",
        "rag_context": f"{BOOSTED} SELECT {server_context} AS context, string_agg('Source ' || rank || ': ' || id, chr(10) ORDER BY rank) AS citations FROM final",
        "rag_messages": augmented(BOOSTED, f"'Context:' || chr(10) || {server_context}", before, after),
        "rag_messages_adapter": _plain(rag.ADAPTER),
        "rag_messages_example": _plain(rag.EXAMPLE),
    }
