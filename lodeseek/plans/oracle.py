"""The queries in DuckDB's SQL."""

from __future__ import annotations

from lodeseek.plans.queries import CLUSTERS, PROBES, TEXT, TWICE, K

CORPUS = "SELECT d.doc_id, d.text, d.lang, d.source, e.embedding FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id"
VECTORS = "SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings"


def tokens(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: strlen(x) > 1)"


def postings(docs: str = "SELECT doc_id, text FROM documents") -> str:
    """CTEs d (doc_id, t), p (term, doc_id, tf, doc_len), v (term, doc_freq), s (n_docs, total_len, avg_doc_len)."""
    return f"""d AS (SELECT doc_id, {tokens("text")} AS t FROM ({docs})),
p AS (SELECT term, doc_id, count(*) AS tf, doc_len FROM (SELECT doc_id, len(t) AS doc_len, unnest(t) AS term FROM d) GROUP BY ALL),
v AS (SELECT term, count(*) AS doc_freq FROM p GROUP BY term),
s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS total_len, avg(len(t)) AS avg_doc_len FROM d)"""


def bm25(tf: str, doc_len: str, avg: str, n: str, df: str) -> str:
    return f"CASE WHEN {df} = 0 OR {n} = 0 THEN 0.0 ELSE ln(({n} - {df} + 0.5) / ({df} + 0.5) + 1.0) * ({tf} * 2.2::DOUBLE) / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {doc_len} / {avg})) END"


SCORE = bm25("p.tf", "p.doc_len", "s.avg_doc_len", "s.n_docs", "v.doc_freq")


def hits(queries: str) -> str:
    """CTE h (query_id, doc_id, score), after postings()."""
    return f"""q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens("text")}) AS term FROM ({queries})) GROUP BY ALL),
h AS (SELECT query_id, doc_id, round(sum(qtf * ({SCORE})), 6) AS score FROM q JOIN p USING (term) JOIN v USING (term), s GROUP BY ALL)"""


def lexical(text: str, k: int, docs: str = "SELECT doc_id, text FROM documents", name: str = "lx") -> str:
    return f"""{postings(docs)}, {hits(f"SELECT 0 AS query_id, '{text}' AS text")},
{name} AS (SELECT doc_id, score FROM h ORDER BY score DESC, doc_id LIMIT {k})"""


def fold(a: str, b: str, op: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {op.replace('A', a + '[i]').replace('B', b + '[i]')}))"


L2 = fold("x.v", "y.v", "(A - B) * (A - B)")
FIRST = f"(SELECT v FROM ({VECTORS}) ORDER BY doc_id LIMIT 1)"


def vector(k: int, vectors: str = VECTORS, name: str = "vx") -> str:
    return f"""vv AS ({vectors}), vq AS (SELECT v FROM vv ORDER BY doc_id LIMIT 1),
{name} AS (SELECT x.doc_id, round(1 / (1 + {L2}), 6) AS score FROM vv x, vq y ORDER BY score DESC, doc_id LIMIT {k})"""


def lloyd(steps: int = 10) -> str:
    """CTEs e (doc_id, v), c0 to c10 (cluster_id, v) and a (doc_id, cluster_id), by as many rounds as k-means may take."""
    parts = [f"e AS ({VECTORS})", f"c0 AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1)::INTEGER AS cluster_id, v FROM e ORDER BY doc_id LIMIT {CLUSTERS})"]
    for i in range(steps):
        parts.append(f"""a{i} AS (SELECT x.doc_id, x.v, arg_min(y.cluster_id, {{'d': {L2}, 'c': y.cluster_id}}) AS cluster_id FROM e x, c{i} y GROUP BY x.doc_id, x.v),
m{i} AS (SELECT cluster_id, pos, avg(value) AS value FROM (SELECT cluster_id, unnest(v) AS value, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY ALL),
n{i} AS (SELECT cluster_id, list(value ORDER BY pos) AS v FROM m{i} GROUP BY cluster_id),
c{i + 1} AS MATERIALIZED (SELECT c.cluster_id, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN n{i} n USING (cluster_id))""")
    parts.append(f"a AS MATERIALIZED (SELECT x.doc_id, x.v, arg_min(y.cluster_id, {{'d': {L2}, 'c': y.cluster_id}}) AS cluster_id FROM e x, c{steps} y GROUP BY x.doc_id, x.v)")
    return ",\n".join(parts)


PROBE = f"pr AS (SELECT query_id, q, cluster_id FROM (SELECT x.doc_id AS query_id, x.v AS q, y.cluster_id, row_number() OVER (PARTITION BY x.doc_id ORDER BY {L2}, y.cluster_id) AS n FROM e x, c10 y WHERE x.doc_id % 100 = 0) WHERE n <= {PROBES})"
PAIR = L2.replace("x.v", "a.v").replace("y.v", "pr.q")
IVF_BATCH = f"ib AS (SELECT * FROM (SELECT query_id, doc_id, round(1 / (1 + {PAIR}), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + {PAIR}), 6) DESC, doc_id)::INTEGER AS rank FROM pr JOIN a USING (cluster_id)) WHERE rank <= {K})"


def batch(k: int, vectors: str = VECTORS) -> str:
    return f"""bv AS ({vectors}),
vb AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM (SELECT y.doc_id AS query_id, x.doc_id, round(1 / (1 + {L2}), 6) AS score FROM bv x, bv y WHERE y.doc_id % 100 = 0)) WHERE rank <= {k})"""


def fuse(lists: str, k: int) -> str:
    return f"SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM ({lists}) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {k}"


def rank(rows: str) -> str:
    return f"SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM {rows}"


DOCS_OF_CORPUS, VECTORS_OF_CORPUS = f"SELECT doc_id, text FROM ({CORPUS})", f"SELECT doc_id, embedding::DOUBLE[] AS v FROM ({CORPUS})"
BOTH = f"{lexical(TEXT, 2 * K, DOCS_OF_CORPUS)}, {vector(2 * K, VECTORS_OF_CORPUS)}"
HYBRID = fuse(f"{rank('lx')} UNION ALL {rank('vx')}", K)
IDS = "SELECT (row_number() OVER () - 1)::BIGINT AS doc_id, doc_id AS stored_id FROM documents"

ORACLE_SQL: dict[str, str] = {
    "doc_lengths": f"SELECT doc_id, len({tokens('text')})::BIGINT AS doc_len FROM documents",
    "corpus_stats": f"WITH {postings()} SELECT n_docs, total_len, round(avg_doc_len, 6) AS avg_doc_len FROM s",
    "term_frequencies": f"WITH {postings()} SELECT term, doc_id, tf, doc_len::BIGINT AS doc_len FROM p",
    "vocabulary": f"WITH {postings()} SELECT term, doc_freq, (row_number() OVER (ORDER BY term) - 1)::BIGINT AS term_id FROM v",
    "bm25_term_scores": f"WITH {postings()} SELECT term, doc_id, tf, doc_freq, round({SCORE}, 6) AS score FROM p JOIN v USING (term), s",
    "bm25_shapes": f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round({bm25('q', '(q * 3)', '75.0::DOUBLE', '1000.0::DOUBLE', 'f')}, 6) AS score FROM (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS q, (l_orderkey % 5)::DOUBLE AS f FROM lineitem)",
    "lexical_topk": f"WITH {lexical(TEXT, K)} SELECT * FROM lx",
    "lexical_duplicate_terms": f"WITH {lexical(TWICE, K)} SELECT * FROM lx",
    "lexical_no_match": f"WITH {lexical('nonexistentterm, ?', K)} SELECT * FROM lx",
    "lexical_batch": f"WITH {postings()}, {hits('SELECT item_id AS query_id, text FROM benchmark')} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM h) WHERE rank <= {K}",
    "vector_l2": f"SELECT x.doc_id, round({L2}, 6) AS distance FROM ({VECTORS}) x, (SELECT {FIRST} AS v) y",
    "vector_dot": f"SELECT x.doc_id, round({fold('x.v', 'y.v', 'A * B')}, 6) AS product FROM ({VECTORS}) x, (SELECT {FIRST} AS v) y",
    "vector_normalize": f"SELECT doc_id, (pos - 1)::BIGINT AS pos, round(CASE WHEN n = 0 THEN value ELSE value / n END, 6) AS value FROM (SELECT doc_id, sqrt({fold('v', 'v', 'A * B')}) AS n, unnest(v) AS value, generate_subscripts(v, 1) AS pos FROM ({VECTORS}))",
    "similarity_scores": f"SELECT x.doc_id, round(1 / (1 + {L2}), 6) AS score FROM ({VECTORS}) x, (SELECT {FIRST} AS v) y",
    "vector_exact_topk": f"WITH {vector(K)} SELECT * FROM vx",
    "vector_batch": f"WITH {batch(K)} SELECT * FROM vb",
    "kmeans_centroids": f"WITH {lloyd()} SELECT cluster_id, (pos - 1)::BIGINT AS pos, round(value, 6) AS value FROM (SELECT cluster_id, unnest(v) AS value, generate_subscripts(v, 1) AS pos FROM c10)",
    "cluster_assign": f"WITH {lloyd()} SELECT doc_id, cluster_id FROM a",
    "cluster_sizes": f"WITH {lloyd()} SELECT cluster_id, count(*) AS n FROM a GROUP BY cluster_id",
    "nearest_clusters": f"WITH {lloyd()}, {PROBE} SELECT query_id, cluster_id FROM pr",
    "ivf_topk": f"WITH {lloyd()}, iq AS (SELECT v FROM e ORDER BY doc_id LIMIT 1), ic AS (SELECT x.cluster_id FROM c10 x, iq y ORDER BY {L2}, x.cluster_id LIMIT {PROBES}) SELECT x.doc_id, round(1 / (1 + {L2}), 6) AS score FROM a x JOIN ic USING (cluster_id), iq y ORDER BY score DESC, doc_id LIMIT {K}",
    "ivf_topk_all_probes": f"WITH {vector(K)} SELECT * FROM vx",
    "ivf_batch": f"WITH {lloyd()}, {PROBE}, {IVF_BATCH} SELECT query_id, doc_id, score, rank FROM ib",
    "ivf_recall": f"WITH {lloyd()}, {PROBE}, {IVF_BATCH}, {batch(K)} SELECT count(*) AS n, count(ib.doc_id) AS hits FROM vb LEFT JOIN ib USING (query_id, doc_id)",
    "rrf_fuse": f"WITH n AS (SELECT doc_id, len({tokens('text')}) AS n FROM documents) {fuse(' UNION ALL '.join(rank(f'(SELECT doc_id, {s} AS score FROM n ORDER BY score DESC, doc_id LIMIT 50)') for s in ('n', '-n', 'doc_id')), K)}",
    "rrf_scores": f"WITH n AS (SELECT doc_id, len({tokens('text')}) AS score FROM documents) SELECT doc_id, rank, round(1.0::DOUBLE / (60 + rank), 6) AS rrf FROM ({rank('n')})",
    "hybrid_topk": f"WITH {BOTH} {HYBRID}",
    "hybrid_lexical_only": f"WITH {lexical(TEXT, 2 * K, DOCS_OF_CORPUS)} {fuse(rank('lx'), K)}",
    "hybrid_vector_only": f"WITH {vector(2 * K, VECTORS_OF_CORPUS)} {fuse(rank('vx'), K)}",
    "hybrid_batch": f"""WITH {postings(DOCS_OF_CORPUS)}, {hits(f"SELECT doc_id AS query_id, text FROM ({CORPUS}) WHERE doc_id % 100 = 0")}, {batch(2 * K, VECTORS_OF_CORPUS)},
u AS (SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h) WHERE rank <= {2 * K} UNION ALL SELECT query_id, doc_id, rank FROM vb),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM u GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM f) WHERE rank <= {K}""",
    "fetch_results": f"WITH {lexical(TEXT, K, DOCS_OF_CORPUS)} SELECT doc_id, score, text, unnest(['lang', 'source']) AS key, unnest([lang, source]) AS value FROM lx JOIN ({CORPUS}) USING (doc_id)",
    "index_search": f"WITH {BOTH}, hx AS ({HYBRID}), r AS (SELECT 'lexical' AS kind, * FROM (SELECT * FROM lx ORDER BY score DESC, doc_id LIMIT {K}) UNION ALL SELECT 'vector', * FROM (SELECT * FROM vx ORDER BY score DESC, doc_id LIMIT {K}) UNION ALL SELECT 'hybrid', * FROM hx) SELECT kind, r.doc_id, score, length(text)::BIGINT AS n_chars, source FROM r JOIN ({CORPUS}) c ON r.doc_id = c.doc_id",
    "dense_ids": IDS,
    "limited_scan": f"SELECT * FROM ({IDS}) WHERE doc_id < 100",
    "ingest_documents": f"SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS doc_id, 'd' || doc_id AS id, length(text)::BIGINT AS n_chars, len(embedding)::BIGINT AS dim, round(embedding[1]::DOUBLE, 6) AS first FROM ({CORPUS})",
    "ingest_limited": f"SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS doc_id, 'd' || doc_id AS id FROM ({CORPUS}) ORDER BY doc_id LIMIT 150",
    "ingest_dim": f"SELECT DISTINCT len(embedding)::BIGINT AS dim FROM ({CORPUS})",
    "training_sample": "SELECT clusters::INTEGER AS clusters, least(count(*), most)::BIGINT AS n, least(count(*), most)::BIGINT AS ids FROM (SELECT DISTINCT l_orderkey * 10 + l_linenumber FROM lineitem), (VALUES (1, 10000), (1000, 40000)) t(clusters, most) GROUP BY clusters, most",
    "embedding_dims": "SELECT len(embedding)::BIGINT AS dim, count(*) AS n FROM embeddings GROUP BY 1",
}
