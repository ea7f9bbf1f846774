"""The operators as queries over whole tables, with production parameters, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import crossparse, langid, licenses, minhash, mixing, packing, pii, quality, vptree, warc
from lodeseek.sources.parquet import spread

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), tokenizer())


def op2_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents"), texts=False).drop("clean_text")


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_identify_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).drop("margins")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents"), weight=mixing.quality())
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


#: The key of the test queries; a real one comes from the caller's secret store.
PII_KEY = b"lodeseek test key"


def op6_pseudonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, spans_col="spans")
    return rows.select("doc_id", "text", F.size("spans").cast("long").alias("n_replaced"), F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",").alias("replaced"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op9_cross_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference is the whole corpus, less the document's own text."""
    return crossparse.cross_parsed(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_best_fit_packing, op2_clean_lines, op3_nearest_vectors, op4_identify_languages, op5_mix_sources, op6_pseudonymise, op7_warc_round_trip, op8_scan_licenses, op9_cross_parse, op10_near_duplicates)}

#: Rows are numbered, so that repeated ids stay apart; windows of three are counted within a row.
QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT r, i, w, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM w WINDOW x AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS twice FROM g WHERE w3 IS NOT NULL),
p AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM c WHERE twice) GROUP BY r),
n AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
l AS (SELECT r, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT r, string_split(t, chr(10)) AS ls FROM d)),
f AS (SELECT r, i, l, regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS b, row_number() OVER (PARTITION BY r, l ORDER BY i) > 1 AS dup
  FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
j AS (SELECT r, dup, len(regexp_extract_all(b, '[^\x20\x09-\x0D]+')) AS n,
    NOT regexp_matches(b, '@END@')
    OR 10 * length(regexp_replace(b, '[^#*$%&|<>]', '', 'g')) >= length(b)
    OR length(b) - length(replace(b, '|', '')) >= 3
    OR (length(b) - length(replace(b, ' > ', ''))) / 3 + (length(b) - length(replace(b, ' » ', ''))) / 3 >= 2
    OR (len(regexp_extract_all(b, '[^\x20\x09-\x0D]+')) <= @SHORT@
      AND (regexp_full_match(s, '@MENU@') OR regexp_full_match(s, '@PARTS@') OR regexp_full_match(s, '@BOILER@'))) AS failed
  FROM (SELECT *, rtrim(b, '@MARKS@') AS s FROM f)),
k AS (SELECT r, count(*) AS n_lines, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (failed) AS n_failed_lines, coalesce(sum(n) FILTER (NOT failed), 0) AS kept_words FROM j GROUP BY r),
a AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(kept_words, 0)::BIGINT AS kept_words
  FROM d LEFT JOIN n USING (r) LEFT JOIN p USING (r) LEFT JOIN k USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND 100 * kept_words >= 50 * n_words AS kept FROM b
"""
_menu, _boilerplate = quality.patterns()
for _name, _text in {"END": quality.LINE_END, "MENU": _menu, "PARTS": quality.PARTS, "BOILER": _boilerplate, "MARKS": quality.MARKS, "SHORT": str(quality.SHORT)}.items():
    QUALITY_SQL = QUALITY_SQL.replace(f"@{_name}@", _text.replace("'", "''"))

#: Exact search; the tree's relaxed pruning loses nothing on the test tables.
NEAREST_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20
"""

#: Key, prefix sum and water level are said here without buckets: whole windows by source.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    -ln((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
    / greatest(0.05, coalesce(pow(length(regexp_replace(text, '[#*$%&|<>]+', '', 'g'))::DOUBLE / nullif(length(text), 0), 8), 1.0)) AS k
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 1 THEN 3.0 WHEN 2 THEN 1.0 ELSE 2.0 END::DOUBLE AS w FROM s),
l AS (SELECT *, 2 * n / w AS ratio,
    ((SELECT sum(n) FROM w) * 1.5 - coalesce(sum(2 * n) OVER (ORDER BY 2 * n / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2 * n / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM w),
g AS (SELECT source, n, least(2 * n, w * (SELECT arg_min(lam, ratio * 1e6 + place) FROM l WHERE lam <= ratio)) AS target FROM l),
e AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS epochs FROM g),
r AS (SELECT d.*, e.n, e.target, e.epochs, e.target - e.epochs * e.n AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, target,
  (size * (epochs + CASE WHEN before + size / 2.0 <= budget AND n > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

#: Exact: all pairs that share a shingle, and components by recursion.
NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS node FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.node = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, d.doc_id = coalesce(m.c, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(node) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

#: Base32 is four letters for each five hexadecimal digits.
WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, upper(sha1(b)) AS x, last FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM h
"""

ORACLE_SQL: dict[str, str] = {"op3_nearest_vectors": NEAREST_SQL, "op10_near_duplicates": NEAR_SQL, "op2_clean_lines": QUALITY_SQL, "op7_warc_round_trip": WARC_SQL, "op5_mix_sources": MIX_SQL}
