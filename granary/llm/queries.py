"""The registered queries of this subpackage, each its operator over its whole table, and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, decontaminate, jaccard, matroska, mixing, pii, quality, resample, scoring, search, tokens, toxicity, warc, wrappers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op1_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_features(matroska.media_column(table(spark, sf_dir, "documents")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's setting; without one a published key that is for tests alone."""
    key = spark.conf.get("spark.granary.pseudonym.key", None) or "published key for tests"
    return pii.pseudonymize(table(spark, sf_dir, "documents"), key.encode())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_scoring": op1_scoring,
    "op2_mixing": op2_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_tokens": op4_tokens,
    "op5_jaccard": op5_jaccard,
    "op6_html": op6_html,
    "op7_matroska": op7_matroska,
    "op8_warc": op8_warc,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
    "op11_toxicity": op11_toxicity,
    "op12_resampling": op12_resampling,
    "op13_search": op13_search,
}

#: base32 of a hex SHA-1: each five hex digits are four letters.
_BASE32 = """list_aggregate(list_transform(range(8), lambda k: list_aggregate(list_transform([32768, 1024, 32, 1], lambda d:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || substr(h, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT) // d) % 32, 1)), 'string_agg', '')), 'string_agg', '')"""

#: crc32 of a text's UTF-8 bytes, byte by byte through the table of its polynomial.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END))"
_CRC = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(hex(f)) // 2), lambda i: CAST('0x' || substr(hex(f), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) + 1 AS BIGINT)])))"

ORACLES: dict[str, str] = {
    "op2_mixing": """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3]::DOUBLE AS weight FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, ((SELECT sum(source_size) * 1.5::DOUBLE FROM r) - coalesce(sum(cap) OVER o, 0)) / ((SELECT sum(weight) FROM r) - coalesce(sum(weight) OVER o, 0)) AS level
  FROM r WINDOW o AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source IS NULL, source LIMIT 1),
t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM f), 'infinity'::DOUBLE)) AS target FROM l),
q AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY substr(md5('20240101:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15), doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(2 * size, greatest(0, least(size, floor(target) - before)) + greatest(0, least(size, floor(target) - source_size - before))) AS BIGINT) AS taken,
  CASE WHEN target > 0 THEN CAST(before + size AS DOUBLE) / target END AS finish FROM q""",
    "op3_decontamination": """
WITH i AS (SELECT item_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS t FROM benchmark),
d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS t FROM documents),
r AS (SELECT DISTINCT least(len(t), 5) AS k FROM i WHERE len(t) > 0),
b AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(t) - least(len(t), 5) + 2), lambda j: array_to_string(t[j:j + least(len(t), 5) - 1], ' '))) AS g FROM i WHERE len(t) > 0),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(t) - k + 2), lambda j: array_to_string(t[j:j + k - 1], ' '))) AS g FROM d, r WHERE len(t) >= k),
n AS (SELECT id, count(*) AS n_shingles FROM b GROUP BY id),
m AS (SELECT s.id AS doc_id, b.id AS item_id, count(*) AS n_found FROM s JOIN b ON s.g = b.g GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM m JOIN n ON n.id = item_id WHERE n_found / n_shingles >= 0.75""",
    "op5_jaccard": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
  ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 75 * (n + m - shared)),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.node = l.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)""",
    "op8_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM f""",
    "op12_resampling": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
e AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
a AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
c AS (SELECT f, {_CRC} % 10000 AS bucket FROM (SELECT f FROM e UNION SELECT f FROM a), (SELECT {_CRC_TABLE} AS t)),
s AS (SELECT bucket, count(*) AS n FROM e JOIN c USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM a JOIN c USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM e) + 10000)::DOUBLE) / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM a) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT r, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM e JOIN c USING (f) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT d.r, doc_id, len(w) >= 20 AS eligible, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
y AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS place FROM x)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN eligible AND place <= 25 * (SELECT count(*) FROM x WHERE eligible) // 100 THEN CAST(place AS BIGINT) END AS rank FROM y""",
    "op13_search": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM benchmark),
c AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(t)) AS BIGINT) AS big_l FROM d WHERE len(t) > 0),
a AS (SELECT q, item_id, term, count(*) AS qtf FROM (SELECT q, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) SEMI JOIN a USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, c GROUP BY term, big_n),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM p JOIN a USING (term) JOIN w USING (term), c GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20""",
}
