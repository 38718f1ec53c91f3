"""Pieces of DuckDB SQL that several oracles share."""

from granary.functions.text import QUERY_STOPWORDS


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tok(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '\\s+'), lambda w: w <> '')"


def estimate(x: str) -> str:
    return f"CAST(CASE WHEN {x} IS NULL OR {x} = '' THEN 0 ELSE greatest(1, trunc(len({words(x)}) / 0.75::DOUBLE)) END AS BIGINT)"


def terms(x: str) -> str:
    """Tokens without stopwords, or all."""
    kept = f"list_filter({tok(x)}, lambda w: w NOT IN ({quoted(QUERY_STOPWORDS)}))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {tok(x)} END"


def longest(x: str, n: int = 3) -> str:
    return f"list_transform(list_slice(list_sort(list_transform(list_distinct({tok(x)}), lambda t: {{'n': -length(t), 't': t}})), 1, {n}), lambda s: s.t)"


CHUNKS = """(SELECT doc_id AS chunk_id, doc_id AS document_id, 'doc' || doc_id || '.md' AS document_name, text AS content, doc_id % 10 + 1 AS page, lang AS section, source AS kb, doc_id AS pos,
  embedding::DOUBLE[] AS embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""
QUESTION_VECTORS = "(SELECT item_id AS query_id, embedding::DOUBLE[] AS qv FROM benchmark JOIN embeddings ON vec_id = item_id)"


def vector_ctes(k: int, metric: str = "cosine", where: str = "score >= 0", name: str = "vec", extra: str = "") -> str:
    """A CTE with the first k chunks by vector of every question."""
    score = {"cosine": "list_cosine_similarity(qv, embedding)", "dot": "list_dot_product(qv, embedding)", "l2": "-list_distance(qv, embedding)"}[metric]
    return f"""{name}_s AS (SELECT query_id, chunk_id, pos, round({score}, 6) AS score FROM {QUESTION_VECTORS} q, {CHUNKS} c WHERE embedding IS NOT NULL AND len(embedding) > 0 {extra}),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM {name}_s WHERE {where} QUALIFY rank <= {k})"""


def bm25_ctes(k: int | None, name: str = "bm", query_sql: str | None = None, keywords: bool = False, kind: str = "standard") -> str:
    """A CTE with the first k chunks by BM25 of every question."""
    query_sql = query_sql or "SELECT item_id AS query_id, text AS query FROM benchmark"
    own = tok("text")
    if keywords:
        key = f"flatten(list_transform({longest('text')}, lambda w: {tok('w')}))"
        own = f"list_concat({own}, {key}, {key}, {key})"
    cut = "" if k is None else f"QUALIFY rank <= {k}"
    return f"""{name}_q AS (SELECT query_id, tok, count(*) AS qtf FROM (SELECT query_id, unnest({terms('query')}) AS tok FROM ({query_sql})) GROUP BY ALL),
{name}_d AS (SELECT doc_id AS chunk_id, doc_id AS pos, {own} AS t FROM documents),
{name}_n AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM {name}_d),
{name}_t AS (SELECT chunk_id, pos, dl, tok, count(*) AS tf FROM (SELECT chunk_id, pos, len(t) AS dl, unnest(t) AS tok FROM {name}_d) GROUP BY ALL),
{name}_f AS (SELECT tok, count(*) AS df FROM {name}_t GROUP BY tok),
{name}_s AS (SELECT query_id, chunk_id, pos, round(sum(qtf * (ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM {name}_t JOIN {name}_q USING (tok) JOIN {name}_f USING (tok), {name}_n GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM {name}_s WHERE score > 0 {cut})"""


def rrf_cte(vec: str, bm: str, name: str = "rrf", vw: float = 1.0, bw: float = 1.0, k: int = 60) -> str:
    return f"""{name}_u AS (SELECT query_id, chunk_id, pos, {vw}::DOUBLE / ({k} + rank) AS part, rank AS vr, NULL::BIGINT AS br FROM {vec}
  UNION ALL SELECT query_id, chunk_id, pos, {bw}::DOUBLE / ({k} + rank), NULL, rank FROM {bm}),
{name}_g AS (SELECT query_id, chunk_id, pos, round(sum(part), 9) AS score, max(vr) AS vr, max(br) AS br FROM {name}_u GROUP BY ALL),
{name} AS (SELECT query_id, chunk_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(vr, 1000000000), br) AS rank FROM {name}_g)"""


def interleave_cte(vec: str, bm: str, k: int, name: str = "mix") -> str:
    return f"""{name}_u AS (SELECT query_id, chunk_id, pos, score, 2 * rank AS place FROM {vec} UNION ALL SELECT query_id, chunk_id, pos, score, 2 * rank + 1 FROM {bm}),
{name}_g AS (SELECT query_id, chunk_id, pos, arg_min(score, place) AS score, min(place) AS place FROM {name}_u GROUP BY ALL),
{name} AS (SELECT query_id, chunk_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM {name}_g QUALIFY rank <= {k})"""


def rerank_cte(source: str, candidates: int, n: int, name: str = "rer") -> str:
    return f"""{name}_s AS (SELECT r.query_id, r.chunk_id, r.pos, r.rank AS before, round(CASE WHEN len(list_distinct({terms('b.text')})) = 0 THEN 0
  ELSE len(list_intersect(list_distinct({terms('b.text')}), list_distinct({tok('d.text')}))) / len(list_distinct({terms('b.text')})) END, 9) AS score
  FROM {source} r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d ON d.doc_id = r.chunk_id WHERE r.rank <= {candidates}),
{name} AS (SELECT query_id, chunk_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM {name}_s QUALIFY rank <= {n})"""


def mmr_ctes(source: str, candidates: int, final: int, weight: float = 0.7, name: str = "mmr") -> str:
    """CTEs (recursive) with all candidates; rank 0 for those that weren't chosen."""
    return f"""{name}_m AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM {source} WHERE rank <= {candidates}),
{name}_c AS (SELECT m.query_id, m.chunk_id, m.pos, m.rank AS r, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END AS rel, embedding::DOUBLE[] AS v FROM {name}_m m LEFT JOIN embeddings ON vec_id = m.chunk_id),
{name}_p AS (SELECT a.query_id, a.r AS i, b.r AS j, coalesce(list_cosine_similarity(a.v, b.v), 0) AS sim FROM {name}_c a JOIN {name}_c b USING (query_id)),
{name}_r(query_id, n, chosen, pick, val) AS (
  SELECT DISTINCT query_id, 0::BIGINT, []::BIGINT[], 0::BIGINT, 0::DOUBLE FROM {name}_c
  UNION ALL
  SELECT query_id, n, chosen, pick, v2 FROM (SELECT s.query_id, s.n + 1 AS n, list_append(s.chosen, c.r) AS chosen, c.r AS pick,
    round({weight}::DOUBLE * c.rel - {1 - weight}::DOUBLE * greatest(0, coalesce((SELECT max(sim) FROM {name}_p p WHERE p.query_id = c.query_id AND p.i = c.r AND list_contains(s.chosen, p.j)), 0)), 6) AS v2
    FROM {name}_r s JOIN {name}_c c ON s.query_id = c.query_id AND NOT list_contains(s.chosen, c.r) WHERE s.n < {final}
    QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY v2 DESC, c.r) = 1)),
{name}_last AS (SELECT query_id, arg_max(chosen, n) AS chosen FROM {name}_r GROUP BY query_id),
{name} AS (SELECT c.query_id, c.chunk_id, c.pos, s.val AS score, s.n AS rank, true AS selected, round(c.rel, 6) AS relevance FROM {name}_r s JOIN {name}_c c ON c.query_id = s.query_id AND c.r = s.pick WHERE s.n > 0
  UNION ALL SELECT c.query_id, c.chunk_id, c.pos, round({weight}::DOUBLE * c.rel - {1 - weight}::DOUBLE * greatest(0, coalesce((SELECT max(sim) FROM {name}_p p WHERE p.query_id = c.query_id AND p.i = c.r AND list_contains(l.chosen, p.j)), 0)), 6), 0, false, round(c.rel, 6)
  FROM {name}_c c JOIN {name}_last l USING (query_id) WHERE NOT list_contains(l.chosen, c.r))"""
