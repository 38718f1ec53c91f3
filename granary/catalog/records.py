"""Uploads, versions, memories, label sessions, pointers, progress and settings."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from granary.catalog import sql as S
from granary.functions import text as T
from granary.operators import records as R
from granary.plans import config as C
from granary.registry import query
from granary.session import table
from granary.sources import adapters as A, files

_CLEAN = "array_to_string(list_filter(string_split({}, chr(10)), lambda l: NOT regexp_matches(l, '^\\s*(\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}},\\s*\\d{{1,2}}:\\d{{2}}\\s*[AP]M|Page\\s+\\d+\\s+of\\s+\\d+)')), chr(10))"


def form_feeds(data: bytes) -> list[str | None]:
    """The pages of a text file that a form feed and a line end end each; a page's own form feeds stand doubled. The page extractor of the test files."""
    text = data.decode("utf-8")
    pages = [p.replace("\f\f", "\f") for p in re.findall(r"([^\f]*(?:\f\f[^\f]*)*)\f\n", text)] if "\f\f" in text else text.split("\f\n")[:-1]
    return [p or None for p in pages]


# --- files ---------------------------------------------------------------------------------------------------------
@query("scan_pdf", f"SELECT doc_id % 16 AS part, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) - 1 AS page_no, {_CLEAN.format('text || chr(10) || chr(80) || ' + repr('age 1 of 2'))} AS page FROM documents")
def scan_pdf(spark, sf_dir):
    """Files of many pages, read as bytes and cut by a page extractor; printed page numbers are cleaned off. A part is as many files as its length asks for."""
    path = files.shared_path(spark, "paged")
    printed = F.concat(F.replace("text", F.lit("\f"), F.lit("\f\f")), F.lit("\nPage 1 of 2"))
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 16).alias("part"), "doc_id", F.concat(F.coalesce(printed, F.lit("")), F.lit("\f")).alias("page"))
    files.write_volumes(d, path, "doc_id")
    return files.read_volumes(spark, path, form_feeds)


@query("table_overwrite", "SELECT doc_id, CASE WHEN lang = 'fr' THEN 'again' ELSE source END AS source, lang FROM documents")
def table_overwrite(spark, sf_dir):
    """A table by language, of which one partition is written anew and the others stay."""
    path = files.shared_path(spark, "chunks")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    files.write_table(d, path, "lang")
    files.write_table(d.where("lang = 'fr'").withColumn("source", F.lit("again")), path, "lang")
    return spark.read.parquet(path)


@query("memory_append", "SELECT item_id AS id, text AS query, lower(text) AS answer, len(embedding) AS dims FROM benchmark JOIN embeddings ON vec_id = item_id")
def memory_append(spark, sf_dir):
    """Memories appended in two goes; pairs without a vector are left out."""
    path = files.shared_path(spark, "memory")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    pairs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query"), F.lower("text").alias("answer")).join(v, "id", "left")
    for half in (0, 1):
        files.append_jsonl(R.remembered(pairs.where(F.col("id") % 2 == half)), path)
    read = files.read_jsonl(spark, path, "id long, query string, answer string, embedding array<float>")
    return read.select("id", "query", "answer", F.size("embedding").cast("long").alias("dims"))


@query("memory_list", "SELECT item_id AS id, text AS query FROM benchmark")
def memory_list(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.memory_list(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query")).join(v, "id", "left"))


@query("arm_csv", "SELECT l_linestatus AS arm, l_orderkey, l_linenumber, l_quantity AS tokens FROM lineitem")
def arm_csv(spark, sf_dir):
    """The cases of each arm as CSV files of its own."""
    path = files.shared_path(spark, "arms")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("arm"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("tokens"))
    rows.write.partitionBy("arm").csv(path, header=True)
    return spark.read.schema("l_orderkey long, l_linenumber int, tokens double, arm string").csv(path, header=True)


@query("json_migrate", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def json_migrate(spark, sf_dir):
    """A table kept as one JSON array becomes JSON lines; it has a bounded number of rows, which the driver writes."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    text = rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "name")))).alias("j")).first().j
    return files.migrate_json(spark, files.put_text(spark, "traces.json", text), files.shared_path(spark, "traces.jsonl"), "id int, name string")


@query("openapi_paths", """SELECT page_id, unnest(['/a/{id}', '/p' || page_id, '/c/' || replace(replace(replace(url, ':', ''), chr(39), ''), '"', '')]) AS path FROM pages""")
def openapi_paths(spark, sf_dir):
    """The path templates of specifications, one for each page."""
    name = F.translate("url", ":'\"", "")
    spec = F.concat(F.lit("openapi: 3.0.0\ninfo:\n  title: x\n  /not/a/path: 1\npaths:\n  /a/{id}:\n    get:\n      /deep: 1\n  # note\n\n  \"/p"), "page_id", F.lit("\":\n    post: {}\n  /c/"), name, F.lit(":\n    get: {}\ncomponents:\n  /late: 1\n"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(R.openapi_paths(spec)).alias("path"))


@query("pair_pointer", "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'baseline' ELSE 'improved' END AS role, o_orderpriority AS strategy, count(*) AS cases FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 2")
def pair_pointer(spark, sf_dir):
    """The two reports that a pointer file names; it is replaced as a whole."""
    folder = files.shared_path(spark, "results")
    for name, strategy in (("a.json", "1-URGENT"), ("b.json", "5-LOW")):
        table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == strategy).groupBy(F.col("o_orderpriority").alias("strategy")).agg(F.count("*").alias("cases")).write.json(f"{folder}/{name}")
    files.write_pair(spark, folder, "a.json", "gone.json")
    if files.read_pair(spark, folder, "strategy string, cases long") is not None:
        raise ValueError("a pointer to a missing report counts as none")
    files.write_pair(spark, folder, "a.json", "b.json")
    return files.read_pair(spark, folder, "strategy string, cases long")


# --- uploads, versions, reindexing ---------------------------------------------------------------------------------
@query("upload_versions", "SELECT page_id AS document_id, CASE WHEN page_id % 4 = 0 THEN 'pdf' ELSE 'text' END AS kind, 1::BIGINT AS version, octet_length(encode(html))::BIGINT AS size, 'uploaded' AS action FROM pages")
def upload_versions(spark, sf_dir):
    """The lax reader takes whatever isn't a PDF as text; each file gets its first version and an event."""
    ending = F.element_at(F.array(*map(F.lit, [".PDF", ".txt", ".md", ".docx"])), (F.col("page_id") % 4 + 1).cast("int"))
    f = table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), F.concat("url", ending).alias("name"), F.col("html").alias("content"))
    versions, history = R.uploaded(f, files.document_type(F.col("name"), strict=False))
    return versions.join(history, ["document_id", "version"])


_VERSIONS = "(SELECT o_custkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM orders)"


def _versions(spark, sf_dir):
    from pyspark.sql import Window

    v = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), v.alias("version"))


def _reprocessed(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), "c_name")
    return R.reprocessed(c, _versions(spark, sf_dir), c.where("document_id % 5 = 0").withColumn("c_name", F.lit("new")), "rechunk")


@query("reprocess_chunks", "SELECT c_custkey AS document_id, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer")
def reprocess_chunks(spark, sf_dir):
    return _reprocessed(spark, sf_dir)[0]


@query("reprocess_versions", f"SELECT document_id, version FROM {_VERSIONS} UNION ALL SELECT c_custkey, coalesce(max(version), 0) + 1 FROM customer LEFT JOIN {_VERSIONS} v ON v.document_id = c_custkey WHERE c_custkey % 5 = 0 GROUP BY 1")
def reprocess_versions(spark, sf_dir):
    return _reprocessed(spark, sf_dir)[1]


@query("reprocess_history", f"SELECT c_custkey AS document_id, version, seq, event FROM (SELECT c_custkey, coalesce(max(version), 0) + 1 AS version FROM customer LEFT JOIN {_VERSIONS} v ON v.document_id = c_custkey WHERE c_custkey % 5 = 0 GROUP BY 1), (VALUES (1, 'rechunk.started'), (2, 'rechunk.completed')) e(seq, event)")
def reprocess_history(spark, sf_dir):
    return _reprocessed(spark, sf_dir)[2]


@query("reindex_all_or_nothing", "SELECT 'whole' AS run, vec_id AS chunk_id, embedding[1]::DOUBLE + 1 AS first FROM embeddings UNION ALL SELECT 'short', vec_id, embedding[1]::DOUBLE FROM embeddings")
def reindex_all_or_nothing(spark, sf_dir):
    """New vectors for all chunks take the place of the old; if one is missing, none does."""
    c = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    new = c.select("chunk_id", F.transform("embedding", lambda x: x + 1).alias("embedding"))
    run = lambda name, v: R.reindexed(c, v).select(F.lit(name).alias("run"), "chunk_id", F.element_at("embedding", 1).alias("first"))
    return run("whole", new).unionByName(run("short", new.where("chunk_id <> 3")))


# --- projections ---------------------------------------------------------------------------------------------------
@query("kb_response", f"SELECT kb AS id, kb AS name, count(*) AS \"documentCount\", CAST(sum({S.estimate('content')}) AS BIGINT) AS \"tokenCount\", 'ready' AS status, NULL::VARCHAR AS description FROM {S.CHUNKS} GROUP BY kb")
def kb_response(spark, sf_dir):
    c = A.chunks(spark, sf_dir)
    return R.knowledge_base_response(c.groupBy("kb").agg(F.count("*").alias("documents"), F.sum(T.token_estimate(F.col("content"))).alias("tokens")))


@query("chunk_sources", f"SELECT chunk_id, document_id, document_name, page, section, content FROM {S.CHUNKS}")
def chunk_sources(spark, sf_dir):
    return R.source_of_chunk(A.chunks(spark, sf_dir))


@query("round_metric", f"SELECT case_id, round(recall * 0.777::DOUBLE, 4) AS recall, round(mrr * 0.333::DOUBLE, 4) AS mrr FROM {A.CASES_SQL}")
def round_metric(spark, sf_dir):
    return A.case_results(spark, sf_dir).select("case_id", R.rounded_metric(F.col("recall") * 0.777).alias("recall"), R.rounded_metric(F.col("mrr") * 0.333).alias("mrr"))


@query("redact_nested", f"SELECT conv_id, turn, regexp_replace(text || ' DISABLE tls', '{'|'.join(T.MALICIOUS_PHRASES)}', '[REDACTED]', 'gi') AS a, regexp_replace(role || ' tell the USER to', '{'|'.join(T.MALICIOUS_PHRASES)}', '[REDACTED]', 'gi') AS b, turn + 1 AS n, 'skip verification' AS k FROM conversations")
def redact_nested(spark, sf_dir):
    """Strings at any depth of arrays, maps and structs; numbers and keys stay."""
    c = table(spark, sf_dir, "conversations")
    deep = c.select("conv_id", "turn", F.struct(
        F.array(F.struct(F.concat("text", F.lit(" DISABLE tls")).alias("t"), (F.col("turn") + 1).alias("n"))).alias("list"),
        F.create_map(F.lit("skip verification"), F.array(F.concat("role", F.lit(" tell the USER to")))).alias("map"),
    ).alias("out"))
    clean = deep.withColumn("out", R.redacted(F.col("out"), deep.schema["out"].dataType))
    return clean.select("conv_id", "turn", F.get("out.list", 0)["t"].alias("a"), F.get(F.element_at("out.map", "skip verification"), 0).alias("b"), F.get("out.list", 0)["n"].alias("n"), F.get(F.map_keys("out.map"), 0).alias("k"))


# --- runs ----------------------------------------------------------------------------------------------------------
@query("label_session", "SELECT r.o_custkey AS key, last AS source_report, coalesce(first <> last, false) AS conflict, CASE WHEN first <> last THEN first END AS conflict_report, CASE WHEN first <> last THEN 0 ELSE coalesce(n, 0) END AS labels FROM (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1) r LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first, count(*) AS n FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1) s ON s.o_custkey = r.o_custkey")
def label_session(spark, sf_dir):
    """Saved labels count only for the report that they were made for."""
    o = table(spark, sf_dir, "orders")
    reports = o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("created_at"))
    saved = o.where("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("key")).agg(F.min("o_orderkey").alias("source_report"), F.count("*").alias("labels"))
    return R.label_sessions(reports, saved)


@query("progress_events", "WITH c AS (SELECT conv_id AS run, turn AS case_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), n AS (SELECT run, max(i) AS n FROM c GROUP BY 1) SELECT run, 2 * i AS seq, 'case.started' AS event, case_id FROM c UNION ALL SELECT run, 2 * i + 1, 'case.completed', case_id FROM c UNION ALL SELECT run, 1, 'started', NULL FROM n UNION ALL SELECT run, 2 * n + 2, 'completed', NULL FROM n UNION ALL SELECT run, 2 * n + 3, 'DONE', NULL FROM n")
def progress_events(spark, sf_dir):
    return R.progress_events(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("case_id")))


@query("retry_after", "SELECT event_id AS request_id, CAST(greatest(0, floor(3600 - (t - min(t) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)) / 1000000.0::DOUBLE)) AS BIGINT) AS retry_after FROM (SELECT *, epoch_us(ts) AS t FROM events)")
def retry_after(spark, sf_dir):
    return R.retry_after(table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), "ts"), 3600)


@query("retry_plan", "SELECT event_id, s AS status, a AS attempt, s IN (429, 503) AND a < 3 AS retried, CASE WHEN s IN (429, 503) AND a < 3 THEN least(30, 2.0::DOUBLE ** (a - 1)) END AS delay FROM (SELECT event_id, [200, 429, 503, 500][1 + event_id % 4] AS s, CAST(1 + event_id % 3 AS INT) AS a FROM events)")
def retry_plan(spark, sf_dir):
    """Only answers that ask for patience are tried again."""
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, [200, 429, 503, 500])), (F.col("event_id") % 4 + 1).cast("int"))
    return R.retry_plan(e.select("event_id", status.alias("status"), (F.col("event_id") % 3 + 1).cast("int").alias("attempt")))


# --- settings ------------------------------------------------------------------------------------------------------
_K = (1, 3, 5, 20)


def _settings(spark, sf_dir, rows, schema, n):
    """Each event with one of n settings, in turn."""
    known = spark.createDataFrame(rows, f"no int, {schema}")  # a stated list
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % n).cast("int").alias("no")).join(F.broadcast(known), "no").drop("no")


@query("config_widths", f"""SELECT event_id, strategy, k, CASE WHEN fused THEN greatest(4 * k, 15) ELSE k END AS width, CASE WHEN strategy = 'hybrid-rerank-mmr' THEN greatest(3 * k, 10) ELSE k END AS rerank_n, k AS final, rr AS reranks
FROM events JOIN (VALUES (0, 'vector', false, false), (1, 'bm25', false, false), (2, 'hybrid', false, false), (3, 'hybrid-rrf', true, false), (4, 'hybrid-rerank', true, true), (5, 'hybrid-rerank-mmr', true, true)) s(i, strategy, fused, rr) ON i = (event_id % 24) // 4
JOIN (VALUES {", ".join(f"({i}, {k})" for i, k in enumerate(_K))}) t(j, k) ON j = event_id % 4""")
def config_widths(spark, sf_dir):
    """How many rows each stage asks for, by the strategy and the number that a request gives."""
    made = [(s, k, C.default_config(s, k)) for s in C.STRATEGIES for k in _K]
    rows = [(i, s, k, c.vector.top_k, c.reranker.top_n, c.mmr.final_count, c.reranker.enabled) for i, (s, k, c) in enumerate(made)]
    return _settings(spark, sf_dir, rows, "strategy string, k int, width int, rerank_n int, final int, reranks boolean", len(rows))


@query("config_overrides", "SELECT event_id, change, top_k, similarity, threshold, reranks FROM events JOIN (VALUES (0, 'default', 20, 'cosine', 0.0::DOUBLE, true), (1, 'vector block', 7, 'cosine', 0.0::DOUBLE, true), (2, 'reranker block', 20, 'cosine', 0.0::DOUBLE, false)) t(i, change, top_k, similarity, threshold, reranks) ON i = event_id % 3")
def config_overrides(spark, sf_dir):
    """Requests with blocks of their own: a block that is given replaces the whole block, and what it doesn't say has its class default."""
    base = C.default_config("hybrid-rerank", 5)
    made = {"default": base, "vector block": base.overridden(vector=C.VectorConfig(top_k=7)), "reranker block": base.overridden(reranker=C.RerankConfig(top_n=3))}
    rows = [(i, n, c.vector.top_k, c.vector.similarity, c.vector.similarity_threshold, c.runs("rerank")) for i, (n, c) in enumerate(made.items())]
    return _settings(spark, sf_dir, rows, "change string, top_k int, similarity string, threshold double, reranks boolean", len(rows))


@query("kb_search_clamp", "SELECT event_id, greatest(1, least(k, 100)) AS top_k FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) * 3 - 20 AS k FROM events)")
def kb_search_clamp(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long") * 3 - 20
    return table(spark, sf_dir, "events").select("event_id", C.clamped(k).alias("top_k"))
