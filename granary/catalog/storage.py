"""Scans and sinks, semi- and anti-joins, versions and changes of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog import sql as S
from granary.operators import storage as ST
from granary.registry import query
from granary.session import table
from granary.sources import adapters as A, files


# --- scans and sinks -----------------------------------------------------------------------------------------------
@query("scan_text", "SELECT page_id, html AS content FROM pages")
def scan_text(spark, sf_dir):
    """Pages written as text files, a line for each in as many files as there are tasks, and the files read whole again."""
    path = files.shared_path(spark, "pages")
    p = table(spark, sf_dir, "pages")
    coded = F.regexp_replace(F.base64(F.encode("html", "UTF-8")), r"\s", "")
    p.select(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce(coded, F.lit("-"))).alias("value")).write.text(path)
    lines = files.read_whole(spark, path).select(F.explode(F.split("content", "\n")).alias("line")).where("line <> ''").select(F.split("line", " ").alias("x"))
    return lines.select(F.col("x")[0].try_cast("long").alias("page_id"), F.when(F.col("x")[1] != "-", F.decode(F.unbase64(F.col("x")[1]), "UTF-8")).alias("content"))


@query("scan_dispatch", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'pdf' WHEN page_id % 4 IN (1, 2) THEN 'text' END AS strict, CASE WHEN page_id % 4 = 0 THEN 'pdf' ELSE 'text' END AS lax FROM pages")
def scan_dispatch(spark, sf_dir):
    ending = F.element_at(F.array(*map(F.lit, [".PDF", ".txt", ".md", ".docx"])), (F.col("page_id") % 4 + 1).cast("int"))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("url", ending).alias("name"))
    return p.select("page_id", files.document_type(F.col("name")).alias("strict"), files.document_type(F.col("name"), strict=False).alias("lax"))


@query("scan_json", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def scan_json(spark, sf_dir):
    """A table kept as one JSON array; it has a bounded number of rows, which the driver writes."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    text = rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "name")))).alias("j")).first().j
    return files.read_json_table(spark, files.put_text(spark, "kb.json", text), "id int, name string")


@query("scan_jsonl", "SELECT event_id, user_id, event_type FROM events")
def scan_jsonl(spark, sf_dir):
    path = files.shared_path(spark, "traces.jsonl")
    table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").write.json(path)
    return files.read_jsonl(spark, path, "event_id long, user_id long, event_type string")


@query("scan_csv", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS cost, o_orderstatus = 'F' AS passed FROM orders")
def scan_csv(spark, sf_dir):
    """Rows written with None for missing values and read back by a schema."""
    path = files.shared_path(spark, "race.csv")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("cost"), (F.col("o_orderstatus") == "F").alias("passed"))
    o.write.csv(path, header=True, nullValue="None")
    return files.read_csv(spark, path, "o_orderkey long, cost double, passed boolean")


@query("handoff_flatten", "SELECT conv_id AS case_id, turn, role AS source_agent, length(text) AS tokens FROM conversations")
def handoff_flatten(spark, sf_dir):
    """Cases with their handoffs nested, one row for each handoff."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(F.collect_list(F.struct("turn", F.col("role").alias("source_agent"), F.length("text").cast("long").alias("tokens"))).alias("h"))
    return c.select("case_id", F.explode("h").alias("h")).select("case_id", "h.turn", "h.source_agent", "h.tokens")


@query("report_scan", "SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey % 4 <> 1")
def report_scan(spark, sf_dir):
    """Reports in a folder: those that can't be read, or lack a date or a summary, are left out."""
    path = files.shared_path(spark, "reports")
    k = F.col("n_nationkey")
    text = F.when(k % 3 == 0, '{"broken').otherwise(F.to_json(F.struct(k.alias("id"), F.when(k % 4 != 1, F.lit("2024")).alias("created_at"), F.struct(F.lit(1).alias("n")).alias("summary"))))
    table(spark, sf_dir, "nation").repartition(5).select(text.alias("value")).write.text(path)
    reports = files.read_jsonl(spark, path, "id int, created_at string, summary struct<n:int>")
    return reports.where("created_at IS NOT NULL AND summary IS NOT NULL").select("id")


@query("byte_range", "SELECT doc_id, lower(substr(hex(encode(text)), 21, 40)) AS part FROM documents")
def byte_range(spark, sf_dir):
    """A range of bytes of all contents, in hexadecimal, as it may begin or end within a character."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.lower(F.hex(files.byte_slice(F.encode("text", "UTF-8"), 10, 20))).alias("part"))


_HEADER = "CASE doc_id % 5 WHEN 0 THEN 'bytes=10-29' WHEN 1 THEN 'bytes=40-' WHEN 2 THEN 'bytes=-19' WHEN 3 THEN 'bytes=5-' || CAST(doc_id % 7 * 200 AS VARCHAR(9)) ELSE 'bytes=' || CAST(doc_id AS VARCHAR(9)) || '-' END"


@query("byte_window", f"""WITH d AS (SELECT doc_id, hex(encode(text)) AS x, octet_length(encode(text)) AS size, {_HEADER} AS header FROM documents),
w AS (SELECT *, coalesce(try_cast(regexp_extract(header, '([0-9]*)-([0-9]*)', 1) AS BIGINT), 0) AS f, try_cast(regexp_extract(header, '([0-9]*)-([0-9]*)', 2) AS BIGINT) AS e FROM d),
v AS (SELECT *, coalesce(e, least(f + 1048575, size - 1)) AS l FROM w)
SELECT doc_id, CASE WHEN f >= size OR l >= size OR f > l THEN 416 ELSE 206 END AS status,
'bytes ' || CASE WHEN f >= size OR l >= size OR f > l THEN '*' ELSE f || '-' || l END || '/' || size AS content_range,
CASE WHEN NOT (f >= size OR l >= size OR f > l) THEN lower(substr(x, 2 * f + 1, 2 * (l - f + 1))) END AS part FROM v""")
def byte_window(spark, sf_dir):
    """What ranges of all contents are answered with: the part, or 416 where they lie outside."""
    w = table(spark, sf_dir, "documents").select("doc_id", files.byte_window(F.encode("text", "UTF-8"), F.expr(_HEADER)).alias("w")).select("doc_id", "w.*")
    shown = F.concat(F.lit("bytes "), F.coalesce(F.concat("start", F.lit("-"), "last"), F.lit("*")), F.lit("/"), F.col("size"))
    return w.select("doc_id", "status", shown.alias("content_range"), F.lower(F.hex("part")).alias("part"))


PICKED = [12, 3, 77, 45, 5, 8, 1, 30, 22, 19]


@query("pick_by_id_list", "SELECT item, doc_id, lang FROM (SELECT unnest([" + ", ".join(map(str, PICKED)) + "]) AS doc_id, generate_subscripts([" + ", ".join(map(str, PICKED)) + "], 1) AS item) JOIN documents USING (doc_id)")
def pick_by_id_list(spark, sf_dir):
    """Fixed ids in the order of their list."""
    ids = spark.createDataFrame([(i + 1, k) for i, k in enumerate(PICKED)], "item long, doc_id long")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(F.broadcast(ids), "doc_id")


# --- scopes and keys -----------------------------------------------------------------------------------------------
@query("chunks_of_doc", "SELECT doc_id, lang FROM documents WHERE doc_id = 17")
def chunks_of_doc(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id = 17").select("doc_id", "lang")


@query("kb_docs", "SELECT doc_id FROM documents WHERE source = 'src1' AND lang = 'en'")
def kb_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source = 'src1' AND lang = 'en'").select("doc_id")


@query("kb_scope_semi", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2'))")
def kb_scope_semi(spark, sf_dir):
    """Chunks whose document is in a knowledge base."""
    docs = table(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src2")).select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").select("vec_id").join(docs, "vec_id", "left_semi")


@query("kb_stats", f"SELECT kb, count(*) AS documents, CAST(sum({S.estimate('content')}) AS BIGINT) AS tokens, count(embedding) AS embedded FROM {S.CHUNKS} GROUP BY kb")
def kb_stats(spark, sf_dir):
    from granary.functions import text as T

    c = A.chunks(spark, sf_dir, embedded=True)
    return c.groupBy("kb").agg(F.count("*").alias("documents"), F.sum(T.token_estimate(F.col("content"))).alias("tokens"), F.count("embedding").alias("embedded"))


@query("merge_update", "SELECT doc_id, coalesce(label::VARCHAR, lang) AS lang FROM documents LEFT JOIN embeddings ON vec_id = doc_id AND vec_id % 2 = 0")
def merge_update(spark, sf_dir):
    new = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("lang"))
    return ST.merge_update(table(spark, sf_dir, "documents").select("doc_id", "lang"), new, "doc_id", "lang")


@query("fk_check", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)")
def fk_check(spark, sf_dir):
    """Rows whose parent isn't there."""
    parents = table(spark, sf_dir, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(parents, "o_custkey", "left_anti").select("o_orderkey")


@query("cascade_delete_anti", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))")
def cascade_delete_anti(spark, sf_dir):
    """What stays of the grandchildren when parents go."""
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return ST.delete_by_key(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), orders, "l_orderkey")


@query("dep_left_join", "SELECT l_orderkey, l_linenumber, coalesce(s_name, 'unknown (external)') AS dependency FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) ON s_suppkey = l_suppkey")
def dep_left_join(spark, sf_dir):
    """Dependencies of packages with what is known of them."""
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    used = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return used.join(known, "l_suppkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("s_name", F.lit("unknown (external)")).alias("dependency"))


@query("distinct_pages", "SELECT source, array_to_string(list_sort(list(DISTINCT doc_id % 10 + 1)), ',') AS pages FROM documents GROUP BY source")
def distinct_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_set(F.col("doc_id") % 10 + 1)).alias("p"))
    return d.select("source", F.concat_ws(",", F.col("p").cast("array<string>")).alias("pages"))


# --- versions and changes ------------------------------------------------------------------------------------------
@query("next_version", "SELECT c_custkey, coalesce(max(v), 0) + 1 AS next FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def next_version(spark, sf_dir):
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("v"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(v, "c_custkey", "left").select("c_custkey", (F.coalesce("v", F.lit(0)) + 1).alias("next"))


@query("latest_version", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_latest FROM orders")
def latest_version(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return ST.latest(o, "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "is_latest")


@query("upsert_last_wins", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'changed' ELSE lang END AS lang FROM documents UNION ALL SELECT doc_id + 100000000, 'new' FROM documents WHERE doc_id % 10 = 0")
def upsert_last_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(0).alias("seq"))
    changes = d.where("doc_id % 3 = 0").select("doc_id", F.lit("changed").alias("lang"), F.lit(1).alias("seq")).union(d.where("doc_id % 10 = 0").select(F.col("doc_id") + 100000000, F.lit("new"), F.lit(1)))
    return ST.upsert(d, changes, "doc_id", "seq").drop("seq")


@query("delete_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delete_anti(spark, sf_dir):
    return ST.delete_by_key(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("current_version_pick", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders) WHERE version = o_custkey % 3 + 1")
def current_version_pick(spark, sf_dir):
    """The version that its dataset names as the current one."""
    from pyspark.sql import Window

    v = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("version", v).where(F.col("version") == F.col("o_custkey") % 3 + 1).select("o_custkey", "o_orderkey")
