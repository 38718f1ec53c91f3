"""Cleaning, headings, sections, chunks, keywords and scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog import sql as S
from granary.functions import text as T
from granary.operators import ingest as I
from granary.registry import query
from granary.session import table, text_table

# Lines that the tables don't have: printed headers, headings, bullets, endpoints and the like.
LINES = [
    "1/2/2024, 3:04 PM Guide", "  Page 3 of 9 https://x", "Plain words here", "# Title", "###### Deep title", "Summary", "Job", "Getting Started", "class Foo bar",
    "Ends with colon:", "lower case start", "A" + "b" * 70, "", "  Two  words  ", "Éclair Time", "#NoBlank", "Case closed",
]
def docs(spark, sf_dir):
    return text_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))


def _lines(spark, sf_dir):
    """doc_id, no, line of all documents, each with one of LINES after its text."""
    planted = F.element_at(F.array(*(F.lit(t) for t in LINES)), (F.col("doc_id") % len(LINES) + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.concat_ws("\n", "content", planted), "\n")).alias("no", "line"))


#: _lines() in DuckDB.
_LINES = "(SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS no FROM (SELECT doc_id, string_split(text || chr(10) || list_extract([" + ", ".join(f"'{t}'" for t in LINES) + f"], CAST(doc_id % {len(LINES)} + 1 AS BIGINT)), chr(10)) AS l FROM documents))"


_HEADING = """(regexp_matches(l, '^#{1,6}\\s+.') OR (length(l) BETWEEN 1 AND 60 AND regexp_matches(l, '^\\p{Lu}') AND NOT regexp_matches(l, '[.:,;]$') AND (regexp_matches(l, '\\s') OR lower(l) IN (""" + S.quoted(T.SECTION_WORDS) + """))
  AND NOT regexp_matches(lower(l), '^(""" + "|".join(T.CODE_PREFIXES) + """)')))"""
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_HEADINGS = f"""h AS (SELECT doc_id, CAST(start AS INT) AS start, CASE WHEN regexp_matches(l, '^#{{1,6}}\\s+.') THEN trim(regexp_extract(l, '^#{{1,6}}\\s+(.+)$', 1)) ELSE l END AS heading FROM (
  SELECT doc_id, {_STRIP.format('line')} AS l, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE {_HEADING})"""


@query("clean_page", "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^\\s*(\\d{1,2}/\\d{1,2}/\\d{2,4},\\s*\\d{1,2}:\\d{2}\\s*[AP]M|Page\\s+\\d+\\s+of\\s+\\d+)')), chr(10)) AS text FROM documents")
def clean_page(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.clean_page(F.col("content")).alias("text"))


@query("norm_ws", "SELECT doc_id, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) AS text FROM documents")
def norm_ws(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.normalize_space(F.col("content")).alias("text"))


@query("heading_flag", f"SELECT doc_id, CAST(no AS INT) AS no, {_HEADING} AS heading FROM (SELECT doc_id, no, {_STRIP.format('line')} AS l FROM {_LINES})")
def heading_flag(spark, sf_dir):
    """Which lines are headings, of all documents and of lines planted among them."""
    return _lines(spark, sf_dir).select("doc_id", "no", T.looks_like_heading(F.col("line")).alias("heading"))


@query("headings", f"WITH {_HEADINGS} SELECT * FROM h")
def headings(spark, sf_dir):
    return I.headings(docs(spark, sf_dir))


_RAW = f"""WITH {_HEADINGS}, c AS (SELECT doc_id, start, heading FROM h UNION ALL SELECT doc_id, 0, NULL FROM documents WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = documents.doc_id AND h.start = 0)),
s AS (SELECT doc_id, start, heading, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS stop, count(*) OVER (PARTITION BY doc_id) AS n FROM c),
r AS (SELECT doc_id, start, heading AS section, substr(text, start + 1, coalesce(stop, length(text)) - start) AS text, n FROM s JOIN documents USING (doc_id))
SELECT doc_id, start, section, text FROM r WHERE NOT regexp_matches(text, '^\\s*$') OR (section IS NULL AND n = 1)"""


@query("sections_raw", _RAW)
def sections_raw(spark, sf_dir):
    return I.raw_sections(docs(spark, sf_dir))


@query("sections")
def sections(spark, sf_dir):
    """Compared with a plain model in the tests."""
    return I.sections(docs(spark, sf_dir))


#: Documents hold no bullets, so some sentence ends and blanks become bullets.
_ITEMS = "(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, '. ', ' • ') WHEN 2 THEN replace(text, ',', ' ‣ ∙ ') || ' ●' ELSE '▪' || replace(text, chr(10), '▪') END AS line FROM documents)"


@query("bullet_items", f"SELECT doc_id, CAST(start AS INT) AS start, item FROM (SELECT doc_id, item, coalesce(sum(length(item) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, n FROM (SELECT doc_id, unnest(regexp_split_to_array(line, '[•●▪‣∙]')) AS item, generate_subscripts(regexp_split_to_array(line, '[•●▪‣∙]'), 1) AS i, len(regexp_split_to_array(line, '[•●▪‣∙]')) AS n FROM {_ITEMS})) WHERE n = 1 OR NOT regexp_matches(item, '^\\s*$')")
def bullet_items(spark, sf_dir):
    """Items of all documents, in whose texts bullets have been planted."""
    i, t = F.col("doc_id") % 4, F.col("content")
    put = lambda old, new: F.replace(t, F.lit(old), F.lit(new))
    line = F.when(i == 0, t).when(i == 1, put(". ", " • ")).when(i == 2, F.concat(put(",", " ‣ ∙ "), F.lit(" ●"))).otherwise(F.concat(F.lit("▪"), put("\n", "▪")))
    return docs(spark, sf_dir).select("doc_id", F.explode(I.bullet_items(line)).alias("i")).select("doc_id", "i.start", "i.item")


def _pieces_sql() -> str:
    def step(prev: str, name: str, sep: str, width: int) -> str:
        parts = f"CASE WHEN length(t) > 512 THEN string_split(t, {sep}) ELSE [t] END"
        return f"""{name} AS (SELECT doc_id, start + before AS start, p AS t FROM (SELECT doc_id, start, p, i, coalesce(sum(length(p) + {width}) OVER (PARTITION BY doc_id, start ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT doc_id, start, unnest({parts}) AS p, generate_subscripts({parts}, 1) AS i FROM {prev})) WHERE p <> '')"""

    return f"WITH a0 AS (SELECT doc_id, 0 AS start, text AS t FROM documents), {step('a0', 'a1', 'chr(10) || chr(10)', 2)}, {step('a1', 'a2', 'chr(10)', 1)}, {step('a2', 'a3', chr(39) + ' ' + chr(39), 1)}, {step('a3', 'a4', chr(39) * 2, 0)} SELECT doc_id, CAST(start AS INT) AS start, t AS piece FROM a4"


@query("atomic_pieces", _pieces_sql())
def atomic_pieces(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(I.atomic_pieces(F.col("content"))).alias("p")).select("doc_id", "p.start", F.col("p.t").alias("piece"))


def _chunks(spark, sf_dir, overlap):
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(I.chunk_text(F.col("content"), I.CHUNK_SIZE, overlap)).alias("chunk_no", "c"))
    return rows.select("doc_id", "chunk_no", "c.t", "c.start", "c.end")


@query("chunk_text")
def chunk_text(spark, sf_dir):
    """Compared with a plain model in the tests."""
    return _chunks(spark, sf_dir, I.OVERLAP)


@query("chunk_text_no_overlap")
def chunk_text_no_overlap(spark, sf_dir):
    return _chunks(spark, sf_dir, 0)


@query("ingest_chunks")
def ingest_chunks(spark, sf_dir):
    """The whole way from documents to chunks, each line a page; compared with a plain model in the tests."""
    return I.ingest_chunks(docs(spark, sf_dir).withColumn("pages", F.split("content", "\n")))


@query("ingest_doc_summary")
def ingest_doc_summary(spark, sf_dir):
    d = docs(spark, sf_dir)
    return I.document_summary(d, I.ingest_chunks(d))


@query("page_for_span", """WITH s AS (SELECT event_id, CAST(user_id * 7 AS INT) AS a, CAST(user_id * 7 + event_id % 60 AS INT) AS b FROM events), p AS (SELECT i AS page, i * 90 - 90 AS x, i * 90 - 5 AS y FROM range(1, 13) t(i))
SELECT event_id, CAST(arg_max(page, o * 100 - page) AS BIGINT) AS page FROM (SELECT event_id, page, greatest(-1, least(b, y) - greatest(a, x)) AS o FROM s, p) GROUP BY event_id""")
def page_for_span(spark, sf_dir):
    bounds = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.struct((i * 90 - 90).alias("start"), (i * 90 - 5).alias("end"), i.alias("page")))
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 7).cast("int").alias("a"), (F.col("user_id") * 7 + F.col("event_id") % 60).cast("int").alias("b"))
    return e.select("event_id", I.page_for_span(F.col("a"), F.col("b"), bounds).cast("long").alias("page"))


@query("pages_of_spans", """WITH d AS (SELECT doc_id, length(text) AS n FROM documents), s AS (SELECT doc_id, unnest(range(0, n // 700 + 1)) AS k FROM d), p AS (SELECT doc_id, unnest(range(0, (n + 999) // 1000)) AS i FROM d WHERE doc_id % 7 <> 0),
m AS (SELECT doc_id, k, arg_max(i + 1, o * 1000000 - i) AS page FROM (SELECT s.doc_id, k, i, greatest(-1, least(k * 700 + 640, i * 1000 + 999) - greatest(k * 700, i * 1000)) AS o FROM s JOIN p ON p.doc_id = s.doc_id) GROUP BY 1, 2)
SELECT s.doc_id, s.k AS span_id, CAST(coalesce(page, 1) AS BIGINT) AS page FROM s LEFT JOIN m ON m.doc_id = s.doc_id AND m.k = s.k""")
def pages_of_spans(spark, sf_dir):
    """Windows of all documents by the page that they overlap most; some documents have no pages."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    s = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 700).cast("int"))).alias("span_id")).withColumns({"start": F.col("span_id") * 700, "end": F.col("span_id") * 700 + 640})
    p = d.where((F.col("doc_id") % 7 != 0) & (F.col("n") > 0)).select("doc_id", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / 1000).cast("int"))).alias("page"))
    return I.pages_of_spans(s, p.withColumns({"start": F.col("page") * 1000 - 1000, "end": F.col("page") * 1000 - 1})).withColumn("span_id", F.col("span_id").cast("long"))


_FIT = f"""WITH t AS (SELECT source AS doc_id, doc_id AS chunk_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{3,}}'), lambda w: w NOT IN ({S.quoted(I.KEYWORD_STOPWORDS)}))) AS tok FROM documents),
tf AS (SELECT doc_id, chunk_id, tok, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT doc_id, tok, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY ALL),
k AS (SELECT * FROM df QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cf DESC, tok) <= 500), n AS (SELECT source AS doc_id, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT tf.doc_id, chunk_id, tf.tok, round(tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1), 9) AS w FROM tf JOIN k ON tf.doc_id = k.doc_id AND tf.tok = k.tok JOIN n ON n.doc_id = tf.doc_id WHERE NOT regexp_matches(tf.tok, '^[\\d.,%/-]+$'))
SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY w DESC, tok) AS rank, tok AS keyword FROM w QUALIFY rank <= 8"""


@query("tfidf_keywords", _FIT)
def tfidf_keywords(spark, sf_dir):
    """Sources stand for documents and their documents for chunks."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return I.tfidf_keywords(d)


@query("clean_keyword", f"SELECT p_partkey, CASE WHEN length(k) >= 2 THEN k END AS keyword FROM (SELECT p_partkey, {_STRIP.format(chr(34).join(['regexp_replace(p_name || ' + chr(39) + ' ’x', chr(39) + ', ' + chr(39) + '[‘’“”' , ']' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')']))} AS k FROM part)")
def clean_keyword(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.clean_keyword(F.concat("p_name", F.lit(" ’x\""))).alias("keyword"))


@query("source_blocks", "SELECT conv_id, turn, unnest(b) AS block, generate_subscripts(b, 1) AS block_no FROM (SELECT conv_id, turn, regexp_extract_all('<x><source id=\"1\">' || text || '</source> t ' || '<source id=\"22\">' || role || chr(10) || '</source>', '(?s)<source id=\"\\d+\">.*?</source>') AS b FROM conversations)")
def source_blocks(spark, sf_dir):
    made = F.concat(F.lit('<x><source id="1">'), "text", F.lit("</source> t "), F.lit('<source id="22">'), "role", F.lit("\n</source>"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(I.source_blocks(made)).alias("block_no", "block"))
    return rows.withColumn("block_no", (F.col("block_no") + 1).cast("long"))


@query("reprocess_replace", "SELECT doc_id, text, lang, 'old' AS version FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'again: ' || text, lang, 'new' FROM documents WHERE doc_id % 7 = 0")
def reprocess_replace(spark, sf_dir):
    """Chunks of reprocessed documents take the place of the old ones; others stay."""
    from granary.operators.storage import replace_by_key

    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.lit("old").alias("version"))
    new = d.where("doc_id % 7 = 0").select("doc_id", F.concat(F.lit("again: "), "text").alias("text"), "lang", F.lit("new").alias("version"))
    return replace_by_key(d, new, "doc_id")


# --- scalar functions ----------------------------------------------------------------------------------------------
@query("tokenize_standard", f"SELECT doc_id, array_to_string({S.tok('text')}, ' ') AS tokens FROM documents")
def tokenize_standard(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.tokens(F.col("content")), " ").alias("tokens"))


@query("tokenize_porter")
def tokenize_porter(spark, sf_dir):
    """Stems of all words by their times; compared with the published algorithm's pairs in the tests."""
    t = text_table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"), "porter")).alias("tok"))
    return t.groupBy("tok").agg(F.count("*").alias("n"))


@query("tokenize_whitespace", f"SELECT doc_id, array_to_string({S.words('lower(text)')}, ' ') AS tokens FROM documents")
def tokenize_whitespace(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.tokens(F.col("content"), "whitespace"), " ").alias("tokens"))


@query("token_estimate", f"SELECT doc_id, {S.estimate('text')} AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.token_estimate(F.col("content")).alias("tokens"))


@query("truncate_tokens", f"SELECT doc_id, CASE WHEN {S.estimate('text')} <= 50 THEN text ELSE array_to_string(list_slice({S.words('text')}, 1, 37), ' ') || chr(10) || chr(10) || '[Context truncated due to token limit]' END AS text FROM documents")
def truncate_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.truncate_tokens(F.col("content"), F.lit(50)).alias("text"))


@query("doc_key", "SELECT page_id, regexp_replace(trim(lower(url || '.PDF ')), '\\.(pdf|md|txt|docx|doc)$', '') AS key, regexp_replace(regexp_replace(lower(url || '.tar.gz'), '^.*/', ''), '(.)\\.[^.]*$', '\\1') AS stem FROM pages")
def doc_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.document_key(F.concat("url", F.lit(".PDF "))).alias("key"), T.document_stem(F.concat("url", F.lit(".tar.gz"))).alias("stem"))
