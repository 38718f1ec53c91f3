"""Checks of answers against known endpoints, deprecations and guardrails; parsers of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.functions import text as T
from granary.session import bounded_broadcast
from granary.sources.tables import written

TOOLS = ["retrieve", "check_deprecation", "answer", "finish"]
SPECIALISTS = ["version_deprecation", "code_sample"]


#: Stands for a parameter in the key of a template; no path holds it.
_ANY = "\u0000"


def path_pattern(template: Column) -> Column:
    """A path template as a pattern: {name} stands for anything but slashes and white space."""
    escaped = F.regexp_replace(template, r"([\\.\[\]^$*+?()|\-])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(escaped, r"\{[^}]+\}", r"[^/\\s]+"), F.lit("$"))


def _segments(path: Column) -> Column:
    return F.split(path, "/")


def _key(path: Column, mask: Column) -> Column:
    """A path with _ANY in the segments that a mask marks."""
    return F.array_join(F.transform(_segments(path), lambda s, i: F.when(F.get(mask, i), F.lit(_ANY)).otherwise(s)), "/")


def template_index(templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of templates(path): shapes(n, mask), the distinct numbers of segments and places of parameters; and entries(key, path, pattern), whose pattern is null where the key decides.

    A template is found by its key, its literal segments with a mark for the others, so a path meets it by an equi-join
    once for each shape of as many segments. A segment that is a parameter only in part is marked too, and decided by the pattern.
    """
    mask = F.transform(_segments(F.col("path")), lambda s: s.rlike(r"\{[^}]+\}"))
    part = F.exists(_segments(F.col("path")), lambda s: s.rlike(r"\{[^}]+\}") & ~s.rlike(r"^\{[^}]+\}$"))
    known = templates.select("path", mask.alias("mask")).where("path IS NOT NULL").distinct()
    entries = known.select(_key(F.col("path"), F.col("mask")).alias("key"), "path", F.when(part, path_pattern(F.col("path"))).alias("pattern"))
    return known.select(F.size("mask").alias("n"), "mask").distinct(), entries


def unknown_endpoints(answers: DataFrame, templates: DataFrame) -> DataFrame:
    """case_id, endpoint: path-like tokens of answers(case_id, answer) that no template(path) matches. Each distinct token is looked up once."""
    tokens = answers.select("case_id", F.explode(F.array_distinct(T.endpoint_tokens(F.col("answer")))).alias("endpoint"))
    shapes, entries = template_index(templates)
    each = tokens.select("endpoint").distinct().withColumn("n", F.size(_segments(F.col("endpoint"))))
    keyed = each.join(bounded_broadcast(shapes), "n").select("endpoint", _key(F.col("endpoint"), F.col("mask")).alias("key"))
    met = keyed.join(bounded_broadcast(entries), "key").where(F.col("pattern").isNull() | F.expr("endpoint rlike pattern"))
    return tokens.join(met.select("endpoint").distinct(), "endpoint", "left_anti").select("case_id", "endpoint")


def phrase_hits(texts: DataFrame, phrases: DataFrame, text: str = "text", hits: str = "hits") -> DataFrame:
    """Adds hits, the ascending numbers of phrases(phrase_no, phrase, whole) that a text holds; whole ones only as words of their own.

    One automaton of all phrases goes to every task, which reads a text once, whatever the number of phrases: MOST_PHRASES
    at most are searched at a time, more of them in as many passes. Phrases are compared as they are; lower-case both
    sides for a search that ignores case. Null texts and empty phrases hit nothing.
    """
    known = phrases.select(F.col("phrase_no").cast("int").alias("phrase_no"), "phrase", F.col("whole").cast("boolean").alias("whole")).where("phrase IS NOT NULL AND phrase <> ''")
    rows = known.limit(MOST_PHRASES + 1).collect()
    parts = [rows]
    if len(rows) > MOST_PHRASES:
        n = -(-2 * known.count() // MOST_PHRASES)
        parts = [known.where(F.pmod(F.xxhash64("phrase_no"), F.lit(n)) == i).collect() for i in range(n)]
    out = texts.withColumn(hits, F.array().cast("array<int>"))
    for part in parts:
        if part:
            out = _hits(out, part, text, hits)
    return out


#: Phrases that one automaton holds at most.
MOST_PHRASES = 500_000


def _hits(texts: DataFrame, phrases: list, text: str, hits: str) -> DataFrame:
    import ahocorasick

    numbers: dict[str, list] = {}
    for r in phrases:
        numbers.setdefault(r.phrase, []).append((r.phrase_no, r.whole))
    automaton = ahocorasick.Automaton()
    for phrase, of in numbers.items():
        automaton.add_word(phrase, (len(phrase), of))
    automaton.make_automaton()
    at, to = texts.columns.index(text), texts.columns.index(hits)
    word = lambda c: c.isalnum() or c == "_"

    def found(value: str | None, before: list) -> list[int]:
        out = set(before)
        for end, (size, of) in automaton.iter(value or ""):
            begin = end - size + 1
            edges = None
            for no, whole in of:
                if whole and edges is None:
                    edges = (begin > 0 and word(value[begin - 1])) != word(value[begin]) and (end + 1 < len(value) and word(value[end + 1])) != word(value[end])
                if not whole or edges:
                    out.add(no)
        return sorted(out)

    def scan(batches):
        import pyarrow as pa

        for b in batches:
            new = [found(v, h) for v, h in zip(b.column(at).to_pylist(), b.column(to).to_pylist(), strict=True)]
            columns = list(b.columns)
            columns[to] = pa.array(new, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return texts.mapInArrow(scan, texts.schema)


def deprecation_violations(answers: DataFrame, deprecations: DataFrame) -> DataFrame:
    """case_id, entry: entries of deprecations(entry, symbols, note) that an answer mentions without a word of the note.

    Symbols and words of all entries are searched at once; an answer's hits then meet the entries by the symbol's number.
    """
    known = written(deprecations.select("entry", F.array_distinct(F.transform("symbols", F.lower)).alias("symbols"), F.array_distinct(T.significant_words(F.col("note"))).alias("signals")), "deprecations")
    each = known.select(F.explode("symbols").alias("phrase")).select("phrase", F.lit(True).alias("whole")).union(known.select(F.explode("signals").alias("phrase")).select("phrase", F.lit(False).alias("whole"))).distinct()
    numbered = written(each.withColumn("phrase_no", F.row_number().over(Window.orderBy("whole", "phrase"))), "phrases")  # the entries are a stated list
    number = lambda words, whole: known.select("entry", F.explode(words).alias("phrase")).join(numbered.where(F.col("whole") == whole), "phrase").select("entry", "phrase_no")
    signals = number("signals", False).groupBy("entry").agg(F.collect_list("phrase_no").alias("signals"))  # the words of one note
    symbols = number("symbols", True).join(signals, "entry", "left").select("entry", F.col("phrase_no").alias("hit"), F.coalesce("signals", F.array().cast("array<int>")).alias("signals"))
    hit = phrase_hits(answers.select("case_id", F.lower("answer").alias("text")), numbered).where(F.size("hits") > 0).select("case_id", "hits")
    mentioned = hit.withColumn("hit", F.explode("hits")).join(bounded_broadcast(symbols), "hit")
    return mentioned.where(~F.arrays_overlap("hits", "signals")).select("case_id", "entry").distinct()


def guardrails(answer: Column) -> Column:
    """Map of the dangerous patterns that an answer holds."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, T.GUARDRAILS)), F.array(*(answer.rlike("(?i)" + p) for p in T.GUARDRAILS.values())))
    return F.map_filter(pairs, lambda _, hit: hit)


def parsed_action(raw: Column) -> Column:
    """Struct tool, thought, query of the first { to the last } of a model's output; a retrieval where that isn't an action of a known tool."""
    block = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(block, "struct<tool:string,thought:string,inputs:struct<query:string>>")
    tool = F.coalesce(parsed["tool"], F.lit("retrieve"))
    good = (block != "") & parsed.isNotNull() & F.coalesce(F.get_json_object(block, "$").isNotNull(), F.lit(False)) & tool.isin(TOOLS)
    return F.struct(F.when(good, tool).otherwise("retrieve").alias("tool"), F.when(good, F.coalesce(F.nullif(F.trim(parsed["thought"]), F.lit("")), F.lit("(no thought provided)"))).otherwise("fallback").alias("thought"), F.when(good, parsed["inputs"]["query"]).alias("query"))


def parsed_specialists(raw: Column) -> Column:
    """Known names of the list between the first [ and the last ] of a line."""
    block = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(\[.*\])", 1)
    return F.coalesce(F.filter(F.from_json(block, "array<string>"), lambda s: s.isin(SPECIALISTS)), F.array().cast("array<string>"))


def markdown_table(text: Column) -> Column:
    """Array of (symbols, endpoint, note) of the three-cell rows of a Markdown table, without its head and rule."""
    rows = F.filter(F.transform(F.split(text, "\n"), T.stripped), lambda line: line.startswith("|") & ~line.rlike(r"^[|\s-]*$"))
    cells = F.transform(rows, lambda line: F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)))
    good = F.filter(cells, lambda c: (F.size(c) == 3) & (F.lower(F.get(c, F.lit(0))) != "symbol"))
    symbols = lambda c: T.let(F.regexp_extract_all(F.get(c, F.lit(0)), F.lit("`([^`]+)`"), 1), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.get(c, F.lit(0)))))
    return F.transform(good, lambda c: F.struct(symbols(c).alias("symbols"), F.get(c, F.lit(1)).alias("endpoint"), F.get(c, F.lit(2)).alias("note")))
