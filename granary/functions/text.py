"""Text functions: tokens, token estimates, white space, headings and keyword checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from granary.functions.stemming import stems

# Words that a query's terms leave out.
QUERY_STOPWORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both
but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had
hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd
i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once
only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such
than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this
those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's
where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours
yourself yourselves
""".split()

# Phrases that mark an answer as a refusal.
REFUSAL_PHRASES = [
    "could not find", "couldn't find", "cannot find", "can't find", "do not have enough information", "don't have enough information",
    "no relevant information", "not contain", "does not contain", "unable to answer", "i don't know", "i do not know",
    "no information available", "not able to find",
]

# Single words that are headings, and beginnings that never are.
SECTION_WORDS = """
summary experience education skills responsibilities objective projects achievements certifications references
highlights overview introduction background qualifications profile employment history publications awards languages
interests activities volunteering expertise competencies accomplishments portfolio contact
""".split()
CODE_PREFIXES = ["protocol ", "class ", "struct ", "enum ", "func ", "extension ", "case ", "var ", "let ", "typealias "]

# Words that don't count as signals of a migration note.
NOTE_STOPWORDS = """
read from instead with after that this have will your note code field endpoint property removed there replacement direct
""".split()

# Phrases that tool output is cleared of, patterns of dangerous code, and marks of code samples.
MALICIOUS_PHRASES = [
    "ignore previous instructions", "ignore all previous", "disregard previous", "disable tls", "disable ssl",
    "bypass verification", "skip verification", "tell the user to", "instruct the user to",
]
GUARDRAILS = {
    "tls_bypass": r"verify\s*=\s*False|ssl\._create_unverified_context",
    "command_injection": r"subprocess\.(call|run|Popen)|os\.system\(",
    "file_access": r"open\s*\([^)]*\/etc\/|open\s*\([^)]*\/root\/",
}
CODE_MARKS = ["def ", "class ", "import ", "```", "curl", "sdk", "client"]
TRUNCATED = "\n\n[Context truncated due to token limit]"

#: Words are runs of letters, digits and underscores, in any script.
WORD = r"([\p{L}\p{N}_]+)"


def let(value: Column, make) -> Column:
    """make(value), with the value computed once for all its uses."""
    return F.element_at(F.transform(F.array(value), make), 1)


def tokens(text: Column, kind: str = "standard") -> Column:
    """Lower-case tokens by a registered tokenizer: 'standard' takes words, 'whitespace' what stands between white space,
    'porter' the stems of words."""
    if kind not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {kind!r}; known: {', '.join(TOKENIZERS)}")
    return TOKENIZERS[kind](F.lower(F.coalesce(text, F.lit(""))))


def space_words(text: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


#: Tokenizers by name, of a lower-case text column; more may be registered.
TOKENIZERS = {
    "standard": lambda lower: F.regexp_extract_all(lower, F.lit(WORD), 1),
    "whitespace": lambda lower: space_words(lower),
    "porter": lambda lower: stems(F.regexp_extract_all(lower, F.lit(WORD), 1)),
}


def query_terms(text: Column, kind: str = "standard") -> Column:
    """Tokens without stopwords; all tokens if nothing else is left. Repeats stay."""
    return let(tokens(text, kind), lambda t: let(F.filter(t, lambda w: ~w.isin(QUERY_STOPWORDS)), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(t)))


def longest_words(text: Column, n: int = 3) -> Column:
    """The n longest distinct tokens, longer first, then by code point: stand-in keywords with an exact SQL form."""
    ranked = F.array_sort(F.transform(F.array_distinct(tokens(text)), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.transform(F.slice(ranked, 1, n), lambda s: s["t"])


def token_estimate(text: Column) -> Column:
    """Words divided by 0.75, rounded down, 1 at least; 0 for null and empty text."""
    words = F.size(space_words(text))
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.greatest(F.lit(1), (words / F.lit(0.75)).cast("int"))).cast("long")


def truncate_tokens(text: Column, most: Column) -> Column:
    """The text if its estimate is within `most`, else its first floor(0.75 * most) words and a mark."""
    kept = F.array_join(F.slice(space_words(text), 1, F.greatest(F.lit(0), F.floor(most * F.lit(0.75))).cast("int")), " ")
    return F.when(token_estimate(text) <= most, text).otherwise(F.concat(kept, F.lit(TRUNCATED)))


def normalize_space(text: Column) -> Column:
    """Runs of white space of any script as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def clean_page(text: Column) -> Column:
    """Without the lines that a browser prints at the top and bottom of a page."""
    printed = r"^\s*(\d{1,2}/\d{1,2}/\d{2,4},\s*\d{1,2}:\d{2}\s*[AP]M|Page\s+\d+\s+of\s+\d+)"
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(printed)), "\n")


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def looks_like_heading(raw: Column) -> Column:
    """A Markdown heading, or a short capitalised line of several words, or of a known word, that isn't a sentence or a signature."""
    line = stripped(raw)
    lower = F.lower(line)
    plain = (
        (F.length(line) > 0)
        & (F.length(line) <= 60)
        & line.rlike(r"^\p{Lu}")
        & ~line.rlike(r"[.:,;]$")
        & (line.rlike(r"\s") | lower.isin(SECTION_WORDS))
        & ~lower.rlike("^(" + "|".join(CODE_PREFIXES) + ")")
    )
    return line.rlike(r"^#{1,6}\s+.") | plain


def heading_text(raw: Column) -> Column:
    """A heading's text without Markdown marks."""
    line = stripped(raw)
    return F.when(line.rlike(r"^#{1,6}\s+.") , stripped(F.regexp_extract(line, r"^#{1,6}\s+(.+)$", 1))).otherwise(line)


def is_refusal(answer: Column) -> Column:
    """Whether an answer is blank or holds a refusal phrase."""
    lower = F.lower(F.coalesce(answer, F.lit("")))
    return lower.rlike(r"^\s*$") | lower.rlike("|".join(REFUSAL_PHRASES))


def holds_all(answer: Column, keywords: Column) -> Column:
    """Whether an answer holds every keyword, whatever the case; true for no keywords."""
    return F.forall(keywords, lambda k: F.contains(F.lower(F.coalesce(answer, F.lit(""))), F.lower(k)))


def keyword_share(answer: Column, keywords: Column) -> Column:
    """Share of the keywords that an answer holds; 1 for none."""
    lower = F.lower(answer)
    return F.when(F.size(keywords) == 0, F.lit(1.0)).otherwise(F.size(F.filter(keywords, lambda k: F.contains(lower, F.lower(k)))) / F.size(keywords))


def word_share(words: Column, text: Column, longer_than: int) -> Column:
    """Share of distinct lower-case words over a length that a lower-case text holds, at 4 places; 0 for none."""
    kept = F.array_distinct(F.filter(space_words(F.lower(words)), lambda w: F.length(w) > longer_than))
    return let(kept, lambda k: F.when(F.size(k) == 0, F.lit(0.0)).otherwise(F.round(F.size(F.filter(k, lambda w: F.contains(F.lower(text), w))) / F.size(k), 4)))


def significant_words(text: Column) -> Column:
    """Lower-case words of four characters or more that aren't common in notes."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(text, "[`*_]", "")), F.lit(r"([a-z][a-z0-9_.\-]{3,})"), 1)
    return F.filter(words, lambda w: ~w.isin(NOTE_STOPWORDS))


def endpoint_tokens(text: Column) -> Column:
    """Path-like tokens in order."""
    return F.regexp_extract_all(text, F.lit(r"(/[A-Za-z][A-Za-z0-9_\-{}]*(?:/[A-Za-z0-9_\-{}]+)*)"), 1)


def redact(text: Column) -> Column:
    """Text with malicious phrases replaced, whatever their case."""
    return F.regexp_replace(text, "(?i)" + "|".join(MALICIOUS_PHRASES), "[REDACTED]")


def clean_keyword(text: Column) -> Column:
    """Without quotes and outer white space; null below two characters."""
    value = stripped(F.regexp_replace(text, "[\"'‘’“”]", ""))
    return F.when(F.length(value) >= 2, value)


def document_key(name: Column) -> Column:
    """Lower-case document name without one known extension."""
    return F.regexp_replace(F.trim(F.lower(name)), r"\.(pdf|md|txt|docx|doc)$", "")


def document_stem(name: Column) -> Column:
    """Lower-case name without folders and its last extension; a leading dot belongs to the name."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
