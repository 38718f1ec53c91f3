"""Benchmark items inside documents: size-partitioned MinHash containment search, in DataFrame operations only.

Items are partitioned by the size of their shingle sets. An item is contained at the threshold t only if at least
ceil(t n) of its n shingles are in the document, so of any n - ceil(t n) + 1 of them at least one is. Each partition
takes that number for its upper size as the length of its MinHash signatures: the item's smallest shingle hashes. A
document whose hashes meet a signature is a candidate, no true match is missed, and candidates are verified by
exact containment of the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common

WORDS = 5
THRESHOLD = 0.75
#: Signature hashes, and shingles of all items, that are broadcast at most; beyond it the joins are shuffled.
BROADCAST_HASHES = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _let(value: Column, make) -> Column:
    """make(value) with the value computed once; a plain reference would be computed anew for every element of a lambda that uses it."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _runs(words_: Column, make, lengths: tuple[int, ...]) -> Column:
    """make(run) of every run of as many words as one of the lengths."""

    def runs(w: Column, n: int) -> Column:
        return F.when(F.size(w) < n, F.slice(F.transform(w, lambda _: make(w)), 1, 0)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1))), lambda i: make(F.slice(w, i, n))))

    return _let(words_, lambda w: F.concat(*(runs(w, n) for n in lengths)))


def shingle_hashes(w: Column, lengths: tuple[int, ...] = (WORDS,)) -> Column:
    return _runs(w, lambda run: F.xxhash64(run), lengths)


def shingles(w: Column, lengths: tuple[int, ...] = (WORDS,)) -> Column:
    return F.array_distinct(_runs(w, lambda run: F.array_join(run, " "), lengths))


def _own(w: Column, make, n: int) -> Column:
    """make(w, lengths) of an item: its n-word runs, or all its words as one if there are fewer."""
    out = make(w, (n,))
    for k in range(n - 1, 0, -1):
        out = F.when(F.size(w) == k, make(w, (k,))).otherwise(out)
    return out


def signatures(items: DataFrame, threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """item_id, run (words of its shingles), grams (distinct shingles), n_grams and signature of items(item_id, text). Sizes are partitioned by powers of two."""
    split = items.select("item_id", words(F.col("text")).alias("w")).select("item_id", F.least(F.size("w"), F.lit(n)).alias("run"), _own(F.col("w"), shingles, n).alias("grams"), F.array_sort(F.array_distinct(_own(F.col("w"), shingle_hashes, n))).alias("hashes"))
    sized = split.where(F.size("grams") > 0).withColumn("n_grams", F.size("grams"))
    part = F.ceil(F.log2("n_grams")).cast("int")
    upper = F.pow(F.lit(2), part)  # the partition's largest size
    length = (upper - F.ceil(upper * F.lit(threshold)) + 1).cast("int")
    return sized.withColumn("signature", F.slice("hashes", 1, length)).drop("hashes")


def _found(docs: DataFrame, items: DataFrame, threshold: float, n: int) -> DataFrame:
    """doc_id, is (hash of the text), item_id, n_shingles and n_found of all pairs of a text and an item with containment >= threshold."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("is"), "text")
    known = common.written(signatures(items, threshold, n), "leak-items")
    size = known.agg(F.coalesce(F.sum(F.size("signature")), F.lit(0)), F.coalesce(F.sum("n_grams"), F.lit(0)), F.collect_set("run")).first()  # n lengths at most
    lengths = tuple(sorted({n, *size[2]}))
    probe = known.select(F.explode("signature").alias("hash")).distinct()
    hashes = docs.select("doc_id", "is", F.explode(shingle_hashes(words(F.col("text")), lengths)).alias("hash"))
    met = hashes.join(F.broadcast(probe) if size[0] <= BROADCAST_HASHES else probe, "hash", "left_semi").select("doc_id", "is").distinct()
    candidates = common.written(met.select(F.col("doc_id").alias("d"), F.col("is").alias("i")), "leak-candidates")
    few = common.small_side(candidates, candidates.count())
    texts = docs.join(few, docs["doc_id"].eqNullSafe(few["d"]) & (docs["is"] == few["i"]), "left_semi").withColumn("row", F.monotonically_increasing_id())
    own = texts.select("doc_id", "is", "row", F.explode(shingles(words(F.col("text")), lengths)).alias("gram"))
    sides = known.select("item_id", "n_grams", F.explode("grams").alias("gram"))
    shared = own.join(F.broadcast(sides) if size[1] <= BROADCAST_HASHES else sides, "gram")
    counted = shared.groupBy("row", "doc_id", "is", "item_id", F.col("n_grams").cast("long").alias("n_shingles")).agg(F.count("*").alias("n_found"))
    return counted.where(F.col("n_found") / F.col("n_shingles") >= threshold).drop("row").distinct()


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """doc_id, item_id, n_shingles (the item's), n_found and containment of all pairs with containment >= threshold.

    Shingles are runs of n words; an item of fewer words is one shingle of its own length, which documents are searched
    for too. Documents and items without words (null, empty, marks alone) match nothing. Null ids are ids like any other;
    rows that repeat an id and a text give one pair; rows that repeat an id with different texts give that of the highest
    containment. A very long text is searched as a whole. Extra columns are ignored; an empty table on either side gives no rows.
    """
    best = _found(docs, items, threshold, n).groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_shingles", "n_found"), F.col("n_found") / F.col("n_shingles")).alias("m")).select("doc_id", "item_id", "m.*")
    return best.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """The rows of docs whose text contains no item.

    Rows are told apart by id and text, so a clean row stays beside a leaking one of the same id or without an id. Null
    and empty texts stay. Extra columns stay, whatever their names; an empty table of items keeps all rows.
    """
    leaked = common.written(_found(docs, items, threshold, n).select(F.col("doc_id").alias("granary_id"), F.col("is").alias("granary_is")).distinct(), "leak-ids")
    side = common.small_side(leaked, leaked.count())
    return docs.join(side, docs["doc_id"].eqNullSafe(side["granary_id"]) & (F.xxhash64(docs["text"]) == side["granary_is"]), "left_anti")
