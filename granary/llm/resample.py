"""Importance resampling towards a target: hashed n-gram features, log-ratio weights, Gumbel top-k.

A text's features are its runs of 1 to n words, counted by bucket over all documents and over the target texts. A
bucket's gain is the logarithm of its smoothed share in the target over that in the documents; a document weighs the mean
gain of its features. The draw adds a Gumbel number that doc_id gives and keeps the highest sums.

Very long texts are cut into chunks at word boundaries. A chunk owns the runs that start in it and carries the n - 1 words
that follow, so no run is lost or counted twice. The chunks of long texts are dealt over all tasks, away from the texts
they come from, and their counts and weights are summed by document; other texts are counted where they are read.
"""

from __future__ import annotations

import math
import zlib
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

BUCKETS = 10_000
#: Characters from which on a text is cut into chunks, and bytes of a chunk at least.
LONG = 1 << 16
CHUNK = 1 << 15


def chunks(text: bytes, n: int, size: int | None = None):
    """(own, carry) of a text: bytes cut at word boundaries every `size` bytes, and the n - 1 words that follow."""
    size = size or CHUNK
    at = 0
    while at < len(text):
        cut = common._NO_TERM.search(text, at + size) if len(text) - at > size else None
        end = cut.end() if cut else len(text)
        carry: list[bytes] = []
        look = end
        while len(carry) < n - 1 and (m := common._ANY_TERM.search(text, look)):
            carry.append(m[0])
            look = m.end()
        yield text[at:end], b" ".join(carry)
        at = end


def feature_buckets(own: bytes, carry: bytes, n: int) -> tuple[int, np.ndarray]:
    """The number of words of `own`, and the buckets of all runs of 1 to n words that start in it."""
    words = [w for piece in common.term_pieces(own) for w in piece]
    starts = len(words)
    if carry:
        words += next(common.term_pieces(carry))
    out, run = [], list(map(zlib.crc32, words))
    out += run[:starts]
    for k in range(1, n):
        run = list(map(zlib.crc32, words[k:], map(zlib.crc32, repeat(b" "), run)))
        out += run[:starts]
    return starts, np.array(out, np.int64) % BUCKETS


def cut_long(texts: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Of texts(doc_id, is, text): those that aren't long, as doc_id, is, own and carry, and a written table row, doc_id, is, own, carry of the chunks of the long ones."""
    long = F.length("text") > LONG

    def split(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):  # a batch for each text, as chunks of many long ones would be much at once
                parts = list(chunks(common.byte_texts(b.column(3).slice(i, 1))[0], n))
                keys = [b.column(k).take(pa.array([i] * len(parts))) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array([p[k] for p in parts], pa.binary()) for k in (0, 1))], names=["row", "doc_id", "is", "own", "carry"])

    short = texts.where(F.coalesce(~long, F.lit(True))).select("doc_id", "is", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("own"), F.lit("").cast("binary").alias("carry"))
    numbered = texts.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "is", "text")
    return short, common.written(numbered.mapInArrow(split, "row long, doc_id long, is long, own binary, carry binary"), "resample-chunks")


def dealt(cut: DataFrame) -> DataFrame:
    """Chunks over all tasks, by document and place."""
    return cut.repartition("row", F.xxhash64("own"))


def bucket_counts(parts: DataFrame, n: int) -> DataFrame:
    """bucket, n of parts(own, carry): a task sends its own sum of each bucket."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for own, carry in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total += np.bincount(feature_buckets(own, carry, n)[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return parts.select("own", "carry").mapInArrow(count, "bucket long, n long")


def totals(*counted: DataFrame) -> np.ndarray:
    """Sums by bucket of tables of bucket_counts."""
    whole = counted[0]
    for c in counted[1:]:
        whole = whole.union(c)
    out = np.zeros(BUCKETS, np.int64)
    for r in whole.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths, rounded down."""
    s, t = int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(b + 1) * float(s + BUCKETS)) / (float(a + 1) * float(t + BUCKETS)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def sums(parts: DataFrame, gain: np.ndarray, n: int, keys: list[str]) -> DataFrame:
    """keys, n_words, n_features and total (sum of gains) of each of parts(keys, own, carry)."""
    width = len(keys)

    def add(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for own, carry in zip(b.column(width).to_pylist(), b.column(width + 1).to_pylist(), strict=True):
                words, x = feature_buckets(own, carry, n)
                rows.append((words, len(x), int(gain[x].sum())))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *(pa.array(c, pa.int64()) for c in cols)], names=[*keys, "n_words", "n_features", "total"])

    return parts.select(*keys, "own", "carry").mapInArrow(add, ", ".join(f"{k} long" for k in [*keys, "n_words", "n_features", "total"]))


def gumbel(doc_id: Column, seed: int) -> Column:
    """A Gumbel number in thousandths, rounded down, from a hash of seed and doc_id; a null id is an empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """Adds rank to written scored(doc_id, score, eligible): 1, 2, 3... over the eligible rows by score, then doc_id, for the first floor(percent / 100) of them.

    Rows are range-partitioned in that order and written with their partition; counts by partition tell where each begins.
    """
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("tie").asc()]
    ordered = common.written(scored.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "resample-order")
    counts = ordered.groupBy("part").agg(F.count_if("eligible").alias("n"))
    begins = common.written(counts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"), "n"), "resample-begins")  # a row for each partition
    last = begins.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    side = common.small_side(begins.drop("n"), last[1])
    place = F.col("begin") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ordered.join(side, F.col("part") == F.col("p")).withColumn("rank", F.when(F.col("eligible") & (place <= percent * last[0] // 100), place).cast("long"))


def _resampled(docs: DataFrame, target: DataFrame, n: int, least_words: int, percent: int, seed: int) -> DataFrame:
    """resample() with is, the hash of the row's text."""
    common.small_batches(docs.sparkSession)
    known = lambda df, i: df.select(i.cast("long").alias("doc_id"), F.xxhash64("text").alias("is"), "text")
    short, cut = cut_long(known(docs, F.col("doc_id")), n)
    few, wanted_cut = cut_long(known(target, F.lit(0)), n)
    gain = gains(totals(bucket_counts(short, n), bucket_counts(dealt(cut), n)), totals(bucket_counts(few, n), bucket_counts(dealt(wanted_cut), n)))
    whole = sums(short, gain, n, ["doc_id", "is"])
    parts = sums(dealt(cut), gain, n, ["row", "doc_id", "is"]).groupBy("row", "doc_id", "is").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "total"))).drop("row")
    weight = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.floor(F.col("total") / F.col("n_features"))).cast("long")
    weighed = whole.union(parts).select("doc_id", "is", "n_features", weight.alias("weight"), (F.col("n_words") >= least_words).alias("eligible"))
    scored = common.written(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "resample-scores")
    common.drop_written(cut, wanted_cut)
    return ranked(scored, percent)


def resample(docs: DataFrame, target: DataFrame, n: int = 2, least_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs(doc_id, text, ...); target(text, ...) is what the draw is to resemble.

    Null and empty texts, and texts without words, have no features and weight 0; they are returned but not drawn, as is
    any document below least_words words. Repeated rows each take part; a null doc_id's Gumbel number is that of an empty
    id, and it comes first among equal scores. Texts of any length count whole. Extra columns of either table are ignored.
    An empty target gives every bucket the gain of its own rarity; an empty docs gives no rows.
    """
    return _resampled(docs, target, n, least_words, percent, seed).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, n: int = 2, least_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that the draw takes, with docs' own columns; rows that repeat an id and a text are taken if one of them is, and extra columns stay, whatever their names."""
    places = _resampled(docs, target, n, least_words, percent, seed).where(F.col("rank").isNotNull())
    side = common.written(places.select(F.col("doc_id").alias("granary_id"), F.col("is").alias("granary_is")).distinct(), "resample-drawn")
    return docs.join(common.small_side(side, side.count()), docs["doc_id"].cast("long").eqNullSafe(side["granary_id"]) & (F.xxhash64(docs["text"]) == side["granary_is"]), "left_semi")
