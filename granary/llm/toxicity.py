"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the buckets of its words, its pairs of neighbouring words, its pairs of words with one word between
them, and the beginnings of its longer words, each counted once. Every coordinate has its own learning rate, from the sum
of its squared gradients, and the L1 penalty keeps most weights at exactly zero, so the fitted model is a short list of
weights that every task gets. It is fitted on a bounded sample of labelled rows (`fit_rows`), dealt by doc_id over PARTS
parts: each of ROUNDS rounds trains every part in a task of its own, from the mean of the states that all parts had after the round before.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from . import common

BITS = 20
#: Lengths, in characters, of the beginnings of longer words that are features.
BEGINNINGS = (4, 5, 6, 7)
#: Labelled rows that the model is fitted on, at most; those with the smallest hashes of doc_id.
FIT_ROWS = 20_000
PARTS = 4
ROUNDS = 12
#: Rows of a part that a feature is in at least, to be learnt there.
LEAST_ROWS = 2
ALPHA, BETA, L1, L2 = 4.0, 1.0, 8.0, 0.01
#: Distinct words that a task remembers.
REMEMBERED = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BITS)


class _Words(dict):
    """By word, its hash and those of its beginnings (0 for none), four bytes each."""

    def __missing__(self, word: bytes) -> bytes:
        shown = word.decode("utf-8", "replace")
        starts = [zlib.crc32(shown[:n].encode("utf-8", "replace"), n) if len(shown) > n else 0 for n in BEGINNINGS]
        out = self[word] = np.array([zlib.crc32(word), *starts], "<u4").tobytes()
        return out


_KNOWN = _Words()


def buckets(text: bytes | None):
    """Buckets of a text's features in arrays, piece by piece; repeats stay. A pair across two pieces is in the later one."""
    before = np.zeros(0, np.uint64)
    for words in common.term_pieces(text):
        if len(_KNOWN) > REMEMBERED:
            _KNOWN.clear()
        rows = np.frombuffer(b"".join(map(_KNOWN.__getitem__, words)), "<u4").reshape(-1, 1 + len(BEGINNINGS))
        own = rows[:, 0].astype(np.uint64)
        starts = rows[:, 1:].ravel()
        h = np.concatenate([before, own])
        pairs = h[:-1] * np.uint64(3) + h[1:] * np.uint64(0x1000193)
        skips = h[:-2] * np.uint64(7) + h[2:] * np.uint64(0x1000193) + np.uint64(99)
        new = len(own)
        all_ = np.concatenate([own, pairs[-new:] if new else pairs[:0], skips[-new:] if new else skips[:0], starts[starts > 0].astype(np.uint64)])
        before = h[-2:]
        yield ((all_ * _MIX) >> _SHIFT).astype(np.int64)


def features(text: bytes | None) -> np.ndarray:
    """The distinct buckets of a text, ascending."""
    return np.unique(np.concatenate(list(buckets(text))))


def weights(z: np.ndarray, n: np.ndarray, l1: float = L1, l2: float = L2) -> np.ndarray:
    """FTRL-proximal weights of coordinates from their state: 0 within the L1 penalty."""
    return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2), 0.0)


def train(rows: list[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass over rows of (feature coordinates, label), in order; changes z and n, whose last coordinate is the intercept's, which no penalty holds."""
    for x, y in rows:
        zx, nx = z[x], n[x]
        w = weights(zx, nx)
        w0 = weights(z[-1:], n[-1:], 0.0, 0.0)[0]
        g = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -30, 30))) - y
        root = np.sqrt(nx + g * g)
        z[x] = zx + g - (root - np.sqrt(nx)) / ALPHA * w
        n[x] = nx + g * g
        z[-1] += g - (np.sqrt(n[-1] + g * g) - np.sqrt(n[-1])) / ALPHA * w0
        n[-1] += g * g


class Model:
    """Nonzero weights by bucket, and the intercept."""

    def __init__(self, learnt: dict[int, float]) -> None:
        self.intercept = learnt.pop(1 << BITS, 0.0)
        self.at = np.array(sorted(learnt), np.int64)
        self.weight = np.array([learnt[i] for i in self.at.tolist()])

    def scorer(self):
        """A function from a text's bytes to its score, with the weights laid out by bucket for this task."""
        dense = np.zeros(1 << BITS)
        dense[self.at] = self.weight
        used = dense != 0

        def score(text: bytes | None) -> float:
            met = np.unique(np.concatenate([b[used[b]] for b in buckets(text)]))
            return round(float(1 / (1 + np.exp(-np.clip(dense[met].sum() + self.intercept, -30, 30)))), 9)

        return score


def held_out() -> F.Column:
    """crc32 of doc_id as text, mod 3, is 1; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Written table part, doc_id, toxic, text of at most fit_rows labelled documents that aren't held out. An id counts once: with its greatest label, and the least of its rows' texts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    chosen = common.written(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "toxic-fit")
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most fit_rows ids
    each = pairs.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    out = common.written(each.select(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part"), "doc_id", "toxic", "text"), "toxic-rows")
    common.drop_written(chosen)
    return out


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model:
    """The model fitted on docs' labelled rows that aren't held out. Without any it has no weights, and scores are one half."""
    rows = sample(docs, labels, fit_rows)

    def read(batches):
        import pyarrow as pa

        try:
            for b in batches:
                x = [features(t).astype("<i4").tobytes() for t in common.byte_texts(b.column(3))]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(x, pa.binary())], names=["part", "doc_id", "toxic", "x"])
        finally:
            _KNOWN.clear()

    common.small_batches(docs.sparkSession)
    # a part is in one partition; what is lost is made again from the table
    dealt = rows.repartition(PARTS, "part").select("part", "doc_id", "toxic", "text").mapInArrow(read, "part long, doc_id long, toxic int, x binary").persist(StorageLevel.MEMORY_AND_DISK)

    path = None
    for _ in range(rounds):
        done = common.written(dealt.mapInArrow(one_round(path), "part long, at binary, z binary, n binary"), "toxic-state")
        if path:
            common.delete_path(docs.sparkSession, path)
        path = done._granary_path
    dealt.unpersist()
    common.drop_written(rows)
    # the nonzero weights alone come to the driver, 2^BITS at most
    learnt = docs.sparkSession.range(1).mapInArrow(read_weights(path), "at long, weight double").collect()
    if path:
        common.delete_path(docs.sparkSession, path)
    return Model({r.at: r.weight for r in learnt})


def common_state(path: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(z, n) of all coordinates and the intercept: the mean over the parts of the last round's table, which a task reads from the shared folder; zeros before the first."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    if path:
        import pyarrow.parquet as pq

        fs, at = common.filesystem(path)
        parts = sorted(pq.read_table(at, filesystem=fs).to_pylist(), key=lambda r: r["part"])
        for r in parts:
            x = np.frombuffer(r["at"], "<i4")
            z[x] += np.frombuffer(r["z"], "<f4") / len(parts)
            n[x] += np.frombuffer(r["n"], "<f4") / len(parts)
    return z, n


def one_round(path: str | None):
    """A function over batches of a part's rows that trains each part from the common state and gives the part's own state."""

    def run(batches):
        import pyarrow as pa

        parts: dict[int, list] = {}
        for b in batches:
            for part, i, y, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts.setdefault(part, []).append((zlib.crc32(str(i).encode()), i, np.frombuffer(x, "<i4"), y))
        for part in sorted(parts):
            own = sorted(parts.pop(part), key=lambda r: r[:2])
            z, n = common_state(path)
            count = np.zeros(len(z), np.int32)
            for r in own:
                count[r[2]] += 1
            train([(r[2][count[r[2]] >= LEAST_ROWS], r[3]) for r in own], z, n)
            at = np.flatnonzero(n)
            cells = [at.astype("<i4"), z[at].astype("<f4"), n[at].astype("<f4")]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], names=["part", "at", "z", "n"])
        common.release()

    return run


def read_weights(path: str | None):
    """A function over one batch that gives the nonzero weights of the common state; the intercept's place is 2^BITS."""

    def run(batches):
        import pyarrow as pa

        for _ in batches:
            z, n = common_state(path)
            w = np.append(weights(z[:-1], n[:-1]), weights(z[-1:], n[-1:], 0.0, 0.0))
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], names=["at", "weight"])
        common.release()

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text, ...); labels(doc_id, toxic, ...).

    Scores come from the text alone, the whole of it however long. Null and empty texts, and texts without words, have no
    features and score the intercept's probability; repeated rows and equal texts get equal scores; a null doc_id is kept
    and is never held out; null labels and labels without an id teach nothing. Extra columns of either table are ignored;
    an empty docs gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fitted(own, labels, fit_rows)

    def score(batches):
        import pyarrow as pa

        one = model.scorer()
        try:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(t) for t in common.byte_texts(b.column(1))], pa.float64())], names=["doc_id", "score"])
        finally:
            _KNOWN.clear()
            common.release()

    common.small_batches(docs.sparkSession)
    return own.mapInArrow(score, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
