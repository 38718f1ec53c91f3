"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network with
temperature-calibrated probabilities.

A token's index vector is sparse, ternary and follows from the token alone; its word vector is the sum of the index
vectors of its neighbours, two on each side, over the whole corpus. All tokens are counted into a written table; the HELD
most frequent ones have a vector each, rarer ones share SHARED vectors by their hashes. A document is the mean of its
word vectors, the mean absolute difference between neighbours and the logarithm of its length. The network is fitted on a
bounded sample of labelled rows (`fit_rows`).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common, hashing

#: Tokens with a vector each, and vectors that all rarer tokens share; together they are what a task holds.
HELD = 61_439
SHARED = 4096
#: Neighbours on each side that a token's vector is made of.
WINDOW = 2
DIM = 32
NONZERO = 4
#: Labelled rows that the network is fitted on, at most; those with the smallest hashes of doc_id.
FIT_ROWS = 20_000
HIDDEN = 32
PIECE = 1 << 17
#: Tokens whose vectors are looked at together, few enough for a core's cache.
LOOK = 1 << 13
SEED = 7
#: A name that no column of docs has.
SCORE = "granary quality score \u2022"


def index_vectors(hashes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """(hashes, NONZERO) places in which the index vector of each hash is +1 (first half) or -1: those of the least mixed values."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.int64).view(np.uint64)[:, None] + (np.arange(dim, dtype=np.uint64) + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.argsort(x ^ (x >> np.uint64(31)), axis=1, kind="stable")[:, :NONZERO].astype(np.int64)


def index_signs(held: np.ndarray) -> np.ndarray:
    """(rows + 1, DIM) index vectors of the held tokens, of the shared rows by their number, and zeros for what stands between two texts."""
    places = index_vectors(np.concatenate([held, np.arange(SHARED)]))
    out = np.zeros((len(places) + 1, DIM), np.int8)
    for j in range(NONZERO):
        out[np.arange(len(places)), places[:, j]] = 1 if j < NONZERO // 2 else -1
    return out


class WordVectors:
    """Hashes of the held tokens, the most frequent first, and the unit vectors of their rows and of the shared ones."""

    def __init__(self, held: np.ndarray, vectors: np.ndarray) -> None:
        self.held, self.vectors = held, vectors

    def words(self) -> hashing.Words:
        return hashing.Words(self.held, SHARED)


def frequent_tokens(docs: DataFrame) -> np.ndarray:
    """Hashes of the HELD most frequent tokens of docs(text) at most, by falling counts; all are counted into a written table."""
    table = common.written(hashing.token_counts(docs), "quality-tokens")
    top = table.where(common.frequent(table, "hash", "n", HELD)).toArrow()
    common.drop_written(table)
    hashes, n = top.column("hash").to_numpy(), top.column("n").to_numpy()
    return hashes[np.lexsort((hashes, -n))]


def word_vectors(docs: DataFrame) -> WordVectors:
    """Word vectors of docs(text). Each task sends one row for each vector; sums are whole numbers, so reruns agree."""
    common.small_batches(docs.sparkSession)
    held = frequent_tokens(docs)
    rows = len(held) + SHARED
    signs = index_signs(held)

    def gather(batches):
        import pyarrow as pa

        sums, known = np.zeros((rows + 1, DIM), np.int64), hashing.Words(held, SHARED)
        for b in batches:
            _sum_batch(b.column(0).to_pylist(), sums, signs, known)
        keep = np.flatnonzero(sums[:rows].any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), *(pa.array(sums[keep, d], pa.int64()) for d in range(DIM))], names=["row", *(f"c{d}" for d in range(DIM))])

    fields = ", ".join(f"c{d} long" for d in range(DIM))
    sums = docs.select("text").mapInArrow(hashing.forgetting(gather), f"row long, {fields}").groupBy("row").agg(*(F.sum(f"c{d}").alias(f"c{d}") for d in range(DIM))).toArrow()
    out = np.zeros((rows, DIM))  # at most one row for each vector
    out[sums.column("row").to_numpy()] = np.stack([sums.column(f"c{d}").to_numpy() for d in range(DIM)], axis=1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return WordVectors(held, (out / np.where(norm > 0, norm, 1)).astype(np.float32))


def _sum_batch(texts, total: np.ndarray, signs: np.ndarray, known: hashing.Words) -> None:
    """Adds to total (rows + 1, DIM) the index vectors of the neighbours of every token; texts are laid end to end with WINDOW places between them."""
    edge = np.full(WINDOW, len(signs) - 1)
    own, n = [edge], 0
    for t in texts:
        x = known.ids(t)
        if len(x) > 1:
            own += [x, edge]
            n += len(x)
        if n >= PIECE:
            _sum_line(np.concatenate(own), total, signs)
            own, n = [edge], 0
    if n:
        _sum_line(np.concatenate(own), total, signs)


def _sum_line(line: np.ndarray, total: np.ndarray, signs: np.ndarray) -> None:
    """The sums of one line, whose first and last WINDOW places are empty, in pieces of LOOK tokens."""
    for lo, hi in hashing.pieces(line[WINDOW:-WINDOW], LOOK):
        e = np.take(signs, line[lo : hi + 2 * WINDOW], axis=0)
        n = hi - lo
        near = np.zeros((n, DIM), np.int8)  # 2 * WINDOW at most
        for k in (*range(WINDOW), *range(WINDOW + 1, 2 * WINDOW + 1)):
            near += e[k : k + n]
        x = line[lo + WINDOW : hi + WINDOW].astype(np.uint16)
        order = np.argsort(x, kind="stable")  # two-byte keys are sorted by radix
        x = np.take(x, order)
        begin = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        total[x[begin]] += np.add.reduceat(np.take(near, order, axis=0), begin, axis=0, dtype=np.int32)


def features(texts: list[str | None], vectors: np.ndarray, known: hashing.Words) -> np.ndarray:
    """(texts, 2 * DIM + 1) features; an empty text has zeros."""
    ids = [known.ids(t) for t in texts]
    out = np.zeros((len(texts), 2 * DIM + 1), np.float32)
    at = 0
    while at < len(ids):
        group, n = [], 0
        while at < len(ids) and (not group or n + len(ids[at]) <= LOOK):
            group.append(at)
            n += len(ids[at])
            at += 1
        if len(group) == 1:
            x, k = ids[group[0]], group[0]
            mean, diff = np.zeros(DIM, np.float64), np.zeros(DIM, np.float64)
            for lo, hi in hashing.pieces(x, LOOK):
                v = vectors[x[lo : hi + 1]]
                mean += v[: hi - lo].sum(axis=0, dtype=np.float64)
                diff += np.abs(np.diff(v, axis=0)).sum(axis=0, dtype=np.float64)
            if len(x):
                out[k, :DIM], out[k, DIM : 2 * DIM] = mean / len(x), diff / max(1, len(x) - 1)
            continue
        full = [k for k in group if len(ids[k])]
        if not full:
            continue
        x = np.concatenate([ids[k] for k in full])
        lengths = np.array([len(ids[k]) for k in full])
        begins = np.cumsum(lengths) - lengths
        v = vectors[x]
        d = np.abs(np.diff(v, axis=0, append=v[-1:]))
        d[begins[1:] - 1] = 0  # the pair across two texts
        out[full, :DIM] = np.add.reduceat(v, begins, axis=0) / lengths[:, None]
        out[full, DIM : 2 * DIM] = np.add.reduceat(d, begins, axis=0) / np.maximum(1, lengths - 1)[:, None]
    out[:, -1] = np.log1p([len(x) for x in ids]) / 10
    return out


class Network:
    """Two layers, tanh and a logistic output; fitted by Adam on standardised features and calibrated by one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, epochs: int = 60) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-4) if len(x) else (0.0, 1.0)
        n_in = x.shape[1]
        self.w = [rng.normal(0, n_in**-0.5, (n_in, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        if not len(x):
            return
        fit = x[~held] if (~held).any() else x
        target = (y[~held] if (~held).any() else y).astype(float)
        z = (fit - self.mean) / self.scale
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for lo in range(0, len(z), 256):
                a, t = z[order[lo : lo + 256]], target[order[lo : lo + 256]]
                h = np.tanh(a @ self.w[0] + self.w[1])
                e = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - t) / len(t)
                back = np.outer(e, self.w[2]) * (1 - h * h)
                grads = [a.T @ back + 1e-5 * self.w[0], back.sum(axis=0), h.T @ e + 1e-5 * self.w[2], np.array([e.sum()])]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if held.any():
            logit, t = self.logits(x[held]), y[held]
            grid = np.geomspace(0.25, 8, 61)
            loss = [np.mean(np.logaddexp(0, np.where(t == 1, -logit, logit) / g)) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        # rounded, as products of matrices differ in their last bits with the number of rows
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30))), 9)


def held_out() -> F.Column:
    """crc32 of doc_id as text, mod 5, is 0; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[WordVectors, Network]:
    """Word vectors of all documents, and the network fitted on labelled ones that aren't held out.

    A document's label is its smallest non-null quality; a fifth of the sample sets the temperature. Without any
    labelled row the network is untrained and scores are near one half.
    """
    vectors = word_vectors(docs)
    hashed = F.xxhash64("doc_id")
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(hashed, "doc_id").limit(fit_rows)
    ids = common.written(chosen, "quality-fit")

    def read(batches):
        import pyarrow as pa

        known = vectors.words()
        for b in batches:
            x = features(b.column(2).to_pylist(), vectors.vectors, known)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    # at most fit_rows ids
    pairs = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    # an id that many rows repeat counts as one row, that of the least features, so the driver gets fit_rows rows at most
    each = pairs.mapInArrow(hashing.forgetting(read), "doc_id long, quality int, x binary").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))
    rows = sorted(each.collect(), key=lambda r: r.doc_id)
    common.drop_written(ids)
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows]) if rows else np.zeros((0, 2 * DIM + 1), np.float32)
    y = np.array([r.quality for r in rows])
    return vectors, Network(x, y, np.array([r.doc_id % 5 == 4 for r in rows], bool))


def scored(docs: DataFrame, model: tuple[WordVectors, Network]) -> DataFrame:
    """Adds SCORE (double, 0 to 1) to docs, which must have text; other columns stay."""
    vectors, network = model
    names = [*docs.columns, SCORE]
    at = docs.columns.index("text")

    def score(batches):
        import pyarrow as pa

        known = vectors.words()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(network.score(features(b.column(at).to_pylist(), vectors.vectors, known)), pa.float64())], names=names)

    common.small_batches(docs.sparkSession)
    return docs.mapInArrow(hashing.forgetting(score), StructType([*docs.schema.fields, StructField(SCORE, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text, ...); labels(doc_id, quality, ...).

    Scores come from the text alone. Null and empty texts have the features of no tokens and are scored too; repeated
    rows get equal scores; extra columns of either table are ignored; an empty docs gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    score = F.col(SCORE)
    return scored(own, fitted(own, labels, fit_rows)).select("doc_id", held_out().alias("held_out"), score.alias("score"), F.when(score >= threshold, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that the classifier, fitted on docs and labels, doesn't reject, with docs' own columns.

    Rows are decided one by one, by their text alone: null, empty and very long texts by their features, repeated rows
    alike. Extra columns stay, whatever their names; an empty table gives no rows.
    """
    model = fitted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, fit_rows)
    return scored(docs, model).where(F.col(SCORE) >= threshold).drop(SCORE)
