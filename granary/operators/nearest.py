"""Exact nearest neighbours as blocked matrix products.

Questions are taken in blocks of a bounded number. A task reads its chunks' vectors in Arrow batches, orders a batch by
nearness to a few of its own vectors and cuts it into blocks. Of every block the centre and the radius give an upper bound
of its scores, by Cauchy and Schwarz; a block is multiplied only with the questions whose k-th best score so far it can
still reach. A task sends k rows for each question at most, and these are ranked once more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

#: Questions that are multiplied at a time; more read the chunks once for each block.
QUESTIONS = 4096
#: Vectors of a block, and vectors that a batch is ordered by.
BLOCK, PIVOTS = 128, 16
#: Scores are rounded to six places; a bound must be below the k-th best by more than that can hide.
SLACK = 2e-6
KINDS = ("cosine", "dot", "l2")


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def scores(q: np.ndarray, c: np.ndarray, kind: str) -> np.ndarray:
    """(questions, chunks) scores at six places; for cosine both sides are unit rows. Distances are negated."""
    if kind != "l2":
        return np.round(q @ c.T, 6)
    # by differences, as squares and a product would cancel for near vectors
    out = np.empty((len(q), len(c)))
    for lo in range(0, len(q), 64):
        out[lo : lo + 64] = -np.sqrt(((q[lo : lo + 64, None, :] - c[None, :, :]) ** 2).sum(axis=2))
    return np.round(out, 6)


def bounds(q: np.ndarray, centre: np.ndarray, radius: float, kind: str) -> np.ndarray:
    """The greatest score that any vector within a radius of a centre can have with each question."""
    if kind == "l2":
        return -np.maximum(0.0, np.linalg.norm(q - centre, axis=1) - radius)
    return q @ centre + np.linalg.norm(q, axis=1) * radius


class Nearest:
    """The best chunks of each question so far, of vectors of one length."""

    def __init__(self, q: np.ndarray, kind: str, k: int | None, least: float | None) -> None:
        self.q, self.kind, self.k, self.least = q, kind, k, least
        self.kth = np.full(len(q), -np.inf)
        self.of, self.score, self.pos, self.row = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.blocks = self.skipped = 0  # pairs of a block and a question, and those left out

    def passes(self, s: np.ndarray) -> np.ndarray:
        if self.least is None:
            return ~np.isnan(s)
        return s <= self.least if self.kind == "l2" else s >= self.least

    def add(self, c: np.ndarray, pos: np.ndarray, row: np.ndarray) -> None:
        """Takes a batch of vectors with their places and their rows' numbers."""
        if not len(c):
            return
        pivots = c[np.linspace(0, len(c) - 1, min(PIVOTS, len(c))).astype(int)]
        near = ((c * c).sum(axis=1)[:, None] - 2 * c @ pivots.T + (pivots * pivots).sum(axis=1)).argmin(axis=1)
        order = np.argsort(near, kind="stable")
        for lo in range(0, len(c), BLOCK):
            at = order[lo : lo + BLOCK]
            block = c[at]
            centre = block.mean(axis=0)
            radius = float(np.sqrt(((block - centre) ** 2).sum(axis=1).max()))
            reach = bounds(self.q, centre, radius, self.kind)
            live = np.flatnonzero(~(reach < self.kth - SLACK))
            self.blocks += len(self.q)
            self.skipped += len(self.q) - len(live)
            if len(live):
                self._merge(live, scores(self.q[live], block, self.kind), pos[at], row[at])

    def _merge(self, live: np.ndarray, s: np.ndarray, pos: np.ndarray, row: np.ndarray) -> None:
        i, j = np.nonzero(self.passes(s) & (s >= self.kth[live][:, None]))
        if not len(i):
            return
        of, score, pos, row = (np.concatenate(x) for x in ((self.of, live[i]), (self.score, s[i, j]), (self.pos, pos[j]), (self.row, row[j])))
        if self.k is not None:
            order = np.lexsort((pos, -score, of))
            of = of[order]
            keep = np.arange(len(of)) - np.searchsorted(of, of, "left") < self.k
            of, order = of[keep], order[keep]
            score, pos, row = score[order], pos[order], row[order]
            full = np.flatnonzero(np.bincount(of, minlength=len(self.q)) == self.k)
            self.kth[full] = score[np.searchsorted(of, full, "right") - 1]
        self.of, self.score, self.pos, self.row = of, score, pos, row

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, row, score) of what is kept, and forgets them where all pairs are asked for."""
        out = self.of, self.row, self.score
        if self.k is None:
            self.of, self.score, self.pos, self.row = self.of[:0], self.score[:0], self.pos[:0], self.row[:0]
        return out


def matrices(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) by length of an Arrow column of arrays; null and empty ones, and those with a null element, are left out."""
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    begins = np.cumsum(sizes) - sizes
    out = {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        v = values[begins[rows][:, None] + np.arange(d)]
        whole = ~np.isnan(v).any(axis=1)
        out[d] = rows[whole], v[whole]
    return out


def _block_search(ids: list, vectors: list, chunks: DataFrame, k: int | None, kind: str, least: float | None, id_field: StructField) -> DataFrame:
    """query_id, chunk_id, pos, score of one block of questions: by task the k best, or all pairs that pass."""
    by_size: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by_size.setdefault(len(v), []).append(i)
    sides = {d: (np.array(at), np.array([vectors[i] for i in at], float)) for d, at in by_size.items()}
    kinds = [to_arrow_type(chunks.schema[c].dataType) for c in ("chunk_id", "pos")]
    id_kind = to_arrow_type(id_field.dataType)
    fields = [id_field, StructField("chunk_id", chunks.schema["chunk_id"].dataType), StructField("pos", chunks.schema["pos"].dataType), StructField("score", DoubleType())]

    def scan(batches):
        import pyarrow as pa

        of = {d: Nearest(unit(q) if kind == "cosine" else q, kind, k, least) for d, (_, q) in sides.items()}
        unlike = {d: Nearest(q[:, :1] * 0, "dot", k, least if kind != "l2" else None) for d, (_, q) in sides.items()}  # score 0 with vectors of other lengths
        kept: list = []  # id and place of the rows that are held, as Arrow arrays
        base = 0

        def found():
            cols: list = [[], [], []]
            for some in (of, unlike):
                for d, n in some.items():
                    i, row, s = n.take()
                    cols[0].append(sides[d][0][i])
                    cols[1].append(row)
                    cols[2].append(np.full(len(s), -np.inf) if some is unlike and kind == "l2" else s)
            at, row, s = (np.concatenate(c) if c else np.zeros(0) for c in cols)
            held = [pa.concat_arrays([pa.array([], kinds[c]), *(p[c].cast(kinds[c]) for p in kept)]) for c in (0, 1)]
            place = pa.array(row.astype(np.int64))
            return pa.RecordBatch.from_arrays([names.take(pa.array(at.astype(np.int64))), held[0].take(place), held[1].take(place), pa.array(s.astype(np.float64) + 0.0)], names=["query_id", "chunk_id", "pos", "score"])

        names = pa.array(ids, id_kind)
        for b in batches:
            kept.append((b.column(0), b.column(1)))
            pos = b.column(1).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
            for size, (rows, c) in matrices(b.column(2)).items():
                for d in sides:
                    if d == size:
                        of[d].add(unit(c) if kind == "cosine" else c, pos[rows], base + rows)
                    else:
                        unlike[d].add(np.zeros((len(rows), 1)), pos[rows], base + rows)
            base += b.num_rows
            if k is None:
                yield found()
                kept, base = [], 0
            elif base > 1 << 16:  # only the rows that are still among the best are held on to
                base = _compact(kept, [*of.values(), *unlike.values()])
        if k is not None and kept:
            yield found()

    return chunks.select("chunk_id", "pos", "embedding").mapInArrow(scan, StructType(fields))


def _compact(kept: list, parts: list[Nearest]) -> int:
    """Drops the ids of rows that no question holds any more; the number of rows left."""
    import pyarrow as pa

    used = np.unique(np.concatenate([p.row for p in parts]))
    whole = [pa.concat_arrays([k[c] for k in kept]).take(pa.array(used)) for c in (0, 1)]
    for p in parts:
        p.row = np.searchsorted(used, p.row)
    kept[:] = [tuple(whole)]
    return len(used)


def nearest(queries: DataFrame, chunks: DataFrame, k: int | None, kind: str = "cosine", least: float | None = None) -> DataFrame:
    """query_id, chunk_id, pos, score of queries(query_id, embedding) among chunks(chunk_id, pos, embedding).

    With k, a task's k best of each question, so that all best ones are among them; without, all pairs whose score is at
    least `least` (for distances, negated, at most). Vectors of unlike lengths have score 0, or an infinite distance; zero
    vectors have cosine 0. Rows without a vector, or with a null in it, are left out. pos is a whole number.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown similarity {kind!r}; known: {', '.join(KINDS)}")
    known = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()))
    rows = known.limit(QUESTIONS + 1).collect()
    parts = [rows]
    if len(rows) > QUESTIONS:
        n = -(-known.count() * 2 // QUESTIONS)
        parts = (known.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).collect() for i in range(n))  # about half of QUESTIONS each
    out = None
    for part in parts:
        one = _block_search([r.query_id for r in part], [r.embedding for r in part], chunks, k, kind, least, StructField("query_id", queries.schema["query_id"].dataType))
        out = one if out is None else out.unionByName(one)
    return out
