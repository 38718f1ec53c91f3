"""Ranked lexical search over a tiered index, exact for every question.

The index has a row for each document: its asked terms and their occurrences. A posting's impact is the term's part in the
document's score without the term's weight. Each upper tier holds every term's postings of the highest impacts, at least
its first TIERS[k], and for every term the residual bound: the highest impact of its postings further down.

Questions start in the topmost tier, where only few postings are read. What is found there of a document is a lower bound
of its score, and with the residual bounds of the question's other terms an upper bound. If no document that the tier
doesn't hold can reach the k-th best lower bound, the documents whose upper bounds reach it are scored in full, and the
answer is exact. A question without that proof falls through to the next tier, and at last to the whole index.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

TOP = 20
#: Postings of a term that an upper tier holds at least, tier by tier.
TIERS = (64, 2048)
#: Steps of impact (of below 2^20), by which tiers are cut.
STEP = 12
#: Documents of a question whose bounds reach the k-th best, at most; a question with more falls through.
CANDIDATES = 2_000
#: Pairs of a question and a term that are searched at a time; more questions are taken in blocks.
PAIRS = 20_000
#: Products of a weight and an impact that a task holds at a time.
CELLS = 1 << 21
_HIGH = 1 << 62


def asked_terms(items: DataFrame) -> DataFrame:
    """Written table item (number of the row), item_id, term, times of items(item_id, text)."""

    def scan(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for item, item_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), common.byte_texts(b.column(2)), strict=True):
                times = Counter()
                for piece in common.term_pieces(text):
                    times.update(piece)
                rows += [(item, item_id, t.decode("utf-8", "replace"), k) for t, k in sorted(times.items())]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.int64()], strict=True)], names=["item", "item_id", "term", "times"])

    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return common.written(numbered.mapInArrow(scan, "item long, item_id long, term string, times long"), "search-asked")


class Asked:
    """A block of questions: their terms by number, and the pairs of a term and a question, by term."""

    def __init__(self, rows: list) -> None:
        self.terms = sorted({r.term for r in rows})
        number = {t: i for i, t in enumerate(self.terms)}
        self.items = sorted({(r["item"], r.item_id) for r in rows}, key=lambda x: x[0])
        place = {x[0]: i for i, x in enumerate(self.items)}
        pairs = sorted((number[r.term], place[r["item"]], r.times) for r in rows)
        self.pair_term, self.pair_item, self.pair_times = (np.array([p[k] for p in pairs], np.int64) for k in range(3))

    def of(self, active: np.ndarray, weight: np.ndarray):
        """(term, item, weight times repeats) of the pairs of the active questions."""
        keep = active[self.pair_item]
        return self.pair_term[keep], self.pair_item[keep], (self.pair_times * weight[self.pair_term])[keep]


def index(docs: DataFrame, terms: list[str]) -> tuple[DataFrame, int, int]:
    """Written table row, doc_id, n (terms with repeats), terms (numbers), times of the documents that hold any of the terms; N and L of all documents."""

    def scan(batches):
        import pyarrow as pa

        number = {t.encode(): i for i, t in enumerate(terms)}
        for b in batches:
            lengths, sizes, flat, times = [], [], [], []
            for text in common.byte_texts(b.column(2)):
                found = Counter()
                for piece in common.term_pieces(text):
                    found.update(piece)
                lengths.append(found.total())
                own = sorted((number[t], k) for t, k in found.items() if t in number)
                sizes.append(len(own))
                flat += [p[0] for p in own]
                times += [p[1] for p in own]
            keep = pa.array([s > 0 or n > 0 for s, n in zip(sizes, lengths, strict=True)])
            at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(v, k)) for v, k in ((flat, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lengths, pa.int64()), *lists], names=["row", "doc_id", "n", "terms", "times"]).filter(keep)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = common.written(rows.mapInArrow(scan, "row long, doc_id long, n long, terms array<int>, times array<long>"), "search-index")
    size = out.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return out, size[0], size[1]


def impacts(times: np.ndarray, n: np.ndarray, big_n: int, big_l: int) -> np.ndarray:
    """Impacts of postings from their occurrences and their documents' lengths, in whole numbers."""
    m = 75 + (25 * n * big_n) // max(1, big_l)
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


def _lists(batch):
    """Of a batch (row, doc_id, n, terms, times): document of each posting, its term and its times."""
    terms, times = batch.column(3), batch.column(4)
    sizes = np.diff(terms.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), sizes), terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64), times.flatten().to_numpy(zero_copy_only=False)


def _by_key(key: np.ndarray, count: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple:
    """Keys once each, with the sums, greatest and least values of their rows."""
    if not len(key):
        return key, count, high, low
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[begin], np.add.reduceat(count[order], begin), np.maximum.reduceat(high[order], begin), np.minimum.reduceat(low[order], begin)


def term_levels(found: DataFrame, n_terms: int, big_n: int, big_l: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """df by term, and for each upper tier its least impact by term and the highest one below it (-1 for none)."""
    levels = (1 << 20) >> STEP

    def scan(batches):
        import pyarrow as pa

        cells = tuple(np.zeros(0, np.int64) for _ in range(4))
        waiting: list[tuple] = []
        for b in batches:
            doc, term, times = _lists(b)
            p = impacts(times, b.column(2).to_numpy()[doc], big_n, big_l)
            waiting.append(_by_key(term * levels + (p >> STEP), np.ones(len(p), np.int64), p, p))
            if sum(len(w[0]) for w in waiting) > CELLS:
                cells, waiting = _by_key(*map(np.concatenate, zip(cells, *waiting, strict=True))), []
        key, *rest = _by_key(*map(np.concatenate, zip(cells, *waiting, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(key // levels, pa.int32()), pa.array(key % levels, pa.int32()), *(pa.array(c, pa.int64()) for c in rest)], names=["term", "level", "n", "high", "low"])

    cells = found.mapInArrow(scan, "term int, level int, n long, high long, low long").groupBy("term", "level").agg(F.sum("n").alias("n"), F.max("high").alias("high"), F.min("low").alias("low"))
    # windows over a term's levels, of which there are 2^20 >> STEP at most
    down = Window.partitionBy("term").orderBy(F.desc("level"))
    placed = cells.withColumn("above", F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums: list[Column] = [F.sum("n").alias("df")]  # levels above the cut, and the one in which it falls, are in the tier
    for k, size in enumerate(TIERS):
        sums += [F.min(F.when(F.col("above") < size, F.col("low"))).alias(f"least{k}"), F.coalesce(F.max(F.when(F.col("above") >= size, F.col("high"))), F.lit(-1)).alias(f"rest{k}")]
    df, least, rest = np.zeros(n_terms, np.int64), [np.zeros(n_terms, np.int64) for _ in TIERS], [np.full(n_terms, -1, np.int64) for _ in TIERS]
    for r in placed.groupBy("term").agg(*sums).collect():  # a row for each term of the block
        df[r.term] = r.df
        for k in range(len(TIERS)):
            least[k][r.term], rest[k][r.term] = r[f"least{k}"], r[f"rest{k}"]
    return df, least, rest


def upper_tier(found: DataFrame, least: np.ndarray, big_n: int, big_l: int) -> DataFrame:
    """Written table of the postings of found with at least the least impacts of their terms; documents without any are left out."""

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            doc, term, times = _lists(b)
            keep = impacts(times, b.column(2).to_numpy()[doc], big_n, big_l) >= least[term]
            sizes = np.bincount(doc[keep], minlength=b.num_rows)
            at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(v[keep], k)) for v, k in ((term, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *lists], names=["row", "doc_id", "n", "terms", "times"]).filter(pa.array(sizes > 0))

    return common.written(found.mapInArrow(cut, "row long, doc_id long, n long, terms array<int>, times array<long>"), "search-tier")


def products(doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_docs: int, pairs, n_items: int) -> np.ndarray:
    """(n_items, n_docs) sums of weight times value over the terms that a question and a document share: the product of the sparse matrices of questions and documents."""
    pair_term, pair_item, weight = pairs
    order = np.argsort(term, kind="stable")
    sorted_term = term[order]
    lo, hi = np.searchsorted(sorted_term, pair_term, "left"), np.searchsorted(sorted_term, pair_term, "right")
    size = hi - lo
    out = np.zeros(n_items * n_docs, np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
        s = size[at:upto]
        if s.sum():
            first = np.repeat(lo[at:upto] - (np.cumsum(s) - s), s)
            idx = order[first + np.arange(s.sum())]
            np.add.at(out, np.repeat(pair_item[at:upto], s) * n_docs + doc[idx], np.repeat(weight[at:upto], s) * value[idx])
        at = upto
    return out.reshape(n_items, n_docs)


class Best:
    """The k best (score, then least doc_id) of each question so far."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.item, self.score, self.doc, self.known = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, scores: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        """Scores by question and document; known is 0 for documents without an id, which come first among equals."""
        item, at = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        new = (item, scores[item, at], doc[at], known[at])
        item, score, doc, known = (np.concatenate(x) for x in zip((self.item, self.score, self.doc, self.known), new, strict=True))
        order = np.lexsort((doc, known, -score, item))
        item = item[order]
        begin = np.searchsorted(item, item, "left")
        keep = np.arange(len(item)) - begin < self.k
        order = order[keep]
        self.item, self.score, self.doc, self.known = item[keep], score[order], doc[order], known[order]
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.least)) == self.k)
        last = np.searchsorted(self.item, full, "right") - 1
        self.least[full] = np.maximum(1, self.score[last])


def best_of(found: DataFrame, pairs, n_items: int, k: int, big_n: int, big_l: int) -> DataFrame:
    """item (place in the block), doc_id, score of the k best documents of every question in found, by task."""

    def scan(batches):
        import pyarrow as pa

        best = Best(n_items, k)
        for b in batches:
            doc, term, times = _lists(b)
            scores = products(doc, term, impacts(times, b.column(2).to_numpy()[doc], big_n, big_l), b.num_rows, pairs, n_items)
            ids = b.column(1)
            best.add(scores, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int32()), pa.array(best.doc, pa.int64(), mask=best.known == 0), pa.array(best.score, pa.int64())], names=["item", "doc_id", "score"])

    return found.mapInArrow(scan, "item int, doc_id long, score long")


def first(df: DataFrame, k: int) -> DataFrame:
    """The k best of each question, with rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id")))).where(F.col("rank") <= k)


def reaching(tier: DataFrame, pairs, bound: np.ndarray, need: np.ndarray, rest: np.ndarray, big_n: int, big_l: int) -> DataFrame:
    """item, n and rows of the documents of a tier whose upper bounds reach need. bound is that of a document of which the tier holds nothing. A task sends the rows of CANDIDATES + 1 at most, but counts all."""
    floor = np.maximum(rest, 0)
    n_items = len(bound)

    def scan(batches):
        import pyarrow as pa

        count, rows = np.zeros(n_items, np.int64), [[] for _ in range(n_items)]
        for b in batches:
            doc, term, times = _lists(b)
            more = impacts(times, b.column(2).to_numpy()[doc], big_n, big_l) - floor[term]
            upper = products(doc, term, more, b.num_rows, pairs, n_items) + bound[:, None]
            item, at = np.nonzero(upper >= need[:, None])
            for i, r in zip(item.tolist(), b.column(0).to_numpy()[at].tolist(), strict=True):
                count[i] += 1
                if count[i] <= CANDIDATES + 1:
                    rows[i].append(r)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some], pa.int64()), pa.array([rows[i] for i in some], pa.list_(pa.int64()))], names=["item", "n", "rows"])

    return tier.mapInArrow(scan, "item int, n long, rows array<long>")


def _block(docs: DataFrame, asked: Asked, k: int) -> tuple[DataFrame, np.ndarray]:
    """Written table item (place), doc_id, score, rank of a block of questions, and by question the tier that proved it (len(TIERS): the whole index)."""
    n_items, n_terms = len(asked.items), len(asked.terms)
    found, big_n, big_l = index(docs, asked.terms)
    df, least, rest = term_levels(found, n_terms, big_n, big_l)
    weight = np.array([math.floor(1000 * math.log((2 * big_n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    proved, out = np.full(n_items, len(TIERS)), []
    active = np.ones(n_items, bool)
    for t in range(len(TIERS)):
        tier = upper_tier(found, least[t], big_n, big_l)
        pairs = asked.of(active, weight)
        # what a document can get from terms of which the tier doesn't hold its posting
        bound = np.zeros(n_items, np.int64)
        np.add.at(bound, pairs[1], pairs[2] * np.maximum(rest[t], 0)[pairs[0]])
        low = first(best_of(tier, pairs, n_items, k, big_n, big_l), k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("low"))
        need = np.full(n_items, _HIGH)
        for r in low.collect():  # a row for each question
            if bound[r["item"]] == 0 or r.n == k and bound[r["item"]] < r.low:
                need[r["item"]] = r.low if r.n == k else 1
        hopeful = active & (need < _HIGH)
        if hopeful.any():
            near = common.written(reaching(tier, asked.of(hopeful, weight), bound, need, rest[t], big_n, big_l), "search-near")
            sure = np.zeros(n_items, bool)
            sure[[r["item"] for r in near.groupBy("item").agg(F.sum("n").alias("n")).where(F.col("n") <= CANDIDATES).collect()]] = True
            sure &= hopeful
            chosen = near.where(F.col("item").isin([int(i) for i in np.flatnonzero(sure)])).select(F.explode("rows").alias("near_row")).distinct() if sure.any() else None
            if chosen is not None:
                side = common.written(chosen, "search-rows")
                whole = found.join(common.small_side(side, side.count()), F.col("row") == F.col("near_row"), "left_semi")
                out.append(common.written(first(best_of(whole, asked.of(sure, weight), n_items, k, big_n, big_l), k), "search-best"))
                common.drop_written(side)
                proved[sure] = t
                active &= ~sure
            common.drop_written(near)
        common.drop_written(tier)
        if not active.any():
            break
    if active.any() or not out:
        out.append(common.written(first(best_of(found, asked.of(active, weight), n_items, k, big_n, big_l), k), "search-best"))
    common.drop_written(found)
    whole = out[0]
    for o in out[1:]:
        whole = whole.union(o)
    return whole, proved


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of every row of items(item_id, text, ...) in docs(doc_id, text, ...), scores above 0 alone.

    Equal scores are ranked by doc_id, a null one first. Null and empty texts, and texts without terms, are found by
    nothing and find nothing; a question whose terms no document holds has no rows. Repeated rows of docs each take a
    place; repeated rows of items each have their own ranks. Texts of any length count whole. Extra columns of either table
    are ignored; an empty table gives no rows. Questions are searched in blocks of about PAIRS terms, each of which reads
    docs once.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    known = asked_terms(items)
    blocks = max(1, math.ceil(known.count() / PAIRS))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for i in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).collect()  # about PAIRS rows
        if not rows:
            continue
        asked = Asked(rows)
        best, _ = _block(docs, asked, k)
        names = spark.createDataFrame([(n, x[1]) for n, x in enumerate(asked.items)], "place int, item_id long")
        out = out.union(best.join(F.broadcast(names), F.col("item") == F.col("place")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
