"""Near-duplicate documents by exact Jaccard similarity of their n-gram sets: a blocked sparse product.

Documents with equal sets are one class, and only classes are compared. The incidence of classes by n-grams is dealt
into blocks by n-gram hash, and of each class only the rows that size-derived bounds leave: if two sets of sizes
x <= y reach the similarity t, then in any fixed order of n-grams the first x - ceil(2t/(1+t) x) + 1 of the smaller
and the first y - ceil(t y) + 1 of the larger share one. The order puts n-grams that many classes hold last, so that
common passages hardly ever enter a block. A block multiplies its n-gram columns, accumulates overlap counts by pair
and drops pairs whose sizes or counts exclude t.

A column longer than SHORT gives each class a neighbour in an order of the column's own; its rows are kept. What those pairs leave
unconnected is multiplied in full in a second round, but only between different components, so a group of thousands
of copies costs its size and not its square, and no link between different texts is lost. Every pair is verified
against the whole sets. N-grams are compared as 64-bit hashes, in which two differ with odds of 2^-64 not. Sets are
equal if 128 bits of theirs are: a class has 64 of them as its number, and classes whose other 64 bits differ are told apart
by both.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from . import common, graphs

WORDS = 5
#: Columns up to this length give all pairs at once.
SHORT = 32
#: N-grams in this many classes of one task's piece are noted as common.
COMMON = 2
#: Of the common n-grams, as many as the order puts last; the order is a matter of speed alone.
COMMON_KEPT = 100_000
#: N-grams that a task counts before it passes the common ones on.
PROFILED = 2_000_000
#: Words whose hashes a worker remembers.
REMEMBERED = 150_000
#: Rows of the incidence in a block, about.
BLOCK_ROWS = 400_000
#: Pairs of a block that are counted at once, about, as often as they meet.
PIECE_PAIRS = 2_000_000
#: Members of a candidate group that one task verifies together; larger groups are cut into pairs of chunks.
CHUNK = 256
#: N-grams of such members together, about.
CHUNK_GRAMS = 4_000_000
#: Rows of a long column that are multiplied at once in the second round, from either side; a few arrays of the square of it are held.
LONG_CHUNK = 1024
#: Rows of a part of one band of sizes of a large column, and pairs of rows that a task holds at a time.
BAND_ROWS, WINDOW_PAIRS = 1 << 14, 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Eight-byte hashes by word, remembered by a worker."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        out = self[word] = xxhash.xxh3_64_digest(word)
        return out


_WORDS = WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def gram_set(text: bytes | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's n-word runs after lower-casing A-Z; all words as one if there are fewer; none without words.

    bytes.lower and bytes.split know just the letters and the white space that are asked for.
    """
    if len(_WORDS) > REMEMBERED:
        _WORDS.clear()
    words = np.frombuffer(b"".join(map(_WORDS.__getitem__, (text or b"").lower().split())), dtype="<u8")
    if not len(words):
        return words
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        out = _mixed(out * _MULT + words[i : len(words) - k + 1 + i])
    return np.unique(out)


def class_id(grams: np.ndarray, split: frozenset[int] = frozenset(), bits: int = 64) -> tuple[int, int] | tuple[None, None]:
    """Signed 64-bit number of a set, and 64 more bits of its hash; None for the empty set, which links with nothing.

    Numbers in split are those of different sets, which get a number from all of the bits. Fewer bits of the number
    than 64 are for tests.
    """
    import xxhash

    if not len(grams):
        return None, None
    whole = xxhash.xxh3_128_digest(grams.tobytes())
    number, rest = (int.from_bytes(x, "big", signed=True) for x in (whole[8:], whole[:8]))
    number >>= 64 - bits
    if number in split:
        number = int.from_bytes(xxhash.xxh3_64_digest(whole), "big", signed=True)
    return number, rest


def _sets(batches):
    """(batch, sets) of batches(doc_id, text as binary, ...). The words are forgotten at the end, so that an idle worker holds little memory."""
    try:
        for b in batches:
            yield b, [gram_set(x) for x in b.column(1).to_pylist()]
    finally:
        _WORDS.clear()
        common.release()


def profile(docs: DataFrame, split: frozenset[int] = frozenset(), bits: int = 64) -> DataFrame:
    """Written table of a single pass: rows of kind 0 are documents (doc_id, is: hash of the text, cls, rest: of the class' hash, n), of kind 1 common n-grams (cls: its hash, n: classes of a piece that hold it)."""

    def scan(batches):
        import pyarrow as pa

        seen, held, size, names = set(), [], 0, ["kind", "doc_id", "is", "cls", "rest", "n"]

        def common_rows():
            grams, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            at = counts >= COMMON
            n = int(at.sum())
            return pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(grams[at].view(np.int64)), pa.nulls(n, pa.int64()), pa.array(counts[at], pa.int64())], names=names)

        for b, sets in _sets(batches):
            numbers = [class_id(s, split, bits) for s in sets]
            classes, rest = [c for c, _ in numbers], [r for _, r in numbers]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int32()), b.column(0), b.column(2), pa.array(classes, pa.int64()), pa.array(rest, pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=names)
            for c, s in zip(classes, sets, strict=True):
                if c is not None and c not in seen:
                    seen.add(c)
                    held.append(s)
                    size += len(s)
            if size > PROFILED:
                yield common_rows()
                seen, held, size = set(), [], 0
        yield common_rows()

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("is")).mapInArrow(scan, "kind int, doc_id long, is long, cls long, rest long, n long")
    return common.written(rows, "grams-profile")


def _shares(t: float, n: int) -> tuple[int, int]:
    """Rows that a set of size n puts into blocks: as the smaller set of a pair, and as the larger."""
    eps = 1e-9
    return n - math.ceil(2 * t / (1 + t) * n - eps) + 1, n - math.ceil(t * n - eps) + 1


def incidence(docs: DataFrame, known: np.ndarray, counts: np.ndarray, blocks: int, t: float, split: frozenset[int] = frozenset(), bits: int = 64) -> DataFrame:
    """Rows of packed incidence: block, keys (hashes), flags (1: of the smaller set's share, 2: of a dealt n-gram), local class numbers, classes, sizes.

    known is sorted. An n-gram of over BLOCK_ROWS classes is dealt over several blocks by class.
    """
    deals = np.maximum(1, -(-counts // (BLOCK_ROWS // 4))).astype(np.uint64)

    def emit(batches):
        import pyarrow as pa

        names = ["block", "keys", "flags", "local", "classes", "sizes"]

        def packed(grams, flags, local, classes, sizes):
            g, f, d = np.concatenate(grams), np.concatenate(flags), np.repeat(np.arange(len(local), dtype=np.int64), local)
            cls, n = np.array(classes, np.int64), np.array(sizes, np.int32)
            block = g >> np.uint64(32)
            if len(known):
                at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                many = (known[at] == g) & (deals[at] > 1)
                f = f | np.where(many, 2, 0).astype(np.uint8)
                block = np.where(many, block + (cls[d].view(np.uint64) % deals[at]) * np.uint64(7919), block)
            block = (block % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
            out = [[] for _ in names]
            for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
                own = order[lo:hi]
                used, where = np.unique(d[own], return_inverse=True)
                for column, value in zip(out, (int(block[own[0]]), g[own].astype("<u8").tobytes(), f[own].tobytes(), where.astype("<u2").tobytes(), cls[used].astype("<i8").tobytes(), n[used].astype("<i4").tobytes()), strict=True):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], names=names)

        seen: set[int] = set()
        state: tuple = ([], [], [], [], [])
        size = 0
        for _, sets in _sets(batches):
            for s in sets:
                c, _ = class_id(s, split, bits)
                if c is None or c in seen:
                    continue
                seen.add(c)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    weight = np.where(known[at] == s, counts[at], 0)
                    if weight.any():
                        s = s[np.lexsort((s, weight))]
                index, probe = _shares(t, len(s))
                flags = np.zeros(probe, np.uint8)
                flags[:index] = 1
                for column, value in zip(state, (s[:probe], flags, probe, c, len(s)), strict=True):
                    column.append(value)
                size += probe
                if size > 400_000 or len(state[2]) >= 60_000:
                    yield packed(*state)
                    state, size = ([], [], [], [], []), 0
            if len(seen) > 1_000_000:
                seen.clear()
        if state[2]:
            yield packed(*state)

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(emit, "block long, keys binary, flags binary, local binary, classes binary, sizes binary")


def _product(pdf, t: float):
    """Of one block: pairs (kind 0: a, b) and the rows of its long columns (kind 1: key, class, size, flag)."""
    import pandas as pd

    packed = zip(*(pdf[c] for c in ("keys", "flags", "local", "classes", "sizes")), strict=True)
    parts = [(np.frombuffer(k, "<u8"), np.frombuffer(f, np.uint8), np.frombuffer(c, "<i8")[(w := np.frombuffer(d, "<u2"))], np.frombuffer(s, "<i4")[w]) for k, f, d, c, s in packed]
    keys, flags, cls, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((cls, keys))
    keys, flags, cls, n = keys[order], flags[order], cls[order], n[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1])  # a class that several tasks sent
    keys, flags, cls, n = keys[first], flags[first], cls[first], n[first]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    lengths = np.diff(np.append(starts, len(keys)))
    dealt = np.add.reduceat((flags >> 1).astype(np.int64), starts) > 0 if len(starts) else np.zeros(0, bool)
    long = (lengths > SHORT) | dealt
    # classes by their rank, so that a pair is one number; n is the same in all rows of a class
    classes, rank = np.unique(cls, return_inverse=True)
    m, size = len(classes), np.zeros(len(classes), np.int64)
    size[rank] = n
    short_row = np.repeat(~long, lengths)
    column = np.repeat(np.arange(len(starts)), lengths)
    alike = lambda x, y: np.minimum(n[x], n[y]) >= t * np.maximum(n[x], n[y]) - 1e-9

    def short_pairs(lo: int, hi: int) -> np.ndarray:
        """Pairs of the short columns that rows lo to hi hold, as often as they meet, a step of the distance within a column at a time."""
        out = [np.zeros(0, np.int64)]
        for step in range(1, min(SHORT, hi - lo)):
            x = lo + np.flatnonzero(short_row[lo : hi - step] & (column[lo : hi - step] == column[lo + step : hi]))
            if not len(x):
                break
            x = x[alike(x, x + step)]
            out.append(rank[x] * m + rank[x + step])  # a column's classes are in order
        return np.concatenate(out)

    # whole columns with about PIECE_PAIRS pairs at a time, so that memory doesn't follow the pairs as often as they meet
    pieces = np.cumsum(np.where(long, 0, lengths * (lengths - 1) // 2)) // PIECE_PAIRS
    cuts = starts[np.flatnonzero(np.diff(pieces, prepend=-1))] if len(starts) else starts
    found, met = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        pairs, times = np.unique(short_pairs(lo, hi), return_counts=True)
        found.append(pairs)
        met.append(times)
    # of a long column: neighbours in an order that is its own, so that a class meets another in every column; they come along uncounted
    rows = np.flatnonzero(np.repeat(long, lengths))
    if len(rows):
        mixed = rows[np.lexsort((_mixed(cls[rows].view(np.uint64) ^ keys[rows]), column[rows]))]
        x, y = mixed[:-1], mixed[1:]
        ok = (column[x] == column[y]) & alike(x, y)
        x, y = rank[x[ok]], rank[y[ok]]
        found.append(np.minimum(x, y) * m + np.maximum(x, y))
        met.append(np.zeros(len(x), np.int64))
    pairs, times = np.concatenate(found), np.concatenate(met)
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    begin = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, int)
    shared = np.add.reduceat(times, begin) if len(begin) else times
    x, y = np.divmod(pairs[begin], m) if len(begin) else (begin, begin)
    none = np.zeros(len(rows), np.int64)
    return pd.DataFrame({
        "kind": np.concatenate([np.zeros(len(x), np.int32), np.ones(len(rows), np.int32)]),
        "a": np.concatenate([classes[x], cls[rows]]), "b": np.concatenate([classes[y], keys[rows].view(np.int64)]),
        "n": np.concatenate([shared, n[rows].astype(np.int64)]), "flag": np.concatenate([np.zeros(len(x), np.int32), (flags[rows] & 3).astype(np.int32)]),
        "na": np.concatenate([size[x], none]), "nb": np.concatenate([size[y], none]),
    })


PRODUCT = "kind int, a long, b long, n long, flag int, na long, nb long"


def _shortfall(na, nb, t: float):
    """What two sets of these sizes have to share at least of the rows that they put into blocks.

    Of the rows after those, up to the end of the set whose rows end first, they share at most the larger of the two
    remainders, ceil(t n) - 1. Takes columns or arrays.
    """
    up, most = (F.ceil, F.greatest) if isinstance(na, Column) else (np.ceil, np.maximum)
    return up((na + nb) * (t / (1 + t)) - 1e-9) - most(up(na * t - 1e-9), up(nb * t - 1e-9)) + 1


def long_rows(made: DataFrame) -> DataFrame:
    """Written table node, rows: in how many long columns each class is."""
    return common.written(made.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("rows")), "jaccard-long")


def bounded_pairs(made: DataFrame, long: DataFrame, t: float) -> DataFrame:
    """Distinct pairs (a, b) of a product whose accumulated overlap leaves the similarity possible.

    Overlap in short columns is counted; in long columns two classes share at most as many rows as either has there.
    """
    pairs = made.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    side = common.small_side(long, long.count())
    marked = pairs.join(side.select(F.col("node").alias("a"), F.col("rows").alias("la")), "a", "left").join(side.select(F.col("node").alias("b"), F.col("rows").alias("lb")), "b", "left")
    most = F.col("shared") + F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
    return marked.where(most >= _shortfall(F.col("na"), F.col("nb"), t)).select("a", "b")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, split: frozenset[int] = frozenset(), bits: int = 64) -> DataFrame:
    """Written links (a, b) among pairs(a, b) whose whole sets reach the similarity; of links that close a circle within one task's group some are left out.

    Pairs are gathered by their candidate component, so a set is sent once for each group it is in. A component of
    over CHUNK members or CHUNK_GRAMS n-grams is cut into chunks, and each pair of chunks that has pairs is a group of its own.
    """
    comps = graphs.connected_components(pairs)
    sized = comps.join(classes.select(F.col("cls").alias("node"), "n"), "node")
    chunks = F.ceil(F.greatest(F.col("members") / CHUNK, F.col("grams") / CHUNK_GRAMS))
    large = common.written(sized.groupBy("comp").agg(F.count("*").alias("members"), F.sum("n").alias("grams")).select("comp", chunks.alias("chunks")).where("chunks > 1"), "jaccard-large")
    members = comps.join(common.small_side(large, large.count()), "comp", "left").select("node", "comp", F.coalesce(F.pmod(F.xxhash64("node"), F.col("chunks")), F.lit(0)).alias("chunk"))
    members = common.written(members, "jaccard-members")
    side = lambda c: members.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"), F.col("chunk").alias(f"chunk_{c}"))
    keyed = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.col("comp_a").alias("comp"), F.least("chunk_a", "chunk_b").alias("lo"), F.greatest("chunk_a", "chunk_b").alias("hi"))
    keyed = common.written(keyed, "jaccard-pairs")
    copies = keyed.select(F.col("a").alias("node"), "comp", "lo", "hi").union(keyed.select("b", "comp", "lo", "hi")).distinct()
    needed = common.written(members.select("node").join(classes.select(F.col("cls").alias("node"), F.col("rep").alias("doc_id")), "node"), "jaccard-needed")

    def read(batches):
        import pyarrow as pa

        for _, sets in _sets(batches):
            # a doc_id may have several texts; the set's own identity tells whose it is
            yield pa.RecordBatch.from_arrays([pa.array([class_id(s, split, bits)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "grams"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    wanted = texts.join(common.small_side(needed.select("doc_id").distinct(), needed.count()), "doc_id", "left_semi")
    if not needed.where("doc_id IS NULL").isEmpty():  # null equals no id in the join; these rows stay where they are, so no task gets them all
        wanted = wanted.union(texts.where("doc_id IS NULL"))
    sets = wanted.mapInArrow(read, "node long, grams binary").dropDuplicates(["node"])
    placed = copies.join(sets, "node").select("node", "grams", F.col("comp").alias("of"), F.col("lo").alias("first"), F.col("hi").alias("last"))

    def check(left, right):
        import pandas as pd

        grams = {k: np.frombuffer(v, np.uint64) for k, v in zip(right.node, right.grams, strict=True)}
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := up.get(x, x)) != x:
                up[x] = up.get(p, p)
                x = p
            return x

        out = []
        for a, b in zip(left.a, left.b, strict=True):
            if root(a) == root(b):
                continue
            x, y = grams[a], grams[b]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                up[root(a)] = root(b)
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    links = common.written(keyed.groupBy("comp", "lo", "hi").cogroup(placed.groupBy("of", "first", "last")).applyInPandas(check, "a long, b long"), "jaccard-links")
    common.drop_written(comps, large, members, keyed, needed)
    return links


def _allowed(x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """Whether two rows (class, component, size, flag, long rows) join components and the bounds allow them.

    A pair that also meets in a short column has been bounded there, so what long columns can give has to do.
    """
    ok = (x[0] != y[0]) & (x[1] != y[1]) & (np.minimum(x[2], y[2]) >= t * np.maximum(x[2], y[2]) - 1e-9)
    ok &= np.where(x[2] < y[2], x[3] & 1, np.where(x[2] > y[2], y[3] & 1, x[3] & y[3] & 1)).astype(bool)
    return ok & (np.minimum(x[4], y[4]) >= _shortfall(x[2], y[2], t))


def _cross(e: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the allowed pairs of a moderate column's rows."""
    x, y = e[:, :, None], e[:, None, :]
    return np.nonzero(_allowed(x, y, t) & (x[0] < y[0]))


def _partner_sizes(n, rows, t: float):
    """(least, greatest) size of a set, not larger than one of n with so many long rows, that the bounds allow beside it. Takes columns or arrays."""
    up, down, least = (F.ceil, F.floor, F.least) if isinstance(n, Column) else (np.ceil, np.floor, np.minimum)
    low = up(n * t - 1e-9)
    return low, least(n, down((rows - 1 + low) * ((1 + t) / t) - n + 1e-6))


_ENTRY = ["a", "comp", "n", "flag", "rows"]


def _columns_pairs(pdf, t: float):
    """Pairs of all columns of a group of moderate ones."""
    import pandas as pd

    pdf = pdf.sort_values(["b", "a"])
    entries, column = pdf[_ENTRY].to_numpy().T, pdf.b.to_numpy()
    cuts = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    out = []
    for lo, hi in zip(cuts, [*cuts[1:], len(column)], strict=True):
        e = entries[:, lo:hi]
        p, q = _cross(e, t)
        out.append(np.stack([e[0][p], e[0][q]]))
    pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
    return pd.DataFrame({"a": pairs[0], "b": pairs[1]})


def _window_pairs(left, right, t: float):
    """Pairs of a row of left and one of right, from rows of one large column, whose size is in the left one's window; pieces of them are held at a time."""
    import pandas as pd

    x, y = left[_ENTRY].to_numpy().T, right.sort_values("of_n")[[f"of_{c}" for c in _ENTRY]].to_numpy().T
    low, high = _partner_sizes(x[2], x[4], t)
    begin, end = np.searchsorted(y[2], low, "left"), np.searchsorted(y[2], high, "right")
    size = np.maximum(0, end - begin)
    ends, at, out = np.cumsum(size), 0, []
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WINDOW_PAIRS, "right")))
        s = size[at:upto]
        p = np.repeat(np.arange(at, upto), s)
        q = np.repeat(begin[at:upto] - (np.cumsum(s) - s), s) + np.arange(len(p))
        ok = _allowed(x[:, p], y[:, q], t)
        out.append(np.stack([x[0][p[ok]], y[0][q[ok]]]))
        at = upto
    pairs = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return pd.DataFrame({"a": pairs.min(axis=0), "b": pairs.max(axis=0)})


def second_pairs(made: DataFrame, long: DataFrame, comps: DataFrame, t: float) -> DataFrame:
    """Distinct pairs (a, b) that long columns give between different components. A column of over LONG_CHUNK classes isn't multiplied as a whole: its rows meet those in their windows of sizes."""
    entries = made.where("kind = 1").select("a", "b", "n", F.col("flag").cast("long").alias("flag")).distinct()
    entries = entries.join(common.small_side(long, long.count()).select(F.col("node").alias("a"), "rows"), "a")
    spread = entries.join(comps.select(F.col("node").alias("a"), "comp"), "a", "left").withColumn("comp", F.coalesce("comp", "a"))
    # a pair's need falls to 0 only as its sizes part to 1 : t, so a column's sizes and rows can't decide it as a whole
    mixed = spread.groupBy("b").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("b", "size")
    open_ = common.written(spread.join(mixed, "b"), "jaccard-open")
    groups = max(int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")), open_.count() // 200_000)
    fields = ["a", "b", "n", "flag", "comp", "rows"]
    small = open_.where(F.col("size") <= LONG_CHUNK).withColumn("g", F.pmod(F.xxhash64("b"), F.lit(groups))).select("g", *fields)
    moderate = small.groupBy("g").applyInPandas(lambda pdf: _columns_pairs(pdf, t), "a long, b long")
    # in a large column the larger set of a pair looks up the sizes that the bounds allow beside it, in bands of a hundredth
    cut = open_.where(F.col("size") > LONG_CHUNK)
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(1.01)).cast("int")
    low, high = _partner_sizes(F.col("n"), F.col("rows"), t)
    below = cut.select(*fields, band(F.col("n")).alias("band"))
    sizes = below.groupBy("b", "band").agg(F.ceil(F.count("*") / BAND_ROWS).alias("parts"))
    bands = common.written(sizes, "jaccard-bands")
    n_bands = bands.count()
    with_parts = lambda df: df.join(common.small_side(bands, n_bands), ["b", "band"])
    smaller = with_parts(below).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts"))).select(*(F.col(c).alias(f"of_{c}") for c in [*fields, "band", "part"]))
    windows = cut.where(low <= high).select(*fields, F.explode(F.sequence(band(low), band(high))).alias("band"))
    larger = with_parts(windows).select(*fields, "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    keys = ["b", "band", "part"]
    large = larger.groupBy(*keys).cogroup(smaller.groupBy(*(f"of_{k}" for k in keys))).applyInPandas(lambda x, y: _window_pairs(x, y, t), "a long, b long")
    return moderate.union(large).distinct()


def common_grams(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the most common n-grams of a profile, COMMON_KEPT at most.

    The driver gets no more than it keeps.
    """
    counted = common.written(seen.where("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")), "grams-common")
    top = sorted(((r.cls & 0xFFFFFFFFFFFFFFFF, r.n) for r in counted.where(common.frequent(counted, "cls", "n", COMMON_KEPT)).collect()))
    common.drop_written(counted)
    return np.array([c for c, _ in top], np.uint64), np.array([n for _, n in top], np.int64)


def components(docs: DataFrame, percent: int = 75, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text, ...).

    Rows link when 100 * shared >= percent * union of their sets; component_id is the smallest doc_id reachable. Null
    and empty texts and texts of white space have no set and are components of their own. Rows that repeat a doc_id
    are each placed by their own text. A null doc_id is given back as null and is never a component's name unless no
    other row of its component has one. A very long text is compared by its
    whole set. Extra columns are ignored; an empty table gives no rows.
    """
    seen, final = _final(docs, percent, bits)
    return place(seen.where("kind = 0"), final).select("doc_id", "n_shingles", "component_id")


def told_apart(docs: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """(profile, written table cls, rep, n, copies of all classes, numbers that different sets had).

    Of n sets about n^2 / 2^65 numbers are those of two, 270 of 1e11; then the pass is done again with these known.
    """
    split: frozenset[int] = frozenset()
    while True:
        seen = profile(docs, split, bits)
        sets = seen.where("kind = 0 AND cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies"), (F.min("rest") != F.max("rest")).alias("several"))
        classes = common.written(sets, "jaccard-classes")
        shared = frozenset(r.cls for r in classes.where("several").select("cls").collect())
        if not shared:
            return seen, classes, split
        split |= shared
        common.drop_written(seen, classes)


def _final(docs: DataFrame, percent: int, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(profile, written table cls, component_id, keeper, copies): of every class its component's name and the component's class that holds it."""
    spark, t = docs.sparkSession, percent / 100
    common.small_batches(spark)
    seen, classes, split = told_apart(docs, bits)
    grams, counts = common_grams(seen)
    total = classes.agg(F.sum("n")).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * (1 - t) / BLOCK_ROWS))
    packed = incidence(docs, grams, counts, blocks, t, split, bits)
    made = common.written(packed.groupBy("block").applyInPandas(lambda pdf: _product(pdf, t), PRODUCT), "jaccard-product")
    long = long_rows(made)
    pairs = common.written(bounded_pairs(made, long, t), "jaccard-candidates")
    links = verified(pairs, classes, docs, percent, split, bits)
    comps = graphs.connected_components(links)
    more = common.written(second_pairs(made, long, comps, t), "jaccard-second")
    if not more.isEmpty():
        added = verified(more, classes, docs, percent, split, bits)
        after = graphs.connected_components(links.union(added))
        common.drop_written(comps, added)
        comps = after
    reps = classes.select("cls", "rep", "copies")
    named = comps.join(reps.select(F.col("cls").alias("node"), "rep"), "node")
    # of each component the least id, and the first of the classes that hold it
    least = named.groupBy("comp").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "node")).alias("m")).select("comp", F.col("m.rep").alias("component_id"), F.col("m.node").alias("keeper"))
    linked = graphs.by_label(comps, comps.count(), least).select(F.col("node").alias("cls"), "component_id", "keeper")
    final = common.written(reps.join(linked, "cls", "left").select("cls", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("keeper", "cls").alias("keeper"), "copies"), "jaccard-final")
    common.drop_written(made, long, pairs, links, comps, more, classes)
    return seen, final


def place(rows: DataFrame, final: DataFrame) -> DataFrame:
    """doc_id, is, n_shingles, component_id, cls, keeper of rows(doc_id, is, cls, n). Classes of many copies are few and are broadcast, so no task gets all copies of one."""
    hot = final.where("copies > 1000").orderBy(F.desc("copies"), "cls").limit(common.BROADCAST_ROWS).select("cls", "component_id", "keeper")
    cols = lambda df: df.select("doc_id", "is", F.col("n").alias("n_shingles"), "component_id", "cls", "keeper")
    none = rows.where("cls IS NULL").select("doc_id", "is", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "cls", F.col("cls").alias("keeper"))
    some = rows.where("cls IS NOT NULL")
    marked = some.join(F.broadcast(hot), "cls")
    rest = some.join(F.broadcast(hot.select("cls")), "cls", "left_anti").join(final.select("cls", "component_id", "keeper"), "cls")
    return cols(marked).union(cols(rest)).union(none)


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs that stand for their component: of every group of near-duplicates one text, with the smallest id.

    Rows are told apart by id and text, so of a repeated id only the rows whose own text has to go do. Of texts with the
    smallest id, or of texts without any id, that with the least set identity stays. Rows alike in id and text are one
    document and stay or go together. Null and empty texts and texts of white space stay. Extra columns stay, whatever
    their names; a very long text is compared as a whole; an empty table gives no rows.
    """
    seen, final = _final(docs, percent)
    leaves = ~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("cls") == F.col("keeper")))
    gone = place(seen.where("kind = 0 AND cls IS NOT NULL"), final).where(leaves).select(F.col("doc_id").alias("granary_id"), F.col("is").alias("granary_is")).distinct()
    out = common.written(gone, "jaccard-gone")
    common.drop_written(seen, final)
    side = common.small_side(out, out.count())
    return docs.join(side, docs["doc_id"].eqNullSafe(side["granary_id"]) & (F.xxhash64(docs["text"]) == side["granary_is"]), "left_anti")
