"""Masked pseudo-likelihood: a bidirectional window network predicts every token from the tokens on both sides, and a
document's score is the sum of the logarithms of these conditional probabilities.

The vocabulary is that of the corpus: a written table with the count of every distinct token. Tokens by falling count
are cut into SIDE classes of about equal mass and every class into SIDE cells. The network sees the cells of the WINDOW
tokens on either side and gives the probability of the token's class, and, by weights of that class' own, of the cell
inside it; frequent tokens have a cell each. Tokens of one cell share its probability by their own counts. Counts
of the TOP most frequent tokens are held by every worker; those of all others are joined from the vocabulary.

Training is one pass over all tokens in ROUNDS. Documents are dealt to rounds and parts by a hash of doc_id, as many
parts as the corpus' bytes need, so neither depends on how the table is partitioned. In a round every part trains on
its own tokens, from the mean of the networks that the round before gave; networks are weighted by their tokens and
summed as whole numbers, so the order of the sums doesn't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import common, hashing

SIDE = 48
CELLS = SIDE * SIDE
#: Cell of places before and after a document.
EDGE = CELLS
WINDOW = 2
PLACES = [o for o in range(-WINDOW, WINDOW + 1) if o]
HIDDEN = 16
BATCH = 4096
RATE = 0.8
#: A row of the input layer moves by the mean of its gradients in a batch, held back as if by so many more that are 0; likewise the weights of a class.
PRIOR, CLASS_PRIOR = 8.0, 64
SEED = 11
ROUNDS = 4
#: UTF-8 bytes of texts that one part trains on, about. A part that gets OVERSIZE times this is cut up by row.
PART_BYTES = 16 << 20
OVERSIZE = 4
#: Partitions that parts are dealt over, at most.
PARTITIONS = 20_000
#: Tokens whose counts every worker holds, at most.
TOP = 1 << 18
#: Bins, by hash, in which the network sees all others.
TAIL_BINS = 64
#: Tokens of a pack, about; a longer document is cut into packs of its own.
PACK = 1 << 18
#: Characters that are split into tokens at once.
SLICE = 1 << 20
#: Weights of a row in which networks are sent, and the whole numbers that stand for 1.
COLUMNS, UNIT = 64, 1 << 20
_ONES = np.ones((SIDE, 1), np.float32)


# --- tokens --------------------------------------------------------------------------------------------------------
#: Base of the hash of a token, the sum of its characters' numbers times the base's powers modulo 2^64, and the base's inverse.
BASE = 0x9E3779B97F4A7C15
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """By code point, whether a character is white space (0), of words (1) or a mark (2), and its number; powers of the base and of its inverse. Made once by a worker."""
    if not _TABLES:
        import re

        every = "".join(map(chr, range(0x110000)))
        kind = np.full(0x110000, 2, np.uint8)
        for i, pattern in ((0, r"\s"), (1, r"\w")):
            kind[np.frombuffer("".join(re.findall(pattern, every)).encode("utf-32-le", "surrogatepass"), "<u4")] = i
        numbers = np.random.default_rng(SEED).integers(1, 1 << 63, 0x110000, dtype=np.uint64)
        power = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(SLICE, b, np.uint64))])
        _TABLES.extend((kind, numbers, power(BASE), power(pow(BASE, -1, 1 << 64))))
    return _TABLES


def _hashed(text: str) -> np.ndarray:
    """Hashes of the tokens of at most SLICE characters: a token's sum is a difference of running sums, shifted to power 0."""
    kind, numbers, powers, inverses = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.zeros(len(points) + 2, np.uint8)
    np.take(kind, points, out=kinds[1:-1])
    cut = np.flatnonzero(kinds[1:] != kinds[:-1])  # runs of one kind begin and end here
    word = kinds[cut[:-1] + 1] > 0
    first, last = cut[:-1][word], cut[1:][word]
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(np.take(numbers, points) * powers[: len(points)], out=sums[1:])
    h = (sums[last] - sums[first]) * inverses[first]
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's tokens, which are runs of word characters and runs of marks, in order; null and empty texts have none.

    A longer text is cut into slices before a white space; a slice without any ends where SLICE ends, in the middle of a token.
    """
    import re

    text = text or ""
    if len(text) <= SLICE:
        return _hashed(text) if text else np.zeros(0, np.int64)
    out, at, space = [], 0, re.compile(r"\s")
    while at < len(text):
        end = min(at + SLICE, len(text))
        if end < len(text):
            blanks = space.finditer(text, end - min(SLICE - 1, 4096), end + 1)
            end = max((m.start() for m in blanks), default=end)
        out.append(_hashed(text[at:end]))
        at = end
    return np.concatenate(out)


def packed(rows):
    """Packs of one part's rows (row, doc_id, hashes): dicts with the distinct hashes (vocab), the tokens as their places
    in it (codes), and rows, ids and lengths of the documents. A piece of a long document has WINDOW tokens of its
    neighbour pieces as margins (lead, trail), which are context alone."""

    def pack(entries, lead=0, trail=0):
        vocab, codes = np.unique(np.concatenate([h for _, _, h in entries]), return_inverse=True)
        wide = np.uint16 if len(vocab) <= 1 << 16 else np.uint32
        return {
            "rows": [r for r, _, _ in entries], "ids": [i for _, i, _ in entries], "lengths": [len(h) for _, _, h in entries], "lead": lead, "trail": trail,
            "vocab": vocab.astype("<i8"), "codes": codes.astype(wide),
        }

    held, size = [], 0
    for row, doc_id, h in rows:
        if len(h) > PACK:
            for lo, hi in hashing.pieces(h, PACK):
                a, b = max(0, lo - WINDOW), min(len(h), hi + WINDOW)
                yield pack([(row, doc_id, h[a:b])], lo - a, b - hi)
            continue
        if held and size + len(h) > PACK:
            yield pack(held)
            held, size = [], 0
        held.append((row, doc_id, h))
        size += len(h)
    if held:
        yield pack(held)


def lined(pack: dict, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells of a pack's tokens with WINDOW edges between documents and at open ends, places of the tokens in it); the first and last WINDOW are context alone."""
    codes, lengths = pack["codes"], np.asarray(pack["lengths"], np.int64)
    lead, trail = pack["lead"], pack["trail"]
    where = np.arange(len(codes)) + np.repeat(WINDOW * (np.arange(len(lengths)) + (0 if lead else 1)), lengths)
    line = np.full(len(codes) + WINDOW * (len(lengths) + 1 - (lead > 0) - (trail > 0)), EDGE, np.uint16)
    line[where] = np.take(cells, codes)
    return line, where


def dealt(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with round, deal and sub: which round and part a row trains in. Rows of an oversized part, such as those of one
    repeated id, are cut up by their place in the table."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(size)).first()[0] or 0
    parts = ROUNDS * max(1, -(-total // (ROUNDS * PART_BYTES)))
    placed = docs.withColumn("deal", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(parts)))
    over = common.written(placed.groupBy("deal").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > OVERSIZE * PART_BYTES), "scoring-oversized")
    n = over.count()
    if n:
        subs = over.select("deal", F.ceil(F.col("bytes") / PART_BYTES).alias("subs"))
        spread = placed.withColumn("place", F.monotonically_increasing_id()).join(common.small_side(subs, n), "deal", "left")
        placed = spread.withColumn("sub", F.coalesce(F.pmod(F.xxhash64("place"), F.col("subs")), F.lit(0)).cast("long")).drop("place", "subs")
    else:
        placed = placed.withColumn("sub", F.lit(0).cast("long"))
        common.drop_written(over)
    keyed = placed.withColumns({"round": (F.col("deal") % ROUNDS).cast("int"), "h": F.xxhash64("doc_id", "text")})
    # a partition may get several parts, one after the other, so their number is bounded whatever the input
    return keyed.repartition(min(parts, PARTITIONS), "deal", "sub").sortWithinPartitions("deal", "sub", "h", "doc_id")


PACKS = "round int, deal long, sub long, seq int, lead int, trail int, rows array<long>, ids array<long>, lengths array<int>, codes binary, vocab binary, hash long, n long"


def packs(docs: DataFrame) -> DataFrame:
    """Written table of all documents as packs (by round), and of the tokens of every part with their counts (round -1)."""

    def tokenise(batches):
        import pyarrow as pa

        schema = pa.schema([("round", pa.int32()), ("deal", pa.int64()), ("sub", pa.int64()), ("seq", pa.int32()), ("lead", pa.int32()), ("trail", pa.int32()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("codes", pa.binary()), ("vocab", pa.binary()), ("hash", pa.int64()), ("n", pa.int64())])

        def table(height: int, **columns):
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(height, f.type) for f in schema], schema=schema)

        def counted(held):
            vocab, place = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
            n = np.bincount(place, np.concatenate([c for _, c in held])).astype(np.int64)
            return table(len(vocab), round=pa.array(np.full(len(vocab), -1, np.int32)), hash=pa.array(vocab), n=pa.array(n))

        from itertools import groupby

        def rows():
            row = TaskContext.get().partitionId() << 40
            for b in batches:
                for doc_id, text, deal, sub, r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    yield (r, deal, sub), (row, doc_id, token_hashes(text))
                    row += 1

        for (r, deal, sub), own in groupby(rows(), key=lambda x: x[0]):
            held, distinct = [], 0
            for seq, p in enumerate(packed(x for _, x in own)):
                inner = p["codes"][p["lead"] : len(p["codes"]) - p["trail"]]
                held.append((p["vocab"], np.bincount(inner, minlength=len(p["vocab"]))))
                distinct += len(p["vocab"])
                one = {"round": r, "deal": deal, "sub": sub, "seq": seq, "lead": p["lead"], "trail": p["trail"], "rows": p["rows"], "ids": p["ids"], "lengths": p["lengths"], "codes": p["codes"].tobytes(), "vocab": p["vocab"].tobytes()}
                yield table(1, **{k: pa.array([v], schema.field(k).type) for k, v in one.items()})
                if distinct > 1_000_000:
                    yield counted(held)
                    held, distinct = [], 0
            if held:
                yield counted(held)

    common.small_batches(docs.sparkSession)
    rows = dealt(docs).select("doc_id", "text", "deal", "sub", "round").mapInArrow(hashing.forgetting(tokenise), PACKS)
    return common.written(rows, "scoring-packs", "round")


def unpacked(b, i: int) -> dict:
    """Row i of a batch of packs(lead, trail, rows, ids, lengths, codes, vocab, ...)."""
    get = lambda c: b.column(c)[i].as_py()
    vocab = np.frombuffer(get("vocab"), "<i8")
    codes = np.frombuffer(get("codes"), np.uint16 if len(vocab) <= 1 << 16 else np.uint32)
    return {"rows": get("rows"), "ids": get("ids"), "lengths": get("lengths"), "lead": get("lead"), "trail": get("trail"), "vocab": vocab, "codes": codes}


# --- vocabulary ----------------------------------------------------------------------------------------------------
class Vocabulary:
    """Cells of all tokens and, in logarithms, the shares that tokens have of their cells. Tokens beyond the most frequent ones are the tail: their share lacks their own count."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int) -> None:
        by_hash = np.argsort(hashes)
        self.hashes, counts = hashes[by_hash], counts[by_hash]
        order = np.lexsort((self.hashes, -counts))
        tail = max(0, total - int(counts.sum()))
        mass = np.concatenate([counts[order].astype(float), np.full(TAIL_BINS, tail / TAIL_BINS)])
        whole = max(mass.sum(), 1.0)
        middle = np.cumsum(mass) - mass / 2
        of = np.minimum((SIDE * middle / whole).astype(np.int64), SIDE - 1)
        size = np.bincount(of, mass, SIDE)
        inside = middle - (np.cumsum(size) - size)[of]
        cell = of * SIDE + np.clip((SIDE * inside / np.maximum(size[of], 1e-300)).astype(np.int64), 0, SIDE - 1)
        self.mass = np.bincount(cell, mass, CELLS)
        n = len(order)
        self.cells, self.share = np.zeros(n, np.uint16), np.zeros(n)
        self.cells[order] = cell[:n]
        self.share[order] = np.log(np.maximum(mass[:n], 1)) - np.log(np.maximum(self.mass[cell[:n]], 1))
        self.tail_cells = cell[n:].astype(np.uint16)
        self.tail_share = -np.log(np.maximum(self.mass[cell[n:]], 1))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, share, whether it is of the tail) of tokens."""
        bin_ = (hashes.view(np.uint64) >> np.uint64(32)) % np.uint64(TAIL_BINS)
        if not len(self.hashes):
            return self.tail_cells[bin_], self.tail_share[bin_], np.ones(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        tail = self.hashes[at] != hashes
        return np.where(tail, self.tail_cells[bin_], self.cells[at]), np.where(tail, self.tail_share[bin_], self.share[at]), tail


def vocabulary(made: DataFrame) -> tuple[DataFrame, Vocabulary, Column]:
    """(written table hash, n of all tokens, what workers hold of it, the condition on its rows that they hold).

    The driver gets no more than TOP rows, however many tokens are frequent.
    """
    table = common.written(made.where("round = -1").groupBy("hash").agg(F.sum("n").alias("n")), "scoring-vocabulary")
    held = common.frequent(table, "hash", "n", TOP)
    top = table.where(held).toArrow()
    return table, Vocabulary(top.column("hash").to_numpy(), top.column("n").to_numpy(), table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), held


# --- network -------------------------------------------------------------------------------------------------------
def start(mass: np.ndarray) -> list[np.ndarray]:
    """The network that training begins with, which gives nearly the shares of the cells' masses: a row of the input
    layer for each cell and edge with HIDDEN weights for each place, hidden bias, and the weights, the bias last, of classes and of cells in classes."""
    rng = np.random.default_rng(SEED)
    of = mass.reshape(SIDE, SIDE)
    size = of.sum(axis=1)
    one, two = rng.normal(0, 0.05, (SIDE, HIDDEN + 1)), rng.normal(0, 0.05, (SIDE, SIDE, HIDDEN + 1))
    one[:, HIDDEN] = np.clip(np.log(np.maximum(size, 1e-9) / max(size.sum(), 1e-9)), -20, 0)
    two[:, :, HIDDEN] = np.clip(np.log(np.maximum(of, 1e-9) / np.maximum(size, 1e-9)[:, None]), -20, 0)
    return [rng.normal(0, 0.3, (CELLS + 1, len(PLACES) * HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), one.astype(np.float32), two.astype(np.float32)]


def _hidden(w: list[np.ndarray], line: np.ndarray) -> np.ndarray:
    """Hidden layer, with a last column of ones, of the places of a line but its first and last WINDOW."""
    n = len(line) - 2 * WINDOW
    x = np.take(w[0], line, axis=0)
    h = np.empty((n, HIDDEN + 1), w[0].dtype)
    z = h[:, :HIDDEN]
    z[:] = w[1]
    for k, o in enumerate(PLACES):
        z += x[WINDOW + o : WINDOW + o + n, k * HIDDEN : (k + 1) * HIDDEN]
    np.tanh(z, out=z)
    h[:, HIDDEN] = 1
    return h


def _class_cuts(cells: np.ndarray) -> list[int]:
    """Where each class begins among sorted cells, and the end."""
    return np.searchsorted(cells, np.arange(SIDE + 1, dtype=np.uint16) * np.uint16(SIDE)).tolist()


def _step(w: list[np.ndarray], line: np.ndarray) -> None:
    """One step of gradient descent on the tokens of a line but its first and last WINDOW places."""
    n = len(line) - 2 * WINDOW
    h = _hidden(w, line)
    order = np.argsort(line, kind="stable")  # two-byte keys are sorted by radix
    cells = np.take(line, order)
    keep = (order >= WINDOW) & (order < n + WINDOW) & (cells != EDGE)
    own, t = order[keep] - WINDOW, cells[keep]
    if not len(own):
        return
    one, two = w[2], w[3]
    hs = np.take(h, own, axis=0)
    begin = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    up = np.zeros((SIDE, SIDE, HIDDEN + 1), h.dtype)  # sums of the hidden layer by target
    up.reshape(CELLS, HIDDEN + 1)[np.take(t, begin)] = np.add.reduceat(hs, begin, axis=0)
    # probabilities are e * inv; a matrix product takes the place of most passes over them
    e = np.exp(hs @ one.T)
    inv = 1 / (e @ _ONES)
    back = e @ one[:, :HIDDEN]
    back *= -inv
    back += np.take(one[:, :HIDDEN], t // np.uint16(SIDE), axis=0)
    back += np.take(two.reshape(CELLS, HIDDEN + 1), t, axis=0)[:, :HIDDEN]
    first = up.sum(axis=1) - e.T @ (hs * inv)
    cuts = _class_cuts(t)
    for c in range(SIDE):
        lo, hi = cuts[c], cuts[c + 1]
        if lo < hi:
            hc, wc = hs[lo:hi], two[c]
            e = np.exp(hc @ wc.T)
            inv = 1 / (e @ _ONES)
            down = e @ wc[:, :HIDDEN]
            down *= inv
            back[lo:hi] -= down
            up[c] -= e.T @ (hc * inv)
            up[c] *= RATE / (hi - lo + CLASS_PRIOR)
            wc += up[c]
    one += first * (RATE / len(t))
    back *= 1 - hs[:, :HIDDEN] ** 2
    w[1] += back.sum(axis=0) * (RATE / len(t))
    spread = np.zeros((n + 4 * WINDOW, HIDDEN), h.dtype)
    spread[own + 2 * WINDOW] = back
    begin = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    move = np.empty((len(begin), w[0].shape[1]), h.dtype)
    for k, o in enumerate(PLACES):  # a place's token is o places from its target
        move[:, k * HIDDEN : (k + 1) * HIDDEN] = np.add.reduceat(np.take(spread, order + (WINDOW - o), axis=0), begin, axis=0)
    move *= (RATE / (np.diff(np.append(begin, len(cells))) + PRIOR)).astype(h.dtype)[:, None]
    w[0][np.take(cells, begin)] += move


def _log_probabilities(w: list[np.ndarray], line: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of the cell at every place of a line but its first and last WINDOW; 0 at edges."""
    n = len(line) - 2 * WINDOW
    h = _hidden(w, line)
    order = np.argsort(line[WINDOW : WINDOW + n], kind="stable")
    t = np.take(line[WINDOW : WINDOW + n], order)
    m = int(np.searchsorted(t, np.uint16(EDGE)))
    order, t = order[:m], t[:m]
    one, two = w[2], w[3]
    hs = np.take(h, order, axis=0)
    own = np.take(one, t // np.uint16(SIDE), axis=0)
    own += np.take(two.reshape(CELLS, HIDDEN + 1), t, axis=0)
    own *= hs
    e = hs @ one.T
    z = (np.exp(e, out=e) @ _ONES)[:, 0].astype(np.float64)
    cuts = _class_cuts(t)
    for c in range(SIDE):
        lo, hi = cuts[c], cuts[c + 1]
        if lo < hi:
            e = hs[lo:hi] @ two[c].T
            z[lo:hi] *= (np.exp(e, out=e) @ _ONES)[:, 0]
    out = np.zeros(n)
    out[order] = own.sum(axis=1, dtype=np.float64) - np.log(z)
    return out


def _batches(line: np.ndarray, size: int):
    """Consecutive stretches of a line with size places each between their first and last WINDOW."""
    for lo in range(0, len(line) - 2 * WINDOW, size):
        yield line[lo : min(lo + size, len(line) - 2 * WINDOW) + 2 * WINDOW]


# --- training and scoring ------------------------------------------------------------------------------------------
def train(made: DataFrame, known: Vocabulary) -> list[np.ndarray]:
    """The network after all rounds over packs()."""
    w = start(known.mass)
    for r in range(ROUNDS):
        w = _round(made.where(F.col("round") == r), known, w)
    return w


def _round(rows: DataFrame, known: Vocabulary, w: list[np.ndarray]) -> list[np.ndarray]:
    """The mean of the networks of all parts, each trained from w. Each part sends its weights in rows, and rows are added up in the executors."""
    shapes = [x.shape for x in w]
    size = sum(x.size for x in w)
    height = -(-size // COLUMNS)

    def fit(batches):
        import pyarrow as pa

        part, own, seen = None, [], 0

        def sent():
            weight = max(1, seen >> 10)
            flat = np.zeros(height * COLUMNS, np.int64)
            flat[:size] = np.round(np.clip(np.concatenate([x.ravel() for x in own]).astype(np.float64), -32, 32) * UNIT).astype(np.int64) * weight
            flat = flat.reshape(height, COLUMNS)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(height)), pa.array(np.full(height, weight)), *(pa.array(flat[:, c]) for c in range(COLUMNS))], names=["i", "n", *(f"c{c}" for c in range(COLUMNS))])

        for b in batches:
            for i in range(b.num_rows):
                at = (b.column("deal")[i].as_py(), b.column("sub")[i].as_py())
                if at != part:
                    if seen:
                        yield sent()
                    part, own, seen = at, [x.copy() for x in w], 0
                pack = unpacked(b, i)
                line, _ = lined(pack, known.look_up(pack["vocab"])[0])
                for stretch in _batches(line, BATCH):
                    _step(own, stretch)
                seen += len(pack["codes"]) - pack["lead"] - pack["trail"]
        if seen:
            yield sent()

    fields = [f"c{c}" for c in range(COLUMNS)]
    # a part is far smaller than a row group, so one task reads it whole
    sums = rows.sortWithinPartitions("deal", "sub", "seq").mapInArrow(hashing.forgetting(fit), ", ".join(["i long", "n long", *(f"{c} long" for c in fields)])).groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in fields))
    found = sums.collect()  # height rows
    if not found:
        return w
    flat = np.zeros((height, COLUMNS))
    for row in found:
        flat[row.i] = np.array(row[2:], np.float64) / (row.n * UNIT)
    out, at = [], 0
    for shape in shapes:
        n = int(np.prod(shape))
        out.append(flat.ravel()[at : at + n].reshape(shape).astype(np.float32))
        at += n
    return out


def scored(pack: dict, known: Vocabulary, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, sum of logarithms, number of tail tokens of each document, the tail tokens' hashes); the sum lacks the logarithms of the tail tokens' counts."""
    cells, share, tail = known.look_up(pack["vocab"])
    line, where = lined(pack, cells)
    value = np.concatenate([_log_probabilities(w, x) for x in _batches(line, 2 * BATCH)]) if len(line) > 2 * WINDOW else np.zeros(0)
    inner = slice(pack["lead"], len(pack["codes"]) - pack["trail"])
    codes = pack["codes"][inner]
    value = value[where[inner] - WINDOW] + np.take(share, codes)
    lengths = np.array(pack["lengths"], np.int64) - pack["lead"] - pack["trail"]
    full = np.flatnonzero(lengths)
    begins = np.cumsum(lengths) - lengths
    sums, tails = np.zeros(len(lengths)), np.zeros(len(lengths), np.int64)
    rare = np.take(tail, codes)
    if len(full):
        sums[full] = np.add.reduceat(value, begins[full])
        tails[full] = np.add.reduceat(rare.astype(np.int64), begins[full])
    return lengths, sums, tails, np.take(pack["vocab"], codes[rare])


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over tokens) and per_token (its mean) of every row of docs(doc_id, text, ...).

    Null and empty texts have no tokens, a log_likelihood of 0 and a null per_token. Repeated rows and equal texts get
    equal scores, rounded to three places; a very long text is scored in pieces that see their neighbours, so its score is
    that of the whole. Extra columns are ignored; an empty table gives no rows. Scores don't depend on how docs is
    partitioned, unless so many rows share one doc_id that their part has to be cut up.
    """
    made = packs(docs)
    table, known, held = vocabulary(made)
    w = train(made, known)

    def score(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                pack = unpacked(b, i)
                n, sums, tails, rare = scored(pack, known, w)
                ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(tails)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(pack["rows"], pa.int64()), pa.array(pack["ids"], pa.int64()), pa.array(n), pa.array(sums), pa.ListArray.from_arrays(pa.array(ends), pa.array(rare))], names=["row", "doc_id", "n", "value", "tail"])

    rows = common.written(made.where("round >= 0").mapInArrow(hashing.forgetting(score), "row long, doc_id long, n long, value double, tail array<long>"), "scoring-rows")
    # tokens that aren't held are rare ones, so no key of this join is hot
    rare = rows.select("row", F.explode("tail").alias("hash")).join(table.where(~held).select("hash", F.log(F.col("n").cast("double")).alias("value")), "hash")
    parts = rows.select("row", "doc_id", "n", "value").unionByName(rare.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n"), "value"))
    whole = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.round(F.sum("value"), 3).alias("log_likelihood"))
    out = common.written(whole.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("per_token")), "scoring-scores")
    common.drop_written(made, table, rows)
    return out
