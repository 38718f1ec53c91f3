import collections
import math

import numpy as np
import pytest

import odd
from granary.llm import hashing, scoring as S

TEXTS = [None, "", "one", "the cat sat on the mat. the dog sat", "x y z " * 700, "a b", "the odd word zyx zyx qqq"]


def hashes_of(text):
    """Token by token, by the definition."""
    out = []
    for t in hashing.TOKEN.findall(text or ""):
        h = sum(int(S._tables()[1][ord(c)]) * pow(S.BASE, i, 1 << 64) for i, c in enumerate(t)) % (1 << 64)
        h ^= h >> 32
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


def model(texts, top=20):
    """A vocabulary that knows the most frequent tokens of texts, a network with something in all weights, and all counts."""
    counts = collections.Counter(h for t in texts for h in hashes_of(t))
    known = counts.most_common(top)
    v = S.Vocabulary(np.array([h for h, _ in known], np.int64), np.array([n for _, n in known], np.int64), sum(counts.values()))
    rng = np.random.default_rng(5)
    return v, [x + rng.normal(0, 0.2, x.shape).astype(np.float32) for x in S.start(v.mass)], counts


def cell_of(v, h):
    if h in v.hashes:
        i = list(v.hashes).index(h)
        return int(v.cells[i])
    return int(v.tail_cells[(h & 0xFFFFFFFFFFFFFFFF) // 2**32 % S.TAIL_BINS])


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def plain(text, v, w, counts, least=0):
    """One token at a time, by the definition: class, cell in the class, token in the cell by exact counts."""
    ids = hashes_of(text)
    cells = [S.EDGE] * 2 + [cell_of(v, h) for h in ids] + [S.EDGE] * 2
    mass = np.asarray(v.mass)
    total = 0.0
    for i, h in enumerate(ids):
        z = w[1].astype(float).copy()
        for k, o in enumerate((-2, -1, 1, 2)):
            z += w[0][cells[i + 2 + o], k * S.HIDDEN : (k + 1) * S.HIDDEN]
        x = np.append(np.tanh(z), 1.0)
        a, b = divmod(cells[i + 2], S.SIDE)
        total += math.log(softmax(w[2] @ x)[a]) + math.log(softmax(w[3][a] @ x)[b]) + math.log(counts[h] / mass[cells[i + 2]])
    return total


def test_scores_equal_one_token_at_a_time():
    v, w, counts = model(TEXTS)
    rows = [(i, i, S.token_hashes(t)) for i, t in enumerate(TEXTS)]
    (pack,) = S.packed(rows)
    n, sums, tails, rare = S.scored(pack, v, w)
    ends = np.cumsum(tails)
    for i, t in enumerate(TEXTS):
        own = rare[ends[i] - tails[i] : ends[i]]
        got = sums[i] + sum(math.log(counts[int(h)]) for h in own)
        assert n[i] == len(hashes_of(t)) and got == pytest.approx(plain(t, v, w, counts), abs=1e-2, rel=1e-5)


def test_pieces_of_a_long_text_score_as_the_whole(monkeypatch):
    v, w, _ = model(TEXTS)
    text = "the cat sat on the mat x y z the dog " * 40
    (whole,) = S.packed([(7, 7, S.token_hashes(text))])
    monkeypatch.setattr(S, "PACK", 100)
    monkeypatch.setattr(S, "SLICE", 64)
    cut = list(S.packed([(7, 7, S.token_hashes(text))]))
    assert len(cut) > 3 and {r for p in cut for r in p["rows"]} == {7}
    n, value = 0, 0.0
    for p in cut:
        a, b, _, _ = S.scored(p, v, w)
        n, value = n + a.sum(), value + b.sum()
    a, b, _, _ = S.scored(whole, v, w)
    assert n == a[0] and value == pytest.approx(b[0], rel=1e-6)


def test_tokens_are_those_of_the_pattern():
    every = "".join(chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000)
    for text in [*TEXTS, " a", "a ", "...", "\u00e9 \u2603 \U0001f600\x00x_1", "\u0301a\u0300 b", every, every[::-1], "a,b;;c  ,, d\x85e\u2028f"]:
        assert S.token_hashes(text).tolist() == hashes_of(text)


def test_slices_are_cut_between_tokens(monkeypatch):
    text = "one two, three\n\nfour five ... six   seven " * 30
    want = hashes_of(text)
    for size in (20, 64, 10_000):
        monkeypatch.setattr(S, "SLICE", size)
        assert S.token_hashes(text).tolist() == want
    monkeypatch.setattr(S, "SLICE", 64)
    assert len(S.token_hashes("x" * 640)) == 10


def test_probabilities_of_the_vocabulary_sum_to_one():
    texts = ["the cat sat on the mat", "a b c d e f g a b a"]
    v, w, counts = model(texts, top=6)
    n = sum(counts.values())
    assert v.mass.sum() == pytest.approx(n)
    line = np.array([S.EDGE, 3, 5, 9, S.EDGE], np.uint16)
    total = 0.0
    for cell in np.flatnonzero(v.mass):
        line[2] = cell
        total += math.exp(S._log_probabilities(w, line)[0])
    for cell in np.flatnonzero(v.mass == 0):
        line[2] = cell
        total += math.exp(S._log_probabilities(w, line)[0])
    assert total == pytest.approx(1, abs=1e-4)
    frequent = collections.defaultdict(float)
    for h, c, s in zip(v.hashes, v.cells, v.share, strict=True):
        frequent[int(c)] += math.exp(s)
    assert all(x <= 1 + 1e-9 for x in frequent.values()) and any(x == pytest.approx(1) for x in frequent.values())


def test_gradient():
    """What a step does to each group of weights is the gradient of the loss, by its own rate."""
    v, w, _ = model(TEXTS)
    w = [x.astype(np.float64) for x in w]
    rng = np.random.default_rng(1)
    cells = rng.integers(0, S.CELLS, 12)
    line = np.concatenate([[S.EDGE] * 2, rng.choice(cells, 60), [S.EDGE] * 2, rng.choice(cells, 7), [S.EDGE] * 2]).astype(np.uint16)
    loss = lambda x: -S._log_probabilities(x, line).sum()
    moved = [x.copy() for x in w]
    S._step(moved, line)
    for k in range(4):
        change = moved[k] - w[k]
        for at in (np.unravel_index(j, change.shape) for j in np.argsort(-np.abs(change), axis=None)[:3]):
            up, down = [x.copy() for x in w], [x.copy() for x in w]
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            targets = line[(line != S.EDGE)]
            scale = {0: lambda: S.RATE / ((line == at[0]).sum() + S.PRIOR), 1: lambda: S.RATE / len(targets), 2: lambda: S.RATE / len(targets), 3: lambda: S.RATE / ((targets // S.SIDE == at[0]).sum() + S.CLASS_PRIOR)}[k]()
            assert -change[at] / scale == pytest.approx(slope, rel=1e-3, abs=1e-4)


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def test_training_tells_order_from_noise(spark):
    made = S.packs(table(spark, [(i, "a b c d e f g h " * 60) for i in range(40)]))
    vocabulary, known, _ = S.vocabulary(made)
    w = S.train(made, known)
    value = lambda t: S.scored(next(S.packed([(0, 0, S.token_hashes(t))])), known, w)[1][0]
    assert value("a b c d e f g h " * 20) > value("h c a g b e d f " * 20) and sum(r.n for r in vocabulary.collect()) == 40 * 480


def test_the_network_predicts_the_token_and_not_just_its_class(spark):
    """Two words of one class, each after a word of its own: the right one scores higher in its place."""
    rng = np.random.default_rng(0)
    body = lambda: " ".join(["p q", "r s"][int(x)] for x in rng.integers(0, 2, 300))
    made = S.packs(table(spark, [(i, body()) for i in range(120)]))
    _, known, _ = S.vocabulary(made)
    w = S.train(made, known)
    score = lambda t: S.scored(next(S.packed([(0, 0, S.token_hashes(t))])), known, w)[1][0]
    assert score("p q r s p q") > score("p s r q p s") + 1


def test_what_is_gathered_grows_with_the_corpus(spark):
    sizes = []
    for n in (50, 500):
        made = S.packs(table(spark, [(i, f"common words and w{i} alone") for i in range(n)]))
        sizes.append(S.vocabulary(made)[0].count())
    assert sizes == [54, 504]


def scores(docs):
    return sorted((r.doc_id, r.n_tokens, r.log_likelihood) for r in S.pseudo_likelihood(docs).collect())


def test_scores_do_not_depend_on_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_BYTES", 4_000)
    monkeypatch.setattr(S, "TOP", 40)  # so that there is a tail, joined from the vocabulary
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[int(x)] for x in rng.zipf(1.4, 60) % 300)) for i in range(200)]
    one, seven = scores(table(spark, rows, 1)), scores(table(spark, rows, 7))
    assert [x[:2] for x in one] == [x[:2] for x in seven]
    assert max(abs(a[2] - b[2]) for a, b in zip(one, seven, strict=True)) <= 0.002


def test_rare_words_score_by_their_own_counts(spark, monkeypatch):
    """Of two alike documents, that whose rare words the corpus holds twice scores higher, by the logarithm of 2 for each."""
    monkeypatch.setattr(S, "TOP", 30)
    fill = [(i, "the cat sat on the mat and the dog sat too") for i in range(100)]
    twice = "the " + " ".join(f"twice{i}" for i in range(40))
    once = "the " + " ".join(f"once{i}" for i in range(40))
    by = {r[0]: r[2] for r in scores(table(spark, [*fill, (1000, twice), (1001, twice), (1002, once)]))}
    assert by[1000] == pytest.approx(by[1001], abs=0.002) and by[1000] > by[1002]


def test_a_part_of_one_repeated_id_is_cut_up(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_BYTES", 500)
    docs = table(spark, [(None if i % 3 else 5, "same words here again") for i in range(600)] + [(i, "other words there") for i in range(10, 40)])
    placed = S.dealt(docs)
    sizes = [r["count"] for r in placed.groupBy("deal", "sub").count().collect()]
    assert placed.count() == 630 and max(sizes) < 120
    out = S.pseudo_likelihood(docs).collect()
    assert len(out) == 630 and len({r.log_likelihood for r in out if r.n_tokens == 4}) == 1


def test_odd_rows(spark):
    rows = S.pseudo_likelihood(odd.docs(spark)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(odd.rows()) and by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 0 and by[2].log_likelihood == 0 and by[2].per_token is None
    assert by[5].n_tokens == 160_000 and abs(by[5].per_token - by[5].log_likelihood / 160_000) < 1e-9 and by[1].log_likelihood == by[6].log_likelihood
    assert S.pseudo_likelihood(odd.none(spark)).count() == 0


def test_classes_are_as_many_as_before_the_cut():
    assert S.SIDE >= 48 and S.CELLS == S.SIDE**2 and S.start(np.ones(S.CELLS))[3].shape == (S.SIDE, S.SIDE, S.HIDDEN + 1)


def test_held_tokens_stay_within_their_limit(spark, monkeypatch):
    """300 tokens of 200,000 each: the topmost step of the histogram alone is over the limit."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(S, "TOP", 10)
    made = spark.range(300).select(F.lit(-1).alias("round"), F.xxhash64("id").alias("hash"), F.lit(200_000).cast("long").alias("n"))
    table, known, held = S.vocabulary(made)
    assert 0 < len(known.hashes) <= 10 and table.where(held).count() == len(known.hashes) and table.where(~held).count() == 300 - len(known.hashes)


def test_parts_share_a_bounded_number_of_partitions(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} and some other words of text {i}" * 3) for i in range(60)], "doc_id long, text string")
    monkeypatch.setattr(S, "PART_BYTES", 200)
    want = {r.doc_id: r.log_likelihood for r in S.pseudo_likelihood(docs).collect()}
    monkeypatch.setattr(S, "PARTITIONS", 3)
    assert S.dealt(docs).rdd.getNumPartitions() <= 3
    assert {r.doc_id: r.log_likelihood for r in S.pseudo_likelihood(docs).collect()} == want
