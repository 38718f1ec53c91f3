import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

import odd
from granary.llm import tokens as K


def test_encoder_equals_the_library_on_whole_texts():
    import duckdb

    e = K.Encoder(K.tokenizer_path())
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    texts += ["<|endoftext|> a", "a\x1c!b !\x1c!", "ΑΣ ΑΣΑ", "é ́a", "it's DON'T", "x y　z \t\r\n w", "ﬁ İstanbul", "a<|startoftext|>b", "\x85a\x85b \x00c", "Ŀa ŉb Ĳc Ǆd ßÉ. À,!?"]
    for t, want in zip(texts, e.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert e.ids(t).tolist() == want.ids


ENCODER = K.Encoder(K.tokenizer_path())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sS.,!éÉßİ́"))))
def test_any_text(text):
    assert ENCODER.ids(text).tolist() == ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


def test_random_access():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), rng.integers(0, 2**8, 5000), rng.integers(0, 2**16, 5000), rng.integers(0, 2**32, 3000), np.where(rng.random(9000) < 0.1, rng.integers(0, 2**24, 9000), 3)):
        ids = ids.astype(np.uint32)
        s = K.Shard(K.shard_bytes([1, None], np.array([len(ids) // 2, len(ids)]), ids))
        assert s.slice(0, len(ids)).tolist() == ids.tolist()
        for i in random.Random(0).sample(range(len(ids)), min(200, len(ids))):
            assert s[i] == ids[i]
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2))
            assert s.slice(int(a), int(b)).tolist() == ids[a:b].tolist()
        assert s.document(0).tolist() + s.document(1).tolist() == ids.tolist() and s.mask.tolist() == [0, 1]


def test_files_hold_every_document(spark):
    rows = odd.rows()
    out = K.token_table(odd.docs(spark)).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    want, at = {}, 0
    for r in rows:
        ids = np.array([*ENCODER.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(r[0], set()).add((len(ids), zlib.crc32(ids.tobytes())))
    for r in out:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    assert K.token_table(odd.none(spark)).count() == 0


def test_other_tokenizers_encode_whole_texts(spark):
    path = K.tokenizer_path("byte_bpe_50k.json")
    assert K.suits(K.tokenizer_path()) and not K.suits(path)
    rows = [(1, "It's  a\n\n TEST, Ünï  x "), (2, None), (3, "<|endoftext|> x")]
    out = {r.doc_id: r for r in K.token_table(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    library = K.WholeTexts(path).tokenizer
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (out[i].n_tokens, out[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_shards_are_rolled(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD_IDS", 50)
    rows = [(None if i % 3 == 0 else i, f"word {i} " * (i % 40)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from granary.llm import common

    path = common.new_path(spark, "tokens")
    manifest = K.write_tokens(docs, path)
    assert manifest.count() > 20 and manifest.agg({"n_ids": "min"}).first()[0] > 0
    out = K.read_tokens(manifest, path).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0)) and sum(r.n_tokens for r in out) == out[-1].start + out[-1].n_tokens
    want = sorted(zlib.crc32(np.array([*ENCODER.tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t in rows)
    assert sorted(r.ids_crc32 for r in out) == want
