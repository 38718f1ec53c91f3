import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings, strategies as st

import odd
from granary.llm import matroska as M


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 200_000), st.integers(0, 255))
def test_round_trip(n, seed):
    data = bytes((i * 31 + seed) % 251 for i in range(n))
    media = M.encode(M.pad(data))
    found = M.parse(media)
    assert b"".join(media[o : o + s] for _, _, o, s, _ in found["packets"]) == M.pad(data) and len(M.pad(data)) % 576 == 0
    assert [t for _, t, *_ in found["packets"]] == [72 * i for i in range(len(M.pad(data)) // 576)]
    assert len(found["cues"]) == found["clusters"] and all(media[at : at + 4] == b"\x1f\x43\xb6\x75" for _, _, at in found["cues"])


def block(lacing, head, frames):
    return M._element(M.SIMPLE_BLOCK, b"\x81\x00\x05" + bytes([0x80 | lacing << 1]) + bytes([len(frames) - 1]) + head + b"".join(frames))


@pytest.mark.parametrize("unknown", [False, True])
def test_all_lacings_and_unknown_sizes(unknown):
    frames = [b"a" * 300, b"b" * 7, b"c" * 255, b"d" * 20]
    xiph = block(1, b"\xff\x2d" + b"\x07" + b"\xff\x00", frames)
    ebml = block(3, M._size(300, 2) + M._size(7 - 300 + (1 << 13) - 1, 2) + M._size(255 - 7 + (1 << 13) - 1, 2), frames)
    fixed = block(2, b"", [b"x" * 9] * 3)
    single = M._element(M.BLOCK_GROUP, M._element(M.BLOCK, b"\x82\xff\xfb\x00zz"))
    body = M._uint(M.TIMESTAMP, 1000) + xiph + ebml + fixed + single
    cluster = b"\x1f\x43\xb6\x75" + (b"\x01" + b"\xff" * 7 + body if unknown else M._size(len(body)) + body)
    rest = cluster + M._element(M.CUES, M._element(M.CUE_POINT, M._uint(M.CUE_TIME, 1000) + M._element(M.CUE_POSITIONS, M._uint(M.CUE_TRACK, 1) + M._uint(M.CUE_CLUSTER, len(M._TRACKS)))))
    data = M._HEAD + b"\x18\x53\x80\x67" + (b"\xff" if unknown else M._size(len(M._TRACKS + rest))) + M._TRACKS + rest
    found = M.parse(data)
    got = [data[o : o + s] for _, _, o, s, _ in found["packets"]]
    assert got == frames + frames + [b"x" * 9] * 3 + [b"zz"]
    assert found["packets"][0][1] == 1005 and found["packets"][-1][:2] == (2, 995) and found["cues"][0][2] == data.index(b"\x1f\x43\xb6\x75")


def test_broken_files_are_refused():
    media = M.encode(M.pad(b"x" * 1000))
    for bad in (media[:-40], media[:60], b"\x00" + media[1:]):
        with pytest.raises((ValueError, IndexError, struct.error, KeyError)):
            assert M.parse(bad)["packets"]


def test_features(spark):
    media = M.media_column(odd.docs(spark))
    rows = M.media_features(media).collect()
    assert len(rows) == len(odd.rows())
    texts = {hashlib.sha256(M.pad((r[1] or "").encode())).hexdigest(): M.pad((r[1] or "").encode()) for r in odd.rows()}
    for r in rows:
        p = texts[r.payload_sha256]
        assert (r.payload_bytes, r.tail_crc32) == (len(p), zlib.crc32(p[-32:])) and r.media_bytes > len(p)
    assert len({(r.media_sha256, r.feature) for r in rows}) == len(texts)
    packets = M.packet_table(media).where("doc_id = 5").orderBy("packet").collect()
    assert sum(p["size"] for p in packets) == len(M.pad(odd.LONG.encode())) and [p.timestamp_ms for p in packets] == [72 * i for i in range(len(packets))]
    assert M.media_features(M.media_column(odd.none(spark))).count() == 0


def test_missing_media(spark):
    media = spark.createDataFrame([(1, 3, bytearray(M.encode(M.pad(b"abc")))), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    rows = {r.doc_id: r for r in M.media_features(media).collect()}
    assert rows[1].payload_bytes == 576 and rows[2].payload_sha256 is None and rows[2].n_bytes == 0 and M.packet_table(media).where("doc_id = 2").count() == 0
