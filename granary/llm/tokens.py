"""Token ids in files of directly addressable codes.

Ids are cut into chunks of eight bits. Level 0 holds the low chunk of every id, level k the next chunk of those ids
that have one; a bitmap on each level marks the ids that continue, and a rank directory holds the number of marks
before each block of 512. Any id is then found by one rank on each level, without decoding a block.

A file (little-endian): magic, counts, the documents' ids and ends, then for each level its length and the places of
chunks, bitmap and directory. Files are shards of a global ascending order of doc_id (null first).
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common

MAGIC = b"GRDAC1\0\0"
BLOCK = 512
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Distinct pieces whose ids a worker remembers.
CACHE = 400_000
#: Ids after which a shard is closed and the next one begun, so that a task holds no more than a shard; a longer document has a shard of its own.
SHARD_IDS = 8_000_000
#: Shards of one partition that keep their order.
SHARDS = 1 << 30
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies use for each byte: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Ids that the tokenizers library gives for a whole text with add_special_tokens=False, as a memory of pieces.

    The vocabulary drops white space and never joins across it, so the library encodes each distinct piece between
    blanks or line ends once and its ids are remembered; other white space stays inside pieces for the library.
    It also lower-cases and cuts letters from punctuation, so a new piece of Latin letters with marks after them
    takes the ids of its lower-case letters, which go straight to the library's model, and of its marks.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        # letters below U+01C0 but for U+0130 and U+0149, whose lower case or composed form isn't one letter
        self.word = re.compile("([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u01bf]+)([.,!?;:#%&*$]*)").fullmatch

    def __missing__(self, piece: str) -> bytes:
        m = self.word(piece)
        if m is None:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        elif (base := m[1].lower()) != piece:
            out = self[base] + self[m[2]]
        else:
            ids = [t.id for t in self.model.tokenize(base if base.isascii() else base.encode().decode("latin-1").translate(self.letters))]
            out = struct.pack(f"<{len(ids)}I", *ids)
        self[piece] = out
        return out

    def ids(self, text: str) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))), dtype="<u4")


class WholeTexts:
    """Ids of whole texts, straight from the library: for tokenizers that Encoder's cutting doesn't suit."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def suits(path: str) -> bool:
    """Whether a tokenizer file has the steps that Encoder relies on: composing, white space as one blank, lower case, pieces cut
    at white space with the blanks dropped, bytes as letters, and a BPE model with word ends."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = lambda part: [s["type"] for s in (part or {}).get("normalizers" if "normalizers" in (part or {}) else "pretokenizers", [])]
    split = next((s for s in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if s["type"] == "Split"), {})
    return (
        spec["model"]["type"] == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>" and steps(spec["normalizer"]) == ["NFC", "Replace", "Lowercase"]
        and steps(spec["pre_tokenizer"]) == ["Split", "ByteLevel"] and split.get("behavior") == "Removed" and bool(split.get("invert"))
    )


_ENCODERS: dict[str, Encoder | WholeTexts] = {}


def encoder(path: str) -> Encoder | WholeTexts:
    """This worker's encoder, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path) if suits(path) else WholeTexts(path)
    return _ENCODERS[path]


def dac_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, continuation bitmap, rank directory) of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(rest) // BLOCK) * (BLOCK // 8), np.uint8)
        padded[: len(bitmap)] = bitmap
        counts = _POPCOUNT[padded].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64)
        directory = np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])
        levels.append(((rest & 255).astype(np.uint8), padded, directory))
        rest = rest[more] >> 8
        if not len(rest):
            return levels


def shard_bytes(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """One file. Null doc_ids are kept by a mask."""
    levels = dac_levels(ids)
    mask = np.array([d is None for d in doc_ids], dtype=np.uint8)
    docs = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    head = MAGIC + struct.pack("<QQQ", len(docs), len(ids), len(levels))
    parts, at = [], len(head) + 24 * len(levels)
    body = [docs.tobytes(), mask.tobytes() + b"\0" * (-len(mask) % 8), ends.astype("<u8").tobytes()]
    at += sum(map(len, body))
    for chunks, bitmap, directory in levels:
        c = chunks.tobytes() + b"\0" * (-len(chunks) % 8)
        parts.append(struct.pack("<QQQ", len(chunks), at, at + len(c)))
        body += [c, bitmap.tobytes(), directory.astype("<u8").tobytes()]
        at += len(c) + len(bitmap) + 8 * len(directory)
    return head + b"".join(parts) + b"".join(body)


class Shard:
    """Random access to the ids of one file's bytes; nothing is decoded but what is asked for."""

    def __init__(self, data) -> None:
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.n_docs, self.n_ids, n_levels = struct.unpack_from("<QQQ", data, 8)
        at = 32 + 24 * n_levels
        self.docs = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.mask = np.frombuffer(data, np.uint8, self.n_docs, at)
        at += self.n_docs + -self.n_docs % 8
        self.ends = np.frombuffer(data, "<u8", self.n_docs, at)
        self.levels = []
        for k in range(n_levels):
            n, chunks, bitmap = struct.unpack_from("<QQQ", data, 32 + 24 * k)
            blocks = -(-n // BLOCK)
            self.levels.append((np.frombuffer(data, np.uint8, n, chunks), np.frombuffer(data, np.uint8, blocks * BLOCK // 8, bitmap), np.frombuffer(data, "<u8", blocks + 1, bitmap + blocks * BLOCK // 8)))

    def _rank(self, level: int, i: int) -> int:
        """Marks before position i of a level."""
        _, bitmap, directory = self.levels[level]
        block = i // BLOCK
        lo = block * (BLOCK // 8)
        marks = int(directory[block]) + int(_POPCOUNT[bitmap[lo : i // 8]].sum())
        return marks + (bin(int(bitmap[i // 8]) & ((1 << i % 8) - 1)).count("1") if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        """The id at a position."""
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * level
            if not bitmap[i // 8] >> i % 8 & 1:
                return value
            i = self._rank(level, i)
        return value

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Ids at positions lo to hi - 1: one rank on each level, then runs of chunks."""
        level, out = 0, np.zeros(hi - lo, np.uint32)
        where = np.arange(hi - lo)
        while len(where):
            chunks, bitmap, _ = self.levels[level]
            out[where] |= chunks[lo:hi].astype(np.uint32) << np.uint32(8 * level)
            bits = np.unpackbits(bitmap[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            where = where[bits]
            if len(where):
                lo = self._rank(level, lo)
                hi = lo + len(where)
                level += 1
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes docs(doc_id, text) into shards below path; returns the written manifest: file, first (order), n_docs, n_ids.

    A null text is empty: its document has the end id alone. Repeated doc_ids stay repeated, next to each other; rows of one
    id are dealt over several ranges by their place in the table. A very long text is encoded whole. Extra columns are
    ignored. Shards follow a range partitioning by doc_id; a file counts only if the manifest names it, so files of lost
    or repeated attempts do no harm. An empty table gives an empty manifest.
    """
    tokenizer = tokenizer or tokenizer_path()
    spark = docs.sparkSession
    common.small_batches(spark)

    def write(batches):
        import pyarrow as pa

        fs, root = common.filesystem(path)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        ids, doc_ids, ends, total, files = [], [], [], 0, 0

        def closed():
            nonlocal ids, doc_ids, ends, total, files
            name = f"shard-{part:06d}-{files:06d}-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(shard_bytes(doc_ids, np.array(ends), np.concatenate(ids)))
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part * SHARDS + files], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([total], pa.int64())], names=["file", "part", "n_docs", "n_ids"])
            ids, doc_ids, ends, total, files = [], [], [], 0, files + 1
            return row

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = encoder(tokenizer).ids(text or "")
                if doc_ids and total + len(x) >= SHARD_IDS:
                    yield closed()
                doc_ids.append(doc_id)
                ids += [x, end]
                total += len(x) + 1
                ends.append(total)
        if doc_ids:
            yield closed()

    placed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    ordered = placed.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    return common.written(ordered.mapInArrow(write, "file string, part long, n_docs long, n_ids long"), "token-manifest")


def read_tokens(manifest: DataFrame, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. The manifest has a row for each shard, so one window orders it."""
    starts = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, root = common.filesystem(path)
                with fs.open_input_file(f"{root}/{name}") as f:
                    shard = Shard(f.read())
                ends = shard.ends.astype(np.int64)
                first = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
                crc = [zlib.crc32(shard.document(k).astype("<u4").tobytes()) for k in range(shard.n_docs)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.docs, mask=shard.mask.astype(bool)), pa.array(first + base), pa.array(ends - first), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a task for each shard: the file names are dealt out over as many partitions as there are shards
    n = max(1, manifest.count())
    dealt = starts.select("file", "base").repartition(n, F.col("base"))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs as shards below the shared folder and returns what the files hold per document."""
    path = common.new_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, path, tokenizer), path)
