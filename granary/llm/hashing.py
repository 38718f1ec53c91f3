"""Tokens as numbers, remembered by each task, for the numpy models of this subpackage."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from . import common

#: Runs of word characters, and runs of marks.
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Distinct tokens that a task remembers.
REMEMBERED = 200_000


def number(token: str) -> int:
    """64 bits of a token, which stand for it in tables."""
    n = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
    return n - (n >> 63 << 64)


class Words(dict):
    """Two-byte rows by token: tokens that are held have a row each, all others share the rows after those."""

    def __init__(self, held: np.ndarray, shared: int) -> None:
        if shared < 1 or len(held) + shared >= 65536:
            raise ValueError("row numbers have two bytes, and one number is kept free")
        self.row = {h: i for i, h in enumerate(held.tolist())}
        self.shared = shared

    def __missing__(self, token: str) -> bytes:
        n = number(token)
        out = self[token] = self.row.get(n, len(self.row) + n % self.shared).to_bytes(2, "little")
        return out

    def ids(self, text: str | None) -> np.ndarray:
        """Rows of a text's tokens in order; null and empty texts have none."""
        if len(self) > REMEMBERED:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, TOKEN.findall(text or ""))), dtype="<u2")


def token_counts(docs):
    """(hash, n) of the distinct tokens of docs(text), counted where the documents are and then summed."""

    def count(batches):
        import pyarrow as pa

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(map(number, known), pa.int64()), pa.array(known.values(), pa.int64())], names=["hash", "n"])

        known = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                known.update(TOKEN.findall(t or ""))
                if len(known) > REMEMBERED:
                    yield sent()
                    known.clear()
        yield sent()

    return docs.select("text").mapInArrow(forgetting(count), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def forgetting(f):
    """A function over batches after which the worker gives its free memory back, so that an idle one holds little."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            common.release()

    return run


def pieces(ids: np.ndarray, most: int):
    """(first, last) of consecutive pieces of at most `most` ids, so that a very long text needs no more memory than a short one."""
    for lo in range(0, max(1, len(ids)), most):
        yield lo, min(lo + most, len(ids))
