"""WARC archives: a distributed writer with payload de-duplication and a Python data source that reads them.

Each record is one gzip member whose extra field ``sl`` holds the member's compressed and plain length, so the
reader inflates only as much of a member as the WARC headers need and then jumps to the next one. Partitions are
planned per archive file; predicates on ``record_type`` and on header columns are pushed into the reader and are
tested on headers before a payload is inflated.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from . import common

#: An archive file is closed and the next one begun beyond this many bytes.
ROLL_BYTES = 64 << 20
#: Inflated at first; the headers of nearly all records fit.
HEAD_BYTES = 4096
MANIFEST = "MANIFEST.json"
SCHEMA = (
    "file string, offset long, record_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, payload_length long, headers map<string,string>, payload binary"
)
_DATE = "2024-01-01T00:00:00Z"  # fixed, so that reruns give the same bytes


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1, as WARC-Payload-Digest carries it after ``sha1:``."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str) -> str:
    """Header values are one line; CR, LF and other controls become percent escapes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member. A revisit keeps the HTTP header block, whose Content-Length tells the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = _one_line(url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def member(plain: bytes) -> bytes:
    """gzip member with the skip-length field."""
    c = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = c.compress(plain) + c.flush()
    tail = struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body) + len(tail)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(plain) & 0xFFFFFFFF) + body + tail


def _parse_head(plain: bytes) -> tuple[dict[str, str], int] | None:
    """Headers by lower-case name and the offset of the block; None if the end of the headers isn't within plain."""
    end = plain.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = plain[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


def _members(read, size: int) -> Iterator[tuple[int, bytes, int]]:
    """(offset, compressed member or its prefix, wbits) of each gzip member that has a skip length; others are found by inflating."""
    at = 0
    while at < size:
        head = read(at, 24)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at {at}")
        if head[3] & 4 and head[12:14] == b"sl":
            length = struct.unpack_from("<I", head, 16)[0]
            yield at, length, True
        else:
            d, pos = zlib.decompressobj(31), at
            while not d.eof:
                part = read(pos, 1 << 16)
                if not part:
                    raise ValueError(f"cut gzip member at {at}")
                d.decompress(part)
                pos += len(part)
            length = pos - len(d.unused_data) - at
            yield at, length, False
        at += length


def records(uri: str, wanted=lambda row: True, payloads: bool = True) -> Iterator[dict]:
    """Rows of one archive. Headers are parsed first; the rest of a member is inflated only for rows that are wanted."""
    fs, path = common.filesystem(uri)
    size = fs.get_file_info(path).size
    with fs.open_input_file(path) as f:
        window = {"at": 0, "data": b""}

        def read(at: int, n: int) -> bytes:
            """n bytes at an offset through one 1 MB window, so that small members cost no request each."""
            lo = at - window["at"]
            if lo < 0 or lo + n > len(window["data"]):
                f.seek(at)
                window["at"], window["data"] = at, f.read(max(n, 1 << 20))
                lo = 0
            return window["data"][lo : lo + n]

        for at, length, _ in _members(read, size):
            d = zlib.decompressobj(31)
            raw = read(at, length)
            plain = d.decompress(raw, HEAD_BYTES)
            while (parsed := _parse_head(plain)) is None:
                if not d.unconsumed_tail:
                    raise ValueError(f"no end of headers in the record at {at} of {uri}")
                plain += d.decompress(d.unconsumed_tail, HEAD_BYTES)
            headers, start = parsed
            row = {
                "file": uri, "offset": at, "record_id": headers.get("warc-record-id"), "record_type": headers.get("warc-type"), "target_uri": headers.get("warc-target-uri"),
                "refers_to": headers.get("warc-refers-to"), "payload_digest": headers.get("warc-payload-digest"), "headers": headers, "payload_length": None, "payload": None,
            }
            if not wanted(row):
                continue
            block_len = int(headers["content-length"])
            while plain.find(b"\r\n\r\n", start) < 0 and d.unconsumed_tail:
                plain += d.decompress(d.unconsumed_tail, HEAD_BYTES)
            is_http = headers.get("content-type", "").startswith("application/http")
            http_end = plain.find(b"\r\n\r\n", start, start + block_len) + 4 if is_http else start
            http = plain[start:http_end].decode("latin-1").lower() if is_http else ""
            stated = next((int(x.partition(":")[2]) for x in http.split("\r\n") if x.startswith("content-length:")), None)
            row["payload_length"] = block_len - (http_end - start) if stated is None else stated
            if payloads and row["record_type"] != "revisit":
                if not d.eof:
                    plain += d.decompress(d.unconsumed_tail) + d.flush()
                row["payload"] = plain[http_end : start + block_len]
                if len(row["payload"]) != block_len - (http_end - start):
                    raise ValueError(f"cut record at {at} of {uri}")
            yield row


class FilePartition(InputPartition):
    def __init__(self, uri: str) -> None:
        self.uri = uri


class WarcReader(DataSourceReader):
    """Reader of whole archives; takes equality, IN and prefix predicates on its string header columns."""

    PUSHED = {"record_id", "record_type", "target_uri", "refers_to", "payload_digest"}

    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path, self.payloads, self.columns = options["path"], options.get("payloads", "true") != "false", columns
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else ""
            if name in self.PUSHED and isinstance(f, EqualTo | In | StringStartsWith):
                kind = "prefix" if isinstance(f, StringStartsWith) else "in"
                self.tests.append((name, kind, tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pafs

        fs, root = common.filesystem(self.path)
        base = self.path.rstrip("/")
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [FilePartition(self.path)]
        listed = f"{root.rstrip('/')}/{MANIFEST}"
        if fs.get_file_info(listed).type == pafs.FileType.File:
            with fs.open_input_stream(listed) as f:
                names = json.loads(f.read())
        else:
            found = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.endswith((".warc", ".warc.gz")))
            if plain := [x for x in found if x.endswith(".warc")]:
                raise ValueError(f"{len(plain)} archives of {self.path} aren't compressed, such as {plain[0]}: they have to be gzip files with a member for each record")
            names = found
        return [FilePartition(f"{base}/{x}") for x in names]

    def read(self, partition: FilePartition):
        tests = self.tests
        if partition is None:  # an archive folder without files
            return

        def wanted(row: dict) -> bool:
            return all(row[n] is not None and (row[n].startswith(v[0]) if kind == "prefix" else row[n] in v) for n, kind, v in tests)

        for row in records(partition.uri, wanted, self.payloads):
            yield tuple(row[c] for c in self.columns)


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payloads", "true|false").load(folder or file)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), [f.name for f in schema.fields])


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records below path."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)


def revisits(pages: DataFrame, min_bytes: int = 0, salts: int = 32) -> DataFrame:
    """(digest, first_id) of payloads of at least min_bytes that several rows hold.

    Counted in two steps, by (digest, salt) and then by digest, so a payload that a third of all rows share
    reaches the last step as at most `salts` rows.
    """
    keyed = pages.select("page_id", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    part = keyed.where(F.col("n") >= min_bytes).groupBy("digest", F.pmod(F.xxhash64("page_id"), F.lit(salts)).alias("salt")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    return part.groupBy("digest").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n")).where("n > 1").select("digest", "first_id")


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> int:
    """Writes one record for each row of pages(page_id, url, html) below path and returns the number of records.

    Of rows with equal payloads of at least min_bytes the one with the smallest page_id is a response, the others
    are revisits that refer to it. A null html is the empty payload, a null url an empty target, a null page_id an
    empty id that compares last; rows repeated with the same page_id are all responses. Extra columns are ignored.
    Files of failed or duplicate attempts stay out of the manifest, which is written last.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    first = common.written(revisits(pages, min_bytes), "warc-first")
    n, salts = first.count(), 32
    digest_col = F.sha1(F.encode("html", "UTF-8"))
    if n <= common.BROADCAST_ROWS:
        joined = pages.withColumn("digest", digest_col).join(F.broadcast(first), "digest", "left")
    else:
        # A hot payload is dealt over `salts` keys; each key's match is repeated for every salt.
        spread = first.select("digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).cast("long").alias("salt"))
        joined = pages.withColumns({"digest": digest_col, "salt": F.pmod(F.xxhash64("page_id"), F.lit(salts))}).join(spread, ["digest", "salt"], "left")
    out = joined.select("page_id", "url", "html", F.when(F.col("first_id") != F.coalesce("page_id", F.lit(-1)), F.col("first_id")).alias("refers_to"))

    def write(batches):
        import pyarrow as pa

        fs, root = common.filesystem(path)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem, count, sink, written, names = f"part-{task.partitionId():05d}-{uuid.uuid4().hex}", 0, None, 0, []
        for batch in batches:
            cols = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                page_id, url, html, refers_to = (c[i].as_py() for c in cols)
                if sink is None:
                    names.append([f"{stem}-{len(names):03d}.warc.gz", 0])
                    sink, written = fs.open_output_stream(f"{root}/{names[-1][0]}", compression=None), 0
                data = record_bytes(page_id, url, html.encode("utf-8"), refers_to)
                sink.write(data)
                written += len(data)
                names[-1][1] += 1
                count += 1
                if written > ROLL_BYTES:
                    sink.close()
                    sink = None
        if sink is not None:
            sink.close()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in names]), pa.array([x[1] for x in names], pa.int64())], names=["file", "n"])

    common.small_batches(spark)
    manifest = common.written(out.mapInArrow(write, "file string, n long"), "warc-manifest")
    rows = manifest.collect()  # one row for each archive file
    fs, root = common.filesystem(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root.rstrip('/')}/{MANIFEST}") as f:
        f.write(json.dumps(sorted(r.file for r in rows)).encode())
    common.drop_written(first, manifest)
    return sum(r.n for r in rows)


def archived_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages as WARC archives below the shared folder and returns what the archives hold:
    page_id, payload_bytes, payload_digest, record_type, refers_to. Empty tables give no rows."""
    spark = pages.sparkSession
    path = common.new_path(spark, "warc")
    write_warc(pages, path, min_bytes)
    return page_records(read_warc(spark, path))


def page_records(records_df: DataFrame) -> DataFrame:
    """Digest columns of records; a response's length and digest are taken anew from the payload read, a revisit's from its headers."""
    page = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1).try_cast("long")
    response = F.col("payload").isNotNull()

    def redigest(batches):
        import pyarrow as pa

        for b in batches:
            payload = b.column("payload")
            made = [None if (p := payload[i].as_py()) is None else digest(p) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "payload_bytes", "stated_digest", "record_type", "refers_to")), pa.array(made, pa.string())], names=["page_id", "payload_bytes", "stated_digest", "record_type", "refers_to", "made"])

    rows = records_df.select(
        page(F.col("record_id")).alias("page_id"), F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("stated_digest"), "record_type", page(F.col("refers_to")).alias("refers_to"), "payload",
    )
    made = rows.mapInArrow(redigest, "page_id long, payload_bytes long, stated_digest string, record_type string, refers_to long, made string")
    return made.select("page_id", "payload_bytes", F.coalesce("made", "stated_digest").alias("payload_digest"), "record_type", "refers_to")
