"""WARC archives: written by tasks, read back by verified record boundaries.

Writing: equal payloads are found by digest (one packed row per task and shard, so a payload
shared by many pages is no hot key); the page with the smallest id keeps the payload and the
others become revisit records. Digests that occur once need no entry, so the lookup table
holds repeated payloads only, and no page is shuffled.

Reading: a task scans one byte range of one file for the record magic and emits, for each
candidate, the offset where its declared length says the next record starts. A payload may
itself hold the magic, even a whole archive, so a candidate proves nothing. Pointer jumping
from the start of the file keeps the candidates that the chain of lengths reaches, in a
logarithmic number of vector steps, and only those are parsed.
"""

from __future__ import annotations

import base64
import hashlib
import json
import mmap
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shards
from tidemark.session import stage

MAGIC = b"WARC/1.0\r\n"
FILE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_LENGTH = re.compile(rb"(?i)\r\nContent-Length:[ \t]*(\d{1,15})[ \t]*(?=\r\n)")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _lead(digest: np.ndarray) -> np.ndarray:
    """The first eight bytes of each digest as a number, which orders as the digest does."""
    return np.ascontiguousarray(digest).view(np.uint8).reshape(-1, 20)[:, :8].copy().view(">u8").ravel().astype(np.uint64)


def repeated_payloads(pages: DataFrame, min_bytes: int) -> shards.Mapped:
    """Sorted digests of payloads that several pages have, with the smallest page id of each."""
    spark = pages.sparkSession
    folder, bits = shards.shared_folder(spark, "payloads"), shards.shard_bits(spark)
    kinds = "S20", "i8", "?"

    def merge(digest, first, many):
        """Distinct sorted digests: their smallest ids, and whether there are several pages."""
        order = np.lexsort((first, digest))
        digest, first, many = digest[order], first[order], many[order]
        new = np.flatnonzero(np.r_[True, digest[1:] != digest[:-1]]) if len(digest) else np.empty(0, int)
        count = np.diff(np.r_[new, len(digest)])
        some = np.logical_or.reduceat(many, new) if len(new) else many
        return digest[new], first[new], some | (count > 1)

    def send(batches):
        for batch in batches:
            ids, payloads = batch.column(0), shards.texts_of(batch.column(1))
            rows = [(hashlib.sha1(p).digest(), i) for p, i in zip(payloads, ids.to_pylist(), strict=True) if len(p) >= min_bytes and i is not None]
            found = merge(np.array([d for d, _ in rows], "S20"), np.array([i for _, i in rows], "i8"), np.zeros(len(rows), bool))
            yield shards.cut(bits, _lead(found[0]), *found)

    def write(shard, rows):
        digest, first, many = merge(*shards.unpack(rows, *kinds))
        shards.save(f"{folder}/first-{shard}.npy", first[many])
        shards.save(f"{folder}/keys-{shard}.npy", digest[many])
        return pa.RecordBatch.from_arrays([pa.array([int(many.sum())])], names=["n"])

    shards.reduce_shards(pages.select("page_id", "html").mapInArrow(send, shards.BLOCK), write, "n long").agg(F.sum("n")).collect()
    return shards.Mapped(folder, bits)


def _first(table: shards.Mapped, digests: list[bytes]) -> list[int | None]:
    out: list[int | None] = []
    for digest in digests:
        shard = int.from_bytes(digest[:8], "big") >> (64 - table.bits)
        have = table.array("keys", shard)
        at = np.searchsorted(have, np.array(digest, "S20")) if len(have) else 0
        same = at < len(have) and have[at] == np.array(digest, "S20")[()]
        out.append(int(table.array("first", shard)[at]) if same else None)
    return out


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record: a response with its payload, or a revisit without.

    A URL with blanks or control characters is escaped, and kept as given in a field of its own.
    """
    escaped = url and _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {escaped}"] if url is not None else []),
        *([f"X-Given-URL: {json.dumps(url)}"] if escaped != url else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, min_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row and returns the files: path, size.

    A NULL html is an empty payload. A page without an id is never referred to. Rows that
    repeat the smallest id of their payload are responses as well. Each attempt of a task
    writes files of its own, and only those of the attempt that counted are listed.
    """
    table = repeated_payloads(pages, min_bytes)
    folder = shards.shared_folder(pages.sparkSession, "archive")

    def write(batches):
        out, path, size = None, "", 0
        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            payloads = shards.texts_of(batch.column(2))
            digests = [hashlib.sha1(p).digest() for p in payloads]
            for i, url, payload, digest, first in zip(ids, urls, payloads, digests, _first(table, digests), strict=True):
                refers = first if first != i and len(payload) >= min_bytes else None
                data = record(i, url, payload, base64.b32encode(digest).decode(), refers, date)
                if out and size + len(data) > file_bytes:
                    out.close()
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size])], names=["path", "size"])
                    out = None
                if not out:
                    path, size = f"{folder}/{uuid.uuid4().hex}.warc", 0
                    out = open(path, "wb")  # noqa: SIM115
                out.write(data)
                size += len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size])], names=["path", "size"])

    return stage(pages.select("page_id", "url", "html").mapInArrow(write, "path string, size long"))


def candidates(data, start: int, end: int) -> tuple[list[int], list[int]]:
    """Offsets of the magic that begin in [start, end), and where each says that it ends (-1: nowhere)."""
    offsets, after, stop, length, at = [], [], -1, None, data.find(MAGIC, start, min(len(data), end + len(MAGIC) - 1))
    while at >= 0:
        # A header ends at the first empty line, however far: a URL may be of any length. Magics
        # before that line share it and the next length field, so no byte is searched again
        # for each of them.
        if stop < at:
            stop = data.find(b"\r\n\r\n", at)
            stop = len(data) if stop < 0 else stop
            length = _LENGTH.search(data, at, stop + 2) if stop < len(data) else None
        elif length and length.start() < at:
            length = _LENGTH.search(data, at, stop + 2)
        to = stop + 8 + int(length[1]) if length else -1
        offsets.append(at)
        after.append(to if 0 < to <= len(data) and data[to - 4 : to] == b"\r\n\r\n" else -1)
        at = data.find(MAGIC, at + 1, min(len(data), end + len(MAGIC) - 1))
    return offsets, after


def reachable(offsets: np.ndarray, after: np.ndarray, size: int) -> np.ndarray:
    """Which of the sorted offsets the chain from offset 0 reaches, by pointer jumping.

    Raises if the chain stops before the end of the file.
    """
    n = len(offsets)
    to = np.searchsorted(offsets, after)
    known = (to < n) & (offsets[np.minimum(to, max(0, n - 1))] == after) if n else np.empty(0, bool)
    jump = np.r_[np.where(known, to, n), n]  # n: nowhere
    step, hit = jump.copy(), np.zeros(n + 1, bool)
    hit[0] = n > 0 and offsets[0] == 0
    while True:
        more = hit.copy()
        more[jump[hit]] = True
        if (more[:n] == hit[:n]).all():
            break
        hit, jump = more, jump[jump]
    hit = hit[:n]
    ends = after[hit & (step[:n] == n)]
    if size and (len(ends) != 1 or ends[0] != size):
        raise ValueError(f"the chain of records breaks off at {ends.tolist()} of {size} bytes")
    return hit


def _mapped(path: str):
    with open(path, "rb") as file:
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)


def boundaries(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Offsets of the true records of each file: path, packed offsets, at most 256 in a row."""
    spark = files.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = (
        files.where("size > 0")
        .select("path", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(range_bytes))).alias("start"))
        .repartition(parts, "path", "start")
    )

    def scan(batches):
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _mapped(path) as data:
                    offsets, after = candidates(data, start, min(size, start + range_bytes))
                packed = shards.pack(np.array(offsets, np.int64), np.array(after, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([packed], pa.binary())], names=["path", "size", "data"])

    def chain(table):
        path, size = table.column("path")[0].as_py(), table.column("size")[0].as_py()
        offsets, after = shards.unpack(table.column("data").to_pylist(), "i8", "i8")
        order = np.argsort(offsets)
        offsets = offsets[order]
        true = offsets[reachable(offsets, after[order], size)]
        rows = [true[i : i + 256].tobytes() for i in range(0, len(true), 256)]
        return pa.table({"path": pa.array([path] * len(rows), pa.string()), "offsets": pa.array(rows, pa.binary())})

    found = ranges.mapInArrow(scan, "path string, size long, data binary")
    return found.groupBy("path").applyInArrow(chain, "path string, offsets binary")


def _parse(data, at: int, with_payload: bool) -> tuple:
    stop = data.find(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at:stop].decode().split("\r\n")[1:])
    body = stop + 4
    split = data.find(b"\r\n\r\n", body) + 4
    end = body + int(head["Content-Length"])
    number = lambda name: int(x) if (x := head[name][len("<urn:x-page:") : -1]) else None
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    url = json.loads(head["X-Given-URL"]) if "X-Given-URL" in head else head.get("WARC-Target-URI")
    if head["WARC-Type"] == "revisit":
        size, refers, payload = int(_LENGTH.search(data[body : split - 2])[1]), number("WARC-Refers-To"), None
    else:
        payload, refers = data[split:end], None
        size = len(payload)
        if base32_sha1(payload) != digest:
            raise ValueError(f"payload of the record at {at} does not have its digest")
    return number("WARC-Record-ID"), url, size, digest, head["WARC-Type"], refers, payload if with_payload else None


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of archives (path, size), each payload checked against its digest."""
    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def parse(batches):
        for batch in batches:
            for path, offsets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _mapped(path) as data:
                    rows = [_parse(data, int(at), with_payload) for at in np.frombuffer(offsets, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORDS.types, strict=True)], schema=_RECORDS)

    return boundaries(files).repartition(parts).mapInArrow(parse, RECORDS)


def query(spark, sf_dir):
    """op4: every page as a WARC record, read back from the archives."""
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH d AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT page_id, html, hex, (
    SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
      (instr('0123456789abcdef', substr(hex, 1 + (k * 5) // 4, 1)) - 1) * 16
      + coalesce(nullif(instr('0123456789abcdef', substr(hex || '0', 2 + (k * 5) // 4, 1)), 0), 1) - 1
    )::BIGINT // (1 << (3 - (k * 5) % 4))::BIGINT % 32, 1), '' ORDER BY k)
    FROM (SELECT unnest(range(32)) AS k)
  ) AS digest FROM d
), f AS (SELECT hex AS h, min(page_id) AS first FROM d GROUP BY hex)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b JOIN f ON hex = h
"""
