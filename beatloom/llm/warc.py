"""Legacy archive converter: ARC files, version 1 and 2, to WARC 1.1.

An ARC record is one header line and as many bytes as the line declares. Version 1 lines have five fields (URL,
IP address, date, type, length), version 2 lines ten (result code, checksum, location, offset and file name come
between type and length). The first record of a file, filedesc://, tells the version. The converter walks the file by
the declared lengths and synthesises WARC fields: WARC-Record-ID (a UUID of URL, date and digest), WARC-Date from
the 14-digit date, WARC-Type, WARC-Block-Digest and WARC-Payload-Digest (SHA-1, base 32).

Archives are rows of a table: name, content (the bytes of a whole archive file of about ARCHIVE_MB). Spark writes them to
the shared folder as Parquet, so writing is atomic and any executor can read them, each archive a row group, so that a
task holds one, whatever the input (common.stored with large_rows); export_archives() writes the files themselves, and
read_files() reads real .arc and .warc files.

Of response records with equal payloads of at least MIN_REVISIT bytes, that with the largest key stays a response and the
others become revisits, which carry headers only. Payload bytes are shuffled once, joined with a slim table of
digests; a very common payload is an ordinary skewed join, which Spark splits.

Cases: a null html is an empty payload; a null url becomes about:blank, and blanks and controls in urls are
percent-encoded; repeated rows with equal key and payload are responses and revisits like any others (of equal keys
the one with the largest record number is the response); a null page_id counts as the smallest; an empty table gives an
empty result; extra columns are ignored. A truncated or malformed record raises ValueError with its place, or ends its archive
if read_arc() is not strict.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ARCHIVE_MB, MIN_REVISIT = 4, 1000
#: Fixed values of the ARC format.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
ARC_NAMES = {1: ("url", "ip", "date", "mime", "length"), 2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length")}
#: All columns of a row group of pages are one range of bytes; a vectored read of it would hold it a second time, outside the heap.
ONE_RANGE = {"parquet.hadoop.vectored.io.enabled": "false"}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:beatloom:arc-to-warc")
WARC_VERSION = b"WARC/1.1"


def clean_url(url: str | None) -> str:
    """A URL fit for a line whose fields are parted by spaces."""
    if not url:
        return "about:blank"
    return "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) if b < 128 else f"%{b:02X}" for b in url.encode())


# ---- ARC ----
def arc_head(name: str, version: int, date: str = "19960101000000") -> bytes:
    body = f"{version} 0 beatloom\n{ARC_FIELDS[version]}\n".encode()
    extra = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, block: bytes, ip: str = "0.0.0.0", date: str = "20000101000000", mime: str = "text/html", status: int = 200, offset: int = 0, name: str = "-") -> bytes:
    middle = "" if version == 1 else f"{status} {hashlib.md5(block).hexdigest()} - {offset} {name} "
    return f"{url} {ip} {date} {mime} {middle}{len(block)}\n".encode() + block + b"\n"


# Lines are read from both ends, so that a blank in the URL or the type does no harm.
_LINES = {
    1: re.compile(r"(.*) (\S+) (\d{4,17}) (.*) (\d+)"),
    2: re.compile(r"(.*) (\S+) (\d{4,17}) (.*) (\d+|-) (\S+) (\S+) (\d+) (\S+) (\d+)"),
}


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file, compressed or not: the fields of their lines, and block, the declared bytes."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, version = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC: no end of line after byte {at}")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        head = line.startswith("filedesc://")
        if version is None and not head:
            raise ValueError("ARC: the file does not begin with filedesc://")
        tried = (2, 1) if head else (version,)
        version, found = next(((v, m) for v in tried if (m := _LINES[v].fullmatch(line))), (version, None))
        if found is None:
            raise ValueError(f"ARC: malformed record line at byte {at}")
        record = dict(zip(ARC_NAMES[version], found.groups(), strict=True))
        start, length = end + 1, int(record["length"])
        if start + length > len(data):
            raise ValueError(f"ARC: the record at byte {at} declares more bytes than there are")
        record["block"] = data[start : start + length]
        if head:
            version = 2 if record["block"][:1] == b"2" else 1
        else:
            yield record
        at = start + length
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1


# ---- WARC ----
def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head, with its blank line, and payload; a block that is no HTTP message is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def digest32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(url: str, date: str, payload_sha1: str, number: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} {payload_sha1} {number}')}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [WARC_VERSION, *(f"{k}: {v}".encode() for k, v in fields), f"Content-Length: {len(block)}".encode(), b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def iso_date(date: str) -> str:
    d = (date + "0101000000"[len(date) - 14 :] if 4 <= len(date) < 14 else date).ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC file: fields by lower-case name, and the block."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"WARC: no record at byte {at}")
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode()] = v.strip().decode()
        start, length = end + 4, int(fields["content-length"])
        if start + length + 4 > len(data):
            raise ValueError(f"WARC: the record at byte {at} declares more bytes than there are")
        yield fields, data[start : start + length]
        at = start + length + 4


# ---- Spark jobs ----
def _archives(rows: Iterator[pd.DataFrame], one: object, head: object, suffix: str) -> Iterator[pd.DataFrame]:
    """Archives of about ARCHIVE_MB from what one(row, name, offset) gives for each row."""
    from pyspark import TaskContext

    task, n, parts, size, name = TaskContext.get().partitionId(), 0, [], 0, ""

    def out() -> pd.DataFrame:
        return pd.DataFrame({"name": [name], "content": [b"".join(parts)]})

    for batch in rows:
        for row in batch.itertuples(index=False):
            if not parts:
                name = f"part-{task:05d}-{n:05d}.{suffix}"
                parts.append(head(name, n))
                size = len(parts[0])
            parts.append(data := one(row, name, n, size))
            size += len(data)
            if size >= ARCHIVE_MB << 20:
                yield out()
                parts, n = [], n + 1
    if parts:
        yield out()


def write_arc(pages: DataFrame) -> DataFrame:
    """name, content: pages as ARC archives, versions 1 and 2 in turn. The key goes into the HTTP head."""

    def one(row: object, name: str, n: int, offset: int) -> bytes:
        payload = ("" if row.html is None else row.html).encode()
        key = "" if row.page_id is None else row.page_id
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {key}\r\nContent-Length: {len(payload)}\r\n\r\n"
        return arc_record(1 + n % 2, clean_url(row.url), head.encode() + payload, offset=offset, name=name)

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    return rows.mapInPandas(lambda it: _archives(it, one, lambda name, n: arc_head(name, 1 + n % 2), "arc"), "name string, content binary")


RECORDS = "rec string, key long, url string, date string, mime string, ip string, status int, head binary, payload binary, payload_sha1 string, payload_bytes long"


def page_key(head: bytes) -> int | None:
    """The number in the first X-Page-Id line that has one, a signed 64-bit integer; null where a foreign header has none or something else."""
    for line in head.split(b"\r\n"):
        if line.lower().startswith(b"x-page-id:") and re.fullmatch(rb"-?[0-9]{1,19}", value := line[10:].strip()):
            if -(2**63) <= (n := int(value)) < 2**63:
                return n
    return None


def _records(name: str, content: bytes, strict: bool) -> Iterator[tuple]:
    records = enumerate(parse_arc(content))
    while True:
        try:
            k, r = next(records)
        except StopIteration:
            return
        except (ValueError, OSError, EOFError):
            if strict:
                raise
            return
        head, payload = split_http(r["block"])
        key = page_key(head)
        status = int(head[9:12]) if head[9:12].isdigit() else None
        yield f"{name}#{k:09d}", key, clean_url(r["url"]), r["date"], r["mime"], r["ip"], status, head, payload, hashlib.sha1(payload).hexdigest(), len(payload)


def read_arc(archives: DataFrame, strict: bool = True) -> DataFrame:
    """One row a record of ARC archives; rec names it: archive and number.

    A malformed archive raises, or, if not strict, gives the records before the fault; arc_errors() tells which those are.
    """

    @common.in_task
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                out = pd.DataFrame(list(_records(name, bytes(content), strict)), columns=[x.split()[0] for x in RECORDS.split(", ")])
                out["key"], out["status"] = out["key"].astype("Int64"), out["status"].astype("Int64")
                yield out

    return archives.select("name", "content").mapInPandas(run, RECORDS)


def arc_errors(archives: DataFrame) -> DataFrame:
    """name, records, error of the archives that cannot be read to their end."""

    @common.in_task
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            rows = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                n = 0
                try:
                    for _ in parse_arc(bytes(content)):
                        n += 1
                except (ValueError, OSError, EOFError) as e:
                    rows.append((name, n, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["name", "records", "error"]).astype({"records": "int64"})

    return archives.select("name", "content").mapInPandas(run, "name string, records long, error string")


def with_revisits(records: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Adds original: null, or for a revisit the record, key and URL it repeats. records is a stored table."""
    large = records.where(F.col("payload_bytes") >= min_bytes)
    best = large.groupBy("payload_sha1").agg(F.max(F.struct("key", "rec", "url", "date")).alias("original"), F.count("*").alias("n")).where("n > 1")
    best = common.stored(best.select("payload_sha1", "original"), "warc-originals")
    out = records.join(best, "payload_sha1", "left")
    own = F.col("original").isNull() | (F.col("original.rec") == F.col("rec")) | (F.col("payload_bytes") < min_bytes)
    return out.withColumn("original", F.when(~own, F.col("original")))


def write_warc(records: DataFrame) -> DataFrame:
    """name, content: WARC archives of records with their originals."""

    def one(r: object, name: str, n: int, offset: int) -> bytes:
        kind, block = ("response", bytes(r.head) + bytes(r.payload)) if pd.isna(r.o_rec) else ("revisit", bytes(r.head))
        fields = [
            ("WARC-Type", kind), ("WARC-Record-ID", record_id(r.url, r.date, r.payload_sha1, r.rec)), ("WARC-Date", iso_date(r.date)), ("WARC-Target-URI", r.url), ("WARC-IP-Address", r.ip),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(r.payload_sha1)).decode()), ("WARC-Block-Digest", digest32(block)), ("Content-Type", "application/http; msgtype=response"),
            ("X-Payload-Length", str(r.payload_bytes)),
        ]
        if kind == "revisit":
            fields += [
                ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(r.o_url, r.o_date, r.payload_sha1, r.o_rec)),
                ("WARC-Refers-To-Target-URI", r.o_url), ("WARC-Refers-To-Date", iso_date(r.o_date)), ("X-Refers-To-Page", r.o_key),
            ]
        return warc_record(fields, block)

    def head(name: str, n: int) -> bytes:
        body = b"software: beatloom\r\nformat: WARC File Format 1.1\r\n"
        return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, "", "", n)), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], body)

    flat = records.select("rec", "url", "date", "ip", "head", "payload", "payload_sha1", "payload_bytes", *[F.col(f"original.{c}").cast("string").alias(f"o_{c}") for c in ("key", "rec", "url", "date")])
    flat = flat.withColumn("payload", F.when(F.col("o_rec").isNull(), F.col("payload")))
    return flat.mapInPandas(lambda it: _archives(it, one, head, "warc"), "name string, content binary")


def read_warc(archives: DataFrame) -> DataFrame:
    """One row a response or revisit record, with digests checked against the bytes read."""
    schema = "page_id long, record_id string, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    @common.in_task
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            for content in batch["content"]:
                rows = []
                for f, block in parse_warc(bytes(content)):
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    if digest32(block) != f["warc-block-digest"]:
                        raise ValueError(f"WARC: block digest of {f['warc-record-id']} differs")
                    head, payload = split_http(block)
                    sha1 = base64.b32decode(f["warc-payload-digest"][5:]).hex()
                    if f["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != sha1:
                        raise ValueError(f"WARC: payload digest of {f['warc-record-id']} differs")
                    key = page_key(head)
                    to = f.get("x-refers-to-page")
                    rows.append((key, f["warc-record-id"], f["warc-target-uri"], f["warc-date"], int(f["x-payload-length"]), sha1, f["warc-type"], int(to) if to and to != "None" else None))
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
                out["page_id"], out["refers_to"] = out["page_id"].astype("Int64"), out["refers_to"].astype("Int64")
                yield out

    return archives.select("name", "content").mapInPandas(run, schema)


def read_files(spark: SparkSession, path: str, pattern: str = "*.{arc,arc.gz,warc}") -> DataFrame:
    """name, content of archive files of a folder; compressed ARC files are read as they are."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def export_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Each archive as a file in a folder that every executor mounts; name and size of what was written."""
    import os

    @common.in_task
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in it:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, f"{folder}/{name}")
            yield pd.DataFrame({"name": batch["name"], "bytes": batch["content"].map(len)})

    return archives.mapInPandas(run, "name string, bytes long")


def convert(arc_archives: DataFrame) -> DataFrame:
    """WARC archives of ARC archives."""
    records = common.stored(read_arc(arc_archives), "arc-records")
    return write_warc(with_revisits(records))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to ARC, ARC to WARC, and what the WARC archives say, read back."""
    pages = common.table(spark, sf_dir, "pages", **ONE_RANGE)
    arcs = common.stored(write_arc(pages), "arc", large_rows=True)
    records = common.stored(read_arc(arcs), "arc-records")
    common.drop_stored(arcs)
    warcs = common.stored(write_warc(with_revisits(records)), "warc", large_rows=True)
    common.drop_stored(records)
    return read_warc(warcs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
