"""Legacy archive converter: ARC records to WARC.

ARC (versions 1 and 2) files start with a version block, `filedesc://...`, whose second
line names the version and whose third one names the fields of every later header line.
Each record is a header line, as many bytes as its last field declares, and a newline.
The converter reads both versions by their declared lengths and synthesises what WARC
has and ARC lacks: a stable record id (UUID 5 of URL, date and digest), an ISO date,
the record type, and SHA-1 digests of block and payload. Of equal payloads the one with
the largest key is the response; the others become revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import shared_dir, table, tune

#: Fixed values of the formats: header fields of ARC 1 and 2, and the profile of revisits.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Payloads below this stay responses whatever their copies.
MIN_REVISIT = 1000
#: Bytes of one archive before compression, or one record if that is longer: what a task holds when it writes or reads one.
FILE_BYTES = 16 << 20
#: What closes a record.
CLOSE = b"\r\n\r\n"
EPOCH_DATE = "20000101000000"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def arc_clean(value: str | None) -> str:
    """A header field: white space and control characters percent-encoded, '-' for nothing."""
    if not value:
        return "-"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: "%%%02X" % ord(m[0]), value)


def arc_version_block(version: int, name: str, date: str = EPOCH_DATE) -> bytes:
    body = f"{version} {0 if version == 1 else 1} cytoquilt\n{ARC_FIELDS[version]}\n".encode()
    url = f"filedesc://{name}"
    if version == 1:
        head = f"{url} 0.0.0.0 {date} text/plain {len(body)}\n"
    else:
        head = f"{url} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n"
    return head.encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, mime: str, block: bytes, name: str, offset: int = 0, status: int = 200) -> bytes:
    if version == 1:
        head = f"{url} 0.0.0.0 {date} {mime} {len(block)}\n"
    else:
        head = f"{url} 0.0.0.0 {date} {mime} {status} {base32_sha1(block)} - {offset} {name} {len(block)}\n"
    return head.encode() + block + b"\n"


class ArcError(ValueError):
    """An archive that does not follow its own declared lengths or fields."""


def read_arc(raw: bytes) -> Iterator[dict]:
    """Records of one ARC file or of several joined ones; version and fields come from each version block."""
    at, names = 0, None
    while at < len(raw):
        if raw[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = raw.find(b"\n", at)
        if end < 0:
            raise ArcError(f"header line at {at} has no end")
        line = raw[at:end].decode("utf-8", "replace").rstrip("\r")
        parts = line.split(" ")
        if not parts[-1].isdigit():
            raise ArcError(f"no length in header line at {at}: {line[:80]!r}")
        size, start = int(parts[-1]), end + 1
        if start + size > len(raw):
            raise ArcError(f"record at {at} declares {size} bytes; {len(raw) - start} are left")
        block = raw[start : start + size]
        at = start + size
        if line.startswith("filedesc://"):
            version, fields = block.split(b"\n", 2)[:2]
            if version[:1] not in b"12" or not fields.strip():
                raise ArcError(f"unknown version block: {version[:40]!r}")
            names = fields.decode().strip().split(" ")
            continue
        if names is None:
            raise ArcError("a record stands before any version block")
        if len(parts) != len(names):  # a URL with blanks, as early crawlers wrote: the fields after it are counted from the end
            if len(parts) < len(names):
                raise ArcError(f"{len(parts)} fields in header line; the version block names {len(names)}")
            parts = ["%20".join(parts[: len(parts) - len(names) + 1]), *parts[len(parts) - len(names) + 1 :]]
        yield dict(zip(names, parts)) | {"block": block}


def http_payload(block: bytes) -> tuple[bytes, bytes]:
    """(HTTP head with its empty line, payload); a block without a head is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    for sep in (b"\r\n\r\n", b"\n\n"):
        at = block.find(sep)
        if at >= 0:
            return block[: at + len(sep)], block[at + len(sep) :]
    return block, b""


def iso_date(arc_date: str) -> str:
    d = (re.sub(r"\D", "", arc_date) + "00000000000000")[:14] if re.match(r"\d{8}", arc_date) else EPOCH_DATE
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, key: object = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {key}')}>"


def warc_record(rec: dict, kind: str, refers: str | None = None, refers_key: object = None, extra: dict[str, str] | None = None) -> bytes:
    """A WARC record without the two line ends that close it."""
    head, payload = http_payload(rec["block"])
    block = head if kind == "revisit" else rec["block"]
    digest = base32_sha1(payload)
    date = iso_date(rec["Archive-date"])
    lines = [
        "WARC/1.0",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(rec['URL'], rec['Archive-date'], digest, (extra or {}).get('X-Key', ''))}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {rec['URL']}",
        f"WARC-IP-Address: {rec['IP-address']}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers}", f"X-Refers-To-Key: {refers_key}"]
    lines += [f"{k}: {v}" for k, v in (extra or {}).items()]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def read_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record, by declared lengths."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if not raw.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at {at}")
        fields = {}
        for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip()] = v.strip()
        start = end + 4
        size = int(fields["Content-Length"])
        if start + size + 4 > len(raw):
            raise ValueError(f"record at {at} is cut short")
        yield fields, raw[start : start + size]
        at = start + size + 4


def gunzip(raw: bytes) -> bytes:
    """All members of a gzip file; other bytes are returned as they are."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw:
        d = zlib.decompressobj(31)
        out.append(d.decompress(raw))
        raw = d.unused_data
    return b"".join(out)


ARC_ROWS = StructType([StructField("key", LongType()), StructField("url", StringType()), StructField("ip", StringType()), StructField("date", StringType()), StructField("mime", StringType()), StructField("digest", StringType()), StructField("size", LongType()), StructField("block", BinaryType())])


def _arc_batch(rows: list[dict], with_block: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [f.name for f in ARC_ROWS.fields]
    cols = [[] for _ in names]
    for r in rows:
        _, payload = http_payload(r["block"])
        key = r["URL"].rpartition("#key=")[2] if "#key=" in r["URL"] else ""
        values = (int(key) if re.fullmatch(r"-?\d+", key) else None, r["URL"].rpartition("#key=")[0] if "#key=" in r["URL"] else r["URL"], r["IP-address"], r["Archive-date"], r["Content-type"], hashlib.sha1(payload).hexdigest(), len(payload), r["block"] if with_block else None)
        for c, v in zip(cols, values):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def pages_as_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Rows (arc binary): legacy segments with the pages, versions 1 and 2 in turn. The key rides in the URL's fragment."""
    tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, out, held = 0, [], 0
        for batch in batches:
            for key, url, body in zip(*(c.to_pylist() for c in batch.columns)):
                version, name = 1 + n % 2, f"segment-{n}.arc"
                body = body or b""
                if out and held + len(body) > FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["arc"])
                    n, out, held = n + 1, [], 0
                    version, name = 1 + n % 2, f"segment-{n}.arc"
                if not out:
                    out.append(arc_version_block(version, name))
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                out.append(arc_record(version, f"{arc_clean(url)}#key={'' if key is None else key}", EPOCH_DATE, "text/html", block, name))
                held += len(block)
            if out:  # a segment ends with its batch at the latest
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["arc"])
                n, out, held = n + 1, [], 0

    rows = pages.select(F.col(id_col).cast("long").alias("k"), F.col(url_col).cast("string").alias("u"), F.col(body_col).cast("binary").alias("b"))
    return rows.mapInArrow(run, StructType([StructField("arc", BinaryType())]))


def read_arc_files(spark, path: str) -> DataFrame:
    """Rows (arc binary) of ARC files, plain or gzip; each file is read whole by one task."""
    return spark.read.format("binaryFile").load(path).select(F.col("content").alias("arc"))


def parse_arc(arcs: DataFrame, with_block: bool = True) -> DataFrame:
    """ARC_ROWS of every record in rows (arc binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                some: list[dict] = []
                held = 0
                for r in read_arc(gunzip(raw.as_py() or b"")):
                    some.append(r)
                    held += len(r["block"])
                    if held > 4 << 20:
                        yield _arc_batch(some, with_block)
                        some, held = [], 0
                if some:
                    yield _arc_batch(some, with_block)

    return arcs.mapInArrow(run, ARC_ROWS)


def convert(arcs: DataFrame, out_path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Write the records of rows (arc binary) as gzip WARC files below out_path.

    Groups of equal payloads are found from digests alone, counted before the shuffle. Rows
    meet their group's largest key by a hash join, which adaptive execution splits where one
    digest is hot; bodies of revisits are not written. A file is one row of the writer, of
    FILE_BYTES at most or one record, however many partitions there are. Archives are parsed
    twice, for the digests and for the records: that costs time, but no copy on disk.
    """
    light = parse_arc(arcs, with_block=False).where(F.col("size") >= min_revisit)
    groups = light.groupBy("digest", "size").agg(F.max(F.struct("key", "url", "date")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), F.col("size").alias("s"), "top")
    rows = parse_arc(arcs)
    joined = rows.join(groups.hint("shuffle_hash"), (rows.digest == F.col("d")) & (rows["size"] == F.col("s")), "left").select(
        *[f.name for f in ARC_ROWS.fields], F.col("top.key").alias("top_key"), F.col("top.url").alias("top_url"), F.col("top.date").alias("top_date"), F.col("d").isNotNull().alias("grouped")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                rec = {"URL": r["url"], "IP-address": r["ip"], "Archive-date": r["date"], "block": r["block"]}
                again = r["grouped"] and r["key"] != r["top_key"]
                refers = record_id(r["top_url"], r["top_date"], base64.b32encode(bytes.fromhex(r["digest"])).decode(), str(r["top_key"])) if again else None
                raw = warc_record(rec, "revisit" if again else "response", refers, r["top_key"], {"X-Key": str(r["key"]) if r["key"] is not None else "", "X-Payload-Length": str(r["size"])})
                if out and held + len(raw) > FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([CLOSE.join(out)], pa.binary())], names=["records"])
                    out, held = [], 0
                out.append(raw)
                held += len(raw) + len(CLOSE)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([CLOSE.join(out)], pa.binary())], names=["records"])

    files = joined.mapInArrow(write, StructType([StructField("records", BinaryType())]))
    # the last record's closing line ends are the writer's separator, so a file is the records' bytes and nothing else
    files.select(F.col("records").cast("string").alias("value")).write.option("lineSep", CLOSE.decode()).option("maxRecordsPerFile", 1).option("compression", "gzip").text(out_path)


WARC_ROWS = StructType([StructField("key", LongType()), StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()), StructField("record_type", StringType()), StructField("refers_to", LongType()), StructField("record_id", StringType()), StructField("target_uri", StringType()), StructField("warc_date", StringType()), StructField("sound", IntegerType())])


def read_warc_files(spark, path: str) -> DataFrame:
    """WARC_ROWS of all records of the archives below path; `sound` is 0 where a digest does not fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in WARC_ROWS.fields]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]
        for batch in batches:
            for raw in batch.column(0):
                cols = [[] for _ in names]
                for f, block in read_warc(gunzip(raw.as_py() or b"")):
                    head, payload = http_payload(block)
                    declared = f["WARC-Payload-Digest"].partition(":")[2]
                    sound = f["WARC-Block-Digest"] == "sha1:" + base32_sha1(block) and (f["WARC-Type"] == "revisit" or declared == base32_sha1(payload))
                    size = len(payload) if f["WARC-Type"] != "revisit" else int(f["X-Payload-Length"])
                    refers = f.get("X-Refers-To-Key", "")
                    values = (int(f["X-Key"]) if f.get("X-Key") else None, size, base64.b32decode(declared).hex(), f["WARC-Type"], int(refers) if re.fullmatch(r"-?\d+", refers) else None, f["WARC-Record-ID"], f["WARC-Target-URI"], f["WARC-Date"], int(sound))
                    for c, v in zip(cols, values):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, WARC_ROWS)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """A record per page: null html is an empty payload; a null page_id is the least of its group."""
    pages = table(spark, sf_dir, "pages")
    where = shared_dir(spark, "warc")
    convert(pages_as_arc(pages), where)
    return read_warc_files(spark, where).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op2_warc": """
with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
w as (select *, max(page_id) over (partition by h) as top from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
from w"""
}
QUERIES = {"op2_warc": op2_warc}
