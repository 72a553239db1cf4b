"""WARC archives: writing records in segments, and reassembling them.

A response record holds an HTTP response whose body is in chunked transfer framing. A record block longer than
`segment` bytes is split: the first segment is the record itself with WARC-Segment-Number 1, the rest are
`continuation` records that name it in WARC-Segment-Origin-ID; the last one gives WARC-Segment-Total-Length. Reading
groups segments by origin, orders them by number, verifies that none is missing and that the length is right, decodes
the chunks, and verifies the payload's digest. Of records with equal payloads of `least` bytes or more the one with
the largest page_id is kept as response; the others are `revisit` records without a body.

Archives are written and read by Spark alone (a record ends with two line breaks, which is the text writer's line
separator), so the folder may be in any store. A file holds `per_file` records of at most `segment` bytes and
their headers: with the defaults under 70 MB before gzip, so a reader's task can hold it.

Defined cases: null html is an empty payload. A null page_id is a response that names no page. Repeated rows
are records of their own; those with the largest id are all responses. Extra columns are ignored. Damaged segments
raise, unless strict is false: then status says what is wrong. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.common import plain, shared_dir, stash

VERSION, END = b"WARC/1.1", b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line is missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is shorter than its size")
        parts.append(body[at : at + size])
        at += size + 2


def base32_digest(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def hex_digest(labelled: str) -> str:
    return base64.b32decode(labelled.partition(":")[2]).hex()


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without the two line breaks that end it."""
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return VERSION + b"\r\n" + head + b"\r\n" + block


def segments(fields: list[tuple[str, object]], origin: str, block: bytes, size: int) -> list[bytes]:
    """A record, or its segments."""
    if len(block) <= size:
        return [record(fields, block)]
    cuts = range(0, len(block), size)
    out = [record([*fields, ("WARC-Segment-Number", 1)], block[:size])]
    for n, at in enumerate(cuts):
        if n:
            more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{origin[:-1]}:{n + 1}>"), ("WARC-Date", dict(fields)["WARC-Date"]), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", n + 1)]
            if n + 1 == len(cuts):
                more.append(("WARC-Segment-Total-Length", len(block)))
            out.append(record(more, block[at : at + size]))
    return out


def parse(data: bytes):
    """The bytes of an archive -> (fields, block) of each record, by Content-Length."""
    at = 0
    while at < len(data):
        head = data.find(END, at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        fields = {}
        for line in data[at:head].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode()] = v.strip().decode()
        start = head + 4
        stop = start + int(fields["content-length"])
        if data[stop : stop + 4] != END:
            raise ValueError(f"record at byte {at} doesn't end where its length says")
        yield fields, data[start:stop]
        at = stop + 4


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _encode(segment: int, chunk: int, date: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            cols = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "serial"))
            for page, url, html, digest, refers, serial in zip(*cols):
                payload = (html or "").encode()
                name = f"<urn:page:{'' if page is None else page}:{serial}>"
                fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", date),
                          ("WARC-Target-URI", None if url is None else re.sub(r"[\s\x00-\x1f]", "%20", url)),
                          ("WARC-Payload-Digest", base32_digest(digest)), ("X-Payload-Length", len(payload)), ("X-Page-ID", page)]
                if refers is not None:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", refers), ("Content-Type", "application/http;msgtype=response")]
                    out.append(record(fields, HTTP))
                else:
                    fields.append(("Content-Type", "application/http;msgtype=response"))
                    out += segments(fields, name, HTTP + chunked(payload, chunk), segment)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return run


def write(pages: DataFrame, path: str, segment: int = 16384, chunk: int = 4096, per_file: int = 4096, least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> str:
    """pages (page_id, url, html) -> gzipped archives in path."""
    pages = pages if "url" in pages.columns else pages.withColumn("url", F.lit(None).cast("string"))
    pages = plain(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.withColumn("digest", F.sha1(body)).withColumn("n", F.octet_length(body)).withColumn("serial", F.monotonically_increasing_id())
    keep = pages.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("keep"), F.count("*").alias("c")).where("c > 1")
    pages = pages.join(keep.select("digest", "n", "keep"), ["digest", "n"], "left")
    pages = pages.withColumn("refers_to", F.when(F.col("page_id") < F.col("keep"), F.col("keep")))
    rows = pages.select("page_id", "url", "html", "digest", "refers_to", "serial").mapInArrow(_encode(segment, chunk, date), "record binary")
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    return path


READ = "origin string, number int, total long, kind string, page_id long, refers_to long, payload_bytes long, digest string, payload binary, block binary, status string"


def _decoded(fields: dict, block: bytes, with_payload: bool):
    """payload_bytes, digest, payload, status of a whole record."""
    try:
        if fields["kind"] == "revisit":
            return int(fields["bytes"]), hex_digest(fields["digest"]), None, "ok"
        payload = payload_of(block)
        found = hashlib.sha1(payload).hexdigest()
        status = "ok" if found == hex_digest(fields["digest"]) and len(payload) == int(fields["bytes"]) else "payload differs from its digest"
        return len(payload), found, payload if with_payload else None, status
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return None, None, None, f"unreadable: {e}"


def _rows(rows):
    import pyarrow as pa

    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _parse(with_payload: bool):
    def run(batches):
        import gzip

        long = lambda v: None if v is None else int(v)
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("content")[i].as_buffer().to_pybytes()
                out, held = [], 0
                for f, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    kind, number = f["warc-type"], long(f.get("warc-segment-number"))
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    own = {"kind": kind, "bytes": f.get("x-payload-length"), "digest": f.get("warc-payload-digest")}
                    row = [f.get("warc-segment-origin-id") or f["warc-record-id"], number, long(f.get("warc-segment-total-length")), kind,
                           long(f.get("x-page-id")), long(f.get("x-refers-to-page-id"))]
                    if number is None:
                        out.append((*row, *(d := _decoded(own, block, with_payload))[:3], None, d[3]))
                    else:
                        out.append((*row, long(own["bytes"]), own["digest"], None, block, None))
                    held += len(block)
                    if held > 8 << 20:
                        yield _rows(out)
                        out, held = [], 0
                if out:
                    yield _rows(out)

    return run


def _join(with_payload: bool):
    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parts = row["parts"]
                numbers, head = [p["number"] for p in parts], parts[0]
                block = b"".join(p["block"] for p in parts)
                base = (row["origin"], 1, parts[-1]["total"], head["kind"], head["page_id"], head["refers_to"])
                if numbers != list(range(1, len(parts) + 1)) or parts[-1]["total"] is None:
                    out.append((*base, None, None, None, None, "segments are missing"))
                elif parts[-1]["total"] != len(block):
                    out.append((*base, None, None, None, None, "segments don't add up to the total length"))
                else:
                    d = _decoded({"kind": head["kind"], "bytes": head["payload_bytes"], "digest": head["digest"]}, block, with_payload)
                    out.append((*base, *d[:3], None, d[3]))
            yield _rows(out)

    return run


def read(spark: SparkSession, path: str, with_payload: bool = True, strict: bool = True) -> DataFrame:
    """Archives -> page_id, record_type, refers_to, payload_bytes, payload_digest, payload, status; one row per reassembled record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*part-*").load(path).select("content")
    found = stash(files.mapInArrow(_parse(with_payload), READ), "records")
    parts = found.where("number is not null").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "block", "total", "kind", "page_id", "refers_to", "payload_bytes", "digest"))).alias("parts"))
    whole = found.where("number is null").unionByName(parts.mapInArrow(_join(with_payload), READ))
    if strict:
        bad = F.raise_error(F.concat(F.lit("WARC record "), F.col("origin"), F.lit(": "), F.col("status")))
        whole = whole.withColumn("status", F.when(F.col("status") == "ok", F.col("status")).otherwise(bad.cast("string")))
        whole = whole.where("status is not null")
    return whole.select("page_id", F.col("kind").alias("record_type"), "refers_to", "payload_bytes", F.col("digest").alias("payload_digest"), "payload", "status")


def archive(pages: DataFrame, with_payload: bool = False, **parameters) -> DataFrame:
    """Writes the archives into the shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/ctxloom-warc-{uuid.uuid4().hex}"
    return read(spark, write(pages, path, **parameters), with_payload)
