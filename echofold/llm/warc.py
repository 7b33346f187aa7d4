"""WARC: writing archives with segmented records, and reading them back with segment reassembly."""

from __future__ import annotations

import re
from base64 import b32encode
from hashlib import sha1

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, shared_path, staged

_CRLF = b"\r\n"
_DATE = "2020-01-01T00:00:00Z"  # a fixed date keeps archives reproducible


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return b32encode(sha1(payload).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without the two line ends that close it."""
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + _CRLF + block


def chunked(payload: bytes, size: int) -> bytes:
    """HTTP chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload in a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(_CRLF, at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != _CRLF:
            raise ValueError("chunk without its line end")
        out.append(body[at : at + n])
        at += n + 2


def split_records(data: bytes):
    """(headers, block) of each record of an archive, by Content-Length alone; header names in lower case."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        n = int(headers["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, block
        at = end + 8 + n


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?i)\r\ntransfer-encoding:\s*chunked", head) else body


def write_warc(pages: DataFrame, path: str, min_revisit: int = 0, segment_bytes: int = 65536, chunk_bytes: int = 16384, records_per_file: int = 1024, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write pages as WARC archives below path (part-*.txt, each a plain WARC file).

    Of pages with equal payloads (UTF-8; null: empty) of at least min_revisit bytes, that with the
    smallest id is the response and the others are revisits that name it; smaller payloads are all
    responses.  A response's HTTP message is chunk-framed; beyond segment_bytes it goes on in
    continuation records.  Spark's text writer commits the files, with the records' closing line
    ends as its separator, so a lost executor leaves no half archive.  A file holds at most
    records_per_file records, hence at most about records_per_file * segment_bytes bytes.

    A record is named by its page's id; where that is null or repeated, a suffix of task and row
    makes the name unique, and a revisit of such a page names it without the suffix.

    Equal payloads are found by SHA-1 and length: one aggregation with partial sums and one join of
    digests, without html, that Spark may split where one payload is very common.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    base = base.withColumns({"sha": F.sha1("html"), "n": F.length("html").cast("bigint")})
    digests = base.select("page_id", "sha", "n")
    first = digests.groupBy("sha", "n").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where((F.col("copies") > 1) & (F.col("n") >= min_revisit))
    repeats = digests.join(first, ["sha", "n"]).where(F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id"))).select("page_id", "sha", "n", "first_id")
    repeats = staged(repeats.where("page_id is not null").distinct(), "repeats")
    shared = base.where("page_id is not null").groupBy("page_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = staged(shared, "shared-ids")
    # by payload too: pages of one id may differ
    marked = base.join(few(repeats), ["page_id", "sha", "n"], "left").join(few(shared), "page_id", "left")

    def run(batches):
        row = 0
        for batch in batches:
            out = []
            for page, url, body, first_id, rows in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id", "rows")), strict=True):
                row += 1
                own = f":r{TaskContext.get().partitionId()}.{row}" if page is None or rows else ""
                rid = f"<urn:page:{'null' if page is None else page}{own}>"
                uri = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
                common = [("WARC-Record-ID", rid), ("WARC-Date", _DATE), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response")]
                digest = [("WARC-Payload-Digest", f"sha1:{digest32(body)}")]
                if first_id is not None:
                    extra = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{first_id}>"), ("X-Payload-Length", str(len(body)))]
                    out.append(record("revisit", common + digest + extra, b"HTTP/1.1 200 OK\r\n\r\n"))
                    continue
                message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(body, chunk_bytes)
                parts = [message[i : i + segment_bytes] for i in range(0, len(message), segment_bytes)]
                number = [("WARC-Segment-Number", "1")] if len(parts) > 1 else []
                out.append(record("response", common + digest + number, parts[0]))
                for k, part in enumerate(parts[1:], 2):
                    last = [("WARC-Segment-Total-Length", str(len(message)))] if k == len(parts) else []
                    out.append(record("continuation", [("WARC-Record-ID", f"{rid[:-1]}:{k}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", str(k)), *last], part))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = marked.select("page_id", "url", "html", "first_id", "rows").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path)


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Read archives back: page_id, url, record_type, refers_to, payload_bytes, payload_digest, ok (and payload).

    Files are parsed by Content-Length.  Whole responses are decoded where they are read.  Segments
    are grouped by their origin identifier (of one record only, so a group is one message), put in
    order of segment number, checked for gaps and against the total length, joined, and freed of
    chunk framing.  Rows whose segments or framing don't hold have ok false and null payload columns.
    A revisit has the digest it states, and its own stated payload length.
    """
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, ok boolean, stated string, origin string, segment int, total bigint, block binary" + ", payload binary" * payloads

    def number(urn: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)(?::r\d+\.\d+)?>", urn or "")
        return int(m[1]) if m else None

    def decoded(block: bytes, stated: str | None) -> dict:
        try:
            body = payload_of(block)
        except ValueError:
            return {"ok": False}
        own = digest32(body)
        return {"payload_bytes": len(body), "payload_digest": own, "ok": stated in (None, f"sha1:{own}")} | ({"payload": body} if payloads else {})

    def to_batch(rows: list[dict], arrow: pa.Schema):
        return pa.RecordBatch.from_pylist(rows, schema=arrow)

    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])

    def parse(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows, held = [], 0
                for h, block in split_records(data.as_py()):
                    kind, stated = h["warc-type"], h.get("warc-payload-digest")
                    row = {"record_type": kind, "stated": stated, "url": h.get("warc-target-uri"), "page_id": number(h.get("warc-record-id"))}
                    if kind == "revisit":
                        row |= {"refers_to": number(h.get("warc-refers-to")), "payload_bytes": int(h.get("x-payload-length", 0)), "payload_digest": (stated or "").removeprefix("sha1:"), "ok": True}
                    elif "warc-segment-number" in h:
                        row |= {"origin": h.get("warc-segment-origin-id", h["warc-record-id"]), "segment": int(h["warc-segment-number"]), "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, "block": block}
                    else:
                        row |= decoded(block, stated)
                    rows.append(row)
                    held += len(block)
                    if held > 8_000_000:
                        yield to_batch(rows, arrow)
                        rows, held = [], 0
                if rows:
                    yield to_batch(rows, arrow)

    records = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, schema)
    records = staged(records, "warc-records")
    whole = records.where("origin is null").drop("stated", "origin", "segment", "total", "block")

    plain = pa.schema([arrow.field(c) for c in whole.columns])

    def finish(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                parts = sorted(r["parts"], key=lambda p: p["segment"])
                block = b"".join(p["block"] for p in parts)
                total = next((p["total"] for p in parts if p["total"] is not None), None)
                head = parts[0]
                fine = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and total == len(block)
                rows.append({"page_id": head["page_id"], "url": head["url"], "record_type": "response"} | (decoded(block, head["stated"]) if fine else {"ok": False}))
            yield to_batch(rows, plain)

    part = F.struct("segment", "total", "page_id", "url", "stated", "block")
    segmented = records.where("origin is not null").groupBy("origin").agg(F.collect_list(part).alias("parts")).mapInArrow(finish, whole.schema)
    return whole.unionByName(segmented)


def warc_round_trip(pages: DataFrame, min_revisit: int = 0, **options) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: see write_warc and read_warc.

    page_id should be unique; rows with a null page_id are written as responses and come back with a
    null page_id, repeated rows as often as they occur.  A null url is read back as urn:none.
    """
    path = shared_path(pages.sparkSession, "warc")
    write_warc(pages, path, min_revisit, **options)
    return read_warc(pages.sparkSession, path)
