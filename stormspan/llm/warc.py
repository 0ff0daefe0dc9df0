"""WARC archives: writing with revisit records and segments, and reading with segment reassembly.

Writing gives one record for each row. Of rows with equal payloads of at least `min_revisit` bytes the one with the
smallest id is a response and the others are revisits of it. A response's block is an HTTP message in chunked transfer
framing. Blocks longer than `segment_bytes` are cut: the first segment is the response record, the others are
continuation records that name the origin, their segment number and, in the last, the total length. Files are written by
Spark's own writer, so any file system of the cluster and its commit protocol serve: each row is a record, and the line
end that the writer adds is the end that a record needs. A file holds at most `records_per_file` records of bounded size.

Reading parses each file as a stream. Whole records are decoded where they are read. Segments are grouped by origin,
ordered by number, checked for gaps and against the total length, joined, and their chunked framing decoded. Revisits
get their payload's length from the response that they refer to; that join deals by record id, and adaptive execution
may split a response with very many revisits.

Defined cases: null payloads are empty; rows with equal id and payload are, with `every_row`, numbered and records each for
itself, otherwise equal records that are read back as one; rows with equal id and other payloads are records each for
itself; a null id has no X-Page-ID field and is null again, and such a row is no revisit; an empty table gives no records; other columns are not read. A missing segment, a wrong
length, a broken chunk, a digest that doesn't fit or a revisit without its response raises an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormspan.llm.common import arrow_map, materialize, shared_dir

MIN_REVISIT = 100
SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 4 << 10
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What a parsed record holds; block is null where payload_* are known.
RECORD = "page_id long, record_id string, kind string, digest string, refers_to string, payload_bytes long, origin string, segment int, total long, block binary"
RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("kind", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])


def record_id(page_id: int | None, digest: str, part: int = 1, copy: int = 0) -> str:
    h = hashlib.sha256((f"{page_id}/{digest}/{part}" + f"/{copy}" * bool(copy)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; chunk extensions and trailers are passed over."""
    at, parts = 0, []
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunked body ends within a chunk size")
        size = int(body[at:line].split(b";", 1)[0].strip(), 16)
        if size == 0:
            return b"".join(parts)
        if body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        parts.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size


def decode_block(block: bytes) -> bytes:
    """The payload of an HTTP response message."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP header without an end")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def records_of(page_id: int | None, payload: bytes, digest: str, first: int | None, url: str | None, segment_bytes: int, copy: int = 0) -> Iterator[bytes]:
    """The records of a row, each without its last line end; copy numbers rows of equal id and payload from 0."""
    own = record_id(page_id, digest, copy=copy)

    def record(kind: str, ident: str, block: bytes, **fields: object) -> bytes:
        head = {"WARC-Type": kind, "WARC-Record-ID": ident, "WARC-Date": DATE, "WARC-Target-URI": "".join((url or "about:blank").split()) or "about:blank"} | ({} if page_id is None else {"X-Page-ID": page_id}) | {k.replace("_", "-"): v for k, v in fields.items()} | {"Content-Length": len(block)}
        return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n"

    if first is not None:
        yield record("revisit", own, HTTP_HEAD, WARC_Profile=PROFILE, WARC_Payload_Digest=f"sha256:{digest}", WARC_Refers_To=record_id(first, digest), Content_Type="application/http; msgtype=response")
        return
    block = HTTP_HEAD + chunked(payload)
    kinds = {"WARC_Payload_Digest": f"sha256:{digest}", "Content_Type": "application/http; msgtype=response"}
    if len(block) <= segment_bytes:
        yield record("response", own, block, **kinds)
        return
    n = -(-len(block) // segment_bytes)
    for k in range(n):
        part = block[k * segment_bytes : (k + 1) * segment_bytes]
        total = {"WARC_Segment_Total_Length": len(block)} if k == n - 1 else {}
        if k == 0:
            yield record("response", own, part, WARC_Segment_Number=1, **kinds)
        else:
            yield record("continuation", record_id(page_id, digest, k + 1, copy), part, WARC_Segment_Origin_ID=own, WARC_Segment_Number=k + 1, **total)


def writer(segment_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            held = 0
            for page, url, payload, digest, first, copy in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "first", "copy")), strict=True):
                for r in records_of(page.as_py(), payload.as_py() or b"", digest.as_py(), first.as_py(), url.as_py(), segment_bytes, copy.as_py()):
                    out.append(r)
                    held += len(r)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return write


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = 4096, compression: str = "gzip", every_row: bool = False) -> None:
    """Writes the archives below path; with every_row each row has a record id of its own."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    light = pages.select(F.col(id_col).cast("long").alias("page_id"), F.unhex(F.sha2(payload, 256)).alias("sha"), F.octet_length(payload).alias("n")).where(F.col("n") >= min_revisit)
    # Written first: joined with its own aggregation, a payload of very many rows couldn't be split by adaptive execution.
    repeats = materialize(light.groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("sha", "first"), "repeats")
    again = light.select("page_id", "sha").distinct().join(repeats, "sha").where("page_id > first")
    full = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha2("payload", 256)))
    copy = F.row_number().over(Window.partitionBy("page_id", "sha").orderBy(F.lit(0))) - 1 if every_row else F.lit(0)
    joined = full.join(again, ["page_id", "sha"], "left").select("page_id", "url", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"), F.lower(F.hex("sha")).alias("digest"), "first", copy.alias("copy"))
    made = arrow_map(joined, writer(segment_bytes), "record binary")
    made.select(F.col("record").cast("string")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


def stream(content: bytes) -> Iterator[bytes]:
    """Decompressed parts of a file's bytes; plain files as they are."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    at = 0
    view = memoryview(content)
    while at < len(content):
        one = zlib.decompressobj(31)
        while at < len(content) and not one.eof:
            data = view[at : at + (1 << 18)]
            yield one.decompress(data)
            at += len(data) - len(one.unused_data)
        if not one.eof:
            raise ValueError("a compressed archive ends early")


def parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    buffer, at = bytearray(), 0

    def fill(upto: int) -> bool:
        while len(buffer) < upto:
            more = next(parts, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while fill(at + 1):
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not fill(len(buffer) + 1):
                raise ValueError("an archive ends within a header")
        lines = bytes(buffer[at:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, size = end + 4, int(head["content-length"])
        if not fill(start + size + 4) or buffer[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield head, bytes(buffer[start : start + size])
        at = start + size + 4
        if at > 1 << 20:
            del buffer[:at]
            at = 0


def measured(block: bytes, digest: str) -> int:
    """Length of the payload, whose digest is checked."""
    payload = decode_block(block)
    if digest and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload digest doesn't fit")
    return len(payload)


def parser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RECORD_ARROW.types, strict=True)], schema=RECORD_ARROW)

    for batch in batches:
        for content in batch.column("content"):
            rows: list[tuple] = []
            for head, block in parse(stream(content.as_py())):
                kind, segment = head["warc-type"], int(head.get("warc-segment-number", 0))
                digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
                own = head["warc-record-id"]
                whole = kind == "response" and not segment
                rows.append((int(head["x-page-id"]) if "x-page-id" in head else None, own, kind, digest or None, head.get("warc-refers-to"), measured(block, digest) if whole else None, head.get("warc-segment-origin-id", own) if segment else None, segment or None, int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None, block if segment else None))
                if len(rows) >= 512:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)


def reassembler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "record_id", "digest", "payload_bytes"]
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            parts = x["parts"]
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                raise ValueError(f"{x['origin']}: segments {[p['segment'] for p in parts]}")
            block, total = b"".join(p["block"] for p in parts), parts[-1]["total"]
            if total != len(block):
                raise ValueError(f"{x['origin']}: {len(block)} bytes, its total length is {total}")
            rows.append((parts[0]["page_id"], x["origin"], parts[0]["digest"], measured(block, parts[0]["digest"])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names)


def read(spark: SparkSession, path: str, every_row: bool = False) -> DataFrame:
    """One row for each archived page: page_id, record_id, record_type, payload_bytes, payload_digest, refers_to (the response's page_id).

    every_row: the archives were written so; else records of equal id are one row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parsed = materialize(arrow_map(files, parser, RECORD), "parsed")  # three readers below
    parts = parsed.where("segment IS NOT NULL").dropDuplicates(["origin", "segment"]).groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("segment", "page_id", "digest", "total", "block"))).alias("parts"))
    long_ones = arrow_map(parts, reassembler, "page_id long, record_id string, digest string, payload_bytes long")
    responses = parsed.where("kind = 'response' AND segment IS NULL").select("page_id", "record_id", "digest", "payload_bytes").unionByName(long_ones)
    revisits = parsed.where("kind = 'revisit'").select("page_id", "record_id", "digest", F.col("refers_to").alias("_to"))
    # The responses that revisits refer to, each once, are written first, so a response of very many revisits can be split.
    known = responses.select(F.col("record_id").alias("_to"), F.col("page_id").alias("refers_to"), "payload_bytes").join(revisits.select("_to").distinct(), "_to", "left_semi")
    known = materialize(known.dropDuplicates(["_to"]), "known")
    resolved = revisits.join(known, "_to", "left").withColumn("payload_bytes", F.when(F.col("payload_bytes").isNull(), F.raise_error(F.concat(F.lit("no response for "), "_to")).cast("long")).otherwise(F.col("payload_bytes")))
    both = responses.select("page_id", "record_id", F.lit("response").alias("record_type"), "payload_bytes", F.col("digest").alias("payload_digest"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        resolved.select("page_id", "record_id", F.lit("revisit").alias("record_type"), "payload_bytes", F.col("digest").alias("payload_digest"), "refers_to")
    )
    return both if every_row else both.dropDuplicates(["record_id"])


def round_trip(pages: DataFrame, every_row: bool = False, **options: object) -> DataFrame:
    """Writes the archives into the shared folder and reads them back."""
    path = f"{shared_dir(pages.sparkSession)}/warc"
    write(pages, path, every_row=every_row, **options)
    return read(pages.sparkSession, path, every_row)
