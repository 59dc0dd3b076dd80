"""WARC archives: writing pages as records with continuation segments, and putting the segments together again.

Writing: a record's block is an HTTP response head and the payload in chunked transfer framing. A block longer than a
segment is cut; the first piece is a `response` record with WARC-Segment-Number 1, the others are `continuation`
records that name it by WARC-Segment-Origin-ID, and the last one holds WARC-Segment-Total-Length. Of equal payloads of
some size, the one of the largest id is stored and the others are `revisit` records that refer to it. Spark's text
writer commits the files (whole-file gzip), so a lost task leaves no half archive, on any store that Spark writes to.

Reading: files are split into records by their Content-Length; continuation records are grouped by origin, ordered by
segment number, checked for gaps and for the total length, joined, and the chunked framing is decoded. A record
that fails a check comes out with the reason in `problem` and no payload; after bytes that are no record, reading goes
on at the next record head.

Defined cases: a null payload is empty; a null id is written without an id and is smaller than any other; of rows
that share id and payload each is a record with a record id of its own, and those of the largest id are each stored;
null URLs are written as `urn:page:<id>`, control characters in URLs as %XX; other columns are not looked at; an empty
table gives no records. Payloads are text; a segment ends between characters.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm._common import cut, map_batches

VERSION = "WARC/1.1"
#: Characters of a block's segment, of a chunk of the framing, and records of a file: together they bound a file's size.
SEGMENT_CHARS, CHUNK_CHARS, FILE_RECORDS = 16_384, 4_096, 2_000
#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 1_000
#: Up to so many repeated digests (some 40 bytes each) are broadcast to the pages; beyond it the pages are shuffled to them.
REPEATED = 200_000
_DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"


def head(fields: list[tuple[str, str]]) -> str:
    return VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"


def chunked(text: str) -> str:
    """The payload in chunked transfer framing: sizes in hex, a zero chunk at the end."""
    out = []
    for at in range(0, len(text), CHUNK_CHARS):
        piece = text[at : at + CHUNK_CHARS]
        out.append(f"{len(piece.encode('utf-8')):x}\r\n{piece}\r\n")
    return "".join(out) + "0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken or doesn't end."""
    out, at = [], 0
    while True:
        line = framed.find(b"\r\n", at)
        if line < 0:
            raise ValueError("a chunk has no size")
        n = int(framed[at:line].split(b";")[0], 16)
        at = line + 2
        if n == 0:
            return b"".join(out)
        if framed[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(framed[at : at + n])
        at += n + 2


def header_value(s: str) -> str:
    """Control characters would end a header line: they are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", s)


def records_of(page_id: int | None, url: str | None, payload: str, digest: str, refers_to: int | None, row: int = 0) -> list[str]:
    """The WARC records of a page, each as text without its last line feed (the text writer adds it). `row` tells equal pages apart."""
    record_id = hashlib.sha256(f"{page_id}|{url}|{digest}|{row}".encode()).hexdigest()
    identity = [("WARC-Date", _DATE), ("WARC-Target-URI", header_value(url) if url is not None else f"urn:page:{page_id}"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        identity.append(("X-Page-ID", str(page_id)))

    def whole(kind: str, number: str, fields: list[tuple[str, str]], block: str) -> str:
        own = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:sha256:{number}>"), *fields]
        kind_of_block = "application/http; msgtype=response"
        return (head([*own, ("Content-Type", kind_of_block), ("Content-Length", str(len(block.encode("utf-8"))))]) + block + _END)[:-1]

    status = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        profile = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers_to))]
        return [whole("revisit", record_id, identity + profile, status + f"Content-Length: {len(payload.encode('utf-8'))}\r\n\r\n")]
    block = status + "Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [block[at : at + SEGMENT_CHARS] for at in range(0, len(block), SEGMENT_CHARS)]
    if len(pieces) == 1:
        return [whole("response", record_id, identity, block)]
    out = [whole("response", record_id, [*identity, ("WARC-Segment-Number", "1")], pieces[0])]
    for k, piece in enumerate(pieces[1:], 2):
        fields = [("WARC-Date", _DATE), identity[1], ("WARC-Segment-Number", str(k)), ("WARC-Segment-Origin-ID", f"<urn:sha256:{record_id}>")]
        if k == len(pieces):
            fields.append(("WARC-Segment-Total-Length", str(len(block.encode("utf-8")))))
        out.append(whole("continuation", hashlib.sha256(f"{record_id}|{k}".encode()).hexdigest(), fields, piece))
    return out


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> None:
    """Writes the pages' records as .txt.gz archives under path.

    The winners of digests that occur repeatedly are found on lean rows and written. Up to REPEATED of them are broadcast
    to the pages, which then don't move; more are joined, and adaptive execution splits where one payload is very
    frequent. A row's number, which needs no shuffle, is part of its record ids: all records of a row are written by one
    task, and so agree on it.
    """
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.coalesce(F.col(payload_column), F.lit("")).alias("payload"))
    digest = F.sha1(F.col("payload").cast("binary"))
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("id", digest.alias("digest"))
    winners = large.groupBy("digest").agg(F.max("id").alias("winner"), F.count("*").alias("n")).where("n > 1").drop("n")
    winners = cut(winners, "winners")
    winners = F.broadcast(winners) if winners.count() <= REPEATED else winners
    rows = rows.withColumn("digest", digest).join(winners, "digest", "left")
    rows = rows.select("id", "url", "payload", "digest", F.when(~F.col("winner").eqNullSafe(F.col("id")), F.col("winner")).alias("refers_to"), F.monotonically_increasing_id().alias("row"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500).to_pydict()
                found = [r for row in zip(*part.values()) for r in records_of(*row)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["value"])

    rows.transform(map_batches, build, "value string").write.option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


_HEADER = re.compile(rb"([^\r\n:]+):[ \t]*([^\r\n]*)\r\n")


_FIELDS = ("kind", "record_id", "origin", "number", "total", "url", "page_id", "digest", "refers_to", "block", "problem")
_RECORD = "kind string, record_id string, origin string, number int, total bigint, url string, page_id bigint, digest string, refers_to bigint, block binary, problem string"
_ARROW = pa.schema(list(zip(_FIELDS, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()))))


def unzipped(data: bytes) -> bytes:
    """Plain bytes of an archive, plain or gzip (one member or several); of a cut-off member what can be read."""
    plain = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            plain.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    else:
        plain.append(data if not plain else b"")
    return b"".join(plain)


def parse(data: bytes) -> Iterator[tuple]:
    """The records of an archive as rows of _FIELDS; what is no record gives a row with a problem alone."""
    data, at = unzipped(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        try:
            if not data.startswith(b"WARC/", at) or end < 0:
                raise ValueError("no record begins")
            first = data.find(b"\r\n", at) + 2
            f = {k.decode("utf-8").lower(): v.decode("utf-8") for k, v in _HEADER.findall(data[first : end + 2])}
            number = lambda key: int(f[key]) if key in f else None  # noqa: E731, B023
            n = int(f["content-length"])
            block = data[end + 4 : end + 4 + n]
            if n < 0 or len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
                raise ValueError("a record is cut off")
            digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
            yield (
                f.get("warc-type"), f.get("warc-record-id"), f.get("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"),
                f.get("warc-target-uri"), number("x-page-id"), digest, number("x-refers-to-page-id"), block, None,
            )
            at = end + 8 + n
        except (ValueError, KeyError) as e:
            yield (*[None] * 10, f"at byte {at}: {e}")
            at = data.find(b"\r\n\r\nWARC/", at + 1) + 4
            if at < 4:
                return


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under path; a file is held in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for row in parse(data.as_py()):
                    rows.append(row)
                    held += len(row[9] or b"")
                    if held > 4_000_000:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select("content").transform(map_batches, run, _RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Records with the parts of their blocks in order: continuation records are put to their origin.

    Only records that have segments move. `problem` tells why a block isn't whole.
    """
    whole = records.where("number is null and (kind is null or kind <> 'continuation')").withColumn("parts", F.when(F.col("block").isNotNull(), F.array("block")))
    parts = records.where("number is not null").withColumn("origin", F.coalesce("origin", "record_id"))
    first = [F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("kind", "url", "page_id", "digest", "refers_to")]
    joined = parts.groupBy("origin").agg(
        *first,
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.sum(F.octet_length("block")).alias("length"),
    )
    gap = ~(F.col("parts.number") == F.sequence(F.lit(1), F.size("parts")))
    problem = (
        F.when(F.col("kind").isNull(), "the first segment is missing")
        .when(gap, "segments are missing or repeated")
        .when(F.col("total").isNull(), "the last segment is missing")
        .when(F.col("length") != F.col("total"), "the total length differs")
    )
    joined = joined.withColumn("problem", problem).withColumn("parts", F.col("parts.block"))
    shared = ["kind", "url", "page_id", "digest", "refers_to", "parts", "problem"]
    lost = records.where("number is null and kind = 'continuation'").withColumn("problem", F.lit("a continuation has no segment number"))
    lost = lost.withColumn("parts", F.lit(None).cast("array<binary>"))
    return whole.select(F.col("record_id"), *shared).unionByName(joined.select(F.col("origin").alias("record_id"), *shared)).unionByName(lost.select("record_id", *shared))


def payloads(whole: DataFrame) -> DataFrame:
    """Per record: page_id, url, record_type, refers_to, payload (null for a revisit), payload_bytes, payload_digest, problem.

    The digest of a stored payload is computed from what was read and must be that of the header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, declared, parts, problem in zip(*(batch.column(i) for i in (4, 5, 6, 7))):
                kind, declared, problem = kind.as_py(), declared.as_py(), problem.as_py()
                body, n, digest = None, None, declared
                if problem is None:
                    http, _, body = b"".join(parts.as_py()).partition(b"\r\n\r\n")
                    fields = {k.lower(): v for k, v in _HEADER.findall(http.partition(b"\r\n")[2] + b"\r\n")}
                    try:
                        if kind == "revisit":
                            body, n = None, int(fields[b"content-length"])
                        else:
                            body = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
                            n, digest = len(body), hashlib.sha1(body).hexdigest()
                            if declared is not None and digest != declared:
                                body, problem = None, "the payload's digest differs"
                    except (ValueError, KeyError) as e:
                        body, n, problem = None, None, f"the block is broken: {e}"
                out.append((body, n, digest, problem))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.string(), pa.string()))] if out else [pa.array([], t) for t in (pa.binary(), pa.int64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), batch.column(2), *columns], ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "problem"])

    columns = whole.select("page_id", "url", "refers_to", "record_id", "kind", "digest", "parts", "problem")
    return columns.transform(map_batches, run, "page_id bigint, url string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string, problem string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return payloads(reassemble(read_records(spark, path)))
