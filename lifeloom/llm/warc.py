"""WARC archives: writing with segmentation and revisits, reading with segment reassembly.

Records are written as WARC/1.1 files, compressed with gzip, through Spark's own writer, so that archives can lie in any
store Spark writes.
A record's block is an HTTP response whose body has chunked transfer framing. A block longer than a segment is split:
the first segment keeps the record's type and id, the others are `continuation` records with WARC-Segment-Origin-ID
and ascending WARC-Segment-Number, the last one with WARC-Segment-Total-Length.

Reading parses the archives by Content-Length as it decompresses them (an archive may be one gzip member, as those written
here, or have one for each record), puts the segments of a record together where they follow one another in an archive, else
groups them by their origin and orders them by segment number, verifies the total length, decodes the chunks and compares the
payload with its digest.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from itertools import groupby
from typing import BinaryIO, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeloom.session import scratch_folder

#: Payloads from this length on are stored once; records with the same payload revisit it.
MIN_REVISIT = 1000
#: Bytes of a block's segment, about: cuts fall between characters, since archives are written as text.
SEGMENT = 16_384
#: Bytes of a chunk of the transfer framing, about.
CHUNK = 4096
#: Records (segments) of an archive, at most: about 128 MB before compression. Its compressed bytes are read as a whole, its
#: records one after another.
RECORDS = 8192
#: Bytes of blocks that leave the reader at once.
BATCH = 8_000_000
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n"


def record_id(page_id: int, row: int, segment: int = 1) -> str:
    """Of a segment of the record of a row: repeated rows have records of their own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{row}/{segment}')}>"


def cut(data: bytes, size: int) -> list[bytes]:
    """Pieces of about `size` bytes of UTF-8 data that never split a character."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in cut(payload, size)) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    """Payload of a body with chunked transfer framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk ends before its length")
        out.append(body[at : at + n])
        at += n + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> str:
    head = "".join(f"{k}: {v}{_END}" for k, v in (*headers, ("Content-Length", len(block))))
    return f"WARC/1.1{_END}{head}{_END}{block.decode('utf-8')}{_END}"


def records_of(
    page_id: int, row: int, url: str | None, payload: bytes, digest: str, refers_to: tuple[int, int] | None
) -> list[str]:
    """The record of a page, as one text for each of its segments."""
    uri = (url or f"urn:page:{page_id}").replace("\r", " ").replace("\n", " ")
    own = [("WARC-Record-ID", record_id(page_id, row)), ("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    own += [("Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        kind = [("WARC-Type", "revisit"), ("WARC-Profile", profile), ("WARC-Refers-To", record_id(*refers_to)), ("Refers-To-Page-ID", refers_to[0])]
        return [_record([*kind, *own], b"HTTP/1.1 200 OK\r\n\r\n")]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = cut(body, SEGMENT)
    if len(parts) == 1:
        return [_record([("WARC-Type", "response"), *own], body)]
    out = [_record([("WARC-Type", "response"), *own, ("WARC-Segment-Number", 1)], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, row, i)), ("WARC-Date", DATE), ("WARC-Target-URI", uri)]
        headers += [("WARC-Segment-Origin-ID", record_id(page_id, row)), ("WARC-Segment-Number", i)]
        out.append(_record(headers + ([("WARC-Segment-Total-Length", len(body))] if i == len(parts) else []), part))
    return out


def with_revisits(pages: DataFrame, minimum: int = MIN_REVISIT) -> DataFrame:
    """Pages (page_id, url, html) with row, digest and refers_to: row and largest page_id of the same payload.

    Payloads are grouped by SHA-1 and SHA-256, with partial sums before the shuffle; only payloads that occur
    again are joined back, and that join may be split where one payload is very common.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumns({"digest": F.sha1("html"), "strong": F.sha2("html", 256)})
    long = F.octet_length("html") >= minimum
    again = (
        rows.where(long)
        .groupBy("digest", "strong")
        .agg(F.max(F.struct("page_id", "row")).alias("kept"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    joined = rows.join(again, ["digest", "strong"], "left")
    refers = F.when(long & (F.col("kept.page_id") != F.col("page_id")), F.col("kept"))
    return joined.select("page_id", "row", "url", "html", "digest", refers["page_id"].alias("to_page"), refers["row"].alias("to_row"))


def _as_text(df: DataFrame, *columns: str) -> DataFrame:
    """df with whole numbers that may be null as text: pandas would hold them as floats, which round beyond 2^53."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def write_warc(pages: DataFrame, path: str, minimum: int = MIN_REVISIT) -> None:
    """Write a record for each row of pages (page_id, url, html) to archives under path.

    Null html is an empty payload, a null url becomes urn:page:<page_id>. Of repeated page_ids each row gives a
    record; those with the largest page_id of a payload are all responses. An empty table gives no record. Other columns
    are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            refers = [None if pd.isna(p) else (int(p), int(r)) for p, r in zip(b["to_page"], b["to_row"], strict=True)]
            lines = [
                r
                for i, n, u, h, d, to in zip(
                    b["page_id"].tolist(), b["row"].tolist(), b["url"], b["html"], b["digest"], refers, strict=True
                )
                for r in records_of(i, n, u, h.encode("utf-8"), d, to)
            ]
            yield pd.DataFrame({"value": lines})

    # Each record ends with two line ends: its own, and the writer's.
    rows = _as_text(with_revisits(pages, minimum), "to_page", "to_row")
    lines = rows.mapInPandas(run, "value string")
    lines.write.options(lineSep=_END, maxRecordsPerFile=RECORDS, compression="gzip").text(path)


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    ends = (b"\r\n", b"\n")
    while line := stream.readline():
        if line in ends:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in ends:
            if not line:
                raise ValueError("an archive ends within a record")
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("an archive ends within a record")
        yield headers, block


class Segment(NamedTuple):
    """A record of an archive; origin is its own id, or for a continuation record that of the record it continues."""

    origin: str
    segment: int
    total: int | None
    record_type: str | None
    page_id: int | None
    url: str | None
    digest: str | None
    refers_to: str | None
    refers_to_page: int | None
    last: bool
    block: bytes


_SEGMENTS = (
    "origin string, segment int, total long, record_type string, page_id long, url string, digest string, "
    "refers_to string, refers_to_page long, last boolean, block binary"
)
#: Columns that the first segment has for its whole record.
_FIELDS = ("record_type", "page_id", "url", "digest", "refers_to", "refers_to_page")
_RECORDS = (
    "record_id string, record_type string, page_id long, url string, digest string, refers_to string, "
    "refers_to_page long, payload binary"
)


def segments_of(data: bytes) -> Iterator[Segment]:
    """The records of an archive, compressed or not, in its order."""
    held = io.BytesIO(data)
    for h, block in parse(gzip.GzipFile(fileobj=held) if data[:2] == b"\x1f\x8b" else held):
        page, to = h.get("page-id"), h.get("refers-to-page-id")
        yield Segment(
            h.get("warc-segment-origin-id", h.get("warc-record-id")),
            int(h.get("warc-segment-number", 1)),
            int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None,
            h.get("warc-type"),
            int(page) if page else None,
            h.get("warc-target-uri"),
            h.get("warc-payload-digest"),
            h.get("warc-refers-to"),
            int(to) if to else None,
            "warc-segment-number" not in h,
            block,
        )


def _frames(rows: Iterator[tuple], schema: str) -> Iterator[pd.DataFrame]:
    """Rows, whose last column has bytes or nothing, in frames of about BATCH bytes."""
    columns = [f.split()[0] for f in schema.split(", ")]
    whole = {c: "Int64" for c in ("total", "page_id", "refers_to_page") if c in columns}

    def made(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=columns, dtype=object).astype(whole)

    out, size = [], 0
    for r in rows:
        out.append(r)
        size += 200 + len(r[-1] or b"")
        if size >= BATCH:
            yield made(out)
            out, size = [], 0
    yield made(out)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt{,.gz}").load(path).select("content")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under path; continuation records carry their origin's id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames((s for b in batches for data in b["content"] for s in segments_of(data)), _SEGMENTS)

    return _archives(spark, path).mapInPandas(run, _SEGMENTS)


def runs_of(segments: Iterator[Segment]) -> Iterator[tuple[bool, list[Segment]]]:
    """Segments of one origin that follow one another in an archive, and whether they are a record from end to end."""
    for _, found in groupby(segments, lambda s: s.origin):
        run = list(found)
        ends = run[0].last if len(run) == 1 else run[-1].total is not None
        yield ends and [s.segment for s in run] == list(range(1, len(run) + 1)), run


def payload_of(block: bytes) -> bytes:
    """Body of an HTTP response block, its transfer framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def checked(origin: str, single: bool, record_type: str | None, digest: str | None, parts: list[tuple]) -> bytes | None:
    """Payload of a record from its (segment, total, block) in order; None of a revisit. Raises ValueError if it isn't whole."""
    if [n for n, *_ in parts] != list(range(1, len(parts) + 1)):
        raise ValueError(f"segments of {origin} are missing or repeated")
    block = b"".join(x for *_, x in parts)
    if not single and parts[-1][1] != len(block):
        raise ValueError(f"segments of {origin} do not have their total length")
    if record_type == "revisit":
        return None
    payload = payload_of(block)
    if digest and digest.partition(":")[2] != hashlib.sha1(payload).hexdigest():
        raise ValueError(f"payload of {origin} does not have its digest")
    return payload


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, page_id, url, digest, payload, refers_to, refers_to_page) of each record under path.

    Records whose segments follow one another in their archive are put together where they are read, and only their ids
    are shuffled, to find repeated ones. All other segments are grouped by origin; one record's segments are all that a
    group ever holds. So archives are parsed twice. A missing or repeated segment, a wrong total length, a broken chunk or
    a payload that doesn't have its digest fails the read. The payload of a revisit is null.
    """

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = (run for b in batches for data in b["content"] for whole, run in runs_of(segments_of(data)) if whole)
        yield from _frames(
            (
                (
                    r[0].origin,
                    *(getattr(r[0], c) for c in _FIELDS),
                    checked(r[0].origin, r[0].last, r[0].record_type, r[0].digest, [(s.segment, s.total, s.block) for s in r]),
                )
                for r in found
            ),
            _RECORDS,
        )

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Segments that have to be grouped; of a record that was whole its id only, as segment 0."""
        found = (x for b in batches for data in b["content"] for x in runs_of(segments_of(data)))
        rows = (s for whole, run in found for s in ([(run[0].origin, 0, *[None] * 9)] if whole else run))
        yield from _frames(rows, _SEGMENTS)

    files = _archives(spark, path)
    first = F.col("segment") == 1
    grouped = (
        files.mapInPandas(apart, _SEGMENTS)
        .groupBy("origin")
        .agg(
            F.sort_array(F.collect_list(F.struct("segment", "total", "block"))).alias("parts"),
            *(F.max(F.when(first, F.col(c))).alias(c) for c in _FIELDS),
            F.bool_and("last").alias("single"),
        )
        .where((F.size("parts") > 1) | (F.col("parts")[0]["segment"] != 0))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            payloads = [
                checked(r.origin, r.single, r.record_type, r.digest, [(p["segment"], p["total"], p["block"]) for p in r.parts])
                for r in b.itertuples()
            ]
            found = b[["origin", *_FIELDS]].rename(columns={"origin": "record_id"}).assign(payload=payloads)
            for c in ("page_id", "refers_to_page"):
                found[c] = pd.array([None if pd.isna(x) else int(x) for x in found[c]], dtype="Int64")
            yield found

    rest = _as_text(grouped, "page_id", "refers_to_page").mapInPandas(run, _RECORDS)
    return files.mapInPandas(together, _RECORDS).unionByName(rest)


def new_folder(spark: SparkSession) -> str:
    return scratch_folder(spark, "warc")
