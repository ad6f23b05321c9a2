"""WARC archives written and read back, with long records in segments.

Writing: a page becomes an HTTP response with chunked framing, and one ``response`` record,
or a ``revisit`` record without a payload if another page with the same payload (``LEAST`` bytes or more)
has a smaller ``page_id``. A block longer than ``SEGMENT`` bytes goes into a first segment and
``continuation`` records that name it as their origin, the last with the total length. Records
are written by Spark's text sink with the separator that ends a record, so archives may lie in any
store that Spark writes to; files are compressed and hold ``PER_FILE`` records at most.

Reading: each file is parsed once by one task, into a table that is written to the shared folder. Records in one piece are decoded
and their digest checked at once; of segments the bytes are kept, which are
grouped by their origin, ordered by number and joined; a missing number or another total length than
the declared one is reported in ``problem``, and so is broken framing, with a null payload. A revisit takes
its payload from the record it refers to. Where only lengths and digests are wanted, no payload leaves the task that decodes it.

A null page is an empty payload. Pages with equal payload and an equal smallest id are all
responses; null ids come last and never are the smallest of several, and pages of them alone are all
responses. Repeated rows give repeated records. An empty table gives an empty archive. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.plans.slices import attach
from obsframe.session import work_dir, write_once

LEAST = 100            # bytes from which equal payloads are stored once
SEGMENT = 1 << 16      # bytes of a block in one record
FRAME = 4096           # bytes of one chunk of the framing
PER_FILE = 2000        # records in one file, which bounds a file at PER_FILE * SEGMENT bytes
END = "\r\n\r\n"
# Ids travel as text through Python, where a column of whole numbers with a null becomes one of floats.
RECORD = "page_id string, refers_to string, record_type string, digest string, record_id string, origin string, number int, total long, block binary"
PARSED = f"{RECORD}, payload binary, payload_bytes long, problem string"
PAGE = "page_id string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string, problem string"


def frame(payload: bytes, size: int = FRAME) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[i:i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unframe(framed: bytes) -> bytes:
    """The payload of chunked framing, chunk extensions and trailers allowed; raises ValueError if it is broken."""
    found, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        size = int(framed[at:end].split(b";")[0].strip(), 16)
        if size == 0:
            return b"".join(found)
        at = end + 2 + size
        if size < 0 or framed[at:at + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it says")
        found.append(framed[end + 2:at])
        at += 2


def _record(kind: str, length: int, fields: list[tuple[str, object]], block: bytes) -> bytes:
    named = [("WARC-Type", kind), *fields, ("Content-Length", length)]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named if v is not None).encode() + b"\r\n" + block


def page_records(page_id, url, payload: bytes, digest: str, first, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, without the separator after them."""
    name = lambda: f"<urn:uuid:{uuid.uuid4()}>"
    target = re.sub(r"[\r\n]", "", url) if url else None
    own = [("WARC-Target-URI", target), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}"),
           ("X-Page-Id", page_id), ("Content-Type", "application/http;msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if first is not None:
        profile = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", first)]
        yield _record("revisit", len(head), [("WARC-Record-ID", name()), *own, *profile], head)
        return
    block, origin = head + frame(payload), name()
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    numbered = [("WARC-Segment-Number", 1)] if len(parts) > 1 else []
    yield _record("response", len(parts[0]), [("WARC-Record-ID", origin), *own, *numbered], parts[0])
    for number, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] if number == len(parts) else []
        yield _record("continuation", len(part), [("WARC-Record-ID", name()), ("WARC-Segment-Origin-ID", origin),
                                                  ("WARC-Segment-Number", number), *total], part)


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one file, compressed as a whole, by record, or not at all."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        at = start + int(fields["Content-Length"])
        number = lambda key: int(fields[key]) if key in fields else None
        yield (fields.get("X-Page-Id"), fields.get("X-Refers-To-Page"), fields["WARC-Type"],
               fields.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None, fields["WARC-Record-ID"],
               fields.get("WARC-Segment-Origin-ID"), number("WARC-Segment-Number"), number("WARC-Segment-Total-Length"), data[start:at])
        at += 4


def _payload(block: bytes) -> tuple[bytes | None, str | None]:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None, "no HTTP header"
    if b"transfer-encoding: chunked" not in head.lower():
        return body, None
    try:
        return unframe(body), None
    except ValueError as error:
        return None, f"framing: {error}"


def _page(page_id, refers_to, kind, digest, block, problem=None) -> tuple:
    payload = None
    if problem is None and kind != "revisit":
        payload, problem = _payload(block)
        found = hashlib.sha256(payload).hexdigest() if payload is not None else None
        problem = problem or (f"digest {found}" if digest and found != digest else None)
        digest = found if found else digest
    return page_id, payload, None if payload is None else len(payload), digest, kind, refers_to, problem


def _parsed(record: tuple, payloads: bool) -> tuple:
    """A segment as it is, another record decoded, without its block."""
    page_id, refers_to, kind, digest, record_id, origin, number, total, block = record
    if number is not None:
        return *record, None, None, None
    _, payload, size, digest, _, _, problem = _page(page_id, refers_to, kind, digest, block)
    return page_id, refers_to, kind, digest, record_id, origin, number, total, None, payload if payloads else None, size, problem


def _table(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


def write(pages: DataFrame, path: str, segment: int = SEGMENT, per_file: int = PER_FILE) -> None:
    """Write one archive record per row of ``pages`` (page_id, url, html), long ones in segments."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    long_enough = F.octet_length("html") >= LEAST
    first = keyed.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    shared = first.where("copies > 1 and first is not null").select("digest", "first")
    plain = attach(keyed, write_once(shared, "copies"), ["digest"]).select(F.col("page_id").cast("string"), "url", "html", "digest", F.when(
        ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).cast("string").alias("first"))

    def records(batches):
        for batch in batches:
            for page_id, url, text, digest, first in batch.itertuples(index=False, name=None):
                yield pd.DataFrame({"value": list(page_records(page_id, url, text.encode(), digest, first, segment))})

    written = plain.mapInPandas(records, "value binary").select(F.col("value").cast("string").alias("value"))
    written.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, payload, payload_bytes, payload_digest, record_type, refers_to, problem: one row per page of the archives below ``path``.

    Without ``payloads`` that column is null; lengths, digests and problems are those of the payloads all the same.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def parsed(batches):
        for batch in batches:
            for data in batch["content"]:
                records = (_parsed(r, payloads) for r in parse(bytes(data)))
                while held := list(islice(records, 200)):
                    yield _table(held, PARSED)

    found = write_once(files.mapInPandas(parsed, PARSED), "records")
    whole = found.where("number is null").withColumnRenamed("digest", "payload_digest").select([c.split()[0] for c in PAGE.split(", ")])
    parts = found.where("number is not null").select([c.split()[0] for c in RECORD.split(", ")])
    return whole.unionByName(reassemble(parts, payloads)).withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def reassemble(records: DataFrame, payloads: bool = True) -> DataFrame:
    """Pages from the segments of long records: grouped by origin, ordered, checked and decoded."""
    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("number")
        numbers, total = group["number"].tolist(), group["total"].max()
        block, first = b"".join(map(bytes, group["block"])), group.astype(object).where(group.notna(), None).iloc[0]
        problem = None
        if numbers != list(range(1, len(numbers) + 1)):
            problem = f"segments {numbers}"
        elif total != len(block):
            problem = f"{len(block)} bytes instead of {total}"
        page = _table([_page(first.page_id, first.refers_to, first.record_type, first.digest, block, problem)], PAGE)
        return page if payloads else page.assign(payload=None)

    return records.withColumn("origin", F.coalesce("origin", "record_id")).groupBy("origin").applyInPandas(joined, PAGE)


def resolve(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem; a revisit has the length of what it refers to."""
    sized = pages.drop("payload")
    own = sized.where("record_type != 'revisit'")
    origin = own.where(F.col("payload_bytes") >= LEAST).groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(
        F.max("payload_bytes").alias("_bytes"))
    revisits = attach(sized.where("record_type = 'revisit'").drop("payload_bytes"), origin, ["refers_to", "payload_digest"])
    revisits = revisits.withColumn("problem", F.when(F.col("_bytes").isNull(), "nothing to refer to").otherwise(F.col("problem")))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]
    return own.select(columns).unionByName(revisits.withColumnRenamed("_bytes", "payload_bytes").select(columns))


def round_trip(pages: DataFrame, segment: int = SEGMENT, per_file: int = PER_FILE) -> DataFrame:
    """Write the archives of all pages to the shared folder and read them back."""
    path = work_dir(pages.sparkSession, "warc")
    write(pages, path, segment, per_file)
    return resolve(write_once(read(pages.sparkSession, path, payloads=False), "pages"))


ROUND_TRIP_SQL = """
    WITH keyed AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
        FROM pages
    ), firsts AS (
        SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM keyed
    ), typed AS (SELECT *, payload_bytes >= 100 AND first <> page_id AS again FROM firsts)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN again THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem
    FROM typed
"""
