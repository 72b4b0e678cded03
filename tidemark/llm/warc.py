"""WARC archives (ISO 28500): writing, reading and reassembly of segments.

Writing: a page becomes a response record, or a revisit of the record with the
smallest id among those of equal payload. The HTTP block of a response carries
the payload in chunked transfer framing; a block longer than ``segment_bytes``
goes on in continuation records, spread over archives. Reading: records are
parsed out of archives; continuation records are grouped by the identifier of
their origin, ordered by segment number, their total length is verified, and
the chunked framing is decoded.

Records of one origin are all that meets in a task; whole archives are not
needed. In reading, records without continuation are not shuffled. Equal payloads
are found by digest: a minimum per digest, combined before the shuffle. In writing,
which rows are revisits comes to them by a join: html stays where it is while Spark
ships the revisits (ids and digests), and moves once when they are too many for that.

Memory: archives of about 1 MB are stored in row groups of ``GROUP_ROWS``, which are what
a task of Spark reads at once. Of a batch, Python makes a value at a time; ``told`` lets
payloads go where they are reassembled, as their digests and lengths.

Cases: null html is an empty payload, of which there is a response too;
equal rows (id and payload) are one record that gives as many rows, all of them
responses if their id is the smallest; a null id is never the smallest; ids may be
any text: names of records hold them percent-encoded, and a null id as no id at all; an empty table gives an empty table; other columns are ignored.
A missing or doubled segment, a wrong total or bad framing raises ValueError in
``reassembled``'s strict mode, else marks the record as damaged.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shipping import ship

from ._common import map_arrow, stage, trim, utf8

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: Spark reads up to 4096 rows of a row group into one array on the heap: here a row is an archive.
GROUP_ROWS = 8
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: object, digest: str) -> str:
    """By id and payload: rows that repeat an id with another payload are other records."""
    return f"<urn:warc:{digest}>" if page is None else f"<urn:warc:{digest}:{quote(str(page), safe='')}>"


def chunked(payload: bytes, chunk: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), chunk):
        data = payload[at : at + chunk]
        parts += (b"%x\r\n" % len(data), data, CRLF)
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size is cut off")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            while (end := body.find(CRLF, at)) > at:  # trailer fields
                at = end + 2
            if end < 0:
                raise ValueError("the end of the chunks is cut off")
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk does not have its length")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _clean(url: str | None) -> str | None:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None


def response(page: object, url: str | None, payload: bytes, segment: int = SEGMENT_BYTES) -> Iterator[tuple[int, bytes]]:
    """(segment number, record) of a response and its continuations."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts, digest = range(0, len(block), segment), sha1_base32(payload)
    for n, at in enumerate(cuts, 1):
        part = block[at : at + segment]
        fields: dict[str, object] = {"WARC-Type": "response" if n == 1 else "continuation"}
        fields["WARC-Record-ID"] = record_id(page, digest) if n == 1 else f"{record_id(page, digest)[:-1]};segment={n}>"
        fields["WARC-Date"] = DATE
        fields["WARC-Target-URI"] = _clean(url)
        if len(cuts) > 1:
            fields["WARC-Segment-Number"] = n
            if n > 1:
                fields["WARC-Segment-Origin-ID"] = record_id(page, digest)
            if n == len(cuts):
                fields["WARC-Segment-Total-Length"] = len(block)
        if n == 1:
            fields |= {"Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}"}
        yield n, record(fields, part)


def revisit(page: object, url: str | None, digest: str, of: object) -> bytes:
    return record(
        {
            "WARC-Type": "revisit", "WARC-Record-ID": record_id(page, digest), "WARC-Date": DATE, "WARC-Target-URI": _clean(url),
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(of, digest),
            "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response",
        },
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n",
    )


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record."""
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        if end < 0 or not archive.startswith(b"WARC/", at):
            raise ValueError("not at a WARC record")
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        size = int(fields["content-length"])
        if archive[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError("a record does not have its length")
        yield fields, archive[start : start + size]
        at = start + size + 4


def archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, segment: int = SEGMENT_BYTES) -> DataFrame:
    """The stored archives of the rows of ``pages``: (archive bytes), each some records."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    base = base.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    firsts = base.where(F.octet_length("html") >= min_bytes).groupBy(F.col("digest").alias("d")).agg(F.struct(F.min("page")).alias("of"))
    # only the digest is joined with the texts' ids: a text goes on if it is a response
    again = stage(
        base.select("page", "digest", F.octet_length("html").alias("n")).join(firsts, F.col("digest") == F.col("d"), "left")
        .where((F.col("n") >= min_bytes) & ~F.col("page").eqNullSafe(F.col("of.col1"))).select(F.struct("page", "digest").alias("p"), F.col("of.col1").alias("of")).distinct(),
        "revisits",
    )
    marked = base.join(again, F.struct("page", "digest").eqNullSafe(F.col("p")), "left").select(
        "page", "url", F.when(F.col("p").isNull(), F.col("html")).alias("html"), "digest", "of", F.col("p").isNotNull().alias("again")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(records_: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(records_)], type=pa.binary())], names=["archive"])

        # continuations go to an archive of their own, so that reading has to bring them together
        held: dict[bool, list[bytes]] = {False: [], True: []}
        size = {False: 0, True: 0}
        for batch in batches:
            cols = [batch.column(i) for i in range(6)]
            values = [utf8(c) if i == 2 else (x.as_py() for x in c) for i, c in enumerate(cols)]
            for page, url, text, digest, of, again in zip(*values, strict=True):
                if again:
                    made = [(1, revisit(page, url, base64.b32encode(bytes.fromhex(digest)).decode(), of))]
                else:
                    made = response(page, url, text, segment)
                for n, r in made:
                    held[n > 1].append(r)
                    size[n > 1] += len(r)
                    if size[n > 1] >= 1 << 20:
                        yield out(held[n > 1])
                        held[n > 1], size[n > 1] = [], 0
        for rest in held.values():
            if rest:
                yield out(rest)
        trim()

    ship(pages.sparkSession)
    rows = {"parquet__block__row__count__limit": GROUP_ROWS, "parquet__page__size__row__check__min": 1, "parquet__enable__dictionary": "false"}
    return stage(marked.mapInArrow(write, "archive binary"), "warc", **rows)


PARTS = "record string, type string, refers string, digest string, origin string, segment int, total long, block binary"


def parsed(stored: DataFrame) -> DataFrame:
    """A row for each record of the archives."""

    def rows(batch):
        for archive in batch.column(0):
            for f, block in records(archive.as_py()):
                n = f.get("warc-segment-number")
                total = f.get("warc-segment-total-length")
                yield (
                    f["warc-record-id"], f["warc-type"], f.get("warc-refers-to"), (f.get("warc-payload-digest") or "").partition(":")[2] or None,
                    f.get("warc-segment-origin-id") or (f["warc-record-id"] if n else None), int(n) if n else None, int(total) if total else None, block,
                )

    return map_arrow(stored.select("archive"), rows, PARTS, lambda r: len(r[7]))


def joined(parts: Iterable[tuple[int, int | None, bytes]]) -> bytes:
    """Block of a record from its segments: (number, total length or null, bytes)."""
    own = sorted(parts, key=lambda p: p[0])
    if [p[0] for p in own] != list(range(1, len(own) + 1)):
        raise ValueError("segments are missing or doubled")
    block = b"".join(p[2] for p in own)
    if own[-1][1] is None or own[-1][1] != len(block):
        raise ValueError("the segments do not have their total length")
    return block


def payload_of(block: bytes) -> bytes:
    head, cut, body = block.partition(b"\r\n\r\n")
    if not cut:
        raise ValueError("no end of the HTTP header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
    return dechunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body


def reassembled(
    parts: DataFrame, strict: bool = True, of: Callable[[bytes | None], tuple] = lambda payload: (payload,), columns: str = "payload binary"
) -> DataFrame:
    """record, type, refers, digest (as stored) and payload of every response
    and revisit; damaged is why a payload is null. ``of`` makes other ``columns``
    of a payload, which then does not leave its task."""
    part = F.struct("segment", "total", "block")
    whole = parts.where(F.col("origin").isNull()).select("record", "type", "refers", "digest", F.lit(1).cast("long").alias("times"), F.array(part).alias("parts"))
    # equal segments of repeated rows become one, so an origin has as many as its block fills
    once = parts.where(F.col("origin").isNotNull()).groupBy("origin", "segment").agg(
        F.max(F.when(F.col("type") != "continuation", F.col("type"))).alias("type"), F.max("refers").alias("refers"), F.max("digest").alias("digest"),
        F.max("total").alias("total"), F.first("block").alias("block"), F.count("*").alias("n"),
    )
    split = once.groupBy(F.col("origin").alias("record")).agg(
        F.max("type").alias("type"), F.max("refers").alias("refers"), F.max("digest").alias("digest"), F.max(F.when(F.col("segment") == 1, F.col("n"))).alias("times"),
        F.collect_list(part).alias("parts"),
    )

    def rows(batch):
        for name, type_, refers, digest, times, own in zip(*((x.as_py() for x in batch.column(i)) for i in range(6)), strict=True):
            payload = why = None
            try:
                block = own[0]["block"] if own[0]["segment"] is None else joined([(p["segment"], p["total"], p["block"]) for p in own])
                payload = None if type_ == "revisit" else payload_of(block)
            except (ValueError, IndexError) as e:
                if strict:
                    raise ValueError(f"{name}: {e}") from e
                why = str(e)
            made = of(payload)
            for _ in range(times or 1):
                yield name, type_, refers, digest, *made, why

    schema = f"record string, type string, refers string, digest string, {columns}, damaged string"
    return map_arrow(whole.unionByName(split), rows, schema, lambda r: sum(len(x) for x in r if isinstance(x, bytes)))


def page_of(record: str, kind: str) -> Column:
    """The id, of type ``kind``, in the name of a record (a column); null if it has none."""
    inside = F.regexp_extract(record, "^<urn:warc:[A-Z2-7]*:([^>]*)>$", 1)
    return F.when(F.col(record).rlike("^<urn:warc:[A-Z2-7]*:"), F.url_decode(inside)).try_cast(kind)


def _sums(payload: bytes | None) -> tuple[str | None, int | None]:
    return (None, None) if payload is None else (sha1_base32(payload), len(payload))


def told(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page, payload_bytes, payload_digest, record_type and refers_to of every row
    of ``pages``, as read back from the archives that are written of them."""
    got = reassembled(parsed(archives(pages, id_col, url_col, html_col)), of=_sums, columns="own string, n long")
    read = stage(got.select("record", "type", "refers", F.coalesce("own", "digest").alias("digest"), "n"), "read")
    kind = pages.schema[id_col].dataType.simpleString()
    sized = read.where("type = 'response'").select(F.col("record").alias("r"), F.col("n").alias("rn")).distinct()
    out = read.where("type = 'response'").withColumn("rn", F.col("n")).unionByName(
        read.where("type = 'revisit'").join(sized, F.col("refers") == F.col("r")).select(*read.columns, "rn")
    )
    return out.select(
        page_of("record", kind).alias("page"), F.col("rn").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", page_of("refers", kind)).alias("refers_to"),
    )


def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("page", "page_id")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT page_id, h, x, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(x, CAST(i AS INTEGER), 1)) - 1), 4, '0')), '') AS bits,
             min(page_id) OVER (PARTITION BY x) AS f FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
         + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INTEGER), 1) AS INTEGER) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INTEGER), 1) AS INTEGER)
         + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INTEGER), 1) AS INTEGER) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INTEGER), 1) AS INTEGER)
         + CAST(substr(bits, CAST(5 * i + 5 AS INTEGER), 1) AS INTEGER) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM b
"""
