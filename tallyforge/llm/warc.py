"""WARC archives: a native writer and a salvage reader.

The writer builds records with column expressions and writes them through
Spark's text sink, so that archives can go to any store Spark can reach. The
reader checks every record (version line, headers, length, end mark, block
digest). After a failed check it searches for the next version line or gzip
member from which a valid record can be read, goes on there, and logs the
bytes between as quarantined.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_schema, batches_of, map_arrow, new_path, staged

VERSION = b"WARC/1.1"
#: Archives are cut at about so many bytes before compression.
ARCHIVE_BYTES = 8 << 20
#: Records of more than so many means are archived by size class.
LARGE = 8
RECORDS = "path string, member long, start long, end long, problem string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed digits of conv() and of RFC 4648
# a line that begins with white space goes on with the field before it
_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[!-9;-~]+:[^\r\n]*\r\n(?:[ \t][^\r\n]*\r\n)*)*)\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
#: Fields that every record has, and those that tell two records with one's end lost from one record with odd values.
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
_ONCE = frozenset((*MANDATORY, "warc-target-uri"))


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's UTF-8: five hex digits give four base32 digits."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def _base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def described(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes and payload_digest of pages; a null html is an empty payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), sha1_base32(payload).alias("payload_digest"),
    )


def catalogue(pages: DataFrame) -> DataFrame:
    """Pages without their payloads, equal rows counted: payload_digest, payload_bytes, page_id, url, n. It is written once."""
    return staged(described(pages).groupBy("payload_digest", "payload_bytes", "page_id", "url").agg(F.count(F.lit(1)).alias("n")), "warc-catalogue")


def _row_key() -> Column:
    """A string that is equal for rows equal in payload, page_id and url."""
    return F.concat_ws(":", "payload_digest", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.coalesce(F.md5("url"), F.lit("null")))


def deduplicated(pages: DataFrame, copies: DataFrame | None = None, *, min_bytes: int = 0) -> DataFrame:
    """One record for each page: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of at least ``min_bytes`` bytes the smallest page_id is
    the response (a null id comes after all others, the smaller url goes first
    among equal ids) and the others revisit it, without a payload. Equal rows
    are the same page fetched again: one may be the response, the rest are
    revisits. Null htmls are empty payloads; an empty table gives no records;
    other columns are not read.
    ``copies`` is the catalogue, where equal rows are counted before they move,
    so a payload that a third of the pages share is few rows there; payloads
    move dealt by digest and page together, equal rows merged first.
    """
    copies = catalogue(pages) if copies is None else copies
    order = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id"), F.col("url"))
    # written first, so that adaptive execution can split a digest that many pages share
    firsts = staged(copies.groupBy("payload_digest").agg(F.min(order).alias("first")), "warc-firsts")
    known = copies.join(firsts, "payload_digest")
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    known = known.withColumn("own", F.when(F.col("payload_bytes") < min_bytes, F.col("n")).when(is_first, 1).otherwise(0))
    revisits = (
        known.filter("n > own").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - F.col("own"))))
        .select("page_id", "url", F.lit(None).cast("string").alias("payload"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("first.page_id").alias("refers_to"))
    )
    named = known.filter("own > 0").select(_row_key().alias("_key"), "own")
    rows = described(pages).withColumn("_key", _row_key()).dropDuplicates(["_key"]).join(named, "_key")
    responses = rows.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("own").cast("long"))))
    return responses.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)


def record_text(date: str = "2000-01-01T00:00:00Z") -> Column:
    """A WARC record without its two closing line ends, from the columns of ``deduplicated``."""
    length, page = F.col("payload_bytes").cast("string"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), length, F.lit("\r\n\r\n"))
    block = F.concat(http, F.coalesce("payload", F.lit("")))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "%", "%25"), "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    return F.concat(
        F.concat_ws(
            "\r\n",
            F.lit(VERSION.decode()),
            line("WARC-Type", F.col("record_type")),
            line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
            F.when(F.col("url").isNotNull(), line("WARC-Target-URI", uri)),
            F.lit(f"WARC-Date: {date}"),
            F.when(F.col("record_type") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            F.when(F.col("record_type") == "revisit", line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("refers_to").cast("string"), F.lit("null")), F.lit(">")))),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            line("WARC-Block-Digest", F.concat(F.lit("sha1:"), sha1_base32(block))),
            F.lit("Content-Type: application/http; msgtype=response"),
            line("Content-Length", F.octet_length(block).cast("string")),
        ),
        F.lit("\r\n\r\n"),
        block,
    )


def mean_record_bytes(copies: DataFrame) -> int:
    """Mean size of a catalogue's response records: one payload for each digest, and its headers."""
    mean = copies.groupBy("payload_digest").agg(F.max("payload_bytes").alias("b")).agg(F.avg("b")).first()[0]
    return int(mean or 0) + 700


def write_archives(records: DataFrame, path: str, mean_bytes: int, *, most_bytes: int | None = None) -> None:
    """Writes the records of ``deduplicated`` as gzip-compressed WARC files below ``path``, where their payloads lie.

    A file of Spark's text sink is one gzip member with many records, cut by
    their number: about ARCHIVE_BYTES of records of ``mean_bytes`` (see
    ``mean_record_bytes``). A record of more than LARGE means goes to the
    files of its size class instead, which hold so few that they stay within
    ARCHIVE_BYTES, or one record if that is larger. So no file holds more than
    LARGE * ARCHIVE_BYTES or one record before compression, and the reader can
    hold one file at a time. ``most_bytes``, the largest record if it is known,
    saves the second pass where there are none of those.
    """
    mean = max(1, mean_bytes)
    size = F.coalesce(F.octet_length("payload"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0)) + 700
    write = lambda df: df.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // mean))
    write(records.filter(size <= LARGE * mean).select(record_text())).text(f"{path}/usual")
    if most_bytes is None or most_bytes > LARGE * mean:
        # a task's rows are numbered, and a part of a class takes as many numbers as records of that size fit a file
        size_class = F.ceil(F.log2(size)).cast("int")
        fit = F.greatest(F.lit(1), F.floor(F.lit(ARCHIVE_BYTES) / F.pow(F.lit(2.0), size_class)))
        large = records.filter(size > LARGE * mean).withColumn("_number", F.monotonically_increasing_id())
        write(large.select(record_text().alias("value"), size_class.alias("class"), F.floor(F.col("_number") / fit).alias("part"))).partitionBy("class", "part").text(f"{path}/large")


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes
    #: Where the gzip member begins in the file; start and end then count its bytes after inflation.
    member: int | None = None


@dataclass
class Gap:
    """Quarantined bytes and the check that failed first."""

    start: int
    end: int
    problem: str
    member: int | None = None


def _fields(head: bytes) -> dict[str, str]:
    """The header fields by lower-case name, the first of each; ValueError if the end of one record and the head of another are in it.

    Any field may stand several times, and any value may end like a version
    line. Only both together, for a field that a record has once, tell that
    the text between is lost.
    """
    found: dict[str, str] = {}
    before: set[str] = set()  # the fields up to the last value that ends in a version line
    for line in re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[:-1]:
        name, _, value = line.partition(":")
        name = name.lower()
        if name in before and name in _ONCE:
            raise ValueError("headers of two records")
        found.setdefault(name, value.strip())
        if re.search(r"WARC/1\.[01]$", value):
            before = set(found)
    return found


def read_record(data: bytes, at: int, *, whole: bool = False) -> Record:
    """The valid record at ``at``; ValueError says which check failed, and Damaged where the record ends all the same.

    With ``whole`` the fields that every record must have are asked for, as
    where the reader looks for a place to go on: the tail of a damaged record
    can look like a record without them.
    """
    head = _HEAD.match(data, at) or _fail("version line or headers")
    headers = _fields(head[1])
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,15}", length):
        raise ValueError("content length")
    if whole and not all(headers.get(name) for name in MANDATORY):
        raise ValueError("mandatory headers")
    start = head.end()
    end = start + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("end of block")
    block = bytes(data[start:end])
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:].upper() != _base32(block):
        raise Damaged("block digest", end + 4)
    return Record(at, end + 4, headers, block)


class Damaged(ValueError):
    """A damaged record with an end mark where its length says; what follows from ``end`` on may be sound."""

    def __init__(self, problem: str, end: int):
        super().__init__(problem)
        self.end = end


def _fail(what: str):
    raise ValueError(what)


def inflate(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What the gzip member at ``at`` holds, and where it ends; None if it is damaged or cut, with what comes before the damage."""
    unpack, parts, place = zlib.decompressobj(31), [], at
    try:
        while place < len(data) and not unpack.eof:
            parts.append(unpack.decompress(data[place : place + 4096]))
            place += 4096
    except zlib.error:
        return b"".join(parts), None
    return b"".join(parts), min(place, len(data)) - len(unpack.unused_data) if unpack.eof else None


def salvage(data: bytes, version: re.Pattern = _NEXT) -> Iterator[Record | Gap]:
    """Valid records in order, plain or in gzip members of one record or many, and the gaps between them."""
    at, bad, problem = 0, -1, ""
    while at < len(data):
        found: list[Record | Gap] = []
        end: int | None = None
        reason = ""
        if version is _NEXT and data.startswith(b"\x1f\x8b\x08", at):
            inner, end = inflate(data, at)
            found = list(salvage(inner, _VERSION))
            for x in found:
                x.member = at
            reason = "gzip member"
            if not any(isinstance(x, Record) for x in found):
                found, end = [], end if end is not None and not inner else None
        else:
            try:
                found = [read_record(data, at, whole=bad >= 0)]
                end = found[0].end
            except ValueError as error:
                reason = str(error)
                # a block whose bytes are damaged between sound headers and a sound end hides no record
                beyond = getattr(error, "end", None)
                if beyond is not None and bad < 0 and (beyond == len(data) or version.match(data, beyond)) and not _ends_with_record(data, at, beyond):
                    yield Gap(at, beyond, reason)
                    at = beyond
                    continue
        if bad >= 0 and (found or end is not None):
            yield Gap(bad, at, problem)
            bad = -1
        yield from found
        if end is None:
            if bad < 0:
                bad, problem = at, reason
            following = version.search(data, at + 1)
            end = following.start() if following else len(data)
        at = end
    if bad >= 0:
        yield Gap(bad, len(data), problem)


def _ends_with_record(data: bytes, at: int, end: int) -> bool:
    """Whether a valid record inside ends where the record at ``at`` claims to: then that one lost its own end and its length reaches too far."""
    for m in _VERSION.finditer(data, at + 1, end):
        try:
            if read_record(data, m.start(), whole=True).end == end:
                return True
        except ValueError:
            pass
    return False


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn or "")
    return int(found[1]) if found else None


def _read_file(path: str, data: bytes, with_payload: bool) -> Iterator[tuple]:
    nothing = (None,) * 7
    for x in salvage(data):
        if isinstance(x, Gap):
            yield path, x.member, x.start, x.end, x.problem, *nothing
            continue
        kind = x.headers.get("warc-type")
        http = x.headers.get("content-type", "application/http").lower().startswith("application/http")
        head, _, payload = x.block.partition(b"\r\n\r\n") if http else (b"", b"", x.block)
        stated = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)", head)
        digest, n = x.headers.get("warc-payload-digest", "").removeprefix("sha1:"), len(payload)
        if kind == "response" and digest and digest != _base32(payload):
            yield path, x.member, x.start, x.end, "payload digest", *nothing
            continue
        if kind == "revisit":
            n = int(stated[1]) if stated else 0
        url = x.headers.get("warc-target-uri")
        if url is not None:
            url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        text = payload.decode("utf-8", "replace") if with_payload and kind == "response" else None
        yield path, x.member, x.start, x.end, None, _number(x.headers.get("warc-record-id")), url, kind, _number(x.headers.get("warc-refers-to")), n, digest or _base32(payload), text


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives below ``path`` (columns of RECORDS).

    A row whose ``problem`` is null is a record; other rows are quarantined
    bytes, start to end, with the check that failed first. Empty files give
    no rows. A task holds one archive at a time, beside Arrow's batch.

    Records of other writers and of any type are read: fields may be repeated
    or folded over lines and values may end like a version line; without a
    block digest the block is taken as it is. What a record does not state is
    null (page_id and refers_to also where the id is no ``urn:page``); the
    payload is the body of an HTTP block and else the whole block, its digest
    counted where none is stated; texts with bytes that are not UTF-8 get
    replacement characters. Repeated records are repeated rows.
    """
    schema = arrow_schema(RECORDS)

    def run(batches):
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from _read_file(batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer().to_pybytes() if batch.column(1)[i].is_valid else b"", with_payload)

        yield from batches_of(rows(), schema)

    return map_arrow(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"), run, RECORDS)


def check_complete(records: DataFrame, copies: DataFrame) -> None:
    """An error unless the archives gave back one record for each page of the catalogue and no gap."""
    pages = copies.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    gaps, found = records.agg(F.count_if(F.col("problem").isNotNull()), F.count_if(F.col("problem").isNull())).first()
    if gaps or found != pages:
        raise RuntimeError(f"{pages} pages were archived; {found} records and {gaps} gaps came back")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    copies = catalogue(pages)
    most = copies.agg(F.max(F.col("payload_bytes") + F.coalesce(F.octet_length("url"), F.lit(0)))).first()[0]
    write_archives(deduplicated(pages, copies), path, mean_record_bytes(copies), most_bytes=(most or 0) + 700)
    records = staged(read_archives(spark, path, with_payload=False), "warc-records")
    check_complete(records, copies)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::BIGINT, 1)), '') AS payload_digest,
    row_number() OVER (PARTITION BY h ORDER BY page_id) AS k, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN first END AS refers_to FROM d
"""
