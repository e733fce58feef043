"""WARC derivative builder: metadata and plain-text conversion records out of responses.

Each response gives two records that refer to it by its record id: a metadata record with the page's title,
language and outlinks, the response's HTTP headers and payload digest; and a conversion record with the page's
plain text.  Both keep the target URI and date.  Records are DataFrame rows; ``written`` makes WARC files of them with
Spark's text source, and ``read`` reads WARC 1.0 and 1.1 files, plain or gzipped by record or whole.  A block is as
long as its Content-Length says, whatever it holds.  A file is read by one task, which holds it whole: WARC files
are of 1 GB by convention.

Defined cases: a null or empty page is a response with an empty payload, whose conversion is empty too; a null
URI is the empty one.  Record ids follow from key, URI and kind, so repeated rows have equal records.  A record that
is cut off, or without a length, is read as far as it goes, with ``intact`` false; what stands between records is
skipped.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
_END = "\r\n"
#: When pages carry no date of their own.
DATE = "2024-01-01T00:00:00Z"

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|title)\b.*?(?:</\1\s*>|\Z)|<head\b.*?(?:</head\s*>|(?=<body))", re.S | re.I)
#: A tag with quoted values read whole, or a declaration; a "<" that starts neither is text.
_MARKUP = re.compile(r"""</?([a-z][^\s/>]*+)(?:(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>|[^>]*+>)|<[!?][^>]*+>|</>""", re.I)
_BREAK = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol tr table article section nav footer header aside main blockquote pre br hr form title dl dt dd".split())


def plain_text(source: str | None) -> str:
    """All text of a page that is shown, a block a line."""
    text = _MARKUP.sub(lambda m: "\n" if m[1] and m[1].lower() in _BREAK else "", _DROP.sub("\n", source or ""))
    lines = (" ".join(html.unescape(x).split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def _id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n, end in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">")) for x in (F.substring(h, a, n), F.lit(end))])


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", date: str | None = None) -> DataFrame:
    """Response records of pages; ``date`` names a column with WARC dates, if there is one."""
    body = F.coalesce(F.col(source), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.octet_length(body).cast("string"), F.lit(_END + _END))
    uri = F.coalesce(F.col(url), F.lit(""))
    return pages.select(
        F.col(key).alias("key"),
        _id(F.coalesce(F.col(key).cast("string"), F.lit("")), uri, F.lit("response")).alias("record_id"),
        uri.alias("target_uri"),
        (F.col(date) if date else F.lit(DATE)).alias("date"),
        F.concat(head, body).alias("block"),
    )


def _split_head(block: Column) -> tuple[Column, Column]:
    """The HTTP header lines of a response block, and its payload."""
    at = F.locate(_END + _END, block)
    head = F.when(at > 0, F.substring(block, F.lit(1), at - 1)).otherwise(block)
    body = F.when(at > 0, F.substring(block, at + 4, F.length(block))).otherwise("")
    return head, body


def derived(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of response records (key, record_id, target_uri, date, block)."""

    @F.arrow_udf("string")
    def plain(sources: pa.Array) -> pa.Array:
        return pa.array([plain_text(s.as_py()) for s in sources], pa.string())

    head, body = _split_head(F.col("block"))
    parts = records.select("key", "record_id", "target_uri", "date", head.alias("head"), body.alias("body"), _digest(F.col("block")).alias("source_digest"))
    parts = parts.select("*", _digest(F.col("body")).alias("payload_digest"), plain("body").alias("plain"))
    head_lines = F.split("head", _END)
    lines = F.slice(head_lines, F.lit(2), F.size(head_lines))
    links = F.regexp_extract_all("body", F.lit(r"(?i)<a\s[^>]*?href=[\"']?([^\"'\s>]+)"), F.lit(1))
    title = F.trim(F.regexp_replace(F.regexp_extract("body", r"(?is)<title[^>]*>(.*?)</title", 1), r"\s+", " "))
    language = F.regexp_extract("body", r"(?i)<html[^>]*\slang=[\"']?([A-Za-z-]+)", 1)
    fields = F.concat(
        F.array(F.concat(F.lit("title: "), title), F.concat(F.lit("language: "), language), F.concat(F.lit("source-status: "), F.element_at(F.split("head", _END), 1)), F.concat(F.lit("source-payload-digest: "), F.col("payload_digest"))),
        F.transform(lines, lambda x: F.concat(F.lit("source-header: "), x)),
        F.transform(links, lambda x: F.concat(F.lit("outlink: "), x)),
    )
    notes = F.concat(F.array_join(fields, _END), F.lit(_END))

    def record(kind: str, content_type: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), F.lit(content_type).alias("content_type"), block.alias("block"))

    each = parts.select("*", F.explode(F.array(record("metadata", "application/warc-fields", notes), record("conversion", "text/plain; charset=utf-8", F.col("plain")))).alias("r"))
    return each.select(
        "key",
        "r.record_type",
        _id(F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("target_uri"), F.col("r.record_type")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        "r.content_type",
        lines.alias("source_headers"),
        "source_digest",
        "payload_digest",
        _digest(F.col("r.block")).alias("block_digest"),
        F.octet_length("r.block").cast("long").alias("content_length"),
        "r.block",
    )


def serialized(records: DataFrame, column: str = "value") -> DataFrame:
    """WARC text of each record, without the end mark that follows it."""
    fields = {"WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "WARC-Source-Digest": "source_digest", "WARC-Source-Payload-Digest": "payload_digest", "WARC-Block-Digest": "block_digest", "Content-Type": "content_type", "Content-Length": "content_length"}
    lines = [F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(_END)) for name, c in fields.items()]
    return records.select(F.concat(F.lit(VERSION + _END), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(_END), "block").alias(column))


def written(records: DataFrame, path: str) -> None:
    """WARC files under ``path``, one a task."""
    serialized(records).write.option("lineSep", _END + _END).text(path)


_START = re.compile(rb"^WARC/1\.[01]\r?$", re.M)
_BLANK = re.compile(rb"\r?\n\r?\n")


#: Bytes of a gzip member that are inflated at a time.
_STEP = 1 << 20


def _members(data: bytes) -> Iterator[bytes]:
    """The data itself, or that of each gzip member; each byte is looked at once, however many members there are."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        inflate, found = zlib.decompressobj(wbits=31), []
        try:
            while not inflate.eof and at < len(view):
                step = view[at : at + _STEP]
                found.append(inflate.decompress(step))
                at += len(step) - len(inflate.unused_data)
        except zlib.error:
            return
        yield b"".join(found)
        while at < len(view) and view[at] == 0:
            at += 1


def _fields(head: bytes) -> dict[str, str]:
    """Header fields; a line that starts with white space goes on from the one before."""
    found: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").splitlines()[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = (x.strip() for x in line.split(":", 1))
            found[name] = value
    return found


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """The records of a WARC file: headers, block, and whether it is whole."""
    waiting = b""

    def of(buffer: bytes, last: bool) -> Iterator[tuple[int, tuple | None]]:
        """Records and the places where they end."""
        at = 0
        while (start := _START.search(buffer, at)) and (blank := _BLANK.search(buffer, start.end())):
            fields = _fields(buffer[start.start() : blank.start()])
            length = next((v for k, v in fields.items() if k.lower() == "content-length"), "")
            after = _START.search(buffer, blank.end())
            end = blank.end() + int(length) if length.isdigit() else after.start() if after else len(buffer)
            if end > len(buffer) and not last:
                return
            block = buffer[blank.end() : end]
            yield min(end, len(buffer)), (fields, block, length.isdigit() and len(block) == int(length))
            at = end

    for member in _members(data):
        waiting, done = waiting + member, 0
        for done, record in of(waiting, False):  # noqa: B007
            yield record
        waiting = waiting[done:]
    for _, record in of(waiting, True):
        yield record


#: What ends a record and begins the next one.
_BETWEEN, _FIRST = "\r\n\r\nWARC/1.", b"WARC/1."


def read(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Records of WARC files: headers (map), block (binary), text (the block as UTF-8) and intact (whether it is whole).

    A file is read at once and goes by Content-Length; Spark can so read files of less than 2 GB.  For larger ones set
    ``whole`` to False: records are then cut where an empty line and a new version line follow, so files of any size
    are split over tasks (gzipped ones are streamed), and a block that has such lines itself is not intact.
    """
    schema = pa.schema([("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("intact", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block, whole in parsed(content.as_py() or b""):
                    rows.append({"headers": list(fields.items()), "block": block, "intact": whole})
                    size += len(block)
                    if len(rows) >= 1000 or size >= 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    if whole:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    else:
        pieces = spark.read.option("lineSep", _BETWEEN).option("recursiveFileLookup", "true").text(path).select(F.col("value").cast("binary").alias("v"))
        begun = F.when(F.substring("v", 1, len(_FIRST)) == F.lit(_FIRST), F.col("v")).otherwise(F.concat(F.lit(_FIRST), F.col("v")))
        files = pieces.where(F.octet_length("v") > 0).select(begun.alias("content"))
    found = files.mapInArrow(run, "headers map<string,string>, block binary, intact boolean")
    return found.select("headers", "block", F.expr("try_validate_utf8(cast(block as string))").alias("text"), "intact")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the derivative records of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return derived(responses(pages)).withColumnRenamed("key", "page_id")
