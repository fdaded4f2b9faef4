"""Web archive derivatives: metadata and plain-text conversion records of responses."""

from __future__ import annotations

import gzip
import html as references
import io
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowsift.llm.common import by_value, on_batches

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"

# HTML's element names. A quote counts in a tag only where a value begins.
LINES = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+"
#: what isn't text: comments, scripts and styles, tags that begin a line, other tags
MARKUP = re.compile(
    r"(?P<gap><!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>script|style)(?=[\s/>])" + ATTRIBUTES + r">.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z))"
    r"|(?P<line></?(?:" + LINES + r")(?=[\s/>])(?:" + ATTRIBUTES + r">|[^>]*(?:>|\Z)))"
    r"|</?[a-z](?:" + ATTRIBUTES + r">|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
SPACES = re.compile(r"[ \t\r\f\xa0]+")
NEW_LINES = re.compile(r" ?\n[ \n]*")


def record_id(*parts: Column) -> Column:
    """A record id made of what names the record: the same on every run."""
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """Response records ``(source_id, record_id, target_uri, date, block)`` of fetched pages."""
    body = F.coalesce(F.col(html), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2))
    return pages.select(
        F.col(id_col).alias("source_id"), record_id(F.lit("response"), F.col(id_col), F.col(url)).alias("record_id"),
        F.coalesce(F.col(url), F.lit("")).alias("target_uri"), F.lit(date).alias("date"), F.concat(head, body).alias("block"),
    )


def text_of(page: str) -> str:
    """The text of a page: lines of its blocks, with every character reference decoded once.

    Spaces that don't break are spaces. A comment, script or style without an end lasts to the end
    of the page, and so does a tag without one.
    """
    parts, at = [], 0
    for m in MARKUP.finditer(page):
        parts += [references.unescape(page[at : m.start()]), " " if m["gap"] else "\n" if m["line"] else ""]
        at = m.end()
    parts.append(references.unescape(page[at:]))
    return NEW_LINES.sub("\n", SPACES.sub(" ", "".join(parts))).strip(" \n")


def plain_text(body: Column) -> Column:
    def convert(pages: pa.Array) -> pa.Array:
        return pa.array((text_of(page.as_py()) if page.is_valid else None for page in pages), pa.string())

    return F.arrow_udf(convert, "string")(body)


def derive(records: DataFrame) -> DataFrame:
    """Two records per response: ``metadata`` and ``conversion``.

    ``(source_id, type, record_id, refers_to, target_uri, date, content_type, block, block_digest,
    source_block_digest, source_payload_digest)``. The metadata record holds the response's status
    line, its headers and its digests as fields; the conversion holds its plain text. Both refer to
    the response, whose date and target they keep, and to whose payload the digests belong.

    A block without a blank line is all header, its payload empty. Null blocks are empty, null
    targets stay empty. Rows that are alike give records with like ids. No shuffle.
    """
    block = F.coalesce("block", F.lit(""))
    at = F.instr(block, CRLF * 2)
    head = F.when(at > 0, F.substring(block, F.lit(1), at - 1)).otherwise(block)
    body = F.when(at > 0, F.substring(block, at + 4, F.length(block))).otherwise(F.lit(""))
    parts = records.select(
        "source_id", F.col("record_id").alias("refers_to"), F.coalesce("target_uri", F.lit("")).alias("target_uri"), "date",
        head.alias("head"), body.alias("body"), digest(block).alias("source_block_digest"), digest(body).alias("source_payload_digest"),
    ).withColumn("text", plain_text(F.col("body")))
    fields = F.concat(
        F.lit("source-status: "), F.substring_index("head", CRLF, 1), F.lit(CRLF),
        F.regexp_replace(F.when(F.instr("head", CRLF) > 0, F.concat(F.expr(f"substring(head, instr(head, '\\r\\n') + 2)"), F.lit(CRLF))).otherwise(F.lit("")), r"(?m)^([^\r\n:]+):", "source-header-$1:"),
        F.lit("source-block-digest: "), F.col("source_block_digest"), F.lit(CRLF),
        F.lit("source-payload-digest: "), F.col("source_payload_digest"), F.lit(CRLF),
    )
    both = F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    rows = parts.select("source_id", "refers_to", "target_uri", "date", "source_block_digest", "source_payload_digest", F.explode(both).alias("r"))
    rows = rows.select("source_id", "r.type", record_id(F.col("r.type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", "date", "r.content_type", "r.block", "source_block_digest", "source_payload_digest")
    return rows.withColumn("block_digest", digest(F.col("block")))


def record_text(records: DataFrame) -> DataFrame:
    """``(record)``: whole records as text, headers and block, without the two line ends after them."""
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return records.select(F.concat(
        F.lit(f"WARC/1.1{CRLF}"), header("WARC-Type", F.col("type")), header("WARC-Record-ID", F.col("record_id")),
        header("WARC-Refers-To", F.col("refers_to")), header("WARC-Target-URI", F.col("target_uri")), header("WARC-Date", F.col("date")),
        header("WARC-Block-Digest", F.col("block_digest")), header("WARC-Payload-Digest", F.col("source_payload_digest")),
        header("Content-Type", F.col("content_type")), header("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF), F.col("block"),
    ).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """Archive files, one per partition, compressed; Spark writes them wherever it can write."""
    record_text(records).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def parse_records(data: bytes):
    """``(headers, block)`` of each record of an archive file, compressed whole or record by record."""
    stream = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline().strip()):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip()] = value.strip()
        yield headers, stream.read(int(headers.get("Content-Length", 0)))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(headers, block)`` of all records below a path; an archive file is one task's work."""

    def make(batch):
        for data in batch.column("content").to_pylist():
            for headers, block in parse_records(data):
                yield pa.RecordBatch.from_arrays([pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary())], ["headers", "block"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(on_batches(make), "headers map<string,string>, block binary")


def report(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("source_id").alias("page_id"), "type", "record_id", "refers_to", "target_uri", "date", "content_type",
        F.octet_length("block").cast("long").alias("content_length"), "block_digest", "source_block_digest", "source_payload_digest",
    )


by_value(__name__)
