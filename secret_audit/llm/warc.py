"""Derived WARC records: metadata and plain-text conversions of response records.

``response_records`` builds response records from a table of pages; ``derived_records`` turns each response into a metadata
record (source headers, digests, title and links as JSON) and a conversion record (the page's text), both referring to the
response by its record id, the metadata naming the conversion as concurrent. ``record_text`` renders records, and
``write_warc`` writes them as WARC files in parallel.

Digests are SHA-1 in base 32, as is usual in WARC headers. Record ids are derived from what a record is made of, so a
repeated task or run writes the same ids.

Defined results: a null page counts as empty (no title, no links, empty text); a null address leaves the header line out.
Rows that repeat a page give the same records again. An empty table gives no records. Columns of the input other than those
named are ignored. Pages are read by ``markup`` in one forward pass, very long ones whole: scripts, styles, templates, frames,
drawings and comments give no text.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secret_audit.llm.markup import Links, Page
from secret_audit.llm.spark_tools import map_slices
from secret_audit.llm.textkit import texts_of

_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

DERIVED = T.StructType([
    T.StructField(n, t) for n, t in (
        ("warc_type", T.StringType()), ("record_id", T.StringType()), ("refers_to", T.StringType()), ("concurrent_to", T.StringType()),
        ("target_uri", T.StringType()), ("date", T.StringType()), ("content_type", T.StringType()), ("content_length", T.LongType()),
        ("block_digest", T.StringType()), ("source_block_digest", T.StringType()), ("source_payload_digest", T.StringType()),
        ("content", T.StringType()),
    )
])
_ARROW = pa.list_(pa.struct([(f.name, pa.int64() if f.name == "content_length" else pa.string()) for f in DERIVED.fields]))


def sha1_base32(data: Column) -> Column:
    """``sha1:`` and the digest in base 32; 160 bits are four groups of eight digits."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def response_records(
    df: DataFrame, id_column: str = "page_id", url: str = "url", page: str = "html", date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """page_id, record_id, target_uri, date, http_header, payload and both digests of a response per page."""
    payload = F.coalesce(F.col(f"`{page}`").cast("string"), F.lit(""))
    header = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n")
    )
    rows = df.select(
        F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("target_uri"), F.lit(date).alias("date"),
        header.alias("http_header"), payload.alias("payload"),
    )
    block = F.concat(F.encode("http_header", "UTF-8"), F.encode("payload", "UTF-8"))
    rows = rows.withColumn("payload_digest", sha1_base32(F.encode("payload", "UTF-8"))).withColumn("block_digest", sha1_base32(block))
    name = F.md5(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("target_uri", F.lit("")), "date", "block_digest"))
    part = lambda a, n: F.substring(name, a, n)
    return rows.withColumn("record_id", F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">")))


def page_text(page: str) -> str:
    """Text of a page: a line per block, blanks within a line collapsed, no empty lines."""
    return Page(page).text


def facts_of(page: Page, base: str | None) -> dict:
    """Title, language and links of a page; links are made absolute where the address is known."""
    own = Links(base)
    links = [{"element": kind, "url": own.absolute(target)} for kind, target in page.links]
    return {"title": page.title, "language": page.language, "links": links}


def headers(block: str) -> dict:
    """Status line and header fields of an HTTP header block; a repeated field keeps all its values."""
    lines = [x for x in block.split("\r\n") if x]
    fields: dict[str, list[str]] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip(), []).append(value.strip())
    return {"status": lines[0] if lines else None, "fields": fields}


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def derive(source: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    page = Page(source["payload"] or "")
    ids = {kind: f"<urn:uuid:{uuid.uuid5(_NAMES, kind + (source['record_id'] or ''))}>" for kind in ("metadata", "conversion")}
    facts = {
        "source": {k: source[k] for k in ("record_id", "target_uri", "date", "block_digest", "payload_digest")},
        "http": headers(source["http_header"] or ""), **facts_of(page, source["target_uri"]),
    }
    contents = {"metadata": ("application/json", json.dumps(facts, ensure_ascii=False, sort_keys=True)), "conversion": ("text/plain; charset=utf-8", page.text)}
    out = []
    for kind, (content_type, content) in contents.items():
        data = content.encode("utf-8", "replace")
        out.append({
            "warc_type": kind, "record_id": ids[kind], "refers_to": source["record_id"],
            "concurrent_to": ids["conversion"] if kind == "metadata" else None, "target_uri": source["target_uri"], "date": source["date"],
            "content_type": content_type, "content_length": len(data), "block_digest": _digest(data),
            "source_block_digest": source["block_digest"], "source_payload_digest": source["payload_digest"], "content": data.decode("utf-8"),
        })
    return out


def derived_records(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Two rows per response: metadata and conversion. ``keep`` names columns of the response that stay."""
    keep = keep or []
    fields = ["record_id", "target_uri", "date", "http_header", "block_digest", "payload_digest"]
    source = responses.select(*keep, F.struct(*fields).alias("_source"), F.coalesce("payload", F.lit("")).alias("_payload"))

    def make():
        def run(part: pa.RecordBatch) -> list[pa.Array]:
            rows = zip(part.column("_source").to_pylist(), texts_of(part, "_payload"), strict=True)
            return [pa.array([derive(s | {"payload": p}) for s, p in rows], _ARROW)]

        return run

    made = map_slices(source, [*keep, "_source"], "_payload", [T.StructField("_records", T.ArrayType(DERIVED))], make)
    return made.select(*keep, F.inline("_records"))


def record_text(record: str = "") -> Column:
    """A record as it stands in a WARC file, without the empty lines that end it."""
    c = lambda n: F.col(f"{record}{n}")
    lines = [
        F.lit("WARC/1.0"), *(F.concat(F.lit(f"{name}: "), c(n).cast("string")) for name, n in (
            ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"),
            ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"),
            ("Content-Type", "content_type"), ("Content-Length", "content_length"),
        )),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), c("content"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write derived records as gzip-compressed WARC files, one per partition."""
    lines = records.select(record_text().alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
