"""WARC archives: write captures as records, read archives back, and assemble transactions.

A capture is three records: a request, a response (or a revisit of an equal payload, which names the
target and date of what it refers to) and metadata. Request and metadata name the response in ``WARC-Concurrent-To``. Reading parses every record of
every archive, and ``transactions`` joins the records of a capture through these identifiers into
one nested row.

Archives are written by Spark's own text sink, a record a line with the records' end (two line
ends) as the line separator, so that any store Spark can write to will do.

Defined results: a null payload is empty; a null url writes no target; line ends in a url are
percent-encoded, as they would end the header. A null id is kept as null. Repeated ids are
captures of their own. An empty table writes no records and reads back as an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mzframe.llm.common import base32_sha1, materialize

EOL = "\r\n"
HTTP_HEAD = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}{EOL}"
RECORD = "record_id string, record_type string, concurrent_to string, target_uri string, date string, capture_key string, refers_to string, refers_to_target string, refers_to_key string, content_type string, payload_digest string, payload_bytes long, payload binary, fields map<string,string>"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *parts))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)), F.lit(">"))


def _record(kind: Column | str, record_id: Column, content_type: str, block: Column, *headers: tuple[str, Column]) -> Column:
    """One record without its end; headers with a null value are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in headers]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(EOL, *lines), F.lit(EOL + EOL), block)


def _header_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")


def plan_captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """(id, digest, first, first_url) of the rows that revisit: first is the smallest id with an equal payload of at least so many bytes.

    Payloads are equal if digest and length are. The grouped minimum is combined before the
    shuffle; the join back carries ids and digests only, and Spark splits a hot digest's rows."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(page_id).alias("id"), _header_url(F.col(url)).alias("url"), base32_sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    rows = materialize(rows, "digests")
    smallest = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url")))
    firsts = rows.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest", "bytes").agg(smallest.alias("f"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(firsts.select("digest", "bytes", F.col("f.id").alias("first"), F.col("f.url").alias("first_url")), "firsts")
    return rows.join(firsts, ["digest", "bytes"], "left").where("id is not null and first is not null and id <> first").select("id", "digest", "first", "first_url").distinct()


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 3000) -> None:
    """Write request, response or revisit, and metadata records to gzip archives below path.

    Only the (id, digest, first) rows of revisits are joined to the rows, so the payloads move once at
    most. records_per_file bounds an archive; readers load one archive's compressed bytes at a time."""
    revisits = plan_captures(pages, page_id, url, payload, min_revisit_bytes)
    rows = pages.select(F.col(page_id).alias("id"), _header_url(F.col(url)).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("body"), F.monotonically_increasing_id().alias("n"))
    rows = rows.withColumn("digest", base32_sha1(F.col("body"))).join(revisits, ["id", "digest"], "left")
    key, again = F.col("id").cast("string"), F.col("first").isNotNull()
    main, of = _uuid(F.lit("response"), key, F.col("n").cast("string")), F.col("first").cast("string")
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    revisited = (("Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Refers-To-Target-URI", F.col("first_url")), ("Refers-To-Date", F.lit(date)))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    target = F.coalesce(F.regexp_replace(F.col("url"), r"^[^:]*://[^/]*", ""), F.lit("/"))
    request = _record("request", _uuid(F.lit("request"), key, F.col("n").cast("string")), "application/http; msgtype=request", F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{EOL}{EOL}")), ("WARC-Concurrent-To", main), *common)
    response = _record(F.when(again, "revisit").otherwise("response"), main, "application/http; msgtype=response", F.when(again, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), F.col("body"))), *common, digest, *(("WARC-" + k, F.when(again, v)) for k, v in revisited))
    about = F.concat(
        *(F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit("")), F.lit(EOL)) for k, v in (("capture-key", key), ("refers-to-key", of), ("payload-bytes", F.octet_length("body").cast("string"))))
    )
    metadata = _record("metadata", _uuid(F.lit("metadata"), key, F.col("n").cast("string")), "application/warc-fields", about, ("WARC-Concurrent-To", main), *common)
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", EOL + EOL).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class _Stream:
    """Reads lines and byte counts from a gzip member sequence without inflating all of it at once."""

    def __init__(self, packed: bytes):
        self.packed, self.at, self.buffer, self.gz = memoryview(packed), 0, b"", zlib.decompressobj(31)

    def more(self) -> bool:
        while self.at < len(self.packed) or self.gz.unconsumed_tail:
            if self.gz.eof:
                rest = self.gz.unused_data
                self.at -= len(rest)
                self.gz = zlib.decompressobj(31)
            chunk = self.gz.unconsumed_tail
            if not chunk:
                chunk = self.packed[self.at : self.at + 65536]
                self.at += len(chunk)
            if out := self.gz.decompress(chunk, 1 << 20):
                self.buffer += out
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Up to the mark, which is skipped; None at the end."""
        seen = 0
        while (k := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.more():
                return None
        out, self.buffer = self.buffer[:k], self.buffer[k + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        if len(self.buffer) < n:
            parts, have = [self.buffer], len(self.buffer)
            self.buffer = b""
            while have < n and self.more():
                parts.append(self.buffer)
                have += len(self.buffer)
                self.buffer = b""
            self.buffer = b"".join(parts)
        if len(self.buffer) < n:
            raise ValueError("a record ends early")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split(EOL))
    return {k.strip().lower(): v.strip() for k, colon, v in pairs if colon}


def parse_archive(packed: bytes, with_payload: bool = True) -> Iterator[dict]:
    """The records of one archive; digest and length are taken from the payload's bytes where there are some."""
    stream = _Stream(packed)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head:
            continue
        if not head.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {head[:40]!r}")
        h = _fields(head)
        block = stream.take(int(h["content-length"]))
        kind = h.get("warc-type", "").lower()
        digest, size, payload, fields = h.get("warc-payload-digest", "").partition(":")[2] or None, None, None, None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest not in (None, found):
                raise ValueError(f"the payload of {h['warc-record-id']} does not match its digest")
            digest, size = found, len(payload)
        elif kind == "metadata":
            fields = _fields(block)
        yield {
            "record_id": h["warc-record-id"], "record_type": kind, "concurrent_to": h.get("warc-concurrent-to"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"),
            "capture_key": (fields or {}).get("capture-key") or None, "refers_to": h.get("warc-refers-to"), "refers_to_target": h.get("warc-refers-to-target-uri"), "refers_to_key": (fields or {}).get("refers-to-key") or None, "content_type": h.get("content-type"),
            "payload_digest": digest, "payload_bytes": size if size is not None else int((fields or {}).get("payload-bytes") or -1) if fields else None, "payload": payload if with_payload else None, "fields": fields,
        }


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives below path, one row each."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for packed in batch["content"]:
                rows: list[dict] = []
                held = 0
                for r in parse_archive(packed, with_payload):
                    rows.append(r)
                    held += len(r["payload"] or b"")
                    if len(rows) >= 2000 or held > 16_000_000:
                        yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(parse, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, record_type, target_uri, refers_to_target, date, payload_digest,
    payload_bytes, payload, request, metadata.

    The joins' keys are the captures' own identifiers, so no key is hot."""
    main = records.where("record_type in ('response', 'revisit')")
    request = records.where("record_type = 'request' and concurrent_to is not null").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "target_uri", "content_type").alias("request"))
    metadata = records.where("record_type = 'metadata' and concurrent_to is not null").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "capture_key", "refers_to_key", "payload_bytes", "fields").alias("metadata"))
    out = main.join(request, "record_id", "left").join(metadata, "record_id", "left")
    size = F.coalesce("payload_bytes", "metadata.payload_bytes").alias("payload_bytes")
    return out.select("record_id", "record_type", "target_uri", "refers_to_target", "date", "payload_digest", size, "payload", "request", "metadata")
