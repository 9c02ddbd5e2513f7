"""WARC archives with revisit records for equal payloads.

1. Every page becomes a response record of a first archive. 2. The archive is read back; of
each record only its header goes on: place (file, number), page, SHA-1 digest and length of
the payload. 3. Headers are shuffled by digest: the record with the smallest page_id (then
place) of a digest is the original, all others revisit it; payloads shorter than
``min_bytes`` stay responses. 4. The records meet their decisions by place, and a second,
deduplicated archive is written with fresh headers; revisits carry no payload. 5. That archive
is read back, which gives the result.

Files are WARC/1.1 records, written by Spark's text writer with the record separator
CR LF CR LF and compressed as a whole (gzip), in files of bounded bytes; they are read as binary files,
decompressed step by step and cut by Content-Length, so payloads may hold anything. Both go to the shared
folder. Ids pass through Python as strings.

A digest that a third of the records share is one row per task in the aggregate and a
skewed join that the engine splits; payloads move once, by place, which is even.

Edge cases: null html is an empty payload; a null url leaves the target out; control
characters in a url are percent-encoded; repeated rows are separate records, one of them the
response. A null page_id comes after all others and refers_to is null for those that revisit
it. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, ship, table
from corpusmill.session import scratch_path

MIN_BYTES = 0
#: Fixed for reproducible archives; a crawl passes its own.
DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 10_000
#: Bytes that an archive file may hold before compression, by its number of records and the largest one.
FILE_BYTES = 1 << 30
#: Bytes read of a decompressed archive at a time.
STEP_BYTES = 1 << 18
_EMPTY = base64.b32encode(hashlib.sha1(b"").digest()).decode()


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(kind: str, fields: dict, payload: str) -> str:
    """One record without its closing CR LF CR LF (the text writer's separator)."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items() if v is not None),
            f"Content-Length: {len(payload.encode('utf-8', 'surrogatepass'))}"]
    return "\r\n".join(head) + "\r\n\r\n" + payload


class _Stream:
    """A file read step by step; what is not asked for yet is held, what was given is let go with the next step."""

    def __init__(self, file):
        self.file, self.held, self.at = file, b"", 0

    def _more(self, count: int) -> int:
        more = self.file.read(count)
        self.held, self.at = self.held[self.at:] + more, 0
        return len(more)

    def until(self, end: bytes) -> bytes | None:
        """The bytes before ``end``, or None behind the last record."""
        found = self.held.find(end, self.at)
        step = STEP_BYTES
        while found < 0:
            had = len(self.held) - self.at
            if not self._more(step):
                if had:
                    raise ValueError("the archive ends within a record")
                return None
            found = self.held.find(end, max(0, had - len(end) + 1))  # the end may lie over two steps
            step *= 2
        out, self.at = self.held[self.at:found], found + len(end)
        return out

    def take(self, count: int) -> bytes:
        while len(self.held) - self.at < count:
            if not self._more(max(STEP_BYTES, count - len(self.held) + self.at)):
                raise ValueError("the archive ends within a record")
        out, self.at = self.held[self.at:self.at + count], self.at + count
        return out


def parse(archive):
    """``(fields, payload)`` of every record of an archive (bytes or an open file), one record in memory at a time."""
    stream = _Stream(io.BytesIO(archive) if isinstance(archive, bytes) else archive)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
        payload = stream.take(int(fields["Content-Length"]) + 4)
        yield fields, payload[:-4]


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def records_per_file(pages: DataFrame) -> int:
    """So many records that a file stays within ``FILE_BYTES`` even if all are as large as the largest."""
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    return max(1, min(RECORDS_PER_FILE, FILE_BYTES // (largest + 4096)))


def write_archive(rows: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Writes ``rows (record string)`` as archive files; returns them as ``(path, content)``."""
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip") \
        .option("maxRecordsPerFile", per_file).text(path)
    return rows.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def _first_records(batches):
    for b in batches:
        out = []
        for page, url, html in zip(b["page_id"], b["url"], b["html"]):
            page, url, html = (None if pd.isna(x) else x for x in (page, url, html))  # page ids are strings here
            payload = html or ""
            raw = payload.encode("utf-8", "surrogatepass")
            out.append(record("response", {
                "WARC-Record-ID": _id(page, url, digest_of(raw)), "WARC-Date": DATE,
                "WARC-Target-URI": None if url is None else _uri(url),
                "WARC-Payload-Digest": f"sha1:{digest_of(raw)}", "X-Page-Id": page,
                "Content-Type": "text/html; charset=utf-8"}, payload))
        yield pd.DataFrame({"record": out})


def _read(make, columns: list[str], with_payload: bool):
    """Reader of archive files in bounded steps; ``make(fields, payload)`` gives a row."""
    def run(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows, held = [], 0
                for k, (fields, payload) in enumerate(parse(gzip.GzipFile(fileobj=io.BytesIO(content)))):
                    rows.append((path.rsplit("/", 1)[-1], k, *make(fields, payload)))
                    held += len(payload) if with_payload else 0
                    if len(rows) >= 5000 or held > 8_000_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return run


def _page(fields: dict, name: str = "X-Page-Id") -> str | None:
    return fields.get(name)


_PLACE = "file string, number bigint"
_HEADERS = f"{_PLACE}, page string, digest string, bytes bigint"
_FULL = f"{_PLACE}, page string, uri string, html string"
_RESULT = f"{_PLACE}, page string, bytes bigint, digest string, kind string, refers string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def decide(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``(file, number, first_page, first_file, first_number)`` for every record; the firsts
    are null for responses."""
    h = headers.withColumn("page", F.col("page").cast("bigint")).withColumn("_null", F.col("page").isNull())
    place = F.struct("_null", "page", "file", "number")
    first = h.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min(place).alias("f"))
    j = h.join(first, "digest", "left")
    revisit = F.col("f").isNotNull() & (F.col("bytes") >= min_bytes) & \
        ~((F.col("f.file") == F.col("file")) & (F.col("f.number") == F.col("number")))
    # as strings: a column with nulls would reach Python as doubles, which end at 2^53
    pick = lambda c: F.when(revisit, F.col(f"f.{c}").cast("string")).alias(f"first_{c}")
    return j.select("file", "number", "digest", "bytes", revisit.alias("revisit"), pick("page"), pick("file"), pick("number"))


def _second_records(batches):
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            clean = lambda x: None if pd.isna(x) else x
            page, uri, ref = clean(r.page), clean(r.uri), clean(r.first_page)
            fields = {"WARC-Record-ID": _id(r.file, r.number), "WARC-Date": DATE, "WARC-Target-URI": uri,
                      "WARC-Payload-Digest": f"sha1:{r.digest}", "X-Payload-Length": int(r.bytes), "X-Page-Id": page}
            if r.revisit:
                fields |= {"WARC-Refers-To": _id(r.first_file, int(r.first_number)), "WARC-Refers-To-Date": DATE,
                           "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                           "X-Refers-To-Page-Id": ref}
            else:
                fields["Content-Type"] = "text/html; charset=utf-8"
            out.append(record("revisit" if r.revisit else "response", fields, "" if r.revisit else r.html or ""))
        yield pd.DataFrame({"record": out})


def deduplicated_archive(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes both archives of ``pages (page_id, url, html)``; returns the files of the
    deduplicated one as ``(path, content)``."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("bigint").cast("string").alias("page_id"), "url", "html")
    per_file = records_per_file(pages)
    first = write_archive(rows.mapInPandas(_first_records, "record string"), scratch_path(spark, "warc-first"), per_file)
    headers = materialize(first.mapInPandas(_read(
        lambda f, p: (_page(f), digest_of(p), len(p)), _names(_HEADERS), False), _HEADERS), "warc-headers")
    full = first.mapInPandas(_read(
        lambda f, p: (_page(f), f.get("WARC-Target-URI"), p.decode("utf-8", "surrogatepass")), _names(_FULL), True), _FULL)
    # headers grow with the archive: a shuffle at every size, never a broadcast
    decided = materialize(decide(headers, min_bytes), "warc-decisions")
    joined = full.join(decided.hint("merge"), ["file", "number"])
    return write_archive(joined.mapInPandas(_second_records, "record string"), scratch_path(spark, "warc-dedup"), per_file)


def _outcome(fields: dict, payload: bytes) -> tuple:
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and digest_of(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    return _page(fields), int(fields["X-Payload-Length"]), digest, kind, _page(fields, "X-Refers-To-Page-Id")


def read_outcome(archive: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` per record."""
    rows = archive.mapInPandas(_read(_outcome, _names(_RESULT), False), _RESULT)
    return rows.select(F.col("page").cast("bigint").alias("page_id"), F.col("bytes").alias("payload_bytes"),
                       F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"),
                       F.col("refers").cast("bigint").alias("refers_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_outcome(deduplicated_archive(table(spark, sf_dir, "pages")))


def sql(view: str = "pages") -> str:
    """The same rows in DuckDB; base32 by cutting the digest's bits in fives."""
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM {view}),
    h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
    b AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
            4 * strpos('0123456789abcdef', substr(hex, i, 1)) - 3, 4)), 'string_agg', '') AS bits FROM h),
    d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
            + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
            + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), 'string_agg', '') AS payload_digest FROM b),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id <> first AND payload_bytes >= {MIN_BYTES} THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id <> first AND payload_bytes >= {MIN_BYTES} THEN first END AS refers_to FROM f
    """


ship(__name__)
