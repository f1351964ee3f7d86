"""WARC archives with revisit records.

Only headers are shuffled to find equal payloads: the digest, the length and the id. The archives are written
as one text file per partition through Spark's own committer, so a lost executor leaves no half
file behind, and read back record by record.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaporlog.llm.common import new_path, sized, staged, text_of, with_library

#: Equal payloads below this many bytes are written again.
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Records of one file at the most: a reader holds one file at a time.
FILE_RECORDS = 1000
RECORD = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, content binary"


def resolve(pages: DataFrame, id_column: str, url_column: str, payload_column: str, least: int = LEAST) -> DataFrame:
    """Pages with payload, digest, bytes and the id of the response that each record repeats (null: it is one itself)."""
    payload = text_of(pages, payload_column)
    rows = pages.select(
        pages[id_column].cast("string").alias("id_text"), pages[id_column].alias("page_id"),
        pages[url_column].cast("string").alias("url"), payload.alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    headers = rows.filter(F.col("bytes") >= least).groupBy("digest")
    originals = headers.agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("records")).filter("records > 1")
    originals = sized(staged(originals.select(F.col("digest").alias("d"), "original"), "originals"))
    found = rows.join(originals, F.col("digest") == F.col("d"), "left")
    return found.withColumn(
        "refers_to", F.expr("CASE WHEN page_id = original THEN NULL ELSE CAST(original AS STRING) END")
    )


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = LEAST) -> None:
    """Write one record per page; revisits carry no payload.

    Of equal payloads of at least `least` bytes the smallest id is the response (all rows that repeat that id are).
    A null id is written without one and, where its payload has an original, as a revisit. Null payloads are
    empty; null urls are left out; control characters and white space in urls become %20.
    """
    rows = resolve(pages, id_column, url_column, payload_column, least)
    url = F.col("url")
    url = F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")  # no header may be broken by a url
    revisit = F.col("refers_to").isNotNull() | F.expr("page_id IS NULL AND original IS NOT NULL")

    def line(name: str, value) -> F.Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def urn(value) -> F.Column:
        h = F.md5(value.cast("binary"))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))

    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.concat(F.coalesce("id_text", F.lit("none")), F.lit(" "), F.col("digest")))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Page-Id", F.col("id_text")),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", urn(F.concat(F.coalesce("refers_to", F.col("original").cast("string")), F.lit(" "), F.col("digest")))),
            line("X-Refers-To-Page-Id", F.coalesce("refers_to", F.col("original").cast("string"))),
            line("WARC-Profile", F.lit(PROFILE)),
            F.lit("Content-Length: 0\r\n\r\n"),
        )).otherwise(F.concat(
            F.lit("Content-Type: text/html; charset=utf-8\r\n"),
            line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"), F.col("payload"),
        )),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers and content of each record of an archive. Anything that is no whole record is an error."""
    view, at, end = memoryview(data), 0, len(data)
    while at < end:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or data[at:at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        headers = {}
        for raw in data[at:stop].split(b"\r\n")[1:]:
            name, _, value = raw.partition(b":")
            headers[name.decode("utf-8").strip().lower()] = value.decode("utf-8").strip()
        start = stop + 4
        size = int(headers["content-length"])
        at = start + size + 4
        if at > end or data[at - 4:at] != b"\r\n\r\n":
            raise ValueError(f"a record is cut off after byte {start}")
        yield headers, view[start:start + size]


def read_archives(spark: SparkSession, path: str, contents: bool = False) -> DataFrame:
    """All records of the archives in a folder: id, url, type, referred id, and the content's own bytes and digest.

    A response's digest is computed from its content and must match its header. `contents` also returns them.
    """
    with_library(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                rows = []
                for headers, content in parse_records(file.as_py()):
                    kind = headers["warc-type"]
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(content).hexdigest() != digest:
                        raise ValueError(f"digest of {headers['warc-record-id']} does not match")
                    rows.append((
                        headers.get("x-page-id"), len(content), digest, kind, headers.get("x-refers-to-page-id"),
                        headers.get("warc-target-uri"), bytes(content) if contents else None,
                    ))
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "content"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def resolved_records(records: DataFrame) -> DataFrame:
    """Records with the payload length that revisits take from their original response, joined by digest and id."""
    originals = records.filter("record_type = 'response'").select(
        F.col("page_id").alias("o_id"), F.col("payload_digest").alias("o_digest"), F.col("payload_bytes").alias("o_bytes")
    ).dropDuplicates(["o_id", "o_digest"])
    revisits = records.filter("record_type = 'revisit'")
    joined = revisits.join(
        originals, (F.col("refers_to") == F.col("o_id")) & (F.col("payload_digest") == F.col("o_digest")), "left"
    ).withColumn("payload_bytes", F.col("o_bytes")).drop("o_id", "o_digest", "o_bytes")
    return records.filter("record_type = 'response'").unionByName(joined)


def archive_round_trip(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = LEAST) -> DataFrame:
    """Write archives to the shared folder, read them back and resolve their revisits: one row per page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to. No pages give no records.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, id_column, url_column, payload_column, least)
    kind = pages.schema[id_column].dataType.simpleString()
    return resolved_records(read_archives(spark, path)).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), q AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS original FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to
FROM q LEFT JOIN f USING (payload_digest)
"""
