"""A content-addressed web archive: payloads once by digest, record headers apart, records by join.

Layout under one folder: ``payloads/`` holds ``(digest, payload, keeper)`` with one row per distinct
payload; ``headers/`` holds ``(digest, header)`` with the exact header block of every record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Payloads shorter than this are always stored as responses.
MIN_REVISIT_BYTES = 100
WARC_DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAYLOADS = T.StructType([T.StructField("digest", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("keeper", T.LongType())])
_HEADERS = T.StructType([T.StructField("digest", T.StringType()), T.StructField("header", T.StringType())])


def _line(name: str, value: Column) -> Column:
    """One header line, or nothing for a null value; control characters can't break the block."""
    clean = F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", "%")
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n"))).otherwise(F.lit(""))


def _record_urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(record_id.cast("string"), F.lit("unknown")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT_BYTES) -> None:
    """Write one WARC record per row of ``pages`` into the archive folder ``path``.

    The payload is the column in UTF-8 (null: empty). Among equal payloads of at least
    ``min_revisit`` bytes the record with the smallest id is the response and the others revisit it
    (rows that repeat that id with that payload are responses too; a null id is larger than any).
    A null uri has no WARC-Target-URI line. Equal payloads meet after a map-side combine, so a
    payload that a third of the pages share costs one row per map task.
    """
    facts = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    facts = facts.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    store = facts.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("id").alias("keeper"))
    store.write.option("compression", "zstd").parquet(f"{path}/payloads")
    keepers = pages.sparkSession.read.schema(_PAYLOADS).parquet(f"{path}/payloads").select("digest", "keeper")
    joined = facts.select("id", "uri", "digest", "bytes").join(keepers, "digest")
    response = (F.col("bytes") < min_revisit) | F.col("id").eqNullSafe(F.col("keeper"))
    kind = F.when(response, "response").otherwise("revisit")
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", _record_urn(F.col("id"))), _line("WARC-Date", F.lit(WARC_DATE)),
        _line("WARC-Target-URI", F.col("uri")), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _line("WARC-Refers-To", F.when(~response, _record_urn(F.col("keeper")))), _line("WARC-Profile", F.when(~response, F.lit(REVISIT_PROFILE))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.when(response, F.col("bytes")).otherwise(F.lit(0))), F.lit("\r\n"),
    )
    joined.select("digest", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _field(name: str, pattern: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"(?m)^{name}: {pattern}\r?$", 1), F.lit(""))


def _verified(payloads: DataFrame) -> DataFrame:
    """The store's rows; a payload that no longer has its digest stops the read."""
    wrong = F.sha2("payload", 256) != F.col("digest")
    return payloads.withColumn("digest", F.when(wrong, F.raise_error(F.concat(F.lit("payload does not match digest "), "digest"))).otherwise(F.col("digest")))


def _headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_HEADERS).parquet(f"{path}/headers").select(
        "digest", "header", F.expr(r"try_cast(regexp_extract(header, '(?m)^WARC-Record-ID: <urn:record:(-?[0-9]+)>', 1) as bigint)").alias("id"),
        _field("WARC-Type", r"(\w+)").alias("record_type"), F.expr(r"try_cast(regexp_extract(header, '(?m)^WARC-Refers-To: <urn:record:(-?[0-9]+)>', 1) as bigint)").alias("refers_to"),
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(id, payload_bytes, payload_digest, record_type, refers_to)`` of every record.

    Each stored payload is hashed and measured once, then only those figures are joined to the headers.
    """
    payloads = _verified(spark.read.schema(_PAYLOADS).parquet(f"{path}/payloads")).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    return _headers(spark, path).join(payloads, "digest").select("id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(id, record_type, refers_to, header, payload, record)``: the original records, byte for byte.

    payload is the full payload, for revisits that of the response; record is the header block with
    the block that belongs to it (none for a revisit) and the two closing line ends.
    """
    payloads = _verified(spark.read.schema(_PAYLOADS).parquet(f"{path}/payloads")).select("digest", "payload")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.col("header").cast("binary"), body, F.lit(b"\r\n\r\n"))
    return _headers(spark, path).join(payloads, "digest").select("id", "record_type", "refers_to", "header", "payload", record.alias("record"))
