"""Content-addressed WARC archive: payloads once by digest, record headers apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.session import own, work_path

# The digits of base 32 as conv writes them and as RFC 4648 wants them.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = "\r\n"


def base32_sha1(payload: str | Column) -> Column:
    """RFC 4648 base 32 of the SHA-1 of bytes: 20 bits, or five hex digits, make four digits."""
    hexes = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexes, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))


def _one_line(value: Column) -> Column:
    """A header value must not hold a line break."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " ")


def record_id(id: Column, address: Column) -> Column:
    """A urn of the page id, or of the payload where there is none: the same in every run."""
    h = F.md5(F.coalesce(F.concat(F.lit("page:"), id.cast("string")), F.concat(F.lit("payload:"), address)))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]), F.lit(">"))


def write_archive(
    pages: DataFrame,
    target: str,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    least_bytes: int = 0,
) -> None:
    """Write ``target/payloads`` and ``target/headers``.

    ``payloads`` holds every distinct payload once: its SHA-256 address, SHA-1
    and bytes. ``headers`` holds one exact WARC header block per page and the
    address it refers to. Of equal payloads of at least ``least_bytes`` bytes,
    the one with the smallest page id is a response, the others are revisits that
    name it; smaller ones are all responses.

    A null html is an empty payload, a null url an empty target URI. A page
    without an id is never the first while another has one. Rows repeated under one id give
    one record each, of the same type. An empty table gives an empty archive.
    Only ids and digests are shuffled to find the first page of a payload, and
    counts are combined before the shuffle, so a payload of very many pages is
    one small row per task; its pages are joined by a skew-aware join. Payload
    bytes are shuffled once, already reduced to one per task.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("id", "url", "payload", F.sha2("payload", 256).alias("address"))

    stored = rows.groupBy("address").agg(F.first("payload").alias("payload"))
    stored.select("address", base32_sha1("payload").alias("sha1"), "payload").write.option("compression", "zstd").parquet(
        f"{target}/payloads"
    )

    light = rows.select(
        "id", "url", "address", base32_sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("n_bytes")
    )
    first = rows.groupBy("address").agg(F.min("id").alias("first_id"))
    named = light.join(first, "address")
    revisit = (F.col("n_bytes") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    uri = _one_line(F.col("url"))
    lines = [
        F.lit(VERSION + BREAK),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", record_id(F.col("id"), F.col("address"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", uri),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(
            revisit,
            F.concat(
                _field("WARC-Profile", F.lit(IDENTICAL)),
                _field("WARC-Refers-To", record_id(F.col("first_id"), F.col("address"))),
                _field("WARC-Refers-To-Page", F.col("first_id").cast("string")),
            ),
        ).otherwise(F.lit("")),
        F.coalesce(_field("WARC-Page", F.col("id").cast("string")), F.lit("")),
        _field("Content-Type", F.lit("text/html; charset=UTF-8")),
        _field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
        F.lit(BREAK),
    ]
    headers = named.select("address", F.concat(*lines).alias("header"))
    headers.write.option("compression", "zstd").parquet(f"{target}/headers")


def header_value(name: str, header: str = "header") -> Column:
    """A field of a header block, or null where it is missing."""
    value = F.regexp_extract(header, rf"\n{name}: ?([^\r\n]*)", 1)
    return F.when(F.col(header).contains(f"\n{name}:"), value)


def read_records(spark: SparkSession, source: str) -> DataFrame:
    """``(address, header, payload)``: every original record, its full payload joined back.

    The join is on the content address; a payload of very many pages is split by
    adaptive execution. A payload whose bytes do not give its address stops the
    read.
    """
    payloads = spark.read.parquet(f"{source}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its address "), "address"))
    )
    headers = spark.read.parquet(f"{source}/headers")
    return headers.join(payloads.select("address", sound.alias("payload")), "address")


def record_facts(spark: SparkSession, source: str, id: str = "page_id") -> DataFrame:
    """One row per record, from the archive: id, payload size and digest, type, page referred to.

    Size and SHA-1 are computed from the stored bytes once per payload, and the
    record's own header must agree with them.
    """
    payloads = spark.read.parquet(f"{source}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("address"), base32_sha1("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its address "), "address"))
    )
    facts = payloads.select("address", F.length("payload").cast("long").alias("payload_bytes"), sound.alias("payload_digest"))
    joined = spark.read.parquet(f"{source}/headers").join(facts, "address")
    agrees = header_value("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "payload_digest")
    digest = F.when(agrees, F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload disagree")))
    return joined.select(
        header_value("WARC-Page").cast("long").alias(id),
        "payload_bytes",
        digest.alias("payload_digest"),
        header_value("WARC-Type").alias("record_type"),
        header_value("WARC-Refers-To-Page").cast("long").alias("refers_to"),
    )


def export_warc(spark: SparkSession, source: str, target: str, revisits_with_payload: bool = False) -> None:
    """Write plain WARC files: a record is its header block, its content and two line breaks.

    Revisits have no content, as the format asks; with ``revisits_with_payload``
    headers and full payloads are put together as they came.
    """
    records = read_records(spark, source)
    full = F.lit(True) if revisits_with_payload else header_value("WARC-Type") == "response"
    content = F.when(full, F.decode("payload", "UTF-8")).otherwise(F.lit(""))
    records.select(F.concat("header", content).alias("value")).write.option("lineSep", BREAK * 2).text(target)


def archived(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as an archive in the shared folder and read the records back."""
    spark = pages.sparkSession
    target = own(spark, work_path(spark, "warc"))
    write_archive(pages, target, id, url, html, least_bytes=least_bytes)
    return record_facts(spark, target, id)
