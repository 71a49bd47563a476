"""WARC archives: writing pages as records, and reading records by their boundary chain.

Reading never trusts a magic line. Tasks split the files at every magic line; each piece is a
candidate record with the offset of the successor its header declares. Pointer jumping from
the start of each file (the pointers double in every round) keeps the candidates that can be
reached; a magic line inside a payload is not reached and goes back into its record. Payloads
of records without an inner magic line, nearly all, are measured where they are read and never
shuffled.

Files are plain sequences of records, compressed as a whole if asked for, written and read by
Spark's text source with a record's end and the magic line as line separators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import new_work_path
from .common import pinned, table

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_FILE = 2000


def base32(hex_digits: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: every 5 of them are 4 characters."""
    out = []
    for i in range(8):
        n = F.conv(F.substring(hex_digits, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _records(pages: DataFrame, date: str, least_bytes: int) -> DataFrame:
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", r"[\r\n]", "").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("same", F.sha2(F.col("payload"), 256))
    first = rows.where(F.col("size") >= least_bytes).groupBy(F.col("same").alias("first_same")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1 AND first IS NOT NULL").drop("n")
    rows = rows.join(first, F.col("same") == F.col("first_same"), "left")
    again = F.coalesce(F.col("page_id") != F.col("first"), F.lit(False))
    digest = base32(F.sha1("payload"))
    urn = lambda page: F.concat(F.lit("<urn:runledger:page:"), page, F.lit(">"))
    page = F.col("page_id").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))
    head = F.concat_ws(
        "\r\n",
        F.when(again, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        line("WARC-Record-ID", F.coalesce(urn(page), F.lit("<urn:runledger:page:none>"))),
        F.lit(f"WARC-Date: {date}"),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Refers-To", F.when(again, urn(F.col("first").cast("string")))),
        F.when(again, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", (F.octet_length(http) + F.when(again, 0).otherwise(F.col("size"))).cast("string")),
    )
    return rows.select(F.concat(F.lit(MAGIC), head, F.lit(END), http, F.when(again, "").otherwise(F.col("payload"))).alias("value"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip", records_per_file: int = RECORDS_PER_FILE) -> None:
    """One record per row of ``pages`` (page_id, url, html), payload the html in UTF-8 (null: empty).

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the smallest
    page_id is a response, rows of other ids are revisits of it. A row without page_id never is
    the one referred to, and is a revisit only of a row that has one; rows that repeat a page
    are written again. An empty table gives files without records.
    """
    _records(pages, date, least_bytes).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


def _parsed(block: Column) -> tuple[Column, Column]:
    """Size and SHA-1 of the payload in an HTTP message."""
    payload = F.substring(block, F.octet_length(F.substring_index(block.cast("string"), END, 1)) + 5, F.lit(2**31 - 1))
    return F.octet_length(payload).cast("long"), F.sha1(payload)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every magic line: file, off, next (declared successor), whole (the piece up to the next
    magic line is what the header declares). Of whole ones the header, size and sha1 of the
    payload, and mark (a hash of the piece); of others the piece."""
    m = len(MAGIC)
    lines = _pieces(spark, path)
    raw = F.col("value").cast("binary")
    header = F.substring_index("value", END, 1)
    length = F.regexp_extract("header", r"(?im)^Content-Length: *(\d{1,18})\r?$", 1)
    pieces = (
        lines.withColumn("header", header).withColumn("head", F.octet_length("header") + 4).withColumn("length", F.octet_length("value"))
        .withColumn("declared", F.when(length != "", length.cast("long")))
        .withColumn("whole", (F.col("head") + F.col("declared") + 4 == F.col("length")).eqNullSafe(True))
    )
    size, sha1 = _parsed(F.substring(raw, F.col("head") + 1, F.col("declared").cast("int")))
    pieces = pieces.select(
        "file", "split", "n", "length", "whole", (F.col("head") + F.col("declared") + 4).alias("reach"), F.when(F.col("whole"), F.col("header")).alias("header"),
        F.when(F.col("whole"), size).alias("size"), F.when(F.col("whole"), sha1).alias("sha1"), F.when(F.col("whole"), F.sha1(raw)).alias("mark"),
        F.when(~F.col("whole"), raw).alias("piece"))
    before = F.coalesce(F.sum(F.col("length") + m).over(W.partitionBy("file").orderBy("split", "n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.withColumn("off", before - m)
    return placed.select("file", "off", (F.col("off") + m + F.col("reach")).alias("next"), "whole", "header", "size", "sha1", "mark", "piece").where("off >= 0")


def reachable(chain: DataFrame) -> DataFrame:
    """(file, off) of the candidates (file, off, next) reached from offset 0 of their file."""
    now = pinned(chain.select("file", "off", F.col("next").alias("to"), (F.col("off") == 0).alias("reached")), "chain")
    known = now.where("reached").count()
    while True:
        ahead = now.select("file", F.col("off").alias("to"), F.col("to").alias("further"))
        told = now.where("reached AND to IS NOT NULL").select("file", F.col("to").alias("off"), F.lit(True).alias("told")).distinct()
        now = pinned(
            now.join(ahead, ["file", "to"], "left").join(told, ["file", "off"], "left")
            .select("file", "off", F.col("further").alias("to"), (F.col("reached") | F.coalesce("told", F.lit(False))).alias("reached")), "chain")
        more = now.where("reached").count()
        if more == known:
            return now.where("reached").select("file", "off")
        known = more


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: header, block size and SHA-1 of the payload (response and revisit
    records as :func:`write_warc` makes them): page_id, url, payload_bytes, payload_digest,
    record_type, refers_to. A file that does not start with a record has none."""
    found = pinned(candidates(spark, path), "candidates")
    real = reachable(found.select("file", "off", "next")).withColumn("real", F.lit(True))
    in_file = W.partitionBy("file").orderBy("off")
    marked = found.join(real, ["file", "off"], "left").withColumn("record", F.last(F.when(F.col("real"), F.col("off")), ignorenulls=True).over(in_file))
    marked = marked.where("record IS NOT NULL")
    simple = marked.where("real AND whole").select("header", "size", "sha1")
    split = marked.where("NOT whole").select("file", "record", "off", "piece")
    inner = pinned(marked.where("whole AND real IS NULL").select("file", "record", "off", "mark"), "inner")
    if not inner.isEmpty():  # whole records inside payloads: their text is read again
        again = _pieces(spark, path).select("file", F.sha1("value").alias("mark"), F.col("value").cast("binary").alias("piece"))
        again = again.join(inner.select("file", "mark").distinct(), ["file", "mark"]).dropDuplicates(["file", "mark"])
        split = split.union(inner.join(again, ["file", "mark"]).select("file", "record", "off", "piece"))
    parts = F.sort_array(F.collect_list(F.struct("off", "piece")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, F.lit(MAGIC.encode()), x["piece"]))
    text = split.groupBy("file", "record").agg(joined.alias("raw")).select(F.substring(F.col("raw"), len(MAGIC) + 1, 2**31 - 1).alias("raw"))
    text = text.withColumn("header", F.substring_index(F.col("raw").cast("string"), END, 1))
    length = F.regexp_extract("header", r"(?im)^Content-Length: *(\d{1,18})\r?$", 1).cast("int")
    size, sha1 = _parsed(F.substring(F.col("raw"), F.octet_length("header") + 5, length))
    rows = simple.union(text.select("header", size, sha1))

    def field(name: str) -> Column:
        value = F.regexp_extract("header", rf"(?im)^{name}: *(.*?)\r?$", 1)
        return F.when(value != "", value)

    revisit = field("WARC-Type") == "revisit"
    page = lambda name: F.regexp_extract(field(name), r"page:(-?\d+)>", 1).try_cast("long")
    return rows.select(
        page("WARC-Record-ID").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        F.when(revisit, field("X-Payload-Length").cast("long")).otherwise(F.col("size")).alias("payload_bytes"),
        F.when(revisit, F.regexp_extract(field("WARC-Payload-Digest"), "sha1:(.*)", 1)).otherwise(base32(F.col("sha1"))).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.when(revisit, page("WARC-Refers-To")).alias("refers_to"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_work_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).drop("url")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', 1 + CAST((CAST('0x' || substr(sha1(h), 1 + 5 * CAST(i // 4 AS BIGINT), 5) AS BIGINT)
    >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM p"""
