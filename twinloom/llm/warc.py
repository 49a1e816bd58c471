"""A content-addressed web archive.

Equal payloads are stored once, under their SHA-256; record headers are kept apart, byte for byte. Records come back by
a join on the digest. A digest is trusted only after checks: all copies of a digest must agree in SHA-1 and length when
written, and a payload must give its digest again when read. Both tables are written by Spark to a folder that all
executors share, so a lost task is simply run again.

Of records with equal payloads the one with the largest page id is ``response`` and the others are ``revisit`` records
that refer to it; payloads smaller than ``least`` bytes are always ``response``. A page that repeats with the same id and
payload has one response among its rows. NULL html is an empty payload, NULL url a record without target, a NULL id
counts as the smallest and is written as ``null``. Line ends in urls are percent-encoded. Other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from twinloom.llm.common import same
from twinloom.session import checkpoint_dir, cut

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexa: Column) -> Column:
    """Base32 of 40 hexadecimal digits: five digits make four characters."""
    out = []
    for i in range(0, 40, 5):
        v = F.conv(F.substring(hexa, i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def write(pages: DataFrame, folder: str, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write ``records`` (digest, head) and ``payloads`` (digest, payload) below ``folder``."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    cells = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), body.alias("payload"))
    seen = cut(
        cells.select("id", "url", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    )
    first = lambda c: F.min(c) == F.max(c)
    owners = cut(seen.groupBy("digest").agg(F.max("id").alias("owner"), (first("sha1") & first("bytes")).alias("sure")))
    if not owners.where("not sure").isEmpty():
        raise ValueError("payloads of one digest differ")

    own = owners.select(F.col("digest").alias("_d"), "owner")
    rows = seen.join(own, F.col("digest") == F.col("_d")).drop("_d")
    heir = same(F.col("id"), F.col("owner"))
    # rows that repeat the owner's id: the first of them is the response
    twins = rows.where(heir).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if twins.isEmpty():
        rows = rows.withColumn("nth", F.lit(1))
    else:
        rows = rows.withColumn("nth", F.when(heir, F.row_number().over(Window.partitionBy("digest", "id").orderBy(F.col("url")))).otherwise(1))
    response = (F.col("bytes") < least) | (heir & (F.col("nth") == 1))
    rows.select("digest", head(response).alias("head")).write.parquet(f"{folder}/records")

    chosen = cells.withColumn("digest", F.sha2("payload", 256)).join(own, (F.col("digest") == F.col("_d")) & same(F.col("id"), F.col("owner")), "left_semi")
    stored = chosen.select("digest", "payload")
    (stored if twins.isEmpty() else stored.dropDuplicates(["digest"])).write.parquet(f"{folder}/payloads")


def head(response: Column) -> Column:
    """The record's WARC header and HTTP header, up to the payload."""
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    size = F.octet_length(http) + F.when(response, F.col("bytes")).otherwise(0)
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(response, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", name("id")),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")),
        F.when(~response, F.concat(line("WARC-Refers-To", name("owner")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", size.cast("string")),
        F.lit(CRLF),
        http,
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(head, payload, record) of every record: ``record`` is the record as an archive holds it (a revisit carries no
    payload), ``payload`` the full payload it stands for. A payload that doesn't give its digest raises."""
    store = spark.read.parquet(f"{folder}/payloads")
    broken = F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))
    good = store.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(broken).alias("payload"))
    rows = spark.read.parquet(f"{folder}/records").join(good, "digest", "left")
    payload = F.coalesce(F.col("payload"), broken)
    carried = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return rows.select("head", payload.alias("payload"), F.concat(F.encode("head", "utf-8"), carried, F.lit(CRLF * 2).cast("binary")).alias("record"))


def field(name: str) -> Column:
    """A header's value, NULL where the record has none."""
    found = F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def archived(pages: DataFrame, folder: str | None = None, least: int = 0, key: str = "page_id") -> DataFrame:
    """Write the archive, read it back, and describe each record from what was read."""
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, least, key)
    kind = pages.schema[key].dataType
    number = lambda c: F.nullif(F.regexp_extract(field(c), r"^<urn:x-page:(.*)>$", 1), F.lit("null")).cast(kind)
    return records(spark, folder).select(
        number("WARC-Record-ID").alias(key),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
    )
