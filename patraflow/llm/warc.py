"""A content-addressed WARC archive.

Payload bytes are stored once per SHA-256 (`blobs`: digest, payload), the exact record headers apart from them (`records`: header, digest and
whether the record carries the payload). Original records come back by a join on the digest, which is computed anew from the stored bytes.
`export` writes the records as .warc.gz files, `read_warc` reads such files, and `records_of` takes ids, types and references from the
headers that it read and checks payloads against them.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _worker  # noqa: F401
from ._bitmap import bitmap, may_contain
from ._store import folder, release, save

#: Smaller payloads are always responses of their own.
LEAST = 100
CRLF = "\r\n"


def _header(kind, record, key, uri, size, digest, refers, refers_key):
    named = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))
    urn = lambda value: F.concat(F.lit("<urn:uuid:"), value, F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        named("WARC-Type", kind),
        named("WARC-Record-ID", urn(record)),
        named("WARC-Target-URI", F.regexp_replace(F.coalesce(uri, F.lit("")), "[\\r\\n]", " ")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        named("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        named("WARC-Refers-To", urn(refers)),
        F.when(refers.isNotNull(), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        named("Page-ID", key.cast("string")),
        named("Refers-To-Page-ID", refers_key.cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        named("Content-Length", size.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes `records` and `blobs` below path. Null payloads are empty; null urls are empty URIs; a record of a null id has no Page-ID. Each
    row has a record id of its own, repeated rows too.

    Of payloads that are equal and have LEAST bytes or more, the smallest id has the response and the others revisit it; repeated rows of
    that id are responses too, and their bytes are still stored once. A null id is never the smallest of several. Smaller payloads are
    responses, stored once by digest as well.
    """
    spark = pages.sparkSession
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    all_ = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text.alias("payload"))
    hashed = all_.select("page_id", "url", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest"), F.expr("uuid()").alias("record"))
    hashed.write.parquet(f"{path}/hashed")
    hashed = spark.read.parquet(f"{path}/hashed")
    # only digests that occur again are joined back: a digest of one row needs no partner
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record")).alias("first")
    again = hashed.groupBy(F.col("digest").alias("d")).agg(first, F.count("*").alias("n"), F.max("payload_bytes").alias("size")).where("n > 1").select("d", "first.page_id", "first.record", "size")
    again.write.parquet(f"{path}/again")
    again = spark.read.parquet(f"{path}/again").withColumnsRenamed({"page_id": "first_id", "record": "first_record"})
    out = hashed.join(again, F.col("digest") == F.col("d"), "left")
    revisit = F.col("d").isNotNull() & (F.col("payload_bytes") >= LEAST) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    size = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    header = _header(kind, F.col("record"), F.col("page_id"), F.col("url"), size, F.col("digest"), F.when(revisit, F.col("first_record")), F.when(revisit, F.col("first_id")))
    out.select(header.cast("binary").alias("header"), "digest", (~revisit).alias("carries")).write.parquet(f"{path}/records")
    # the bytes of a digest that occurs once are its row's; of others those of one row: the digest's rows of the smallest id, taken once
    bytes_ = all_.select("page_id", "payload", F.sha2("payload", 256).alias("digest")).withColumn("k", F.xxhash64("digest"))
    keyed = again.withColumn("k", F.xxhash64("d"))
    bits = bitmap(keyed, "k")
    owned = may_contain(bytes_, "k", bits).join(again.select("d", "first_id", F.lit(True).alias("repeated")), F.col("digest") == F.col("d"), "left")
    once = may_contain(bytes_, "k", bits, False).select("digest", "payload").unionByName(owned.where("repeated is null").select("digest", "payload"))
    owner = owned.where("repeated and page_id <=> first_id").groupBy("digest").agg(F.first("payload").alias("payload"))
    once.unionByName(owner).select("digest", F.col("payload").cast("binary").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/blobs")


def verified_blobs(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads with the digest and size of the bytes as they are; a wrong digest raises an error."""
    blobs = spark.read.parquet(f"{path}/blobs")
    real = F.sha2("payload", 256)
    checked = F.when(real == F.col("digest"), real).otherwise(F.raise_error(F.concat(F.lit("stored payload does not have the digest "), F.col("digest"))))
    return blobs.select(checked.cast("string").alias("digest"), "payload")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The original records, header and block (empty for a revisit), by a join of headers with payloads."""
    records = spark.read.parquet(f"{path}/records")
    carried = records.where("carries").select("header", F.col("digest").alias("named"))
    full = carried.join(verified_blobs(spark, path), F.col("named") == F.col("digest")).select("header", F.col("payload").alias("block"))
    return full.unionByName(records.where("not carries").select("header", F.lit(b"").alias("block")))


def export(spark: SparkSession, path: str, out: str, file_records: int = 2000) -> None:
    """The archive as .warc.gz files of at most file_records records (UTF-8 payloads), through Spark's writer."""
    record = F.concat("header", F.lit(b"\r\n"), "block").cast("string")
    writer = read(spark, path).select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records)
    writer.option("compression", "gzip").text(out)


def _parsed(batches):
    for batch in batches:
        for value in batch.column(0):
            data = value.as_py()
            data, at, heads, blocks = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, 0, [], []
            while at < len(data):
                stop = data.index(b"\r\n\r\n", at)
                head = data[at : stop + 2]
                size = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                if data[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
                    raise ValueError("a WARC record is cut short")
                heads.append(head)
                blocks.append(data[stop + 4 : stop + 4 + size])
                at = stop + 8 + size
            for i in range(0, len(heads), 256):
                part = blocks[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array(heads[i : i + 256], pa.binary()), pa.array(part, pa.binary()), pa.array([hashlib.sha256(b).hexdigest() for b in part], pa.string())], ["header", "block", "block_digest"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc and .warc.gz files: header (bytes, without the blank line), block and block_digest (SHA-256). One file is one row of
    the scan, so files must fit a task's memory; `export` bounds them by records. A record that is cut short raises an error."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed, "header binary, block binary, block_digest string")


def field(header, name: str):
    """The value of a header's field; null without it."""
    return F.nullif(F.regexp_extract(header.cast("string"), f"(?:^|\\r\\n){name}: ([^\\r\\n]*)", 1), F.lit(""))


def records_of(files: DataFrame) -> DataFrame:
    """Of read_warc()'s rows: page_id, payload_bytes, payload_digest, record_type, refers_to, all as the archives have them. A response whose
    payload has another digest than its header says, or a revisit of a response that isn't there, raises an error."""
    names = {"page_id": "Page-ID", "type": "WARC-Type", "record": "WARC-Record-ID", "said": "WARC-Payload-Digest", "refers": "WARC-Refers-To", "refers_id": "Refers-To-Page-ID"}
    rows = files.select(*[field(F.col("header"), v).alias(k) for k, v in names.items()], F.octet_length("block").cast("long").alias("bytes"), "block_digest")
    rows = save(rows.withColumns({"page_id": F.col("page_id").cast("long"), "refers_id": F.col("refers_id").cast("long"), "said": F.substring_index("said", ":", -1)}), "read")
    wrong = lambda what: F.raise_error(F.concat(F.lit(what), F.col("record")))
    full = rows.where("type = 'response'")
    own = F.when(F.col("said") == F.col("block_digest"), F.col("block_digest")).otherwise(wrong("not the payload that the header names: ").cast("string"))
    responses = full.select("page_id", F.col("bytes").alias("payload_bytes"), own.alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    target = full.join(rows.where("type = 'revisit'").select(F.col("refers").alias("r")).distinct(), F.col("record") == F.col("r"), "left_semi").select(F.col("record").alias("t"), F.col("bytes").alias("t_bytes"), F.col("block_digest").alias("t_digest"))
    both = rows.where("type = 'revisit'").join(target, F.col("refers") == F.col("t"), "left")
    same = F.when(F.col("said") == F.col("t_digest"), F.col("t_digest")).otherwise(wrong("no response with the payload that is revisited: ").cast("string"))
    return responses.unionByName(both.select("page_id", F.col("t_bytes").alias("payload_bytes"), same.alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_id").alias("refers_to")))


def archived(pages: DataFrame) -> DataFrame:
    """Writes an archive in the session's shared folder, its records as WARC files, reads these back and returns records_of() them."""
    spark = pages.sparkSession
    path = folder(spark, "warc")
    write(pages, path)
    release(spark)
    export(spark, path, f"{path}/warc")
    release(spark)
    return records_of(read_warc(spark, f"{path}/warc"))
