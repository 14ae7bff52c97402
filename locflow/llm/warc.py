"""Operator 3: WARC archives written by Spark and read back by boundary chains.

Writing. Each page becomes one record (a table row); Spark's text sink puts
the two line ends after each record, which is the record separator of the
format. Of pages with equal payloads the one of the smallest id is a
``response``; the others are ``revisit`` records whose HTTP header still
names the payload's length. Payloads are told apart by SHA-256, computed
before anything is shuffled, and only the digests that occur for more than one
page are joined back.

Reading. Archives are plain files and are read in splits, cut at every
occurrence of the record magic, also inside payloads. Each cut is a candidate
record; a task parses its header and emits where its successor must begin.
Offsets are running sums inside a split plus the sums of the file's earlier
splits. Pointer jumping from offset 0 of each file (every round doubles the
jumps) keeps the records that a chain of boundaries reaches; magic inside a
payload is never reached. A record that holds the magic lies in several cuts:
which ones is settled on offsets alone, by file and megabyte, and a second pass
brings the bytes of a record's cuts together, each record on its own.

Defined cases: null html is an empty payload; a null page id or url is left
out of the header and comes back null; ids of any simple type come back as
they were (percent-encoded in the record); rows that repeat the smallest id of
their payload are all responses; line ends in urls are percent-encoded;
an empty table gives an empty folder and no rows; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locflow.llm.shared import work_folder, written

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
RECORDS_PER_FILE = 2048     # 11 rounds of jumping
DATE = "2024-01-01T00:00:00Z"
SMALLEST_REVISIT = 0        # payload bytes from which equal payloads are revisits
BLOCK = 1 << 20             # bytes of a file by which records meet the cuts they span

# Digits of base 32 (RFC 4648) beside those of Spark's conv.
DIGITS, CONV_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1: every five hex digits are four digits of base 32."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), CONV_DIGITS, DIGITS)


def records(pages: DataFrame, smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """One record of text per page, without the record's two last line ends."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).alias("n"),
                        base32_sha1(payload).alias("digest"), F.sha2(payload, 256).alias("sha256"))
    shared = (rows.where(F.col("n") >= smallest).groupBy("sha256")
              .agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"), F.count("*").alias("uses"))
              .where("uses > 1 and first_id is not null").select("sha256", "first_id"))
    rows = rows.join(written(shared, "warc-shared"), "sha256", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n").cast("string"), F.lit(END))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.url_encode(F.col(c).cast("string")), F.lit(">"))
    header = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", name("page_id")), F.lit(f"WARC-Date: {DATE}\r\n"), line("WARC-Target-URI", url),
        line("WARC-Refers-To", F.when(revisit, name("first_id"))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit(END))
    return rows.select(F.concat(header, http, F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))


def write(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write one record per page as uncompressed archives."""
    (records(pages).write.option("lineSep", END).option("compression", "none")
     .option("maxRecordsPerFile", records_per_file).text(path))


def cuts(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between occurrences of the magic, by file and split, in file order within a split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("value"))


FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.M)
CANDIDATE = ("file string, split bigint, at bigint, n bigint, size bigint, page_id string, type string, "
             "refers_to string, head bigint, payload_bytes bigint, payload_digest string, stated_digest string")


def fields(header: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.rstrip(b"\r").decode("utf-8", "replace") for k, v in FIELD.findall(header)}


def page_id(value: str | None) -> str | None:
    m = re.fullmatch(r"<urn:page:([^<>]*)>", value or "")
    return unquote_plus(m.group(1)) if m else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_body(block: bytes) -> tuple[int, bytes]:
    """The length that the HTTP header names, and what follows it."""
    end = block.find(b"\r\n\r\n")
    head, body = (block[:end], block[end + 4:]) if end >= 0 else (b"", block)
    length = fields(head).get("content-length", "")
    return (int(length) if length.isdigit() else len(body)), body


def parse(value: bytes):
    """A cut as a candidate: size of the record from its magic on, and what its header says; None if it has no header."""
    end = value.find(b"\r\n\r\n")
    f = fields(value[:end]) if end >= 0 else {}
    length = f.get("content-length", "")
    if not length.isdigit() or "warc-type" not in f:
        return None
    head, length = end + 4, int(length)
    stated = f.get("warc-payload-digest", "").removeprefix("sha1:")
    n = body_digest = None
    if head + length <= len(value):         # else the block holds the magic and goes on in the next cut
        n, body = http_body(value[head:head + length])
        body_digest = digest(body) if f["warc-type"] != "revisit" else stated
    return (len(MAGIC) + head + length + 4, page_id(f.get("warc-record-id")), f["warc-type"],
            page_id(f.get("warc-refers-to")), head, n, body_digest, stated)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every cut: where it begins in its split, how many bytes it takes, and its record if it has a header."""
    def run(batches):
        key, at = None, 0
        for batch in batches:
            rows = []
            for file, split, value in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "value"))):
                if (file, split) != key:
                    key, at = (file, split), 0
                n = len(value) + len(MAGIC)
                rows.append((file, split, at, n, *(parse(value) or (None,) * 8)))
                at += n
            names = [c.split()[0] for c in CANDIDATE.split(", ")]
            kinds = {"string": pa.string(), "bigint": pa.int64()}
            yield pa.RecordBatch.from_pydict({
                name: pa.array([r[k] for r in rows], kinds[c.split()[1]])
                for k, (name, c) in enumerate(zip(names, CANDIDATE.split(", ")))})

    return cuts(spark, path).mapInArrow(run, CANDIDATE)


def placed(found: DataFrame) -> DataFrame:
    """Candidates with the offset of their magic (``begin``) and of their successor (``next``) in the file.

    A cut's bytes are followed by the next magic, so its own magic stands
    just before it: at the sum of all bytes before, less one magic.
    """
    splits = found.groupBy("file", "split").agg(F.sum("n").alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    begin = F.col("base") + F.col("at") - len(MAGIC)
    return found.join(splits, ["file", "split"]).where(begin >= 0).withColumn("begin", begin).withColumn(
        "next", begin + F.col("size"))


def reachable(nodes: DataFrame) -> DataFrame:
    """``file, begin`` of the records that the chain from offset 0 of their file passes (nodes: ``file, begin, next``).

    After round k a node's pointer spans 2^k records and all of a file's
    first 2^k records are marked; a pointer past the last record is null.
    """
    longest = nodes.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    now = nodes.select("file", "begin", "next", (F.col("begin") == 0).alias("reached"))
    for _ in range(max(longest - 1, 0).bit_length()):
        now = written(now, "warc-chain")
        marks = now.where("reached and next is not null").select("file", F.col("next").alias("begin"), F.lit(True).alias("mark"))
        jump = now.select("file", F.col("begin").alias("next"), F.col("next").alias("then"))
        now = now.join(jump, ["file", "next"], "left").join(marks, ["file", "begin"], "left").select(
            "file", "begin", F.col("then").alias("next"), (F.col("reached") | F.coalesce("mark", F.lit(False))).alias("reached"))
    return now.where("reached").select("file", "begin")


def spanned(found: DataFrame, torn: DataFrame) -> DataFrame:
    """``file, cut, begin, size, head``: the cuts that each torn record spans. A record meets the cuts of its own
    megabytes only, so one file with many records or many cuts is dealt over many tasks."""
    spans = torn.withColumn("block", F.explode(F.expr(f"sequence(begin div {BLOCK}, (next - 1) div {BLOCK})")))
    at = found.select("file", F.col("begin").alias("cut"), F.expr(f"begin div {BLOCK}").alias("block"))
    return at.join(spans, ["file", "block"]).where("cut >= begin and cut < next").select("file", "cut", "begin", "size", "head")


def put_together(spark: SparkSession, path: str, members: DataFrame) -> DataFrame:
    """Length and digest of the payloads of records that lie in several cuts (``members``: as ``spanned`` gives them)."""
    def measure(batches):
        key, at = None, 0
        for batch in batches:
            rows = []
            for file, split, value in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "value"))):
                if (file, split) != key:
                    key, at = (file, split), 0
                rows.append((file, split, at, value))
                at += len(value) + len(MAGIC)
            yield pa.RecordBatch.from_pydict({"file": pa.array([r[0] for r in rows], pa.string()),
                                              "split": pa.array([r[1] for r in rows], pa.int64()),
                                              "at": pa.array([r[2] for r in rows], pa.int64()),
                                              "value": pa.array([r[3] for r in rows], pa.binary())})

    def join(batches):
        for batch in batches:
            out = []
            for file, begin, size, head, parts in zip(*(batch.column(c).to_pylist()
                                                        for c in ("file", "begin", "size", "head", "parts"))):
                whole = MAGIC.encode().join(p["value"] for p in sorted(parts, key=lambda p: p["begin"]))
                n, body = http_body(whole[head:size - len(MAGIC) - 4])
                out.append((file, begin, n, digest(body)))
            yield pa.RecordBatch.from_pydict({"file": pa.array([r[0] for r in out], pa.string()),
                                              "begin": pa.array([r[1] for r in out], pa.int64()),
                                              "torn_bytes": pa.array([r[2] for r in out], pa.int64()),
                                              "torn_digest": pa.array([r[3] for r in out], pa.string())})

    rows = cuts(spark, path).mapInArrow(measure, "file string, split bigint, at bigint, value binary")
    spans = rows.withColumn("n", F.octet_length("value").cast("bigint") + len(MAGIC))
    splits = spans.groupBy("file", "split").agg(F.sum("n").alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    cut = spans.join(splits, ["file", "split"]).select("file", (F.col("base") + F.col("at") - len(MAGIC)).alias("cut"), "value")
    parts = cut.join(members, ["file", "cut"])      # both sides are dealt by cut, never by file alone
    parts = parts.groupBy("file", "begin", "size", "head").agg(     # of one record: bounded by its own size
        F.collect_list(F.struct(F.col("cut").alias("begin"), "value")).alias("parts"))
    return parts.mapInArrow(join, "file string, begin bigint, torn_bytes bigint, torn_digest string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder of archives: ``file, begin, page_id, type, refers_to, payload_bytes, payload_digest,
    stated_digest``; ids as text."""
    found = written(placed(written(candidates(spark, path), "warc-cuts")), "warc-candidates")
    chain = written(reachable(found.where("size is not null").select("file", "begin", "next")), "warc-reached")
    real = found.join(chain, ["file", "begin"])
    torn = written(real.where("payload_digest is null").select("file", "begin", "next", "size", "head"), "warc-torn")
    if not torn.isEmpty():
        real = real.join(put_together(spark, path, written(spanned(found, torn), "warc-members")), ["file", "begin"], "left").withColumns({
            "payload_bytes": F.coalesce("payload_bytes", "torn_bytes"),
            "payload_digest": F.coalesce("payload_digest", "torn_digest")})
    return real.select("file", "begin", "page_id", "type", "refers_to", "payload_bytes", "payload_digest", "stated_digest")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and return what reading them back gives, one row per page."""
    spark = pages.sparkSession
    path = work_folder(spark, "warc")
    write(pages, path)
    kind = pages.schema["page_id"].dataType
    return read(spark, path).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
                                    F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))


def oracle(pages: str = "pages") -> str:
    chunk = "('0x' || substr(sha1(payload), 1 + 5 * i, 5))::BIGINT"
    digits = " || ".join(f"substr('{DIGITS}', ((v >> {s}) & 31)::INT + 1, 1)" for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM {pages}),
d AS (SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
        array_to_string(list_transform(list_transform(range(8), lambda i: {chunk}), lambda v: {digits}), '') AS payload_digest,
        min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM d"""
