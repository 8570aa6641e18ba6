"""WARC archives compressed with a dictionary of their own.

An archive is one file as the WARC-Zstandard form has it: a leading skippable
frame that holds a dictionary trained on the archive's own records, then one
frame for each record. Archives are rows of a table (name, size, bytes), written
by Spark into the shared folder, so that any reader of the cluster finds them.

Equal payloads are found by digest before the writing: of each digest only the
smallest page_id counts, a partial aggregation that a page with a million
copies passes as one row for each task. The page rows then meet their digest's
page in an ordinary left join, whose hot digests adaptive execution splits.
"""

from __future__ import annotations

import io
import re
import struct

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.arrow import by_bytes, tidy
from triagelake.llm.shared import Scratch, table

#: Payload bytes in an archive, dictionary size, and the bytes of records, evenly spread over the archive, that it is trained on.
ARCHIVE, DICTIONARY, TRAINED_ON = 12 << 20, 64 << 10, 4 << 20
SKIPPABLE = 0x184D2A5D
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ID = "urn:triagelake:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ARCHIVES = "archive string, n_records int, bytes binary"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(raw: Column) -> Column:
    """Upper-case base32 of a binary column's SHA-1 (20 bytes are 32 characters, 5 hex digits are 4 of them)."""
    letters = F.lit(BASE32)

    def spelled(digest: Column) -> Column:
        parts = []
        for k in range(8):
            five = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
            parts += [F.substring(letters, F.shiftright(five, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
        return F.concat(*parts)

    return F.transform(F.array(F.sha1(raw)), spelled)[0]  # a lambda's argument is computed once


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload (null html: empty), digest, refers_to.

    Of rows with equal payloads of ``least`` bytes or more, those with the
    smallest page_id have a null refers_to (several, if that page is repeated);
    the others refer to it. A page without an id is never referred to and
    refers to nothing.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", base32_sha1(F.col("payload")))
    firsts = (
        rows.where(F.col("page_id").isNotNull() & (F.length("payload") >= least))
        .groupBy("digest").agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last"))
        .where("_first < _last").drop("_last")
    )
    later = (F.length("payload") >= least) & (F.col("page_id") > F.col("_first"))
    return rows.join(firsts, "digest", "left").withColumn("refers_to", F.when(later, F.col("_first"))).drop("_first")


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record: a response with its payload, or a revisit, whose block is the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(records: list[bytes]) -> bytes:
    import zstandard

    step = max(1, -(-sum(map(len, records)) // TRAINED_ON))
    try:
        trained = zstandard.train_dictionary(DICTIONARY, records[::step], k=200, d=8)
    except zstandard.ZstdError:  # too few records, or nothing in common: the form allows a dictionary of plain content
        trained = zstandard.ZstdCompressionDict(b"".join(x[:512] for x in records[:64]), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    inside = zstandard.ZstdCompressor(level=9).compress(trained.as_bytes())
    one = zstandard.ZstdCompressor(level=3, dict_data=trained).compress
    return struct.pack("<II", SKIPPABLE, len(inside)) + inside + b"".join(map(one, records))


def read_archive(data: bytes) -> list[tuple]:
    """The records of an archive, in RECORDS' order of fields."""
    import zstandard

    magic, n = struct.unpack("<II", data[:8])
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + n], max_output_size=1 << 26))
    with zstandard.ZstdDecompressor(dict_data=trained).stream_reader(io.BytesIO(data[8 + n :]), read_across_frames=True) as f:
        plain = f.read()
    out, at = [], 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in plain[at:end].decode().split("\r\n")[1:])
        at = end + 4
        block = plain[at : at + int(head["Content-Length"])]
        at += len(block) + 4
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
        page, refers = head["WARC-Record-ID"][len(ID) + 1 : -1], head.get("WARC-Refers-To")
        kind = head["WARC-Type"]
        out.append((int(page) if page else None, head.get("WARC-Target-URI"), kind, int(refers[len(ID) + 1 : -1]) if refers else None,
                    head["WARC-Payload-Digest"].removeprefix("sha1:"), length, payload if kind == "response" else None))
    return out


def write_archives(rows: DataFrame) -> DataFrame:
    """Archives of ``with_revisits``'s rows; each holds about ARCHIVE bytes of payload, one record at least."""
    def run(batches):
        part, held, size, k = TaskContext.get().partitionId(), [], 0, 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{k:05d}.warc.zst"]), pa.array([len(held)], pa.int32()), pa.array([write_archive(held)], pa.binary())], ["archive", "n_records", "bytes"])

        for batch in by_bytes(batches, "payload", 4 << 20):
            for r in batch.to_pylist():
                held.append(record_bytes(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"]))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield done()
                    held, size, k = [], 0, k + 1
        if held:
            yield done()

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(tidy(run), ARCHIVES)


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the archives; a revisit has no payload of its own."""
    def run(batches):
        for batch in batches:
            for data in batch["bytes"]:
                cols = list(zip(*read_archive(data.as_py()), strict=True))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    return archives.select("bytes").mapInArrow(tidy(run), RECORDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page, from the archives as they are read back; an empty table writes none and gives no rows.

    Lengths and digests are those of the payload that was read where the record
    has one; a revisit says its own in its headers.
    """
    archives = Scratch(spark).save(write_archives(with_revisits(table(spark, sf_dir, "pages"))), codec="uncompressed")
    back = read_archives(archives)
    own = F.col("record_type") == "response"
    return back.select(
        "page_id", F.when(own, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


#: The rows of ``op9_warc``: base32 letters are five bits of the digest each, 20 bits (five hex digits) at a time.
OP9_SQL = f"""WITH p AS (SELECT page_id::BIGINT AS page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first,
 array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}', 1 + ((('0x' || substr(hex, (i // 4 * 5 + 1)::BIGINT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM d"""
