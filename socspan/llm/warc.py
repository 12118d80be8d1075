"""WARC archives: writing pages with revisit records, and reading by boundary-chain verification.

Reading splits files into byte ranges. A task can't tell from its range
whether "WARC/1.1" starts a record or is text inside a payload, so it emits
every place that parses as a header as a candidate, with the offset of the
record that would follow. Pointer jumping over these candidate-to-successor
links from the file's first byte keeps just the records that the chain
reaches; its rounds are the logarithm of the records of a file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_at, shared_dir, short_batches, written

VERSION = b"WARC/1.1\r\n"
CHUNK = 4 << 20  # bytes of a file that a task looks through
HEADER_READ = 64 << 10  # bytes that are read at once while a header's end is looked for
FILE_MOST = 256 << 20  # a file that reaches this size is closed and another begun
REVISIT_LEAST = 100  # shorter payloads are always stored
FIRST_SENT = 200_000  # digests that occur twice or more are sent to all executors up to this number (30 MB), and joined beyond it
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # of all records, so that repeated runs write the same bytes

MANIFEST = "file string, bytes long, records long"
CANDIDATE = "file string, at long, next long, kind string, page_id long, refers_to long, digest string, payload_bytes long, url string"


def _record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    rid = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return VERSION + "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, done, size, n = None, [], 0, 0
        for pdf in batches:
            for there, page_id, url, body, digest, revisit, refers in zip(*(pdf[c].tolist() for c in ("there", "page_id", "url", "body", "digest", "revisit", "refers")), strict=True):
                if out is None:
                    to, size, n = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc", 0, 0
                    fs, name = file_at(to)
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(name)
                rec = _record("revisit" if revisit else "response", page_id if there else None, url, body.encode("utf-8", "replace"), digest, refers if revisit else None)
                out.write(rec)
                size, n = size + len(rec), n + 1
                if size >= FILE_MOST:
                    out.close()
                    done.append((to, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((to, size, n))
        yield pd.DataFrame(done, columns=["file", "bytes", "records"])

    return write


def write_warc(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """One record per row of pages (page_id, url, html); returns the manifest of files.

    Of equal payloads of at least REVISIT_LEAST bytes the smallest page_id is a
    response and the others are revisits that refer to it; rows that repeat
    that smallest page_id are responses too. Null html counts as empty. A null
    page_id never is what others refer to. An empty table gives no file.
    Digests that occur once aren't looked up; the others keep their smallest
    id, after a partial aggregation. Beyond FIRST_SENT of them the pages are
    joined, which Spark may split where one payload is very common.
    """
    spark = pages.sparkSession
    short_batches(spark)
    folder = folder or shared_dir(spark, "warc")
    page = F.col("page_id").cast("long")
    p = pages.select(page.alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("body"))
    p = p.withColumn("digest", F.sha2("body", 256))
    big = p.filter(F.octet_length("body") >= REVISIT_LEAST)
    first = big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    first = written(first, "warc-first")
    p = p.join(F.broadcast(first) if first.count() <= FIRST_SENT else first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    rows = p.select(F.col("page_id").isNotNull().alias("there"), F.coalesce("page_id", F.lit(0)).alias("page_id"), "url", "body", "digest", revisit.alias("revisit"), F.coalesce("first", F.lit(0)).alias("refers"))
    return written(rows.mapInPandas(_writer(folder), MANIFEST), "warc-manifest")


def _number(text: bytes | None, before: bytes) -> int | None:
    m = re.fullmatch(rb"<?%b(-?\d+)>?" % before, text or b"")
    return int(m[1]) if m else None


def _parse(f, at: int, size: int) -> dict | None:
    """The candidate at an offset, or None if no record with its whole block can start there."""
    fields, pos, rest = {}, at + len(VERSION), b""
    while True:  # line by line, so that text inside a payload is given up at its first line that isn't a header's
        parts, got = [rest], rest.find(b"\r\n")
        while got < 0 and pos < size:
            part = f.read_at(min(HEADER_READ if len(parts) > 1 else 4096, size - pos), pos)
            pos += len(part)
            # a line's end may lie across two reads
            split = parts[-1][-1:] == b"\r" and part[:1] == b"\n"
            got = sum(map(len, parts)) + (-1 if split else part.find(b"\r\n")) if split or b"\r\n" in part else -1
            parts.append(part)
        if got < 0:
            return None
        data = b"".join(parts)
        line, rest = data[:got], data[got + 2 :]
        if not line:
            break
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        fields[k.strip().lower()] = v.strip()
    if not (fields.get(b"content-length") or b"").isdigit():
        return None
    n, block = int(fields[b"content-length"]), pos - len(rest)
    if block + n + 4 > size:
        return None
    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
    out = {"at": at, "next": block + n + 4, "kind": kind, "page_id": _number(fields.get(b"warc-record-id"), b"urn:page:"), "refers_to": _number(fields.get(b"warc-refers-to"), b"urn:page:"), "digest": None, "payload_bytes": None}
    out["url"] = fields[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in fields else None
    if kind == "response":
        sha, skip, got, rest = hashlib.sha256(), None, 0, b""
        for i in range(0, n, 1 << 20):
            part = f.read_at(min(1 << 20, n - i), block + i)
            if skip is None:
                rest += part
                if (cut := rest.find(b"\r\n\r\n")) < 0:
                    continue
                part, skip = rest[cut + 4 :], cut + 4
            sha.update(part)
            got += len(part)
        out |= {"digest": sha.hexdigest(), "payload_bytes": got}
    elif kind == "revisit":
        out["digest"] = fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha256:")
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CANDIDATE.split(", ")]
    for pdf in batches:
        for file, size, lo, chunk in zip(*(pdf[c].tolist() for c in ("file", "bytes", "lo", "chunk")), strict=True):
            fs, name = file_at(file)
            found = []
            with fs.open_input_file(name) as f:
                data = f.read_at(min(chunk + len(VERSION) - 1, size - lo), lo)
                i = data.find(VERSION)
                while 0 <= i < chunk:
                    if c := _parse(f, lo + i, size):
                        found.append(c | {"file": file})
                    i = data.find(VERSION, i + 1)
            out = pd.DataFrame(found, columns=names)
            for c in ("page_id", "refers_to", "payload_bytes"):
                out[c] = pd.array([None if x is None else x for x in (y[c] for y in found)], dtype="Int64")
            yield out


def reached(links: DataFrame) -> DataFrame:
    """Of links (file, at, next) those that the chain from offset 0 of each file reaches.

    Each round joins the reached offsets with jumps of doubled length, so k
    rounds follow chains of 2^k records; both tables hold one row per
    candidate at most, and files bound the rows of a key.
    """
    jump = written(links.select("file", "at", "next").dropDuplicates(["file", "at"]), "warc-jump")
    got = written(jump.filter("at = 0").select("file", "at"), "warc-reached")
    n = got.count()
    while True:
        ahead = got.join(jump, ["file", "at"]).select("file", F.col("next").alias("at")).join(jump.select("file", "at"), ["file", "at"], "left_semi")
        got = written(got.union(ahead).distinct(), "warc-reached")
        if (now := got.count()) == n:
            return got
        n = now
        further = jump.select("file", F.col("at").alias("next"), F.col("next").alias("then"))
        jump = written(jump.join(further, ["file", "next"], "left").select("file", "at", F.coalesce("then", "next").alias("next")), "warc-jump")


def read_warc(manifest: DataFrame) -> DataFrame:
    """The records of the files: file, at, kind, page_id, url, payload_bytes, digest, refers_to.

    payload_bytes of a revisit is that of the response that it refers to.
    Raises ValueError where the chain of a file doesn't end at its last byte or
    hasn't as many records as were written.
    """
    short_batches(manifest.sparkSession)
    ranges = manifest.select("file", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(CHUNK))).alias("lo"), F.lit(CHUNK).alias("chunk")).filter("lo < bytes")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(ranges.repartition(n, "file", "lo").mapInPandas(_scan, CANDIDATE), "warc-candidates")
    records = found.join(reached(found), ["file", "at"], "left_semi")
    ends = records.groupBy("file").agg(F.max("next").alias("end"), F.count(F.lit(1)).alias("n"))
    if broken := manifest.join(ends, "file", "left").filter("bytes > 0 and not (end <=> bytes and n <=> records)").select("file", "bytes", "records", "end", "n").first():
        raise ValueError(f"{broken.file}: {broken.n} of {broken.records} records, which end at {broken.end} of {broken.bytes} bytes.")
    stored = records.filter("kind = 'response'").select(F.col("page_id").alias("refers_to"), "digest", F.col("payload_bytes").alias("stored_bytes")).filter("refers_to is not null").dropDuplicates(["refers_to", "digest"])
    again = records.filter("kind = 'revisit'").join(stored, ["refers_to", "digest"], "left").withColumn("payload_bytes", F.col("stored_bytes"))
    cols = ["file", "at", "kind", "page_id", "url", "payload_bytes", "digest", "refers_to"]
    return records.filter("kind = 'response'").select(cols).unionByName(again.select(cols))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to WARC files and read back."""
    records = read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return records.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


OP5_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
f as (select sha256(body) as d, min(page_id) as first_id from p where octet_length(encode(body)) >= 100 group by 1)
select p.page_id, octet_length(encode(p.body)) as payload_bytes, sha256(p.body) as payload_digest,
  case when f.first_id is not null and f.first_id is distinct from p.page_id then 'revisit' else 'response' end as record_type,
  case when f.first_id is distinct from p.page_id then f.first_id end as refers_to
from p left join f on sha256(p.body) = f.d
"""
