"""Operator 1, WARC archives: a writer and a splittable reader.

Writer: one gzip member per record. Members are written by Spark's text writer as raw bytes, so any store Spark
reaches will do and the commit protocol covers lost executors. The writer ends each row with a NUL byte, which is
the last byte of a member whose record is under 16 MiB (the high byte of its length); a larger record is followed by
an empty member, which ends in NUL as well.

Reader: tasks take byte ranges of the files, scan them for gzip magic, accept a candidate if it decodes to a WARC
header, and own the records that start inside their range; a record may end beyond it. Bytes that only look like
magic fail to decode and are passed over. Stores that pyarrow can't open are read whole by Spark's binary source.

Null html: an empty payload. Null url: no target header. Rows with a null page_id are written as responses without
an id and read back with a null one. Repeated rows with the least page_id of a payload are all responses. Empty
table: an empty archive, no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.llm.common import fresh_key, tasks_for

MAGIC, CHUNK, HEAD = b"\x1f\x8b\x08", 1 << 20, 1 << 14
SCHEMA = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string"
PYARROW_SCHEMES = ("file", "hdfs", "s3", "s3a", "gs")


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is the least page_id of an equal payload of at least ``min_bytes``, if another's."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    firsts = rows.where((F.length("payload") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows, firsts = rows.withColumn("key", fresh_key(F.col("sha"))), firsts.select(fresh_key(F.col("sha")).alias("key"), "first")
    other = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    return rows.join(firsts, "key", "left").select("page_id", "url", "payload", other.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response"]
    lines += [f"WARC-Record-ID: <urn:page:{page_id}>"] if page_id is not None else []
    lines += ["WARC-Target-URI: " + "".join(url.splitlines())] if url is not None else []
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as a gzip member, and an empty one after it where needed, so that the last byte is NUL."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    return out if out.endswith(b"\0") else out + gzip.compress(b"", mtime=0)


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) into files under ``path``."""

    @F.pandas_udf("binary")
    def pack(page_id: pd.Series, url: pd.Series, payload: pd.Series, refers_to: pd.Series) -> pd.Series:
        whole = lambda x: None if pd.isna(x) else int(x)
        return pd.Series([member(record(whole(a), b, bytes(c), whole(d)))[:-1] for a, b, c, d in zip(page_id, url, payload, refers_to, strict=True)], dtype=object)

    text = lambda c: F.col(c).cast("string")  # noqa: E731  ids as strings: pandas would make longs with nulls floats
    rows = mark_revisits(pages, min_bytes).select(pack(text("page_id"), F.col("url"), F.col("payload"), text("refers_to")).cast("string").alias("value"))
    rows.write.option("lineSep", "\0").text(path)


def parse(data: bytes) -> dict:
    """The fields of one decoded record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", len(rest)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(fields[name].removeprefix("<urn:page:").rstrip(">")) if fields.get(name, "").startswith("<urn:page:") else None
    kind = fields.get("warc-type")
    if kind == "revisit":
        lengths = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, digest = int(lengths[0]) if lengths else None, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {"page_id": number("warc-record-id"), "record_type": kind, "refers_to": number("warc-refers-to"), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest}


class Window:
    """A buffer over a seekable file that moves forward: bytes from ``at`` on, which stand in ``data`` from ``pos`` on."""

    def __init__(self, file, at: int) -> None:
        self.file, self.at, self.data, self.pos = file, at, b"", 0
        file.seek(at)

    def more(self) -> bool:
        data = self.file.read(CHUNK)
        self.data, self.pos = self.data[self.pos :] + data, 0
        return bool(data)

    def skip(self, n: int) -> None:
        self.pos, self.at = self.pos + n, self.at + n


def decode(w: Window) -> tuple[bytes, int] | None:
    """The record that starts where ``w`` stands and its packed length; None if there is none."""
    unpack = zlib.decompressobj(31)
    out, done = [], 0
    try:
        while not unpack.eof:
            if w.pos + done == len(w.data) and not w.more():
                return None
            part = w.data[w.pos + done : w.pos + done + (CHUNK if out else HEAD)]
            out.append(unpack.decompress(part))
            done += len(part)
            if len(out) == 1 and out[0] and not out[0].startswith(b"WARC/"[: len(out[0])]):
                return None
    except zlib.error:
        return None
    data = b"".join(out)
    return (data, done - len(unpack.unused_data)) if data.startswith(b"WARC/") else None


def records_in(file, start: int, end: int) -> Iterator[dict]:
    """The records of ``file`` that start in [start, end)."""
    w = Window(file, start)
    while w.at < end:
        i = w.data.find(MAGIC, w.pos)
        if i < 0:
            w.skip(max(0, len(w.data) - 2 - w.pos))
            if not w.more():
                return
            continue
        w.skip(i - w.pos)
        if w.at >= end:
            return
        found = decode(w)
        if found:
            yield parse(found[0])
        w.skip(found[1] if found else 1)


def open_file(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    system, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(name)


def read_archive(spark: SparkSession, path: str, split_bytes: int = 8 << 20) -> DataFrame:
    """The records of all files under ``path``, each read by the task whose byte range it starts in."""
    files = spark.read.format("binaryFile").load(path)
    if path.partition(":")[0] not in PYARROW_SCHEMES:
        return files.mapInPandas(_whole_files, SCHEMA)
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("end"))
    # by number, since adaptive execution would take rows so narrow for little work and read them in one task
    ranges = ranges.repartition(tasks_for(spark, ranges.count()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                with open_file(r.path) as file:
                    yield from _frames(records_in(file, int(r.start), int(r.end)))

    return ranges.mapInPandas(run, SCHEMA)


def _whole_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import io

    for pdf in frames:
        for content in pdf.content:
            yield from _frames(records_in(io.BytesIO(content), 0, len(content)))


def _frames(records: Iterator[dict], rows: int = 2000) -> Iterator[pd.DataFrame]:
    batch: list[dict] = []
    for r in records:
        batch.append(r)
        if len(batch) == rows:
            yield _frame(batch)
            batch = []
    if batch:
        yield _frame(batch)


def _frame(batch: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(batch).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})
