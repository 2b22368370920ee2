"""WARC archives and their capture index, merged from locally sorted runs by a loser tree."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, n_parts, stage, work_path

EPOCH = dt.datetime(2020, 1, 1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Index rows that one merging task should get.
ROWS_A_TASK = 200_000


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed and joined by commas, then ')' and the path and query."""
    m = re.match(r"(?s)[^:/?#]*://([^/?#]*)([^#]*)", url or "")
    if not m:
        return ")" + (url or "")
    host = m[1].lower().rpartition("@")[2]
    return ",".join(reversed(host.split("."))) + ")" + m[2].lower()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has the HTTP head only, and refers to the record that has the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    when = EPOCH + dt.timedelta(seconds=(page_id or 0) % 10**9)
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:x-page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else "about:blank",
        "WARC-Date": f"{when:%Y-%m-%dT%H:%M:%SZ}",
        "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:x-page:{refers_to}>"}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _writer(folder: str, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Archives of one task, under names of its partition: a repeated attempt replaces them by the same."""
        fs, base = opened(folder)
        part, serial, out, records, size, drafts = TaskContext.get().partitionId(), 0, None, 0, 0, ""
        done: list[tuple] = []

        def close():
            nonlocal out, serial
            if out is not None:
                out.close()
                name = f"pages-{part:06d}-{serial:04d}.warc.gz"
                fs.move(drafts, f"{base}/{name}")
                done.append((f"{folder}/{name}", records, size))
                out, serial = None, serial + 1

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4))):
                payload = (html.as_py() or "").encode()
                if out is None:
                    drafts = f"{base}/draft-{uuid.uuid4().hex}"
                    out, records, size = fs.open_output_stream(drafts, compression=None), 0, 0
                packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                data = packer.compress(record(page_id.as_py(), url.as_py(), payload, digest_of(payload), refers_to.as_py())) + packer.flush()
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= most_bytes:
                    close()
        close()
        columns = list(zip(*done)) if done else [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])
    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, most_bytes: int = 256 << 20) -> DataFrame:
    """Write one record per row of ``pages(page_id, url, html)`` into .warc.gz files of about ``most_bytes`` in a
    shared folder; returns ``(archive, records, bytes)``. The files exist when the call returns.

    Of rows with equal payloads of at least ``min_bytes``, the one with the smallest page_id is a response and
    the others are revisits of it. A null html is an empty payload, a null url about:blank; rows that share page_id
    and payload are responses each; a null page_id revisits any row that has one. Only digests are grouped, and
    only those of repeated payloads are joined back by page_id, so a payload that many pages share is no hot key.
    """
    payload = F.coalesce("html", F.lit(""))
    named = pages.select("page_id", F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("n"))
    shared = named.where(F.col("n") >= min_bytes).groupBy("sha").agg(
        F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count("*").alias("copies")).where(
        "copies > 1 and refers_to is not null").select("sha", "refers_to")
    revisits = named.where(F.col("n") >= min_bytes).join(shared, "sha").where("page_id is null or page_id <> refers_to").select(
        F.col("page_id").alias("id"), F.col("sha").alias("id_sha"), "refers_to").distinct()
    rows = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("sha")).join(
        revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("id_sha")), "left")
    ordered = rows.select("page_id", "url", "html", "refers_to").sortWithinPartitions("page_id", "url", "html")
    in_small_batches(pages)
    fs, base = opened(folder)
    fs.create_dir(base, recursive=True)
    return stage(ordered.mapInArrow(_writer(folder, most_bytes), "archive string, records bigint, bytes bigint"), "archives")


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """``(offset, length, record)`` of each gzip member of an open archive; one record is in memory at a time."""
    offset, data = 0, b""
    while True:
        unpack, parts, taken = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not data:
                data = stream.read(1 << 20)
                if not data:
                    if taken:
                        raise ValueError("the archive ends inside a record")
                    return
            parts.append(unpack.decompress(data))
            taken += len(data) - len(unpack.unused_data)
            data = unpack.unused_data
        yield offset, taken, b"".join(parts)
        offset += taken


def parsed(data: bytes) -> dict:
    """Fields of a record, and its payload's length and digest: computed from a response's payload, and as stated
    by a revisit, which has none."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = block[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    number = re.compile(r"<urn:x-page:(-?\d*)>")
    if fields["warc-type"] == "response":
        size, digest = len(payload), digest_of(payload)
        if digest != stated:
            raise ValueError(f"payload digest differs: {fields['warc-record-id']}")
    else:
        size, digest = int(re.search(rb"(?i)content-length: (\d+)", http)[1]), stated
    own, other = number.match(fields["warc-record-id"])[1], number.match(fields.get("warc-refers-to", ""))
    return {"page_id": int(own) if own else None, "url_key": url_key(fields["warc-target-uri"]),
            "timestamp": re.sub(r"\D", "", fields["warc-date"]), "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["warc-type"], "refers_to": int(other[1]) if other else None}


CAPTURE = pa.schema([
    ("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("run", pa.string()),
    ("offset", pa.int64()), ("length", pa.int64())])
CAPTURE_DDL = ("url_key string, timestamp string, page_id bigint, payload_bytes bigint, payload_digest string, "
               "record_type string, refers_to bigint, run string, offset bigint, length bigint")


def order_of(row: dict) -> tuple:
    return row["url_key"], row["timestamp"], row["page_id"] is not None, row["page_id"] or 0, row["run"], row["offset"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            fs, path = opened(archive)
            with fs.open_input_stream(path, compression=None) as stream:
                run = [parsed(data) | {"run": archive, "offset": offset, "length": length} for offset, length, data in members(stream)]
            run.sort(key=order_of)
            yield pa.RecordBatch.from_pylist(run, schema=CAPTURE)


def capture_runs(archives: DataFrame) -> DataFrame:
    """Read every archive, one at a time and record by record, into a run of index rows sorted by url key and time."""
    spark = archives.sparkSession
    return archives.select("archive").repartition(n_parts(spark), "archive").mapInArrow(_runs, CAPTURE_DDL)


class LoserTree:
    """Merges k sorted iterators: inner nodes keep the losers of their matches, so that the next smallest item
    takes log2(k) comparisons along one path."""

    def __init__(self, sources: list[Iterator], key):
        self.sources, self.key, self.k = sources, key, len(sources)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _next(self, i: int):
        item = next(self.sources[i], None)
        return None if item is None else (self.key(item), i, item)

    def _before(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return b is None or a is not None and a[:2] < b[:2]

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            held = self.losers[node]
            if held < 0:  # still empty: the rival has not come yet
                self.losers[node] = i
                return
            if self._before(held, i):
                self.losers[node], i = i, held
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.k:
            i = self.losers[0]
            head = self.heads[i]
            if head is None:
                return
            yield head[2]
            self.heads[i] = self._next(i)
            self._replay(i)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[dict]] = {}
    for batch in batches:  # the partition's share of every run, each in order
        for row in batch.to_pylist():
            runs.setdefault(row["run"], []).append(row)
    some: list[dict] = []
    for row in LoserTree([iter(r) for r in runs.values()], order_of):
        some.append(row)
        if len(some) == 10_000:
            yield pa.RecordBatch.from_pylist(some, schema=CAPTURE)
            some = []
    yield pa.RecordBatch.from_pylist(some, schema=CAPTURE)


def merge_runs(runs: DataFrame, rows: int) -> DataFrame:
    """Globally ordered capture histories: by url key, timestamp, page_id, over all partitions in turn.

    The runs are cut at common split points of the whole order, so that a url with very many captures spreads over
    tasks; a task merges its share of all runs, about ROWS_A_TASK index rows, by a loser tree.
    """
    parts = max(n_parts(runs.sparkSession), -(-rows // ROWS_A_TASK))
    return runs.repartitionByRange(parts, "url_key", "timestamp", "page_id", "run", "offset").sortWithinPartitions(
        "run", "url_key", "timestamp", "page_id", "offset").mapInArrow(_merge, CAPTURE_DDL)


def archive_and_index(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives, read them back and return the merged capture index, one row per page:
    url_key, timestamp, page_id, payload_bytes, payload_digest, record_type, refers_to, run, offset, length.

    Pages have no capture time; a record's is EPOCH plus page_id seconds. See write_archives for nulls and ties;
    an empty table writes no archive and gives no rows.
    """
    spark = pages.sparkSession
    archives = write_archives(pages, folder or work_path(spark, "warc"), min_bytes)
    rows = archives.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first().n
    return merge_runs(stage(capture_runs(archives), "runs"), rows)
