"""WARC archives, and a two-level capture index over them."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir, small_batches, written

LEAST_SHARED = 100
#: Compressed bytes that one task reads back.
TASK_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRIES = "key string, page_id long, file string, offset long, length long"
SHARDS = "shard int, file string, first_key string, first_id long, blocks int, entries long"
RECORDS = "url string, page_id long, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def url_key(url: Column) -> Column:
    """The sort key of a URL: its host's labels in reverse, then the port, path and query; a null URL has an empty key."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


def safe_url(url: Column) -> Column:
    """The URL with control characters and spaces percent-encoded, as they would break a header or an index line."""
    for i in (*range(33), 127):
        url = F.replace(url, F.lit(chr(i)), F.lit(f"%{i:02X}"))
    return url


def _record(url: str | None, page_id: int | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}"
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {url}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        head += [f"WARC-Refers-To-Target-URI: {refers_url}"] if refers_url is not None else []
        payload = b""
    block = http + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """One uncompressed record: url, page_id, record_type, payload, payload_bytes, payload_digest, refers_to. A response's payload must have its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    page = lambda x: int(x[10:-1]) if len(x) > 11 else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']}: its payload does not have its digest")
    return {
        "url": fields.get("WARC-Target-URI"), "page_id": page(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"],
        "payload": payload if response else None, "payload_bytes": size, "payload_digest": digest,
        "refers_to": None if response else page(fields["WARC-Refers-To"])
    }


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", most_bytes: int = 1 << 30) -> DataFrame:
    """Write a record for each row of pages (page_id long, url string, html string; other columns are left alone) to WARC files in folder.

    Every record is a gzip member of its own. The payload is html in UTF-8; a null is empty. Of records with equal payloads
    (by SHA-256) of LEAST_SHARED bytes or more, those of the smallest page_id are responses and the others revisits that refer to it; all others are
    responses. Rows without page_id are revisits where their payload has a smallest page_id, else responses. Each task writes its own files of about most_bytes, under
    names that no other attempt has, so a lost attempt's file is in no index. Returns the index entries (key, page_id, file, offset, length), as a written table.
    """
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), safe_url(F.col("url").cast("string")).alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")
    )
    p = p.withColumns({"digest": F.sha2("payload", 256), "key": url_key(F.col("url"))})
    large = written(p.where(F.length("payload") >= LEAST_SHARED).select("digest", "page_id", "url"), "digests")
    first = written(large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL").drop("n"), "payloads")
    urls = large.join(first, "digest").where("page_id = first_id").groupBy("digest").agg(F.min("url").alias("first_url"))
    first = written(first.join(urls, "digest"), "payloads")
    p = p.join(first, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None:
                    name, at = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip.compress(_record(r["url"], r["page_id"], r["payload"], r["digest"], r["refers_to"], r["first_url"], date), 5, mtime=0)
                out.write(member)
                rows.append((r["key"], r["page_id"], name, at, len(member)))
                at += len(member)
                if at >= most_bytes:
                    out.close()
                    out = None
            yield _batch(rows, ENTRIES)
        if out is not None:
            out.close()

    return written(p.select("url", "page_id", "payload", "digest", "refers_to", "first_url", "key").mapInArrow(run, ENTRIES), "captures")


def _order(key: str, page_id: int | None) -> tuple:
    return (key, page_id is not None, page_id or 0)


def build_index(entries: DataFrame, folder: str, block_entries: int = 3000, shard_entries: int = 500_000) -> list[tuple]:
    """Sort the entries by (key, page_id) into shards, each a file of compressed blocks with a sparse directory of its own.

    A shard's directory holds the first entry, offset and length of each block. Returns (first entry's order, file) of each
    shard in order: a row for each shard_entries of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        shard, out, blocks, at, held, entries = TaskContext.get().partitionId(), None, [], 0, [], 0
        name = f"{shard:05d}-{uuid.uuid4().hex}"

        def flush() -> None:
            nonlocal at, held
            data = zlib.compress(json.dumps(held).encode(), 6)
            out.write(data)
            blocks.append((held[0][0], held[0][1], at, len(data)))
            at, held = at + len(data), []

        for batch in batches:
            for r in batch.to_pylist():
                out = out or files.open_output_stream(f"{base}/{name}.blocks", compression=None)
                held.append((r["key"], r["page_id"], r["file"], r["offset"], r["length"]))
                entries += 1
                if len(held) >= block_entries:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            with files.open_output_stream(f"{base}/{name}.directory", compression=None) as f:
                f.write(zlib.compress(json.dumps(blocks).encode(), 6))
            yield _batch([(shard, name, blocks[0][0], blocks[0][1], len(blocks), entries)], SHARDS)

    shards = entries.count() // shard_entries + 1
    parts = entries.repartitionByRange(shards, "key", "page_id").sortWithinPartitions("key", "page_id")
    return [(_order(r.first_key, r.first_id), r.file) for r in written(parts.mapInArrow(run, SHARDS), "shards").orderBy("shard").collect()]


class _Index:
    """Lookups in one task: binary search for the shard, in its directory for the block, then in the block; the last ones read are kept."""

    def __init__(self, shards: list[tuple], folder: str) -> None:
        self.files, self.base = fs.FileSystem.from_uri(folder)
        self.firsts, self.names = [x[0] for x in shards], [x[1] for x in shards]
        self.shard, self.block, self.blocks, self.lines = -1, (-1, -1), [], []

    def _block(self, shard: int, k: int) -> list[tuple]:
        if self.shard != shard:
            with self.files.open_input_file(f"{self.base}/{self.names[shard]}.directory") as f:
                self.blocks = json.loads(zlib.decompress(f.read()))
            self.shard, self.orders = shard, [_order(b[0], b[1]) for b in self.blocks]
        if self.block != (shard, k):
            with self.files.open_input_file(f"{self.base}/{self.names[shard]}.blocks") as f:
                f.seek(self.blocks[k][2])
                self.lines = [(_order(x[0], x[1]), *x[2:]) for x in json.loads(zlib.decompress(f.read(self.blocks[k][3])))]
            self.block = (shard, k)
        return self.lines

    def find(self, key: str, page_id: int | None) -> list[tuple[str, int, int]]:
        """(file, offset, length) of all captures of the page."""
        want, found = _order(key, page_id), []
        shard = bisect_right(self.firsts, want) - 1
        while shard >= 0:  # equal entries may begin in an earlier block or shard
            self._block(shard, self.block[1] if self.block[0] == shard else 0)
            k = bisect_right(self.orders, want) - 1
            while k >= 0:
                lines = self._block(shard, k)
                i = bisect_right(lines, want, key=lambda x: x[0])
                while i and lines[i - 1][0] == want:
                    i -= 1
                    found.append(lines[i][1:])
                if i or lines[0][0] != want:
                    return found
                k -= 1
            shard -= 1
        return found


def read_captures(wanted: DataFrame, shards: list[tuple], index: str, archives: str, reads: int = 512, tasks: int | None = None) -> DataFrame:
    """The records of the wanted (key, page_id) pairs, looked up in the index and read by range from the archives.

    Repeated pairs count once; a pair that the index lacks gives no row. Rows have the columns RECORDS; a revisit's payload is null, the
    other columns are those of the full payload. A record whose payload does not have its digest stops the read. Ranges of keys are dealt to
    ``tasks`` tasks, the session's parallelism if not given: what they read is payloads, of which the pairs' own size says nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Index(shards, index)
        files, base = fs.FileSystem.from_uri(archives)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for whole in batches:
            for at in range(0, whole.num_rows, reads):
                spans = sorted(x for r in whole.slice(at, reads).to_pylist() for x in look.find(r["key"], r["page_id"]))
                rows, name, f = [], None, None
                for file, offset, length in spans:
                    if file != name:
                        if f:
                            f.close()
                        name, f = file, files.open_input_file(f"{base}/{file}")
                    f.seek(offset)
                    record = parse_record(gzip.decompress(f.read(length)))
                    rows.append(tuple(record[n] for n in names))
                if f:
                    f.close()
                yield _batch(rows, RECORDS)

    return wanted.select("key", F.col("page_id").cast("long").alias("page_id")).distinct().repartitionByRange(
        tasks or wanted.sparkSession.sparkContext.defaultParallelism, "key", "page_id"
    ).sortWithinPartitions("key", "page_id").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives and an index of pages, then look every page up and read it back. Columns RECORDS, a row for each row of pages."""
    spark = pages.sparkSession
    small_batches(spark)
    archives, index = shared_dir(spark, "archives"), shared_dir(spark, "index")
    entries = write_archives(pages, archives)
    shards = build_index(entries, index)
    stored = entries.agg(F.sum("length")).first()[0] or 0
    wanted = pages.select(url_key(safe_url(F.col("url").cast("string"))).alias("key"), "page_id")
    return read_captures(wanted, shards, index, archives, tasks=max(spark.sparkContext.defaultParallelism, stored // TASK_BYTES))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through the archives and back."""
    back = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The oracle works from the pages alone.
OP3_SQL = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > min(page_id) OVER (PARTITION BY coalesce(html, '')) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > min(page_id) OVER (PARTITION BY coalesce(html, '')) THEN min(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages
"""
