"""Vectors compressed to codes: a codebook a part, trained by an RDD treeAggregate over columnar blocks of integers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, written

#: Vectors of a block, and of the slices in which its distances are worked out, so that these stay in a core's cache.
BLOCK, SLICE = 4096, 256
GOOD = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"


@dataclass
class Codebooks:
    """entries[part, entry, position]: whole numbers; scale: what components are multiplied by before they are rounded down."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        """Lowercase hex of all components in decimal by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly: in 64-bit integers, or in Python's where these might not do."""
    low = np.floor(values * float(scale)) if not len(values) or np.abs(values).max() < 2.0**40 / scale else None
    if low is not None:
        return low.astype(np.int64)
    return np.array([scale * int(v) if abs(v) >= 2.0**53 else math.floor(scale * v) for v in values.tolist()], object)


def fitting(dims: int, *arrays: np.ndarray) -> type:
    """The smallest of int32, int64 and Python's integers that holds every squared distance between the arrays' rows exactly."""
    most = max((int(abs(a).max()) for a in arrays if a.size), default=0)
    bound = max(dims, 1) * (2 * most) ** 2
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object


def columns(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """Lists of numbers as a block [position, vector] of whole numbers; what a vector lacks counts as 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = whole(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), scale)
    sizes = np.diff(vectors.offsets.to_numpy())
    x = np.zeros((width, len(vectors)), flat.dtype)
    row = np.repeat(np.arange(len(vectors)), sizes)
    x[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = flat
    return x


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each vector [position, vector] in a book [entry, position]; ties to the lower entry. Distances accumulate dimension by dimension."""
    n, kind = block.shape[1], fitting(len(block), block, book)
    block, book = block.astype(kind), np.ascontiguousarray(book.T.astype(kind))
    code, error = np.zeros(n, np.int64), np.zeros(n, object if kind is object else np.int64)
    for at in range(0, n, SLICE):
        part = block[:, at : at + SLICE]
        total = np.zeros((part.shape[1], book.shape[1]), kind)
        gap = np.empty_like(total)
        for x, entry in zip(part, book):
            np.subtract(x[:, None], entry[None, :], out=gap)
            np.multiply(gap, gap, out=gap)
            total += gap
        best = total.argmin(axis=1)
        code[at : at + SLICE], error[at : at + SLICE] = best, total[np.arange(len(best)), best]
    return code, error


def tensors(state, block: np.ndarray, books: np.ndarray):
    """Adds a block's vectors to (sums, counts) by part and nearest entry; state is None at first."""
    parts, entries, width = books.shape
    sums, counts = state or (np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64))
    if sums.dtype == object or block.dtype == object or max(int(abs(block).max()), int(abs(sums).max())) + 1 > (1 << 62) // (block.shape[1] + 1):
        sums, block = sums.astype(object), block.astype(object)
    for p in range(parts):
        part = block[p * width : (p + 1) * width]
        code, _ = nearest(part, books[p])
        np.add.at(sums[p], code, part.T)
        np.add.at(counts[p], code, 1)
    return sums, counts


def merged(a, b):
    """Two states of tensors() as one."""
    if a is None or b is None:
        return b if a is None else a
    if object in (a[0].dtype, b[0].dtype) or int(abs(a[0]).max()) + int(abs(b[0]).max()) >= 1 << 62:
        return a[0].astype(object) + b[0].astype(object), a[1] + b[1]
    return a[0] + b[0], a[1] + b[1]


def train(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks of the vectors' parts; None if there is no vector.

    vectors: vec_id, embedding. Vectors that are null or hold null or non-finite components take no part. Components become floor(scale * x), exactly at
    any size. Vectors shorter than the longest count as filled up with 0, and its length is rounded up to a multiple of ``parts``. Each part's codebook
    starts as that part of the rows with the ``entries`` smallest vec_ids (equal ids by vector, null ids last); repeated rows count each time. A round assigns
    every part to its nearest entry (ties to the lower) and replaces each entry by floor(sum / count) of its parts; unused entries stay.

    The vectors are written once as blocks of columns. Each round is a treeAggregate of (sums, counts), whose size depends on the codebooks alone; a lost
    executor's blocks are read again.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kept = vectors.where(GOOD).select("vec_id", "embedding")
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return None
    width = -(-longest // parts)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = columns(batch.column("embedding").slice(at, BLOCK), parts * width, scale)
                if x.dtype == object:
                    yield pa.RecordBatch.from_pydict({"kind": ["text"], "data": [",".join(map(str, x.ravel())).encode()]})
                else:
                    kind = "<i2" if not x.size or abs(x).max() < 1 << 15 else "<i8"
                    yield pa.RecordBatch.from_pydict({"kind": [kind], "data": [x.astype(kind).tobytes()]})

    def opened(row) -> np.ndarray:
        flat = np.array([int(v) for v in row.data.decode().split(",") if v], object) if row.kind == "text" else np.frombuffer(row.data, row.kind).astype(np.int64)
        return flat.reshape(parts * width, -1) if width else np.zeros((0, 1), np.int64)

    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).toArrow().column("embedding")
    books = columns(first, parts * width, scale).T.reshape(len(first), parts, width).transpose(1, 0, 2)
    if not width:
        return Codebooks(books, scale)
    stored = written(kept.mapInArrow(blocks, "kind string, data binary"), "blocks").rdd
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(books)
        sums, counts = stored.treeAggregate(None, lambda state, row, now=now: tensors(state, opened(row), now.value), merged)
        used = counts[..., None] > 0
        books = np.where(used, sums // np.where(used, counts[..., None], 1), books)
        now.destroy()
    return Codebooks(books, scale)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code string (two hex digits an entry, in part order), error long (squared distances summed over parts; null beyond a long) of every vector that train() takes."""
    small_batches(vectors.sparkSession)
    parts, entries, width = books.entries.shape
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    kept = vectors.where(GOOD).select("vec_id", "label", "embedding")
    shape = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(None).cast("long").alias("error")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = columns(batch.column("embedding"), parts * width, books.scale)
            found = [nearest(x[p * width : (p + 1) * width], books.entries[p]) for p in range(parts)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            error = sum(e.astype(object) for _, e in found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                    pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())
                ], ["vec_id", "label", "code", "error"]
            )

    return kept.mapInArrow(run, shape)


def compressed(vectors: DataFrame, **options) -> DataFrame:
    """encode() by the codebooks of train() (same options), with label_error, the error summed over equal labels (nulls together; null beyond a long), and codebooks_sha256.

    A table without vectors gives no rows. Other columns are left alone; repeated rows have equal codes.
    """
    books = train(vectors, **options)
    if books is None:
        return vectors.limit(0).select(
            "vec_id", "label", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")),
            F.lit("").alias("codebooks_sha256")
        )
    coded = written(encode(vectors, books), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error"))
    return coded.join(sums, coded.label.eqNullSafe(sums.of), "left").select("vec_id", "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors: 4 parts, 256 entries, 4 rounds."""
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql(rounds: int) -> str:
    """The query in SQL: a table of assignments and one of codebooks a round."""
    text = """
WITH k AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, (d - 1) // w AS p, (d - 1) % w AS j, floor(1024 * embedding[d]::DOUBLE)::BIGINT AS v FROM (SELECT *, len(embedding) // 4 AS w, unnest(range(1, len(embedding) + 1)) AS d FROM k)),
c0 AS MATERIALIZED (SELECT e, p, j, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 256) f ON f.vec_id = x.vec_id)"""
    for r in range(rounds + 1):
        text += f""",
a{r} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, (q, e)) AS e, min(q) AS q FROM (
  SELECT x.vec_id, x.p, c.e, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS q FROM x JOIN c{r} c ON c.p = x.p AND c.j = x.j GROUP BY x.vec_id, x.p, c.e) GROUP BY vec_id, p)"""
        if r < rounds:
            text += f""",
n{r} AS (SELECT a.e, x.p, x.j, floor(sum(x.v) / count(*))::BIGINT AS v FROM x JOIN a{r} a ON a.vec_id = x.vec_id AND a.p = x.p GROUP BY a.e, x.p, x.j),
c{r + 1} AS MATERIALIZED (SELECT c.e, c.p, c.j, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN n{r} n ON n.e = c.e AND n.p = c.p AND n.j = c.j)"""
    return f"""{text},
o AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(q)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT o.vec_id, o.code, o.error, (sum(o.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) FROM c{rounds}) AS codebooks_sha256 FROM o JOIN k ON k.vec_id = o.vec_id"""


OP13_SQL = _sql(4)
