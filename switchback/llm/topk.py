"""Exact top-k by inner product over an impact-ordered index, read score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import small_batches, written

LEVELS = 16
ROUND = 128
#: Beyond this, sums of products in doubles might not be exact, and every vector of the block is scored.
EXACT = 1 << 22
INDEX = "block long, dims int, width int, ids binary, nulls binary, rows binary, vectors binary, postings binary"
INDEX_COLUMNS = [x.split()[0] for x in INDEX.split(", ")]
HITS = "query_row long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(row, vec_id, vector array<long>) of the vectors without null or non-finite components: floor(scale * x) of each component x as a double. A written table; row is unique."""
    good = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    whole = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform(embedding, x -> floor({scale}D * cast(x AS double)))").alias("vector"))
    return written(whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector"), "vectors")


def _blocks(most: int, index: bool):
    """A function for mapInArrow: rows of quantised() to blocks of at most ``most`` of them, with impact-ordered postings if index is set.

    The postings of a dimension list the block's vectors by value; LEVELS segments of equal length follow one another,
    and a segment's least and greatest values are its quantised impact. A missing trailing component is 0; nulls marks null ids. Vectors are kept in
    integers of as many bytes (width) as their largest component needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            nonlocal number
            dims = max((len(v) for _, _, v in held), default=0)
            x = np.zeros((len(held), dims), np.int64)
            for i, (_, _, v) in enumerate(held):
                x[i, : len(v)] = v
            ids, nulls = np.array([i or 0 for _, i, _ in held], np.int64), np.array([i is None for _, i, _ in held])
            most_value = max(int(x.max(initial=0)), -1 - int(x.min(initial=0)))
            width = 2 if most_value < 1 << 15 else 4 if most_value < 1 << 31 else 8
            posts = np.argsort(x.T, axis=1, kind="stable").astype(np.uint16).tobytes() if index else b""
            number += 1
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number - 1], pa.int64()), "dims": pa.array([dims], pa.int32()), "width": pa.array([width], pa.int32()),
                    "ids": [ids.tobytes()], "nulls": [nulls.tobytes()], "rows": [np.array([r for r, _, _ in held], np.int64).tobytes()],
                    "vectors": [x.astype(f"i{width}").tobytes()], "postings": [posts]
                }
            )

        for batch in batches:
            for r in zip(batch.column("row").to_pylist(), batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist()):
                held.append(r)
                if len(held) == most:
                    yield block()
                    held = []
        if held:
            yield block()

    return run


class _Segments:
    """A block of the index, opened: per dimension and level the postings and the values they lie between."""

    def __init__(self, x: np.ndarray, postings: np.ndarray) -> None:
        n, dims = x.shape
        self.x, self.n, self.dims = x, n, dims
        ends = np.linspace(0, n, min(LEVELS, n) + 1).astype(int)
        self.levels = len(ends) - 1
        values = np.take_along_axis(x.T, postings.astype(np.int64), axis=1)
        self.least, self.most = values[:, ends[:-1]], values[:, ends[1:] - 1]
        self.lists = [postings[d, a:b] for d in range(dims) for a, b in zip(ends, ends[1:])]
        self.sizes = np.tile(np.diff(ends), dims)
        self.large = n and dims and max(int(x.max()), -int(x.min())) >= EXACT

    def top(self, q: np.ndarray, k: int, own: int) -> np.ndarray:
        """Places of at least the k vectors of highest score, ties included, without place own.

        With the least upper bound of each dimension as a base, a segment's impact is what its vectors may have above it.
        Segments are read by descending impact into accumulators. What a vector's unread segments can add is at most
        the sum of each dimension's next impact. Vectors that could still reach the k-th best score known are possible members; reading
        ends once they are few, or all segments are read.
        """
        everyone = np.delete(np.arange(self.n), own) if own >= 0 else np.arange(self.n)
        if len(everyone) <= k or not self.dims or self.large or max(int(q.max()), -int(q.min())) >= EXACT:
            return everyone
        upper = np.maximum(q[:, None] * self.least, q[:, None] * self.most).astype(float)
        base, impact = upper.min(axis=1).sum(), (upper - upper.min(axis=1, keepdims=True)).ravel()
        order = np.argsort(-impact, kind="stable")
        order = order[: np.count_nonzero(impact)]
        dims, got = order // self.levels, np.zeros(self.n)
        if own >= 0:
            got[own] = -np.inf
        known = -np.inf
        for at in range(0, len(order), ROUND):
            part = order[at : at + ROUND]
            got += np.bincount(np.concatenate([self.lists[s] for s in part]), np.repeat(impact[part], self.sizes[part]), self.n)
            next_impact = np.zeros(self.dims)
            left = order[at + ROUND :]
            d, first = np.unique(dims[at + ROUND :], return_index=True)
            next_impact[d] = impact[left[first]]
            lead = np.argpartition(-got, k - 1)[:k] if self.n > k else everyone
            known = max(known, int((self.x[lead] @ q).min()) if own < 0 or own not in lead else -np.inf)
            members = base + got + next_impact.sum() >= known
            if np.count_nonzero(members) <= 8 * k:
                break
        else:
            if not len(order):
                return everyone
        return np.flatnonzero(members)


def top_k(vectors: DataFrame, queries: str = "vec_id % 100 = 0", k: int = 10, scale: int = 1024, block: int = 4096, most_parts: int = 4096) -> DataFrame:
    """The k rows of highest integer inner product with each query, exactly; ties to the smaller vec_id.

    vectors: vec_id, embedding; other columns are left alone. Components become floor(scale * x). Vectors that are null,
    or have null or non-finite components, take no part. Queries are the rows that the SQL condition selects; a row is no candidate of its own, but
    repeated rows are candidates of one another. A vector's missing trailing components count as 0; a null vec_id comes last among ties. Scores are 64-bit and wrap
    beyond. Returns query_id, rank, vec_id, score: fewer than k rows a query if there are fewer candidates; none for an empty table.

    The index is a table of blocks. Each block of queries meets each block of the index once, by an equi-join on the index's block number
    for which the query blocks are repeated; a pair of blocks yields at most k hits a query (at ties and at the last rank by vec_id).
    """
    small_batches(vectors.sparkSession)
    rows = quantised(vectors, scale)
    index = written(rows.mapInArrow(_blocks(min(block, 65536), True), INDEX), "index")
    asked = written(rows.where(queries).mapInArrow(_blocks(256, False), INDEX).drop("postings"), "queries")
    parts = max(1, min(most_parts, index.count()))
    part = F.pmod(F.shiftright("block", 32) + 7919 * F.col("block").bitwiseAND((1 << 32) - 1), F.lit(parts))
    index = index.select(part.alias("part"), *INDEX_COLUMNS[1:])
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), *(F.col(c).alias(f"q_{c}") for c in INDEX_COLUMNS[1:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple = (None, None)
        for whole in batches:
            for r in (whole.slice(i, 1).to_pylist()[0] for i in range(whole.num_rows)):
                numbers = {c: np.frombuffer(r[c], np.int64) for c in ("ids", "rows", "q_ids", "q_rows")}
                n, m, dims, q_dims = len(numbers["ids"]), len(numbers["q_ids"]), r["dims"], r["q_dims"]
                if opened[0] != r["rows"][:8]:  # rows are unique, so the first one names the block
                    x = np.frombuffer(r["vectors"], f"i{r['width']}").astype(np.int64).reshape(n, dims)
                    opened = (r["rows"][:8], _Segments(x, np.frombuffer(r["postings"], np.uint16).reshape(dims, n)))
                segments, places = opened[1], {row: i for i, row in enumerate(numbers["rows"].tolist())}
                asks = np.zeros((m, max(dims, q_dims)), np.int64)
                asks[:, :q_dims] = np.frombuffer(r["q_vectors"], f"i{r['q_width']}").reshape(m, q_dims)
                hits = []
                nulls, q_nulls = (np.frombuffer(r[c], bool) for c in ("nulls", "q_nulls"))
                for row, query_id, no_id, q in zip(numbers["q_rows"].tolist(), numbers["q_ids"].tolist(), q_nulls.tolist(), asks[:, :dims]):
                    at = segments.top(q, k, places.get(row, -1))
                    scores = segments.x[at] @ q
                    best = at[np.lexsort((numbers["rows"][at], numbers["ids"][at], nulls[at], -scores))[:k]]
                    hits += [
                        (row, None if no_id else query_id, None if none else i, s) for i, none,
                        s in zip(numbers["ids"][best].tolist(), nulls[best].tolist(), (segments.x[best] @ q).tolist())
                    ]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*hits) if hits else ((),) * 4)], ["query_row", "query_id", "vec_id", "score"])

    hits = index.join(asked, "part").drop("part").mapInArrow(run, HITS)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every hundredth vector, against all rows."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
