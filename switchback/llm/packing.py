"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import coder, tokenizer_file
from .shared import small_batches

PIECES = "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, sequence_cost double"


def assign(lengths: list[int], most: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int]], list[int], list[float]]:
    """Put documents of these token counts into sequences without padding.

    Returns the pieces (document, start, length, sequence), in their order within a sequence, and each sequence's
    length and cost. As many sequences as can be are of ``most`` tokens; the rest of the tokens goes to sequences of
    distinct powers of two. A piece costs linear * length + quadratic * length ** 2, as attention stays within it. What is
    longer than ``most`` is cut. Pieces go, by descending cost, to the sequence of lowest cost that has room for them;
    where none has, the one with most room is filled and what is left is a piece again. Ties go to the earlier one.
    """
    total = sum(lengths)
    sizes = [most] * (total // most) + [1 << b for b in reversed(range(most.bit_length())) if total % most >> b & 1]
    room, cost = np.array(sizes, np.int64), np.zeros(len(sizes))
    heap = [(-min(most, n - s), d, s) for d, n in enumerate(lengths) for s in range(0, n, most)]
    heapq.heapify(heap)
    pieces = []
    while heap:
        n, d, s = heapq.heappop(heap)
        n = -n
        fits = room >= n
        to = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
        put = min(n, int(room[to]))
        pieces.append((d, s, put, to))
        room[to] -= put
        cost[to] += linear * put + quadratic * put * put
        if put < n:
            heapq.heappush(heap, (put - n, d, s + put))
    return pieces, sizes, cost.tolist()


def pack(docs: DataFrame, tokenizer: str, most: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 1024, group_tokens: int = 1 << 19) -> DataFrame:
    """Pack the tokens of every whole text into sequences of at most ``most`` tokens (a power of two).

    docs: doc_id, text; other columns are left alone. A document is the ids of its text, then end_id; a null or empty text is end_id alone, and a
    repeated row is a document of its own. Returns a row for each piece of a document: doc_id (null where the row has none), start and length
    within the document, its ids, their CRC-32 as little-endian unsigned 32-bit numbers, the document's tokens, and the
    sequence, the offset in it, and the sequence's length and estimated cost. An empty table gives no rows.

    Nothing is shuffled: each task encodes its rows and packs them in groups of about group_tokens tokens, which bounds
    its memory; a group's sequences are balanced against one another, and none has padding, as the last few are of a power of
    two. A sequence_id holds the number of the task and of the sequence in it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    model = tokenizer_file(docs.sparkSession, tokenizer)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, number = coder(model), TaskContext.get().partitionId() << 40
        group: list[tuple[int | None, bytes]] = []
        held = 0
        names = [x.split()[0] for x in PIECES.split(", ")]

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            pieces, sizes, costs = assign([len(b) // 4 for _, b in group], most, linear, quadratic)
            filled, rows = [0] * len(sizes), []
            for d, s, n, to in pieces:
                doc_id, ids = group[d]
                piece = memoryview(ids)[4 * s : 4 * (s + n)]
                rows.append((doc_id, s, n, np.frombuffer(piece, "<i4"), zlib.crc32(piece), len(ids) // 4, number + to, filled[to], sizes[to], costs[to]))
                filled[to] += n
            number += len(sizes)
            for k in range(0, len(rows), 1000):
                columns = dict(zip(names, zip(*rows[k : k + 1000])))
                ends = np.cumsum([0, *columns["length"]], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(columns["ids"])))
                yield pa.RecordBatch.from_arrays([ids if x == "ids" else pa.array(v, pa.float64() if x == "sequence_cost" else pa.int64()) for x, v in columns.items()], names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = c.whole(text.as_py() or "") + end
                group.append((doc_id.as_py(), ids))
                held += len(ids) // 4
                if held >= group_tokens:
                    yield from packed()
                    group, held = [], 0
        if group:
            yield from packed()

    return docs.mapInArrow(run, PIECES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens, the ids as their digest."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
