"""Repeated passages removed by prefix-free parsing: texts cut into phrases at hash triggers, a dictionary of phrases, and the order of its suffixes.

A phrase holds all strings of WIDTH bytes whose trigger (the least hash of SEED bytes in the string, the first among equals) is at one place, so that
phrases overlap by WIDTH - 1 bytes and equal strings have equal triggers. Each string of WIDTH bytes starts in one phrase alone, and its place in the order of the
corpus depends on that phrase's suffix, which is long enough; of the parse, the order needs no more than which documents hold a phrase first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, written
from .textnp import U64, mixed, text_blocks

WIDTH, SEED = 50, 16
#: Starts of strings that are worked on at a time; bytes of a pack of documents, if it has more than one; bytes of text for a bucket.
BLOCK, PACK, BUCKET = 1 << 17, 1 << 23, 1 << 24
#: Packs that are searched for hot triggers, and the share of a pack's documents that makes a trigger hot (and no fewer than eight).
PROBES, HOT = 8, 0.01
LOW = U64((1 << 32) - 1)
PACKS = "pack long, size long, ids binary, known binary, ends binary, texts binary"


def _words(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each place on as one number, a view; places near the end see zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()
    return np.ndarray(len(data), f"{order}u8", padded, 0, (1,))


def _spelt(words: np.ndarray, start: np.ndarray | None, size: np.ndarray | int) -> np.ndarray:
    """A hash of strings of WIDTH to 2 * WIDTH - 2 bytes, nonlinear in steps of eight bytes. words: those of the text, or without start the strings themselves, WIDTH bytes a row."""
    word = (lambda at: words[start + at]) if start is not None else lambda at: np.ascontiguousarray(words[:, at : at + 8]).view("<u8")[:, 0]
    h = np.zeros(len(words) if start is None else len(start), U64) + np.asarray(size).astype(U64)
    with np.errstate(over="ignore"):
        for k, at in enumerate((0, 8, 16, 24, 32, 40, WIDTH - 8)):
            h = mixed(h * U64(0x2545F4914F6CDD1D) ^ word(at), k + 1)
        if start is not None:
            for k, back in enumerate((8, 16, 24, 32, 40, 48)):
                h = mixed(h * U64(0x2545F4914F6CDD1D) ^ words[start + size - back], k + 9)
    return h


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes, those of equal weight together, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in arrays), 1)


def _unzip(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    flat, out, at = np.frombuffer(zstandard.decompress(data), np.uint8), [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(flat[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of size[0] numbers, and so on."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _new(*sorted_keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(sorted_keys[0]), bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return out


class Pack:
    """Some documents and their phrases: where each starts (start), how many strings start in it (count), its document (doc), trigger and spelling."""

    def __init__(self, row: dict) -> None:
        self.number = row["pack"]
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.data = np.frombuffer(zstandard.decompress(row["texts"]), np.uint8)
        found = [self._block(at) for at in range(0, max(len(self.data) - WIDTH + 1, 0), BLOCK)]
        kinds = (np.int64, np.int64, np.int64, U64, U64)
        self.start, self.count, self.doc, self.trigger, self.spelling = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, k) for i, k in enumerate(kinds))

    def _block(self, at: int) -> tuple:
        data = self.data[at : at + BLOCK + WIDTH - 1]
        words, n = _words(data).astype(U64), len(data) - SEED + 1
        with np.errstate(over="ignore"):
            each = mixed(words)
            seeds = mixed(each[:n] * U64(0x9E3779B97F4A7C15) + each[SEED - 8 : n + SEED - 8] * U64(0xC2B2AE3D27D4EB4F))
        least, wide, whole = (seeds & ~LOW) | np.arange(n, dtype=U64), 1, WIDTH - SEED + 1
        while 2 * wide <= whole:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        if wide < whole:
            least = np.minimum(least[: len(least) - (whole - wide)], least[whole - wide :])
        place = (least & LOW).astype(np.int64)
        start = np.arange(len(place))
        doc = np.searchsorted(self.ends, start + at, "right")
        inside = (start + at + WIDTH <= self.ends[doc]) & self.known[doc]
        start, place, doc = start[inside], place[inside], doc[inside]
        first = np.flatnonzero(_new(place, doc)) if len(start) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(start)))
        start, doc, trigger = start[first], doc[first], seeds[place[first]] >> U64(16)
        return start + at, count, doc, trigger, _spelt(words, start, count + WIDTH - 1) if len(start) else np.zeros(0, U64)

    def index(self, buckets: int, hot: np.ndarray) -> None:
        """The pack's different phrases by bucket: of, the phrase of each occurrence; least, its smallest document id here."""
        loose = np.isin(self.trigger, hot)
        bucket = (np.where(loose, self.spelling, mixed(self.trigger)) % U64(buckets)).astype(np.int64)
        order = np.lexsort((self.spelling, self.trigger, bucket))
        new = _new(self.spelling[order], self.trigger[order], bucket[order]) if len(order) else np.zeros(0, bool)
        self.of = np.zeros(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        firsts = np.flatnonzero(new)
        self.sample = order[firsts]  # an occurrence of each
        self.bucket, self.loose = bucket[self.sample], loose[self.sample]
        self.least = np.minimum.reduceat(self.ids[self.doc[order]], firsts) if len(firsts) else np.zeros(0, np.int64)

    def by_bucket(self) -> Iterator[tuple[int, slice]]:
        edges = np.flatnonzero(_new(self.bucket)) if len(self.bucket) else []
        for a, b in zip(edges, [*edges[1:], len(self.bucket)]):
            yield int(self.bucket[a]), slice(a, b)

    def answered(self, bits: list[bytes], sizes: list[int]) -> None:
        """What the dictionary says of each different phrase: whether an earlier document than any here has it, and whether others of its trigger may share strings with it."""
        both = [np.unpackbits(np.frombuffer(x, np.uint8)).reshape(2, -1)[:, :n] for x, n in zip(bits, sizes)]
        self.earlier, self.shared = (np.concatenate([b[i] for b in both]).astype(bool) if both else np.zeros(0, bool) for i in range(2))

    def asked(self, buckets: int) -> tuple[np.ndarray, ...]:
        """(start, count, document id, bucket) of the strings to be looked up, in order of buckets: phrases that may share strings with others and have no earlier document, whole; those of a
        hot trigger string by string, equal ones once. string_of is the number of each string of phrase j, from strings_at[j] on, in that order; here says that an earlier document of
        this pack has it."""
        j = np.flatnonzero(self.shared & ~self.earlier)
        start, count, loose = self.start[self.sample[j]], self.count[self.sample[j]], self.loose[j]
        bucket = (mixed(self.trigger[self.sample[j]], 7) % U64(buckets)).astype(np.int64)
        owner = np.repeat(np.flatnonzero(loose), count[loose])
        single = _ranges(start[loose], count[loose])
        name = _spelt(self.data[single[:, None] + np.arange(WIDTH)], None, WIDTH)
        order = np.lexsort((self.least[j][owner], name))
        fresh = _new(name[order]) if len(order) else np.zeros(0, bool)
        pick = order[fresh]
        unit_start, unit_count = np.concatenate([start[~loose], single[pick]]), np.concatenate([count[~loose], np.ones(len(pick), np.int64)])
        unit_id = np.concatenate([self.least[j][~loose], self.least[j][owner[pick]]])
        unit_bucket = np.concatenate([bucket[~loose], (name[pick] % U64(buckets)).astype(np.int64)])
        sort = np.argsort(unit_bucket, kind="stable")
        at = np.zeros(len(sort), np.int64)
        at[sort] = np.cumsum(unit_count[sort]) - unit_count[sort]
        self.strings_at = np.zeros(len(self.least), np.int64)
        self.strings_at[j] = np.cumsum(count) - count
        self.string_of = np.zeros(int(count.sum()), np.int64)
        whole = j[~loose]
        self.string_of[_ranges(self.strings_at[whole], count[~loose])] = _ranges(at[: len(whole)], count[~loose])
        same = np.zeros(len(name), np.int64)
        same[order] = np.cumsum(fresh) - 1
        there = _ranges(self.strings_at[j[loose]], count[loose])
        self.string_of[there] = at[len(whole) :][same]
        self.here = np.zeros(len(self.string_of), bool)
        self.here[there] = self.least[j][owner] > self.least[j][owner[pick]][same]
        return unit_start[sort], unit_count[sort], unit_id[sort], unit_bucket[sort]

    def removed(self, repeated: np.ndarray) -> np.ndarray:
        """Of each byte, whether a string that an earlier document has covers it; ``repeated`` says so of the strings that were asked()."""
        earlier = self.earlier[self.of] | (self.ids[self.doc] > self.least[self.of])
        steps = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(steps, self.start[earlier], 1)
        np.add.at(steps, (self.start + self.count + WIDTH - 1)[earlier], -1)
        ask = ~earlier & self.shared[self.of]
        start, string = _ranges(self.start[ask], self.count[ask]), _ranges(self.strings_at[self.of[ask]], self.count[ask])
        start = start[repeated[self.string_of[string]] | self.here[string]]
        np.add.at(steps, start, 1)
        np.add.at(steps, start + WIDTH, -1)
        return np.cumsum(steps, dtype=np.int32)[:-1] > 0

    @cached_property
    def begins(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text to packs."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def pack() -> pa.RecordBatch:
        nonlocal number
        number += 1
        ids, known, sizes, texts = (np.concatenate([h[i] for h in held]) for i in range(4))
        row = {
            "pack": number - 1, "size": len(texts), "ids": ids.tobytes(), "known": known.tobytes(), "ends": np.cumsum(sizes).tobytes(),
            "texts": zstandard.compress(texts.tobytes(), 3)
        }
        return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()})

    for batch in batches:
        ids = batch.column("doc_id")
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        for i, j, data, offsets in text_blocks(batch.column("text"), PACK):
            if held and size + len(data) > PACK:
                yield pack()
                held, size = [], 0
            held.append((values[i:j], known[i:j], np.diff(offsets), data))
            size += len(data)
    if held:
        yield pack()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, as a pack's texts are large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _dictionary(hot: np.ndarray):
    """For applyInArrow: the phrases of a bucket from all packs, to what each pack must know of its own."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        found = [_unzip(d.as_py(), n, "<u8", "<u8", "<i8") for n, d in zip(sizes, table.column("data"))]
        trigger, spelling, first = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.lexsort((spelling, trigger))
        new = _new(spelling[order], trigger[order])
        starts = np.flatnonzero(new)
        least = np.minimum.reduceat(first[order], starts)
        same = np.flatnonzero(_new(trigger[order][starts]))
        size = np.diff(np.append(same, len(starts)))
        several = np.repeat(np.minimum.reduceat(least, same) < np.maximum.reduceat(least, same), size) | np.isin(trigger[order][starts], hot)
        of = np.zeros(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        both, at = np.stack([least[of] < first, several[of]]), np.cumsum([0, *sizes])
        bits = [np.packbits(np.pad(both[:, a:b], ((0, 0), (0, -(b - a) % 8)))).tobytes() for a, b in zip(at, at[1:])]
        return pa.table({"pack": table.column("pack"), "bucket": table.column("bucket"), "n": table.column("n"), "bits": pa.array(bits, pa.binary())})

    return run


def suffix_order(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the strings of WIDTH bytes from each start on in the order of their bytes, and where it comes to another string."""
    words = _words(data, ">")
    keys = [words[start + at].astype(U64) for at in (WIDTH - 8, 40, 32, 24, 16, 8, 0)]
    order = np.lexsort(keys)
    return order, _new(*(k[order] for k in keys))


def _suffixes(table: pa.Table) -> pa.Table:
    """For applyInArrow: the suffixes of a bucket's phrases in order, to whether an earlier document than the phrase's own has each string."""
    sizes, texts = table.column("n").to_pylist(), []
    starts, ids, counts, at = [], [], [], 0
    for n, d, t in zip(sizes, table.column("data"), table.column("texts")):
        count, first = _unzip(d.as_py(), n, "<i4", "<i8")
        texts.append(np.frombuffer(zstandard.decompress(t.as_py()), np.uint8))
        long = count.astype(np.int64) + WIDTH - 1
        starts.append(_ranges(at + np.cumsum(long) - long, count.astype(np.int64)))
        ids.append(np.repeat(first, count))
        counts.append(int(count.sum()))
        at += len(texts[-1])
    start, first = np.concatenate(starts), np.concatenate(ids)
    order, new = suffix_order(np.concatenate(texts), start)
    least = np.minimum.reduceat(first[order], np.flatnonzero(new))
    repeated = np.zeros(len(order), bool)
    repeated[order] = least[np.cumsum(new) - 1] < first[order]
    at = np.cumsum([0, *counts])
    bits = [np.packbits(repeated[a:b]).tobytes() for a, b in zip(at, at[1:])]
    return pa.table({"pack": table.column("pack"), "bucket": table.column("bucket"), "n": pa.array(counts, pa.int32()), "bits": pa.array(bits, pa.binary())})


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept binary, spans array<struct<start, length>>: each document without the bytes that a string of 50 bytes covers which also starts in a document with a smaller id.

    docs: doc_id, text; other columns are left alone. Texts count as UTF-8, null as empty; strings do not cross documents, and are judged on the input. Rows with equal ids have no
    smaller one among them; a row with a null id is kept whole and removes nothing. Texts under 50 bytes are kept whole. Spans are the maximal runs removed. An empty table
    gives no rows.

    Documents are packed (8 MB, or one longer document) and written once. A pack sends each of its different phrases once, with its first document here, to a bucket of its trigger, which
    answers in two bits a phrase; phrases that may share strings with others of their trigger then go, by bytes, to the buckets that sort their suffixes. Phrases of
    hot triggers (found in a few packs; which ones they are changes where work is done, never results) are dealt by their spelling and asked string by string.
    """
    spark = docs.sparkSession
    small_batches(spark)
    packs = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packed, PACKS), "packs")
    n_packs, total = packs.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(spark.sparkContext.defaultParallelism, -(-total // BUCKET))

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            pack = Pack(row)
            pair = np.unique(np.stack([pack.trigger, pack.doc.astype(U64)]), axis=1)[0] if len(pack.doc) else np.zeros(0, U64)
            trigger, docs_with = np.unique(pair, return_counts=True)
            yield pa.RecordBatch.from_pydict({"trigger": trigger[docs_with >= max(8, HOT * len(pack.ids))].astype(np.int64)})

    probes = packs.where(F.col("pack").isin([r.pack for r in packs.select("pack").sample(min(1.0, 2 * PROBES / max(n_packs, 1)), 1).limit(PROBES).collect()]))
    hot = np.array(sorted(r.trigger for r in probes.mapInArrow(heavy, "trigger long").distinct().collect()), U64)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            pack = Pack(row)
            pack.index(buckets, hot)
            for bucket, part in pack.by_bucket():
                at = pack.sample[part]
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([bucket], pa.int32()), "pack": [pack.number], "n": pa.array([len(at)], pa.int32()),
                        "data": [_zip(pack.trigger[at], pack.spelling[at], pack.least[part])]
                    }
                )

    answer = "pack long, bucket int, n int, bits binary"
    entries = packs.mapInArrow(phrases, "bucket int, pack long, n int, data binary")
    known = written(entries.groupBy("bucket").applyInArrow(_dictionary(hot), answer), "phrases")
    gathered = lambda found, name: found.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "bits"))).alias(name))

    def opened(row: dict) -> Pack:
        pack = Pack(row)
        pack.index(buckets, hot)
        said = row["known_phrases"] or []
        pack.answered([x["bits"] for x in said], [x["n"] for x in said])
        return pack

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            pack = opened(row)
            start, count, first, bucket = pack.asked(4 * buckets)
            edges = np.flatnonzero(_new(bucket)) if len(bucket) else []
            for a, b in zip(edges, [*edges[1:], len(bucket)]):
                texts = pack.data[_ranges(start[a:b], count[a:b] + WIDTH - 1)].tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([int(bucket[a])], pa.int32()), "pack": [pack.number], "n": pa.array([b - a], pa.int32()),
                        "data": [_zip(count[a:b].astype(np.int32), first[a:b])], "texts": [zstandard.compress(texts, 1)]
                    }
                )

    judged = packs.join(gathered(known, "known_phrases"), "pack", "left")
    asked = judged.mapInArrow(strings, "bucket int, pack long, n int, data binary, texts binary")
    repeated = written(asked.groupBy("bucket").applyInArrow(_suffixes, answer), "strings")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            pack = opened(row)
            pack.asked(4 * buckets)
            flags = [np.unpackbits(np.frombuffer(x["bits"], np.uint8))[: x["n"]].astype(bool) for x in row["known_strings"] or []]
            gone = pack.removed(np.concatenate(flags) if flags else np.zeros(0, bool))
            for a in range(0, len(pack.ids), 500):
                part = range(a, min(a + 500, len(pack.ids)))
                spans = []
                for d in part:
                    mine = np.flatnonzero(np.diff(np.concatenate([[0], gone[pack.begins[d] : pack.ends[d]].view(np.int8), [0]])))
                    spans.append([{"start": int(x), "length": int(y - x)} for x, y in zip(mine[::2], mine[1::2])])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(pack.ids[d]) if pack.known[d] else None for d in part], pa.int64()),
                        pa.array([int(pack.ends[d] - pack.begins[d]) for d in part], pa.int64()),
                        pa.array([pack.data[pack.begins[d] : pack.ends[d]][~gone[pack.begins[d] : pack.ends[d]]].tobytes() for d in part], pa.binary()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                    ],
                    ["doc_id", "n_bytes", "kept", "spans"],
                )

    return judged.join(gathered(repeated, "known_strings"), "pack", "left").mapInArrow(
        cut, "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, length: long>>"
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that earlier ones hold."""
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.col("n_bytes") - F.length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM h WHERE doc_id IS NOT NULL)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
g AS (SELECT DISTINCT w.doc_id, w.p FROM w JOIN f ON f.s = w.s AND f.first < w.doc_id),
r AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM g)),
u AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS at FROM u),
t AS (SELECT k.doc_id, string_agg(substr(h.h, 2 * k.at + 1, 2 * (k.a - k.at)), '' ORDER BY k.a) AS kept, max(k.b) AS last, sum(k.b - k.a) AS gone, count(*) AS spans FROM k JOIN h ON h.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT h.doc_id, (len(h.h) // 2)::BIGINT AS n_bytes, coalesce(t.gone, 0)::BIGINT AS n_removed, coalesce(t.spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN t.doc_id IS NULL THEN h.h ELSE t.kept || substr(h.h, 2 * t.last + 1) END)) AS kept_sha256
FROM h LEFT JOIN t ON t.doc_id = h.doc_id"""
