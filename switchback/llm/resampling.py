"""A quality classifier by importance resampling: hashed n-gram models of target and raw text, a Gumbel top-k sample, and what no sample may hold."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, written
from .textnp import PUNCTUATED, cut_words, mixed, text_blocks

BITS = 14
BINS = 4096
#: Toxic words are rare, so they get buckets of their own: 2 ** FINE of them, of which those of BITS are the upper bits.
FINE = 20
#: Parts of the labels, each scored by a model of the others to find the cutoff.
FOLDS = 3
#: A bucket is evidence where the lower bound, WIDE standard errors down, of the log of its toxic over its clean share of documents is above LEAST.
WIDE, LEAST = 1.5, 1.5
#: More labelled documents than this are found by bits first, some 16 a document, at most 64 * WORDS; as many or fewer are broadcast.
MANY, WORDS = 4096, 1 << 20
#: Buckets whose counts go through the shuffle in one row.
BLOCK = 4096


def _features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every token and of every pair of neighbouring tokens of some texts."""
    words = cut_words(data, offsets, PUNCTUATED, lower=False)
    one = words.hashes()
    of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    with np.errstate(over="ignore"):
        two = mixed(one[:-1] * np.uint64(3) + one[1:], 7)[of[:-1] == of[1:]]
    shift = np.uint64(64 - bits)
    return np.concatenate([one >> shift, two >> shift]).astype(np.int64), np.concatenate([of, of[:-1][of[:-1] == of[1:]]])


def count_features(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, raw, target): how often each of the 2 ** BITS buckets occurs in the texts of docs, and in those of target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column("text")):
                sums += np.bincount(_features(data, offsets)[0], minlength=1 << BITS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    found = [df.select("text").mapInArrow(run, "bucket long, n long").withColumn("raw", F.lit(raw)) for df, raw in ((docs, True), (target, False))]
    sums = [F.sum(F.when(F.col("raw") == raw, F.col("n")).otherwise(0)).alias(name) for raw, name in ((True, "raw"), (False, "target"))]
    return found[0].unionByName(found[1]).groupBy("bucket").agg(*sums)


def log_ratios(counted: DataFrame) -> np.ndarray:
    """The log of target chance over raw chance of each bucket, with one added to each count. The number of buckets bounds what reaches the driver."""
    sums = np.ones((2, 1 << BITS))
    for r in counted.collect():
        sums[:, r.bucket] += r.raw, r.target
    return np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, fold) of all rows of docs that are labelled clean (toxic 0) or toxic (1), as a written table.

    Beyond MANY labels, texts are dealt by doc_id; those without a label mostly stay where they are, as a bit for each hash of a label's doc_id tells.
    """
    toxic = labels.where("doc_id IS NOT NULL AND toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    kinds = [d.select("doc_id", F.lit(i).alias("toxic")) for i, d in enumerate((_clean(labels), toxic))]
    marked = written(kinds[0].union(kinds[1]).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")), "marked")
    texts, n = docs.select("doc_id", "text"), marked.count()
    if n <= MANY:
        return written(texts.join(F.broadcast(marked), "doc_id"), "labelled")
    size = min(WORDS, 1 << (n // 4).bit_length())
    place = F.pmod(F.xxhash64(F.lit("bit"), "doc_id"), F.lit(64 * size))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = marked.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(bit(place)).alias("bits"))
    words = words.unionByName(docs.sparkSession.range(size).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bits = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w.bits).alias("bits"))
    word = F.get("bits", F.shiftright(place, 6).cast("int"))
    texts = texts.crossJoin(F.broadcast(written(bits, "bits"))).where(word.bitwiseAND(bit(place)) != 0).drop("bits")
    return written(texts.join(marked.hint("shuffle_hash"), "doc_id"), "labelled")  # texts are not sorted


def _packed(counts: np.ndarray) -> bytes:
    """Mostly small counts, of 2 * FOLDS groups, compressed with their low bytes apart from the high ones."""
    return zlib.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(counts: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(counts), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(2 * FOLDS, -1)


def toxic_evidence(labelled: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, bounds) of a model without each fold, and of their mean: the buckets of evidence and their lower bounds. Only those reach the driver.

    The mean serves rows that no model has seen: its scores lie as those of one model on the fold that it has not seen, by which cutoffs are set; a model of all
    folds would have more buckets, and higher scores.

    labelled: text, toxic (0 or 1), fold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2 * FOLDS, (1 << FINE) + 1), np.int32)  # the last counts documents
        for batch in batches:
            group = batch.column("toxic").to_numpy() * FOLDS + batch.column("fold").to_numpy()
            for i, j, data, offsets in text_blocks(batch.column("text")):
                bucket, of = _features(data, offsets, FINE)
                held = np.unique(of.astype(np.int64) << FINE | bucket)
                np.add.at(sums, (group[i:j][held >> FINE], held & (1 << FINE) - 1), 1)
                np.add.at(sums, (group[i:j], 1 << FINE), 1)
        for block, part in enumerate(np.split(sums, range(BLOCK, 1 << FINE | 1, BLOCK), axis=1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_packed(part)])], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                part = _unpacked(counts)
                sums[block] = sums[block] + part if block in sums else part.astype(np.int64)
        for block, part in sums.items():
            at = np.flatnonzero(part.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(at + block * BLOCK), *(pa.array(n[at]) for n in part)], ["bucket", *names])

    # a task holds most buckets of even a small share of the texts, so counts by bucket as rows of their own would be more than the texts
    names = [f"g{g}" for g in range(2 * FOLDS)]
    found = labelled.select("text", "toxic", "fold").mapInArrow(run, "block long, counts binary").repartition("block")
    counted = written(found.mapInArrow(add, ", ".join(["bucket long", *(f"{n} long" for n in names)])), "evidence")
    of = counted.where(F.col("bucket") == 1 << FINE).first()
    models = []
    for out in range(FOLDS):
        rate, error = [], []
        for kind in (1, 0):
            groups = [f"g{kind * FOLDS + f}" for f in range(FOLDS) if f != out]
            n = sum((F.col(g) for g in groups), F.lit(0.5))
            rate.append(F.log(n / float(1 + sum(of[g] if of else 0 for g in groups))))
            error.append(1 / n)
        bound = rate[0] - rate[1] - WIDE * F.sqrt(error[0] + error[1])
        rows = counted.where(F.col("bucket") < 1 << FINE).select("bucket", bound.alias("bound")).where(F.col("bound") > LEAST).collect()
        models.append((np.array([r.bucket for r in rows], np.int64), np.array([r.bound for r in rows], np.float32)))
    at, of = np.unique(np.concatenate([m[0] for m in models]), return_inverse=True)
    return [*models, (at, (np.bincount(of, np.concatenate([m[1] for m in models]), len(at)) / FOLDS).astype(np.float32))]


def scores(text: Column, ratios: np.ndarray, evidence: list[tuple[np.ndarray, np.ndarray]], fold: Column | None = None) -> Column:
    """Of a whole text: log_weight, the sum of its features' log ratios; mean, that sum over their number; toxic, the sum of the bounds of its distinct buckets
    of evidence over the root of their number, by the model without fold, or the mean of all. All 0 for a null text or one without tokens."""

    table: list[np.ndarray] = []  # filled once a process

    @F.arrow_udf("log_weight double, mean double, toxic double")
    def weigh(column: pa.Array, folds: pa.Array) -> pa.Array:
        if not table:
            bounds = np.zeros((len(evidence), 1 << FINE), np.float32)
            for model, (at, bound) in zip(bounds, evidence):
                model[at] = bound
            table.append(bounds)
        bounds = table[0]
        model_of, parts = folds.to_numpy(zero_copy_only=False), [np.zeros((3, 0))]
        for i, j, data, offsets in text_blocks(column):
            fine, of = _features(data, offsets, FINE)
            n = np.maximum(1, np.bincount(of, minlength=j - i))
            weight = np.bincount(of, ratios[fine >> FINE - BITS], j - i)
            bound = bounds[model_of[i:j][of], fine]
            hit = np.flatnonzero(bound)
            hit = hit[np.unique(of[hit].astype(np.int64) << FINE | fine[hit], return_index=True)[1]]
            parts.append(np.stack([weight, weight / n, np.bincount(of[hit], bound[hit], j - i) / np.sqrt(n)]))
        return pa.StructArray.from_arrays([pa.array(x) for x in np.round(np.concatenate(parts, 1), 9)], ["log_weight", "mean", "toxic"])

    return weigh(text.cast("string"), F.lit(len(evidence) - 1) if fold is None else fold)


def gumbel_key(weight: Column, doc_id: Column, seed: int) -> Column:
    """weight plus Gumbel noise that depends on doc_id and seed only, so that a task run again gives the same sample."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) + 0.5) / float(1 << 53)
    return weight - F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest value of keys.key (double, not null), exactly; None if there are fewer than k.

    Each round counts the rows in BINS bins of equal width between the bounds known, and goes on in the bin that holds the
    k-th value, until that bin holds one value only. At most BINS counts reach the driver in a round.
    """
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if n < k or k < 1:
        return None
    while low < high:
        width = (high - low) / BINS
        inside = keys.where(F.col("key").between(low, high))
        place = F.least(F.lit(BINS - 1), F.floor((F.col("key") - low) / width)) if width > 0 else F.lit(0)
        bins = sorted(inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect(), key=lambda r: -r.high)
        for r in bins:
            if r.n >= k:
                break
            k -= r.n
        if len(bins) == 1 and (r.low, r.high) == (low, high):  # neighbouring doubles
            return high if keys.where(F.col("key") == high).count() >= k else low
        low, high = r.low, r.high
    return low


def _clean(labels: DataFrame) -> DataFrame:
    """(doc_id) of labelled documents with quality 1 and toxic 0 in all their labels; a null label is neither."""
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.coalesce(F.expr("quality = 1 AND toxic = 0"), F.lit(False))).alias("clean")
    ).where("clean").select("doc_id")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, keep_clean: float = 0.995, seed: int = 1) -> DataFrame:
    """Draw the k rows of docs with the largest sum of log importance weight and Gumbel noise, a sample without replacement by weight, from those not rejected.

    docs: doc_id, text; labels: doc_id, quality, toxic; other columns are left alone. Returns doc_id, log_weight, gumbel_key and kept for each row; ties with the k-th
    row are kept. Without k, k is the number of rows with a key at least as large as that of the share keep_clean of the
    labelled clean documents, so that nearly all clean text is drawn and what is unlike it is not. Null and empty texts weigh nothing (0 in
    the log); repeated rows have equal keys; a row without doc_id takes part. Texts of any length are weighed whole. Without labels there is no target: every weight is about 0, and without k all rows are kept. Empty docs give no rows.

    A sum over a text drowns a few toxic words, and noise drowns the weight of a short text. So two cutoffs without noise reject rows first, each as tight as
    leaves the share keep_clean of the labelled clean documents: one on the evidence of toxicity (if any label is toxic), one on the mean log ratio (if any
    has quality 0). All models are fitted to all labelled documents; the cutoff of toxicity comes from labels that the model scored had not
    seen. With k, fewer rows are kept where fewer are not rejected.
    """
    keys, least, _, cuts = _keys(docs, labels, k, keep_clean, seed)
    return keys.select("doc_id", "log_weight", F.col("key").alias("gumbel_key"), ((F.col("key") >= F.lit(least)) & _allowed(F.col("mean"), F.col("toxic"), cuts)).alias("kept"))


def _allowed(mean: Column, toxic: Column, cuts: tuple[float, float]) -> Column:
    return (mean >= F.lit(cuts[0])) & (toxic <= F.lit(cuts[1]))


def _keys(docs: DataFrame, labels: DataFrame, k: int | None, keep_clean: float, seed: int):
    """(doc_id, log_weight, mean, toxic, key) of all rows as a written table, the least key of the sample, both models, and the least mean and most evidence allowed."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = _labelled(docs, labels)
    ratios = log_ratios(count_features(docs, labelled.where("toxic = 0")))
    low, most = -np.inf, np.inf
    evidence = [(np.zeros(0, np.int64), np.zeros(0, np.float32))]
    if not labels.where("doc_id IS NOT NULL AND toxic = 1").isEmpty():
        evidence = toxic_evidence(labelled)
        unseen = labelled.where("toxic = 0").select(scores(F.col("text"), ratios, evidence, F.col("fold")).alias("s"))
        unseen = written(unseen.select(F.col("s.toxic").alias("key")), "unseen")
        found = kth_largest(unseen, int((1 - keep_clean) * unseen.count()) + 1)
        most = np.inf if found is None else found
    keys = docs.select("doc_id", scores(F.col("text"), ratios, evidence).alias("s")).select("doc_id", "s.*")
    keys = written(keys.withColumn("key", gumbel_key(F.col("log_weight"), F.col("doc_id"), seed)), "keys")
    clean = written(keys.join(_clean(labels), "doc_id").select("key", "mean"), "clean")
    share = max(1, int(np.ceil(keep_clean * clean.count())))
    if not labels.where("doc_id IS NOT NULL AND quality = 0").isEmpty():
        found = kth_largest(clean.select(F.col("mean").alias("key")), share)
        low = -np.inf if found is None else found
    drawn = keys.where(_allowed(F.col("mean"), F.col("toxic"), (low, most)))
    if k is None:
        least = kth_largest(clean, share)
        least = -np.inf if least is None else least
    else:
        found = kth_largest(drawn, k)
        least = (np.inf if k < 1 else -np.inf) if found is None else found
    return keys, least, (ratios, evidence), (low, most)


def sampled(docs: DataFrame, labels: DataFrame, k: int | None = None, keep_clean: float = 0.995, seed: int = 1) -> DataFrame:
    """The rows of docs that resample() keeps, with all their columns; texts are weighed again where they lie, not shuffled."""
    _, least, models, cuts = _keys(docs, labels, k, keep_clean, seed)
    s = scores(F.col("text"), models[0], models[1][-1:])
    return docs.where((gumbel_key(s["log_weight"], F.col("doc_id").cast("long"), seed) >= F.lit(least)) & _allowed(s["mean"], s["toxic"], cuts))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weighed against the labelled clean ones."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
