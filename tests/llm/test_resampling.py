import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from switchback.llm.resampling import _labelled, _packed, _unpacked, kth_largest, op4_quality_classifier, resample, sampled, toxic_evidence

SF = "/root/testdata/sf0.1"


def small(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, key string, log_weight double")


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(3)
    values = [float(x) for x in rng.normal(0, 1e3, 3000)] + [7.5] * 200 + [1e300, -1e300, 0.0, 5e-324]
    df = spark.createDataFrame([(x,) for x in values], "key double")
    for k in (1, 2, 150, 1500, len(values)):
        assert kth_largest(df, k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(df, len(values) + 1) is None and kth_largest(df.limit(0), 1) is None
    assert kth_largest(spark.createDataFrame([(2.0,)] * 9, "key double"), 4) == 2.0


def test_sample_size_and_determinism(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    first = resample(docs, labels, k=300).where("kept")
    assert first.count() == 300
    again = resample(docs.repartition(7), labels, k=300).where("kept")
    assert sorted(r.doc_id for r in first.collect()) == sorted(r.doc_id for r in again.collect())
    assert sampled(docs, labels, k=300).columns == docs.columns and sampled(docs, labels, k=300).count() == 300
    whole = op4_quality_classifier(spark, "/root/testdata/sf0.01")
    assert whole.count() == docs.count() and whole.columns == ["doc_id", "log_weight", "gumbel_key", "kept"]


def test_rows_of_all_kinds(spark):
    rows = [(1, "good words here"), (1, "good words here"), (2, None), (3, ""), (None, "bad # bad"), (4, "good words " * 30_000)]
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, None), (None, 1, 0), (9, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = resample(small(spark, rows), labels).collect()
    assert len(got) == 6 and {r.log_weight for r in got if r.doc_id in (2, 3)} == {0.0}
    assert len({r.gumbel_key for r in got if r.doc_id == 1}) == 1 and all(r.kept for r in got if r.doc_id == 1)
    assert all(r.kept for r in resample(small(spark, rows), labels.limit(0)).collect())
    assert resample(small(spark, rows).limit(0), labels).collect() == []
    assert sampled(small(spark, rows), labels, k=0).collect() == []
    assert sampled(small(spark, rows), labels, k=6).count() == 6


def test_held_out_toxic_and_low_quality_are_rejected(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = labels.where("doc_id % 3 = 0").join(docs.select("doc_id", "n_chars"), "doc_id")
    rows = resample(docs, labels.where("doc_id % 3 != 0")).join(held, "doc_id")
    shares = rows.groupBy(
        F.expr("CASE WHEN quality = 0 THEN 'low' WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END").alias("kind")
    ).agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    kept = {r.kind: r.kept for r in shares}
    assert kept["clean"] > 0.98 and kept["low"] < 0.03 and kept["toxic"] < 0.1


M64 = (1 << 64) - 1


def mix(x, seed=0):
    x = (x + seed) & M64
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M64
    return x ^ x >> 31


def features_brute(text, bits):
    """Buckets of all tokens and neighbouring pairs, by whole numbers of Python."""
    def token(w):
        h = len(w) * 0xD6E8FEB86659FD93
        for i in range(0, len(w), 8):
            h += mix(int.from_bytes(w[i : i + 8], "little") ^ mix(i // 8 + 1, 1))
        return mix(h & M64)

    ones = [token(w) for w in re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\x20\x09-\x0d]+", (text or "").encode())]
    pairs = [mix((3 * a + b) & M64, 7) for a, b in zip(ones, ones[1:])]
    return [x >> 64 - bits for x in ones + pairs]


def spark_hash(*values):
    """Spark's xxhash64 of whole numbers (4 bytes for an int, 8 for a long)."""
    seed = 42
    for size, v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(size, "little", signed=True), seed)
    return seed


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    clean = {r.doc_id for r in labels if r.quality == 1 and r.toxic == 0} & docs.keys()
    toxic = {r.doc_id for r in labels if r.toxic == 1} & docs.keys()
    features = {i: features_brute(t, 20) for i, t in docs.items()}
    raw, target = Counter(), Counter()
    for i, f in features.items():
        raw.update(x >> 6 for x in f)
        if i in clean:
            target.update(x >> 6 for x in f)
    sizes = [sum(c.values()) + (1 << 14) for c in (target, raw)]
    ratio = {b: math.log((target[b] + 1) / sizes[0]) - math.log((raw[b] + 1) / sizes[1]) for b in range(1 << 14)}
    weight = {i: sum(ratio[x >> 6] for x in f) for i, f in features.items()}
    mean = {i: weight[i] / max(1, len(f)) for i, f in features.items()}
    uniform = {i: ((spark_hash((4, 1), (8, i)) >> 11) + 0.5) / (1 << 53) for i in docs}
    key = {i: weight[i] - math.log(-math.log(uniform[i])) for i in docs}
    fold = lambda i: (lambda h: (h - (1 << 64) if h >> 63 else h) % 3)(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), xxhash.xxh64_intdigest(b"fold", 42)))

    def evidence(out):
        some = [[i for i in kind if fold(i) != out] for kind in (toxic, clean)]
        seen = [Counter(x for i in part for x in set(features[i])) for part in some]
        bound = {}
        for x in seen[0]:
            a, b = (c[x] + 0.5 for c in seen)
            bound[x] = math.log(a / (1 + len(some[0]))) - math.log(b / (1 + len(some[1]))) - 1.5 * math.sqrt(1 / a + 1 / b)
        return {x: v for x, v in bound.items() if v > 1.5}

    models = {out: evidence(out) for out in (0, 1, 2)}
    models[None] = {x: sum(m.get(x, 0) for m in models.values()) / 3 for x in set().union(*models.values())}
    score = lambda i, out: sum(models[out].get(x, 0) for x in set(features[i])) / math.sqrt(max(1, len(features[i])))
    share = math.ceil(0.995 * len(clean))
    kth = lambda values, k: sorted(values, reverse=True)[k - 1]
    most = kth([score(i, fold(i)) for i in clean], int((1 - 0.995) * len(clean)) + 1)
    low, least = kth([mean[i] for i in clean], share), kth([key[i] for i in clean], share)
    got = {r.doc_id: r for r in op4_quality_classifier(spark, sf).collect()}
    assert got.keys() == docs.keys() and toxic
    near, wrong = 0, []
    for i in docs:
        assert math.isclose(got[i].log_weight, weight[i], rel_tol=1e-6, abs_tol=1e-6) and math.isclose(got[i].gumbel_key, key[i], rel_tol=1e-6, abs_tol=1e-6)
        gaps = (key[i] - least, mean[i] - low, most - score(i, None))
        near += min(map(abs, gaps)) < 1e-5
        if min(map(abs, gaps)) >= 1e-5 and got[i].kept != (min(gaps) >= 0):
            wrong.append(i)
    assert not wrong and near < 10 and 0 < sum(not r.kept for r in got.values()) < len(docs)


def test_all_labels_count(spark, monkeypatch):
    # more clean documents than any bound of old, each with a word of its own: where all rows are target, no bucket is likelier there
    docs = spark.range(25_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert resample(docs, labels).agg(F.max(F.abs("log_weight"))).first()[0] == 0
    # labels found by bits first
    some = labels.where("doc_id % 3 = 0").withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    plain = {tuple(r) for r in resample(docs, some).collect()}
    monkeypatch.setattr("switchback.llm.resampling.MANY", 10)
    monkeypatch.setattr("switchback.llm.resampling.WORDS", 64)
    assert {tuple(r) for r in resample(docs, some).collect()} == plain
    assert len({r[1] for r in plain}) > 1


def shuffled_mb(spark):
    """What all stages so far have written to shuffles."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) / 1e6


def test_shuffles_hold_labelled_texts_and_little_more(spark):
    # labels beyond a broadcast, a tenth of the rows; all texts are some 26 MB, of words that occur once or so
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.sha2(F.concat_ws(".", F.col("id"), F.when(k % 2 == 0, k)), 224).substr(1, 8)))
    docs = spark.range(0, 48_000, 1, 24).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = docs.where("doc_id % 10 = 0").select("doc_id", F.lit(1).alias("quality"), F.expr("cast(doc_id % 20 = 0 AS int)").alias("toxic"))
    threshold, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled_mb(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labelled = _labelled(docs, labels)
        assert labelled.count() == 4800
        middle = shuffled_mb(spark)
        toxic_evidence(labelled)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert middle - before < 5 and shuffled_mb(spark) - middle < 5, (middle - before, shuffled_mb(spark) - middle)


def test_counts_are_packed_whole():
    counts = np.zeros((6, 4096), np.int32)
    counts[2, 7], counts[5, 4095], counts[0, 0] = 1, 2**31 - 1, 70_000
    assert (_unpacked(_packed(counts)) == counts).all() and (_unpacked(_packed(counts[:, :1])) == counts[:, :1]).all()
