import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from switchback.llm.line_dedup import without_boilerplate
from switchback.llm.quality_rules import quality_rules
from switchback.llm.resampling import resample

from .test_line_dedup import brute as lines_brute
from .test_ngram_join import brute as components_brute

SF = "/root/testdata/sf0.01"


def test_stages_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "line_dedup", "ngram_jaccard", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        rows = {r.doc_id: r for r in docs.collect()}
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert after.columns == columns
        if name == "quality_classifier":
            want = {r.doc_id for r in resample(docs, labels).where("kept").collect()}
            assert {r.doc_id for r in after.collect()} == want
            good = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()} & rows.keys()
            assert len(good & want) >= 0.98 * len(good)
        if name == "quality_rules":
            want = {r.doc_id for r in quality_rules(docs, labels).where("kept").collect()}
            assert {r.doc_id for r in after.collect()} == want
        if name == "line_dedup":
            got = sorted(((r.source, r.text) for r in after.collect()), key=str)
            assert got == sorted((x[:2] for x in lines_brute([(r.source, r.text) for r in rows.values()], 0.05, 10)), key=str)
        if name == "ngram_jaccard":
            want = {i for i, _, c in components_brute([(r.doc_id, r.text) for r in rows.values()], 5, 80) if i == c}
            assert {r.doc_id for r in after.collect()} == want and len(want) < len(rows)
        if name == "packing":
            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            ids = {i: np.array([*t.encode(r.text, add_special_tokens=False).ids, 0], "<u4") for i, r in rows.items()}
            got = after.collect()
            assert sum(r.length for r in got) == sum(map(len, ids.values()))
            assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got)
        docs = after
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_odd_rows_pass_all_stages(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (None, "a b c " * 90, "en", "s", 1), (3, "", "en", "s", 0), (4, "word " * 60, "en", None, 2), (4, "word " * 60, "en", None, 2)],
        "doc_id long, text string, lang string, source string, n_chars long"
    )
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    twice = without_boilerplate(docs)
    assert twice.count() == 5
    kept = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    assert sorted(str(r.doc_id) for r in kept.select(F.col("doc_id")).collect()) == ["1", "3", "4", "None"]


def test_columns_of_any_name_and_a_very_long_text_pass_all_stages(spark, tmp_path):
    names = ["n_lines", "n_dropped", "kept", "row", "stratum", "lo", "hi", "n", "id", "no_id", "s", "host", "lines", "drop", "label", "toxic", "key", "hit", "fold"]
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    long = "\n".join(f"Line {i} tells of {i * 7} things, and of {i * i} more that nobody had seen before." for i in range(70_000))
    assert len(long) > 5_000_000
    docs = base.unionByName(spark.createDataFrame([(9_000_001, long, "en", "long", len(long))], base.schema))
    docs = docs.select("*", *(F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in names))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.select("doc_id", *names).collect()
        assert rows and all(r[c] == f"{c} {r.doc_id}" for r in rows for c in names), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {r.doc_id for r in rows}
