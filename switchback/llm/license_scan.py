"""License scans by ordered signature rules, with DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .license_rules import BASE, LEAST, any_of, rules
from .shared import let, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed: what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: How sure a detection is by its priority.
SURE = (1.0, 0.95, 0.8, 0.6, 0.3)


def spaced_words(text: Column) -> Column:
    """The words of a text with ASCII letters in lower case, each after one space; empty for null."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.rtrim(F.regexp_replace(F.concat(F.lit(" "), low), BETWEEN, " "))


def word_count(words: Column) -> Column:
    return F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit("")))


def _pieces(w: Column, pattern: Column) -> Column:
    """The text cut before each place of a rule: words in the piece, and words of the match that it begins with (0 without), which may reach into the next ones."""
    ahead = F.concat(F.lit("(?=("), pattern, F.lit(r"(?= |\z)))"))
    cuts = F.split(w, ahead, F.lit(-1))
    both = F.struct(cuts.alias("cuts"), F.regexp_extract_all(w, ahead, F.lit(1)).alias("found"))
    return let(
        both,
        lambda b: F.transform(
            b.cuts, lambda c,
            i: F.struct(word_count(c).alias("words"), F.coalesce(word_count(F.get(b.found, i - F.size(b.cuts) + F.size(b.found))), F.lit(0)).alias("n"))
        )
    )


def scan(docs: DataFrame) -> DataFrame:
    """All places of the signature rules that no better rule's place contains, summed up for each row of docs.

    docs: doc_id, text; other columns are left alone. Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections
    (array of start, n_words, label, priority). Word counts and places are in words from 0.

    The rules whose keyword stands in the text are searched over its words, each from every place, so places of one rule may overlap. A place is suppressed by a
    place that contains it and has a lower priority number, or the same and is longer, or else comes earlier among the rules; base phrases have priority 0 and
    stay. labels holds all labels left, licenses' and those of other notices (copyright, license-file, proprietary and the like), and base_labels those of base
    phrases, both sorted; score is the greatest sureness among places left, 0 if there is none. Null and empty texts have no words; repeated
    rows are scanned alike; a null doc_id stays null; an empty table gives no rows.
    """
    all_rules = [{"rule": i, **dict(zip(("priority", "label", "keyword", "pattern"), r))} for i, r in enumerate(rules())]
    listed = F.from_json(F.lit(json.dumps(all_rules)), "array<struct<rule: int, priority: int, label: string, keyword: string, pattern: string>>")
    listed_keywords = list(dict.fromkeys(r["keyword"] for r in all_rules))
    keywords = F.from_json(F.lit(json.dumps(listed_keywords)), "array<string>")
    seen = F.lit(f"(?=({any_of(listed_keywords)}))")

    def found(w: Column) -> Column:
        gated = lambda g: F.transform(
            F.filter(listed, lambda r: F.array_contains(g, r.keyword)),
            lambda r: F.struct(r.rule.alias("rule"), r.priority.alias("priority"), r.label.alias("label"), _pieces(w, r.pattern).alias("pieces"))
        )
        hits = lambda g: F.filter(gated(g), lambda s: F.exists(s.pieces, lambda p: p.n > 0))
        # one search for the longest keyword at each place; those that begin it stand there too
        gates = let(
            F.array_distinct(F.regexp_extract_all(w, seen, F.lit(1))),
            lambda f: F.when(F.size(f) > 0, let(F.filter(keywords, lambda k: F.exists(f, lambda x: F.startswith(x, k))), hits))
        )
        return F.struct(word_count(w).cast("long").alias("n_words"), gates.alias("found"))

    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), let(spaced_words(F.col("text").cast("string")), found).alias("f"))
    narrow = written(d.select("row", "doc_id", "f.*"), "found")

    none = narrow.where("coalesce(size(found), 0) <= 0").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), *(F.lit(None).cast("long").alias(c) for c in ("first_word", "last_word")),
        *(F.lit("").alias(c) for c in ("base_labels", "labels")), F.lit(0.0).alias("score"),
        F.array().cast("array<struct<start: long, n_words: long, label: string, priority: int>>").alias("detections")
    )
    some = narrow.where("size(found) > 0").repartition("row").select("row", "doc_id", "n_words", F.inline("found"))
    places = some.select("row", "doc_id", "n_words", "rule", "priority", "label", F.posexplode("pieces").alias("at", "piece"))
    before = Window.partitionBy("row", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("start", F.coalesce(F.sum("piece.words").over(before), F.lit(0)).cast("long"))
    places = places.where("piece.n > 0").withColumn("stop", F.col("start") + F.col("piece.n"))
    earlier = Window.partitionBy("row").orderBy("start", F.desc("stop"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    for p in range(LEAST + 1):
        places = places.withColumn(f"reach{p}", F.max(F.when(F.col("priority") <= p, F.col("stop"))).over(earlier))
    reach = F.element_at(F.array(*(F.coalesce(f"reach{p}", F.lit(-1)) for p in range(LEAST + 1))), F.col("priority") + 1)
    base = F.col("priority") == 0
    left = places.where(base | (reach < F.col("stop")))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    sure = F.element_at(F.array(*(F.lit(s) for s in SURE)), F.col("priority") + 1)
    hits = left.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max(sure).alias("score"),
        F.array_sort(F.collect_list(F.struct("start", (F.col("stop") - F.col("start")).alias("n_words"), "label", "priority"))).alias("detections"),
    )
    return none.unionByName(hits.drop("row"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by all rules."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
