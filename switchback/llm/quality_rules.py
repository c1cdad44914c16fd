"""Quality rules whose cutoffs are chosen for a guaranteed rate of false rejections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, written
from .textnp import LINES, VISIBLE, cut_words, mixed, text_blocks

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
CAPITALS = np.zeros(256, np.int64)
CAPITALS[65:91] = 1
FIRST_OF_POINT = np.ones(256, np.int64)
FIRST_OF_POINT[0x80:0xC0] = 0
#: What the rules compare to their cutoffs; a document fails a rule above its cutoff.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "word_chars / greatest(n_words, 1) / 100",
}
#: The cutoffs to choose from are 2 ** (-i / STEPS) for i = 0, 1, ... STEPS * 10, fixed beforehand.
STEPS = 8


def _count(column: pa.Array) -> dict[str, np.ndarray]:
    found: dict[str, list[np.ndarray]] = {c: [] for c in COUNTS}
    for _, _, data, offsets in text_blocks(column):
        words = cut_words(data, offsets, VISIBLE, lower=False)
        n = np.diff(words.first)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
        of = np.repeat(np.arange(len(n)), n)
        inside = VISIBLE[data] > 0
        lines = cut_words(data, offsets, LINES, lower=False)
        filled = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
        line_of = np.repeat(np.arange(len(n)), np.diff(lines.first))[filled]
        n_lines = np.bincount(line_of, minlength=len(n))
        _, at = np.unique(mixed(lines.hashes()[filled] ^ mixed(line_of.astype(np.uint64), 3)), return_index=True)
        windows, ends = words.shingles(3)
        window_of = np.repeat(np.arange(len(n)), np.diff(ends))
        _, back, times = np.unique(mixed(windows ^ mixed(window_of.astype(np.uint64), 4)), return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[back] > 1)
        first = twice - ends[window_of[twice]] + words.first[window_of[twice]]
        repeated = np.zeros(len(of), bool)
        for k in range(3):
            repeated[first + k] = True
        for c, x in zip(
            COUNTS,
            (
                n, total(FIRST_OF_POINT[data] * inside), total(SYMBOLS[data]), n_lines, n_lines - np.bincount(line_of[at], minlength=len(n)),
                np.bincount(of[repeated], minlength=len(n)), total(CAPITALS[data])
            )
        ):
            found[c].append(x.astype(np.int64))
    return {c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in found.items()}


def counts(text: Column) -> Column:
    """A struct of COUNTS for a whole text: words between ASCII white space, code points in them, symbols, lines with a word, those equal to an
    earlier one, words in three-word windows found twice or more, and ASCII capitals. A null text has none of them."""

    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS))
    def count(column: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x) for x in _count(column).values()], list(COUNTS))

    return count(text.cast("string"))


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def tail(n: int, k: int, p: float) -> float:
    """P(X <= k) for X binomial with n trials of chance p."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    log_choose = np.concatenate([[0.0], np.cumsum(np.log(n - i[:-1]) - np.log(i[1:]))])
    terms = log_choose + i * math.log(p) + (n - i) * math.log1p(-p)
    top = terms.max()
    return float(min(1.0, math.exp(top) * np.exp(terms - top).sum()))


def choose_cutoffs(good: DataFrame, risk: float, doubt: float) -> DataFrame:
    """(stratum, rule, cutoff) from good labelled rows: stratum and COUNTS.

    For each stratum, all rules together reject at most a share ``risk`` of good documents, with a chance of at least 1 - doubt that
    this holds in every stratum. Each rule has risk / rules, and a test level of doubt / (strata * rules) (Bonferroni). Its cutoffs are
    tested from the most lenient on, each by the exact binomial tail of the rejections seen; the first that does not pass ends it (a fixed
    sequence needs no more correction). A rule without a passing cutoff is not used in the stratum and has no row.
    """
    strata = good.select("stratum").distinct().count()
    share, level = risk / len(RULES), doubt / max(1, strata * len(RULES))
    values = F.array(*(F.struct(F.lit(r).alias("rule"), F.expr(f"cast({e} AS double)").alias("value")) for r, e in RULES.items()))
    # the number of cutoffs, from the most lenient on, that the value does not exceed; its first failure is the next one
    step = f"cast(CASE WHEN value <= 0 THEN {10 * STEPS + 1} WHEN value > 1 THEN 0 ELSE least({10 * STEPS + 1}, floor(-log2(value) * {STEPS}) + 1) END AS int)"
    bins = good.select("stratum", F.inline(values)).groupBy("stratum", "rule", F.expr(step).alias("passed")).agg(F.count("*").alias("n"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(10 * STEPS + 2, np.int64)
        np.add.at(seen, pdf.passed.to_numpy(), pdf.n.to_numpy())
        n, rejected, chosen = int(seen.sum()), 0, None
        for i in range(10 * STEPS + 1):
            rejected += int(seen[i])
            if rejected > share * n or tail(n, rejected, share) > level:
                break
            chosen = i
        out = pdf.iloc[: int(chosen is not None)][["stratum", "rule"]]
        return out.assign(cutoff=2.0 ** (-(chosen or 0) / STEPS))

    return bins.groupBy("stratum", "rule").applyInPandas(best, "stratum string, rule string, cutoff double")


def judged(docs: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """docs (with stratum and COUNTS) with failed_rules, the rules of its stratum that each row fails, and kept, whether it fails neither those nor the base rules."""
    wide = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    wide = written(wide, "cutoffs").withColumnRenamed("stratum", "s")
    fails = F.array_compact(F.array(*(F.when(F.expr(f"{e} > cutoffs['{r}']"), F.lit(r)) for r, e in RULES.items())))
    return docs.join(wide, F.col("stratum") == F.col("s"), "left").withColumn("failed_rules", fails).withColumn("kept", ~base_failed() & (F.size("failed_rules") == 0)).drop("cutoffs", "s")


def stratum(lang: str = "lang") -> Column:
    return F.coalesce(F.col(lang).cast("string"), F.lit(""))


def fitted(docs: DataFrame, labels: DataFrame, risk: float = 0.02, doubt: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(counts by row, cutoffs): docs has doc_id, text, lang; labels has doc_id, quality. Both results are written tables.

    The holdout is every labelled document that passes the base rules and has quality 1 in all its labels. Rows without doc_id, or whose label is null, are not in it. A null lang is
    a stratum of its own, named by the empty string.
    """
    small_batches(docs.sparkSession)
    rows = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum().alias("stratum"), counts(F.col("text")).alias("c")).select("doc_id", "stratum", "c.*"),
        "counts"
    )
    good = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality")).where("quality = 1")
    cutoffs = written(choose_cutoffs(rows.where(~base_failed()).join(good.select("doc_id"), "doc_id"), risk, doubt), "cutoffs")
    return rows, cutoffs


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.02, doubt: float = 0.05) -> DataFrame:
    """For each row of docs: doc_id, the counts, base_failed, kept and failed_rules.

    Null and empty texts have no words and fail the base rules; repeated rows are judged alike; empty tables give no rows, and without labels
    the base rules alone decide. A value equal to its cutoff passes. Texts of any length are counted whole. Columns of docs other than doc_id, text and lang are left alone.
    """
    rows, cutoffs = fitted(docs, labels, risk, doubt)
    return judged(rows, cutoffs).select("doc_id", *COUNTS, base_failed().alias("base_failed"), "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def passing(docs: DataFrame, labels: DataFrame, risk: float = 0.02, doubt: float = 0.05) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with all their columns; texts are counted again where they lie, not shuffled."""
    _, cutoffs = fitted(docs, labels, risk, doubt)
    rows = docs.select(F.struct("*").alias("row"), stratum().alias("stratum"), counts(F.col("text")).alias("c")).select("row", "stratum", "c.*")
    return judged(rows, cutoffs).where("kept").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by cutoffs from all labels."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("n_lines", "n_capitals")


#: The counts from lists of words, windows and lines; the binomial tail from log-gamma.
OP10_SQL = r"""
WITH t AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
again AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice CROSS JOIN range(3) r(d) GROUP BY doc_id),
c AS MATERIALIZED (
  SELECT t.doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals
  FROM t LEFT JOIN again USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
v AS MATERIALIZED (
  SELECT doc_id, stratum, base_failed, unnest(['symbols', 'capitals', 'dup_lines', 'repeats', 'long_words']) AS rule, unnest([n_symbols / greatest(word_chars, 1), n_capitals / greatest(word_chars, 1),
    n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1), word_chars / greatest(n_words, 1) / 100]) AS value FROM b),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1),
h AS (SELECT v.stratum, rule, CASE WHEN value <= 0 THEN 81 WHEN value > 1 THEN 0 ELSE least(81, floor(-log2(value) * 8) + 1) END AS passed FROM v JOIN good USING (doc_id) WHERE NOT base_failed),
m AS (SELECT 0.05::DOUBLE / (5 * count(DISTINCT stratum)) AS level FROM h),
q AS (SELECT stratum, rule, i, count(*) AS n, count(*) FILTER (passed <= i) AS k FROM h CROSS JOIN range(81) s(i) GROUP BY ALL),
z AS (
  SELECT stratum, rule, i, any_value(n) AS n, any_value(q.k) AS k, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.004::DOUBLE) + (n - j) * ln(0.996::DOUBLE))) AS tail
  FROM q JOIN range(100000) s(j) ON j <= q.k AND q.k <= 0.004 * n GROUP BY stratum, rule, i),
e AS (SELECT q.stratum, q.rule, coalesce(min(q.i) FILTER (coalesce(z.tail > m.level, true)), 81) - 1 AS chosen FROM q CROSS JOIN m LEFT JOIN z USING (stratum, rule, i) GROUP BY ALL),
f AS (SELECT v.doc_id FROM v JOIN e ON e.stratum = v.stratum AND e.rule = v.rule AND e.chosen >= 0 AND v.value > 2 ** (-e.chosen / 8) GROUP BY v.doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND f.doc_id IS NULL AS kept, coalesce(x.rules, '') AS failed_rules
FROM b LEFT JOIN f USING (doc_id) LEFT JOIN (
  SELECT v.doc_id, string_agg(v.rule, ',' ORDER BY list_position(['symbols', 'capitals', 'dup_lines', 'repeats', 'long_words'], v.rule)) AS rules
  FROM v JOIN e ON e.stratum = v.stratum AND e.rule = v.rule AND e.chosen >= 0 AND v.value > 2 ** (-e.chosen / 8) GROUP BY v.doc_id) x USING (doc_id)"""
