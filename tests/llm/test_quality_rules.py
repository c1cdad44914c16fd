import random
import re
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa

from switchback.llm.quality_rules import COUNTS, _count, choose_cutoffs, op10_quality_rules, quality_rules, tail


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(inside), sum("A" <= c <= "Z" for c in text))


def test_counts_match_brute_force():
    rng = random.Random(1)
    texts = [None, "", " ", "\n", "a\n\na\na \n a", "x y x y x y", "É#é É#é É#é z", "one", "one two", "A A A A", "a b c d a b c"]
    texts += ["".join(rng.choice(["a", "b", "É", " ", " ", "\n", "|", "\t", "日", "#", "Q\n"]) for _ in range(rng.randrange(0, 200))) for _ in range(300)]
    texts.append("word " * 30000)
    got = list(zip(*(x.tolist() for x in _count(pa.array(texts)).values())))
    assert got == [brute(t) for t in texts]
    assert len(_count(pa.array([], pa.string()))["n_words"]) == 0


def test_tail_is_exact():
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.1), (50, 50, 0.1), (200, 9, 0.03)):
        assert abs(tail(n, k, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12


def test_cutoffs_hold_the_risk(spark):
    rng = np.random.default_rng(5)
    rows = [("en", 100, 1000, int(s), 10, 0, 0, 5) for s in rng.integers(0, 20, 4000)] + [("de", 100, 1000, 5, 10, 0, 0, 5)] * 60
    df = spark.createDataFrame(rows, ["stratum", *COUNTS])
    cut = {(r.stratum, r.rule): r.cutoff for r in choose_cutoffs(df, 0.02, 0.05).collect()}
    assert not any(s == "de" for s, _ in cut)  # 60 rows prove nothing
    assert 0.019 <= cut["en", "symbols"] < 0.024 and cut["en", "dup_lines"] == 2.0**-10
    assert sum(r[3] / 1000 > cut["en", "symbols"] for r in rows[:4000]) <= 0.004 * 4000


def test_rows_of_all_kinds(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}###" for i in range(60))
    docs = spark.createDataFrame(
        [(i, good + f" n{i}", "en", "k") for i in range(3000)] + [
            (3000, bad, "en", "k"), (3001, bad, None, "k"), (3002, None, "en", "k"), (None, "a b " * 100, "en", "k"), (3000, bad, "en", "k")
        ],
        "doc_id long, text string, lang string, kept string"
    )
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2900)] + [(5, 0, 0), (None, 1, 0), (3000, None, 0), (3000, 1, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    assert all(got[i].kept for i in range(3000))
    assert not got[3000].kept and not got[3000].base_failed and "symbols" in got[3000].failed_rules
    assert got[3001].kept and got[3001].failed_rules == ""  # no labels in its stratum
    assert got[3002].base_failed and got[3002].n_words == 0 and got[None].base_failed and not got[None].kept
    assert quality_rules(docs, labels).count() == 3005
    assert quality_rules(docs.limit(0), labels).collect() == []
    assert quality_rules(docs.where("doc_id >= 3000"), labels.limit(0)).where("kept").count() == 3


def cutoffs_brute(good, risk, doubt):
    """{(stratum, rule): cutoff} by the definition: every cutoff in turn, its rejections counted anew, the tail in whole fractions."""
    value = {
        "symbols": lambda c: c[2] / max(c[1], 1), "capitals": lambda c: c[6] / max(c[1], 1), "dup_lines": lambda c: c[4] / max(c[3], 1), "repeats": lambda c: c[5] / max(c[0], 1), "long_words": lambda c: c[1] / max(c[0], 1) / 100,
    }
    strata, out = {s for s, _ in good}, {}
    p = Fraction(risk) / len(value)
    for s in strata:
        rows = [c for t, c in good if t == s]
        for rule, f in value.items():
            values = [f(c) for c in rows]
            for i in range(81):
                cut = 2.0 ** (-i / 8)
                k = sum(v > cut for v in values)
                chance = sum(comb(len(rows), j) * p**j * (1 - p) ** (len(rows) - j) for j in range(k + 1)) if k <= p * len(rows) else 1
                if chance > Fraction(doubt) / (len(strata) * len(value)):
                    break
                out[s, rule] = cut
    return out, value


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = ([r.asDict() for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()] for t in ("documents", "labels"))
    held(spark, docs, labels, {r.doc_id: r for r in op10_quality_rules(spark, sf).collect()}, 0.02, 0.05)
    many = [{"doc_id": 10_000 * k + d["doc_id"], "text": d["text"], "lang": "en" if k % 2 else "de"} for k in range(12) for d in docs]
    tags = [{"doc_id": 10_000 * k + r["doc_id"], "quality": r["quality"]} for k in range(12) for r in labels]
    got = quality_rules(spark.createDataFrame(many, "doc_id long, text string, lang string"), spark.createDataFrame(tags, "doc_id long, quality int"), 0.2, 0.05)
    assert held(spark, many, tags, {r.doc_id: r for r in got.collect()}, 0.2, 0.05) > 20


def held(spark, docs, labels, got, risk, doubt):
    """Every row against its counts and the verdict by cutoffs_brute(); how many rules alone reject."""
    counts = {d["doc_id"]: brute(d["text"]) for d in docs}
    failed = {i: c[0] < 50 or 100 * c[5] > 50 * c[0] for i, c in counts.items()}
    bad = {r["doc_id"] for r in labels if r["quality"] != 1}
    good = {r["doc_id"] for r in labels} - bad
    lang = {d["doc_id"]: d["lang"] or "" for d in docs}
    cut, value = cutoffs_brute([(lang[i], counts[i]) for i in counts if i in good and not failed[i]], str(risk), str(doubt))
    alone = 0
    for i, c in counts.items():
        rules = sum(f(c) > cut.get((lang[i], rule), float("inf")) for rule, f in value.items())
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == (c[0], c[1], c[2], c[4], c[5])
        assert got[i].base_failed == failed[i] and got[i].kept == (not failed[i] and not rules), i
        alone += not failed[i] and rules > 0
    assert len(got) == len(counts)
    return alone
