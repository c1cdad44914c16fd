import random
import re

from switchback.llm.license_rules import BASE, LEAST, rules
from switchback.llm.license_scan import SURE, op6_license_scan, scan

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    w = "".join(f" {x}" for x in words)
    spans, at = {}, 0
    for i, x in enumerate(words):
        spans[at] = i
        at += len(x) + 1
    places = []
    for k, (priority, label, _, pattern) in enumerate(rules()):
        rx = re.compile(pattern + "(?= |$)")
        places += [(spans[m], spans[m] + rx.match(w, m)[0].count(" "), priority, k, label) for m in spans if rx.match(w, m)]

    def beaten(h):
        return any(o is not h and o[0] <= h[0] and o[1] >= h[1] and (o[2] < h[2] or o[2] == h[2] and (o[1] - o[0] > h[1] - h[0] or o[:2] == h[:2] and o[3] < h[3])) for o in places)

    left = [h for h in places if h[2] == 0 or not beaten(h)]
    base = [h for h in places if h[2] == 0]
    starts = [i for _, phrase in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    assert sorted(starts) == sorted(h[0] for h in base)
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({h[4] for h in base})),
        ",".join(sorted({h[4] for h in left})), max((SURE[h[2]] for h in left), default=0.0)
    )


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, w string, rule int")
    return [tuple(r)[1:8] for r in scan(df).orderBy("doc_id").collect()]


def test_rules_are_hundreds_and_gated():
    found = rules()
    assert len(found) > 300 and all(0 <= p <= LEAST for p, *_ in found)
    for _, _, keyword, pattern in found:  # the keyword stands in a sample of the pattern
        sample = re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", re.sub(r"\.\{1,80\}\?", "x", pattern))
        for _ in range(4):
            sample = re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", sample)
        sample = re.sub(r"\[(.)[^\]]*\](\{\d(,\d)?\})?\??", lambda m: {"c": "s"}.get(m[1], m[1]), sample).replace(" ?", " ").replace("?", "")
        assert keyword.replace("licenc", "licens") in sample.replace("licenc", "licens"), (keyword, pattern, sample)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    parts = [
        "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "under the mit license", "cc by nc", "CC BY-NC-SA 4.0",
        "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.",
        "SPDX-License-Identifier: MIT", "apache license version 2", "apache license version 20", "Copyright (c) 2020", "BSD 3-Clause",
        "lesser general public license v2.1", "mit", "é", "word", "\n", "under the", "2", "GPLv3", "see the LICENSE file for details",
        "Creative Commons Attribution-ShareAlike 4.0", "public domain", "Neither the name of the group nor the names of its contributors may be used"
    ]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    texts += [f"{x}{end}" for x in ("under the mit license", "MIT License", "cc by nc") for end in ("\x85", "\u2028", "\u2029", "\r\n", "\x85\n", " \u2028", "\u2029 x")]
    notice = "neither the name of {} nor the names of its contributors may be used"
    texts += [
        notice.format("a " + notice.format("b")), "neither the name of a neither the name of b nor the names of its contributors may be used",
        notice.format("neither the name of neither the name of c"), "apache license version 2 apache license version 2 0"
    ]
    texts += [None, "", " .\n", "MIT", "under the MIT license", "Kelvin K under the MİT license", "cc by nc cc by nc cc by nc", "\U0001f600 cc by nc \U0001f600"]
    assert run(spark, texts) == [brute(t) for t in texts]


def test_long_text_empty_table_and_repeats(spark):
    long = "x " * 20_000 + "Released under the MIT License.\n" * 3_000
    got = run(spark, [long])[0]
    assert got == (20_000 + 15_000, 3_000, 20_001, 20_001 + 5 * 2_999, "mit", "mit", 1.0)
    df = spark.createDataFrame([(None, "cc by nc"), (1, "cc by nc"), (1, "cc by nc")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_base) for r in scan(df).collect()) == [("1", 1), ("1", 1), ("None", 1)]
    assert scan(df.limit(0)).collect() == []


def test_query_on_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_license_scan(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: brute(t) for i, t in docs.items()} and len(rows) == len(docs)
