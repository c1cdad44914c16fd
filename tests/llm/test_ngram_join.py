import random
import re
from collections import defaultdict

from switchback.llm.ngram_join import jaccard_components, one_of_each, op5_ngram_jaccard

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[top(i)] = top(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[top(i)].append(doc)
    return sorted((doc, len(sets[i]), min(ids[top(i)]) if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def run(spark, rows, width=4, percent=85):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, h string, rep long")
    return sorted(tuple(r)[:3] for r in jaccard_components(df, width, percent).collect())


def test_random_texts_with_copies_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        if rows and rng.random() < 0.7:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.choice((1, 3, 4, 20, 60, 120)))]
        rows.append((1000 - i, " ".join(w)))
    assert run(spark, rows) == brute(rows, 4, 85)
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_chain_of_links_is_one_component(spark):
    base = [f"a{i}" for i in range(120)]
    rows = [(i, " ".join([f"z{k}" for k in range(i)] + base[i:])) for i in range(0, 30)]
    assert run(spark, rows) == brute(rows, 4, 85)


def test_edge_texts(spark):
    long = " ".join(f"v{i % 7919}" for i in range(30000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one\x0btwo three"), (7, long), (8, long + " end"), (9, "É x y z"),
        (10, "é x y z"), (4, "One two")
    ]
    assert run(spark, rows) == brute(rows, 4, 85)


def test_rows_without_id_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (None, "lone words stand here"), (4, None)], "doc_id long, text string")
    got = {tuple(r)[:3] for r in jaccard_components(df, 4, 85).collect()}
    assert got == {(None, 2, 3), (3, 2, 3), (None, 1, None), (4, 0, 4)}
    assert jaccard_components(df.limit(0)).collect() == []


def test_same_id_with_different_texts(spark):
    rows = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "p q r s t u")]
    assert run(spark, rows) == brute(rows, 4, 85)


def test_every_link_is_counted(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = [(1, " ".join(base))]
    for i in range(2, 60):  # near copies of one text, which link to one another or not
        w = list(rng.choice(rows)[1].split(" "))
        for _ in range(rng.choice((0, 1, 1, 2))):
            w[rng.randrange(len(w))] = f"c{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    grams = {i: frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) for i, t in rows for w in [t.split(" ")]}
    want = {i: sum(100 * len(a & b) >= 85 * len(a | b) for b in set(grams.values()) if a != b) for i, a in grams.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_components(df, 4, 85)
    assert {r.doc_id: r.n_links for r in got.collect()} == want and max(want.values()) > 5
    plain = jaccard_components(df, 4, 85, every_link=False)
    assert sorted(r[:4] for r in got.collect()) == sorted(tuple(r) for r in plain.collect())


def test_hot_shingles_and_components_are_split(spark, monkeypatch):
    monkeypatch.setattr("switchback.llm.ngram_join.MEET", 3)
    monkeypatch.setattr("switchback.llm.ngram_join.BLOCK", 4)
    test_every_link_is_counted(spark)
    test_random_texts_with_copies_match_brute_force(spark)


def test_many_short_texts_that_share_one_phrase(spark):
    rows = [(i, f"all rights reserved by the holder of this w{i % 9000} and w{i * 7 % 9001}") for i in range(20_000)]
    rows += [(30_000 + i, "all rights reserved by the holder of this" + f" v{i // 2}" * (i % 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_components(df, 4, 85).collect()}
    assert {got[i] for i in range(30_000, 30_600, 2)} == {(30_000, 0)} and len(got) == 20_600
    assert all(got[i] == (i, 0) for i in range(9001))


def test_one_of_each_keeps_different_texts_and_any_columns(spark):
    names = ["kept_id", "row", "id", "lo", "hi", "n", "rep", "component", "h"]
    near = [f"w{i}" for i in range(60)]
    rows = [
        (7, "one text of five words"), (7, "another text with six words here"), (7, "one text of five words"), (8, "ONE text of five words"),
        (9, " ".join(near)), (10, " ".join([*near[:-1], "x"])), (None, "one text of five words"), (None, "lone words without an id stand"),
        (11, None), (11, ""), (12, " \n")
    ]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = one_of_each(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(
        [(7, "one text of five words"), (7, "another text with six words here"), (9, " ".join(near)), (None, "lone words without an id stand"), (11, None), (11, ""), (12, " \n")],
        key=str
    )


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r)[:3] for r in op5_ngram_jaccard(spark, sf).collect()) == brute(rows, 4, 85)
