import random
from collections import Counter

import duckdb

from switchback.llm import line_dedup
from switchback.llm.line_dedup import OP9_SQL, op9_line_dedup, without_boilerplate

BLANK = " \t\v\f\r"


def brute(rows, ratio, least):
    pages, seen = Counter(h for h, _ in rows), Counter()
    for h, t in rows:
        seen.update({(h, x) for x in (t or "").split("\n") if x.strip(BLANK)})
    gone = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for h, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if (h, x) not in gone]
        out.append((h, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "k", 7) for i, r in enumerate(rows)], "doc_id long, source string, text string, line string, n_lines int")


def test_matches_brute_force(spark):
    rng = random.Random(2)
    hosts = ["a", "a", "a", "b", None, "", "c"]
    rows = [
        (
            rng.choice(hosts),
            rng.choice([None, "", "\n\n", "menu\nmenu", "x"]) if rng.random() < 0.1 else "\n".join(
                rng.choice(["menu", "foot ", f"own {rng.random()}", "", " \t", f"word {rng.randrange(9)}", "é"]) for _ in range(rng.randrange(1, 9))
            )
        ) for _ in range(400)
    ]
    rows += [("one", "menu\nmenu")] * 3 + [("tie", "t")] * 10 + [("tie", "u")] * 10
    for ratio, least in ((0.05, 10), (0.5, 3), (0.2, 10)):
        got = without_boilerplate(table(spark, rows), ratio=ratio, least_pages=least)
        assert got.columns == ["doc_id", "source", "text", "line", "n_lines", "n_dropped"]
        assert sorted(((r.source, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute(rows, ratio, least)


def test_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", 0)
    rows = [("a", f"menu\nown {i}") for i in range(30)] + [(None, "menu")] * 30
    got = without_boilerplate(table(spark, rows), ratio=0.5, least_pages=3)
    assert sorted(((r.source, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute(rows, 0.5, 3)


def test_empty_table_and_long_text(spark):
    assert without_boilerplate(table(spark, [("a", "b")]).limit(0)).collect() == []
    long = "\n".join(["same"] + [f"line {i}" for i in range(50_000)])
    got = without_boilerplate(table(spark, [("a", long)] + [("a", "same")] * 12), ratio=0.5).orderBy("doc_id").collect()
    assert got[0].n_dropped == 1 and got[0].n_lines == 50_001 and got[1].text == ""


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, op9_line_dedup(spark, sf).collect())) == sorted(db.execute(OP9_SQL).fetchall())
