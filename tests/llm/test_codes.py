import hashlib
import math
import random

import numpy as np
import pytest

from switchback.llm.codes import compressed, op13_vector_codes, whole

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain loops over Python's integers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    longest = max((len(v) for _, v, _ in kept), default=0)
    width = -(-longest // parts)
    vectors = [[1024 * int(x) if abs(x) >= 2**53 else math.floor(1024 * x) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in vectors]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign(c, p):
        return min((sum((a - b) ** 2 for a, b in zip(c, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(assign(c[p], p)[1], []).append(c[p])
            for k, members in groups.items():
                books[p][k] = [sum(x) // len(members) for x in zip(*members)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, label), c in zip(kept, cut):
        found = [assign(c[p], p) for p in range(parts)]
        error = sum(e for e, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    small = lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, small(e), small(by_label[label]), sha) for i, c, e, label in out), key=str)


def run(spark, rows, **options):
    got = compressed(spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA).repartition(5), **options).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=str)


def test_query_matches_plain_loops(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = op13_vector_codes(spark, SF)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    x = np.array([[math.floor(1024 * float(v)) for v in vec] for _, vec, _ in sorted(rows)], np.int64)
    books = [x[:256, p * 16 : p * 16 + 16].copy() for p in range(4)]
    for step in range(5):
        near = [((x[:, None, p * 16 : p * 16 + 16] - books[p][None]) ** 2).sum(2) for p in range(4)]
        codes = [d.argmin(1) for d in near]
        for p in range(4 if step < 4 else 0):
            for k in set(codes[p].tolist()):
                members = x[codes[p] == k, p * 16 : p * 16 + 16]
                books[p][k] = members.sum(0) // len(members)
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    want = {i: ("".join(f"{codes[p][n]:02x}" for p in range(4)), sum(int(near[p][n].min()) for p in range(4))) for n, (i, _, _) in enumerate(sorted(rows))}
    labels = {}
    for i, _, label in rows:
        labels[label] = labels.get(label, 0) + want[i][1]
    assert {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()} == {i: (*want[i], labels[label], sha) for i, _, label in rows}


def test_ties_repeats_and_fewer_vectors_than_entries(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(40), [rng.choice([-1.0, -0.25, 0.0, 0.5]) for _ in range(8)], rng.choice([None, 1, 2])) for _ in range(120)]
    rows += rows[:30] + [(None, [0.5] * 8, 1)]
    assert run(spark, rows, entries=7) == brute(rows, entries=7)
    assert run(spark, rows[:5]) == brute(rows[:5])


def test_odd_vectors(spark):
    rows = [
        (1, None, 1), (2, [1.0, None], 1), (3, [float("nan")], 1), (4, [float("inf"), 0.0], 2), (5, [], 2), (6, [0.25, -0.3, 7.0, 1.0, 2.0], None),
        (7, [1e9] * 4, None), (8, [-1e9, 3.5, 1e17, 2.0], 3), (9, [1.7e308], 3)
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, entries=2, rounds=2) == brute(rows, entries=2, rounds=2)
    assert run(spark, [(5, [], 2)]) == brute([(5, [], 2)])
    rows = [(1, [0.0], 1), (2, [1.0], 1), (3, [1e9], 1)]
    assert run(spark, rows, entries=1, rounds=0) == brute(rows, entries=1, rounds=0)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)]])
def test_nothing_to_compress(spark, rows):
    assert run(spark, rows) == []


def test_whole_numbers_round_down():
    assert whole(np.array([-0.0001, 0.0009, 1.0, -1.0]), 1024).tolist() == [-1, 0, 1024, -1024]
    assert whole(np.array([2.0**60, 0.5]), 1024).tolist() == [2**70, 512]
