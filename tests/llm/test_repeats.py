import hashlib
import random

import numpy as np
import pytest

from switchback.llm import repeats
from switchback.llm.repeats import op11_suffix_dedup, suffix_order, without_repeats

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, n_bytes string, kept string"


def brute(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            t = (t or "").encode()
            for p in range(len(t) - 49):
                s = t[p : p + 50]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        t = (t or "").encode()
        gone = bytearray(len(t) + 1)
        for p in range(len(t) - 49) if i is not None else ():
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for p in range(len(t)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, tmp_path, rows, parts=5):
    spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r) for r in op11_suffix_dedup(spark, str(tmp_path)).collect()), key=str)


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op11_suffix_dedup(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == brute(rows) and sum(r[3] > 0 for r in got) > 50


def mutated(rng, alphabet, n):
    """Texts that share pieces of 40 to 300 letters at all offsets, copies, and texts of one letter or a short period."""
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40, 300))) for _ in range(12)]
    texts = ["".join(p[a : a + rng.randrange(30, 120)] for p in rng.choices(pool, k=6) for a in [rng.randrange(40)]) for _ in range(n)]
    return texts + texts[:5] + ["a" * 49, "a" * 50, "a" * 400, "b" * 51 + "a" * 60, "ab" * 90, "ba" * 90, "", None, "é" * 70, "xé" + "é" * 40, pool[0], pool[0][:50], pool[0][1:]]


@pytest.mark.parametrize("alphabet,hot,block,pack", [("ab", 0.0, 64, 500), ("abcdefgh \n", 0.01, 1 << 17, 1 << 23), ("abcé", 2.0, 97, 2000)])
def test_shared_pieces_match_brute_force(spark, tmp_path, monkeypatch, alphabet, hot, block, pack):
    """Blocks, packs and hot triggers of all sizes; the options reach the workers by the functions' module, so each is set there."""
    rng = random.Random(len(alphabet))
    rows = list(enumerate(mutated(rng, alphabet, 60)))
    rng.shuffle(rows)
    rows += [(None, rows[0][1]), (rows[1][0], rows[1][1]), (rows[2][0], rows[3][1]), (-5, rows[4][1]), (1 << 40, rows[5][1])]
    for name, value in (("HOT", hot), ("BLOCK", block), ("PACK", pack)):
        monkeypatch.setattr(repeats, name, value)
    made, want = [], brute(rows)
    # one process, without Spark: the same steps with the options set
    assert run(spark, tmp_path, rows) == want
    assert local(rows, made) == want and len(made) > (1 if pack < 5000 else 0)


def local(rows, made):
    """The operator's steps one after another in this process."""
    import pyarrow as pa

    class Context:
        partitionId = staticmethod(lambda: 0)

    held, repeats.TaskContext = repeats.TaskContext, type("T", (), {"get": staticmethod(lambda: Context)})
    try:
        table = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
        packs = [repeats.Pack(r) for b in repeats._packed([table]) for r in b.to_pylist()]
    finally:
        repeats.TaskContext = held
    made += packs
    counts = np.unique(np.concatenate([p.trigger for p in packs]), return_counts=True)
    hot = counts[0][counts[1] >= max(2, repeats.HOT * len(rows))] if repeats.HOT < 1 else np.zeros(0, np.uint64)
    entries, answers = {}, {}
    for p in packs:
        p.index(3, hot)
        for b, part in p.by_bucket():
            at = p.sample[part]
            entries.setdefault(b, []).append({"bucket": b, "pack": p.number, "n": len(at), "data": repeats._zip(p.trigger[at], p.spelling[at], p.least[part])})
    for b, e in sorted(entries.items()):
        for r in repeats._dictionary(hot)(pa.Table.from_pylist(e)).to_pylist():
            answers.setdefault(r["pack"], []).append(r)
    asked, said = {}, {}
    for p in packs:
        mine = answers.get(p.number, [])
        p.answered([r["bits"] for r in mine], [r["n"] for r in mine])
        start, count, first, bucket = p.asked(3)
        for b in sorted(set(bucket.tolist())):
            k = np.flatnonzero(bucket == b)
            texts = b"".join(p.data[s : s + c + 49].tobytes() for s, c in zip(start[k], count[k]))
            asked.setdefault(b, []).append(
                {"bucket": b, "pack": p.number, "n": len(k), "data": repeats._zip(count[k].astype(np.int32), first[k]), "texts": repeats.zstandard.compress(texts)}
            )
    for _, e in sorted(asked.items()):
        for r in repeats._suffixes(pa.Table.from_pylist(e)).to_pylist():
            said.setdefault(r["pack"], []).append(np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: r["n"]].astype(bool))
    out = []
    for p in packs:
        gone = p.removed(np.concatenate(said[p.number]) if p.number in said else np.zeros(0, bool))
        for d in range(len(p.ids)):
            part, text = gone[p.begins[d] : p.ends[d]], p.data[p.begins[d] : p.ends[d]]
            spans = int(np.count_nonzero(np.diff(np.concatenate([[0], part.view(np.int8)])) == 1))
            out.append((int(p.ids[d]) if p.known[d] else None, len(text), int(part.sum()), spans, hashlib.sha256(text[~part].tobytes()).hexdigest()))
    return sorted(out, key=str)


def test_long_text_and_empty_table(spark, tmp_path):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghij ") for _ in range(300_000))
    rows = [(1, long), (2, long[1000:9000] + "#" + long[200_000:200_080]), (0, long[150_000:150_055])]
    assert run(spark, tmp_path, rows) == brute(rows)
    assert without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_suffixes_stand_in_byte_order():
    data = np.frombuffer(("banana" * 40).encode(), np.uint8)
    order, new = suffix_order(data, np.arange(150))
    assert [bytes(data[i : i + 50]) for i in order] == sorted(bytes(data[i : i + 50]) for i in range(150)) and new.sum() == 6
