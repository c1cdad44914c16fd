import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from switchback.llm.packing import assign, op7_packing, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs):
    """Every id once, sequences gapless, lengths right; docs: {doc_id: ids}."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.array(docs[r.doc_id], "<u4")
        assert r.doc_tokens == len(ids) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_length))
    assert pieces.keys() == docs.keys()
    for found, want in [(v, len(docs[k])) for k, v in pieces.items()] + [([x[:2] for x in v], v[0][2]) for v in sequences.values()]:
        at = 0
        for s, n in sorted(found):
            assert s == at
            at += n
        assert at == want
    assert all(v[0][2] <= 1024 and v[0][2].bit_count() == 1 for v in sequences.values())
    return sequences


def test_assignment_is_whole_and_balanced():
    rng = random.Random(1)
    lengths = [rng.choice((1, 3, 50, 300, 800, 1024, 1025, 5000)) for _ in range(400)]
    pieces, sizes, costs = assign(lengths, 1024, 1.0, 1 / 1024)
    assert sum(sizes) == sum(lengths) == sum(p[2] for p in pieces)
    assert sum(n < 1024 for n in sizes) <= 10 and len(set(sizes[-10:])) >= 1
    lengths = [512] * 100 + [256] * 200 + [128] * 400
    _, sizes, costs = assign(lengths, 1024, 1.0, 1 / 1024)
    assert set(sizes) <= {1024, 512, 256} and max(costs[:-2]) < 1.35 * min(costs[:-2])
    assert assign([], 1024, 1, 1) == ([], [], [])


def test_query_over_small_tables(spark):
    t = Tokenizer.from_file(PATH)
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [0] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(op7_packing(spark, sf).collect(), docs)


def test_null_empty_long_and_repeated(spark):
    t = Tokenizer.from_file(PATH)
    rows = [(1, None), (2, ""), (3, "x " * 50000), (None, "some words")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, start int")
    check(pack(df, PATH, group_tokens=1000).collect(), {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in rows})
    assert pack(df.limit(0), PATH).collect() == []
    assert pack(df.where("doc_id = 2").union(df.where("doc_id = 2")), PATH).count() == 2


def test_sequences_are_rebuilt_from_the_pieces(spark):
    t = Tokenizer.from_file(PATH)
    docs = [(i, "word %d and more " % i * (1 + i * 7 % 300)) for i in range(1500)]
    rows = pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH, group_tokens=200_000).collect()
    sequences, back = defaultdict(dict), defaultdict(dict)
    for r in rows:
        assert len(r.ids) == r.length
        sequences[r.sequence_id][r.offset] = r.ids
        back[r.doc_id][r.start] = r.ids
    assert all(sum(map(len, x.values())) in {1 << b for b in range(11)} for x in sequences.values())
    for i, text in docs:
        assert [x for s in sorted(back[i]) for x in back[i][s]] == t.encode(text, add_special_tokens=False).ids + [0]


def test_long_runs_of_white_space(spark):
    t = Tokenizer.from_file(PATH)
    texts = [" " * 1_000_000, "a" + "\t" * 1_000_000 + "b", "x" + " " * 600_001 + "<|endoftext|>", "\n" * 5_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(pack(df, PATH).collect(), {i: t.encode(x, add_special_tokens=False).ids + [0] for i, x in enumerate(texts)})
