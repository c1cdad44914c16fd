import hashlib
import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from switchback.llm.bpe import Coder, build_lexicon, encode_decode, frequent_words, op2_bpe
from switchback.llm.lexicon import Lexicon, compile_lexicon

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "the", "Hello", " ", "  ", "\n", "\n\n", "\t", "\r\n", "it's", "'ll", "é", "日本", "１２", "½", "x²", " ", " ", "\u0085", "\x1c", "\x1f", "​", "🙂",
    "<|endoftext|>", "<|endof", "12345", "###", "a_b", "Ⅷ", "क्षि", "\x00", "ß", "　", "﻿", "|", "'", "don", "t", "-", "ﬁ", "'S"
]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_lexicon_holds_exactly_its_words(tmp_path):
    rng = random.Random(1)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))): tuple(rng.randrange(50000) for _ in range(rng.randrange(1, 4))) for _ in range(3000)}
    (tmp_path / "x").write_bytes(compile_lexicon(words.items()))
    lexicon = Lexicon(str(tmp_path / "x"))
    assert all(lexicon.get(w) == ids for w, ids in words.items())
    assert all((lexicon.get(w) is None) == (w not in words) for w in [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 9))) for _ in range(3000)])
    asked = [*words, b"", b"zz", *(w + b"a" for w in words), *(w[:-1] for w in words)]
    assert lexicon.find(asked) == [None if lexicon.get(w) is None else array("I", lexicon.get(w)).tobytes() for w in asked]
    assert lexicon.find([]) == []
    assert lexicon.states < 1 + sum(map(len, words)) / 4


def test_suffixes_are_shared(tmp_path):
    (tmp_path / "x").write_bytes(compile_lexicon([(a + b"tion", (1,)) for a in (b"a", b"b", b"c")]))
    assert Lexicon(str(tmp_path / "x")).states == 6


def test_empty_lexicon(tmp_path):
    (tmp_path / "x").write_bytes(compile_lexicon([]))
    assert Lexicon(str(tmp_path / "x")).get(b"a") is None


def test_random_texts_match_the_library(reference, tmp_path):
    rng = random.Random(2)
    (tmp_path / "x").write_bytes(compile_lexicon([(b" the", tuple(reference.encode(" the").ids)), (b" Hello", tuple(reference.encode(" Hello").ids))]))
    for c in (Coder(PATH), Coder(PATH, str(tmp_path / "x"), most_known=50)):
        for _ in range(3000):
            text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 12)))
            want = reference.encode(text, add_special_tokens=False).ids
            assert c.ids(text).tolist() == want, repr(text)
            assert c.decode(want) == reference.decode(want, skip_special_tokens=False)


def test_long_pieces(reference):
    rng = random.Random(3)
    for text in ("a" * 5000, "".join(rng.choice("abcdefgh") for _ in range(3000)), "=" * 999, "é" * 700):
        assert Coder(PATH).ids(text).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_every_code_point_matches(reference):
    c = Coder(PATH)
    for at in range(0, 0x11000, 97):
        text = "".join(f"a{chr(i)} {chr(i)}b" for i in range(at, at + 97) if not 0xD800 <= i < 0xE000)
        assert c.ids(text).tolist() == reference.encode(text, add_special_tokens=False).ids, at


def test_null_empty_long_and_repeated_rows(spark, reference):
    texts = [(1, None), (2, ""), (3, "the the\nthe end"), (3, "the the\nthe end"), (None, "the"), (4, "word " * 60000)]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or 0, r.ids, r.decoded) for r in encode_decode(df, PATH, 3).collect()), key=str)
    assert got == sorted(((i or 0, reference.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in texts), key=str)
    assert encode_decode(df.limit(0), PATH).collect() == []
    assert len(build_lexicon(df.limit(0), PATH)) > 0


def test_query_matches_the_library(spark, reference):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in op2_bpe(spark, sf).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(reference.decode(ids, skip_special_tokens=False)))


RUNS = [
    " " * 1_000_000, " " * 5_000_000, "\t" * 1_000_000, "\n" * 1_000_001 + "x", " \n" * 500_000 + "end",
    "a" + " " * 700_001 + "<|endoftext|>" + " " * 9 + "b", "one\n\n  two\r\n\r\n three  four \n"
]


def test_long_runs_of_white_space_through_spark(spark, reference):
    want = [reference.encode(t, add_special_tokens=False).ids for t in RUNS]
    df = spark.createDataFrame(list(enumerate(RUNS)), "doc_id long, text string")
    got = {r.doc_id: (r.ids, r.decoded) for r in encode_decode(df, PATH).collect()}
    assert all(got[i] == (ids, RUNS[i]) for i, ids in enumerate(want))


def test_random_white_space_matches_by_all_ways(reference):
    rng, c = random.Random(8), Coder(PATH)
    parts = [" ", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "\x85", "\x1c", "word", "Word,", "12", "é", "'s", "<|endoftext|>", " " * 600, "\n" * 700, "#!"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))
        want = reference.encode(text, add_special_tokens=False).ids
        assert c.ids(text).tolist() == want and array("I", c.whole(text)).tolist() == want, repr(text)


def test_merging_many_pieces_is_merging_each(reference):
    rng, merges = random.Random(4), Coder(PATH).merges
    pieces = [bytes(rng.choice(b"aeinrst \xc3\xa9") for _ in range(rng.randrange(1, 90))) for _ in range(2000)]
    assert [array("I", x).tolist() for x in merges.many(pieces)] == [merges.one(p) for p in pieces]
    long = bytes(rng.choice(b"abab ab") for _ in range(9000))
    whole = merges.one(long)
    merges.ordered = False  # no rounds: the heap alone
    assert whole == merges.one(long)


def test_lexicon_serves_texts_with_blank_lines_and_runs(tmp_path, reference, monkeypatch):
    words = [" the", " quick", " end"]
    (tmp_path / "x").write_bytes(compile_lexicon((w.encode(), tuple(reference.encode(w).ids)) for w in words))
    c, merged = Coder(PATH, str(tmp_path / "x")), []
    many = c.merges.many
    monkeypatch.setattr(c.merges, "many", lambda pieces: merged.extend(pieces) or many(pieces))
    text = "x the quick the\n\nz the  quick \n\n\n the end\tend the, \n"
    c.buffers([text])
    assert c.ids(text).tolist() == reference.encode(text, add_special_tokens=False).ids
    assert not {w.encode() for w in words} & set(merged) and b"," in merged  # only what the lexicon lacks is merged


def test_words_are_chosen_within_a_bin(spark):
    docs = spark.createDataFrame([(" ".join(["x", *(f"w{i}" for i in range(500))]),)] * 2 + [("x top top top " + "y" * 500 + " ",)], "text string")
    got = {r.word: r.n for r in frequent_words(docs, 400).collect()}
    assert 300 < len(got) <= 400 and got["top"] == 3 and max(map(len, got)) <= 64
    assert frequent_words(docs, 501).count() == 501 and frequent_words(docs, 0).count() == 0
