import pyarrow as pa

from switchback.llm.ngram_join import jaccard_components, one_of_each
from switchback.llm.quality_rules import _count
from switchback.llm.resampling import _features
from switchback.llm.textnp import cut_words, text_blocks


def colliding(letters="ab", doublings=12):
    """The Thue-Morse word and its complement: equal under every polynomial modulo 2 ** 64."""
    a, b = letters
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def words_of(texts):
    (_, _, data, offsets), = text_blocks(pa.array(texts), 1 << 30)
    return cut_words(data, offsets)


def test_words_of_all_lengths_have_hashes_of_their_own():
    words = ["x" * n for n in range(1, 40)] + ["a" * 8 + "b" * 8, "b" * 8 + "a" * 8, "x\0", "y" * 100_000, *colliding(), *colliding("xy", 3)]
    both = [set(words_of([" ".join(words)]).hashes(seed).tolist()) for seed in (0, 1)]
    assert len(both[0]) == len(both[1]) == len(words) and not both[0] & both[1]
    assert len(words_of(["", " \n"]).hashes()) == 0


def test_hash_of_a_word_does_not_depend_on_its_surroundings():
    one, two = words_of(["hello worldwide"]).hashes(), words_of(["zz", "worldwide,", "x worldwide hello"]).hashes()
    assert one[1] == two[3] and one[0] == two[4] and one[1] != two[1]


def test_words_that_collide_under_polynomials_stay_apart(spark):
    a, b = colliding()
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} and more words of it"), (4, f"{b} and more words of it")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs, 4, 85).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    assert one_of_each(docs).count() == 4
    buckets = [set(_features(*[x for x in text_blocks(pa.array([t]))][0][2:], 20)[0].tolist()) for t in (a, b)]
    assert buckets[0].isdisjoint(buckets[1])


def test_lines_that_collide_under_polynomials_are_different():
    a, b = colliding()
    assert _count(pa.array([f"{a}\n{b}", f"{a}\n{a}"]))["n_dup_lines"].tolist() == [0, 1]
