import random

from switchback.llm.graph import components


def test_long_chains_in_any_order(spark):
    rng = random.Random(7)
    ids = rng.sample(range(10**6), 1001)
    links = [*zip(ids, ids[1:]), (2_000_000, 2_000_001), (2_000_001, 2_000_000), (5_000_000, 5_000_000), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(ids, min(ids)), 2_000_000: 2_000_000, 2_000_001: 2_000_000}


def test_falling_and_adverse_chains(spark):
    fall = list(range(600, 0, -1))
    comb = [x for pair in zip(range(1000, 1150), range(2000, 2150)) for x in pair]  # ever smaller, larger, smaller
    links = [*zip(fall, fall[1:]), *zip(comb, comb[1:])]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(fall, 1), **dict.fromkeys(comb, 1000)}
