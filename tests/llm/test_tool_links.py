import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from switchback.llm.tool_links import OP8_SQL, canonical, canonical_text, link_tools, op8_tool_links, schema_nodes

TOOLS = {
    "add": {
        "properties": {"a": {"type": "integer"}, "b": {"type": "number"}, "how": {"type": "string", "enum": ["fast", "slow"], "maxLength": 4}},
        "required": ["a", "b"], "additionalProperties": False
    },
    "free": {"properties": {}},
}
KIND = "conv_id long, turn long, role string, text string, id string, row long"


def call(i, name="add", after=(), **arguments):
    return {"id": i, "name": name, "arguments": arguments, "after": list(after)}


def run(spark, rows):
    df = spark.createDataFrame([(c, t, role, json.dumps(x, ensure_ascii=False) if isinstance(x, dict) else x, "id", 0) for c, t, role, x in rows], KIND)
    return link_tools(df, TOOLS).collect()


def test_links_validation_and_canonical_lines(spark):
    rows = [
        (1, 0, "system", "hello {"),
        (
            1, 1, "assistant",
            {"tool_calls": [call("x", b=2.5, a=1), call("y", a="1", c=3), call("z", name="none"), call("w", name="free", z={"b": 1, "a": [1, {"d": 1, "c": "é\n"}]}, how=None)]}
        ),
        (1, 2, "tool", {"tool_call_id": "y", "content": {"q": 1, "p": "2"}}),
        (1, 3, "tool", {"tool_call_id": "x", "content": "12"}),
        (1, 4, "tool", {"tool_call_id": "x", "content": "again"}),
        (1, 5, "tool", {"tool_call_id": "gone", "content": None}),
        (1, 6, "assistant", {"tool_calls": [{"id": "x", "name": "add", "arguments": '{"a": 1, "b": 1, "how": "later"}'}]}),
        (1, 7, "assistant", {"tool_calls": [{"id": "s", "name": "add", "arguments": "no json"}, {"id": None, "name": "free", "arguments": [1]}]}),
        (1, 8, "assistant", '{"tool_calls": [], "tool_calls": []}'),
        (2, 1, "tool", {"tool_call_id": "z", "content": 1}),
        (None, 0, "user", None),
        (None, 1, "assistant", ""),
    ]
    got = {(r.conv_id, r.turn, r.part): r for r in run(spark, rows)}
    brief = {k: (r.kind, r.status, r.errors) for k, r in got.items()}
    assert brief == {
        (1, 0, 0): ("message", "plain", ""),
        (1, 1, 0): ("call", "linked", ""),
        (1, 1, 1): ("call", "linked", "missing:b,type:a,unexpected:c"),
        (1, 1, 2): ("call", "unanswered", "unknown_tool"),
        (1, 1, 3): ("call", "unanswered", ""),
        (1, 2, 0): ("result", "linked", ""),
        (1, 3, 0): ("result", "linked", ""),
        (1, 4, 0): ("result", "repeated", ""),
        (1, 5, 0): ("result", "orphan", ""),
        (1, 6, 0): ("call", "duplicate", "long:how,option:how"),
        (1, 7, 0): ("call", "unanswered", "no_arguments"),
        (1, 7, 1): ("call", "unanswered", "not_an_object"),
        (1, 8, 0): ("message", "plain", ""),
        (2, 1, 0): ("result", "orphan", ""),
        (None, 0, 0): ("message", "plain", ""),
        (None, 1, 0): ("message", "plain", ""),
    }
    assert got[1, 1, 0].line == '{"arguments":{"a":1,"b":2.5},"id":"x","kind":"call","name":"add","role":"assistant","turn":1}'
    assert got[1, 1, 3].line == '{"arguments":{"how":null,"z":{"a":[1,{"c":"é\\n","d":1}],"b":1}},"id":"w","kind":"call","name":"free","role":"assistant","turn":1}'
    assert got[1, 2, 0].line == '{"content":{"p":"2","q":1},"id":"y","kind":"result","role":"tool","turn":2}'
    assert got[None, 0, 0].line == '{"kind":"message","role":"user","turn":0}'


def test_order_is_topological(spark):
    rows = [
        (1, 0, "assistant", {"tool_calls": [call("a", "free", after=["b"]), call("b", "free"), call("c", "free", after=["a", "lost"]), call("e", "free")]}),
        (1, 1, "user", "words"),
        (1, 2, "tool", {"tool_call_id": "b", "content": 1}),
        (1, 3, "tool", {"tool_call_id": "a", "content": 1}),
        (1, 4, "user", "more words"),
        (1, 5, "tool", {"tool_call_id": "c", "content": 1}),
        (2, 0, "assistant", {"tool_calls": [call("a", "free", after=["b"]), call("b", "free", after=["a"]), call("c", "free")]}),
        (3, 0, "tool", {"tool_call_id": "a", "content": 1}),
        (3, 4, "assistant", {"tool_calls": [call("a", "free")]}),
    ]
    got = sorted(run(spark, rows), key=lambda r: (r.conv_id, r.ready, r.depth, r.turn, r.part))
    order = [(r.kind, r.call_id) for r in got if r.conv_id == 1]
    assert order == [("call", "b"), ("call", "e"), ("message", None), ("result", "b"), ("call", "a"), ("result", "a"), ("call", "c"), ("message", None), ("result", "c")]
    assert {r.call_id: r.n_missing for r in got if r.conv_id == 1 and r.kind == "call"} == {"a": 0, "b": 0, "c": 1, "e": 0}
    assert {r.call_id: r.cyclic for r in got if r.conv_id == 2} == {"a": True, "b": True, "c": False}
    assert not any(r.cyclic for r in got if r.conv_id != 2)
    assert [r.kind for r in got if r.conv_id == 3] == ["call", "result"]


def test_hot_id_repeats_and_empty_table(spark):
    rows = [(1, 0, "assistant", {"tool_calls": [call("a", a=1, b=1)]})] * 200 + [(1, 1, "tool", {"tool_call_id": "a", "content": "x" * 100_000})] * 3
    got = run(spark, rows)
    assert len(got) == 203 and sorted(r.status for r in got) == ["duplicate"] * 199 + ["linked"] * 2 + ["repeated"] * 2
    assert link_tools(spark.createDataFrame([], KIND), TOOLS).collect() == []


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    df = op8_tool_links(spark, sf)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, db.execute(f"SELECT {', '.join(df.columns)} FROM ({OP8_SQL})").fetchall()))


KEYWORDS = {
    "n": {"type": "number", "minimum": 5, "exclusiveMaximum": 9.5},
    "e": {"enum": [1, 2, "x", None, {"b": 1.50, "a": [True]}]},
    "s": {"type": ["string", "null"], "minLength": 2, "pattern": "^[a-c]+$"},
    "o": {
        "type": "object",
        "properties": {"z": {"type": "string"}, "deep": {"type": "array", "items": {"type": "array", "items": {"type": "integer"}}}},
        "required": ["z"], "additionalProperties": False
    },
    "l": {"type": "array", "items": {"const": 3}, "minItems": 1, "maxItems": 2, "description": "no more than two"},
    "no": False,
}


@pytest.mark.parametrize(
    ("arguments", "errors"),
    [
        ({"n": 5, "e": 1.0, "s": "ab", "o": {"z": "", "deep": [[1, 2.0], []]}, "l": [3, 3.0]}, ""),
        ({"n": 4.99}, "small:n"), ({"n": 9.5}, "large:n"), ({"n": "7"}, "type:n"), ({"n": 1e1}, "large:n"),
        ({"e": 7}, "option:e"), ({"e": {"a": [True], "b": 1.5}}, ""), ({"e": None}, ""), ({"e": "1"}, "option:e"),
        ({"s": None}, ""), ({"s": "x"}, "pattern:s,short:s"), ({"s": 3}, "type:s"),
        ({"o": {"z": 3}}, "type:o.z"), ({"o": {"y": 1}}, "missing:o.z,unexpected:o.y"), (
            {"o": {"z": "", "deep": [[1], ["2", 3.5], 4]}}, "type:o.deep[1][0],type:o.deep[1][1],type:o.deep[2]"
        ),
        ({"l": []}, "few:l"), ({"l": [3, 4, 3]}, "many:l,option:l[1]"), ({"no": 1}, "type:no"), ({"unheard": 1}, ""),
    ],
)
def test_schema_keywords(spark, arguments, errors):
    df = spark.createDataFrame(
        [(1, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "t", "arguments": arguments}]}))],
        "conv_id long, turn long, role string, text string"
    )
    assert [r.errors for r in link_tools(df, {"t": {"type": "object", "properties": KEYWORDS}, **{f"other{i}": {} for i in range(1500)}}).collect()] == [errors]


def test_unknown_keywords_are_refused():
    for bad in ({"oneOf": []}, {"properties": {"a": {"multipleOf": 2}}}, {"additionalProperties": {"type": "string"}}):
        with pytest.raises(ValueError, match="not supported"):
            schema_nodes({"t": bad})


def test_equal_numbers_have_one_text(spark):
    same = {
        "1": ["1", "1.0", "1e0", "10E-1", "0.1e1"], "0": ["0", "-0", "0.0", "-0e5"], "1.5": ["1.5", "1.50", "15e-1"],
        "1e+21": ["1e21", "1000000000000000000000", "1000000000000000000000.0"], "-1e-7": ["-1e-7", "-0.0000001", "-0.10e-6"],
        "0.000001": ["1e-6", "0.0000010"], "123456789012345678901": ["123456789012345678901"],
        "9007199254740993": ["9007199254740993", "9007199254740993.0", "9.007199254740993e15"]
    }
    rows = [(w, x) for w, xs in same.items() for x in xs]
    got = spark.createDataFrame(rows, "want string, x string").select(
        "want", canonical_text(F.col("x")).alias("got"),
        canonical_text(F.concat(F.lit('{"a\\\\":['), "x", F.lit(',"1.0 \\" 2e5 \\u001F"]}'))).alias("inside")
    ).collect()
    assert all(r.got == r.want and r.inside == '{"a\\\\":[' + r.want + ',"1.0 \\" 2e5 \\u001f"]}' for r in got)
    assert [canonical(x) for x in (1.0, 1e21, -1e-7, 1.50, 10**20, 0.0, 1e-6, 12e3)] == ["1", "1e+21", "-1e-7", "1.5", "100000000000000000000", "0", "0.000001", "12000"]
    rows = [(1, 0, "assistant", '{"tool_calls": [{"id": "a", "name": "free", "arguments": {"x": %s, "y": "1e0"}}]}' % x) for x in same["1"] + ["1.00"]]
    lines = {r.line for r in link_tools(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOLS).collect()}
    assert lines == {'{"arguments":{"x":1,"y":"1e0"},"id":"a","kind":"call","name":"free","role":"assistant","turn":0}'}


def places_brute(calls, results):
    """calls: {id: (turn, deps)}; results: {id: turn}."""
    label = {}
    while True:
        new = {}
        for i, (turn, deps) in calls.items():
            if i not in label and all(d in label for d in deps if d in calls):
                best = (turn, 0)
                for d in deps:
                    if d in calls:
                        ready, depth = label[d]
                        if d in results:
                            ready, depth = (results[d], 0) if results[d] > ready else (ready, depth + 1)
                        best = max(best, (ready, depth + 1) if ready >= turn else (turn, 0))
                new[i] = best
        if not new:
            return {i: (*label.get(i, (turn, 0)), i not in label) for i, (turn, _) in calls.items()}
        label |= new


def test_places_match_brute_force(spark):
    rng, rows, want = random.Random(6), [], {}
    for conv in range(60):
        n = rng.randrange(1, 14)
        calls = {
            f"c{i}": (
                rng.randrange(6),
                [f"c{rng.randrange(n + 1)}" for _ in range(rng.choice((0, 1, 1, 1, 2, 3)))] if conv % 3 else [f"c{j}" for j in rng.sample(range(i), min(i, rng.choice((0, 1, 2))))]
            ) for i in range(n)
        }
        results = {i: rng.randrange(8) for i in calls if rng.random() < 0.7}
        rows += [(conv, turn, "assistant", {"tool_calls": [call(i, "free", after=deps)]}) for i, (turn, deps) in calls.items()]
        rows += [(conv, turn, "tool", {"tool_call_id": i, "content": 1}) for i, turn in results.items()]
        want |= {(conv, i): x for i, x in places_brute(calls, results).items()}
    got = {(r.conv_id, r.call_id): (r.ready, r.depth, r.cyclic) for r in run(spark, rows) if r.kind == "call"}
    assert got == want and sum(x[2] for x in want.values()) > 20 and max(x[1] for x in want.values()) > 3


def test_long_chain_and_ring(spark):
    ring = [
        (1, 0, "assistant", {"tool_calls": [call(f"r{i}", "free", after=[f"r{(i + 1) % 1000}"]) for i in range(1000)]}),
        (1, 0, "assistant", {"tool_calls": [call("behind", "free", after=["r5"]), call("alone", "free", after=["alone"])]})
    ]
    chain = [(2, 0, "assistant", {"tool_calls": [call(f"k{i}", "free", after=[f"k{i + 1}"] if i < 999 else []) for i in range(1000)]})]
    got = run(spark, ring + chain)
    assert all(r.cyclic for r in got if r.conv_id == 1)
    assert {r.call_id: r.depth for r in got if r.conv_id == 2} == {f"k{i}": 999 - i for i in range(1000)}
