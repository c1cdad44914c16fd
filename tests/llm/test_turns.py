import hashlib
import random
import re
import zlib

import pytest

from switchback.llm import turns as module
from switchback.llm.turns import Repair, costs, damaged, digests, op12_conversation_repair, walk

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, place string, n int"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def cheapest(rows, faults):
    """All ways, turn by turn: of each state (none, s, u, a) the least (cost, audit) and its lines."""

    def insert(states):
        for _ in range(3):
            for q, (cost, audit, lines) in list(states.items()):
                to, name = ("a", "assistant") if q == "u" else ("u", "user")
                new = (cost + 3, audit + "I", [*lines, name + ":"])
                if to not in states or new[:2] < states[to][:2]:
                    states[to] = new
        return states

    states = {"": (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults):
        new = {}

        def offer(q, x):
            if q not in new or x[:2] < new[q][:2]:
                new[q] = x

        for q, (cost, audit, lines) in insert(states).items():
            offer(q, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if (q, role[:1]) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                offer(role[:1], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            to, name = ("a", "assistant") if q == "u" else ("u", "user")
            offer(to, (cost + 3 + more, audit + "R", [*lines, f"{name}:{text}"]))
        states = new
    ends = insert(states)
    return min((ends[q] for q in ("", "a") if q in ends), key=lambda x: x[:2])


def brute(rows, every):
    out = []
    for conv in {r[0] for r in every}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            visible = VISIBLE.findall(text)
            faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated")
            seen.add((role, text))
        known = {r[1] for r in mine if r[1] is not None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = cheapest(mine, faults)
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows(rng, convs, turns):
    texts = ["Yes.", "no", "", " \t", "So? ", "What!\n", None, "A. ", "x" * 40 + ".", "x" * 40 + "!"]
    return [
        (
            rng.choice([*range(convs), None]), rng.choice([*range(turns), None]),
            rng.choice(["user", "assistant", "system", "tool", "", None, "agent"]), rng.choice(texts)
        ) for _ in range(convs * turns)
    ]


def run(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "mine", 3) for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    return sorted((tuple(r) for r in op12_conversation_repair(spark, str(tmp_path)).collect()), key=str)


def test_query_matches_all_ways(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op12_conversation_repair(spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(harmed(rows), rows)


@pytest.mark.parametrize("stretch", [16, 1])
def test_odd_rows_match_all_ways(spark, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(module, "STRETCH", stretch)
    rng = random.Random(5)
    rows = odd_rows(rng, 12, 9) + [
        (77, 1, "user", None), (78, None, None, None), (79, 0, "system", "Be kind."), (79, 2**40, "user", "Hi."),
        (80, 1, "user", "long " * 200_000 + ".")
    ]
    rows += [(81, 5, "user", "Same.")] * 30
    assert run(spark, tmp_path, rows) == brute(harmed(rows), rows)


def test_one_conversation_in_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(module, "STRETCH", 2)
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "", f"{t}.", f"{t}?", str(t)])) for t in range(300)]
    table = spark.createDataFrame([(*r, "mine", 3) for r in rows], SCHEMA).repartition(4)
    repair = Repair(table)
    got = {r.conv_id: r for r in repair.summary().collect()}[1]
    want = brute(rows, rows)[0]
    assert (got.gaps, got.blank, got.duplicate, got.truncated, got.illegal, got.cost, got.audit) == want[1:-1]
    assert digests(repair.turns()).collect()[0].repaired_sha256 == want[-1]
    assert repair.stretches.count() > 50


def test_no_rows(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    assert damaged(spark.createDataFrame([], SCHEMA)).columns == ["conv_id", "turn", "role", "text"]


def test_running_minima_match_every_way():
    rng = random.Random(7)
    for _ in range(500):
        letters = "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(9)))
        rows = [(1, i, ("system", "user", "assistant", "tool")[(ord(c) - 97) // 3], "t") for i, c in enumerate(letters)]
        faults = [("", "truncated", "blank")[(ord(c) - 97) % 3] for c in letters]
        cost = costs(letters, module.END)
        want = cheapest(rows, faults)
        assert cost[0][0] == want[0] and walk(letters, cost, 0, True)[0] == want[1]
