"""Conversations repaired at least cost: a dynamic programme over the turns that stay, in stretches that tasks share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches, written

#: Turns of a stretch at most, as a power of 2.
STRETCH = 16
#: Prices of a deletion, of an insertion or a new role, and of a truncated turn that stays.
DELETE, CHANGE, TRUNCATED = 4, 3, 3
FAR = 1 << 60
#: The last role so far: none, system, user, assistant. What inserting the rest costs where the conversation ends.
NONE, SYSTEM, USER, ASSISTANT = range(4)
END = (0, 2 * CHANGE, CHANGE, 0)
NAMES = ("", "system", "user", "assistant")
#: A turn's letter tells its role's initial (s, u, a, other) and its fault (none, truncated, blank or duplicate).
LETTERS = "abcdefghijkl"
LONGS = T.ArrayType(T.LongType())
SPACES = " \t\n\x0b\f\r"


def costs(letters: str, end: tuple) -> list[tuple]:
    """For each place between the turns, the least cost of all that follows, by the last role so far; ``end`` is that of what follows the last turn.

    Turns that stay, with their own role or a new one, form a subsequence. From the last one to the first, running minima by role hold the prefix sum of
    deletions before a turn plus the price of its staying and of all after it; the gap from the last role so far costs the difference of prefix sums, and the pair of roles says
    what must be inserted there.
    """
    n, after = len(letters), end
    system = user = assistant = FAR
    out = [end]
    for j in range(n - 1, -1, -1):
        role, fault = divmod(ord(letters[j]) - 97, 3)
        before = DELETE * j
        if fault < 2:
            price = before + TRUNCATED * fault
            if role == 0:
                system = min(system, price + after[SYSTEM])
            user = min(user, price + (0 if role == 1 else CHANGE) + after[USER])
            assistant = min(assistant, price + (0 if role == 2 else CHANGE) + after[ASSISTANT])
        gone, u, a = DELETE * n - before, user - before, assistant - before
        next_user = min(u, a + CHANGE)
        after = (min(system - before, next_user, gone + end[0]), min(next_user, gone + end[1]), min(u + CHANGE, a, gone + end[2]), min(next_user, gone + end[3]))
        out.append(after)
    out.reverse()
    return out


def walk(letters: str, cost: list[tuple], role: int, last: bool) -> tuple[str, int]:
    """(audit, last role) of the cheapest edits from a role on, the least audit among equals: at each step the least letter that costs() allows."""
    audit = []
    for j, letter in enumerate(letters):
        own, fault = divmod(ord(letter) - 97, 3)
        then = cost[j + 1]
        while True:
            now, fits = cost[j][role], ASSISTANT if role == USER else USER
            if DELETE + then[role] == now:
                audit.append("D")
                break
            if CHANGE + cost[j][fits] == now:
                audit.append("I")
                role = fits
                continue
            kept = SYSTEM if own == 0 and role == NONE else fits if own + 1 == fits else None
            if kept is not None and TRUNCATED * fault + then[kept] == now:
                audit.append("K")
                role = kept
            else:
                audit.append("R")
                role = fits
            break
    while last and END[role]:
        audit.append("I")
        role = ASSISTANT if role == USER else USER
    return "".join(audit), role


def repaired_lines(piece: str, before: int, role: str, text: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that stay or are inserted, by a turn's piece of the audit and the last role before it."""
    state = before
    for edit in piece:
        if edit == "D":
            continue
        fits = ASSISTANT if state == USER else USER
        if edit == "K":
            yield edit, role, text
            state = SYSTEM if role[:1] == "s" else fits
        else:
            yield edit, NAMES[fits], text if edit == "R" else ""
            state = fits


@F.pandas_udf(LONGS)
def _transfer(letters: pd.Series) -> pd.Series:
    """Least costs from each role at a stretch's start to each at its end, then the pairs of neighbours of wrong roles, and the first and last initial."""

    def one(x: str) -> list[int]:
        by_end = [costs(x, tuple(0 if q == r else FAR for r in range(4)))[0] for q in range(4)]
        roles = "".join("suax"[(ord(c) - 97) // 3] for c in x)
        wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        return [min(by_end[q][p], FAR) for p in range(4) for q in range(4)] + [wrong, ord(roles[0]), ord(roles[-1])]

    return letters.map(one)


@F.pandas_udf(T.StructType().add("ends", T.ArrayType(LONGS)).add("cost", T.LongType()).add("illegal", T.LongType()))
def _ends(stretches: pd.Series) -> pd.DataFrame:
    """Of a conversation's stretches in order: the least costs of all that follows each, of the whole, and the pairs of wrong roles."""

    def one(found) -> tuple:
        after, ends, illegal = END, [], 0
        for i in range(len(found) - 1, -1, -1):
            t = [int(x) for x in found[i]]
            ends.append(list(after))
            illegal += t[16] + (i > 0 and chr(found[i - 1][18]) + chr(t[17]) not in ("su", "ua", "au"))
            after = tuple(min(t[4 * p + q] + after[q] for q in range(4)) for p in range(4))
        return ends[::-1], after[NONE], illegal

    return pd.DataFrame([one(x) for x in stretches], columns=["ends", "cost", "illegal"])


@F.pandas_udf(T.StructType().add("audits", T.ArrayType(T.StringType())).add("roles", LONGS))
def _solve(letters: pd.Series, end: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
    """By the last role before a stretch: its audit and the last role after it."""

    def one(x, e, is_first, is_last) -> tuple:
        cost = costs(x, tuple(int(v) for v in e))
        found = [walk(x, cost, role, is_last) for role in range(1 if is_first else 4)]
        return [a for a, _ in found], [r for _, r in found]

    return pd.DataFrame([one(*x) for x in zip(letters, end, first, last)], columns=["audits", "roles"])


@F.pandas_udf(LONGS)
def _starts(roles: pd.Series) -> pd.Series:
    """The last role before each stretch of a conversation, in order."""

    def one(found) -> list[int]:
        at = [NONE]
        for by_start in found:
            at.append(int(by_start[at[-1]]))
        return at[:-1]

    return roles.map(one)


def _in_order(key: str, *values: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(key, *values)))


def placed_turns(turns: DataFrame) -> DataFrame:
    """(place, conv_id, turn, role, text, n): the different turns in order, as a written table; place grows with conv_id, turn (nulls first), role, text.

    n counts rows that are equal in all four; nulls in role and text are one space. Rows are dealt by ranges of the order, so that one conversation may lie in many tasks.
    """
    space = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    rows = turns.select("conv_id", "turn", space("role"), space("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return written(ranged.select(F.monotonically_increasing_id().alias("place"), "*"), "turns")


class Repair:
    """The repair of turns (conv_id, turn, role, text; other columns are left alone). Tables are worked out when made.

    A conversation's rows stand by turn (nulls first), rows of one turn by role and text. A row's first fault counts: blank (no visible character), duplicate (role and text
    seen earlier), truncated (the last visible character is none of .!?). Blank and duplicate rows must be deleted (4); others are kept, get the role user or assistant (3) or are
    deleted; empty turns may be inserted (3); a truncated row that stays costs 3 more. Roles must then read (s?(ua)+)? by their initials, at least cost, ties to the
    least audit. Null roles and texts are one space; null conv_ids are one conversation; a table without rows has no conversations.

    The work on letters (one a row) is cut into stretches of 65,536 rows at most: each gives the costs from role to role over it, these are put together by conversation, and each
    stretch is solved again with what follows known. No text is in these steps, and no conversation's rows are in one task.
    """

    def __init__(self, turns: DataFrame) -> None:
        small_batches(turns.sparkSession)
        self.rows = placed_turns(turns)
        visible = F.rtrim("text", F.lit(SPACES))
        firsts = self.rows.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
        marked = self.rows.select(
            "place", "conv_id", "n", F.substring("role", 1, 1).alias("initial"), (F.length(visible) == 0).alias("blank"),
            F.substring(visible, -1, 1).isin(".", "!", "?").alias("ends")
        )
        marked = marked.join(firsts, "place", "left")
        new = ~F.col("blank") & F.col("first").isNotNull()
        role = 3 * F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
        letter = lambda fault: F.substring(F.lit(LETTERS), role + fault + 1, F.lit(1))
        # further rows that are equal in all are duplicates, or blank
        letters = F.concat(
            F.when(new, F.when(F.col("ends"), letter(F.lit(0))).otherwise(letter(F.lit(1)))).otherwise(letter(F.lit(2))),
            F.repeat(letter(F.lit(2)), (F.col("n") - 1).cast("int"))
        )
        self.marks = written(
            marked.select(
                "place", "conv_id", "n", "blank", (~F.col("blank")).cast("long").alias("said"), new.alias("new"),
                (new & ~F.col("ends")).alias("truncated"), letters.alias("letters")
            ),
            "marks"
        )
        stretches = self.marks.groupBy("conv_id", F.shiftright("place", STRETCH)).agg(F.min("place").alias("at"), _in_order("place", "letters").alias("found"))
        stretches = written(
            stretches.select(
                "conv_id", "at", F.array_join(F.col("found.letters"), "").alias("letters"),
                F.transform(
                    "found",
                    lambda x: F.struct(x.place.alias("place"), F.length(x.letters).alias("n"), F.substring(x.letters, 1, 1).isin("a", "b", "c").alias("system"))
                ).alias("turns")
            ),
            "stretches"
        )
        listed = stretches.select("conv_id", "at", _transfer("letters").alias("transfer")).groupBy("conv_id").agg(_in_order("at", "transfer").alias("found"))
        self.whole = written(listed.select("conv_id", F.col("found.at").alias("ats"), _ends(F.col("found.transfer")).alias("end")).select("conv_id", "ats", "end.*"), "ends")
        ends = self.whole.select(F.posexplode(F.arrays_zip("ats", "ends")).alias("i", "x"), F.size("ats").alias("of")).select(
            F.col("x.ats").alias("at"), F.col("x.ends").alias("end"), (F.col("i") == 0).alias("first"), (F.col("i") == F.col("of") - 1).alias("last")
        )
        solved = stretches.join(ends, "at").select("conv_id", "at", "turns", _solve("letters", "end", "first", "last").alias("found"))
        solved = written(solved.select("conv_id", "at", "turns", "found.*"), "solved")
        starts = solved.groupBy("conv_id").agg(_in_order("at", "roles").alias("found")).select(
            F.explode(F.arrays_zip(F.col("found.at").alias("at"), _starts(F.col("found.roles")).alias("role"))).alias("x")
        )
        starts = starts.select(F.col("x.at").alias("at"), F.col("x.role").alias("before"))
        self.stretches = written(
            solved.join(starts, "at").select("conv_id", "at", "turns", F.col("before").cast("int").alias("before"), F.get("audits", F.col("before").cast("int")).alias("audit")),
            "edits"
        )

    def summary(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs) and audit of every conversation."""
        turns = self.rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
        count = lambda x, name: F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias(name)
        n, blank, new = F.col("n"), F.col("blank"), F.col("new")
        faults = self.marks.groupBy("conv_id").agg(
            count(F.when(blank, n), "blank"), count(F.when(~blank, n - new.cast("long")), "duplicate"), count(F.col("truncated"), "truncated")
        )
        audits = self.stretches.groupBy("conv_id").agg(F.array_join(_in_order("at", "audit")["audit"], "").alias("audit"))
        parts = [turns, faults, self.whole.select("conv_id", "illegal", "cost"), audits]
        joined = parts[0]
        for x in parts[1:]:
            joined = joined.unionByName(x, allowMissingColumns=True)
        return joined.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")))

    def turns(self) -> DataFrame:
        """conv_id, place, k, edit (K, R, I), role, text of the repaired turns; a conversation's are in order by place and k."""

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for turns, role, audit in zip(batch.column("turns").to_pylist(), batch.column("before").to_pylist(), batch.column("audit").to_pylist()):
                    places, found, before, at = [], [], [], 0
                    for i, turn in enumerate(turns):
                        start, left = at, turn["n"]
                        while left or (i == len(turns) - 1 and at < len(audit)):
                            left -= audit[at] != "I"
                            at += 1
                        places.append(turn["place"])
                        found.append(audit[start:at])
                        before.append(role)
                        for edit in audit[start:at]:
                            if edit != "D":
                                role = SYSTEM if edit == "K" and turn["system"] else ASSISTANT if role == USER else USER
                    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(found, pa.string()), pa.array(before, pa.int32())], ["place", "piece", "before"])

        def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for conv, place, role, text, piece, before in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text", "piece", "before"))):
                    out += ((conv, place, k, *line) for k, line in enumerate(repaired_lines(piece, before, role, text)))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)

        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("k", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        found = self.stretches.mapInArrow(pieces, "place long, piece string, before int")
        rows = self.rows.select(F.col("conv_id").cast("long").alias("conv_id"), "place", "role", "text").join(found, "place")
        return rows.mapInArrow(lines, "conv_id long, place long, k long, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of Repair.turns(): lowercase hex of `role:text`, joined by newlines. A conversation without turns has no row.

    A hash goes from byte to byte, so that a conversation's turns pass one task as a sorted stream, a batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, sha = [], (), None
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if now != (conv,):
                    done += [(*now, sha.hexdigest())] if now else []
                    now, sha = (conv,), hashlib.sha256(f"{role}:{text}".encode())
                else:
                    sha.update(f"\n{role}:{text}".encode())
        done += [(*now, sha.hexdigest())] if now else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], ["conv_id", "repaired_sha256"])

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "place", "k").mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 takes [.!?] from it, 3 repeats it, 4 makes its role user. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault != 0")
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")
    ).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged and repaired."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    repair = Repair(damaged(turns))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = turns.select("conv_id").distinct().unionByName(repair.summary(), allowMissingColumns=True).unionByName(digests(repair.turns()), allowMissingColumns=True)
    found = every.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.max("repaired_sha256").alias("sha")
    )
    return found.select("conv_id", *numbers, "audit", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


OP12_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
m AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(4294967295, list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 20 AS f FROM conversations, tab),
h AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM m WHERE f <> 0),
o AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM h),
d AS MATERIALIZED (SELECT *, role[1] AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault, lag(role[1]) OVER (PARTITION BY c ORDER BY n) AS pi FROM o),
fit AS MATERIALIZED (SELECT * FROM (VALUES ('', 'u', 'user', 'a', 'assistant'), ('s', 'u', 'user', 'a', 'assistant'), ('u', 'a', 'assistant', 'u', 'user'), ('a', 'u', 'user', 'a', 'assistant')) v(q, q1, r1, q2, r2)),
s(c, n, q, cost, audit, l) AS (
  SELECT DISTINCT c, 0::BIGINT, '', 0::BIGINT, '', []::VARCHAR[] FROM d
  UNION ALL
  SELECT c, n, q, cost, audit, l FROM (SELECT *, row_number() OVER (PARTITION BY c, q ORDER BY cost, audit) AS best FROM (
    SELECT z.c, z.n, z.e.q AS q, z.cost + z.e.p AS cost, z.audit || z.e.a AS audit, list_concat(z.l, z.e.l) AS l FROM (
      SELECT s.c, d.n, s.cost, s.audit, s.l, unnest([
        {'ok': true, 'q': s.q, 'p': 4, 'a': 'D', 'l': []::VARCHAR[]},
        {'ok': d.i = fit.q1 OR s.q = '' AND d.i = 's', 'q': d.i, 'p': 0 + w.w, 'a': 'K', 'l': [d.role || ':' || d.text]},
        {'ok': d.i = fit.q2, 'q': d.i, 'p': 3 + w.w, 'a': 'IK', 'l': [fit.r1 || ':', d.role || ':' || d.text]},
        {'ok': true, 'q': fit.q1, 'p': 3 + w.w, 'a': 'R', 'l': [fit.r1 || ':' || d.text]},
        {'ok': true, 'q': fit.q2, 'p': 6 + w.w, 'a': 'IR', 'l': [fit.r1 || ':', fit.r2 || ':' || d.text]}]) AS e, d.fault
      FROM s JOIN d ON d.c = s.c AND d.n = s.n + 1 JOIN fit ON fit.q = s.q, LATERAL (SELECT CASE WHEN d.fault = 'truncated' THEN 3 ELSE 0 END AS w) w) z
    WHERE z.e.ok AND (z.e.a = 'D' OR z.fault NOT IN ('blank', 'duplicate')))) WHERE best = 1),
e AS (SELECT c, max(n) AS n FROM d GROUP BY c),
fin AS (SELECT c, arg_min({'cost': cost, 'audit': audit, 'l': l}, {'cost': cost, 'audit': audit}) AS x FROM (
  SELECT s.c, s.cost + CASE s.q WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END AS cost, s.audit || CASE s.q WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit, list_concat(s.l, CASE s.q WHEN 's' THEN ['user:', 'assistant:'] WHEN 'u' THEN ['assistant:'] ELSE []::VARCHAR[] END) AS l
  FROM s JOIN e ON e.c = s.c AND e.n = s.n) GROUP BY c),
g AS (SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (n > 1 AND pi || i NOT IN ('su', 'ua', 'au')) AS illegal FROM d GROUP BY c)
SELECT v.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(g.blank, 0) AS blank, coalesce(g.duplicate, 0) AS duplicate, coalesce(g.truncated, 0) AS truncated, coalesce(g.illegal, 0) AS illegal, coalesce(fin.x.cost, 0)::BIGINT AS cost, coalesce(fin.x.audit, '') AS audit,
  sha256(coalesce(array_to_string(fin.x.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN fin ON fin.c = g.c"""
