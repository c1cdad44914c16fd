"""Tool calls linked to their results, put in order, validated and written as canonical JSON, with DataFrame functions only."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, written

CALLS = "array<struct<id: string, name: string, arguments: variant, after: array<string>>>"
#: What a schema may say of a value, and what is only said about it.
CHECKED = {
    "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "minItems",
    "maxItems", "items", "properties", "required", "additionalProperties"
}
REMARKS = {"title", "description", "default", "examples", "deprecated", "format", "$schema", "$id", "$comment"}
NODES = (
    "tool string, path string, inner boolean, kinds array<string>, options array<string>, least double, most double, over double, under double, shortest long, longest long,"
    " pattern string, fewest long, largest long, required array<string>, closed boolean, names array<string>"
)


def canonical(value: object) -> str:
    """JSON text of a value with sorted keys and each number in one form, as canonical_text() has it."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(v)}" for k, v in sorted(value.items(), key=lambda x: x[0].encode("utf-16-be"))) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, str | bool) or value is None:
        return json.dumps(value, ensure_ascii=False)
    sign, digits, exponent = Decimal(repr(value)).as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    n, text = len(text) + exponent, text.rstrip("0")
    if not text:
        return "0"
    if 0 < n <= 21:
        out = text.ljust(n, "0")[:n] + ("." + text[n:] if len(text) > n else "")
    elif -6 < n <= 0:
        out = "0." + "0" * -n + text
    else:
        out = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{n - 1:+d}"
    return "-" * sign + out


def _number(token: Column) -> Column:
    """A JSON number by its exact decimal value: plain from 1e-6 to below 1e21, else with an exponent."""
    size = lambda x: F.length(x)
    bare = F.regexp_replace(token, "^-", "")
    mantissa = F.regexp_extract(bare, "^[0-9.]*", 0)
    parts = F.struct(
        F.split_part(mantissa, F.lit("."), F.lit(1)).alias("whole"),
        F.when(F.contains(mantissa, F.lit(".")), F.split_part(mantissa, F.lit("."), F.lit(2))).otherwise("").alias("rest"),
        F.coalesce(F.regexp_extract(bare, "[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0)).alias("e")
    )

    def shaped(p: Column) -> Column:
        all_digits = F.concat(p.whole, p.rest)
        led = F.ltrim(all_digits, F.lit("0"))
        return let(F.struct(F.rtrim(led, F.lit("0")).alias("d"), (size(p.whole) + p.e - size(all_digits) + size(led)).alias("n")), form)

    def form(x: Column) -> Column:
        d, n, k = x.d, x.n, size(x.d)
        plain = F.when(n >= k, F.rpad(d, n, "0")).otherwise(F.concat(F.substring(d, F.lit(1), n), F.lit("."), F.substring(d, n + 1, k)))
        wide = F.concat(
            F.substring(d, F.lit(1), F.lit(1)), F.when(k > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), k))).otherwise(""),
            F.when(n > 0, "e+").otherwise("e-"), F.abs(n - 1).cast("string")
        )
        text = F.when((n > 0) & (n <= 21), plain).when((n > -6) & (n <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), d)).otherwise(wide)
        return F.when(d == "", "0").otherwise(F.concat(F.when(F.startswith(token, F.lit("-")), "-").otherwise(""), text))

    return let(parts, shaped)


def canonical_text(text: Column) -> Column:
    """JSON text with its numbers in one form, so that equal values have equal texts; strings stay as they are, but for the case of escapes."""
    number = "-?[0-9][0-9.eE+-]*"
    escapes = [f"\\u00{x}" for x in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")]

    def rewritten(part: Column) -> Column:
        gaps, tokens = F.split(part, number, F.lit(-1)), F.regexp_extract_all(part, F.lit(f"({number})"), F.lit(1))
        return let(tokens, lambda t: F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(_number(F.get(t, i)), F.lit("")))), ""))

    def whole(t: Column) -> Column:
        # what no valid JSON text holds stands for escaped backslashes and quotes, so that every other quote begins or ends a string
        marked = F.replace(F.replace(t, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
        for x in escapes:
            marked = F.replace(marked, F.lit(x), F.lit(x.lower()))
        parts = F.transform(F.split(marked, '"', -1), lambda p, i: F.when((i % 2 == 0) & p.rlike("[0-9]"), rewritten(p)).otherwise(p))
        return F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))

    return let(text, lambda t: F.when(t.rlike(r"[0-9][.eE]|[0-9]{22}|-0|\\u00[01][A-F]"), whole(t)).otherwise(t))


def _kind(v: str) -> str:
    """The JSON type of a variant; a number without a fraction is an integer."""
    s = f"schema_of_variant({v})"
    return (
        f"CASE WHEN {v} IS NULL OR {s} = 'VOID' THEN 'null' WHEN {s} = 'STRING' THEN 'string' WHEN {s} = 'BOOLEAN' THEN 'boolean' WHEN {s} LIKE 'OBJECT%' THEN 'object' WHEN {s} LIKE 'ARRAY%' THEN 'array'"
        f" WHEN {s} = 'BIGINT' OR {s} LIKE '%,0)' OR {s} = 'DOUBLE' AND cast({v} AS double) = floor(cast({v} AS double)) THEN 'integer' ELSE 'number' END"
    )


def schema_nodes(tools: dict[str, dict]) -> list[tuple]:
    """Rows of NODES for each part of each tool's JSON Schema, by its path. A keyword that is not checked here is refused, not ignored."""
    rows: list[tuple] = []

    def add(tool: str, path: str, schema: dict | bool) -> None:
        s = {} if schema is True else {"type": []} if schema is False else schema
        unknown = s.keys() - CHECKED - REMARKS
        if unknown or not isinstance(s.get("additionalProperties", True), bool) or not isinstance(s.get("items", {}), dict | bool):
            raise ValueError(f"schema of tool {tool}, at {path or 'its top'}: {', '.join(sorted(unknown)) or 'additionalProperties or items'} is not supported")
        kinds, fields = s.get("type"), s.get("properties", {})
        options = s.get("enum", [s["const"]] if "const" in s else None)
        number = lambda k: None if s.get(k) is None else float(s[k])
        rows.append((
            tool, path, bool(fields) or "items" in s, [kinds] if isinstance(kinds, str) else kinds, None if options is None else [canonical(x) for x in options], number("minimum"), number("maximum"), number("exclusiveMinimum"),
            number("exclusiveMaximum"), s.get("minLength"), s.get("maxLength"), s.get("pattern"), s.get("minItems"), s.get("maxItems"), s.get("required", []), s.get("additionalProperties", True) is False, list(fields),
        ))
        for name, inner in fields.items():
            add(tool, f"{path}/.{name}", inner)
        if "items" in s:
            add(tool, f"{path}/[]", s["items"])

    for name, schema in tools.items():
        add(name, "", schema)
    return rows


def argument_errors(calls: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """(row, errors): what is wrong with the arguments of calls (row, name, arguments as JSON text); calls without fault have no row.

    Each level of the schemas is a join of the values there with the schemas' parts of that path, so neither tools nor arguments are limited in number.
    """
    spark = calls.sparkSession
    nodes = written(spark.createDataFrame(schema_nodes(tools), NODES), "schemas")
    depth = max((p.count("/.") + p.count("/[]") for _, p, *_ in schema_nodes(tools)), default=0)
    name = "concat(at, CASE WHEN at = '' THEN '' ELSE '.' END, {})"
    keys = "coalesce(map_keys(fields), array())"
    text = "CASE WHEN kind = 'string' THEN cast(v AS string) END"
    number = "CASE WHEN kind IN ('integer', 'number') THEN cast(v AS double) END"
    size = "CASE WHEN kind = 'array' THEN size(elements) END"
    tests = {
        "type": "NOT array_contains(kinds, kind) AND NOT (kind = 'integer' AND array_contains(kinds, 'number'))", "option": "NOT array_contains(options, plain)", "small": f"{number} < least OR {number} <= over", "large": f"{number} > most OR {number} >= under",
        "short": f"length({text}) < shortest", "long": f"length({text}) > longest", "pattern": f"NOT ({text}) RLIKE pattern", "few": f"{size} < fewest", "many": f"{size} > largest",
    }
    wrong = [f"CASE WHEN {t} THEN array(concat('{n}:', at)) ELSE array() END" for n, t in tests.items()]
    wrong.append(f"CASE WHEN kind = 'object' THEN transform(array_except(required, {keys}), x -> concat('missing:', {name.format('x')})) ELSE array() END")
    wrong.append(f"CASE WHEN closed THEN transform(array_except({keys}, names), x -> concat('unexpected:', {name.format('x')})) ELSE array() END")
    kids = (
        f"concat(transform(coalesce(map_entries(fields), array()), e -> struct(concat(path, '/.', e.key) AS path, {name.format('e.key')} AS at, e.value AS v)),"
        " transform(coalesce(elements, array()), (e, i) -> struct(concat(path, '/[]') AS path, concat(at, '[', i, ']') AS at, e AS v)))"
    )

    def opened(level: DataFrame) -> DataFrame:
        met = level.withColumn("kind", F.expr(_kind("v"))).withColumn("plain", F.when(F.col("options").isNotNull(), canonical_text(F.to_json("v"))))
        return met.withColumns(
            {
                "fields": F.expr("CASE WHEN kind = 'object' THEN cast(v AS map<string, variant>) END"),
                "elements": F.expr("CASE WHEN kind = 'array' THEN cast(v AS array<variant>) END")
            }
        )

    top = calls.select("row", F.col("name").alias("tool"), F.lit("").alias("path"), F.lit("").alias("at"), F.try_parse_json("arguments").alias("v"))
    top = opened(top.join(nodes.where("path = ''").drop("path"), "tool", "left"))
    whole = "CASE WHEN closed IS NULL THEN array('unknown_tool') WHEN kind = 'null' THEN array('no_arguments') WHEN kind != 'object' THEN array('not_an_object') ELSE {} END"
    found = [top.select("row", F.explode(F.expr(whole.format(f"concat({', '.join(wrong)})"))).alias("error"))]
    level = top.where("closed IS NOT NULL AND kind = 'object'")
    for _ in range(depth):
        inner = level.where("inner").select("row", "tool", F.explode(F.expr(kids)).alias("k")).select("row", "tool", "k.*")
        level = opened(inner.join(nodes, ["tool", "path"]))
        found.append(level.select("row", F.explode(F.expr(f"concat({', '.join(wrong)})")).alias("error")))
    errors = found[0]
    for f in found[1:]:
        errors = errors.unionAll(f)
    return errors.groupBy("row").agg(F.array_sort(F.collect_list("error")).alias("errors"))


def _items(messages: DataFrame) -> DataFrame:
    """A row for each plain message, call and result, as a written table; row is unique."""
    m = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text")
    )
    m = m.withColumn("body", F.when(F.col("role").isin("assistant", "tool") & F.startswith(F.ltrim("text"), F.lit("{")), F.try_parse_json(canonical_text(F.col("text")))))
    m = m.withColumns(
        {
            "calls": F.expr(f"CASE WHEN role = 'assistant' THEN try_variant_get(body, '$.tool_calls', '{CALLS}') END"),
            "answers": F.expr("CASE WHEN role = 'tool' THEN try_variant_get(body, '$.tool_call_id', 'string') END")
        }
    )
    base = ["conv_id", "turn", "role"]
    no = {"name": F.lit(None).cast("string"), "arguments": F.lit(None).cast("variant"), "after": F.lit(None).cast("array<string>")}
    calls = m.where("size(calls) > 0").select(*base, F.posexplode("calls").alias("part", "c")).select(
        *base, F.col("part").cast("long").alias("part"), F.lit("call").alias("kind_of"), F.col("c.id").alias("call_id"),
        F.col("c.name").alias("name"),
        F.expr(
            "CASE WHEN c.arguments IS NOT NULL AND schema_of_variant(c.arguments) = 'STRING' THEN try_parse_json(cast(c.arguments AS string)) ELSE c.arguments END"
        ).alias("arguments"),
        F.col("c.after").alias("after"), F.lit(None).cast("variant").alias("content"), F.lit(None).cast("string").alias("text")
    )
    rest = m.where("coalesce(size(calls), 0) <= 0").select(
        *base, F.lit(0).cast("long").alias("part"), F.when(F.col("answers").isNotNull(), "result").otherwise("message").alias("kind_of"),
        F.col("answers").alias("call_id"), *(c.alias(n) for n, c in no.items()),
        F.expr("CASE WHEN answers IS NOT NULL THEN try_variant_get(body, '$.content', 'variant') END").alias("content"),
        F.expr("CASE WHEN answers IS NULL THEN text END").alias("text")
    )
    both = calls.unionByName(rest)
    call = F.to_json(F.struct("arguments", F.col("call_id").alias("id"), F.lit("call").alias("kind"), "name", "role", "turn"))
    result = F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("result").alias("kind"), "role", "turn"))
    message = F.to_json(F.struct(F.col("text").alias("content"), F.lit("message").alias("kind"), "role", "turn"))
    line = F.when(F.col("kind_of") == "call", call).when(F.col("kind_of") == "result", result).otherwise(message)
    arguments = F.when((F.col("kind_of") == "call") & F.col("arguments").isNotNull(), F.to_json("arguments"))
    out = both.select(*base, "part", F.col("kind_of").alias("kind"), "call_id", "name", arguments.alias("arguments"), "after", canonical_text(line).alias("line"))
    return written(out.withColumn("row", F.monotonically_increasing_id()), "items")


def _moved(items: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(call_row, ready, depth, cyclic) of calls that cannot stand at their own turn, and (call_row, n_missing) of those with dependencies that are no calls.

    A call goes after the results of its dependencies: to the later of its turn and theirs (ready), and at that turn after them (depth). So a dependency's place
    (r, d) puts its call at (r, d + k) if r >= t, else at (t, c): a step (t, k, c), and two such steps in a row make one. Where no call has to move nothing
    more is done. Else, in the conversations where one has to, calls with one dependency are joined to the first call behind it with none or several, by doubling:
    rounds grow with the logarithm of a chain, and calls on a ring are those that never arrive. Of the rest, calls whose dependencies all have
    their places are placed, round by round, until none is: what is left is in or behind a ring, keeps its place, and is marked cyclic. So rounds grow only with the
    longest chain of calls that each need several others.
    """
    first = items.alias("i").join(
        keys.alias("k"), F.col("i.conv_id").eqNullSafe(F.col("k.conv_id")) & (F.col("i.call_id") == F.col("k.call_id"))
    ).where("i.kind = 'call' AND i.row = k.call_row AND size(i.after) > 0")
    wanted = written(first.select("i.conv_id", "i.row", "i.turn", F.explode(F.array_distinct("i.after")).alias("dep")), "wanted")
    found = wanted.alias("w").join(
        keys.alias("k"), F.col("w.conv_id").eqNullSafe(F.col("k.conv_id")) & (F.col("w.dep") == F.col("k.call_id")) & F.col("k.call_row").isNotNull(),
        "left"
    )
    found = written(
        found.select("w.conv_id", "w.row", "w.turn", F.col("k.call_row").alias("d"), F.col("k.call_turn").alias("d_turn"), F.col("k.result_turn").alias("r_turn")),
        "dependencies"
    )
    missing = written(found.where("d IS NULL").groupBy(F.col("row").alias("call_row")).agg(F.count("*").alias("n_missing")), "missing")
    edges = found.where("d IS NOT NULL")
    late = edges.where("greatest(d_turn, r_turn) >= turn").select(F.col("conv_id").alias("c")).distinct()
    edges = edges.join(written(late, "late"), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    step = F.expr(
        "CASE WHEN r_turn IS NULL THEN struct(turn AS t, 1L AS k, 0L AS c) WHEN r_turn >= turn THEN struct(r_turn AS t, 2L AS k, 1L AS c) ELSE struct(turn AS t, 2L AS k, 0L AS c) END"
    )
    edges = written(edges.select("row", "d", "turn", "d_turn", step.alias("f")), "edges")
    none = edges.sparkSession.range(0).select(F.col("id").alias("call_row"), F.col("id").alias("ready"), F.col("id").alias("depth"), F.lit(False).alias("cyclic"))
    if edges.isEmpty():
        return none, missing

    def after(g: str, f: str) -> str:
        """The step g after the step f."""
        return f"CASE WHEN {f}.t >= {g}.t THEN struct({f}.t AS t, {f}.k + {g}.k AS k, {f}.c + {g}.k AS c) ELSE struct({g}.t AS t, {f}.k + {g}.k AS k, {g}.c AS c) END"

    def put(f: str) -> str:
        return f"CASE WHEN ready >= {f}.t THEN struct(ready, depth + {f}.k AS depth) ELSE struct({f}.t AS ready, {f}.c AS depth) END"

    turns = edges.select("row", "turn").distinct()
    wide = written(edges.groupBy("row").agg(F.count("*").alias("needs")), "needs")
    single = edges.join(wide.where("needs = 1").select("row"), "row", "left_semi")
    several = edges.join(wide.where("needs > 1"), "row").select("row", "d", "f", "needs")
    chain = written(single.select("row", F.col("d").alias("to"), "f"), "chains")
    span, n = 1, chain.count()
    while True:
        ahead = chain.select(F.col("row").alias("to"), F.col("to").alias("next"), F.col("f").alias("g"))
        jumped = chain.join(ahead, "to", "left").select(
            "row", F.coalesce("next", "to").alias("to"), F.when(F.col("g").isNull(), F.col("f")).otherwise(F.expr(after("f", "g"))).alias("f"),
            F.col("g").isNotNull().alias("moving")
        )
        jumped, span = written(jumped, "chains"), 2 * span
        chain = jumped.drop("moving")
        if span > 2 * n or jumped.where("moving").isEmpty():
            break
    still = jumped.where("moving").select("row")  # after so many rounds, on or behind a ring of such calls
    chain = written(chain.join(still, "row", "left_anti"), "chains")
    roots = chain.select(F.col("row").alias("d"), "to", F.col("f").alias("g"))
    several = several.join(roots, "d", "left").select(
        "row", F.coalesce("to", "d").alias("d"), F.when(F.col("g").isNull(), F.col("f")).otherwise(F.expr(after("f", "g"))).alias("f"), "needs"
    )
    several = written(several, "several")
    starts = edges.select(F.col("d").alias("node"), F.col("d_turn").alias("ready")).distinct().join(wide.select(F.col("row").alias("node")), "node", "left_anti")
    placed = written(starts.withColumn("depth", F.lit(0).cast("long")), "placed")
    while True:
        new = several.join(placed, F.col("d") == F.col("node")).groupBy("row").agg(
            F.max(F.expr(put("f"))).alias("x"), F.count("*").alias("n"), F.first("needs").alias("needs")
        ).where("n = needs")
        new = written(new.select(F.col("row").alias("node"), "x.*").join(placed.select("node"), "node", "left_anti"), "placed")
        if new.isEmpty():
            break
        placed = written(placed.union(new), "placed")
    by_chain = chain.join(placed, F.col("to") == F.col("node")).select("row", F.expr(put("f")).alias("x")).select("row", "x.*")
    all_placed = placed.withColumnRenamed("node", "row").join(wide.select("row"), "row", "left_semi").union(by_chain)
    now = turns.join(all_placed, "row", "left").where("ready IS NULL OR ready != turn OR depth != 0")
    cyclic = F.col("ready").isNull()
    return written(
        now.select(F.col("row").alias("call_row"), F.coalesce("ready", "turn").alias("ready"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), cyclic.alias("cyclic")),
        "moved"
    ), missing


def _answered() -> str:
    """The place of a call's result, where it has one, else its own: ready, depth; from its own place and r_turn."""
    return "CASE WHEN r_turn IS NULL THEN struct(ready, cast(depth AS long) AS depth) WHEN r_turn > ready THEN struct(r_turn AS ready, 0L AS depth) ELSE struct(ready, cast(depth + 1 AS long) AS depth) END"


def link_tools(messages: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """Link the tool calls of conversations to their results, order them, validate their arguments, and write each item as canonical JSON.

    messages: conv_id long, turn long, role, text; other columns are left alone. An assistant's text may be a JSON object with tool_calls, a list of id, name,
    arguments (an object, or a string that holds one) and after, the ids of calls whose results it needs. A tool's text may be a JSON object with tool_call_id and
    content. All other messages are plain, as are those with repeated keys. tools: JSON Schemas by name, of any number; the keywords CHECKED count, at any depth, and
    others but REMARKS raise an error.

    Returns a row for each plain message, call and result: conv_id, turn, part (the place among the calls of a message), role, kind (message,
    call, result), call_id, status, errors (sorted, comma-joined), n_missing (dependencies that are no calls), ready, depth, cyclic and line. Within a conversation, the
    order by ready, depth, turn, part has every call after the results it needs and every result after its call, and moves nothing else; cyclic calls have no such order.
    status: linked; unanswered, a call without result; duplicate, a call whose id an earlier one has; orphan, a result without call; repeated, a result after the
    first; plain. line has its keys sorted, no spaces, no null fields, and each number in one form: by its exact value up to 38 digits, beyond that by the nearest double. Texts may be of any length. errors name the keyword's kind (type, option, small, large, short, long,
    pattern, few, many, missing, unexpected) and the place. Rows with a null conv_id are one conversation. An item with a null id links with nothing;
    repeated rows are duplicates and repeats; an empty table gives no rows.

    Ids are counted before the shuffle, so one id or conversation may hold any share of the rows; nothing gathers a conversation.
    """
    items = _items(messages)
    errors = argument_errors(items.where("kind = 'call'").select("row", "name", "arguments"), tools)
    place = F.struct("turn", "part", "row")
    keys = items.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(
        F.min(F.when(F.col("kind") == "call", place)).alias("c"), F.min(F.when(F.col("kind") == "result", place)).alias("r")
    )
    keys = written(
        keys.select(
            "conv_id", "call_id", F.col("c.row").alias("call_row"), F.col("c.turn").alias("call_turn"), F.col("r.row").alias("result_row"),
            F.col("r.turn").alias("result_turn")
        ),
        "keys"
    )
    moved, missing = _moved(items, keys)
    named = items.drop("after", "name", "arguments").join(written(errors, "errors"), "row", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>"))).join(
        keys.withColumnRenamed("conv_id", "c2").withColumnRenamed("call_id", "i2"),
        F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("call_id") == F.col("i2")), "left"
    )
    call, result, own = F.col("kind") == "call", F.col("kind") == "result", F.col("row")
    status = F.when(
        call,
        F.when(F.coalesce(own != F.col("call_row"), F.lit(False)), "duplicate").when(F.col("call_row").isNull() | F.col("result_row").isNull(), "unanswered").otherwise("linked")
    )
    status = status.when(result, F.when(F.col("call_row").isNull(), "orphan").when(own != F.col("result_row"), "repeated").otherwise("linked")).otherwise("plain")
    named = named.withColumn("status", status).withColumn("of", F.when(F.col("status") != "duplicate", F.col("call_row")))
    if moved.isEmpty():
        placed = named.withColumns({"ready": F.lit(None).cast("long"), "depth": F.lit(None).cast("long"), "cyclic": F.lit(False)})
    else:
        placed = named.join(moved.withColumnRenamed("call_row", "of"), "of", "left")
    if missing.isEmpty():
        placed = placed.withColumn("n_missing", F.lit(0).cast("long"))
    else:
        placed = placed.join(missing.withColumnRenamed("call_row", "row"), "row", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))
    calls_place = F.struct(
        F.coalesce("ready", F.when(F.col("of").isNotNull(), F.col("call_turn")), "turn").alias("ready"),
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth")
    )
    placed = placed.withColumn("at", calls_place).drop("ready", "depth").select("*", "at.*").withColumn("r_turn", F.when(result & F.col("of").isNotNull(), F.col("turn")))
    return placed.withColumn("last", F.expr(_answered())).select(
        "conv_id", "turn", "part", "role", "kind", "call_id", "status", F.array_join("errors", ",").alias("errors"), "n_missing", F.col("last.ready").alias("ready"), F.col("last.depth").alias("depth"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"), "line",
    )


#: The tool that plain conversations are read as calls of.
REPLY = {
    "reply": {
        "type": "object", "properties": {"question": {"type": "string", "maxLength": 300}, "turn": {"type": "integer"}},
        "required": ["question", "turn"], "additionalProperties": False
    }
}


def as_tool_dialogs(conversations: DataFrame) -> DataFrame:
    """Plain conversations as messages of link_tools(): a user's turn calls the tool reply, the assistant's next turn is its result; other turns stay as they are.

    A call needs the result of the user's turn before; in every fifth conversation that of the user's turn after, so that its calls stand in the wrong order.
    """
    call_id = lambda back: F.concat_ws("-", "conv_id", F.col("turn") - back)
    after = F.when(F.col("conv_id") % 5 == 0, F.array(call_id(-2))).when(F.col("turn") >= 2, F.array(call_id(2))).otherwise(F.array().cast("array<string>"))
    call = F.struct(call_id(0).alias("id"), F.lit("reply").alias("name"), F.struct(F.col("text").alias("question"), "turn").alias("arguments"), after.alias("after"))
    text = F.when(F.col("role") == "user", F.to_json(F.struct(F.array(call).alias("tool_calls")))).when(
        F.col("role") == "assistant", F.to_json(F.struct(call_id(1).alias("tool_call_id"), F.col("text").alias("content")))
    ).otherwise(F.col("text"))
    role = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def op8_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, read as calls of one tool."""
    linked = link_tools(as_tool_dialogs(spark.read.parquet(f"{sf_dir}/conversations.parquet")), REPLY)
    return linked.select("conv_id", "turn", "part", "kind", "call_id", "status", "errors", "n_missing", "ready", "depth", F.sha2("line", 256).alias("line_sha256"))


#: In every fifth conversation, calls two turns apart follow the last of their row; each call between lies one deeper, and each answer of those too.
OP8_SQL = """
WITH m AS (
  SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind, role,
    CASE role WHEN 'user' THEN conv_id || '-' || turn WHEN 'assistant' THEN conv_id || '-' || (turn - 1) END AS call_id FROM conversations),
u AS (
  SELECT c.conv_id, c.turn, c.call_id, r.turn IS NOT NULL AS answered, c.turn - 2 * row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS line
  FROM m c LEFT JOIN m r ON r.conv_id = c.conv_id AND r.kind = 'result' AND r.turn = c.turn + 1 WHERE c.kind = 'call' AND c.conv_id % 5 = 0),
b AS (
  SELECT *, max(turn) OVER w AS last, coalesce(sum(1 + answered::INT) OVER (w ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS behind FROM u WINDOW w AS (PARTITION BY conv_id, line)),
p AS (
  SELECT b.conv_id, b.call_id, b.last + CASE WHEN l.answered AND b.turn < b.last THEN 1 ELSE 0 END AS ready, CASE WHEN b.turn < b.last THEN b.behind - l.answered::INT ELSE 0 END AS depth
  FROM b JOIN u l ON l.conv_id = b.conv_id AND l.turn = b.last)
SELECT m.conv_id, m.turn, 0::BIGINT AS part, m.kind, m.call_id,
  CASE WHEN m.kind = 'message' THEN 'plain' WHEN o.kind IS NOT NULL THEN 'linked' WHEN m.kind = 'call' THEN 'unanswered' ELSE 'orphan' END AS status,
  CASE WHEN m.kind = 'call' AND length(m.text) > 300 THEN 'long:question' ELSE '' END AS errors,
  CASE WHEN m.kind = 'call' AND (m.conv_id % 5 = 0 OR m.turn >= 2)
    AND NOT EXISTS (SELECT 1 FROM m p WHERE p.conv_id = m.conv_id AND p.kind = 'call' AND p.turn = m.turn + CASE WHEN m.conv_id % 5 = 0 THEN 2 ELSE -2 END) THEN 1 ELSE 0 END::BIGINT AS n_missing,
  CASE WHEN m.kind = 'message' OR p.ready IS NULL OR m.kind = 'result' AND m.turn > p.ready THEN m.turn ELSE p.ready END::BIGINT AS ready,
  CASE WHEN m.kind = 'message' OR p.ready IS NULL OR m.kind = 'result' AND m.turn > p.ready THEN 0 WHEN m.kind = 'result' THEN p.depth + 1 ELSE p.depth END::BIGINT AS depth,
  sha256(CASE m.kind
    WHEN 'call' THEN '{"arguments":{"question":' || to_json(m.text) || ',"turn":' || m.turn || '},"id":"' || m.call_id || '","kind":"call","name":"reply","role":"assistant","turn":' || m.turn || '}'
    WHEN 'result' THEN '{"content":' || to_json(m.text) || ',"id":"' || m.call_id || '","kind":"result","role":"tool","turn":' || m.turn || '}'
    ELSE '{"content":' || to_json(m.text) || ',"kind":"message","role":"' || m.role || '","turn":' || m.turn || '}' END) AS line_sha256
FROM m LEFT JOIN m o ON o.conv_id = m.conv_id AND o.call_id = m.call_id AND o.kind <> m.kind
LEFT JOIN p ON p.conv_id = m.conv_id AND p.call_id = m.call_id AND (m.kind = 'call' OR o.kind IS NOT NULL)
"""
