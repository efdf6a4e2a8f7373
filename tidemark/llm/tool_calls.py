"""Tool-call linking for chat transcripts, in DataFrame functions only.

Messages carry tool calls and results as JSON in their texts:
`{"tool_calls": [{"id": ..., "name": ..., "arguments": {...}}]}` and
`{"tool_call_id": ..., "content": ...}`. Calls and results are hash-joined on
conversation and identifier. A call needs the calls that its arguments name, at any depth,
by objects `{"$ref": identifier}`; other texts are plain values, whatever they begin with.
`level` is a call's place in the order of needs (0 without needs, else one more than the
deepest need, of whatever turn), and `place` counts a conversation's calls in that
topological order. Calls in or behind a cycle, and calls that name unknown identifiers or
stand behind such calls, have neither.

Levels come from pointer doubling over the needs: rounds grow with the logarithm of the
longest chain, without a limit. A round's rows are pairs of a call and one that it reaches by so
many steps: as many as calls for chains, more where calls need several others (calls in or behind
a cycle leave as soon as that is seen). Places are
counted over sorted ranges of all calls, so that one long conversation is no single task.

Arguments are parsed as VARIANT, with their JSON types, and checked against a table of
schemas (`name`, `argument`, `type`, `required`); `argument` may be the path of a field of
an object (`filter.lang`), `type` one of string, integer, number, boolean, object, array. A
reference fits every type. The call is written as canonical JSON: keys of all objects in
order, no spaces, numbers in their shortest form.

Defined results: null and empty texts, texts that aren't such JSON, and calls without
identifier or name are no calls (`malformed()` lists messages that mention calls but aren't
JSON, so that they can be counted); of calls with one identifier in a conversation the one
with the least turn (then name and arguments) counts and `repeats` says how many more there
were; arguments that are no object count as none; of several results the first at or after
the call's turn is linked; a result before its call isn't. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import released, written

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:variant>>>"
RESULT = "struct<tool_call_id:string,content:string>"
_REF = r'\{"\$ref":"((?:[^"\\]|\\.)*)"\}'
#: Calls that meet what they need in one task.
MOST_WAITING = 1000
_ON = ["conv_id", "call_id"]


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", "$1")


def calls_of(messages: DataFrame) -> DataFrame:
    """One row for each identifier in a conversation: `conv_id`, `turn`, `call_id`, `name`, `arguments` (canonical JSON of an object), `repeats`."""
    parsed = messages.filter(F.col("text").contains("tool_calls")).select("conv_id", "turn", F.explode(F.from_json("text", CALLS)["tool_calls"]).alias("c"))
    arguments = F.when(F.schema_of_variant("c.arguments").startswith("OBJECT"), F.to_json("c.arguments"))
    calls = parsed.select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.coalesce(arguments, F.lit("{}")).alias("arguments")).filter("call_id IS NOT NULL AND name IS NOT NULL")
    merged = calls.groupBy(*_ON).agg(F.min(F.struct("turn", "name", "arguments")).alias("first"), (F.count("*") - 1).alias("repeats"))
    return merged.select(*_ON, "first.*", "repeats")


def malformed(messages: DataFrame) -> DataFrame:
    """Messages that mention calls or results but hold no JSON object (or one with a key twice): their calls can't be read."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT"), F.lit(False))
    return messages.filter((F.col("text").contains('"tool_calls"') | F.col("text").contains('"tool_call_id"')) & ~is_object)


def results_of(messages: DataFrame) -> DataFrame:
    parsed = messages.filter(F.col("text").contains("tool_call_id")).select("conv_id", "turn", F.from_json("text", RESULT).alias("r"))
    return parsed.select("conv_id", F.col("turn").alias("result_turn"), F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content")).filter("call_id IS NOT NULL")


def _dealt(waiting: DataFrame, known: DataFrame) -> DataFrame:
    """`waiting` (`conv_id`, `call_id`, `needs`) joined with `known` (`conv_id`, `needs`, ...) on what is needed; a call that more than MOST_WAITING need is copied, so that they meet in several tasks."""
    hot = waiting.groupBy("conv_id", "needs").agg(F.ceil(F.count("*") / MOST_WAITING).cast("int").alias("parts")).filter("parts > 1")  # one in MOST_WAITING rows at most
    parts = F.coalesce("parts", F.lit(1))
    left = waiting.join(hot, ["conv_id", "needs"], "left").withColumn("salt", F.pmod(F.xxhash64(*_ON), parts).cast("int")).drop("parts")
    right = known.join(hot, ["conv_id", "needs"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, ["conv_id", "needs", "salt"]).drop("salt")


def needs_of(calls: DataFrame) -> DataFrame:
    """`conv_id`, `call_id`, `needs`, `known`: one row for each identifier that a call names."""
    refs = F.transform(F.regexp_extract_all("arguments", F.lit(_REF), F.lit(1)), lambda x: F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), x, F.lit('"'))), "$", "string"))
    edges = written(calls.select(*_ON, F.explode(F.array_distinct(refs)).alias("needs")))
    met = _dealt(edges, calls.select("conv_id", F.col("call_id").alias("needs"))).select(*_ON, "needs", F.lit(True).alias("known"))
    return edges.join(met, [*_ON, "needs"], "left").select(*_ON, "needs", F.coalesce("known", F.lit(False)).alias("known"))


def longest(edges: DataFrame) -> DataFrame:
    """`conv_id`, `call_id`, `far` of the calls with needs: steps of the longest chain of needs, null where chains don't end.

    `edges` has `conv_id`, `call_id`, `needs`; a call that can't be met needs itself.
    """
    # calls reached by `step` steps; `done` has the longest chains of fewer steps that end, `lost` the calls known to stand in or behind a cycle
    open_ = first = written(edges.select(*_ON, "needs").distinct())
    waiting = first.select(*_ON).distinct()
    most = waiting.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    ends = open_.select("conv_id", F.col("needs").alias("call_id")).distinct().join(waiting, _ON, "left_anti")
    done, lost = written(ends.withColumn("far", F.lit(0).cast("long"))), written(open_.limit(0).select(*_ON))
    step = 1
    # a chain of more steps than a conversation has calls with needs never ends
    while step <= most and not open_.isEmpty():
        behind = open_.join(lost.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"]).select(*_ON)
        now_lost = written(lost.unionByName(open_.filter("call_id = needs").select(*_ON)).unionByName(behind).distinct())
        left = written(open_.join(now_lost, _ON, "left_anti"))
        there = done.select("conv_id", F.col("call_id").alias("needs"), (F.col("far") + step).alias("far"))
        more = written(done.unionByName(_dealt(left, there).select(*_ON, "far")).groupBy(*_ON).agg(F.max("far").alias("far")))
        # lost calls still lead on what needs them, which is then found to be lost too
        onward = open_.select("conv_id", F.col("call_id").alias("needs"), F.col("needs").alias("onward"))
        further = written(_dealt(left, onward).select(*_ON, F.col("onward").alias("needs")).distinct())
        released(done, lost, left, *([open_] if step > 1 else []))  # the first one is read again below
        done, lost, open_, step = more, now_lost, further, 2 * step
    endless = lost.unionByName(open_.select(*_ON)).distinct().withColumn("endless", F.lit(True))
    return waiting.join(done, _ON, "left").join(endless, _ON, "left").select(*_ON, F.when(F.col("endless").isNull(), F.col("far")).alias("far"))


def levels(calls: DataFrame) -> DataFrame:
    """`conv_id`, `call_id`, `turn`, `level` of every call; null where it can't be ordered."""
    needs = needs_of(calls)
    met = longest(needs.select(*_ON, F.when(F.col("known"), F.col("needs")).otherwise(F.col("call_id")).alias("needs")))
    out = calls.select(*_ON, "turn").join(met.withColumn("waits", F.lit(True)), _ON, "left")
    return out.select(*_ON, "turn", F.when(F.col("waits").isNull(), F.lit(0)).otherwise(F.col("far")).cast("long").alias("level"))


def places(levelled: DataFrame) -> DataFrame:
    """`conv_id`, `call_id`, `level`, `place`: a conversation's calls counted by level, then turn, then identifier; null without a level.

    Calls are sorted in ranges over all conversations; a range counts its own, and a table of
    (conversation, range) counts says how many of a conversation come before the range.
    """
    order = ["conv_id", "level", "turn", "call_id"]
    ranged = written(levelled.filter("level IS NOT NULL").repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n"))
    within = ranged.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order[1:])))
    placed = within.join(before.drop("n"), ["conv_id", "part"]).select(*_ON, (F.col("before") + F.col("at")).cast("long").alias("place"))
    return levelled.select(*_ON, "level").join(placed, _ON, "left")


def _type(v: Column) -> Column:
    """The JSON type of a variant; `ref` for a reference."""
    t = F.schema_of_variant(v)
    return (
        F.when(t == "BIGINT", "integer").when(t.rlike(r"^DECIMAL\([0-9]+,0\)$"), "integer").when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "number")
        .when(t == "OBJECT<`$ref`: STRING>", "ref").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "VOID", "null").otherwise(F.lower(t))
    )


def types_of(arguments: Column) -> Column:
    """A map from the paths of arguments, and of the fields of arguments that are objects, to their types."""
    entries = lambda v: F.map_entries(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    own = F.transform(entries(F.try_parse_json(arguments)), lambda e: F.struct(e["key"].alias("key"), _type(e["value"]).alias("type"), e["value"].alias("value")))
    inner = F.flatten(F.transform(F.filter(own, lambda e: e["type"] == "object"), lambda e: F.transform(entries(e["value"]), lambda f: F.struct(F.concat(e["key"], F.lit("."), f["key"]).alias("key"), _type(f["value"]).alias("type")))))
    return F.array_distinct(F.concat(F.transform(own, lambda e: F.struct(e["key"].alias("key"), e["type"].alias("type"))), inner))


def problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """`conv_id`, `call_id` and the sorted problems of the calls' arguments: unknown tool, missing, unknown or mistyped arguments.

    Fields of an argument that is an object are checked only if the schema names fields of it.
    """
    wanted = schemas.groupBy("name").agg(F.collect_list(F.struct("argument", "type", "required")).alias("wanted"))  # one tool's arguments
    both = calls.join(wanted, "name", "left").withColumn("given", types_of(F.col("arguments")))
    names, paths = F.transform("wanted", lambda w: w["argument"]), F.transform("given", lambda g: g["key"])
    missing = F.transform(F.filter("wanted", lambda w: w["required"] & ~F.array_contains(paths, w["argument"])), lambda w: F.concat(F.lit("missing:"), w["argument"]))
    parents = F.transform(F.filter(names, lambda n: n.contains(".")), lambda n: F.substring_index(n, ".", 1))
    checked = F.filter("given", lambda g: ~g["key"].contains(".") | F.array_contains(parents, F.substring_index(g["key"], ".", 1)) | F.array_contains(names, g["key"]))
    unknown = F.transform(F.filter(checked, lambda g: ~F.array_contains(names, g["key"]) & ~F.array_contains(parents, g["key"])), lambda g: F.concat(F.lit("unknown:"), g["key"]))
    fits = lambda g, w: (g["type"] == w["type"]) | (g["type"] == "ref") | ((w["type"] == "number") & (g["type"] == "integer"))
    wrong = F.transform(F.filter("wanted", lambda w: F.exists("given", lambda g: (g["key"] == w["argument"]) & ~fits(g, w))), lambda w: F.concat(F.lit("type:"), w["argument"]))
    found = F.when(F.col("wanted").isNull(), F.array(F.lit("unknown_tool"))).otherwise(F.array_sort(F.concat(missing, unknown, wrong)))
    return both.select(*_ON, found.alias("problems"))


def canonical(call_id: Column, name: Column, arguments: Column) -> Column:
    """Canonical JSON of a call; `arguments` is canonical already."""
    return F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), _quoted(call_id), F.lit(',"name":'), _quoted(name), F.lit("}"))


def link(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call of `messages` (`conv_id`, `turn`, `text`): its order, result, problems and canonical JSON."""
    messages = messages.select("conv_id", "turn", "text")
    calls = written(calls_of(messages))
    first = results_of(messages).join(calls.select(*_ON, "turn"), _ON).filter("result_turn >= turn")
    first = first.groupBy(*_ON).agg(F.min(F.struct("result_turn", "content")).alias("r")).select(*_ON, "r.*")
    df = calls.join(places(levels(calls)), _ON, "left").join(first, _ON, "left").join(problems(calls, schemas), _ON, "left")
    return df.select(
        "conv_id", "call_id", "turn", "name", "level", "place", "result_turn", "content",
        F.col("result_turn").isNotNull().alias("linked"), (F.size("problems") == 0).alias("valid"), F.array_join("problems", ",").alias("problems"),
        canonical(F.col("call_id"), F.col("name"), F.col("arguments")).alias("json"), "repeats",
    )


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Plain chats rewritten as tool use: a user turn becomes two calls, an assistant turn the result of the second call of the turn before.

    The first call (`a`) needs the second (`b`) of the user turn two before, and the second needs the first, so
    a conversation is one chain over all its turns; in every eleventh conversation the first also needs the second, a cycle.
    Tools take turns by the text's length; every fifth conversation gives its limit as a text, so checks have work.
    """
    c = conversations.filter("role IN ('user', 'assistant')").groupBy("conv_id", "turn", "role").agg(F.min("text").alias("text"))
    n = F.coalesce(F.length("text"), F.lit(0))
    tool = F.element_at(F.array(F.lit("search"), F.lit("translate"), F.lit("summarise")), (n % 3 + 1).cast("int"))
    call_id = lambda t, part: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"), F.lit(part))
    ref = lambda id_: F.struct(id_.alias("$ref"))
    turn = F.col("turn")
    # to_json() leaves null fields out, so `after` and `limit` have one place for each kind of value
    limit = lambda texts: F.when((F.col("conv_id") % 5 == 0) == F.lit(texts), n)
    one = F.struct(
        F.when(turn >= 2, ref(call_id(turn - 2, "b"))).alias("after"),
        F.struct(F.lit("en").alias("lang"), F.when(F.col("conv_id") % 11 == 0, F.array(ref(call_id(turn, "b")))).alias("of"), limit(False).alias("limit"), limit(True).cast("string").alias("text_limit")).alias("filter"),
        F.coalesce("text", F.lit("")).alias("query"),
    )
    two = F.struct(F.array(ref(call_id(turn, "a"))).alias("sources"), (n * 0.5).alias("weight"))
    call = lambda part, name, arguments: F.to_json(F.struct(call_id(turn, part).alias("id"), name.alias("name"), arguments.alias("arguments")))
    calls = F.concat(F.lit('{"tool_calls":['), call("b", F.lit("merge"), two), F.lit(","), call("a", tool, one), F.lit("]}"))
    result = F.to_json(F.struct(F.col("text").alias("content"), call_id(turn - 1, "b").alias("tool_call_id")))
    return c.select("conv_id", "turn", F.when(F.col("role") == "user", F.replace(calls, F.lit('"text_limit":'), F.lit('"limit":'))).otherwise(result).alias("text"))
