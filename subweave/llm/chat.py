"""Chat formatting with linked tool calls, with DataFrame functions only.

A message whose text is a JSON object with the array tool_calls makes calls (id, name, arguments); a message of role tool
whose text is a JSON object with tool_call_id answers one (content). Answers meet calls in a hash join by conversation and id, dealt
over salts as one call may have any number of answers. A conversation's order is the topological one that keeps turns in place
otherwise: an answer comes after the message that made its call and before that message's next sibling, answers of one
message in the order of its calls, and an answer may make calls of its own, to any depth. An answer without a call stays at its own
turn. Where messages answer each other in a circle, the first of them by turn stays at its turn. Arguments are checked against
the tools' schemas, at every level. Messages are written as canonical JSON: no spaces, keys sorted at every level, absent
fields left out; arguments that came as a JSON text are written as what they hold.

Each message is one row, so a long conversation is never gathered: messages are sorted by ranges of the whole order, and positions
are a range's start and the place in it. An answer's sort key is the way from its root, so it is as long as the chain of
calls above it.

Nulls, empties, ties: a message without a text has no content. Text that is no JSON object is plain content. Of calls with one id
in a conversation the first by turn, text, role and place is linked; a message's own repeated ids are counted. Answers with one id all
follow their call, by turn. A conversation id that is null is a conversation of its own; a turn that is null counts as the last.
Messages equal in turn are in the order of text and role. An unknown tool is not valid, nor are arguments that are no
object; absent ones are an empty object. Columns other than the four are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subweave.store import stored

#: Stands for a turn that is null.
_LAST = (1 << 62) - 1
#: Characters of a text that ranges are told apart by, and salts over which the answers to one message are dealt.
PREFIX, SALTS = 256, 16


@dataclass(frozen=True)
class Schema:
    """A JSON type (string, integer, number, boolean, array, object) and what it may hold."""

    type: str
    enum: tuple[str, ...] = ()
    items: Schema | None = None
    properties: tuple[tuple[str, Schema], ...] = ()
    required: tuple[str, ...] = ()


@dataclass(frozen=True)
class Tool:
    name: str
    arguments: Schema


def _object(required: tuple[str, ...], **properties: Schema) -> Schema:
    return Schema("object", properties=tuple(properties.items()), required=required)


_TEXT, _INTEGER = Schema("string"), Schema("integer")
TOOLS = (
    Tool("search", _object(("query",), query=_TEXT, limit=_INTEGER)),
    Tool("fetch", _object(("url",), url=_TEXT, method=Schema("string", enum=("GET", "POST")), headers=Schema("array", items=_object(("name", "value"), name=_TEXT, value=_TEXT)))),
    Tool("calculate", _object(("expression",), expression=_TEXT, precision=_INTEGER)),
    Tool("weather", _object(("place",), place=_TEXT, days=_INTEGER, metric=Schema("boolean"))),
    Tool("now", _object(())),
)


def _is(value: Column, kind: str) -> Column:
    """Whether a variant is of the JSON type. A number without a fraction is an integer, however it is written."""
    name = F.schema_of_variant(value)
    if kind == "number":
        return name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL")
    if kind == "integer":
        number = F.try_variant_get(value, "$", "double")
        return (name == "BIGINT") | (_is(value, "number") & (number == F.floor(number)))
    if kind in ("array", "object"):
        return name.startswith(kind.upper())
    return name == {"string": "STRING", "boolean": "BOOLEAN"}[kind]


def valid(value: Column, schema: Schema) -> Column:
    """Whether a variant fits the schema; never null."""
    good = _is(value, schema.type)
    if schema.enum:
        good = good & F.try_variant_get(value, "$", "string").isin(*schema.enum)
    if schema.items:
        good = good & F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: valid(x, schema.items))
    if schema.type == "object":
        own = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        known = F.array(*(F.lit(k) for k, _ in schema.properties)) if schema.properties else F.array().cast("array<string>")
        good = good & (F.size(F.array_except(own, known)) == 0)
        for k, part in schema.properties:
            there = F.array_contains(own, k)
            fits = valid(F.try_variant_get(value, f"$['{k}']", "variant"), part)
            good = good & (there & fits if k in schema.required else ~there | fits)
    return F.coalesce(good, F.lit(False))


def _valid_call(call: Column, tools: tuple[Tool, ...]) -> Column:
    out = F.lit(False)
    for t in tools:
        out = F.when(call["name"] == t.name, valid(F.coalesce(call["arguments"], F.parse_json(F.lit("{}"))), t.arguments)).otherwise(out)
    return out


def _arguments(value: Column) -> Column:
    """Arguments that came as a JSON text are what it holds."""
    return F.when(F.schema_of_variant(value) == "STRING", F.coalesce(F.try_parse_json(F.try_variant_get(value, "$", "string")), value)).otherwise(value)


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with calls (array of id, name, arguments), answers (id of the call) and content, from their role and text."""
    body = F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text"))
    rows = messages.withColumn("body", body)
    calls = F.expr("try_variant_get(body, '$.tool_calls', 'array<variant>')")
    content = F.expr("try_variant_get(body, '$.content', 'string')")
    call = lambda c: F.struct(
        F.try_variant_get(c, "$.id", "string").alias("id"),
        F.try_variant_get(c, "$.name", "string").alias("name"),
        _arguments(F.try_variant_get(c, "$.arguments", "variant")).alias("arguments"),
    )
    rows = rows.withColumn("calls", F.transform(calls, call)).withColumn("answers", F.when(F.col("role") == "tool", F.expr("try_variant_get(body, '$.tool_call_id', 'string')")))
    plain = F.col("calls").isNull() & F.col("answers").isNull()
    return rows.withColumn("content", F.when(plain, F.col("text")).otherwise(content)).drop("body")


def _ranked(messages: DataFrame) -> DataFrame:
    """The messages with rank, a long that ascends by conversation, turn, text and role.

    Ranges are told apart by the beginning of a text. Only where that is the whole text may its repeats fall into different
    ranges, as their order does not matter.
    """
    head, whole = F.substring("text", 1, PREFIX), F.coalesce(F.length("text") <= PREFIX, F.lit(True))
    rows = messages.withColumn("at", F.coalesce("turn", F.lit(_LAST))).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("conv_id", "at", head, ~whole, F.when(whole, F.col("role")), F.when(whole, F.col("row")))
    return stored(dealt.sortWithinPartitions("conv_id", "at", "text", "role").drop("row").withColumn("rank", F.monotonically_increasing_id()), "ranked")


def _met(rows: DataFrame, by: list[Column], own: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows in a hash join with own, whose keys do not repeat; the rows of one key are dealt over salts. rows has child."""
    salted = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("shuffle_hash")
    on = F.pmod(F.col("child"), F.lit(SALTS)) == F.col("_salt")
    for a, b in zip(by, keys, strict=True):
        on = on & a.eqNullSafe(F.col(b))
    return rows.join(salted, on, how).drop("_salt")


def links(ranked: DataFrame) -> DataFrame:
    """For each answer whose call is found: child and parent (ranks of the messages), place (of the call) and call_turn."""
    acting = parsed(ranked.where(F.ltrim("text").startswith("{")))
    made = acting.where("calls is not null").select("conv_id", "at", "rank", F.posexplode("calls").alias("place", "call")).where("call.id is not null")
    first = made.groupBy(F.col("conv_id").alias("c"), F.col("call.id").alias("id")).agg(F.min(F.struct("rank", "place", "at")).alias("f"))
    first = first.select("c", "id", F.col("f.rank").alias("parent"), F.col("f.place").cast("long").alias("place"), F.col("f.at").alias("call_turn"))
    answers = acting.where("answers is not null").select(F.col("rank").alias("child"), "conv_id", "answers")
    return stored(_met(answers, [F.col("conv_id"), F.col("answers")], first, ["c", "id"], "inner").select("child", "parent", "place", "call_turn"), "links")


def _doubled(tree: DataFrame, rounds: int, carried: str, joined: Column) -> DataFrame:
    """Pointers up the tree (child, up, and a carried column), twice as far each round, until none has farther to go."""
    state = tree
    for _ in range(rounds):
        above = state.select(F.col("child").alias("_of"), F.col("up").alias("_up"), F.col(carried).alias("_above"))
        state = _met(state, [F.col("up")], above, ["_of"], "left")
        state = state.select("child", F.coalesce("_up", "up").alias("up"), F.when(F.col("_of").isNull(), F.col(carried)).otherwise(joined).alias(carried), F.col("_of").isNotNull().alias("went"))
        state = stored(state, "pointers")
        if not state.where("went").limit(1).count():
            break
    return state


def ways(found: DataFrame) -> DataFrame:
    """child and key: the ranks of its root and of the messages below that, with the calls' places between them.

    A link that closes a circle is cut where the circle's message of the least rank is the child.
    """
    tree = found.select("child", F.col("parent").alias("up"), "place")
    rounds = math.ceil(math.log2(found.count() + 1)) + 1
    far = _doubled(tree.select("child", "up", F.col("up").alias("least")), rounds, "least", F.least("least", "_above"))
    round_ = far.where("went").select(F.col("up").alias("_node")).distinct()
    cut = far.join(round_, F.col("child") == F.col("_node"), "left_semi").where("least = child").select(F.col("child").alias("_cut"))
    tree = stored(tree.join(cut, F.col("child") == F.col("_cut"), "left_anti"), "tree")
    own = tree.select("child", "up", F.array("place", "child").alias("way"))
    return _doubled(own, rounds, "way", F.concat("_above", "way")).select("child", F.concat(F.array("up"), "way").alias("key"))


def ordered(messages: DataFrame) -> DataFrame:
    """The messages (conv_id, turn, role, text) with position (from 0 in each conversation), call_turn and linked."""
    ranked = _ranked(messages)
    found = links(ranked)
    placed = ranked.withColumn("call_turn", F.lit(None).cast("long")).withColumn("linked", F.lit(False))
    if found.limit(1).count():
        own = found.select("child", "call_turn").join(ways(found), "child", "left")
        keyed = ranked.join(own, F.col("rank") == F.col("child"), "left").withColumn("key", F.coalesce("key", F.array("rank"))).withColumn("linked", F.col("child").isNotNull())
        dealt = keyed.repartitionByRange("key").sortWithinPartitions("key").drop("key", "child").withColumn("rank", F.monotonically_increasing_id())
        placed = stored(dealt, "ordered")
    placed = placed.withColumn("range", F.shiftright("rank", 33))
    # conversations over more than one range: no more rows than twice the ranges, which the session's partitions bound
    counts = placed.groupBy("conv_id", "range").count()
    within, all_ = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv_id")
    counts = counts.select("conv_id", "range", F.sum("count").over(within).alias("base"), F.count("*").over(all_).alias("n")).where("n > 1 and base is not null")
    bases = F.broadcast(counts.select(F.col("conv_id").alias("bc"), F.col("range").alias("br"), "base"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("rank"))
    whole = placed.withColumn("nth", nth).join(bases, F.col("conv_id").eqNullSafe(F.col("bc")) & (F.col("range") == F.col("br")), "left")
    return whole.select("conv_id", "turn", "role", "text", (F.coalesce("base", F.lit(0)) + F.col("nth") - 1).alias("position"), F.when(F.col("call_turn") < _LAST, F.col("call_turn")).alias("call_turn"), "linked")


def formatted(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tools: tuple[Tool, ...] = TOOLS) -> DataFrame:
    """A row per message: conv_id, turn, role, position (from 0), call_turn and linked (of the call it answers), n_calls, n_bad_calls, n_repeated_ids, json."""
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    out = parsed(ordered(rows))
    counted = lambda n: F.when(F.col("calls").isNull(), 0).otherwise(n).cast("long")
    ids = F.transform("calls", lambda c: c["id"])
    out = out.withColumn("n_calls", counted(F.size("calls"))).withColumn("n_bad_calls", counted(F.size(F.filter("calls", lambda c: ~_valid_call(c, tools)))))
    out = out.withColumn("n_repeated_ids", counted(F.size(ids) - F.size(F.array_distinct(ids))))
    return out.select("conv_id", "turn", "role", "position", "call_turn", "linked", "n_calls", "n_bad_calls", "n_repeated_ids", _json().alias("json"))


def _json() -> Column:
    """Keys in alphabetical order; variants are written with theirs sorted too."""
    calls = F.transform("calls", lambda c: F.struct(c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    return F.to_json(F.struct("content", "conv_id", "role", F.col("answers").alias("tool_call_id"), calls.alias("tool_calls"), "turn"))


def written(rows: DataFrame, turn_start: str = "<|im_start|>", turn_end: str = "<|im_end|>") -> DataFrame:
    """formatted() with text: the message as a training text, to be joined by position."""
    body = F.coalesce(F.get_json_object("json", "$.content"), F.lit(""))
    calls = F.get_json_object("json", "$.tool_calls")
    whole = F.concat(F.lit(turn_start), F.coalesce("role", F.lit("")), F.lit("\n"), body, F.coalesce(F.concat(F.lit("\n"), calls), F.lit("")), F.lit(turn_end + "\n"))
    return rows.withColumn("text", whole)
