"""Chat formatting: tool calls linked to results, ordered topologically, validated, as canonical JSON.

`link` takes two tables:

* calls: conv_id long, call_id string, parent_id string (the call that must come first, or null), name string,
  arguments string (JSON);
* results: conv_id long, call_id string, content string.

1. Calls and results are dealt by (conv_id, call_id) and meet in a shuffled hash join: both sides have one row an
   identifier by then, so a hash table has its share of identifiers and no hot one. A call without a result stays,
   `pending`; a result without a call stays, `orphan`. Of several calls of one identifier the smallest arguments win,
   of several results the smallest content; n_calls and n_results tell how many there were.
2. Topological order. Parents make a forest (or cycles, which are marked). Depths are found by pointer doubling:
   each round every open call adds its ancestor's depth to its own and jumps to its ancestor's ancestor, a hash join,
   so a chain of d calls takes log2(d) + 1 rounds and no conversation is gathered in one task. A round writes the
   calls that are still open, and those that it finishes once. A parent that doesn't exist counts as none.
3. Arguments are checked against the tool's JSON schema (type, required, properties, additionalProperties, enum,
   minimum, maximum, minLength, maxLength, items), in Arrow batches; schemas are a small parameter.
4. Each linked call is one canonical JSON object: keys sorted, no white space, shortest numbers, UTF-8 unescaped.

Arguments that are null or aren't JSON are invalid and stand as a JSON string or null. So do arguments nested more than
NESTED deep, which a reader may refuse (RFC 8259, section 9); the problem says which it was. Integers have any number of
digits, numbers beyond a double's range are null. A lone surrogate, which UTF-8 can't hold, stays an escape, \\udxxx. A null
conv_id is a conversation of its own; rows with null call_id never link: each is pending or orphan. Null content is JSON
null. Tables without rows give an empty result; columns besides those named are not read, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: How a depth is written where a call's ancestors never end.
CYCLE = -1
#: Arrays and objects inside one another.
NESTED = 200

_LONE = re.compile("[\ud800-\udfff]")
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"?', re.DOTALL)


@contextmanager
def _any_digits():
    """Integers of any length are read and written."""
    most = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)
    try:
        yield
    finally:
        sys.set_int_max_str_digits(most)


def _valid(text: str) -> str:
    """Lone surrogates as escapes, so that the text has a UTF-8 form."""
    return _LONE.sub(lambda found: f"\\u{ord(found[0]):04x}", text)


def canonical(value) -> str:
    """JSON text with sorted keys, no white space and numbers in their shortest form."""
    with _any_digits():
        return _valid(json.dumps(_plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


def nesting(text: str) -> int:
    """How deep brackets and braces stand inside one another, strings apart."""
    if text.count("[") + text.count("{") <= NESTED:
        return 0
    deep = most = 0
    for c in _STRING.sub("", text):
        if c in "[{":
            deep += 1
            most = max(most, deep)
        elif c in "]}":
            deep -= 1
    return most


def _plain(value):
    if isinstance(value, float):
        if not math.isfinite(value):
            return None
        return int(value) if value.is_integer() and abs(value) < 1e21 else value
    if isinstance(value, dict):
        return {k: _plain(x) for k, x in value.items()}
    return [_plain(x) for x in value] if isinstance(value, list) else value


_TYPES = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "integer": lambda x: not isinstance(x, bool) and (isinstance(x, int) or isinstance(x, float) and x.is_integer()),
}


def errors(value, schema: dict, at: str = "$") -> list[str]:
    """What breaks the schema, each with its place."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_TYPES[k](value) for k in kinds):
            return [f"{at}: not of type {'/'.join(kinds)}"]
    out = []
    if "enum" in schema and not any(x == value and isinstance(x, bool) == isinstance(value, bool) for x in schema["enum"]):
        out.append(f"{at}: not one of the values")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", math.inf):
            out.append(f"{at}: too long")
    if _TYPES["number"](value):
        if value < schema.get("minimum", -math.inf):
            out.append(f"{at}: too small")
        if value > schema.get("maximum", math.inf):
            out.append(f"{at}: too large")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += errors(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in own:
                out += errors(value[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not known")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += errors(value[k], schema["additionalProperties"], f"{at}.{k}")
    return out


def _read(text: str | None) -> tuple[object, str | None]:
    """The value of JSON text and what is wrong with it as JSON."""

    def refuse(name: str):
        raise ValueError(name)

    if text is None:
        return None, "$: not JSON"
    if nesting(text) > NESTED:
        return text, "$: nested too deep"
    try:
        with _any_digits():
            return json.loads(text, parse_constant=refuse), None
    except ValueError:
        return text, "$: not JSON"


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, depth of calls with unique identifiers: 0 without a parent, CYCLE if it never ends."""
    key = ["conv_id", "call_id"]
    nodes = calls.select(*key, F.col("parent_id").alias("up"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("i"))
    parents = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i")).hint("shuffle_hash")
    rows = nodes.join(parents, same, "left").select(*key, F.when(F.col("i").isNotNull(), F.col("up")).alias("up"))
    state = common.written(rows.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")), "depths")
    done, open_ = state.filter("up is null").select(*key, "depth"), state.filter("up is not null")
    total = state.count()
    while not open_.isEmpty():
        above = open_.unionByName(done.withColumn("up", F.lit(None).cast("string")))
        above = above.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("up").alias("beyond"), F.col("depth").alias("more")).hint("shuffle_hash")
        # who jumps gains a pointer twice as far; whose ancestor is a root is done
        met = open_.join(above, same).select(*key, F.col("beyond").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        met = common.written(met, "depths")
        done = done.unionByName(met.filter("up is null").select(*key, "depth"))
        open_ = met.filter("up is not null")
        deepest = open_.agg(F.max("depth").alias("d")).first().d
        # deeper than there are calls: only cycles are left
        if deepest is not None and deepest > 2 * total:
            return done.unionByName(open_.select(*key, F.lit(CYCLE).cast("long").alias("depth")))
    return done


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, call_id, state (linked, pending, orphan), depth, n_calls, n_results, valid, problems, json."""
    key = ["conv_id", "call_id"]
    calls = calls.select(F.col("conv_id").cast("long").alias("conv_id"), "call_id", "parent_id", "name", "arguments")
    results = results.select(F.col("conv_id").cast("long").alias("conv_id"), "call_id", "content")
    # min of a struct, not a list: copies of an identifier meet as one row a map task
    call = F.min(F.struct(F.col("arguments"), F.col("name"), F.col("parent_id"))).alias("call")
    single = calls.filter("call_id is not null").groupBy(*key).agg(call, F.count(F.lit(1)).alias("n_calls"))
    single = single.select(*key, "call.parent_id", "call.name", "call.arguments", "n_calls")
    answers = results.filter("call_id is not null").groupBy(F.col("conv_id").alias("c"), F.col("call_id").alias("i")).agg(F.min(F.struct(F.col("content").isNull(), "content"))["content"].alias("content"), F.count(F.lit(1)).alias("n_results"))
    single = common.written(single, "calls")
    answers = answers.hint("shuffle_hash")
    # a missing half counts none of its kind
    both = single.join(answers, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")), "full")
    both = both.select(
        F.when(F.col("n_calls").isNotNull(), F.col("conv_id")).otherwise(F.col("c")).alias("conv_id"),
        F.coalesce("call_id", "i").alias("call_id"),
        *("parent_id", "name", "arguments", "content"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
    )
    deep = depths(single).select(F.col("conv_id").alias("dc"), F.col("call_id").alias("di"), "depth").hint("shuffle_hash")
    both = both.join(deep, F.col("conv_id").eqNullSafe(F.col("dc")) & (F.col("call_id") == F.col("di")), "left").drop("dc", "di")
    nameless = calls.filter("call_id is null").select(*key, "parent_id", "name", "arguments", F.lit(None).cast("string").alias("content"), F.lit(1).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_results"), F.lit(0).cast("long").alias("depth"))
    unasked = results.filter("call_id is null").select(*key, *[F.lit(None).cast("string").alias(c) for c in ("parent_id", "name", "arguments")], "content", F.lit(0).cast("long").alias("n_calls"), F.lit(1).cast("long").alias("n_results"), F.lit(None).cast("long").alias("depth"))
    both = both.select(nameless.columns).unionByName(nameless).unionByName(unasked)
    both = both.withColumn("state", F.when(F.col("n_calls") == 0, "orphan").when(F.col("n_results") == 0, "pending").otherwise("linked"))
    return both.mapInArrow(_formatter(schemas), "conv_id long, call_id string, state string, depth long, n_calls long, n_results long, valid boolean, problems array<string>, json string")


def _formatter(schemas: dict[str, dict]):
    schema = pa.schema([("conv_id", pa.int64()), ("call_id", pa.string()), ("state", pa.string()), ("depth", pa.int64()), ("n_calls", pa.int64()), ("n_results", pa.int64()), ("valid", pa.bool_()), ("problems", pa.list_(pa.string())), ("json", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("valid", "problems", "json")}
            for row in batch.to_pylist():
                value, problems = None, []
                if row["n_calls"]:
                    value, wrong = _read(row["arguments"])
                    if wrong:
                        problems = [wrong]
                    elif row["name"] not in schemas:
                        problems = ["$: no such tool"]
                    else:
                        problems = [_valid(x) for x in errors(value, schemas[row["name"]])]
                out["valid"].append(not problems if row["n_calls"] else None)
                out["problems"].append(problems)
                shown = {"call_id": row["call_id"], "state": row["state"]}
                if row["n_calls"]:
                    shown |= {"name": row["name"], "arguments": value, "valid": not problems}
                if row["n_results"]:
                    shown["result"] = row["content"]
                out["json"].append(canonical(shown))
            yield from common.emit({c: batch.column(c) for c in schema.names[:6]} | out, schema, 2000)

    return run


#: The tools that a plain conversation is read as.
SCHEMAS = {
    "reply": {
        "type": "object",
        "required": ["prompt", "turn"],
        "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 1000}, "turn": {"type": "integer", "minimum": 0}},
    }
}


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text), by arithmetic on turns alone.

    A user's turn t calls `reply` as "conv:t"; an assistant's turn t is the result of "conv:t-1"; a call's parent is
    the call that the turn before it answered, "conv:t-2". Turns of other roles, or of null role, make neither.
    """
    name = lambda back: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), (F.col("turn") - back).cast("string"))
    named = lambda back: F.when(F.col("turn").isNotNull(), name(back))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn")), {"ignoreNullFields": "false"})
    calls = conversations.filter("role = 'user'").select("conv_id", named(0).alias("call_id"), named(2).alias("parent_id"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    results = conversations.filter("role = 'assistant'").select("conv_id", named(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
