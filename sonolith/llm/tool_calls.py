"""Tool-call linking: calls meet their results by identifier, come in an order that respects their references, have
their arguments checked against the tool's schema, and are written as canonical JSON.

Calls and results are joined on (conversation, identifier), so one very long conversation is dealt out like any other
rows. A call refers to another by ``{"$ref": "<identifier>"}`` anywhere in its arguments. Its level is the length of
the longest chain of references behind it. Conversations of up to ``IN_ONE_TASK`` references are ordered by the task
that has them; longer ones by rounds over all their calls: a call that waits for one other only knows its level as
max(c, level + a), and such functions are composed, so that a chain of n calls takes log2(n) rounds.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, staged

IN_ONE_TASK = 100_000
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: object, kind: str) -> bool:
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    return isinstance(value, _TYPES.get(kind, object))


def usable(schema: object) -> bool:
    """Whether :func:`validate` can read a schema: true, false, or an object whose known keywords are of the right kind, all the way down. Other keywords are not looked at."""
    if isinstance(schema, bool):
        return True
    if not isinstance(schema, dict):
        return False
    kinds = schema.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    required, properties = schema.get("required", []), schema.get("properties", {})
    return (
        all(isinstance(k, str) and k in (*_TYPES, "number", "integer") for k in kinds)
        and isinstance(required, list) and all(isinstance(k, str) for k in required)
        and isinstance(properties, dict) and all(map(usable, properties.values()))
        and isinstance(schema.get("enum", []), list)
        and all(_is(schema.get(k, 0), "number") for k in ("minimum", "maximum"))
        and all(usable(schema.get(k, True)) for k in ("items", "additionalProperties"))
    )


def validate(value: object, schema: dict | bool, at: str = "$") -> list[str]:
    """Errors of a value against a usable schema (type, required, properties, additionalProperties, items, enum, minimum, maximum; true admits all, false nothing). A reference fits any schema."""
    if schema is False:
        return [f"{at}: not allowed"]
    if schema is True or (isinstance(value, dict) and set(value) == {"$ref"}):
        return []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not of type {'|'.join(kinds)}"]
    out = []
    if "enum" in schema and not any(value == e and isinstance(value, bool) == isinstance(e, bool) for e in schema["enum"]):
        out.append(f"{at}: not one of the allowed values")
    if _is(value, "number"):
        out += [f"{at}: less than {schema['minimum']}"] if value < schema.get("minimum", -math.inf) else []
        out += [f"{at}: more than {schema['maximum']}"] if value > schema.get("maximum", math.inf) else []
    if isinstance(value, dict):
        properties, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            out += validate(value[k], properties.get(k, others), f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        out += [e for i, v in enumerate(value) for e in validate(v, schema["items"], f"{at}[{i}]")]
    return out


_SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value: object) -> str:
    """Keys sorted, no white space, no escapes but the necessary ones (lone surrogates are among these)."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _number(text: str) -> float:
    if not math.isfinite(value := float(text)):
        raise ValueError(text)
    return value


def parse(text: str) -> object:
    """JSON in the strict sense: ``NaN``, ``Infinity`` and numbers beyond the range of a double are a ValueError. Of a repeated key the last value counts."""
    return json.loads(text, parse_constant=_number, parse_float=_number)


def references(value: object) -> list[str]:
    """The identifiers that a value refers to, each once."""
    found, open_ = {}, [value]
    while open_:
        x = open_.pop()
        if isinstance(x, dict):
            if isinstance(x.get("$ref"), str):
                found[x["$ref"]] = None
            open_ += x.values()
        elif isinstance(x, list):
            open_ += x
    return sorted(_SURROGATE.sub("\ufffd", r) for r in found)


@lru_cache(maxsize=256)
def _schema(text: str) -> dict | bool | None:
    """The schema; None if the text is not JSON or the schema is not usable."""
    try:
        schema = parse(text)
        return schema if usable(schema) else None
    except (RecursionError, ValueError):
        return None


def check(arguments: str | None, schema: str | None) -> tuple[str, list[str], list[str]]:
    """(arguments as canonical JSON, errors, references) of one call. What cannot be read stays text, as a JSON string."""
    raw = arguments if arguments is not None else "{}"
    try:
        value = parse(raw)
        written = canonical(value)
        read = None if schema is None else _schema(schema)
        errors = ["tool: unknown"] if schema is None else ["tool: bad schema"] if read is None else validate(value, read)
        return written, [_SURROGATE.sub("\ufffd", e) for e in errors], references(value)
    except RecursionError:
        return canonical(raw), ["$: nested too deeply"], []
    except ValueError:
        return canonical(raw), ["$: not JSON"], []


def levels(edges: list[tuple[int, int]]) -> dict[int, int | None]:
    """Level of every call of the references (call, call referred to): 0 without a reference, None in or behind a cycle."""
    waits: dict[int, int] = {}
    behind: dict[int, list[int]] = {}
    for a, b in edges:
        waits[a] = waits.get(a, 0) + 1
        waits.setdefault(b, 0)
        behind.setdefault(b, []).append(a)
    level: dict[int, int] = {x: 0 for x, n in waits.items() if not n}
    ready, high = list(level), dict.fromkeys(waits, 0)
    while ready:
        b = ready.pop()
        for a in behind.get(b, ()):
            high[a] = max(high[a], level[b] + 1)
            waits[a] -= 1
            if not waits[a]:
                level[a] = high[a]
                ready.append(a)
    return {x: level.get(x) for x in waits}


def _in_tasks(edges: DataFrame) -> DataFrame:
    """(``row_id``, ``level``) of the calls of bounded conversations, each ordered by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = ((c.as_py(), a.as_py(), b.as_py()) for x in batches for c, a, b in zip(*x.columns, strict=True))
        for _, group in groupby(every, key=lambda e: e[0]):
            found = levels([(a, b) for _, a, b in group])
            yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int32())], names=["row_id", "level"])

    return edges.select("conv_id", "row_id", "dep_row").repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(run, "row_id long, level int")


def _in_rounds(edges: DataFrame) -> DataFrame:
    """The same for conversations of any length. A round settles all calls whose references are settled, and lets calls that wait for one other only look through it."""
    nodes = edges.select(F.explode(F.array("row_id", "dep_row")).alias("row_id")).distinct()
    waiting = edges.select("row_id", F.col("dep_row").alias("dep"), F.lit(1).alias("a"), F.lit(0).alias("c")).distinct().checkpoint()
    settled = nodes.join(waiting.select("row_id").distinct(), "row_id", "left_anti").withColumn("level", F.lit(0)).checkpoint()
    out, new = [settled], settled
    while not new.isEmpty():
        known = new.select(F.col("row_id").alias("dep"), F.col("level").alias("known"))
        met = waiting.join(known, "dep", "left").withColumn("low", F.when(F.col("known").isNotNull(), F.greatest("c", F.col("known") + F.col("a"))))
        # what is settled goes into the least level that each call has by now
        per = met.groupBy("row_id").agg(F.max(F.coalesce("low", "c")).alias("c"), F.collect_set(F.when(F.col("low").isNull(), F.struct("dep", "a"))).alias("open")).checkpoint()
        new = per.where(F.size("open") == 0).select("row_id", F.col("c").alias("level")).checkpoint()
        left = per.where(F.size("open") > 0).select("row_id", "c", F.size("open").alias("n_open"), F.explode("open").alias("o")).select("row_id", "c", "n_open", "o.dep", "o.a")
        through = left.where("n_open = 1").select(F.col("row_id").alias("dep"), F.col("dep").alias("next"), F.col("a").alias("a2"), F.col("c").alias("c2"))
        jumped = left.join(through, "dep", "left")
        waiting = jumped.select("row_id", F.coalesce("next", "dep").alias("dep"), (F.col("a") + F.coalesce("a2", F.lit(0))).alias("a"), F.greatest("c", F.coalesce(F.col("c2") + F.col("a"), F.lit(0))).alias("c")).checkpoint()
        out.append(new)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.unionByName(waiting.select("row_id").distinct().withColumn("level", F.lit(None).cast("int")))


def _ordered(calls: DataFrame, heads: DataFrame, in_one_task: int) -> tuple[DataFrame, DataFrame]:
    """(``row_id, level`` of all calls with references and of those referred to; ``row_id`` of calls with an unknown reference)."""
    edges = staged(calls.select("conv_id", "row_id", F.explode("refs").alias("call_id")).where("conv_id IS NOT NULL"), "references")
    targets = staged(edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n")).join(heads.select("conv_id", "call_id", F.col("first").alias("dep_row")), ["conv_id", "call_id"], "left"), "referred")
    met = staged(join_spread(edges, targets, ["conv_id", "call_id"], "n").select("conv_id", "row_id", "dep_row"), "resolved")
    known = met.where("dep_row IS NOT NULL")
    long = staged(known.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > in_one_task).select("conv_id"), "long-conversations")
    found = _in_tasks(known.join(long, "conv_id", "left_anti"))
    if not long.isEmpty():
        found = found.unionByName(_in_rounds(known.join(long, "conv_id", "left_semi")))
    return found, met.where("dep_row IS NULL").select("row_id").distinct()


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """One row per call, and one per result without a call.

    ``calls``: conv_id, call_id, seq, name, arguments (JSON text). ``results``: conv_id, call_id, seq, content.
    ``schemas``: name, schema (JSON text). Other columns are not read, whatever their names. Returns conv_id, call_id,
    seq, level, name, status, errors, record: sorted by (level, seq) the calls of a conversation are in topological
    order (null level: in or behind a cycle, last). Calls without a known reference have level 0.

    Status: ``linked``; ``pending`` (no result); ``repeated`` (its identifier belongs to an earlier call of the
    conversation; it gets no result); ``orphan`` (result without call). Ties: of calls with one identifier the first by
    ``seq`` counts, then by a hash of name and arguments; of rows that are equal one is linked and the others are
    repeated. Of several results the first counts, ties by content. A reference means the call that counts.
    Calls without conversation or identifier are pending; results without either are dropped. Null arguments are an
    empty object; what is not JSON or nested too deeply is an error and stays text in the record. Unknown tools and
    unknown references are errors; of several schemas of a name the smallest text counts, and one that is not JSON or
    not of the right kind is the error ``tool: bad schema`` of every call of the tool. Empty tables give no rows.
    """
    tools = schemas.where("name IS NOT NULL").groupBy("name").agg(F.min("schema").alias("schema"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [check(x.as_py(), y.as_py()) for x, y in zip(b.column("arguments"), b.column("schema"), strict=True)]
            more = pa.array([r[0] for r in read], pa.string()), pa.array([r[1] for r in read], pa.list_(pa.string())), pa.array([r[2] for r in read], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), *more], names=[*keys, "written", "errors", "refs"])

    keys = ["conv_id", "call_id", "seq", "name", "tie"]
    given = calls.select("conv_id", "call_id", "seq", "name", "arguments", F.xxhash64("name", "arguments").alias("tie")).join(tools, "name", "left")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.select(*keys).schema.fields)
    read = given.select(*keys, "arguments", "schema").mapInArrow(run, f"{kinds}, written string, errors array<string>, refs array<string>")
    read = staged(read.withColumn("row_id", F.monotonically_increasing_id()), "calls")

    named = read.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    heads = named.groupBy("conv_id", "call_id").agg(F.min(F.struct("seq", "tie", "row_id"))["row_id"].alias("first"), F.count("*").alias("n"))
    answers = results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("seq", "content")).alias("answer"))
    identifiers = staged(heads.join(answers, ["conv_id", "call_id"], "full_outer"), "identifiers")
    met = join_spread(named, identifiers.where("first IS NOT NULL"), ["conv_id", "call_id"], "n")
    alone = read.where("conv_id IS NULL OR call_id IS NULL").withColumn("status", F.lit("pending")).withColumn("content", F.lit(None).cast("string"))
    status = F.when(F.col("row_id") != F.col("first"), "repeated").when(F.col("answer").isNull(), "pending").otherwise("linked")
    linked = met.withColumn("status", status).withColumn("content", F.when(F.col("status") == "linked", F.col("answer.content"))).drop("first", "answer").unionByName(alone)

    found, unknown = _ordered(read, identifiers.where("first IS NOT NULL"), in_one_task)
    marks = found.withColumn("is_ordered", F.lit(True)).join(unknown.withColumn("is_unknown", F.lit(True)), "row_id", "full_outer")
    rows = linked.join(marks, "row_id", "left")
    text = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(F.col(c).cast("string").alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))
    result = F.when(F.col("status") == "linked", F.concat(F.lit(',"result":'), text("content"))).otherwise("")
    record = F.concat(F.lit('{"arguments":'), "written", F.lit(',"call_id":'), text("call_id"), F.lit(',"name":'), text("name"), result, F.lit("}"))
    level = F.when(F.col("is_ordered"), F.col("level")).otherwise(0)
    errors = F.when(F.col("is_unknown"), F.array_append("errors", F.lit("reference: unknown"))).otherwise(F.col("errors"))
    every = rows.select("conv_id", "call_id", "seq", level.cast("int").alias("level"), "name", "status", errors.alias("errors"), record.alias("record"))
    orphan = F.concat(F.lit('{"call_id":'), text("call_id"), F.lit(',"result":'), text("content"), F.lit("}"))
    lost = identifiers.where("first IS NULL").withColumn("content", F.col("answer.content"))
    kind = {f.name: f.dataType for f in every.schema.fields}
    return every.unionByName(lost.select("conv_id", "call_id", F.lit(None).cast(kind["seq"]).alias("seq"), F.lit(None).cast("int").alias("level"), F.lit(None).cast(kind["name"]).alias("name"), F.lit("orphan").alias("status"), F.array().cast("array<string>").alias("errors"), orphan.alias("record")))


#: Tools as which turns of plain conversations are read, and what they take.
SCHEMAS = {
    "answer": {"type": "object", "properties": {"text": {"type": "string"}, "words": {"type": "integer", "minimum": 1, "maximum": 250}, "after": {"type": "object"}}, "required": ["text", "words"], "additionalProperties": False},
    "greet": {"type": "object", "properties": {"text": {"type": "string"}, "words": {"type": "integer", "minimum": 1, "maximum": 50}, "after": {"type": "object"}}, "required": ["text", "words"], "additionalProperties": False},
}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas from a table of plain turns (conv_id, turn, role, text).

    Each assistant turn is a call (``greet`` up to turn 1, else ``answer``); each user turn is the result of the call of
    the turn before it, if that was the assistant's. System turns and an opening user turn are neither and not read.
    Calls refer to one another: the first of every four (turns 1, 9, 17, ...) to the one after it, the second to the
    last of the four before, the others to the one before.
    """
    spark = conversations.sparkSession
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\\s+"), lambda w: w != ""))
    step = F.when(F.col("turn") % 8 == 1, 2).when(F.col("turn") == 3, None).when(F.col("turn") % 8 == 3, -4).otherwise(-2)
    ref = F.when(step.isNotNull() & (F.col("turn") + step > 0), F.struct(F.concat(F.lit("t"), F.col("turn") + step).alias("$ref")))
    calls = conversations.where("role = 'assistant'").select("conv_id", F.concat(F.lit("t"), "turn").alias("call_id"), F.col("turn").alias("seq"), F.when(F.col("turn") <= 1, "greet").otherwise("answer").alias("name"), F.to_json(F.struct("text", words.alias("words"), ref.alias("after"))).alias("arguments"))
    results = conversations.where("role = 'user' AND turn > 0").select("conv_id", F.concat(F.lit("t"), F.col("turn") - 1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return calls, results, spark.createDataFrame([(k, canonical(v)) for k, v in SCHEMAS.items()], "name string, schema string")
