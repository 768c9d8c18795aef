"""Chat formatting with linked tool calls.

Calls and results meet by a hash join on conversation and identifier, calls are put into topological order (a level is
the longest chain of calls a call waits for; chains are walked by pointer doubling), arguments are validated against the schema
of the tool, and each linked record is written as canonical JSON (sorted keys, no spaces, shortest escapes).
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import stash

#: The tool that plain chats are expressed with, and what its arguments must be.
REPLY_SCHEMA = {"reply": {"required": ["prompt", "turn"], "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 600}, "turn": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with ``value``: type, enum, required, additionalProperties, items and the usual bounds."""
    out = []
    kind = schema.get("type")
    if kind and (not isinstance(value, _TYPES[kind]) or kind in ("integer", "number") and isinstance(value, bool)):
        return [f"{at}: not {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, str):
        out += [f"{at}: {k}" for k, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", len(value)))) if bad]
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: {k}" for k, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(known.keys() & value.keys()):
            out += violations(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    return out


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _waits(calls: DataFrame) -> Column:
    """``waits_for`` as an array, whether it names one call or several."""
    if isinstance(calls.schema["waits_for"].dataType, T.ArrayType):
        return F.coalesce("waits_for", F.array().cast("array<string>"))
    return F.when(F.col("waits_for").isNull(), F.array().cast("array<string>")).otherwise(F.array("waits_for"))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of each call: the longest chain of calls it waits for; null on and behind cycles.

    ``waits_for`` (one identifier or an array) names calls of the same conversation; names of no call count as none.
    Repeated calls wait for what any of them waits for. Runs of calls that wait for one call each are walked by pointer
    doubling, so a chain of n calls takes log2 n joins on identifiers; calls that wait for several are then levelled a
    round for each such call on the deepest path. No conversation is gathered.
    """
    node = F.struct("conv_id", "call_id").alias("k")
    asked = calls.filter("call_id is not null").select(node, _waits(calls).alias("w"))
    nodes = asked.select("k").distinct()
    edges = asked.select("k", F.explode("w").alias("w")).select("k", F.struct(F.col("k.conv_id").alias("conv_id"), F.col("w").alias("call_id")).alias("up")).distinct()
    edges = stash(edges.join(nodes.select(F.col("k").alias("up")), "up", "left_semi"), "waits")
    alone = edges.groupBy("k").agg(F.count("*").alias("n"), F.min("up").alias("one"))
    start = nodes.join(alone, "k", "left")
    single = F.coalesce(F.col("n") == 1, F.lit(False))
    step = stash(start.select("k", F.when(single, F.col("one")).otherwise(F.col("k")).alias("at"), single.cast("long").alias("dist"), (~single).alias("done"), F.coalesce("n", F.lit(0)).alias("n")), "levels")
    for _ in range(max(2, step.count()).bit_length() + 1):
        if not step.filter("not done").head(1):
            break
        above = step.select(F.col("k").alias("at"), F.col("at").alias("at2"), F.col("dist").alias("more"), F.col("done").alias("done2"))
        step = stash(step.join(above, "at").select("k", F.col("at2").alias("at"), (F.col("dist") + F.col("more")).alias("dist"), F.col("done2").alias("done"), "n"), "levels")
    known = step.filter("n = 0").select("k", F.lit(0).cast("long").alias("level"))
    joints = edges.join(step.filter("n > 1").select("k"), "k", "left_semi").join(step.select(F.col("k").alias("up"), "at", "dist", "done"), "up")
    while True:
        reach = joints.join(known.select(F.col("k").alias("at"), "level"), "at", "left").groupBy("k")
        ready = reach.agg(F.bool_and(F.col("done") & F.col("level").isNotNull()).alias("ok"), (F.max(F.col("dist") + F.col("level")) + 1).alias("level")).filter("ok").select("k", "level")
        fresh = stash(ready.join(known, "k", "left_anti"), "joints")
        if not fresh.head(1):
            break
        known = stash(known.union(fresh), "known")
    out = step.join(known.select(F.col("k").alias("at"), "level"), "at", "left")
    return out.select("k.conv_id", "k.call_id", F.when(F.col("done"), F.col("level") + F.col("dist")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """conv_id, turn, call_id, level, status, valid, errors, record.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), waits_for (an identifier or an array of them);
    ``results``: conv_id, turn, call_id, content. Further columns of either are not looked at. Identifiers are those of
    a conversation (a null conv_id is one more conversation), so the same identifier elsewhere is another call. Of
    repeated identifiers the first by (turn, arguments or content) counts. Status is linked, unanswered (no result) or
    orphan (a result without a call; its level and valid are null). Arguments that are no JSON, or of an unknown tool,
    are invalid. Null identifiers take no part. Very long arguments and contents go through whole. Empty tables give no
    rows.
    """
    key = F.struct("conv_id", "call_id").alias("k")
    one_call = calls.filter("call_id is not null").groupBy(key).agg(F.min(F.struct("turn", "name", "arguments")).alias("c"))
    one_result = results.filter("call_id is not null").groupBy(key).agg(F.min(F.struct("turn", "content")).alias("r"))
    order = levels(calls).select(key, "level")
    both = one_call.join(one_result, "k", "full").join(order, "k", "left")
    rows = both.select("k.conv_id", F.coalesce("c.turn", "r.turn").alias("turn"), "k.call_id", "level", F.when(F.col("c").isNull(), "orphan").when(F.col("r").isNull(), "unanswered").otherwise("linked").alias("status"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("r.content").alias("content"))

    def write(batches):
        for b in batches:
            valid, errors, record = [], [], []
            for call_id, level, status, name, arguments, content in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5, 6, 7)), strict=True):
                value, wrong = None, None
                if status != "orphan":
                    try:
                        value = json.loads(arguments or "")
                        wrong = violations(value, schemas[name]) if name in schemas else [f"unknown tool {name}"]
                    except (ValueError, TypeError):
                        wrong = ["no JSON"]
                valid.append(None if wrong is None else not wrong)
                errors.append(None if wrong is None else "; ".join(wrong))
                record.append(canonical({"arguments": value, "id": call_id, "level": level, "name": name, "result": content, "status": status}))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(record, pa.string())], names=["conv_id", "turn", "call_id", "level", "status", "valid", "errors", "record"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(write, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, call_id string, level long, status string, valid boolean, errors string, record string")


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain chats: a user turn calls ``reply``, the assistant turn after it is the result, and a
    call waits for the one two turns before. Rows without conversation or turn, and other roles, are no calls."""
    turns = conversations.filter("conv_id is not null and turn is not null")
    call_id = lambda back: F.concat_ws("-", "conv_id", (F.col("turn") - back).cast("string"))
    calls = turns.filter("role = 'user'").select("conv_id", "turn", call_id(0).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"), call_id(2).alias("waits_for"))
    results = turns.filter("role = 'assistant'").select("conv_id", "turn", call_id(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def chat(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, level, status, valid, errors, record: the rows of ``link`` and a row for every other turn.

    A turn that is no part of a linked record keeps its role and text in a record of its own. Its status is turn (a
    role other than user and assistant), repeated (another text under the conversation, turn and role of a call or
    result that counts) or unplaced (no conversation or turn); call_id, level, valid and errors are null. Equal rows are one.
    """
    linked = link(*from_turns(conversations), REPLY_SCHEMA)
    turns = conversations.select("conv_id", "turn", "role", "text").distinct()
    talks = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    # as in ``link``: of repeated calls the least JSON counts, of repeated results the least text, null first
    prompt = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))
    order = F.when(F.col("role") == "user", prompt).otherwise(F.col("text"))
    placed = turns.filter("conv_id is not null and turn is not null").filter(talks)
    first = placed.groupBy("conv_id", "turn", "role").agg(F.min(F.struct(order.alias("o"))).alias("f"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = placed.withColumn("o", order).join(first, ["conv_id", "turn", "role"]).filter(~F.col("o").eqNullSafe(F.col("f.o")))
    columns = ["conv_id", "turn", "role", "text"]
    unplaced = turns.filter("conv_id is null or turn is null").select(*columns, F.lit("unplaced").alias("status"))
    other = turns.filter("conv_id is not null and turn is not null").filter(~talks).select(*columns, F.lit("turn").alias("status"))
    rows = other.union(unplaced).union(repeated.select(*columns, F.lit("repeated").alias("status")))

    names = linked.columns

    def write(batches):
        for b in batches:
            record = [canonical({"conversation": c, "role": r, "status": s, "text": x, "turn": t}) for c, t, r, x, s in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), b.column(4), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string()), pa.array(record, pa.string())], names=names)

    kinds = dict(rows.dtypes)
    return linked.union(rows.mapInArrow(write, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, call_id string, level long, status string, valid boolean, errors string, record string"))
