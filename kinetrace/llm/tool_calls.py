"""Chat formatting: tool calls linked with their results, in canonical JSON.

Events are read from turns (conv_id, turn, role, text): a JSON object with "tool_calls" holds calls ({"id", "name",
"arguments"}, also under "function", arguments as object or as JSON text); one with "tool_call_id" is a result. Any
other turn is a message; with `exchanges`, a user's message is a call of the tool "reply" with the message as its
argument, and the assistant's message of the next turn is its result, so plain conversations are linked the same way.

Calls and results are hash-joined by (conv_id, id). A call may use results of earlier turns, and of calls of its own
message, named as {"$result": id} anywhere in its arguments; calls of a message are put in topological order, and turns
follow each other, so (turn, position) is a topological order of the conversation whatever its length. References that
no earlier call answers, and cycles, are reported. Arguments are validated against the tool's schema. Each event is
serialised as canonical JSON: keys sorted, no spaces, shortest numbers, text as it is.

Of calls (or results) with the same id in a conversation the first by (turn, position) counts, others are "duplicate"; ties
go to the smaller digest of the body; equal rows that repeat are one event. Null conv_id or turn makes a key of its own
that links with nothing; null roles and texts count as empty. White space around JSON doesn't count. Text that is no valid
JSON (NaN and infinite numbers are none) is a message, one nested too deeply a message with that problem; texts of any
length are read whole. Lone surrogates are written as escapes (\\udXXX) in bodies, ids and names. Extra columns of any
name are not read. Empty tables give no rows. Rows are one for each event, never one for a conversation, so long
conversations stay spread over tasks.
"""

from __future__ import annotations

import json
import math
import re
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batch, stored

EVENTS = "conv_id long, turn long, position long, kind string, role string, call_id string, name string, body string, uses array<string>, problems array<string>"
REPLY = {"reply": {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}}, "required": ["prompt"], "additionalProperties": False}}


#: Rows of a hash join's build side for each partition; beyond it the sides are sorted and merged.
BUILD = 1_000_000
_SURROGATE = re.compile("[\ud800-\udfff]")


def _encodable(s: str) -> str:
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", s)


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, and whole numbers without a fraction."""
    return _encodable(json.dumps(_plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False))


def _plain(v):
    if isinstance(v, float):
        return int(v) if v.is_integer() and abs(v) < 2**53 else v
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def _number(s: str) -> float:
    if not math.isfinite(v := float(s)):
        raise ValueError(s)
    return v


def _loads(text: str):
    """JSON without NaN and infinite numbers, which canonical JSON has no form for."""
    return json.loads(text, parse_float=_number, parse_constant=_number)


_TYPES = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}
#: Keywords that say nothing about validity.
_NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment", "$defs", "definitions", "deprecated", "readOnly", "writeOnly"}
_KNOWN = {
    "type", "enum", "const", "required", "properties", "additionalProperties", "minProperties", "maxProperties", "items", "minItems", "maxItems", "uniqueItems",
    "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "anyOf", "oneOf", "allOf", "not", "$ref",
}


def _target(ref: str, root):
    """The schema that a reference within the root schema names, or None."""
    for step in ref[2:].split("/") if ref.startswith("#/") else [] if ref == "#" else [None]:
        step = step and step.replace("~1", "/").replace("~0", "~")
        if not isinstance(root, dict) or step not in root:
            return None
        root = root[step]
    return root


def violations(value, schema, path: str = "$", root=None) -> list[str]:
    """What a value breaks of a schema; keywords, types and references that are not supported are reported too."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return [] if schema else [f"{path}: not allowed"]
    out, kinds = [f"{path}: unsupported keyword {k}" for k in sorted(schema.keys() - _KNOWN - _NOTES)], schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        out += [f"{path}: unsupported type {k}" for k in kinds if k not in _TYPES]
        if not any(_TYPES[k](value) for k in kinds if k in _TYPES):
            return out + [f"{path}: not {schema['type']}"]
    if "$ref" in schema:
        other = _target(schema["$ref"], root)
        out += [f"{path}: unsupported reference {schema['$ref']}"] if other is None else violations(value, other, path, root)
    same = lambda x: canonical(x) == canonical(value)  # noqa: E731  (1 and true differ, 1 and 1.0 do not)
    if "enum" in schema and not any(map(same, schema["enum"])):
        out.append(f"{path}: not in enum")
    if "const" in schema and not same(schema["const"]):
        out.append(f"{path}: not the constant")
    fits = lambda key: sum(not violations(value, s, path, root) for s in schema[key])
    out += [x for s in schema.get("allOf", ()) for x in violations(value, s, path, root)]
    if "anyOf" in schema and not fits("anyOf") or "oneOf" in schema and fits("oneOf") != 1 or "not" in schema and not violations(value, schema["not"], path, root):
        out.append(f"{path}: no fitting alternative")
    bounds = []
    if isinstance(value, dict):
        known, rest = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{path}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}", root)
            elif rest is False:
                out.append(f"{path}.{k}: unexpected")
            elif rest is not True:
                out += violations(value[k], rest, f"{path}.{k}", root)
        bounds = [("minProperties", "maxProperties", len(value))]
    elif isinstance(value, list):
        if "items" in schema:
            out += [x for i, v in enumerate(value) for x in violations(v, schema["items"], f"{path}[{i}]", root)]
        if schema.get("uniqueItems") and len({canonical(v) for v in value}) < len(value):
            out.append(f"{path}: repeated items")
        bounds = [("minItems", "maxItems", len(value))]
    elif isinstance(value, str):
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{path}: not like the pattern")
        bounds = [("minLength", "maxLength", len(value))]
    elif _TYPES["number"](value):
        bounds = [("minimum", "maximum", value)]
        if value <= schema.get("exclusiveMinimum", -math.inf) or value >= schema.get("exclusiveMaximum", math.inf):
            out.append(f"{path}: out of bounds")
        if "multipleOf" in schema and Fraction(str(value)) % Fraction(str(schema["multipleOf"])):
            out.append(f"{path}: no multiple")
    if any(low in schema and v < schema[low] or high in schema and v > schema[high] for low, high, v in bounds):
        out.append(f"{path}: out of bounds")
    return out


def _uses(v) -> list[str]:
    if isinstance(v, dict):
        if set(v) == {"$result"} and isinstance(v["$result"], str):
            return [_encodable(v["$result"])]
        return [x for k in sorted(v) for x in _uses(v[k])]
    return [x for y in v for x in _uses(y)] if isinstance(v, list) else []


def ordered(calls: list[tuple[str, list[str]]]) -> tuple[list[int], set[int]]:
    """A topological order of the calls (id, ids used) of one message, stable, and those on or behind a cycle, put last."""
    first: dict[str, int] = {}
    for i, (c, _) in enumerate(calls):
        first.setdefault(c, i)
    needs = [{first[u] for u in uses if u in first} for _, uses in calls]
    open_, used_by = [len(n) for n in needs], [[] for _ in calls]
    for i, n in enumerate(needs):
        for j in n:
            used_by[j].append(i)
    order, ready = [], [i for i, n in enumerate(open_) if not n]
    while ready:
        order += ready
        fresh = []
        for i in ready:
            for j in used_by[i]:
                open_[j] -= 1
                if not open_[j]:
                    fresh.append(j)
        ready = sorted(fresh)
    left = [i for i, n in enumerate(open_) if n]
    return order + left, set(left)


def _read(role: str, text: str, schemas: dict) -> list:
    """Events of one turn: (kind, id, name, body, uses, problems), in topological order."""
    try:
        return list(_events(role, text, schemas))
    except RecursionError:
        return [("message", None, None, canonical({"content": text, "role": role}), [], ["nested too deeply"])]


def _events(role: str, text: str, schemas: dict):
    value = None
    if text.lstrip(" \t\r\n")[:1] == "{":
        try:
            value = _loads(text)
        except ValueError:
            value = None
    if isinstance(value, dict) and isinstance(value.get("tool_calls"), list):
        calls = []
        for c in value["tool_calls"]:
            c = c if isinstance(c, dict) else {}
            of = c["function"] if isinstance(c.get("function"), dict) else c
            name, args, problems = _encodable(str(of.get("name") or "")), of.get("arguments", {}), []
            if isinstance(args, str):
                try:
                    args = _loads(args)
                except ValueError:
                    problems.append("$: arguments are no JSON")
            if name not in schemas:
                problems.append("no schema")
            elif not problems:
                problems += violations(args, schemas[name])
            if c.get("id") is None:
                problems.append("no id")
            calls.append((None if c.get("id") is None else _encodable(str(c["id"])), name, args, sorted(set(_uses(args))), [_encodable(p) for p in problems]))
        order, cyclic = ordered([(c[0] or "", c[3]) for c in calls])
        if "content" in value and value["content"]:
            yield "message", None, None, canonical({"content": value["content"], "role": role}), [], []
        for i in order:
            cid, name, args, uses, problems = calls[i]
            yield "call", cid, name, canonical({"arguments": args, "id": cid, "name": name, "role": role}), uses, problems + ["cycle"] * (i in cyclic)
    elif isinstance(value, dict) and isinstance(value.get("tool_call_id"), (str, int)):
        cid = _encodable(str(value["tool_call_id"]))
        yield "result", cid, None, canonical({"content": value.get("content"), "role": role, "tool_call_id": cid}), [], []
    else:
        yield "message", None, None, canonical({"content": text, "role": role}), [], []


def events(turns: DataFrame, schemas: dict, exchanges: bool = False) -> DataFrame:
    """All events of turns (conv_id, turn, role, text), arguments validated."""
    schemas = {**(REPLY if exchanges else {}), **schemas}
    names = EVENTS.split(", ")
    kinds = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    out = pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in names)])

    def run(batches):
        for rb in batches:
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                role, text = role or "", text or ""
                for at, (kind, cid, name, body, uses, problems) in enumerate(_read(role, text, schemas)):
                    if exchanges and kind == "message" and turn is not None and role == "user":
                        args = {"prompt": text}
                        kind, cid, name, problems = "call", f"turn-{turn}", "reply", violations(args, schemas["reply"])
                        body = canonical({"arguments": args, "id": cid, "name": name, "role": role})
                    elif exchanges and kind == "message" and turn is not None and role == "assistant":
                        kind, cid = "result", f"turn-{turn - 1}"
                        body = canonical({"content": text, "role": role, "tool_call_id": cid})
                    rows.append((conv, turn, at, kind, role, cid, name, body, uses, problems))
            if rows:
                yield batch(out, *zip(*rows, strict=True))

    plain = turns.select(turns["conv_id"].cast("long"), turns["turn"].cast("long"), turns["role"].cast("string"), turns["text"].cast("string"))
    return plain.mapInArrow(run, EVENTS)


def linked(found: DataFrame) -> DataFrame:
    """Events with status, partner_turn and problems: the first calls hash-joined with the first results by
    (conv_id, call_id), and these links with the events, which are parsed and stored once."""
    found = found.groupBy("conv_id", "turn", "position", "kind", "role", "call_id", "name", "body").agg(F.first("uses").alias("uses"), F.first("problems").alias("problems"))
    found = stored(found.withColumn("digest", F.sha2("body", 256)), "events")
    key = ["conv_id", "call_id"]
    keyed = found.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("call_id").isNotNull())
    first = lambda kind: keyed.where(F.col("kind") == kind).groupBy(*key).agg(F.min(F.struct("turn", "position", "digest")).alias(kind))
    rows = {r["kind"]: r["count"] for r in keyed.groupBy("kind").count().collect()}  # calls and results: two rows
    most = BUILD * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = lambda side, n: side.hint("shuffle_hash" if n <= most else "merge")
    pairs = stored(first("call").join(hashed(first("result"), rows.get("result", 0)), key, "full"), "links")
    both = found.join(hashed(pairs, sum(rows.values())), key, "left")
    own = F.when(F.col("kind") == "call", F.col("call")).otherwise(F.col("result"))
    other = F.when(F.col("kind") == "call", F.col("result")).otherwise(F.col("call"))
    is_first = (own["turn"] == F.col("turn")) & (own["position"] == F.col("position")) & (own["digest"] == F.col("digest"))
    late = F.col("result.turn") < F.col("call.turn")
    status = F.when(F.col("kind") == "message", "message").when(own.isNull(), "unkeyed").when(~is_first, "duplicate").when(other.isNull(), F.when(F.col("kind") == "call", "unanswered").otherwise("orphan")).when(late, "early-result").otherwise("linked")
    both = both.select("conv_id", "turn", "position", "kind", "role", "call_id", "name", "body", "uses", "problems", status.alias("status"), F.when(status == "linked", other["turn"]).alias("partner_turn"))
    # References: each must name a call that comes before, in an earlier turn or in the same message.
    refs = both.where(F.size("uses") > 0).select("conv_id", "turn", "position", F.explode("uses").alias("call_id"))
    calls = pairs.where("call is not null").select("conv_id", "call_id", F.col("call.turn").alias("at"))
    broken = refs.join(calls, key, "left").where("at is null or at > turn").groupBy("conv_id", "turn", "position").agg(F.sort_array(F.collect_set(F.concat(F.lit("unknown reference "), F.col("call_id")))).alias("broken"))
    done = both.join(broken, ["conv_id", "turn", "position"], "left")
    return done.withColumn("problems", F.concat("problems", F.coalesce("broken", F.array().cast("array<string>")))).drop("broken")


def assembled(events: DataFrame, turns: int = 256) -> DataFrame:
    """(conv_id, part, json): canonical JSON arrays of the events of up to so many turns each, in order."""
    part = F.floor(F.col("turn") / turns).alias("part")
    of = events.groupBy("conv_id", part).agg(F.sort_array(F.collect_list(F.struct("turn", "position", "body"))).alias("all"))
    return of.select("conv_id", "part", F.concat(F.lit("["), F.array_join(F.transform("all", lambda e: e["body"]), ","), F.lit("]")).alias("json"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked(events(spark.read.parquet(f"{sf_dir}/conversations.parquet"), {}, exchanges=True))
    return found.select("conv_id", "turn", "position", "kind", "call_id", "status", "partner_turn", (F.size("problems") == 0).alias("valid"), F.array_join("problems", "; ").alias("problems"), F.col("body").alias("canonical_json"), F.sha2("body", 256).alias("json_sha256"))
