"""Operator 8, chat formatting: tool-call linking.

1. Messages become events.  A text that is a JSON object with ``tool_calls`` (each
   ``id, name, arguments, after``) or ``tool_call_id`` is read as such.  With
   ``derive=True`` a plain user turn is read as a call of ``search`` (texts of up to
   ``SHORT`` words) or ``summarize`` that comes after the conversation's previous
   user turn, and an assistant turn as the result of the call of the turn before it.
2. Arguments are checked against the schemas (required fields, types, ranges, no
   unknown fields) and every event is written as canonical JSON (sorted keys, no
   spaces), per row in Arrow batches.
3. Calls and results are hash-joined by (conversation, identifier); of several
   results the first stays (the others are counted).
4. Calls are put in topological order.  Where all dependencies point back, turn
   order is one.  Only for conversations with a forward reference, levels are
   relaxed by joins until they settle; calls on a cycle, or after one, get no level.
   Positions come from counts per block of turns, so a conversation of any length
   is numbered without gathering it in one task.

Cases: null and empty texts are plain messages; a text that starts like JSON but
does not parse is plain; null arguments are an empty object; lone surrogates are written as their
escapes, and NaN or infinite numbers are violations, written as strings; a null conversation links
nothing (its calls stay unanswered, its results are orphans), a null turn sorts first; results without a
call are orphans, calls without a result unanswered; a dependency on an unknown
call is counted and ignored; repeated rows are separate messages (equal
identifiers link to the same result); an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import arrow_ready, keep

SHORT = 24
TURN_BLOCK = 1024
#: schemas of the tools: field -> (type, required, largest value or length)
SCHEMAS: dict[str, dict[str, tuple[str, bool, int | None]]] = {
    "search": {"query": ("string", True, 2000), "words": ("integer", True, SHORT)},
    "summarize": {"text": ("string", True, None), "words": ("integer", True, None), "ratio": ("number", False, 1)},
}
_TYPES = {"string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool),
          "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
          "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v),
          "array": lambda v: isinstance(v, list), "object": lambda v: isinstance(v, dict)}

_EVENT = ("conv_id long, turn long, role string, kind string, call_id string, name string, after array<string>, "
          "errors array<string>, json string")


_LONE = re.compile("[\ud800-\udfff]")


def whole(text: str) -> str:
    """The text with lone surrogates (which no UTF-8 text can hold) as their escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def finite(value):
    """The value with numbers that JSON does not have (NaN, infinities) as their names."""
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    if isinstance(value, dict):
        return {k: finite(v) for k, v in value.items()}
    return [finite(v) for v in value] if isinstance(value, list) else value


def canonical(value) -> str:
    return whole(json.dumps(finite(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def check(name: str | None, arguments, schemas: dict) -> list[str]:
    """Violations of a call's arguments against its schema, sorted."""
    if name not in schemas:
        return [f"unknown tool {name}"]
    if not isinstance(arguments, dict):
        return ["arguments are no object"]
    schema, out = schemas[name], []
    for field, (kind, required, top) in schema.items():
        if field not in arguments:
            out += [f"missing {field}"] * required
        elif not _TYPES[kind](arguments[field]):
            out.append(f"{field} is no {kind}")
        elif top is not None and (len(arguments[field]) if kind in ("string", "array") else arguments[field]) > top:
            out.append(f"{field} over {top}")
    return sorted(out + [f"unexpected {whole(f)}" for f in arguments if f not in schema])


def _parsed(text: str | None):
    if text and text.lstrip()[:1] == "{":
        try:
            v = json.loads(text)
        except (ValueError, RecursionError):
            return None
        if isinstance(v, dict) and ("tool_calls" in v or "tool_call_id" in v):
            return v
    return None


def _text(v) -> str | None:
    return v if v is None else whole(v) if isinstance(v, str) else canonical(v)


def _events(conv, turn, role, text, previous, schemas: dict, derive: bool) -> Iterator[tuple]:
    """(kind, call_id, name, after, errors, json) of a message."""
    v = _parsed(text)
    if v is not None and isinstance(v.get("tool_calls"), list):
        for c in v["tool_calls"]:
            c = c if isinstance(c, dict) else {}
            arguments = c.get("arguments")
            if isinstance(arguments, str):
                try:
                    arguments = json.loads(arguments)
                except (ValueError, RecursionError):
                    pass
            arguments = {} if arguments is None else arguments
            after = [_text(x) for x in c["after"]] if isinstance(c.get("after"), list) else []
            yield ("call", _text(c.get("id")), _text(c.get("name")), after, check(_text(c.get("name")), arguments, schemas),
                   canonical({"id": c.get("id"), "name": c.get("name"), "arguments": arguments}))
    elif v is not None:
        yield "result", _text(v.get("tool_call_id")), None, [], [], canonical({"tool_call_id": v.get("tool_call_id"), "content": v.get("content")})
    elif derive and role == "user" and text:
        n = len(text.split())
        name, arguments = ("search", {"query": text, "words": n}) if n <= SHORT else ("summarize", {"text": text, "words": n})
        call = f"call_{turn}"
        yield ("call", call, name, [f"call_{previous}"] if previous is not None else [], check(name, arguments, schemas),
               canonical({"id": call, "name": name, "arguments": arguments}))
    elif derive and role == "assistant" and text and turn is not None:
        call = f"call_{turn - 1}"
        yield "result", call, None, [], [], canonical({"tool_call_id": call, "content": text})
    else:
        yield "message", None, None, [], [], canonical({"role": role, "content": text})


def _event_rows(schemas: dict, derive: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "role", "kind", "call_id", "name", "after", "errors", "json"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(),
                 pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
        for b in batches:
            rows = [(m["conv_id"], m["turn"], m["role"], *e) for m in b.to_pylist()
                    for e in _events(m["conv_id"], m["turn"], m["role"], m["text"], m["previous"], schemas, derive)]
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
    return run


def events(messages: DataFrame, schemas: dict | None = None, derive: bool = True) -> DataFrame:
    """The events of ``messages`` (``conv_id, turn, role, text``)."""
    arrow_ready(messages.sparkSession)
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    if derive:
        # the previous user turn: the latest inside the block of turns, else the last of an earlier block
        m = m.withColumn("_b", F.floor(F.col("turn") / TURN_BLOCK))
        user = F.when((F.col("role") == "user") & (F.col("text") != ""), F.col("turn"))
        last = m.groupBy("conv_id", "_b").agg(F.max(user).alias("_t"))
        over = Window.partitionBy("conv_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        last = last.select(F.col("conv_id").alias("_c"), F.col("_b").alias("_bb"), F.max("_t").over(over).alias("_t"))
        near = Window.partitionBy("conv_id", "_b").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
        m = (m.withColumn("_near", F.max(user).over(near))
             .join(last, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("_b").eqNullSafe(F.col("_bb")), "left")
             .withColumn("previous", F.coalesce("_near", "_t")))
    else:
        m = m.withColumn("previous", F.lit(None).cast("long"))
    m = m.select("conv_id", "turn", "role", "text", "previous")
    return m.mapInArrow(_event_rows(schemas or SCHEMAS, derive), _EVENT)


def _levels(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """Longest-path levels of ``calls (conv_id, call_id)``; cyclic calls and those behind
    them have no row.  A call with one dependency points at it, and pointers are doubled
    until they end at a call with none or several, so a chain of n calls takes log n
    rounds.  The other calls are settled by frontier rounds (Kahn) until nothing changes."""
    key = ["conv_id", "call_id"]
    edges = keep(edges.where("call_id is not null").distinct(), "chat-edges")
    calls = calls.where("call_id is not null").distinct()
    one = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("anc")).where("n = 1")
    one = keep(one.select(*key, "anc", F.lit(1).cast("long").alias("dist")), "chat-pointers")
    longest = one.groupBy("conv_id").count().agg(F.max("count").alias("n")).collect()[0]["n"] or 0
    ends = one.select("conv_id", F.col("call_id").alias("anc"))
    ptr = one
    for _ in range(longest.bit_length()):
        step = ptr.select("conv_id", F.col("call_id").alias("anc"), F.col("anc").alias("_a"), F.col("dist").alias("_d"))
        ptr = keep(ptr.join(step, ["conv_id", "anc"], "left").select(
            *key, F.coalesce("_a", "anc").alias("anc"), (F.col("dist") + F.coalesce("_d", F.lit(0))).alias("dist")), "chat-pointers")
    ptr = keep(ptr.join(ends, ["conv_id", "anc"], "left_anti"), "chat-pointers")        # a pointer into a cycle never ends
    via = ptr.select("conv_id", F.col("call_id").alias("parent"), "anc", "dist")
    waiting = keep(edges.join(one, key, "left_anti").join(via, ["conv_id", "parent"], "left")
                   .select(*key, F.coalesce("anc", "parent").alias("parent"), (F.coalesce("dist", F.lit(0)) + 1).alias("w"),
                           F.lit(None).cast("long").alias("v")), "chat-waiting")
    free = keep(calls.join(edges, key, "left_anti").select(*key, F.lit(0).cast("long").alias("level")), "chat-free")
    done = free
    while not free.isEmpty():
        ready = free.select("conv_id", F.col("call_id").alias("parent"), F.col("level").alias("_l"))
        waiting = keep(waiting.join(ready, ["conv_id", "parent"], "left")
                       .select(*key, "parent", "w", F.coalesce("v", F.col("_l") + F.col("w")).alias("v")), "chat-waiting")
        free = keep(waiting.groupBy(*key).agg(F.max("v").alias("level"), F.count(F.lit(1)).alias("n"), F.count("v").alias("k"))
                    .where("n = k").select(*key, "level"), "chat-free")
        waiting = keep(waiting.join(free, key, "left_anti"), "chat-waiting")
        done = keep(done.unionByName(free), "chat-done")
    base = done.select("conv_id", F.col("call_id").alias("anc"), F.col("level").alias("_l"))
    return done.unionByName(ptr.join(base, ["conv_id", "anc"]).select(*key, (F.col("_l") + F.col("dist")).alias("level")))


def link_calls(messages: DataFrame, schemas: dict | None = None, derive: bool = True) -> DataFrame:
    """One row per event: ``conv_id, turn, role, kind, call_id, name, status, valid,
    errors, n_results, unknown_after, level, position, json, result_json``."""
    ev = keep(events(messages, schemas, derive).withColumn("row", F.monotonically_increasing_id()), "chat-events")
    key = ["conv_id", "call_id"]
    calls, results = ev.where("kind = 'call'"), ev.where("kind = 'result'")
    first = results.groupBy(*key).agg(F.min(F.struct("turn", "json")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    first = keep(first, "chat-results")
    known = keep(calls.groupBy(*key).agg(F.min("turn").alias("at")), "chat-calls")

    dep = calls.select("conv_id", "call_id", "turn", "row", F.explode("after").alias("parent"))
    seen = dep.join(known.select("conv_id", F.col("call_id").alias("parent"), "at"), ["conv_id", "parent"], "left")
    seen = keep(seen, "chat-deps")
    unknown = seen.where("at is null").groupBy("row").agg(F.count(F.lit(1)).alias("unknown_after"))
    forward = keep(seen.where("at >= turn").select("conv_id").distinct(), "chat-forward")
    edges = seen.where("at is not null").join(forward, "conv_id", "left_semi").select("conv_id", "call_id", "parent").distinct()
    hard = known.join(forward, "conv_id", "left_semi").select(*key)
    level = _levels(edges, hard) if not forward.isEmpty() else hard.withColumn("level", F.lit(0).cast("long"))

    c = (calls.join(first, key, "left").join(unknown, "row", "left").join(level, key, "left")
         .join(forward.withColumn("_hard", F.lit(True)), "conv_id", "left"))
    # sort key of a call: its turn, or its level where turn order does not do; cyclic calls last
    c = c.withColumn("_o", F.when(F.col("_hard"), F.coalesce("level", F.lit(2**40))).otherwise(F.coalesce("turn", F.lit(-1))))
    # blocks of turns; where levels rule, blocks of turns of one level
    c = c.withColumn("_b", F.when(F.col("_hard"), F.col("_o")).otherwise(F.floor(F.col("_o") / TURN_BLOCK)))
    c = keep(c.withColumn("_b2", F.when(F.col("_hard"), F.floor(F.col("turn") / TURN_BLOCK))), "chat-linked")
    per = c.groupBy("conv_id", "_b", "_b2").agg(F.count(F.lit(1)).alias("_n")).withColumn("_t", F.floor(F.col("_b") / TURN_BLOCK))
    tiers = per.groupBy("conv_id", "_t").agg(F.sum("_n").alias("_n"))
    over = Window.partitionBy("conv_id").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    tiers = tiers.select(F.col("conv_id").alias("_c"), F.col("_t").alias("_tt"), F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_first"))
    over = Window.partitionBy("conv_id", "_t").orderBy("_b", "_b2").rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("_inner", F.coalesce(F.sum("_n").over(over), F.lit(0)))
           .join(tiers, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("_t").eqNullSafe(F.col("_tt")))
           .select("_c", F.col("_b").alias("_bb"), F.col("_b2").alias("_bb2"), (F.col("_first") + F.col("_inner")).alias("_before")))
    inside = Window.partitionBy("conv_id", "_b", "_b2").orderBy("_o", "turn", "call_id", "row")
    c = (c.withColumn("_i", F.row_number().over(inside))
         .join(per, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("_b").eqNullSafe(F.col("_bb")) & F.col("_b2").eqNullSafe(F.col("_bb2")))
         .withColumn("position", (F.col("_before") + F.col("_i") - 1).cast("long")))
    out = ["conv_id", "turn", "role", "kind", "call_id", "name", "status", "valid", "errors", "n_results", "unknown_after",
           "level", "position", "json", "result_json"]
    c = c.select("conv_id", "turn", "role", "kind", "call_id", "name",
                 F.when(F.col("_hard") & F.col("level").isNull(), "cyclic").when(F.col("n_results").isNull(), "unanswered")
                 .otherwise("linked").alias("status"), (F.size("errors") == 0).alias("valid"),
                 F.array_join("errors", "; ").alias("errors"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
                 F.coalesce("unknown_after", F.lit(0)).cast("long").alias("unknown_after"),
                 F.when(F.col("_hard"), F.col("level")).alias("level"), "position", "json", F.col("r.json").alias("result_json"))
    r = results.join(known.select(*key, F.lit(True).alias("_k")), key, "left")
    rest = r.withColumn("status", F.when(F.col("_k"), "linked").otherwise("orphan")).drop("_k").unionByName(
        ev.where("kind = 'message'").withColumn("status", F.lit("message")))
    rest = rest.select("conv_id", "turn", "role", "kind", "call_id", "name", "status", F.lit(True).alias("valid"),
                       F.lit("").alias("errors"), F.lit(0).cast("long").alias("n_results"),
                       F.lit(0).cast("long").alias("unknown_after"), F.lit(None).cast("long").alias("level"),
                       F.lit(None).cast("long").alias("position"), "json", F.lit(None).cast("string").alias("result_json"))
    return c.select(*out).unionByName(rest.select(*out))
