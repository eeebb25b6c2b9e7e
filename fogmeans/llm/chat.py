"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import dropped, map_texts, pinned, scratch_path

#: Argument schemas by tool name, in the public JSON Schema words type, properties, required, items, enum.
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}, "method": {"enum": ["GET", "POST"]}}, "required": ["url"]},
}
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
#: Calls of a conversation that are ordered inside one task, at most; larger conversations are ordered by rounds of joins.
TOGETHER = 100_000
#: Rank of what stands in a cycle or behind one.
LAST = 1 << 30


class _Mark(str):
    """Finished JSON among values that are still to be written."""


def clean(text: str) -> str:
    """Halves of surrogate pairs, which no UTF-8 holds, become U+FFFD."""
    return text if text.isascii() else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def quoted(text: str) -> str:
    return json.dumps(clean(text), ensure_ascii=False)


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and unescaped Unicode, of values of any depth. The one writer for all fields."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, _Mark):
            out.append(v)
        elif isinstance(v, dict):
            parts: list = [_Mark("{")]
            for i, k in enumerate(sorted(v)):
                parts += [_Mark(("," if i else "") + quoted(k) + ":"), v[k]]
            todo += [_Mark("}"), *reversed(parts)]
        elif isinstance(v, list):
            todo.append(_Mark("]"))
            for i in range(len(v) - 1, -1, -1):
                todo.append(v[i])
                if i:
                    todo.append(_Mark(","))
            todo.append(_Mark("["))
        else:
            out.append(quoted(v) if isinstance(v, str) else json.dumps(v))
    return "".join(out)


def _finite(digits: str) -> float:
    if (f := float(digits)) in (float("inf"), float("-inf")):
        raise ValueError("a number beyond doubles")
    return f


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def parsed_json(text: str):
    """The value, or ValueError: also for NaN, infinities, numbers beyond doubles, integers of over 4,300 digits and texts nested too deeply for the parser."""
    pairs = (lambda p: {clean(k): clean(v) if isinstance(v, str) else v for k, v in p}) if "\\u" in text else None
    try:
        return json.loads(text, parse_float=_finite, parse_constant=_no_constant, object_pairs_hook=pairs)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def is_ref(value) -> bool:
    """An argument {"$ref": id} stands for the result of another call."""
    return isinstance(value, dict) and len(value) == 1 and isinstance(value.get("$ref"), str)


def errors_of(value, schema: dict, at: str = "$") -> list[str]:
    """Where ``value`` breaks ``schema``; references to other results are taken as any type. As deep as the schema, not the value."""
    if is_ref(value):
        return []
    kind = schema.get("type")
    if kind in ("integer", "number"):
        ok = isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    else:
        ok = kind is None or isinstance(value, _KINDS[kind])
    out = [] if ok else [f"{at}: not of type {kind}"]
    if "enum" in schema and (isinstance(value, (dict, list)) or value not in schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        out += [e for k, s in schema.get("properties", {}).items() if k in value for e in errors_of(value[k], s, f"{at}.{k}")]
    if isinstance(value, list) and "items" in schema:
        out += [e for i, v in enumerate(value) for e in errors_of(v, schema["items"], f"{at}[{i}]")]
    return out


def refs_of(value) -> set[str]:
    out, todo = set(), [value]
    while todo:
        v = todo.pop()
        if is_ref(v):
            out.add(v["$ref"])
        elif isinstance(v, (dict, list)):
            todo += v.values() if isinstance(v, dict) else v
    return out


def parse_message(text: str, schemas: dict[str, dict]) -> tuple[list[dict], str | None, str]:
    """(calls, id of the call this answers, content as JSON).

    A text that is a JSON object with a list ``tool_calls`` of objects with string ids and names holds calls; one with a
    string ``tool_call_id`` is a result. Every other text, broken JSON too, is plain content.
    """
    if not text.lstrip().startswith("{"):
        return [], None, quoted(text)
    try:
        obj = parsed_json(text)
    except ValueError:
        return [], None, quoted(text)
    if isinstance(obj.get("tool_call_id"), str):
        return [], obj["tool_call_id"], canonical(obj.get("content"))
    calls = obj.get("tool_calls")
    if not (isinstance(calls, list) and calls and all(isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("name"), str) for c in calls)):
        return [], None, quoted(text)
    out = []
    for c in calls:
        args, bad = c.get("arguments", {}), []
        if isinstance(args, str):
            try:
                args = parsed_json(args)
            except ValueError:
                bad = ["$: not JSON"]
        bad += errors_of(args, schemas[c["name"]]) if c["name"] in schemas else ["$: unknown tool"]
        out.append({"id": c["id"], "json": canonical({"arguments": args, "id": c["id"], "name": c["name"]}), "errors": bad, "deps": sorted(map(clean, refs_of(args)))})
    return out, None, canonical(obj.get("content"))


def parsed(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    schemas = SCHEMAS if schemas is None else schemas

    def make():
        def work(texts, roles):
            got = [parse_message((t or b"").decode(), schemas) for t in texts]
            return [[g[0] for g in got], [g[1] for g in got], [g[2] for g in got], ["null" if r is None else quoted(r) for r in roles], [None if g[1] is None else quoted(g[1]) for g in got]]

        return work

    calls = "calls array<struct<id: string, json: string, errors: array<string>, deps: array<string>>>"
    return map_texts(messages, ["conv_id", "turn", "role"], make, f"{calls}, answers string, content string, role_json string, answers_json string", also=("role",))


def _order(nodes: dict, edges: list[tuple]) -> dict:
    """Of each node: (level, place), by taking away what waits for nothing. ``nodes`` gives each one's own place, ``edges`` are
    (node, what it waits for, place of that result, step to the node's level). What is in a cycle or behind one has level None and its own place."""
    waits, after = dict.fromkeys(nodes, 0), {}
    for a, b, at, step in edges:
        waits[a] += 1
        after.setdefault(b, []).append((a, at, step))
    level, place = dict.fromkeys(nodes, 0), dict(nodes)
    free, done = [n for n in nodes if not waits[n]], {}
    while free:
        b = free.pop()
        done[b] = (level[b], place[b])
        for a, at, step in after.get(b, ()):
            level[a] = max(level[a], level[b] + step)
            place[a] = max(place[a], place[b], at)
            waits[a] -= 1
            if not waits[a]:
                free.append(a)
    return {n: done.get(n, (None, nodes[n])) for n in nodes}


def ordered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, id, level, place) of ``nodes`` (conv_id, id, own): the longest way of steps to a node without edges, and the
    largest of its own place, the places of all it waits for, and ``at`` of the edges to them. Level is null in a cycle and
    behind one.

    ``edges`` are (conv_id, id, dep, at, step) between nodes. Conversations of up to TOGETHER edges are ordered in a task each; of
    larger ones a round of joins settles one level, so one conversation may hold any share of all calls.
    """
    edges = pinned(edges, "chat-edges")
    alone = nodes.join(edges.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti")
    size = pinned(edges.groupBy("conv_id").agg(F.count("*").alias("n")), "chat-sizes")
    if not size.head(1):
        return alone.select("conv_id", "id", F.lit(0).cast("long").alias("level"), F.col("own").alias("place"))
    few = edges.join(size.where(F.col("n") <= TOGETHER).select("conv_id"), "conv_id", "left_semi")
    ends = few.select("conv_id", "id").union(few.select("conv_id", F.col("dep").alias("id"))).distinct()
    rows = few.withColumn("own", F.lit(None).cast("long")).unionByName(nodes.join(ends, ["conv_id", "id"], "left_semi").select("conv_id", "id", F.lit(None).cast(dict(edges.dtypes)["dep"]).alias("dep"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("step"), "own"))
    kinds = dict(nodes.dtypes)
    out = StructType.fromDDL(f"conv_id {kinds['conv_id']}, id {kinds['id']}, level long, place long")

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        is_node = pdf["own"].notna()
        own = {i: int(p) for i, p in zip(pdf.loc[is_node, "id"], pdf.loc[is_node, "own"], strict=True)}
        e = pdf[~is_node]
        got = _order(own, [(a, b, int(at), int(step)) for a, b, at, step in zip(e["id"], e["dep"], e["at"], e["step"], strict=True)])
        made = pd.DataFrame([(i, lv, p) for i, (lv, p) in got.items()], columns=["id", "level", "place"])
        made.insert(0, "conv_id", pdf["conv_id"].iloc[0])
        made["level"] = made["level"].astype("Int64")
        return made

    total = rows.groupBy("conv_id").applyInPandas(order, out)
    if size.where(F.col("n") > TOGETHER).head(1):
        big = size.where(F.col("n") > TOGETHER).select("conv_id")
        total = total.union(_rounds(nodes.join(big, "conv_id", "left_semi"), edges.join(big, "conv_id", "left_semi")))
    total = pinned(total, "chat-order")
    dropped(size)
    return total.union(alone.join(total.select("conv_id", "id"), ["conv_id", "id"], "left_anti").select("conv_id", "id", F.lit(0).cast("long").alias("level"), F.col("own").alias("place")))


def _rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ordered() in rounds that settle what waits for nothing any more, each appended to one table in the shared folder."""
    spark, path = nodes.sparkSession, scratch_path(nodes.sparkSession, "chat-levels")
    nodes, edges = pinned(nodes, "chat-nodes"), pinned(edges, "chat-edges")
    first = nodes.join(edges.select("conv_id", "id"), ["conv_id", "id"], "left_anti").select("conv_id", "id", F.lit(0).cast("long").alias("level"), F.col("own").alias("place"))
    first.write.parquet(path)
    kind = first.schema
    while True:
        done = spark.read.schema(kind).parquet(path)
        met = edges.join(done.select("conv_id", F.col("id").alias("dep"), F.col("place").alias("p"), F.col("level").alias("l")), ["conv_id", "dep"], "left")
        ready = met.groupBy("conv_id", "id").agg(F.count_if(F.col("p").isNull()).alias("left"), F.max(F.greatest("p", "at")).alias("p"), F.max(F.col("l") + F.col("step")).alias("level")).where("left = 0")
        free = pinned(ready.join(done, ["conv_id", "id"], "left_anti").join(nodes, ["conv_id", "id"]).select("conv_id", "id", "level", F.greatest("own", "p").alias("place")), "chat-free")
        if not free.head(1):
            break
        free.write.mode("append").parquet(path)
    return nodes.join(done, ["conv_id", "id"], "left").select("conv_id", "id", "level", F.coalesce("place", "own").alias("place"))


def format_chat(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row a message: conv_id, turn, role, place, rank, linked, valid, errors, json.

    (place, rank, turn) is a topological order of a conversation: a result comes after its call, a message with a call that
    refers to another call after that call's message and its results. Messages that don't wait for later ones keep their
    turn as place. What is in a cycle of messages or behind one keeps its turn and comes last at it. linked: a result has
    its call, or all calls of a message have results (null for other messages). valid: all arguments keep their schemas.
    Calls within a message stand in topological order, cycles last. Of several calls with one id in a conversation the
    first (by turn, then by place in its message) counts for links and references. Rows are never gathered by conversation
    beyond TOGETHER references: identifiers are hash-joined, so one conversation may hold any share of all rows.

    Calls of a null conversation or turn and results of a null conversation link with nothing. Null texts are empty
    contents; null roles stay null; repeated messages each keep a row; an empty table gives no rows. Texts may be of any
    length and depth the JSON parser takes; others, NaN, infinities, numbers beyond doubles and integers of over 4,300
    digits are no JSON, so plain content. Lone surrogates become U+FFFD. Other columns are ignored.
    """
    rows = pinned(parsed(messages, schemas), "chat-parsed")
    has_calls = F.size("calls") > 0
    turn = F.col("turn").cast("long")
    each = rows.where(has_calls).select("conv_id", turn.alias("turn"), F.posexplode("calls").alias("at", "c")).select("conv_id", "turn", "c.id", F.struct("turn", "at", "c.deps").alias("key")).where("conv_id is not null and turn is not null")
    first = pinned(each.groupBy("conv_id", "id").agg(F.min("key").alias("key")).select("conv_id", "id", F.col("key.turn").alias("call_turn"), "key.deps"), "chat-calls")
    results = rows.where(~has_calls & F.col("answers").isNotNull())
    answered = results.where("conv_id is not null").groupBy("conv_id", F.col("answers").alias("id")).agg(F.max(turn).alias("result_turn"))
    deps = first.select("conv_id", "id", "call_turn", F.explode("deps").alias("dep"))
    known = first.select("conv_id", F.col("id").alias("dep"), F.col("call_turn").alias("dep_turn"))
    refs = pinned(deps.join(known, ["conv_id", "dep"]).join(answered.select("conv_id", F.col("id").alias("dep"), "result_turn"), ["conv_id", "dep"], "left"), "chat-deps")
    levels = ordered(first.select("conv_id", "id", F.lit(0).cast("long").alias("own")), refs.select("conv_id", "id", "dep", F.lit(0).cast("long").alias("at"), F.lit(1).cast("long").alias("step"))).select("conv_id", "id", F.coalesce("level", F.lit(LAST)).alias("level"))
    levels = pinned(levels, "chat-call-levels")
    between = refs.where("call_turn != dep_turn").join(levels.select("conv_id", F.col("id").alias("dep"), "level"), ["conv_id", "dep"]).groupBy("conv_id", F.col("call_turn").alias("id"), F.col("dep_turn").alias("dep")).agg(F.max(F.coalesce("result_turn", "dep_turn")).alias("at"), F.max(F.col("level") + 2).alias("step"))
    spots = ordered(each.select("conv_id", F.col("turn").alias("id"), F.col("turn").alias("own")).distinct(), between)
    spots = pinned(spots.select("conv_id", F.col("id").alias("call_turn"), "place", F.coalesce("level", F.lit(LAST)).alias("rank")), "chat-places")
    per_call = each.select("conv_id", "turn", "id").distinct().join(levels.hint("shuffle_hash"), ["conv_id", "id"]).join(answered.select("conv_id", "id", F.lit(True).alias("answered")), ["conv_id", "id"], "left")
    per_message = per_call.groupBy("conv_id", "turn").agg(F.map_from_entries(F.collect_list(F.struct("id", "level"))).alias("levels"), F.bool_and(F.coalesce("answered", F.lit(False))).alias("all_answered"))
    per_message = per_message.join(spots.withColumnRenamed("call_turn", "turn"), ["conv_id", "turn"]).select("conv_id", F.col("turn").alias("call_turn"), "levels", "all_answered", "place", "rank")
    plain = rows.where(~has_calls & F.col("answers").isNull()).select("conv_id", "turn", "role", turn.alias("place"), F.lit(0).alias("rank"), F.lit(None).cast("boolean").alias("linked"), F.lit(True).alias("valid"), F.lit("").alias("errors"), _json())
    in_order = F.array_sort(F.transform("calls", lambda c, i: F.struct(F.try_element_at("levels", c["id"]).alias("level"), i.alias("i"), c["json"].alias("json"))))
    bad = F.flatten(F.transform("calls", lambda c: F.transform(c["errors"], lambda e: F.concat(c["id"], F.lit(" "), e))))
    calling = rows.where(has_calls).withColumn("call_turn", turn).join(per_message, ["conv_id", "call_turn"], "left").select("conv_id", "turn", "role", F.coalesce("place", turn).alias("place"), _rank(F.col("rank")), F.coalesce("all_answered", F.lit(False)).alias("linked"), (F.size(bad) == 0).alias("valid"), F.array_join(bad, "; ").alias("errors"), _json(F.concat(F.lit(',"tool_calls":['), F.array_join(F.transform(in_order, lambda x: x["json"]), ","), F.lit("]"))))
    of_call = first.select("conv_id", "id", "call_turn").join(spots, ["conv_id", "call_turn"]).join(levels, ["conv_id", "id"]).select("conv_id", F.col("id").alias("answers"), "place", "rank", "level")
    linked = results.join(of_call.hint("shuffle_hash"), ["conv_id", "answers"], "left")
    answering = linked.select("conv_id", "turn", "role", F.greatest(turn, "place").alias("place"), _rank(F.col("rank") + 1 + F.col("level")), F.col("place").isNotNull().alias("linked"), F.lit(True).alias("valid"), F.lit("").alias("errors"), _json(F.concat(F.lit(',"tool_call_id":'), F.col("answers_json"))))
    return plain.unionByName(calling).unionByName(answering)


def _rank(rank):
    return F.least(F.coalesce(rank, F.lit(0)), F.lit((1 << 31) - 1)).cast("int").alias("rank")


def _json(more=None):
    parts = [F.lit('{"content":'), F.col("content"), F.lit(',"role":'), F.col("role_json"), *([more] if more is not None else []), F.lit("}")]
    return F.concat(*parts).alias("json")


SQL = """select conv_id, turn, role, turn place, 0::int rank, null::boolean linked, true valid, '' errors,
'{"content":' || to_json(coalesce(text, '')) || ',"role":' || coalesce(to_json(role)::varchar, 'null') || '}' json from conversations"""
