"""Chat formatting on random conversations against a plain version, and on odd JSON."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fogmeans.llm import chat, queries


def call_message(calls):
    return json.dumps({"tool_calls": [{"id": i, "name": "calculate", "arguments": {"expression": [{"$ref": d} for d in deps]}} for i, deps in calls], "content": None})


def random_rows(n=60, seed=1):
    """(conv_id, turn, role, text) and, of each conversation, what its messages are."""
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        ids, turn = [f"c{k}" for k in range(r.randint(1, 7))], 0
        groups = []
        rest = list(ids)
        while rest:
            k = r.randint(1, 3)
            groups.append([rest.pop() for _ in range(min(k, len(rest)))])
        messages = []
        for g in groups:
            messages.append(call_message([(i, r.sample([*ids, "gone"], r.choice([0, 0, 1, 2])) if r.random() < 0.6 else []) for i in g]))
        for i in ids:
            if r.random() < 0.7:
                messages.append(json.dumps({"tool_call_id": i, "content": {"b": r.randint(0, 9), "a": [1.5, None]}}))
        messages += ["plain text"] * r.randint(0, 2)
        r.shuffle(messages)
        for m in messages:
            rows.append((conv, turn, "assistant", m))
            turn += 1
    return rows


def plain_version(rows):
    """(conv, turn): (place, rank, linked, ids of calls in order), by memoised search."""
    out = {}
    for conv in {c for c, _, _, _ in rows}:
        texts = {t: x for c, t, _, x in rows if c == conv}
        calls, deps, results, objects = {}, {}, {}, {}
        for t in sorted(texts):
            objects[t] = obj = json.loads(texts[t]) if texts[t].startswith("{") else {}
            for c in obj.get("tool_calls", []):
                if c["id"] not in calls:
                    calls[c["id"]], deps[c["id"]] = t, [d["$ref"] for d in c["arguments"]["expression"]]
            if "tool_call_id" in obj:
                results[obj["tool_call_id"]] = max(t, results.get(obj["tool_call_id"], -1))
        deps = {i: [d for d in ds if d in calls] for i, ds in deps.items()}

        def behind(node, edges, seen=()):
            """Whether ``node`` reaches a cycle."""
            return node in seen or any(behind(d, edges, (*seen, node)) for d in edges(node))

        def level(i):
            return chat.LAST if behind(i, lambda n: deps[n]) else max((level(d) + 1 for d in deps[i]), default=0)

        def refs(t):
            return [(d, calls[d]) for i, at in calls.items() if at == t for d in deps[i] if calls[d] != t]

        def spot(t):
            """place, rank of the message with calls at turn t"""
            if behind(t, lambda n: [at for _, at in refs(n)]):
                return t, chat.LAST
            parts = [(spot(at), d) for d, at in refs(t)]
            return max([t, *[p for (p, _), _ in parts], *[results.get(d, -1) for _, d in parts]]), max((rank + level(d) + 2 for (_, rank), d in parts), default=0)

        for t, obj in objects.items():
            if "tool_calls" in obj:
                order = [c["id"] for c in obj["tool_calls"]]
                p, rank = spot(t)
                out[conv, t] = (p, min(rank, (1 << 31) - 1), all(i in results for i in order), sorted(order, key=lambda i: (level(i), order.index(i))))
            elif obj.get("tool_call_id") in calls:
                p, rank = spot(calls[obj["tool_call_id"]])
                out[conv, t] = (max(t, p), min(rank + 1 + level(obj["tool_call_id"]), (1 << 31) - 1), True, None)
            else:
                out[conv, t] = (t, 0, False if "tool_call_id" in obj else None, None)
    return out


@pytest.mark.parametrize("together", [chat.TOGETHER, 0])
def test_random_conversations(spark, tmp_path, together, monkeypatch):
    monkeypatch.setattr(chat, "TOGETHER", together)
    rows = random_rows(60 if together else 12)
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op6_chat_format(spark, str(tmp_path)).collect()
    want = plain_version(rows)
    assert len(got) == len(rows) and any(w[3] and len(w[3]) > 1 for w in want.values())
    for g in got:
        obj = json.loads(g["json"])
        have = (g["place"], g["rank"], g["linked"], [c["id"] for c in obj["tool_calls"]] if "tool_calls" in obj else None)
        assert have == want[g["conv_id"], g["turn"]]
        assert g["json"] == chat.canonical(obj) == json.dumps(obj, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    # the order is topological wherever no cycle is
    for conv in {g["conv_id"] for g in got}:
        mine = sorted((g for g in got if g["conv_id"] == conv), key=lambda g: (g["place"], g["rank"], g["turn"]))
        at, ready = {}, {}
        for k, g in enumerate(mine):
            obj = json.loads(g["json"])
            for c in obj.get("tool_calls", []):
                at.setdefault(c["id"], (k, g["rank"]))
            if "tool_call_id" in obj:
                ready[obj["tool_call_id"]] = k
        for k, g in enumerate(mine):
            obj = json.loads(g["json"])
            if g["rank"] >= chat.LAST:
                continue
            for c in obj.get("tool_calls", []):
                for d in c["arguments"]["expression"]:
                    if d["$ref"] in at and at[d["$ref"]][0] != k:
                        assert at[d["$ref"]][0] < k and ready.get(d["$ref"], -1) < k
            if g["linked"] and "tool_call_id" in obj:
                assert at[obj["tool_call_id"]][0] < k


def test_odd_json(spark):
    deep = "[" * 1500 + "]" * 1500
    deeper = '{"a":' * 1500 + "1" + "}" * 1500
    call = lambda args: '{"tool_calls":[{"id":"a","name":"search","arguments":%s}]}' % args
    texts = [
        call('{"query":"q","limit":%s}' % ("9" * 401)),
        call('{"query":%s}' % deep),
        call('{"query":{"x":%s}}' % deeper),
        '{"tool_call_id":"a","content":"\\ud800 \\ud83d\\ude00"}',
        '{"tool_call_id":"\\udc00","content":1e999}',
        '{"tool_call_id":"a","content":NaN}',
        '{"tool_call_id":"a","content":%s}' % ("9" * 5000),
        '{"tool_call_id":"\\u001f","content":"\\u001f"}',
        "[" * 200_000,
        '{"tool_call_id":"x","content":' + "[" * 200_000,
        '{"tool_calls":[{"id":"a","name":"search","arguments":"[1e999]"}]}',
        "x" * 1_000_000,
    ]
    df = spark.createDataFrame([(i, 0, "r\u001f😀" if i == 7 else "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_chat(df).collect()}
    assert len(got) == len(texts)
    assert got[0]["valid"] and "9" * 401 in got[0]["json"]
    assert got[1]["errors"] == "a $.query: not of type string" and deep in got[1]["json"] and deeper in got[2]["json"]
    assert json.loads(got[3]["json"])["content"] == "� \U0001f600"
    for i in (4, 5, 6, 8, 9, 11):
        assert got[i]["linked"] is None and json.loads(got[i]["json"])["content"] == texts[i]
    assert got[7]["json"] == '{"content":"\\u001f","role":"r\\u001f\U0001f600","tool_call_id":"\\u001f"}'
    assert "not JSON" in got[10]["errors"]
    assert all(r["role"] == "user" for i, r in got.items() if i != 7)


def test_first_of_repeated_ids_counts(spark):
    rows = [(1, 0, "a", call_message([("x", [])])), (1, 1, "a", call_message([("x", ["y"])])), (1, 2, "a", call_message([("y", ["x"])]))]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("place", F.lit(7))
    got = {r["turn"]: (r["place"], r["rank"]) for r in chat.format_chat(df.union(df.where("turn = 2"))).collect()}
    # y waits for the first x alone, so there is no cycle
    assert got == {0: (0, 0), 1: (1, 0), 2: (2, 2)}
