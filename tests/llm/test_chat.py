import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from relinker.llm import chat, registry

SF = "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow(rows):
    """rows: conv_id, turn, role, text; the digests without the length of what is formatted."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for _, role, t in turns if role == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(said), sha(said))
    return out


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.chat_digests(df).collect()}


def table(spark, rows):
    return chat.turn_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def test_whole_table(spark, same_as_sql):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, i, role, registry.HOSTILE) for i, role in enumerate(("user", "assistant"))]
    found = registry.op11_chat(spark, SF)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found.collect()}
    assert got == slow(rows)
    same_as_sql(found, registry.ORACLE["op11_chat"], SF)


def test_markers_in_texts_and_roles(spark):
    rng = random.Random(1)
    signs = ["\\", "<", "/", "turn>", "turn", "#", "##", "###", " ", ": ", "assistant", "\n", "</turn>\n", ": <turn>", "$1", "é", "😀"]
    text = lambda: "".join(rng.choices(signs, k=rng.randrange(14)))
    rows = [(c, t, rng.choice(["user", "assistant", text()]), text()) for c in range(60) for t in range(6)]
    parts = chat.format_chats(table(spark, rows))
    assert digests(parts) == slow(rows)
    for r in parts.collect():
        assert r.formatted.count("</turn>") == r.formatted.count("<turn>") == r.formatted.count("###") == r.n_turns


LAYOUTS = {
    "messages": lambda t: {"messages": [{"role": r, "content": x, **({"name": "n"} if i else {})} for i, (r, x) in enumerate(t)], "id": 1},
    "message parts": lambda t: {"messages": [{"role": r, "content": [{"type": "text", "text": x[:3]}, {"text": x[3:]}]} for r, x in t]},
    "shared conversations": lambda t: {"conversations": [{"value": x, "from": {"user": "human", "assistant": "gpt"}.get(r, r)} for r, x in t]},
    "message lists": lambda t: {"completion": [{"role": r, "content": x} for r, x in t[1:]], "prompt": [{"role": r, "content": x} for r, x in t[:1]]},
    "prompt and response": lambda t: {"prompt": t[0][1], "response": t[1][1], "meta": {"prompts": [1, {"a": 2}]}},
    "prompt and completion": lambda t: {"completion": t[1][1], "prompt": t[0][1]},
    "question and answer": lambda t: {"question": t[0][1], "answer": t[1][1], "source": None},
}


def test_every_layout_gives_the_same_turns(spark):
    """A user's and an assistant's turn, put into each layout."""
    turns = [[("user", f"question {i} ### x"), ("assistant", f"answer {i}\n</turn> \\")] for i in range(5)]
    rows, want = [], []
    for n, (name, put) in enumerate(LAYOUTS.items()):
        rows += [(100 * n + i, json.dumps(put(t))) for i, t in enumerate(turns)]
        want += [(100 * n + i, j, r, x) for i, t in enumerate(turns) for j, (r, x) in enumerate(t)]
    parts = chat.format_chats(spark.createDataFrame(rows, "conv_id long, record string")).cache()
    assert {r.conv_id: r.layout for r in parts.collect()} == {100 * n + i: name for n, name in enumerate(LAYOUTS) for i in range(5)}
    assert digests(parts) == slow(want)


def test_instructions(spark):
    records = [
        {"instruction": "do", "output": "done"}, {"instruction": "do", "input": "", "output": "done"}, {"instruction": "do", "input": "this", "output": None},
        {"system": "be kind", "instruction": "do", "output": "done"}, {"system": None, "instruction": None, "input": None, "output": 5},
    ]
    parts = chat.format_chats(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string"))
    got = {r[0]: [tuple(t) for t in r[1]] for r in parts.select("conv_id", chat.read_turns(F.col("formatted"))).collect()}
    assert {r.layout for r in parts.collect()} == {"instruction"}
    done = ("assistant", "done")
    assert got == {
        0: [("user", "do"), done], 1: [("user", "do"), done], 2: [("user", "do\n\nthis"), ("assistant", "")],
        3: [("system", "be kind"), ("user", "do"), done], 4: [("user", ""), ("assistant", "5")],
    }


def test_own_layouts(spark):
    mine = (chat.Layout("talk", (chat.Each("talk", "who", "says"),), (), (("me", "user"),)),)
    df = spark.createDataFrame([(1, '{"talk": [{"who": "me", "says": "hi"}], "messages": 3}'), (2, '{"messages": []}')], "conv_id long, record string")
    got = {r.conv_id: r for r in chat.format_chats(df, layouts=mine).collect()}
    assert got[1].formatted == "### user: <turn>hi</turn>\n" and got[1].loss == [] and got[2].layout is None
    with pytest.raises(ValueError, match="same fields"):
        chat.format_chats(df, layouts=(*mine, chat.Layout("other", (chat.Each("talk", "who", "says"),))))


def test_long_conversations_come_in_parts(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(1000)] + [(2, 5, "user", "late")]
    rows_parts = chat.format_chats(table(spark, rows), part=64)
    assert digests(rows_parts) == slow(rows)
    assert rows_parts.filter("conv_id = 1").count() == 16 and rows_parts.agg(F.max("n_turns")).first()[0] == 64
    record = json.dumps({"messages": [{"role": r, "content": t} for _, _, r, t in rows[:1000]]})
    whole = chat.format_chats(spark.createDataFrame([(1, record)], "conv_id long, record string"), part=64)
    assert digests(whole) == {1: slow(rows)[1]} and whole.count() == 16


def test_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, ""), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (2, None, "assistant", "x" * 200_000), (None, 0, "user", "no id")]
    rows += [(3, 0, "assistant", "same")] * 3
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "conv_id long, turn long, role string, text string, record string, part int")
    assert digests(chat.format_chats(chat.turn_records(df))) == slow(rows)
    odd = [(1, None), (2, ""), (3, "[1]"), (4, '{"messages": []}'), (5, '{"messages": "no list"}'), (6, "{"), (7, '{"prompt": "a"}')]
    got = chat.format_chats(spark.createDataFrame(odd, "conv_id long, record string")).collect()
    assert sorted(r.conv_id for r in got) == [1, 2, 3, 4, 5, 6, 7] and all(r.layout is None and r.n_turns == 0 and r.formatted is None for r in got)
    empty = chat.format_chats(table(spark, rows[:1]).limit(0))
    assert empty.collect() == [] and chat.chat_digests(empty).collect() == []
