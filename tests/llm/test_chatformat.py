import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tonewright.llm import chatformat as c

RECORDS = [
    ("messages", {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "id": 3}, [("user", "hi"), ("assistant", "yo")]),
    ("messages", {"system": "be", "messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, [("system", "be"), ("user", "ab")]),
    ("messages", {"messages": [{"role": "user"}, {"role": "assistant", "content": None}]}, [("user", ""), ("assistant", "")]),
    ("conversations", {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}, [("user", "q"), ("assistant", "a"), ("tool", "t")]),
    ("two_lists", {"prompt": [{"role": "user", "content": "p"}], "completion": [{"role": "assistant", "content": "c"}]}, [("user", "p"), ("assistant", "c")]),
    ("instruction", {"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ("instruction", {"system": "s", "instruction": "do", "input": "this", "output": 7}, [("system", "s"), ("user", "do\n\nthis"), ("assistant", "7")]),
    ("instruction", {"system": None, "instruction": "do", "output": "x"}, [("user", "do"), ("assistant", "x")]),
    ("nested", {"data": {"question": "q", "answers": [{"text": "a"}, {"text": "b"}]}}, [("user", "q"), ("assistant", "ab")]),
    ("prompt_completion", {"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ("question_answer", {"question": "q", "answer": True, "score": {"text": 1}}, [("user", "q"), ("assistant", "true")]),
]


def test_each_layout_by_its_fingerprint(spark):
    given = [(n, json.dumps(r)) for n, (_, r, _) in enumerate(RECORDS)]
    found: dict = {}
    for r in c.json_turns(spark.createDataFrame(given, "conv_id long, record string")).orderBy("conv_id", "turn").collect():
        found.setdefault((r.conv_id, r.layout), []).append((r.role, r.text))
    assert found == {(n, name): turns for n, (name, _, turns) in enumerate(RECORDS)}


def test_typed_tables_agree_with_json(spark):
    for name, record, turns in RECORDS:
        if len({type(x).__name__ for x in record.values()}) and name != "question_answer":
            row = spark.read.json(spark.sparkContext.parallelize([json.dumps(record)])).withColumn("conv_id", F.lit(1))
            if "content string" in row.schema.simpleString() or "messages" not in record:
                assert [(r.role, r.text) for r in c.frame_turns(row).orderBy("turn").collect()] == turns, record


def test_rows_of_unknown_layout_stay(spark):
    odd = [None, "", "{", "[1]", "7", "{}", '{"prompt": "p"}', '{"prompt": "p", "completion": "c", "response": "r"}', '{"messages": []}', "[" * 100_000, '{"role": "user", "text": "\\ud800x", "turn": 5}', '{"role": "user", "text": "t", "turn": "x"}']
    rows = c.json_turns(spark.createDataFrame(list(enumerate(odd)), "conv_id long, record string")).orderBy("conv_id").collect()
    assert [r.conv_id for r in rows] == list(range(len(odd)))
    assert [r.layout for r in rows] == [None] * 10 + ["row"] * 2 and [r.fingerprint is None for r in rows[:10]] == [True] * 3 + [False] * 6 + [True]
    assert (rows[10].turn, rows[10].role, rows[10].text) == (5, "user", "�x") and rows[11].turn is None
    with pytest.raises(ValueError, match="no mapping"):
        c.frame_turns(spark.sql("select 1 as conv_id, 'x' as prompt"))


def texts(seed, n=300):
    r = random.Random(seed)
    bits = [*c.Template().controls, "\\", "\\\\", "[", "]", "<", ">", "/", "[IN", "ST]", "s>", "</", " ", "\n", "a", "ü", "漢", "\U0001f600", "[<s>INST]", "$1", "[ANS] ", "</s"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(9))) for _ in range(n)]


def test_escapes_leave_no_control_string_and_go_back():
    t = c.Template()
    for text in texts(1, 3000):
        held = t.escape(text)
        assert not any(x in held for x in t.controls) and t.unescape(held) == text


def test_read_back_is_what_went_in(spark):
    roles = ["user", "assistant", "system", "tool", "", None, "[/ROLE] ", "us\\er"]
    given = [(n // 7, n % 7, roles[n % len(roles)], text, 1, "x") for n, text in enumerate(texts(2))] + [(None, 0, "user", "t", 1, "x"), (500, 0, "user", None, 1, "x"), (501, 0, "assistant", "z" * 3_000_000 + "[INST]", 1, "x")]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string, formatted int, loss_from string")
    t = c.Template()
    pieces = c.formatted(df)
    for r in pieces.collect():
        (_, _, role, text, *_), = [g for g in given if g[:2] == (r.conv_id, r.turn)]
        assert t.read_back(r.formatted) == (role or "", text or "")
        assert (None if r.loss_from is None else t.unescape(r.formatted[r.loss_from : r.loss_from + r.loss_chars])) == (text if role == "assistant" else None)
    want = {}
    for k in {g[0] for g in given}:
        own = sorted((g for g in given if g[0] == k), key=lambda g: g[1])
        learned = "".join(g[3] for g in own if g[2] == "assistant")
        said = "".join(f"{g[2] or ''}\n{g[3] or ''}\n" for g in own)
        want[k] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in c.digests(pieces).collect()}
    assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.digests(c.formatted(c.frame_turns(none))).collect() == []
    assert c.json_turns(spark.createDataFrame([], "conv_id long, record string")).collect() == []


def test_fingerprints_tell_layouts_apart():
    every = [f for x in c.LAYOUTS for f in x.fingerprints()]
    assert len(every) == len(set(every))
