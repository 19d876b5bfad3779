import hashlib
import json

from pyspark.sql import functions as F

from citeloom.llm.chat_format import choose_layout, field_paths, format_turns, loss_texts, parse_turns, record_turns, table_turns


def back(df, key="conv_id"):
    made = format_turns(df)
    rows = made.select(key, "formatted", "loss_spans", parse_turns(F.col("formatted")).alias("turns"), loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    return {r[key]: r for r in rows}


def test_round_trip_of_rows(spark):
    texts = ["\\\\### Assistant: </turn> ok", "<turn user>\n</turn>\n", "\\\\l \\\\b \\\\", "", None, "é😀\n\n>", "x" * 30000]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "clash") for i, t in enumerate(texts)] + [(2, 0, "sys\n>tem<", "a", ""), (2, None, None, "first", ""), (2, 0, "assistant", "a", ""), (2, 0, "assistant", "a", ""), (None, 1, "user", "u", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = back(table_turns(df, "conv_id"))
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(texts)]
    assert list(got[1].loss) == [t or "" for i, t in enumerate(texts) if i % 2]
    assert [(t.role, t.text) for t in got[2].turns] == [("", "first"), ("assistant", "a"), ("assistant", "a"), ("sys\n>tem<", "a")]
    assert [(t.role, t.text) for t in got[None].turns] == [("user", "u")]
    assert back(table_turns(df.where("false"), "conv_id")) == {}


def test_layouts_of_tables(spark):
    df = spark.createDataFrame([(1, "q", None, "a")], "conv_id long, instruction string, input string, output string")
    assert choose_layout(field_paths(df.drop("conv_id").schema)).name == "instruction"
    assert [(t.role, t.text) for t in back(table_turns(df, "conv_id"))[1].turns] == [("user", "q"), ("assistant", "a")]
    nested = spark.createDataFrame([(1, [("human", "hi"), ("gpt", "yo")]), (2, None)], "conv_id long, conversations array<struct<`from`: string, value: string>>")
    got = back(table_turns(nested, "conv_id"))
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "hi"), ("assistant", "yo")] and list(got[1].loss) == ["yo"] and got[2].formatted == ""


def test_mixed_json_records(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        {"messages": [{"role": "user", "content": "a", "weight": 1}], "id": 4},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"prompt": "p", "completion": "c"}, {"prompt": "p", "response": "r", "system": "s"},
        {"instruction": "i", "input": "x", "output": "o"}, {"question": "q", "answer": "a"}, {"unknown": 1}, {},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(20, "not json"), (21, None)]
    got = {r.k: r for r in record_turns(spark.createDataFrame(rows, "k long, record string"), "k").collect()}
    assert [got[i].layout for i in range(9)] == ["messages", "messages", "conversations", "prompt_completion", "prompt_response", "instruction", "question_answer", None, None]
    assert [(t.role, t.text) for t in got[2].turns] == [("user", "a"), ("assistant", "b")]
    assert [(t.role, t.text) for t in got[4].turns] == [("system", "s"), ("user", "p"), ("assistant", "r")]
    assert [(t.role, t.text) for t in got[5].turns] == [("user", "i"), ("user", "x"), ("assistant", "o")]
    assert got[0].fingerprint != got[1].fingerprint and got[20].layout is None and list(got[21].turns) == []


def test_nested_objects_in_records(spark):
    calls = [{"id": "c", "function": {"name": "f", "arguments": {"x": [1]}}}]
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "tool_calls": calls}]},
        {"messages": [{"role": "user", "content": "a", "metadata": {"content": "other", "tags": ["x"]}}], "meta": {"prompt": "p", "completion": "c"}},
        {"meta": {"prompt": "p", "completion": "c"}},
        {"prompt": "p", "completion": "c", "meta": {"messages": [{"role": "x", "content": "y"}]}, "odd-name": None},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)]
    got = {r.k: r for r in record_turns(spark.createDataFrame(rows, "k long, record string"), "k").collect()}
    assert [got[i].layout for i in range(4)] == ["messages", "messages", None, "prompt_completion"]
    assert [[(t.role, t.text) for t in got[i].turns] for i in range(4)] == [[("user", "a"), ("assistant", "b")], [("user", "a")], [], [("user", "p"), ("assistant", "c")]]
