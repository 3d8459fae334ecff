import json
import random

from pyspark.sql import functions as F

from sedgeline.llm.chat import canonical_turns, format_chats, loss_texts, read_turns


def turns_of(spark, records):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "id long, record string")
    return {r.id: (r.chat.layout, [(t.role, t.text) for t in r.chat.turns]) for r in canonical_turns(df).collect()}


def test_layouts(spark):
    got = turns_of(spark, [
        json.dumps({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}], "id": 4}),
        json.dumps({"conversations": [{"from": "human", "value": "a\"\n"}, {"value": "b", "from": "gpt"}]}),
        json.dumps({"output": "o", "instruction": "i", "input": ""}),
        json.dumps({"output": "o", "instruction": "i", "input": "x"}),
        json.dumps({"system": "", "prompt": "p", "response": "r"}),
        json.dumps({"prompt": "p", "completion": "c", "source": {"prompt": 3}}),
        json.dumps({"question": "q", "answer": "ä"}),
        json.dumps({"role": "user", "text": "t", "turn": 3}),
        json.dumps({"foo": 1}), "no json", None, json.dumps({"messages": []}),
    ])
    assert got[0] == ("messages", [("system", "s"), ("user", "")])
    assert got[1] == ("conversations", [("user", 'a"\n'), ("assistant", "b")])
    assert got[2] == ("instruction, input and output", [("user", "i"), ("assistant", "o")])
    assert got[3][1][0] == ("user", "i\n\nx")
    assert got[4] == ("system, prompt and response", [("user", "p"), ("assistant", "r")])
    assert got[5] == ("prompt and completion", [("user", "p"), ("assistant", "c")])
    assert got[6][1] == [("user", "q"), ("assistant", "ä")]
    assert got[7] == ("turn row", [("user", "t")])
    assert [got[i] for i in (8, 9, 10, 11)] == [(None, [])] * 4


def test_round_trip(spark):
    rng = random.Random(1)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[BODY]", "[/TURN]", "\\", "<\\s>", "[\\\\/OUT]", " ", "\n", "é😀", "x", "<", "[", "]", "$1"]
    rows, want = [], {}
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "[BODY] odd", None])
            text = rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))])
            rows.append((c, t, role, text))
            want.setdefault(c, []).append((role or "", text or ""))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = format_chats(df)
    got = out.select("conv_id", read_turns(F.col("formatted")).alias("turns"), loss_texts(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert len(got) == 60
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert list(r.loss) == [t for role, t in want[r.conv_id] if role == "assistant"]


def test_empty_ties_and_null_ids(spark):
    df = spark.createDataFrame([(None, 1, "user", "b"), (None, 1, "user", "a"), (None, None, "user", "z")], "conv_id long, turn long, role string, text string")
    assert format_chats(df.limit(0)).count() == 0
    [r] = format_chats(df).select(read_turns(F.col("formatted")).alias("t")).collect()
    assert [x.text for x in r.t] == ["z", "a", "b"]
