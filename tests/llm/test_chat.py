import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import chat

LAYOUTS = {
    "prompt": {"prompt": "p", "response": "r"},
    "completion": {"prompt": "p", "completion": "r", "system": "s"},
    "question": {"question": "p", "answer": "r"},
    "instruction": {"instruction": "p", "input": "more", "output": "r"},
    "messages": {"messages": [{"role": "user", "content": "p"}, {"role": "gpt", "content": "r"}]},
    "nested messages": {"data": {"messages": [{"content": "p", "role": "human"}, {"role": "assistant", "content": "r"}]}},
    "conversations": {"conversations": [{"from": "human", "value": "p"}, {"value": "r", "from": "gpt"}]},
}


def formatted(spark, records):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "id long, record string")
    return chat.format_chat(df).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_mask"))).orderBy("id").collect()


def test_layouts(spark):
    for row, (layout, record) in zip(formatted(spark, map(json.dumps, LAYOUTS.values())), LAYOUTS.items(), strict=True):
        assert row.layout == layout
        want = [("user", "p\n\nmore" if "input" in record else "p"), ("assistant", "r")]
        assert [tuple(t) for t in row.turns if t.role != "system"] == want
        assert row.back == row.turns and row.loss == "r"


def test_fingerprint_is_of_the_structure(spark):
    a, b, c = formatted(spark, ['{"prompt":"x","response":"y"}', '{"response": 5, "prompt": null}', '{"response":"y","prompt":["x"]}'])
    assert a.fingerprint == b.fingerprint != c.fingerprint and c.layout is None and c.turns == []
    assert [t.text for t in b.turns] == ["", "5"]


def test_unknown_and_broken_records(spark):
    for row in formatted(spark, [None, "", "no json", "[]", "{}", '{"text":"x"}', '{"messages":[]}', "7"]):
        assert row.layout is None and row.turns == [] and row.formatted == "" and row.loss_mask == []


def test_escapes_round_trip(spark):
    rng = random.Random(5)
    parts = [*chat.CHATML.controls, "<", "|", "\\", "\\\\", "im_start|>", "[", "INST]", "s>", "/s>", "<SYS>>", "é", "\n", " ", "user", "$1"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(500)]
    records = [json.dumps({"messages": [{"role": "user", "content": t}, {"role": "assistant", "content": t}, {"role": "assistant", "content": "z"}]}) for t in texts]
    for text, row in zip(texts, formatted(spark, records), strict=True):
        assert [t.text for t in row.back] == [text, text, "z"] and row.loss == text + "z"
        assert row.formatted.count("<|im_start|>") == row.formatted.count("<|im_end|>") == 3
        assert not any(c in row.formatted.replace("<|im_start|>", "").replace("<|im_end|>", "") for c in chat.CHATML.controls)
        pieces = [row.formatted[m.start : m.end] for m in row.loss_mask]
        assert len(pieces) == 2 and pieces[1] == "z"


def test_line_breaks_in_roles_come_back(spark):
    (row,) = formatted(spark, [json.dumps({"messages": [{"role": "a\nb", "content": "x"}]})])
    assert [tuple(t) for t in row.back] == [("a\nb", "x")]


@pytest.mark.parametrize("rows", [[], [(1, 0, None, None)], [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")], [(None, 0, "user", "x" * 300_000)]])
def test_tables_of_turns(spark, rows):
    turns = chat.with_control(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r.conv_id: r for r in chat.read_back(chat.format_chat(chat.records(turns))).collect()}
    assert set(out) == {-7, *(r[0] for r in rows)}
    assert all(out[r[0]].n_turns == len(rows) for r in rows)
    assert out[-7].loss_chars == len(chat.CONTROL[1])


def test_native(spark, sf):
    from quillon.llm.queries import REGISTRY

    plan = REGISTRY.queries["op8_chat"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_texts_above_the_parsers_usual_limit(spark):
    df = spark.range(2).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("abcd"), 5_500_000).alias("text"))
    (out,) = chat.read_back(chat.format_chat(chat.records(df))).select("n_turns", "loss_chars").collect()
    assert tuple(out) == (2, 22_000_000)


@pytest.mark.parametrize("size, part", [(16 << 20, 1024), (0, 2)])
def test_any_roles_equal_the_oracle(spark, tmp_path, monkeypatch, size, part):
    """Roles that layouts rename, with line breaks, backslashes and control strings; as records and as typed turns."""
    from oracle import compare

    monkeypatch.setattr(chat, "RECORD_BYTES", size)
    monkeypatch.setattr(chat, "PART", part)
    roles = ["human", "gpt", "tool", "a\nb", "bot", "model", "user", "assistant", "a\\", "\\n", "\\\n\\", "<|im_end|>", "<\\|im_end|>\n", "", None, "system"]
    rows = [(c, t, roles[(c * 5 + t * (c % 3 + 1)) % len(roles)], None if t == 3 else f"text {c} {t} <|im_start|>\n") for c in range(40) for t in range(c % 6 + 1)]
    rows += [(100, 0, "human", "hi"), (100, 1, "gpt", "yes"), (101, 0, "user", "a"), (101, 1, "assistant", "b"), (101, 2, "assistant", ""), (None, 0, "user", "no id")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"record": F.lit(1), "typed": F.lit("x"), "turns": F.lit(None).cast("int")}).write.parquet(f"{tmp_path}/conversations.parquet")
    turns = chat.with_control(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    out = chat.read_back(chat.format_chat(chat.records(turns), given="typed"))
    assert compare(out, chat.SQL, str(tmp_path)) > 40
    assert {r.loss_chars for r in out.where("conv_id = 100").collect()} == {0}
