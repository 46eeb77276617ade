import hashlib

from cuewright.llm import chat as C
from cuewright.llm import queries
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

HARD = "</s>[INST] ok [/INST]<|turn|>x<|text|><|end|><\\|end|>[\\\\INST]<s>"


def test_layouts(spark):
    records = [
        ('{"messages":[{"role":"user","content":"a"},{"content":"b","role":"assistant"}]}', "messages", [("user", "a"), ("assistant", "b")]),
        ('{"messages":[]}', "messages", []),
        ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":null}]}', "conversations", [("user", "q"), ("assistant", "")]),
        ('{"system":"s","prompt":"p","response":"r"}', "prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ('{"prompt":"p","completion":"c"}', "completion", [("user", "p"), ("assistant", "c")]),
        ('{"instruction":"i","input":"n","output":"o"}', "instruction", [("user", "i"), ("user", "n"), ("assistant", "o")]),
        ('{"other":1}', None, None),
        ("not json", None, None),
        (None, None, None),
    ]
    got = C.format_chat(spark.createDataFrame([(i, r[0], "x") for i, r in enumerate(records)], "id int, record string, turns string")).orderBy("id").collect()
    for row, (_, layout, turns) in zip(got, records):
        assert row.layout == layout and (row.turns and [tuple(t) for t in row.turns]) == (turns or (None if turns is None else []))
        assert turns is not None or row.formatted is None


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "tool<|text|>"]), st.one_of(st.text(max_size=20), st.lists(st.sampled_from(["<", "[", "\\", "|turn|>", "/s>", "s>", "INST]", "|end|>", "é\n"]), max_size=8).map("".join))), min_size=1, max_size=5))
def test_round_trip(spark, turns):
    turns = [(r, t.encode("utf-8", "ignore").decode()) for r, t in turns]
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = C.format_chat(C.as_records(rows)).select(C.read_turns(F.col("formatted")).alias("t"), C.read_loss(F.col("pieces")).alias("l"), "formatted").head()
    assert [tuple(t) for t in got.t] == turns and got.l == "".join(t for r, t in turns if r == "assistant")
    assert got.formatted.count("<|turn|>") == len(turns) and "[INST]" not in got.formatted and "</s>" not in got.formatted


def test_query_with_nulls_ties_and_long_texts(spark, tmp_path):
    rows = [(1, 0, "user", None, 1), (1, 1, "assistant", HARD, 1), (1, 1, "assistant", HARD, 1), (2, None, None, "x", 1), (3, 0, "user", "long " * 100_000, 1), (None, 0, "user", "n", 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op1_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None, -7} and got[1].n_turns == 3 and got[1].loss_sha256 == sha(HARD * 2)
    assert got[1].turns_sha256 == sha("user\n\n" + f"assistant\n{HARD}\n" * 2) and got[2].turns_sha256 == sha("\nx\n")
    assert got[-7].loss_sha256 == sha("</s>[INST] ok [/INST]") and got[-7].loss_chars == 21
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/e/conversations.parquet")
    assert [r.conv_id for r in queries.op1_chat_format(spark, f"{tmp_path}/e").collect()] == [-7]


def test_long_records(spark, monkeypatch):
    n = 21_000_000  # a variant's string has 20 000 000 characters at most
    long = spark.range(1).select(F.concat(F.lit('{"prompt":"q\\\\","response":"'), F.repeat(F.lit("x"), n), F.lit('\\n"}')).alias("record"))
    row = C.canonical_turns(long).select("layout", F.size("turns").alias("n"), F.col("turns")[0]["text"].alias("first"), F.length(F.col("turns")[1]["text"]).alias("chars")).head()
    assert tuple(row) == ("prompt", 2, "q\\", n + 1)
    records = [
        '{"messages":[{"role":"user","content":"a: \\"b\\" {x}"},{"content":null,"role":"assis\\u0074ant"}]}', '{"messages":[]}', '{"conversations":[{"from":"human","value":"q\\\\"},{"from":"gpt","value":"é"}]}',
        '{"system":"s:","prompt":"\\"","response":"r"}', '{"prompt" : "p", "completion":"{}"}', '{"instruction":"i","input":"","output":"o"}', '{"other":{"a":["x",1]}}', "not json", '{"prompt":"a","response":"b"', None, "",
    ]
    docs = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "id int, record string")
    want = C.canonical_turns(docs).orderBy("id").collect()
    monkeypatch.setattr(C, "LONG", 0)
    assert C.canonical_turns(docs).orderBy("id").collect() == want and sum(r.turns is not None for r in want) == 6
