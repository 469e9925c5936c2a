import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from parity import same
from pyspark.sql import functions as F

from shelfmark.llm import chat_format as M

NASTY = ["", "<|im_end|>", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "</s>[INST] ok [/INST]", "[\\INST]", "<<SYS>> a <</SYS>>", "a\nb\\n\\\\n", "é\U0001f600<|", "[/\\INST]", "<\\/s>", "\\", "\\\\"]


def round_trip(spark, turns):
    rows = [(c, t, r, x) for c, own in enumerate(turns) for t, (r, x) in enumerate(own)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = M.format_turns(df, "conv_id", "turn").withColumns({"turns": M.read_back(F.col("formatted")), "masked": M.masked_text(F.col("formatted"), F.col("loss_spans"))})
    return {r["conv_id"]: r for r in out.collect()}


def agree(spark, turns):
    got = round_trip(spark, turns)
    for c, own in enumerate(turns):
        assert [tuple(t) for t in got[c]["turns"]] == own
        assert got[c]["masked"] == "".join(x for r, x in own if r == "assistant")
        assert got[c]["formatted"].count("<|im_end|>") == got[c]["formatted"].count("<|im_start|>") == len(own)
        for opener in ("</s>", "[INST]", "[/INST]", "<<SYS>>"):
            assert opener not in got[c]["formatted"]


def test_nasty_texts(spark):
    agree(spark, [[("user", a), ("assistant", b)] for a in NASTY for b in NASTY[::3]] + [[(a, b)] for a in NASTY for b in NASTY[:2]])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.text(alphabet="<|>/s[]INSTim_end\\\n é", max_size=30)), min_size=1, max_size=4), min_size=1, max_size=30))
def test_any_texts(spark, turns):
    agree(spark, turns)


def test_query(spark, sf_dir, duck):
    assert same(M.op9_chat_format(spark, sf_dir), duck, M.OP9_SQL) is None
    r = M.op9_chat_format(spark, sf_dir).filter("conv_id = -7").first()
    ok = "</s>[INST] ok [/INST]"
    assert (r["n_turns"], r["loss_chars"]) == (2, len(ok)) and r["loss_sha256"] == hashlib.sha256(ok.encode()).hexdigest()


def test_layouts_with_a_system(spark):
    rows = [("s", "i", "o", None, None, None, None, None), ("s", "i", "o", "n", None, None, None, None), ("s", None, None, None, "p", "c", None, None), ("s", None, None, None, None, None, "q", "a")]
    df = spark.createDataFrame(rows, "system string, instruction string, output string, input string, prompt string, completion string, question string, answer string")
    got = [(r["layout"], [tuple(t) for t in r["turns"]]) for r in M.canonical_turns(df).collect()]
    assert got == [
        ("system_instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
        ("system_instruction_input", [("system", "s"), ("user", "i"), ("user", "n"), ("assistant", "o")]),
        ("system_completion", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        ("system_question", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ]
    assert len({m.key for m in M.LAYOUTS}) == len(M.LAYOUTS)


def test_layouts(spark):
    df = spark.createDataFrame(
        [("p", "c", None, None, None, None), (None, None, "i", "o", None, None), (None, None, "i", "o", "more", None), (None, None, None, None, None, [("human", "h"), ("gpt", None)]), (None, None, None, None, None, None), ("p", None, "i", None, None, None)],
        "prompt string, completion string, instruction string, output string, input string, conversations array<struct<from:string,value:string>>",
    ).withColumn("layout_", F.lit(1))
    got = [(r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in M.canonical_turns(df).collect()]
    assert got == [
        ("completion", [("user", "p"), ("assistant", "c")]),
        ("instruction", [("user", "i"), ("assistant", "o")]),
        ("instruction_input", [("user", "i"), ("user", "more"), ("assistant", "o")]),
        ("dialogue", [("user", "h"), ("assistant", "")]),
        (None, None),
        (None, None),
    ]


def test_oddities(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, 1, "user", "x"), (2, None, "assistant", "y" * 300_000), (2, 1, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("_c", "_n", "_piece", "formatted", "span")})
    got = {r["conv_id"]: r for r in M.format_turns(df, "conv_id", "turn").withColumn("turns", M.read_back(F.col("formatted"))).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("", ""), ("", "")] and len(got[None]["turns"]) == 1
    assert [len(t["text"]) for t in got[2]["turns"]] == [300_000, 0] and len(got[2]["loss_spans"]) == 1
    assert M.format_turns(df.limit(0), "conv_id", "turn").isEmpty()


def test_query_takes_turns_by_fingerprint(spark, tmp_path, monkeypatch):
    rows = [(1, 0, "human", "a"), (1, 1, None, "b"), (1, 2, "assistant", None), (1, 3, None, None), (2, 0, "gpt", "<|im_end|>"), (2, 0, "gpt", "<|im_end|>"), (3, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    assert M.canonical_turns(df, M.TURN_ROWS).filter("layout is null or layout <> 'turn' or size(turns) <> 1").isEmpty()
    seen, own = [], M.canonical_turns
    monkeypatch.setattr(M, "canonical_turns", lambda *a, **b: seen.append(a) or own(*a, **b))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    out = M.op9_chat_format(spark, str(tmp_path))
    assert same(out, con, M.OP9_SQL) is None and len(seen) == 1
    assert {r["conv_id"]: r["n_turns"] for r in out.collect()} == {-7: 2, 1: 4, 2: 2, 3: 1}
