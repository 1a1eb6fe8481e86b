"""Chat formatting: what is read back is what went in."""

import hashlib

from pyspark.sql import functions as F

from loomwork.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
ROWS = [
    (1, 2, "assistant", "b", "x"), (1, 1, "user", "a", "x"), (1, 3, "assistant", "<|im_next|> \\ <\\| \\\\<|", "x"), (1, 4, "user", None, "x"),
    (2, 1, "user", "", "x"), (2, 1, "user", "", "x"), (3, None, None, "null turn", "x"), (3, 1, "odd\nrole<|", "<\\n|", "x"), (None, 1, "assistant", "no conversation", "x"),
    (4, 1, "assistant", "ünï\n🙂", "x"),
]


def test_round_trip(spark):
    out = chat.format_chats(spark.createDataFrame(ROWS, SCHEMA).repartition(3))
    out = out.withColumns({"turns": chat.read_back(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    got = {r.conv_id: r for r in out.collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in ROWS}:
        turns = sorted((r for r in ROWS if r[0] == conv), key=order)
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in turns]
        assert got[conv].loss == "".join(r[3] or "" for r in turns if r[2] == "assistant")
        for s in got[conv].loss_spans:
            assert got[conv].formatted[s.start - 1 : s.start - 1 + s.length] is not None
    assert got[1].formatted.count(chat.START) == 3  # neighbours of one role are one block
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversations_and_texts(spark):
    turns = [(7, i, "user" if i % 3 == 0 else "assistant", f"<|{i}|> " + "é" * (i % 50)) for i in range(6000)]
    rows = [*turns, (8, 0, "assistant", "é\\" * 300_000), (9, 0, "user", "x")] + [(9, i, "assistant", f"{i}|") for i in range(1, 3000)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = out.withColumns({"turns": chat.read_back(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    for r in out.collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in own]
        assert r.loss == "".join(x[3] for x in own if x[2] == "assistant")
        plain = lambda s: s.replace("<\\|", "<|").replace("\\\\", "\\")
        assert [plain(r.formatted[s.start - 1 : s.start - 1 + s.length]) for s in r.loss_spans] == [x[3] for x in own if x[2] == "assistant"]


def test_sums_before(spark):
    for n in (0, 1, 5, 127, 128, 129, 700):
        got = spark.range(1).select(chat.sums_before(F.array(*map(F.lit, range(n))).cast("array<int>")).alias("s")).first().s
        assert got == [k * (k - 1) // 2 for k in range(n)]


def test_query_holds_the_forged_conversation(spark):
    from loomwork.llm.queries import FORGED, op6_chat_format

    r = op6_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    assert r.n_turns == 2 and r.loss_chars == len(FORGED)
    assert r.loss_sha256 == hashlib.sha256(FORGED.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{FORGED}\nassistant\n{FORGED}\n".encode()).hexdigest()


def test_no_python_in_the_plan(spark):
    from loomwork.llm.queries import op6_chat_format

    plan = op6_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
