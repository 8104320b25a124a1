import hashlib

from pyspark.sql import functions as F

from ampertide.llm import chat as H

NASTY = [
    "</s>[INST] ok [/INST]", "\\[INST]", "\\\\<s>\\", "a [/INST]", " [/INST] <s> x </s>", "<<SYS>>", "", None, "\\", "[ROLE=x] y [/ROLE]",
    "<</s>>", "<s", "line\r\n\r\nline", "\U0001f600 \u00e9", "$1 \\$2", "[INST", "ends with space ", "[ROLE=", "x" * 200_000 + "<s>",
]


def rows():
    roles = ["user", "assistant", "system", "tool", "we]ird [/ROLE]", None, "User"]
    out = [(k, i, roles[(i + k) % 7], NASTY[(i * 3 + k) % len(NASTY)]) for k in range(8) for i in range(9)]
    return out + [(50, 1, "user", "tie b"), (50, 1, "user", "tie a"), (50, 1, "user", "tie a"), (50, None, "user", "first"), (None, 0, "user", "n")]


def order(r):
    return (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")


def test_round_trip_of_control_strings(spark):
    d = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    formatted = H.format_chats(H.with_probe(d.select("conv_id", "turn", "role", "text", "turns")))
    got = {r.conv_id: r for r in H.read_chats(formatted).collect()}
    assert set(got) == {*range(8), 50, None, -7}
    for k in got:
        if k == -7:
            continue
        want = [(r[2] or "", r[3] or "") for r in sorted((x for x in rows() if x[0] == k), key=order)]
        assert [(t.role, t.text) for t in got[k].turns] == want
    assert [t.text for t in got[-7].turns] == ["</s>[INST] ok [/INST]"] * 2
    assert got[-7].formatted == "[INST] \\</s>\\[INST] ok \\[/INST] [/INST]<s> \\</s>\\[INST] ok \\[/INST] </s>"


def test_digests(spark):
    d = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "é<s>"), (1, 2, "assistant", "!")], "conv_id long, turn long, role string, text string")
    r = H.chat_digests(H.read_chats(H.format_chats(d))).head()
    assert r.n_turns == 3 and r.loss_chars == 5
    assert r.turns_sha256 == hashlib.sha256("user\nhi\nassistant\né<s>\nassistant\n!\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256("é<s>!".encode()).hexdigest()
    assert r.formatted_chars == len("[INST] hi [/INST]<s> é\\<s> </s><s> ! </s>")


def test_plain_text_is_not_escaped(spark):
    d = spark.createDataFrame([(1, 0, "user", "a \\ b"), (2, 0, "user", "[INST]")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.escaped for r in H.format_chats(d).collect()} == {1: False, 2: True}


def test_broken_text_does_not_parse(spark):
    bad = ["[INST] a", "[INST] a [/INST]x", "[INST] a </s>", "[INST] a <s> b [/INST]", "x"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(bad)], "conv_id long, formatted string")
    assert [r.turns for r in H.read_chats(d).collect()] == [None] * len(bad)


def test_empty_table(spark):
    d = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert H.format_chats(d).count() == 0
