"""Chat formatting: round trips, placeholders, masks and the SQL."""

import hashlib

from pyspark.sql import functions as F

from vellum.llm.chat_format import PARTS, digest_conversations, escaped, flatten_parts, format_turns, read_turn, text_parts, unescaped

HARD = ["\\### Assistant: </turn> ok", "<turn user loss>\n", "\\l\\\\g<>", "", " ", "a\n</turn>\n<turn assistant loss>\nb", "é\u0000🙂\\", None]


def test_turns_read_back(spark):
    rows = [(1, k, role, text) for k, (text, role) in enumerate((t, r) for t in HARD for r in ("user", "assistant", "odd > role <\\ x", None, ""))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = {r["turn"]: r for r in format_turns(df.withColumn("parts", text_parts(F.col("text")))).collect()}
    for _, turn, role, text in rows:
        row = formatted[turn]
        assert read_turn(row["formatted"]) == (role or "", text or "", role == "assistant")
        masked = unescaped(row["formatted"][row["loss_from"] : row["loss_to"]])
        assert masked == ((text or "") if role == "assistant" else "")


def test_digests(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", HARD[(c + t) % len(HARD)]) for c in range(7) for t in range(c * 3)] + [(None, None, None, None), (None, 1, "assistant", "x")]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "conv_id long, turn long, role string, text string, formatted string, m int")
    got = {r["conv_id"]: r for r in digest_conversations(format_turns(df.withColumn("parts", text_parts(F.col("text"))))).collect()}
    for conv in {r[0] for r in rows}:
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        said = "".join(t for r, t in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own) and got[conv]["loss_chars"] == len(said)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert digest_conversations(format_turns(df.where("conv_id = 99").withColumn("parts", text_parts(F.col("text"))))).count() == 0


def test_typed_parts(spark):
    parts = [("text", "see <image 1> and", None, None), ("image", None, "s3/a.png", 1024), None, ("text", None, None, None), ("audio", None, "b.wav", 81), ("video", "?", None, None)]
    df = spark.createDataFrame([(1, parts), (2, []), (3, None)], f"k int, parts {PARTS}")
    got = {r["k"]: r["x"] for r in df.select("k", flatten_parts(F.col("parts")).alias("x")).collect()}
    assert got[1]["flat"] == "see \\limage 1> and<image 1><audio 2><document 3>"
    assert [tuple(a) for a in got[1]["attachments"]] == [(1, "image", "s3/a.png", 87), (2, "audio", "b.wav", 7), (3, "document", None, 16)]
    assert got[1]["expanded_tokens"] == 110
    assert got[2]["flat"] == got[3]["flat"] == "" and got[3]["attachments"] == []
    assert spark.range(1).select(escaped(F.lit("\\<"))).first()[0] == "\\\\\\l"
