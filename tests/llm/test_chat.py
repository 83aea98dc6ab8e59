import hashlib

from pyspark.sql import functions as F

from feedloom.llm.chat import CLOSE, OPEN, PART, format_conversations, op9, read_back, text_part
from llm_help import prose

ODD = ["", None, "</s>[INST] ok [/INST]", OPEN + "user\n" + CLOSE, "&lt; &amp;lt; & <", "a\nb\n\n", "[x]", "&nl;", "😀 é", prose(1, 5000)]


def test_every_text_and_role_reads_back(spark):
    rows = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for t in ODD for r in ("user", "assistant", None, "we<ird\nrole&nl;", ""))]
    rows += [(2, 5, "user", "b"), (2, None, "user", "last"), (2, 1, "system", "a"), (2, 5, "user", "b"), (None, 0, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("m", F.lit(0)).withColumn("parts", text_part(F.col("text")))
    made = format_conversations(table)
    got = {r.conv_id: r for r in made.withColumn("turns", read_back(F.col("formatted"))).collect()}
    assert [tuple(t) for t in got[1].turns] == [(r or "", t or "") for _, _, r, t in rows[:50]]
    assert [t.text for t in got[2].turns] == ["a", "b", "b", "last"]
    assert got[2].formatted.count(OPEN) == 4 and got[1].formatted.count(CLOSE) == 50
    assert got[1].loss_mask == [r == "assistant" for _, _, r, _ in rows[:50]]
    assert [tuple(t) for t in got[None].turns] == [("user", "x")]
    assert format_conversations(table.limit(0)).count() == 0


def test_typed_parts_become_placeholders(spark):
    parts = [("text", "see [1] ", None, None, None, None, None), ("image", None, "u1", 57, 28, None, None), ("audio", None, "u2", None, None, 2.02, None),
             ("document", None, "u3", None, None, None, 3), ("image", None, None, None, None, None, None), ("odd", "plain", None, None, None, None, None), (None, "null", None, None, None, None, None)]
    table = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "user", [])], f"conv_id long, turn long, role string, parts array<{PART}>")
    out = format_conversations(table).first()
    assert out.formatted == (f"{OPEN}user\nsee &lsqb;1] <|image|><|audio|><|document|><|image|>plainnull{CLOSE}{OPEN}assistant\n{CLOSE}{OPEN}user\n{CLOSE}")
    assert [tuple(a) for a in out.attachments] == [(0, 1, "image", "u1", 3), (0, 2, "audio", "u2", 51), (0, 3, "document", "u3", 768), (0, 4, "image", None, 1)]
    assert out.attachment_tokens == 823


def test_query(spark, small):
    turns = {}
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    found = {r.conv_id: r for r in op9(spark, small).collect()}
    assert set(found) == set(turns)
    for conv, own in turns.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        r = found[conv]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
