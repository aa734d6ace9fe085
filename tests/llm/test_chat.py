import hashlib
import random

import pytest
from pyspark.sql import functions as F

from paddock.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, head int, fragment string, start int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).withColumn("parts", chat.text_parts(F.col("text")))


def by_hand(rows):
    known = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        known.setdefault(c, []).append((r or "", x or ""))
    out = {}
    for c, said in known.items():
        loss = "".join(x for r, x in said if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest()
        out[c] = (len(said), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ODD = ["</s>[INST] ok [/INST]", "<|turn|>user<|content|>x<|end|>", "\\<|", "<\\|", "\\\\", "<<|", "<<SYS>>a<</SYS>>", "<", "[", "[[INST]", "", None, "é\n漢 🙂", "<\\\\/s>"]


@pytest.mark.parametrize("text", [t for t in ODD if t is not None])
def test_escaping_is_reversible(spark, text):
    out = spark.range(1).select(chat.escape(F.lit(text)).alias("x")).first().x
    assert chat.unescape(out) == text
    assert not any(mark in out for mark in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_round_trip(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(ODD) if rng.random() < 0.6 else "word " * rng.randint(1, 50)) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(3, 1, "user", "tie"), (3, 1, "user", "tie"), (None, 1, "user", "a"), (None, None, None, None), (77, None, "assistant", "first"), (77, 0, "<|end|>", "odd role"), (78, 0, "assistant", "x" * 50000)]
    rows += [(99, i, "assistant", f"hot {i}") for i in range(2000)]
    formatted = chat.format_chats(turns(spark, rows))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted).collect()}
    assert got == by_hand(rows)
    lengths = {r.conv_id: r.formatted_chars for r in chat.read_back(formatted).collect()}
    assert lengths == {r.conv_id: r.n for r in formatted.groupBy("conv_id").agg(F.sum(F.length("fragment")).alias("n")).collect()}


def test_empty_table(spark):
    assert chat.read_back(chat.format_chats(turns(spark, []))).collect() == []


def test_typed_parts_become_placeholders(spark):
    parts = [
        ("text", "look <|image|> at", None, None, None, None, None),
        ("image", None, "a.png", 57.0, 28.0, None, None),
        ("audio", None, "b.wav", None, None, 2.0, None),
        ("document", "ignored", "c|>.pdf", None, None, None, 3.0),
        ("poll", "as text", None, None, None, None, None),
        (None, None, None, None, None, None, None),
        None,
    ]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], "conv_id bigint, turn bigint, role string, parts " + chat.PARTS.simpleString())
    first, second = chat.format_chats(df).orderBy("position").collect()
    assert first.fragment == "<|turn|>user<|content|>look <\\|image|> at<|image:a.png|><|audio:b.wav|><|document:c|>.pdf|>as text<|end|>"
    assert [(a.kind, a.ref, a["at"], a.tokens) for a in first.attachments] == [("image", "a.png", 1, 3), ("audio", "b.wav", 2, 50), ("document", "c|>.pdf", 3, 3072)]
    assert second.fragment == "<|turn|>assistant<|content|><|end|>" and second.start == len(first.fragment)
    assert (second.loss_start, second.loss_end) == (second.start + 28,) * 2 and first.loss_start is None
