"""Chat formatting: turns of typed parts become marked, reversible text with a loss mask.

A turn is `<|turn|>role<|content|>content<|end|>`. Inside roles and texts a backslash is doubled
and one is put into every control string, so that a control string stands only where the
template or a placeholder puts it. `unescape` undoes this exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Control strings of common chat templates and of this one (fixed values): after "<" and after "[".
ANGLE, SQUARE = r"<(\||/?s>|</?SYS>>)", r"\[(/?INST\])"
TURN, CONTENT, END = "<|turn|>", "<|content|>", "<|end|>"
LOSS_ROLES = ("assistant",)
PATCH, TOKENS_A_SECOND, TOKENS_A_PAGE = 28, 25, 1024
FORMATTED = "conv_id bigint, position bigint, start bigint, fragment string, loss_start bigint, loss_end bigint, attachments array<struct<kind string, ref string, at bigint, tokens bigint>>"
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
PARTS = T.ArrayType(
    T.StructType(
        [T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in ("width", "height", "seconds", "pages")]
    )
)


def escape(text: Column) -> Column:
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(text, ANGLE, r"<\\$1"), SQUARE, r"[\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _unknown(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text"))


def _tokens(part: Column) -> Column:
    """Tokens that a model expands the placeholder of an attachment to; sizes that miss count as one unit."""
    unit = F.lit(1.0)
    image = F.ceil(F.coalesce(part["width"], unit) / PATCH) * F.ceil(F.coalesce(part["height"], unit) / PATCH)
    audio = F.ceil(F.coalesce(part["seconds"], unit) * TOKENS_A_SECOND)
    pages = F.ceil(F.coalesce(part["pages"], unit)) * TOKENS_A_PAGE
    kind = _unknown(part)
    return F.when(kind == "image", image).when(kind == "audio", audio).when(kind == "document", pages).otherwise(F.lit(0)).cast("bigint")


def _visit(part: Column) -> Column:
    """Text of a part: its escaped text, or the placeholder of an attachment."""
    kind = _unknown(part)
    place = F.concat(F.lit("<|"), kind, F.lit(":"), escape(part["ref"]), F.lit("|>"))
    return F.when(kind.isin("image", "audio", "document"), place).otherwise(escape(part["text"]))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    fields = [F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref")]
    return F.array(F.struct(*fields, *[F.lit(None).cast("double").alias(c) for c in ("width", "height", "seconds", "pages")]))


def _assemble(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Positions and offsets of sorted turns; only the running conversation's counts are kept."""
    current, position, start = object(), 0, 0
    for frame in frames:
        out = []
        for conv, fragment, head, loss, attachments in zip(frame["conv_id"], frame["fragment"], frame["head"], frame["loss"], frame["attachments"]):
            if conv != current:
                current, position, start = conv, 0, 0
            a, b = (start + head, start + len(fragment) - len(END)) if loss else (None, None)
            out.append((None if conv is None else int(conv), position, start, fragment, a, b, attachments))
            position, start = position + 1, start + len(fragment)
        table = pd.DataFrame(out, columns=["conv_id", "position", "start", "fragment", "loss_start", "loss_end", "attachments"])
        yield table.astype({c: "Int64" for c in ("conv_id", "loss_start", "loss_end")})


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """One row per turn of (conv_id, turn, role, parts): its formatted text, where it starts in the
    conversation, the loss mask and the attachments, all in code points from the conversation's start.

    `parts` is a list as `text_parts` makes it; null parts and texts are empty, parts of unknown type
    count as texts, a null role is the empty role. Turns are ordered by turn, role and text, nulls
    first, and repeated rows stay. Rows without conv_id are one conversation. A conversation is a
    sequence, so one task reads it, as a stream: memory holds a batch of turns at a time. An empty
    table gives no rows; other columns are not looked at.
    """
    parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    head = F.concat(F.lit(TURN), escape(role), F.lit(CONTENT))
    body = F.array_join(F.transform("known", _visit), "")
    shown = F.concat(head, F.col("body"), F.lit(END))
    is_place = lambda p: _unknown(p).isin("image", "audio", "document")
    listed = F.transform(
        F.filter(F.transform("known", lambda p, i: F.struct(_unknown(p).alias("kind"), p["ref"].alias("ref"), i.cast("bigint").alias("at"), _tokens(p).alias("tokens"), is_place(p).alias("place"))), lambda x: x["place"]),
        lambda x: F.struct(x["kind"], x["ref"], x["at"], x["tokens"]),
    )
    flat = (
        turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), parts.alias("known"))
        .withColumn("known", F.filter("known", lambda p: p.isNotNull()))
        .withColumn("body", body)
        .select("conv_id", "turn", "role", "body", shown.alias("fragment"), F.length(head).alias("head"), F.col("role").isin(*loss_roles).alias("loss"), listed.alias("attachments"))
    )
    ordered = flat.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "body").drop("turn", "role", "body")
    # ids travel as texts, since pandas would make numbers next to nulls floating
    return ordered.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(_assemble, FORMATTED)


def parse_turn(fragment: str) -> tuple[str, str]:
    """Role and text of a formatted turn, unescaped; placeholders stay."""
    role, content = fragment[len(TURN) : -len(END)].split(CONTENT, 1)
    return unescape(role), unescape(content)


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, state, first = None, None, True

    def close():
        return (current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    columns = [c.split()[0] for c in DIGESTS.split(", ")]
    for frame in frames:
        out = []
        for conv, position, start, fragment, a, b in zip(*(frame[c] for c in ("conv_id", "position", "start", "fragment", "loss_start", "loss_end"))):
            if position == 0:
                if not first:
                    out.append(close())
                current, first = (None if conv is None else int(conv)), False
                state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse_turn(fragment)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if not pd.isna(a):
                masked = unescape(fragment[int(a) - start : int(b) - start])
                state[2] += len(masked)
                state[3].update(masked.encode())
            state[4] = start + len(fragment)
        yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})
    if not first:
        yield pd.DataFrame([close()], columns=columns).astype({"conv_id": "Int64"})


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation of `format_chats`: counts and digests of what its output says.

    It follows `format_chats` directly, whose rows of a conversation lie together in order.
    """
    return formatted.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(_digest, DIGESTS)
