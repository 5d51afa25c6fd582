"""Chat formatting with typed content parts.

A visitor flattens the parts of a turn (text, image, audio, document) into one string: texts as they are, everything
else as a numbered placeholder, with a reference and the tokens it will expand to. Turns are then set between marks,
with every control string inside texts broken by a backslash, so that the output can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: What may not appear in a text as it is: the template's own marks, placeholders, and marks of common chat templates.
CONTROL = (START, BODY, END, "<|image:", "<|audio:", "<|document:", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>")
PART = "type string, text string, ref string, width int, height int, seconds double, pages int"
#: Tokens of a 28 x 28 image patch after 2 x 2 merging, of a second of audio, of a document page.
IMAGE_CELL, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512
_BREAK = "(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)"


def escape(text: Column) -> Column:
    """Backslashes doubled, and one put behind the first character of every control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), F.lit(_BREAK.replace("<", "\\<")), F.lit(r"$1\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part other than text stands for; unknown sizes count as one unit."""
    cells = F.ceil(F.coalesce(part["width"], F.lit(1)) / IMAGE_CELL) * F.ceil(F.coalesce(part["height"], F.lit(1)) / IMAGE_CELL)
    return (
        F.when(part["type"] == "image", cells)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * AUDIO_RATE))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS)
        .otherwise(0)
    ).cast("long")


def flatten_parts(parts: Column) -> tuple[Column, Column]:
    """(content, attachments) of an array of PART structs, in order.

    Content is escaped text with a placeholder ``<|type:n|>`` for the n-th attachment; attachments are structs of
    n, type, ref, tokens. Null parts, and parts of an unknown type without text, count for nothing.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<struct<{', '.join(x.replace(' ', ':') for x in PART.split(', '))}>>")), lambda p: p.isNotNull())
    media = F.filter(parts, lambda p: p["type"].isin("image", "audio", "document"))
    attached = F.transform(media, lambda p, i: F.struct(i.alias("n"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))

    def visit(acc: Column, p: Column) -> Column:
        is_media = p["type"].isin("image", "audio", "document")
        mark = F.concat(F.lit("<|"), p["type"], F.lit(":"), acc["n"].cast("string"), F.lit("|>"))
        return F.struct(F.concat(acc["s"], F.when(is_media, mark).otherwise(escape(F.coalesce(p["text"], F.lit(""))))).alias("s"), (acc["n"] + F.when(is_media, 1).otherwise(0)).alias("n"))

    return F.aggregate(parts, start, visit)["s"], attached


def text_parts(text: Column) -> Column:
    """One text part (null: empty)."""
    none = {k: F.lit(None).cast(t) for k, t in (x.split(" ") for x in PART.split(", "))}
    given = {"type": F.lit("text"), "text": F.coalesce(text, F.lit(""))}
    return F.array(F.struct(*((given.get(k, v)).alias(k) for k, v in none.items())))


def format_turns(turns: DataFrame, parts: str = "parts", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_end, attachments, expanded_tokens of every turn. No shuffle.

    ``formatted`` is <|turn|>role<|body|>content<|end|>; loss_start and loss_end (code points in it) bound the content
    if the role is one of ``loss_roles``, else both are null. Null roles are empty. Repeated rows stay rows; an empty
    table gives none; further columns are not read.
    """
    content, attached = flatten_parts(F.col(parts))
    role = escape(F.coalesce(F.col("role"), F.lit("")))
    head = F.concat(F.lit(START), role, F.lit(BODY))
    rows = turns.select("conv_id", "turn", "role", content.alias("content"), attached.alias("attachments")).withColumn("head", head)
    start = F.when(F.col("role").isin(*loss_roles), F.length("head"))
    return rows.select("conv_id", "turn", F.concat("head", "content", F.lit(END)).alias("formatted"), start.alias("loss_start"), (start + F.length("content")).alias("loss_end"), "attachments", F.coalesce(F.aggregate(F.transform("attachments", lambda a: a["tokens"]), F.lit(0).cast("long"), lambda x, y: x + y), F.lit(0).cast("long")).alias("expanded_tokens"))


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, content) of one formatted turn; placeholders stay."""
    head, body = formatted.removeprefix(START).removesuffix(END).split(BODY, 1)
    return unescape(head), unescape(body)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation from its formatted turns alone, in order of turn (ties: of formatted text).

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Turns are sorted by conversation and
    streamed through the hashes, so a conversation of any length takes constant memory.
    """
    rows = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, kind = None, None

        def row(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        def table(done: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for conv, text, start, end in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if state is None or state[0] != conv:
                    if state:
                        done.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, content = read_turn(text)
                state[1] += 1
                state[2].update(f"{role}\n{content}\n".encode())
                if start is not None:
                    masked = unescape(text[start:end])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(text)
            if done:
                yield table(done)
        if state:
            yield table([row(state)])

    return rows.mapInArrow(run, f"conv_id {rows.schema[0].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
