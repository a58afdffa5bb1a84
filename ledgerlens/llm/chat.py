"""Chat formatting at the level of tokens.

Each turn becomes `<|im_start|>` role `\\n` content `<|im_end|>` `\\n`. The segments (role line, content,
closing newline) are encoded separately with the byte-level BPE tokenizer, and the two markers are
reserved ids past its vocabulary spliced between them, so a marker's string inside a text can never
become a marker. Texts are escaped before encoding so that the formatted string is unambiguous too:
a backslash is doubled and `<|` becomes `<\\|` (in roles a newline also becomes `\\n`); `unescape`
reverses it exactly.

Turns are encoded row by row, with no grouping. A conversation's token offsets and loss-mask ranges
then come from prefix sums of the turns' token counts, a running window per conversation that
streams through its rows, so a conversation of very many turns needs no task memory of its size.

Defined results: rows are ordered by turn, nulls first, ties by role then text; a null role or text
is empty; an empty text has no content tokens; long texts are encoded whole; repeated rows are
separate turns; a null conv_id is a conversation of its own; columns other than conv_id, turn, role
and text are dropped, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.align import default_paths, ranks_a, spelled, tokenizer_a

# The markers of a turn.
START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"

TURNS = "conv_id long, pos long, role string, head array<int>, content array<int>, tail array<int>"
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    out = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return out.replace("\n", "\\n") if role else out


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m.group(1) == "n" else m.group(1), text)


def reserved(path: str) -> tuple[int, int]:
    """The ids of the two markers: the first two past the tokenizer's vocabulary."""
    tok, _ = tokenizer_a(path)
    n = tok.get_vocab_size(with_added_tokens=True)
    return n, n + 1


def encode_turns(turns: DataFrame, path: str | None = None) -> DataFrame:
    """Per turn row: conv_id, pos (its place, from 0), role, and token ids of head, content and tail.

    head = START + role line, content = the text, tail = END + newline.
    """
    path = path or default_paths()[0]
    w = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("pos", F.row_number().over(w) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fast = ranks_a(path)  # the same ids as the tokenizer's own encoder, faster
        start, end = reserved(path)
        newline = fast.encode_ordinary("\n")
        for pdf in batches:
            heads = [fast.encode_ordinary(escape(r, role=True) + "\n") for r in pdf["role"]]
            bodies = [fast.encode_ordinary(escape(t)) for t in pdf["text"]]
            yield pd.DataFrame({
                "conv_id": pdf["conv_id"], "pos": pdf["pos"], "role": pdf["role"],
                "head": [[start, *h] for h in heads], "content": bodies,
                "tail": [[end, *newline]] * len(pdf),
            })

    return rows.select("conv_id", "pos", "role", "text").mapInPandas(run, TURNS)


def assemble(encoded: DataFrame) -> DataFrame:
    """Token offsets and loss ranges by prefix sums: `offset` of each turn in its conversation, and
    `loss_start`, `loss_end` (end exclusive) of its content when the role is the assistant's, else equal."""
    n = F.size("head") + F.size("content") + F.size("tail")
    w = W.partitionBy("conv_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    placed = encoded.withColumn("n_tokens", n.cast("long")).withColumn("offset", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).cast("long"))
    begin = F.col("offset") + F.size("head")
    on = F.col("role") == LOSS_ROLE
    return placed.select(
        "*", begin.cast("long").alias("loss_start"),
        F.when(on, begin + F.size("content")).otherwise(begin).cast("long").alias("loss_end"),
    )


def format_chats(turns: DataFrame, path: str | None = None) -> DataFrame:
    """One row per turn: conv_id, pos, offset, n_tokens, ids (the turn's tokens), loss_start, loss_end."""
    out = assemble(encode_turns(turns, path))
    return out.select("conv_id", "pos", "offset", "n_tokens", F.concat("head", "content", "tail").alias("ids"),
                      "loss_start", "loss_end")


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """Decode each written turn: conv_id, pos, role, text (unescaped), formatted (the turn's string with
    markers) and loss_text (decoded tokens under the loss mask, unescaped)."""
    path = path or default_paths()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, table = tokenizer_a(path)
        start, end = reserved(path)

        def text_of(ids) -> str:
            return spelled(np.asarray(ids, np.int64), table).tobytes().decode("utf-8", "replace") if len(ids) else ""

        def decode(ids) -> str:
            ids = np.asarray(ids, np.int64)
            marks = np.flatnonzero((ids == start) | (ids == end))
            out, at = [], 0
            for m in marks.tolist():
                out.append(text_of(ids[at:m]))
                out.append(START if ids[m] == start else END)
                at = m + 1
            out.append(text_of(ids[at:]))
            return "".join(out)

        for pdf in batches:
            roles, texts, whole, loss = [], [], [], []
            for ids, off, a, b in zip(pdf["ids"], pdf["offset"], pdf["loss_start"], pdf["loss_end"]):
                s = decode(ids)
                head, rest = s[len(START):].split("\n", 1)
                roles.append(unescape(head))
                texts.append(unescape(rest[: rest.index(END)]))
                whole.append(s)
                loss.append(unescape(text_of(ids[a - off : b - off])) if b > a else "")
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "pos": pdf["pos"], "role": roles, "text": texts,
                                "formatted": whole, "loss_text": loss})

    schema = "conv_id long, pos long, role string, text string, formatted string, loss_text string"
    return formatted.select("conv_id", "pos", "ids", "offset", "loss_start", "loss_end").mapInPandas(run, schema)
