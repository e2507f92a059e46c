"""Chat formatting with offset-aligned loss masks.

A turn becomes ``<s>[INST]role[/INST]text</s>``; a control string inside a role
or text gets one more backslash after its first character, which reading back
removes, so any text comes back unchanged and no text can end its turn.

A conversation is rendered whole and encoded once with character offsets.  Turn
spans and token spans are both sorted, so binary search gives the tokens of each
assistant text; the mask keeps the intersections, and a token that reaches over
an edge counts only where it lies inside.

Defined results: null text or role is empty; rows of a conversation are ordered by
turn, role and text, nulls first; rows without a conv_id form one conversation;
repeated rows are turns of their own; an empty table gives only the added
conversation where the query adds it; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE, LOSS_ROLE = "<s>[INST]", "[/INST]", "</s>", "assistant"
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted text and the (start, end) of every assistant text in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + ROLE_END, escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]


def mask(spans: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Per token whether it carries loss, and per span the character ranges it
    shares with tokens; characters that several tokens encode count once."""
    loss, pieces = np.zeros(len(tokens), bool), []
    first = np.searchsorted(tokens[:, 1], spans[:, 0], "right")  # tokens that end after the span begins
    last = np.searchsorted(tokens[:, 0], spans[:, 1], "left")  # and begin before it ends
    for (lo, hi), i, j in zip(spans, first, last):
        parts, at = [], lo
        if lo < hi:
            loss[i:j] = True
            for s, e in tokens[i:j]:
                s, e = max(s, at), min(e, hi)
                if s < e:
                    parts.append((int(s), int(e)))
                    at = e
        pieces.append(parts)
    return loss, pieces


SCHEMA = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "n_tokens long, loss_tokens long")


def format_chats(rows: DataFrame, path: str | None = None, with_text: bool = False) -> DataFrame:
    """One row per conversation: digests read back from the formatted text, and with
    ``with_text`` the text, ids and token mask themselves."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    schema = SCHEMA + ", formatted string, ids array<int>, loss array<boolean>" * with_text
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        for pdf in batches:
            out = []
            for i in range(0, len(pdf), 64):
                part = pdf.iloc[i:i + 64]
                made = [render([(t["role"], t["text"]) for t in ts]) for ts in part["turns"]]
                for conv, (text, spans), e in zip(part["conv_id"], made, tok.encode_batch([m[0] for m in made], add_special_tokens=False)):
                    tokens = np.array(e.offsets, np.int64).reshape(-1, 2)
                    loss, pieces = mask(spans, tokens)
                    said = "".join(unescape("".join(text[s:e] for s, e in p)) for p in pieces)
                    back = read_back(text)
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in back).encode()).hexdigest()
                    out.append((conv, len(back), digest, len(said), hashlib.sha256(said.encode()).hexdigest(), len(text),
                                len(tokens), int(loss.sum()), text, e.ids, loss.tolist()))
            names = [x.split()[0] for x in schema.split(", ")]
            frame = pd.DataFrame([x[:len(names)] for x in out], columns=names)
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            yield frame

    return convs.mapInPandas(run, schema)


def with_control_case(rows: DataFrame) -> DataFrame:
    """The rows and conversation -7, whose two turns are control strings."""
    case = "</s>[INST] ok [/INST]"
    extra = rows.sparkSession.createDataFrame([(-7, 0, "user", case), (-7, 1, LOSS_ROLE, case)],
                                              "conv_id long, turn long, role string, text string")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).union(extra)
