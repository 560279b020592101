"""Chat formatting with offset-aligned loss masks.

A conversation is rendered once, encoded once with character offsets, and a token belongs to
the loss when its span meets an assistant turn's text, found by binary search in the sorted
turn spans. Markers are special tokens and cannot occur in an escaped text, so no token
crosses the edge of a turn.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import small_batches

# The template's markers.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Vocabulary of the public tokenizer; another path may be given.
DEFAULT_TOKENIZER = "byte_bpe_50k.json"
SCHEMA = "conv_id long, n_turns long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    """No ``<|`` is left: one more backslash goes between ``<``, any backslashes and ``|``."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``render`` was given."""
    return [(unescape(role), unescape(text)) for part in formatted.split(END)[:-1] for role, _, text in [part[len(TURN) :].partition(TEXT)]]


def load_tokenizer(path: str | None):
    import json

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(DEFAULT_TOKENIZER)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["post_processor"] = None  # it would trim white space from offsets
    tokenizer = Tokenizer.from_str(json.dumps(spec))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    tokenizer.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
    return tokenizer


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each token span meets one of the sorted, disjoint spans, by binary search."""
    if not len(spans):
        return np.zeros(len(starts), dtype=bool)
    k = np.searchsorted(spans[:, 0], np.maximum(starts, ends - 1), side="right") - 1
    return (k >= 0) & (spans[np.maximum(k, 0), 1] > starts)


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The characters under the mask, each once and in order (tokens of one character may share its span)."""
    a, b = starts[mask], ends[mask]
    if not len(a):
        return ""
    upto = np.maximum.accumulate(b)
    first = np.flatnonzero(np.append(True, a[1:] > upto[:-1]))
    last = np.append(first[1:] - 1, len(a) - 1)
    return "".join(unescape(formatted[x:y]) for x, y in zip(a[first].tolist(), upto[last].tolist(), strict=True))


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts), kind))


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple = ("assistant",), tokenizer_path: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, token ids with their spans, loss mask.

    Rows are ordered by turn, ties by role and text, nulls first; null role or text is empty;
    null conv_id is a conversation of its own; repeated rows are repeated turns. Other columns
    are ignored. A conversation is rendered and encoded as a whole, so one task holds one
    conversation at a time: its size is the bound. An empty table gives no rows.
    """
    small_batches(conversations.sparkSession)
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("row"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sizes, flat = pc.list_value_length(part.column(1)).to_pylist(), pc.list_flatten(part.column(1))
                turns = iter(zip(flat.field("role").to_pylist(), flat.field("text").to_pylist(), strict=True))
                texts, wanted = [], []
                for n in sizes:
                    rows = [(role or "", text or "") for role, text in islice(turns, n)]
                    formatted, spans = render(rows)
                    texts.append(formatted)
                    wanted.append(np.array([s for s, (role, _) in zip(spans, rows, strict=True) if role in loss_roles and s[1] > s[0]], np.int64).reshape(-1, 2))
                ids, starts, ends, masks = [], [], [], []
                for e, spans in zip(tokenizer.encode_batch(texts, add_special_tokens=False), wanted, strict=True):
                    offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                    ids.append(np.array(e.ids, np.int64))
                    starts.append(offsets[:, 0])
                    ends.append(offsets[:, 1])
                    masks.append(loss_mask(offsets[:, 0], offsets[:, 1], spans))
                numbers = [list_column(x, pa.int32()) for x in (ids, starts, ends)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(texts, pa.string()), *numbers, list_column(masks, pa.bool_())], names=["conv_id", "n_turns", "formatted", "token_ids", "token_starts", "token_ends", "loss_mask"])

    return grouped.select(F.col("conv_id").cast("long").alias("conv_id"), "rows").mapInArrow(encode, SCHEMA)


def digest_chats(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output, a row for each of its rows: hashes of turns and of the text under the mask.

    A conversation without loss has the hash of an empty text; an empty table gives no rows.
    """

    @F.pandas_udf("turns_sha256 string, loss_chars long, loss_sha256 string")
    def digest(text: pd.Series, starts: pd.Series, ends: pd.Series, mask: pd.Series) -> pd.DataFrame:
        out = []
        for t, a, b, m in zip(text, starts, ends, mask, strict=True):
            loss = masked_texts(t, np.asarray(a), np.asarray(b), np.asarray(m, dtype=bool))
            turns = "".join(f"{role}\n{said}\n" for role, said in parse(t))
            out.append((hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
        return pd.DataFrame(out, columns=["turns_sha256", "loss_chars", "loss_sha256"])

    rows = formatted.withColumn("d", digest("formatted", "token_starts", "token_ends", "loss_mask"))
    return rows.select("conv_id", "n_turns", "d.*", F.length("formatted").cast("long").alias("formatted_chars"))
