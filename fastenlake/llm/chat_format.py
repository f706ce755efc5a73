"""Chat formatting with offset-aligned loss masks.

Template, per turn: ``<|im_start|>role<|im_sep|>text<|im_end|>``.  The three marks
are added to the tokenizer as special tokens, so no token spans a mark and a text.
Control strings inside roles and texts are escaped reversibly: each ``<`` +
backslashes + ``|`` gets one backslash more, so no text can hold a mark.

A conversation is rendered whole and encoded once with offsets.  Turn spans and
token spans are both sorted; each turn's tokens are found by binary search, and the
loss mask covers the tokens of the assistant texts.

Rows are dealt by conversation and sorted by turn, then streamed: a block is a
whole conversation, or, beyond BLOCK_CHARS, as many turns as fit (cut at marks,
where the tokens don't change), so a conversation of any length needs bounded
memory.  Nothing is collected per conversation.

Defined cases: null text and null role count as empty; equal turn numbers are
ordered by role, then text, and repeated rows are turns of their own; a null
conv_id is a conversation of its own; null turns come first; extra columns are
ignored; an empty table gives no rows; a single turn isn't cut: the longest one is held
whole by a task, with its tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"
BLOCK_CHARS = 1 << 20
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


@dataclass
class Block:
    """Consecutive whole turns of one conversation."""

    conv_id: int | None
    first: bool
    last: bool
    text: str
    ids: np.ndarray
    offsets: np.ndarray  # [tokens, 2], code points of text
    loss: np.ndarray  # per token

    def turns(self) -> list[tuple[str, str]]:
        """Roles and texts, read back from the rendered text."""
        return [(unescape(r), unescape(t)) for r, t in _TURN.findall(self.text)]

    def loss_texts(self) -> list[str]:
        """What lies under the mask, by turn; tokens that share a character count it once."""
        out, spans = [], self.offsets[self.loss]
        joined: list[list[int]] = []
        for a, b in spans.tolist():
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        for a, b in joined:
            out.append(unescape(self.text[a:b]))
        return out


@lru_cache(maxsize=4)
def chat_tokenizer(path: str):
    """A byte-level BPE whose offsets keep white space, with the marks added."""
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (START, SEP, END)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def encoded(conv_id: int | None, turns: list[tuple[str, str]], first: bool, last: bool, path: str) -> Block:
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        head = START + escape(role) + SEP
        parts += [head, body, END]
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    rendered = "".join(parts)
    e = chat_tokenizer(path).encode(rendered, add_special_tokens=False)
    offsets = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(e)).reshape(-1, 2)
    loss = np.zeros(len(offsets) + 1, np.int64)
    if spans:
        s = np.array(spans, np.int64)
        low = np.searchsorted(offsets[:, 0], s[:, 0])
        high = np.searchsorted(offsets[:, 0], s[:, 1])
        np.add.at(loss, low, 1)
        np.add.at(loss, high, -1)
    return Block(conv_id, first, last, rendered, np.array(e.ids, np.int64), offsets, np.cumsum(loss)[:-1] > 0)


def blocks(rows: Iterable[tuple[int | None, str, str]], path: str, most: int = BLOCK_CHARS) -> Iterator[Block]:
    """rows (conv_id, role, text) of whole conversations, in order."""
    held: list[tuple[str, str]] = []
    now, size, first = None, 0, True
    for conv, role, text in rows:
        if held and conv != now:
            yield encoded(now, held, first, True, path)
            held, size, first = [], 0, True
        elif size > most:
            yield encoded(now, held, first, False, path)
            held, size, first = [], 0, False
        now = conv
        held.append((role, text))
        size += len(role) + len(text)
    if held:
        yield encoded(now, held, first, True, path)


def _streamed(conversations: DataFrame) -> DataFrame:
    text, role = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "role"))
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", role, text)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)


def formatted(conversations: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """conv_id, block (from 0), text, ids, token_start, token_end, loss_mask."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for x in blocks(_rows(batches), path, block_chars):
            n = 0 if x.first else n + 1
            cols = [[x.conv_id], [n], [x.text], [x.ids.tolist()], [x.offsets[:, 0].tolist()], [x.offsets[:, 1].tolist()], [x.loss.tolist()]]
            kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "block", "text", "ids", "token_start", "token_end", "loss_mask"])

    schema = "conv_id long, block int, text string, ids array<long>, token_start array<long>, token_end array<long>, loss_mask array<boolean>"
    return _streamed(conversations).mapInArrow(run, schema)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def digests(found: Iterable[Block]) -> Iterator[tuple]:
    """One row of DIGEST per conversation, all read back from its blocks."""
    for x in found:
        if x.first:
            turns_hash, loss_hash, n = hashlib.sha256(), hashlib.sha256(), [0] * 5
        for role, text in x.turns():
            turns_hash.update(f"{role}\n{text}\n".encode())
            n[0] += 1
        for text in x.loss_texts():
            loss_hash.update(text.encode())
            n[1] += len(text)
        n[2] += len(x.text)
        n[3] += len(x.ids)
        n[4] += int(x.loss.sum())
        if x.last:
            yield x.conv_id, n[0], turns_hash.hexdigest(), n[1], loss_hash.hexdigest(), *n[2:]


def formatted_digests(conversations: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """DIGEST of what formatted() holds, without writing the tokens down."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in DIGEST.split(", ")]
        held: list[tuple] = []
        for row in digests(blocks(_rows(batches), path, block_chars)):
            held.append(row)
            if len(held) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return _streamed(conversations).mapInArrow(run, DIGEST)
