"""Best-fit decreasing packing of tokenised documents.

1. ``tokenised``: every document once through the tokenizer; only documents longer
   than a sequence are cut.  Words between ASCII white space are encoded one by
   one and remembered, which gives the tokenizer's ids for the whole text: its
   pre-tokens never span white space.
2. The pieces' lengths are counted (at most MAX_TOKENS rows, whatever the input).
3. ``plan``: best-fit decreasing over these counts.  Open bins with the same
   remaining capacity are alike and kept as runs of bin numbers; a segment tree
   over remaining capacities gives the tightest that fits in logarithmic time.
   All documents of one length that meet the same run are placed by one step, so
   the plan grows with the number of lengths and not of documents.
4. ``packed``: a piece's rank among its equals (bucket counts summed up, then a
   row number in its bucket, so that no length meets in one task) is looked up in
   the plan, which is broadcast: its size is checked, and beyond it is joined.

Defined cases: null text counts as empty and has only the closing id; equal
lengths are ranked by bucket, doc_id and piece; a repeated row is packed again; a null
doc_id packs like any other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MAX_TOKENS = 4096
CLOSING_ID = 1
#: Distinct words, and distinct parts of words, remembered by a Python worker; about 150 bytes each.
MEMO = 250_000
#: Rows of the plan that are broadcast, 40 bytes each.
BROADCAST_PLAN = 2_000_000


class Step(NamedTuple):
    """Pieces of one length ranked from `rank` go, one each, to the `bins` bins from `first`, at `offset`."""

    length: int
    rank: int
    bins: int
    first: int
    offset: int


class CapacityTree:
    """Segment tree over remaining capacities 0..size: which have open bins."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.any = np.zeros(2 * self.width, bool)

    def put(self, capacity: int, some: bool) -> None:
        i = capacity + self.width
        self.any[i] = some
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that has an open bin."""
        i = least + self.width
        if i >= 2 * self.width:
            return None
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return None


def plan(counts: dict[int, int], size: int = MAX_TOKENS) -> list[Step]:
    """Best-fit decreasing for counts[length] pieces of each length from 1 to size."""
    tree, runs, steps, used = CapacityTree(size), [[] for _ in range(size + 1)], [], 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = size
                first, bins = used, max(1, left // (size // length))
                used += bins
            else:
                first, bins = runs[capacity].pop()
                tree.put(capacity, bool(runs[capacity]))
            # a bin just filled is the tightest until no more fits: whole bins one after another, then the rest in one
            each = min(capacity // length, left)
            whole = min(bins, left // each)
            steps += [Step(length, rank + k * whole, whole, first, size - capacity + k * length) for k in range(each)]
            rank, left = rank + each * whole, left - each * whole
            for spare, at, n in ((capacity - each * length, first, whole), (capacity, first + whole, bins - whole)):
                if spare and n:
                    runs[spare].append((at, n))
                    tree.put(spare, True)
    return steps


_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_SIMPLE = re.compile(rf"([{_LETTERS}]+)([!-/:-@\[-`{{-~]*)")


class Memo(dict):
    """word in UTF-8 -> its ids as little-endian 32-bit numbers.

    A word of Latin-1 letters with ASCII punctuation behind needs no normaliser or
    pre-tokenizer run if these split it there and lower its letters, which is probed
    when a tokenizer is loaded: its two parts go straight to the tokenizer's model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {c: spell.pre_tokenize_str(chr(c))[0][0] for c in range(128, 256)}
        self.parts: dict[str, bytes] = {}
        rng = random.Random(0)
        letters = [c for c in map(chr, range(256)) if re.fullmatch(f"[{_LETTERS}]", c)]
        probes = ["".join(rng.choices(letters, k=rng.randrange(1, 9))) + "".join(rng.choices("!'.,<|>_`~(", k=rng.randrange(3))) for _ in range(300)]
        self.simple = all(self.direct(_SIMPLE.fullmatch(w)) == self.whole(w) for w in probes)

    def whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            spelled = part if part.isascii() else part.translate(self.spelling)
            found = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            if len(self.parts) >= MEMO:
                self.parts.clear()
            self.parts[part] = found
        return found

    def direct(self, m: re.Match) -> bytes:
        return self.part(m[1].lower()) + (self.part(m[2]) if m[2] else b"")

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        m = _SIMPLE.fullmatch(text) if self.simple and len(word) <= 64 else None
        found = self.direct(m) if m else self.whole(text)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = found
        return found


_memo: dict[str, Memo] = {}


def memo(path: str) -> Memo:
    if path not in _memo:
        _memo[path] = Memo(path)
    return _memo[path]


def ids_bytes(text: bytes | None, known: Memo) -> bytes:
    """The text's ids and the closing id, four bytes each."""
    return b"".join(map(known.__getitem__, (text or b"").split())) + CLOSING_ID.to_bytes(4, "little")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised(docs: DataFrame, path: str, size: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most `size` ids; with_ids adds them (binary, 32-bit little-endian)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memo(path)
        for b in batches:
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = memoryview(ids_bytes(text, known))
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    for col, v in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([bytes(part)] if with_ids else [])), strict=True):
                        col.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    schema = PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, schema)


def _ranked(pieces: DataFrame, total: int) -> DataFrame:
    """pieces with rank: 0, 1, ... among those of one length."""
    buckets = max(1, math.isqrt(total))  # as many buckets of a length as pieces in a bucket, at most
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).select("length", "bucket", "before")
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    return dealt.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside")).drop("bucket", "before", "inside")


def _placed(ranked: DataFrame, steps: list[Step]) -> DataFrame:
    spark = ranked.sparkSession
    if len(steps) > BROADCAST_PLAN:
        table = spark.createDataFrame(pd.DataFrame(steps, columns=["length", "rank0", "bins", "first", "offset"]))
        met = ranked.join(table, (ranked["length"] == table["length"]) & (ranked["rank"] >= table["rank0"]) & (ranked["rank"] < table["rank0"] + table["bins"]))
        return met.select(*[ranked[c] for c in ranked.columns if c != "rank"], (F.col("first") + F.col("rank") - F.col("rank0")).alias("sequence_id"), "offset")
    ordered = sorted(steps)
    held = spark.sparkContext.broadcast(np.array(ordered, np.int64).reshape(-1, 5))
    names = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        start = np.searchsorted(s[:, 0], np.arange(s[-1, 0] + 2 if len(s) else 1))
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            low, high = start[length], start[length + 1]  # the last step of that length that begins at or before rank
            while (low + 1 < high).any():
                mid = (low + high) // 2
                right = (s[np.minimum(mid, len(s) - 1), 1] <= rank) & (mid < high)
                low, high = np.where(right, mid, low), np.where(right, high, np.maximum(mid, low + 1))
            out = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(s[low, 3] + rank - s[low, 1]), pa.array(s[low, 4])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {t}" for c, t in ranked.dtypes if c != "rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def packed(docs: DataFrame, path: str, size: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it lies in which sequence of at most `size` tokens."""
    pieces = stored(tokenised(docs, path, size, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # size rows at most
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    return _placed(_ranked(pieces, sum(counts.values())), plan(counts, size))
