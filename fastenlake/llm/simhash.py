"""SimHash near-duplicates with a Gray-order hierarchical Hamming index.

Fingerprints: see ``fingerprint``.  Linking all pairs of at most MAX_BITS
differing bits runs over *distinct* fingerprints only:

1. A pair within 3 bits agrees on one of four 16-bit blocks, so each fingerprint
   goes to four buckets (block number, block value).  A bucket with more than
   HOT_BUCKET entries is dealt out again by four 12-bit blocks of its other 48
   bits, and what is still too large by four 9-bit blocks of the 36 left, which loses
   no pair either.
2. Inside a bucket fingerprints are sorted by Gray rank.  Runs of FAN neighbours
   form a node, runs of FAN nodes the next level.  A node keeps the masked bit
   pattern that all below it share and its parent doesn't.  A query walks down
   with the accumulated count of differing bits: a node over MAX_BITS is dropped
   as a whole; one that can't exceed MAX_BITS is linked as a whole, by a range.
3. A bucket gives, for each fingerprint, one link to the least one it reaches
   there: a spanning star instead of all pairs.  Components join the buckets.

Defined cases: null or blank text has fingerprint zero, which links like any
other; repeated rows each get a row; a null doc_id counts behind all others;
extra columns are ignored; an empty table gives no rows; a long text is hashed in
blocks, with its words held whole by one task.  ``simhash_dedup`` judges rows by
(doc_id, text): of each group the rows of the least doc_id stay (also several rows or
texts of that doc_id), null doc_ids only in a group without any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components

SHINGLE, SEED, MAX_BITS = 3, 42, 3
FAN = 8
#: Bits of a block, each of four, that a bucket is dealt by
BLOCKS = (16, 12, 9)
HOT_BUCKET = 1 << 16
#: The most keys of dropped rows that are broadcast (about 32 bytes each); beyond, a shuffle join.
BROADCAST_KEYS = 1_000_000
#: Query-node pairs held at once while an index is walked.
FRONTIER = 1 << 20


def _hashes(words: list[bytes]) -> list[int]:
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return [digest(b" ".join(words), SEED)]
    return [digest(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:], strict=False)]


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit fingerprint of a text in UTF-8: XXH64 of each 3-word shingle
    (repeats count); a bit is set where over half the hashes have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n, ones = 0, np.zeros(64, np.int64)
    for i in range(0, max(1, len(words) - SHINGLE + 1), 1 << 16):  # long texts in blocks
        part = np.array(_hashes(words[i : i + (1 << 16) + SHINGLE - 1]), np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
        n += len(part)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((fingerprint(t) for t in b.column(3).to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(found.view(np.int64))], ["doc_id", "t1", "t2", "fp"])


def text_key() -> list[Column]:
    """Two hashes that stand for a text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2 (text key), fp (the fingerprint's 64 bits as a long)."""
    return docs.select(F.col("doc_id").cast("long"), *text_key(), F.col("text").cast("binary")).mapInArrow(_fingerprints, "doc_id long, t1 long, t2 long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Groups of sorted fingerprints, each under its own hierarchy; see above."""

    def __init__(self, group: np.ndarray, value: np.ndarray):
        """group: ascending numbers; value: uint64, by Gray rank in each group."""
        self.n = len(value)
        size = np.bincount(np.unique(group, return_inverse=True)[1]) if self.n else np.zeros(0, int)
        zero = np.zeros(self.n, np.uint64)
        #: per level, from the leaves: pattern, shared mask, first and end child (leaves: themselves), group sizes
        self.levels = [(value, ~zero, np.arange(self.n), np.arange(self.n) + 1)]
        self.leaf_span = [(np.arange(self.n), np.arange(self.n) + 1)]
        while len(size) and size.max() > 1:
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            up = -(-size // FAN)
            first = np.repeat(start, up) + FAN * (np.arange(up.sum()) - np.repeat(np.cumsum(up) - up, up))
            end = np.minimum(first + FAN, np.repeat(start + size, up))
            pattern, mask, _, _ = self.levels[-1]
            every, some = np.bitwise_and.reduceat(pattern, first), np.bitwise_or.reduceat(pattern, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(every ^ some)
            self.levels.append((every & shared, shared, first, end))
            low, high = self.leaf_span[-1]
            self.leaf_span.append((low[first], high[end - 1]))
            size = up
        self.root = np.repeat(np.arange(len(size)), self._leaves_per_root()) if self.n else np.zeros(0, int)

    def _leaves_per_root(self) -> np.ndarray:
        low, high = self.leaf_span[-1]
        return high - low

    def roots(self, most: int = MAX_BITS) -> np.ndarray:
        """For each leaf the least leaf that pairs of at most `most` differing bits lead to."""
        a, b, edges = [], [], 0
        root, whole = np.arange(self.n), np.zeros(self.n + 1, bool)  # whole[i]: leaf i is tied to leaf i + 1
        value, top = self.levels[0][0], len(self.levels) - 1
        queries = np.arange(self.n)
        stack = [(top, queries, self.root, np.zeros(self.n, np.int64), np.zeros(self.n, np.uint64))]
        while stack:
            level, who, node, acc, seen = stack.pop()
            if len(who) > FRONTIER:
                half = len(who) // 2
                stack += [(level, *(x[part] for x in (who, node, acc, seen))) for part in (slice(half), slice(half, None))]
                continue
            pattern, mask, first, end = self.levels[level]
            acc = acc + np.bitwise_count((value[who] ^ pattern[node]) & mask[node] & ~seen)  # bits factored out above count once
            low, high = (x[node] for x in self.leaf_span[level])
            near = (acc <= most) & (high - 1 > who)  # each pair once: a leaf behind the query
            who, node, acc, low, high = who[near], node[near], acc[near], low[near], high[near]
            sure = acc + np.bitwise_count(~mask[node]) <= most
            a.append(who[sure])
            b.append(low[sure])
            edges += len(a[-1])
            if level:
                for x, y in {*zip(low[sure].tolist(), high[sure].tolist(), strict=True)}:
                    whole[x : y - 1] = True
                who, node, acc = who[~sure], node[~sure], acc[~sure]
                many = end[node] - first[node]
                child = np.repeat(first[node] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                # children in the order of their parents; in pieces, so that the frontier stays bounded
                stack.append((level - 1, np.repeat(who, many), child, np.repeat(acc, many), np.repeat(mask[node], many)))
            if edges > FRONTIER or not stack:
                tied = np.flatnonzero(whole[: self.n])
                root = merged(root, np.concatenate([*a, tied]), np.concatenate([*b, tied + 1]))
                a, b, edges = [], [], 0
        return root


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each index's component, given roots so far and edges (a, b)."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _bucket_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, fp) to links; works on whole buckets, some at a time."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def solved(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else key
        size = np.bincount(group)[group] if len(group) else group
        many = size > 1  # a fingerprint alone in its bucket links to nothing here
        group, fp = group[many], fp[many]
        root = GrayIndex(group, fp.view(np.uint64)).roots() if len(fp) else fp
        tied = root != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[root[tied]])], schema=schema)

    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(2)))
        if held[0][0][0] == held[-1][0][-1]:
            continue  # one bucket so far
        key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
        held = [(key[cut:], fp[cut:])]
        yield solved(key[:cut], fp[:cut])
    if held:
        yield solved(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _buckets(rows: DataFrame, bits: int) -> DataFrame:
    """rows (fp, key, rest: 4 * bits of fp) to four each: key with a block's number and value, rest without it."""
    each = []
    for j in range(4):
        block = F.shiftrightunsigned("rest", bits * j).bitwiseAND((1 << bits) - 1)
        low = F.col("rest").bitwiseAND((1 << bits * j) - 1)
        upper = F.shiftleft(F.shiftrightunsigned("rest", bits * (j + 1)), bits * j) if j < 3 else F.lit(0).cast("long")
        each.append(F.struct((F.col("key") * (4 << bits) + (j << bits) + block).alias("key"), upper.bitwiseOR(low).alias("rest")))
    return rows.select("fp", F.explode(F.array(*each)).alias("b")).select("fp", "b.key", "b.rest")


def fingerprint_links(values: DataFrame) -> DataFrame:
    """values (fp: distinct longs) to links (u, v) that connect what lies within MAX_BITS."""
    rows, done = values.select("fp", F.lit(1).cast("long").alias("key"), F.col("fp").alias("rest")), []
    for bits in BLOCKS:
        each = _buckets(rows, bits)
        if bits != BLOCKS[-1]:
            hot = stored(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_BUCKET).select("key"), "hot-buckets")
        if bits == BLOCKS[-1] or hot.isEmpty():
            done.append(each)
            break
        done.append(each.join(hot, "key", "left_anti"))
        rows = each.join(hot, "key", "left_semi")
    each = reduce(DataFrame.unionByName, done)
    rank = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        each = each.withColumn("rank", rank.bitwiseXOR(F.shiftrightunsigned(rank, s)))
        rank = F.col("rank")
    top = F.lit(-(1 << 63)).cast("long")
    dealt = each.withColumn("rank", F.col("rank").bitwiseXOR(top)).repartition("key").sortWithinPartitions("key", "rank")
    return dealt.select("key", "fp").mapInArrow(_bucket_links, "u long, v long")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, fp, component_id for every row of docs."""
    prints = stored(fingerprints(docs), "fingerprints")
    values = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(values.select("fp"))).withColumnRenamed("node", "fp")
    ends = values.join(roots, "fp", "left").select("fp", "least", "root")
    joined = ends.where("root IS NOT NULL")
    component = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = joined.join(component, "root").select("fp", "component_id")
    alone = ends.where("root IS NULL").select("fp", F.col("least").alias("component_id"))
    return prints.join(linked.unionByName(alone), "fp")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable) for every row of docs."""
    return _grouped(docs).select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id isn't the least of their component."""
    lost = _grouped(docs).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = stored(lost.select(F.col("doc_id").alias("__sd_id"), F.col("t1").alias("__sd_t1"), F.col("t2").alias("__sd_t2")).distinct(), "near-copies")
    small = gone.count() <= BROADCAST_KEYS
    t1, t2 = text_key()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__sd_id")) & (t1 == F.col("__sd_t1")) & (t2 == F.col("__sd_t2"))
    return docs.join(F.broadcast(gone) if small else gone, same, "left_anti")
