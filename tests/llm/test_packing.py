import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fastenlake.llm import packing as pk

PATH = public_tokenizers.path("word_bpe_49k.json")


def bins_of_best_fit(counts, size):
    capacities, n = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            i = bisect.bisect_left(capacities, length)
            n, c = (n + 1, size) if i == len(capacities) else (n, capacities.pop(i))
            if c > length:
                bisect.insort(capacities, c - length)
    return n


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    size = r.choice([10, 37, 100, 4096])
    counts = {r.randrange(1, size + 1): r.randrange(1, r.choice([3, 50, 1000])) for _ in range(r.randrange(1, 60))}
    steps, bins, ranks = pk.plan(counts, size), {}, {}
    for s in steps:
        ranks.setdefault(s.length, []).append((s.rank, s.bins))
        for i in range(s.bins):
            bins.setdefault(s.first + i, []).append((s.offset, s.length))
    for length, c in counts.items():
        at = 0
        for a, n in sorted(ranks[length]):
            assert a == at
            at += n
        assert at == c
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= size
    assert len(bins) == bins_of_best_fit(counts, size)


def test_tree_finds_the_tightest():
    r, tree, held = random.Random(1), pk.CapacityTree(50), set()
    for _ in range(500):
        c = r.randrange(51)
        (held.remove if c in held else held.add)(c)
        tree.put(c, c in held)
        least = r.randrange(51)
        assert tree.tightest(least) == min((x for x in held if x >= least), default=None)


TEXTS = ["", None, "Hello, World's  end ", "á é x", "<|endoftext|>y <|startoftext|>", "ΑΣ ΣΑΣ İ", "word " * 5000, "ab\x1ccd\x85ef", "x" * 200, "can't won't I'm 12345"]


@pytest.mark.parametrize("table", [False, True])
def test_packed_covers_every_piece_with_the_tokenizers_ids(spark, monkeypatch, table):
    if table:
        monkeypatch.setattr(pk, "BROADCAST_PLAN", 0)
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(0, ""), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rank": F.lit("x"), "length": F.lit("y")})
    got = pk.packed(df, PATH, 64, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 64)):
            raw = np.array(ids[at : at + 64], "<u4").tobytes()
            want.append((i, k, at, len(raw) // 4, zlib.crc32(raw), raw))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    counts = {}
    for w in want:
        counts[w[3]] = counts.get(w[3], 0) + 1
    assert len(bins) == bins_of_best_fit(counts, 64)


def test_words_give_the_tokenizers_ids():
    r, known, tokenizer = random.Random(3), pk.Memo(PATH), Tokenizer.from_file(PATH)
    assert known.simple
    for _ in range(3000):
        word = "".join(r.choice(["th", "Er", "É", "ß", "'s", "'", "-", "9", ".", "_", "Σ", "i", "<|", "ñ", "ÿ", "e\u0301"]) for _ in range(r.randrange(1, 7)))
        assert known[word.encode()] == np.array(tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes(), word


def test_packed_empty_table(spark):
    assert pk.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
