import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fastenlake.llm import exact_dedup as ed
from fastenlake.llm import line_dedup as ld
from fastenlake.llm import simhash as sh
from fastenlake.llm.graph import components

DOCS = "doc_id long, text string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(["ala", "bor", "ciu", "den", "Efa", "gil"]) + str(rng.randrange(50)) for _ in range(n))


def make(rng):
    long_text = words(rng, 9000)
    rows = [(i, words(rng, rng.randrange(0, 60)), f"s{i % 14}", 1) for i in range(120)]
    rows += [(200 + i, long_text + (" " * i), "s1", 2) for i in range(3)]
    rows += [(300, None, None, None), (301, "", "s2", 0), (302, " \n\t", "s2", 0), (None, "x y z", "s3", 5), (7, rows[7][1], "s7", 1)]
    return rows


def brute_exact(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    return sorted(((i, min(g)[3], len(g), i == min(g)[3], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for *_, i in g), key=str)


@pytest.mark.parametrize("identify", [ed.chunk_id, lambda c: F.length(c).cast("long")])
def test_exact_dedup_matches_brute_force_also_when_identifiers_collide(spark, identify):
    rows = make(random.Random(1))
    got = ed.exact_dedup(spark.createDataFrame(rows, DOCS).withColumn("keep_id", F.lit("clash")), identify)
    assert sorted(map(tuple, got.collect()), key=str) == brute_exact(rows)


def test_exact_dedup_empty_table(spark):
    assert ed.exact_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_chunks_give_back_the_text_and_are_bounded(spark):
    text = words(random.Random(2), 5000).replace(" ", "") + "ß" * 10000
    got = spark.createDataFrame([(text,)], "t string").select(ed.chunks(F.col("t"))).first()[0]
    assert "".join(got) == text and max(map(len, got)) <= ed.MAX_CHUNK + ed.ANCHOR_RUN and len(got) > 20


@pytest.mark.parametrize("most", [ld.BROADCAST_PLACES, -1])
def test_line_dedup_keeps_first_and_counts_sites_exactly(spark, monkeypatch, most):
    monkeypatch.setattr(ld, "BROADCAST_PLACES", most)
    rows = [(i, f"own {i}\n common line \n\nnine" if i < 9 else f"own {i}\ncommon line", f"s{i}", i) for i in range(12)]
    rows += [(50, "twice\ntwice", "s1", 0), (51, None, None, None), (52, "common line\ncommon line", None, 1)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"h1": F.lit("x"), "pos": F.lit("y"), "gone": F.lit(1), "row": F.lit(2), "a.b": F.lit(3), "n_lines": F.lit("z")})
    got = {r["doc_id"]: r["text"] for r in ld.line_dedup(df, min_sites=10).collect()}
    want = {i: f"own {i}\n\nnine" if i < 9 else f"own {i}" for i in range(12)} | {50: "twice\ntwice", 51: "", 52: ""}
    want[0] = rows[0][1]
    assert got == want  # "nine" stands on nine sites only
    assert {r["doc_id"]: r["text"] for r in ld.line_dedup(df).collect()} == {i: t.removesuffix("\nnine") if i else t for i, t in want.items()}
    assert ld.line_dedup(df).columns == df.columns
    assert ld.line_dedup(df.limit(0)).collect() == []


def test_line_dedup_of_a_very_long_text(spark):
    text = "\n".join(f"line {i}" for i in range(50_000))
    rows = [(0, text + "\nall over", "s0", 0)] + [(i, f"own {i}\nall over", f"s{i}", 0) for i in range(1, 12)]
    got = {r["doc_id"]: r["text"] for r in ld.line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {0: rows[0][1]} | {i: f"own {i}" for i in range(1, 12)}


def test_line_dedup_repeated_rows_and_null_ids(spark):
    rows = [(1, "a\nb", f"s{i}", 0) for i in range(11)] + [(None, "a\nc", "s0", 0), (2, "b", "s0", 0)]
    got = sorted((str(r["doc_id"]), r["text"]) for r in ld.line_dedup(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted([("1", "a\nb")] * 11 + [("None", "c"), ("2", "")])


def brute_fingerprint(text):
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(values, most=3):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[:i]:
            if (a ^ b).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in vs}


def test_simhash_matches_brute_force(spark):
    rng = random.Random(3)
    rows = make(rng)
    for i in range(80):
        w = words(rng, 300).split()
        for k in range(4):
            v = list(w)
            v[rng.randrange(300)] = "zz"
            rows.append((1000 + 10 * i + k, " ".join(v), "s", 0))
    got = sh.simhash_groups(spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit(1))).collect()
    fps = {(i, t): brute_fingerprint(t) for i, t, *_ in rows}
    comp = brute_components(set(fps.values()))
    least = {}
    for (i, _), f in fps.items():
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    want = sorted(((str(i), f, least.get(comp[f])) for (i, t), f in ((k, fps[k]) for k in [(r[0], r[1]) for r in rows])), key=str)
    assert sorted(((str(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in got), key=str) == want


@pytest.mark.parametrize("most", [sh.BROADCAST_KEYS, -1])
def test_simhash_dedup_loses_no_unique_text_of_a_repeated_doc_id(spark, monkeypatch, most):
    monkeypatch.setattr(sh, "BROADCAST_KEYS", most)
    rng = random.Random(8)
    copy, own, unnamed, two = (words(rng, 200) for _ in range(4))
    rows = [(1, copy, "s", 0), (7, copy, "s", 1), (7, own, "s", 2), (None, copy + " ", "s", 3), (None, unnamed, "s", 4), (None, unnamed, "s", 5), (1, copy, "s", 6), (9, two, "s", 7), (8, two + "\n", "s", 8)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"t1": F.lit(1), "fp": F.lit("x")})
    left = sh.simhash_dedup(df)
    assert left.columns == df.columns and sorted(r["n_chars"] for r in left.collect()) == [0, 2, 4, 5, 6, 8]


def random_ball(rng, n):
    base = [rng.getrandbits(64) for _ in range(5)]
    out = set()
    for _ in range(n):
        x = rng.choice(base)
        for _ in range(rng.randrange(0, 6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out | {rng.getrandbits(64) for _ in range(n)})


@pytest.mark.parametrize("frontier", [64, 1 << 20])
def test_gray_index_equals_brute_force(monkeypatch, frontier):
    monkeypatch.setattr(sh, "FRONTIER", frontier)
    rng = random.Random(4)
    values = np.array(random_ball(rng, 200), np.uint64)
    values = values[np.argsort(sh.gray_rank(values), kind="stable")]
    group = np.sort(np.array([rng.randrange(3) for _ in values]))
    root = sh.GrayIndex(group, values).roots()
    for g in range(3):
        at = np.flatnonzero(group == g)
        want = brute_components(values[at].tolist())
        assert {tuple(sorted(values[at][root[at] == r].tolist())) for r in set(root[at])} == {tuple(sorted(k for k in want if want[k] == r)) for r in set(want.values())}


@pytest.mark.parametrize("hot", [3, 1 << 16])
def test_fingerprint_links_lose_nothing_in_hot_buckets(spark, monkeypatch, hot):
    monkeypatch.setattr(sh, "HOT_BUCKET", hot)
    values = random_ball(random.Random(5), 150)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in components(sh.fingerprint_links(df)).collect()}
    want = brute_components(values)
    classes = lambda m: {tuple(sorted(k for k in m if m[k] == r)) for r in set(m.values())}
    assert classes(roots) == {c for c in classes(want) if len(c) > 1}


def test_components_of_a_chain_and_no_edges(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
