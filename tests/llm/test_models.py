import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fastenlake.llm import hmm_lm as hl
from fastenlake.llm import quality_mil as qm
from fastenlake.llm.common import remainder

DOC = "doc_id long, text string"
rng = random.Random(1)
A, B = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]


def corpus(n):
    out = []
    for i in range(n):
        own = A if i % 2 else B
        out.append((i, " ".join(rng.choice(own) if rng.random() < 0.95 else f"rare{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 120)))))
    return out


def test_forward_equals_the_sum_over_all_paths():
    r = np.random.default_rng(2)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    hmm = hl.Hmm(norm(r.random(hl.STATES)), norm(r.random((hl.STATES, hl.STATES))), r.random((5, hl.STATES)))
    seqs = [np.array(x, np.uint16) for x in ([0, 1], [3], [], [4, 4, 2, 0], [1, 2, 3])]
    got = hl.forward(hmm, seqs)
    for s, g in zip(seqs, got, strict=True):
        total = 1.0
        if len(s):
            a = hmm.start * hmm.emit[s[0]]
            for x in s[1:]:
                a = np.array([sum(a[i] * hmm.move[i, j] for i in range(hl.STATES)) * hmm.emit[x, j] for j in range(hl.STATES)])
            total = a.sum()
        assert g == pytest.approx(np.log(total))


@pytest.mark.parametrize("segment, batch", [(256, 2048), (2, 2048), (3, 5), (1, 3)])
def test_expected_counts_of_whole_sequences_equal_brute_force(monkeypatch, segment, batch):
    monkeypatch.setattr(hl, "SEGMENT", segment)
    monkeypatch.setattr(hl, "BATCH", batch)
    monkeypatch.setattr(hl, "SIDE", 2)

    r = np.random.default_rng(3)
    monkeypatch.setattr(hl, "STATES", 2)
    monkeypatch.setattr(hl, "CLASSES", 4)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    hmm = hl.Hmm(norm(r.random(2)), norm(r.random((2, 2))), r.random((4, 2)))
    segments = [np.array(x, np.uint16) for x in ([0, 1, 3, 2], [3], [1, 1], [2, 0, 0, 3, 1, 2, 1], [1, 2, 3])]
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    like = hl.expected(hmm, segments, start, move, emit)
    s0, m0, e0, l0 = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2)), 0.0
    for seg in segments:
        paths = {}
        for path in itertools.product(range(2), repeat=len(seg)):
            p = hmm.start[path[0]] * hmm.emit[seg[0], path[0]]
            for (i, j), x in zip(itertools.pairwise(path), seg[1:], strict=True):
                p *= hmm.move[i, j] * hmm.emit[x, j]
            paths[path] = p
        total = sum(paths.values())
        l0 += np.log(total)
        for path, p in paths.items():
            s0[path[0]] += p / total
            for i, j in itertools.pairwise(path):
                m0[i, j] += p / total
            for x, i in zip(seg, path, strict=True):
                e0[x, i] += p / total
    assert like == pytest.approx(l0)
    for got, want in ((start, s0), (move, m0), (emit, e0)):
        assert got == pytest.approx(want)


def test_scores_base_and_held_out_gain(spark):
    rows = [*corpus(300), (None, None), (1000, ""), (1001, "A1 zzz\x1cq A1"), (7, "x")]
    df = spark.createDataFrame(rows, DOC).withColumns({"score": F.lit("x"), "n": F.lit(1)})
    got = hl.hmm_scores(df, remainder(F.col("doc_id"), 7) != 2).collect()
    assert len(got) == len(rows)
    key = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = {(i, t): [*(t or "").encode().lower().split(), b" "] for i, t in rows}
    counts = {}
    for i, t in rows:
        if not key(i):
            for w in tokens[i, t]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted(((str(i), not key(i), len(w), sum(x in counts for x in w), n, round(sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w), 6)) for (i, t), w in ((r, tokens[r]) for r in rows)))
    assert sorted((str(r["doc_id"]), r["train"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    out = [r for r in got if not r["train"]]
    # two equal topics: log10(2) a token of about 1.6 is there to gain
    assert sum(r["score"] for r in out) > 0.9 * sum(r["base_score"] for r in out)  # logs: nearer to zero is better
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_long_sequences_in_single_precision_stay_finite():
    r = np.random.default_rng(5)
    unigram = 0.01 + r.random(hl.CLASSES) ** 8
    hmm = hl.first_guess(unigram / unigram.sum())
    seqs = [r.integers(0, hl.CLASSES, n).astype(np.uint16) for n in (70_000, 300, 5)]
    start, move, emit = np.zeros(hl.STATES), np.zeros((hl.STATES, hl.STATES)), np.zeros((hl.CLASSES, hl.STATES))
    like = hl.expected(hmm, seqs, start, move, emit)
    assert like == pytest.approx(hl.forward(hmm, seqs).sum(), rel=1e-4)
    assert (start.sum(), move.sum(), emit.sum()) == pytest.approx((3, 70_302, 70_305), rel=1e-4)


def test_scores_do_not_depend_on_the_layout(spark):
    rows = corpus(200)
    a = spark.createDataFrame(rows, DOC).repartition(3, "text")
    b = spark.createDataFrame(rows[::-1], DOC).coalesce(1)
    one, two = ({r["doc_id"]: r["score"] for r in hl.hmm_scores(x, remainder(F.col("doc_id"), 7) != 2).collect()} for x in (a, b))
    assert one == pytest.approx(two, rel=1e-4)


def test_a_long_word_and_a_long_text(spark):
    rows = [(i, "x" * 300_000 + " a b") for i in range(4)] + [(9, "a b " * 50_000)]
    got = {r["doc_id"]: r for r in hl.hmm_scores(spark.createDataFrame(rows, DOC), F.col("doc_id") < 9).collect()}
    assert len(got) == 5 and all(np.isfinite(r["score"]) for r in got.values()) and got[9]["n_tokens"] == 100_001 == got[9]["n_known"]


def test_hmm_without_training_documents(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], DOC)
    got = sorted(map(tuple, hl.hmm_scores(df, F.lit(False)).collect()))
    assert got == [(1, False, 3, 0, 0, 0.0, 0.0), (2, False, 1, 0, 0, 0.0, 0.0)]
    assert hl.hmm_scores(df.limit(0), F.lit(True)).collect() == []


def bad(r):
    return "\n".join("!!! ### " + "$$ &&" * r.randrange(1, 4) for _ in range(30))


def good(r):
    return " ".join("".join(r.choice("aeioutnrs") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(20, 400)))


def test_quality_learns_on_held_out_documents(spark):
    r = random.Random(5)
    rows = [(i, good(r) if i % 3 else bad(r) if i % 2 else "und " * 90) for i in range(400)] + [(900, None), (901, ""), (None, good(r)), (3, rows_text := bad(r))]
    assert rows_text
    df = spark.createDataFrame(rows, DOC).withColumn("predicted", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(400)] + [(900, None, None), (5000, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    learn = qm.learnable(F.col("doc_id"))
    got = qm.quality_scores(df, qm.fit(df, labels, learn)).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7) for x in got)
    held = [x for x in got if x["doc_id"] is not None and x["doc_id"] < 400 and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2]
    assert sum(x["predicted"] == (x["doc_id"] % 3 > 0) for x in held) >= 0.97 * len(held) > 50
    assert qm.quality_scores(df.limit(0), qm.fit(df, labels.limit(0))).collect() == []
    assert {x["score"] for x in qm.quality_scores(df, qm.fit(df, labels.limit(0))).collect()} == {0.5}


def test_slabs_give_the_same_score_as_one_bag(monkeypatch):
    r = random.Random(6)
    bags = [qm.bag(t.encode()) for t in [good(r) for _ in range(40)] + [bad(r) for _ in range(40)]]
    model = qm.fit_bags(bags, np.array([1.0] * 40 + [0.0] * 40))
    text = (good(r) + "\n" + bad(r) + " ").encode() * 30
    monkeypatch.setattr(qm, "SLAB", 5000)
    assert b"".join(qm.slabs(text)) == text
    h = model.encode(qm.bag(text))
    e = model.attend(h)
    a = np.exp(e - e.max())
    want = qm._sigmoid((a / a.sum()) @ h @ model.p["c"] + model.p["d"])
    assert model.score(text) == pytest.approx(float(want), abs=1e-5)


def test_fitting_lowers_the_loss(monkeypatch):
    r = random.Random(7)
    bags = [qm.bag(t.encode()) for t in [good(r) for _ in range(30)] + [bad(r) for _ in range(30)]]
    y = np.array([1.0] * 30 + [0.0] * 30)
    monkeypatch.setattr(qm, "EPOCHS", 8)
    model = qm.fit_bags(bags, y)
    p = []
    for b in bags:
        h = model.encode(b)
        e = model.attend(h)
        a = np.exp(e - e.max())
        p.append(float(qm._sigmoid((a / a.sum()) @ h @ model.p["c"] + model.p["d"])))
    loss = -np.mean(np.log(np.where(y > 0, p, 1 - np.array(p)) + 1e-12))
    assert loss < 0.1


def test_gradients_equal_differences():
    r = np.random.default_rng(8)
    size, y = np.array([3, 1, 4]), np.array([1.0, 0.0, 1.0])
    x = r.normal(size=(8, 5))
    p = {k: r.normal(size=s) for k, s in {"W": (5, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "d": ()}.items()}
    _, grad = qm.loss_and_gradients(p, x, size, y)
    for k in p:
        for at in np.ndindex(p[k].shape):
            moved = []
            for step in (1e-5, -1e-5):
                q = {n: v.copy() for n, v in p.items()}
                q[k][at] += step
                moved.append(qm.loss_and_gradients(q, x, size, y)[0])
            assert (moved[0] - moved[1]) / 2e-5 == pytest.approx(float(grad[k][at]), abs=1e-6)


def plain_features(words):
    """Features of one passage, from the definition: shares of byte classes and pairs, repetitions, word length."""
    text = b" ".join(words)
    kind = [next((k for k, c in enumerate(qm.CLASSES) if chr(b) in c), len(qm.CLASSES)) if b < 128 else len(qm.CLASSES) + 1 for b in text]
    single, pair = [0] * qm.N, [0] * qm.N**2
    for k in kind:
        single[k] += 1
    for a, b in itertools.pairwise(kind):
        pair[a * qm.N + b] += 1
    low = [bytes(c | 32 for c in w) for w in words]
    again = [sum(x == y for x, y in zip(low, low[k:], strict=False)) / len(words) for k in (1, 2)]
    size = max(1, len(text))
    return [*((x / size) ** 0.5 for x in single), *((x / size) ** 0.5 for x in pair), *again, min(sum(map(len, words)) / len(words), 40) / 10, len(words) / qm.PASSAGE]


def test_quality_query_equals_a_plain_forward_pass(spark):
    r = random.Random(9)
    rows = [(i, good(r)[:300].strip() if i % 2 else "!! $$ 12 && " * 5 + "x") for i in range(60)]
    rows = [(i, " ".join(t.split()[: qm.PASSAGE])) for i, t in rows]
    df = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = qm.fit(df, labels, qm.learnable(F.col("doc_id")))
    p = {k: np.asarray(v, float).tolist() for k, v in model.p.items()}
    got = {x["doc_id"]: x["score"] for x in qm.quality_scores(df, model).collect()}
    for i, t in rows:
        x = [min(6, max(-6, (a - m) / s)) for a, m, s in zip(plain_features(t.encode().split()), model.mean.tolist(), model.scale.tolist(), strict=True)]
        h = [np.tanh(sum(a * w[j] for a, w in zip(x, p["W"], strict=True)) + p["b"][j]) for j in range(qm.HIDDEN)]
        # one passage: its attention weight is one
        assert got[i] == pytest.approx(1 / (1 + np.exp(-sum(a * c for a, c in zip(h, p["c"], strict=True)) - p["d"])), abs=2e-3)


def test_fit_takes_whole_texts_of_any_length_until_the_bytes_are_used(spark, monkeypatch):
    assert qm._within([(1, 9), (2, 5), (3, 5)], 12) == 2 and qm._within([(1, 99)], 12) is None and qm._within([(1, 5), (2, 5)], 10) is None
    r = random.Random(10)
    rows = [(i, good(r) if i % 2 else bad(r)) for i in range(80)] + [(80, bad(r) * 400), (81, good(r) * 100)]
    df, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame([(i, i % 2) for i in range(82)], "doc_id long, quality int")
    for most in (1 << 26, 40_000):
        monkeypatch.setattr(qm, "FIT_BYTES", most)
        got = {x["doc_id"]: x["score"] for x in qm.quality_scores(df, qm.fit(df, labels)).collect()}
        assert got[80] < 0.5 < got[81]
