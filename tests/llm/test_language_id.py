import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fastenlake.llm import language_id as li

WORDS = {"aa": ["banda", "corra", "luna", "mesa"], "bb": ["kwist", "zwerk", "blaut", "ständ"]}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def brute_log2(counts, langs, g):
    """Interpolated Kneser-Ney straight from the definition: order is len(g)."""

    def p(c, g):
        if not g:
            return 1 / alphabet
        level = c
        for _ in range(li.ORDER - len(g)):
            level = Counter(x[1:] for x in level)
        d = li._discount(level.values())
        same = {k: v for k, v in level.items() if k[:-1] == g[:-1]}
        if not same:
            return p(c, g[1:])
        total = sum(same.values())
        return max(same.get(g, 0) - d, 0) / total + d * len(same) / total * p(c, g[1:])

    alphabet = max(2, len({ch for x in langs for k in counts[x] for ch in k}) + 1)
    return [np.log2(p(counts[x], g)) for x in langs]


def test_scores_equal_the_definition():
    rng = random.Random(1)
    counts = {x: li.grams([text(rng, x, 60)]) for x in WORDS}
    models = li.train(counts)
    sample = "Luna zwerk, qqq ständ-banda"
    cp, _ = li.letters_of([sample])
    got = models.log2(cp)
    s = "".join(map(chr, cp.tolist()))
    for i in range(li.ORDER - 1, len(s)):
        assert got[i] == pytest.approx(brute_log2(counts, models.langs, s[i - li.ORDER + 1 : i + 1]), abs=1e-3)


def test_probabilities_sum_to_one():
    rng = random.Random(2)
    counts = {x: li.grams([text(rng, x, 40)]) for x in WORDS}
    chars = {c for x in counts for g in counts[x] for c in g}
    for h in ["ban", "sta", "zzz", " lu"]:
        total = sum(2 ** np.array(brute_log2(counts, [*counts], h + c)) for c in chars) + 2 ** np.array(brute_log2(counts, [*counts], h + "一"))
        assert total == pytest.approx([1, 1], abs=0.02)


def test_texts_don_t_influence_each_other_and_blocks_don_t_matter(monkeypatch):
    rng = random.Random(3)
    models = li.train({x: li.grams([text(rng, x, 60)]) for x in WORDS})
    models.limits[:] = (0, np.inf, np.inf)
    texts = [text(rng, "aa", 30), "", "123 !!", None, text(rng, "bb", 200), "Luna", "\x01\x01"]
    one = [models.predict([t])[0] for t in texts]
    assert models.predict(texts) == one
    monkeypatch.setattr(li, "BLOCK", 7)
    assert [o[0] for o in models.predict(texts)] == [o[0] for o in one]
    assert [o[0] for o in one] == ["aa", "und", "und", "und", "bb", "aa", "und"]
    assert one[3] == ("und", 0.0, True, None)


def test_identify_language_held_out(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, x, rng.randrange(1, 80)), x) for i, x in enumerate(["aa", "bb"] * 150)]
    rows += [(1000, None, "aa"), (1001, "?? 12", None), (1002, "xq " * 80, None), (None, "luna mesa", None), (5, rows[5][1], "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = li.identify_language(df, li.remainder(F.col("doc_id"), 4) != 2).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert sum(by[i]["lang_pred"] == x for i, _, x in rows[:300]) >= 297
    assert not any(by[i]["rejected"] for i in range(300)) and by[1002]["rejected"]
    assert by[1000]["lang_pred"] == by[1001]["lang_pred"] == "und" and by[None]["lang_pred"] == "aa"
    kept = li.accepted(df)
    assert kept.columns == df.columns and kept.where("doc_id < 1000").count() == 301


def test_one_odd_calibration_text_does_not_void_rejection(spark):
    rng = random.Random(6)
    rows = [(i, text(rng, "aa", 40), "aa") for i in range(1500)] + [(9000, "a7f3 " * 60, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    (odd,) = df.where(F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(li.CALIBRATE)) == 0).orderBy("doc_id").limit(1).collect()
    odd_df = df.withColumn("text", F.when(F.col("doc_id") == odd["doc_id"], F.lit("q#xz w" * 9)).otherwise(F.col("text")))
    got = {r["doc_id"]: r["rejected"] for r in li.predicted(odd_df, li.fit(odd_df)).collect()}
    assert got[9000] and sum(got[i] for i in range(1500)) <= 1


def test_a_very_long_text(spark):
    rng = random.Random(7)
    rows = [(i, text(rng, x, 60), x) for i, x in enumerate(["aa", "bb"] * 40)] + [(100, text(rng, "bb", 300_000), "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in li.identify_language(df).collect()}[100] == "bb"


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[:4] for r in li.identify_language(df).collect()] == [(1, "und", 0.0, True)]
    assert li.identify_language(df.limit(0)).collect() == []
