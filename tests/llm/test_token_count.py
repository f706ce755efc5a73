import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from fastenlake.llm import token_count as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, " \n", "Hello, World! it's", "naïve Straße 日本語 😀 ▁▁x", "aaaa " * 400, "x" * 300, "é́ ﬁ\x00\x1cq"]


def reference(pieces, byte_fallback):
    vocab = [("<unk>", 0.0), *pieces]
    if byte_fallback:
        vocab += [(f"<0x{i:02X}>", -1e6) for i in range(256)]
    low = min(s for _, s in pieces)
    vocab[0] = ("<unk>", low)
    t = Tokenizer(models.Unigram([(p, s) if s > -1e6 else (p, low) for p, s in vocab], unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), pre_tokenizers.Split(" ", "removed"), pre_tokenizers.Metaspace(prepend_scheme="always", split=False)])
    return t


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_counts_equal_the_unigram_tokenizers(byte_fallback):
    rng = random.Random(1)
    # few pieces with equal scores: many ties
    letters = "abcé"
    pieces = [(tc.MARK, -2.0), *[(c, -1.0) for c in "abé"]]
    pieces += [(p, rng.choice([-1.0, -2.0, -3.0])) for p in {"".join(rng.choice(letters) for _ in range(rng.randrange(2, 5))) for _ in range(25)} | {tc.MARK + "ab"}]
    mine, other = tc.Counter(pieces, byte_fallback), reference(pieces, byte_fallback)
    for _ in range(1500):
        word = "".join(rng.choice(letters + "z日") for _ in range(rng.randrange(1, 12)))
        assert mine[word.encode()][0] == len(other.encode(word).ids), word


def test_counts_equal_the_tokenizer_on_the_public_vocabulary():
    pieces, fallback = tc.vocabulary(PATH)
    assert fallback and len(pieces) > 30_000
    mine, other = tc.Counter(pieces, True), reference(pieces, True)
    rng = random.Random(2)
    for _ in range(400):
        word = "".join(rng.choice(["th", "er", "ing", "é", "日", "X", "1", ".", "tion"]) for _ in range(rng.randrange(1, 9)))
        assert mine[word.encode()][0] == len(other.encode(word).ids), word


def brute(pieces, unknown, sentence):
    """Best score over all segmentations, tried one by one."""
    known = dict(pieces)
    best = [0.0]
    for end in range(1, len(sentence) + 1):
        options = [best[at] + known[sentence[at:end]] for at in range(end) if sentence[at:end] in known]
        if sentence[end - 1] not in known:
            options.append(best[end - 1] + unknown)
        best.append(max(options))
    return best[-1]


def test_rows_and_scores(spark):
    pieces, _ = tc.vocabulary(PATH)
    unknown = min(s for _, s in pieces) - tc.UNKNOWN_PENALTY
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (3, TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    got = sorted(map(tuple, tc.token_counts(df, PATH).collect()), key=str)
    one = tc.Counter(*tc.vocabulary(PATH))
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        want.append((i, len(words), sum(one.count(tc.MARK + w.decode())[0] for w in words), sum(brute(pieces, unknown, tc.MARK + w.decode()) for w in words)))
    assert got == sorted(want, key=str)
    assert tc.token_counts(df.limit(0), PATH).collect() == []


def test_very_long_texts_and_words(spark):
    rows = [(1, "word other \n\t" * 100_000), (2, "abc" * 50_000), (3, " \n" * 1000)]
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in tc.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    one = tc.Counter(*tc.vocabulary(PATH))
    assert got[1] == (200_000, 100_000 * sum(one.count(tc.MARK + w)[0] for w in ("word", "other"))) and got[2][0] == 1 and got[2][1] > 10_000 and got[3] == (0, 0)
