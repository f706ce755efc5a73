"""Hidden Markov language model over words.

Tokens: ASCII-lower-cased words between ASCII white space, then one end token.

1. ``word_counts``: all training texts once; words are counted map-side, then merged.
2. The HEAD most frequent words with HEAD_LEAST or more occurrences are classes of
   their own (broadcast, bounded).  The others share TAIL classes by a hash of their last three bytes.  A tail word's
   share of its class is its absolutely discounted count; what the discount frees is
   the class's unknown word.  So class sequences are known without a look-up, and
   P(word | state) = P(class | state) * P(word | class) sums to one.
3. ``encoded``: every document once to its class numbers (two bytes each) and its
   tail words, stored.
4. Baum-Welch: each partition runs scaled forward-backward over its whole training
   sequences and gives expected counts, which are
   aggregated by class; STATES x classes parameters are re-estimated on the driver.
   A sweep finds the states: its SLICES rounds each take another hash slice of the training
   documents, all of them once, and add to the halved counts of the slices before.
   FULL_ROUNDS rounds over every training document follow.  A sequence longer than SEGMENT is
   worked on in segments side by side: products of transfer matrices give each the
   exact forward vector in front of it and the exact backward vector behind it.
5. Scores: the scaled forward recursion gives the exact likelihood of each whole
   class sequence.  Tail words meet their counts by a shuffle join on the word; the
   head never does, so no word of the join is hot.

Defined cases: null text counts as empty and is one end token; without a training
document the model is the base model; a null doc_id is treated like the text ``''``
when documents are split; repeated rows are counted and scored again; extra columns
are ignored; an empty table gives no rows; words of over HEAD_BYTES are never head
words; a text's words are held whole by one task; scores don't depend on how rows lie
in files or partitions but for rounding.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

HEAD, TAIL = 64_000, 1_024
CLASSES = HEAD + TAIL  # below 65536: two bytes
HEAD_LEAST = 3
END = b" "  # no word has a space
STATES = 8
HEAD_BYTES = 256
SEGMENT = 2048
SLICES, FULL_ROUNDS = 12, 2
#: Words a partition counts before it hands them on.
FLUSH = 250_000
#: Tokens worked on at once, about 100 bytes each.
BATCH = 1 << 19
#: Segments whose transfer matrices are made side by side.
SIDE = 2_048
PRIOR = 50.0


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAIL


def _texts(docs: DataFrame, train: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), train.alias("train"), F.col("text").cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary; END for the end token), class (of the tail), n."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*held], pa.binary()), pa.array([tail_class(w) for w in held], pa.int32()), pa.array([*held.values()], pa.int64())], ["word", "class", "n"])

        held: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(words_of(t))
                held[END] += 1
                if len(held) > FLUSH:
                    yield out()
                    held.clear()
        yield out()

    parts = docs.select(F.col("text").cast("binary")).mapInArrow(run, "word binary, class int, n long")
    return parts.groupBy("word", "class").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    head: list[bytes]
    counts: np.ndarray  # of the head words
    tokens: int  # N
    types: int  # V

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (self.tokens + self.types + 1))


class Ids(dict):
    """word -> class number."""

    def __init__(self, head: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(head))
        self.room = len(head) + FLUSH

    def __missing__(self, word: bytes) -> int:
        found = HEAD + tail_class(word)
        if len(self) < self.room:
            self[word] = found
        return found


ENCODED = "row long, doc_id long, train boolean, slice int, n_tokens long, n_head long, base_head double, seq binary, tail array<binary>, tail_n array<int>"


def encoded(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        ids = Ids(v.head)
        base = np.concatenate([v.base(v.counts), np.zeros(CLASSES - len(v.head))])
        for b in batches:
            rows = []
            for t in b.column(4).to_pylist():
                words = words_of(t)
                words.append(END)
                seq = np.fromiter(map(ids.__getitem__, words), np.uint16, len(words))
                at = np.flatnonzero(seq >= HEAD)
                tail = Counter([words[i] for i in at.tolist()])
                rows.append((len(words), len(words) - len(at), float(base[seq].sum()), seq.tobytes(), [*tail], [*tail.values()]))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), *cols], [c.split()[0] for c in ENCODED.split(", ")])

    part = F.when(F.col("train"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(SLICES))).otherwise(-1).cast("int")
    return texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "train", part.alias("slice"), "text").mapInArrow(run, ENCODED)


@dataclass
class Hmm:
    start: np.ndarray  # [S]
    move: np.ndarray  # [S, S]
    emit: np.ndarray  # [classes, S]


def forward(hmm: Hmm, seqs: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each whole sequence by the scaled forward recursion."""
    out = np.zeros(len(seqs))
    size = np.array([len(s) for s in seqs])
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    if not len(order):
        return out
    flat, n = np.concatenate([seqs[i] for i in order]), size[order]
    first = np.cumsum(n) - n
    active = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")  # how many have a t-th token
    total = np.zeros(len(order))
    for t in range(n[0]):
        k = active[t]
        like = hmm.emit[flat[first[:k] + t]]
        a = (a[:k] @ hmm.move) * like if t else hmm.start * like  # noqa: F821
        c = a.sum(axis=1)
        a /= c[:, None]
        total[:k] += np.log(c)
    out[order] = total
    return out


def transfers(hmm: Hmm, parts: list[np.ndarray]) -> np.ndarray:
    """[parts, S, S]: product over a part's tokens of (moves times emissions), up to a factor."""
    order = np.argsort([-len(x) for x in parts], kind="stable")
    n = np.array([len(parts[i]) for i in order])
    flat = np.concatenate([parts[i] for i in order])
    first = np.cumsum(n) - n
    active = np.searchsorted(-n, -np.arange(1, n.max(initial=0) + 1), "right")
    m = np.tile(np.eye(STATES, dtype=hmm.move.dtype), (len(parts), 1, 1))
    for t, k in enumerate(active):
        now = (m[:k].reshape(-1, STATES) @ hmm.move).reshape(k, STATES, STATES) * hmm.emit[flat[first[:k] + t]][:, None, :]
        m[:k] = now / now.max(axis=(1, 2), keepdims=True)
    out = np.empty_like(m)
    out[order] = m
    return out


class Piece(NamedTuple):
    tokens: np.ndarray
    ahead: np.ndarray | None  # forward vector in front; None: a start
    behind: np.ndarray  # backward vector


def pieces(hmm: Hmm, seqs: list[np.ndarray]) -> list[Piece]:
    """The sequences' segments of SEGMENT tokens with what the others of a sequence say about
    their ends, longest first; the transfer matrices of all of them are made side by side."""
    whole = np.ones(STATES, hmm.move.dtype)
    cuts = [[s[i : i + SEGMENT] for i in range(0, len(s), SEGMENT)] for s in seqs]
    inner = [x for cut in cuts if len(cut) > 1 for x in (cut[0][1:], *cut[1:])]
    m = np.concatenate([transfers(hmm, inner[i : i + SIDE]) for i in range(0, len(inner), SIDE)]) if inner else []
    out, at = [], 0
    for cut in cuts:
        ahead, behind = [None], [whole]
        if len(cut) > 1:
            own = m[at : at + len(cut)]
            at += len(cut)
            now = hmm.start * hmm.emit[cut[0][0]]
            for x in own[:-1]:
                now = now @ x
                now /= now.sum()
                ahead.append(now)
            for x in own[:0:-1]:
                now = x @ behind[-1]
                behind.append(now / now.sum())
        out += map(Piece, cut, ahead, reversed(behind))
    return sorted(out, key=lambda x: -len(x.tokens))


def expected(hmm: Hmm, seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
    """Adds the sequences' expected counts (forward-backward) and returns their log likelihood."""
    like = 0.0
    for gamma, flat, first, xi, part in _posteriors(hmm, seqs):
        start += gamma[:, first].sum(axis=1)
        move += xi * hmm.move
        for s in range(STATES):
            emit[:, s] += np.bincount(flat, gamma[s], CLASSES)
        like += part
    return like


def _posteriors(hmm: Hmm, seqs: list[np.ndarray]) -> Iterator[tuple]:
    """About BATCH tokens of segments at a time: state posteriors [S, tokens], the tokens, which
    of the first begin sequences, expected moves (but for their probability), log likelihood."""
    made, begin, size = pieces(hmm, seqs), 0, 0
    for i, x in enumerate(made):
        size += len(x.tokens)
        if size >= BATCH or i + 1 == len(made):
            yield _solved(hmm, made[begin : i + 1])
            begin, size = i + 1, 0


def _solved(hmm: Hmm, made: list[Piece]) -> tuple:
    """Scaled forward-backward over segments, longest first, side by side.  Tokens lie by time:
    the first of all segments, the second of all that have one, and so on."""
    n = np.array([len(x.tokens) for x in made])
    active = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")
    begin = np.concatenate(([0], np.cumsum(active)))
    lane = np.concatenate([np.arange(k) for k in active])
    at = (np.cumsum(n) - n)[lane] + np.repeat(np.arange(n[0]), active)
    flat = np.concatenate([x.tokens for x in made])[at]
    inner = np.array([x.ahead is not None for x in made])
    ahead = np.array([x.ahead for x in made if x.ahead is not None], hmm.move.dtype).reshape(-1, STATES).T
    behind = np.array([x.behind for x in made], hmm.move.dtype).T
    like = np.ascontiguousarray(hmm.emit[flat].T)
    a, c, to = np.empty_like(like), np.empty(len(flat), like.dtype), np.ascontiguousarray(hmm.move.T)
    now = np.repeat(hmm.start[:, None], active[0], axis=1).astype(like.dtype)
    now[:, inner] = to @ ahead
    for t, k in enumerate(active):
        o = begin[t]
        own = slice(o, o + k)
        now = (to @ now[:, :k] if t else now) * like[:, own]
        scale = now.sum(axis=0)
        now /= scale
        a[:, own], c[own] = now, scale
    xi = np.zeros((STATES, STATES))
    like /= c
    beta = np.zeros((STATES, 0), like.dtype)
    for t in range(n[0] - 1, -1, -1):
        own = slice(begin[t], begin[t] + active[t])
        alpha, w = a[:, own], beta
        if beta.shape[1]:
            w = like[:, begin[t + 1] : begin[t + 1] + active[t + 1]] * beta
            xi += alpha[:, : w.shape[1]] @ w.T
            w = hmm.move @ w
        if w.shape[1] < active[t]:
            ends = behind[:, w.shape[1] : active[t]]
            w = np.concatenate([w, ends / (alpha[:, w.shape[1] :] * ends).sum(axis=0)], axis=1)
        beta = w
        alpha *= beta  # the posterior
    xi += ahead @ (like[:, : active[0]] * beta)[:, inner].T
    return a, flat, np.flatnonzero(~inner), xi, float(np.log(c).sum(dtype=np.float64))


def round_of_training(sequences: DataFrame, hmm: Hmm) -> list[np.ndarray]:
    """Expected counts (start, moves, emissions) and log likelihood of one Baum-Welch round, aggregated over all partitions."""
    held = sequences.sparkSession.sparkContext.broadcast(hmm)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
        like, seqs, tokens = 0.0, [], 0
        for b in batches:
            for s in b.column(0).to_pylist():
                seqs.append(np.frombuffer(s, np.uint16))
                tokens += len(seqs[-1])
                if tokens >= BATCH:
                    like += expected(held.value, seqs, start, move, emit)
                    seqs, tokens = [], 0
        if seqs:
            like += expected(held.value, seqs, start, move, emit)
        some = np.flatnonzero(emit.any(axis=1))
        # rows: classes, then CLASSES + s for moves from s, the start, and the likelihood
        rows = np.concatenate([emit[some], move, start[None], np.eye(1, STATES) * like])
        keys = np.concatenate([some, CLASSES + np.arange(STATES + 2)])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(rows[:, s]) for s in range(STATES)]], ["k", *[f"s{s}" for s in range(STATES)]])

    parts = sequences.mapInArrow(run, "k int, " + ", ".join(f"s{s} double" for s in range(STATES)))
    summed = parts.groupBy("k").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(STATES)]).toArrow()  # CLASSES + STATES + 2 rows at most
    out = np.zeros((CLASSES + STATES + 2, STATES))
    out[summed["k"].to_numpy()] = np.stack([summed[f"s{s}"].to_numpy() for s in range(STATES)], axis=1)
    held.destroy()
    return [out[CLASSES + STATES], out[CLASSES : CLASSES + STATES], out[:CLASSES], out[-1, 0]]


def estimated(start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Hmm:
    """Maximisation; the class unigram is the emissions' prior, worth PRIOR tokens a state."""
    e = emit + PRIOR * unigram[:, None]
    m = move + 1
    return Hmm(((start + 1) / (start + 1).sum()).astype(np.float32), (m / m.sum(axis=1, keepdims=True)).astype(np.float32), (e / e.sum(axis=0)).astype(np.float32))


def first_guess(unigram: np.ndarray, seed: int = 1) -> Hmm:
    rng = np.random.default_rng(seed)
    e = unigram[:, None] * np.exp(0.5 * rng.normal(size=(CLASSES, STATES)))
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    return Hmm(np.full(STATES, 1 / STATES, np.float32), move.astype(np.float32), (e / e.sum(axis=0)).astype(np.float32))


def train(sequences: DataFrame, unigram: np.ndarray) -> tuple[Hmm, list[float]]:
    """sequences (slice, seq) of the training documents; the log likelihoods by full round."""
    hmm, likes, held = first_guess(unigram), [], None
    for k in range(SLICES):
        *counts, _ = round_of_training(sequences.where(F.col("slice") == k).select("seq"), hmm)
        held = counts if held is None else [x / 2 + y for x, y in zip(held, counts, strict=True)]
        hmm = estimated(*held, unigram)
    for _ in range(FULL_ROUNDS):
        *counts, like = round_of_training(sequences.select("seq"), hmm)
        likes.append(float(like))
        hmm = estimated(*counts, unigram)
    return hmm, likes


def hmm_scores(docs: DataFrame, learn_from: Column) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    texts = _texts(docs, learn_from)
    counts = stored(word_counts(texts.where("train")), "word-counts")
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("word") == F.lit(END), F.col("n"))).alias("docs")).first()
    if not total["docs"]:
        tokens = F.size(F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long") + 1
        none = F.lit(0).cast("long")
        return texts.select("doc_id", "train", tokens.alias("n_tokens"), none.alias("n_known"), none.alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    top = counts.where(((F.col("n") >= HEAD_LEAST) & (F.length("word") <= HEAD_BYTES)) | (F.col("word") == F.lit(END))).orderBy(F.desc("n"), "word").limit(HEAD).toArrow()  # HEAD rows at most
    v = Vocabulary([bytes(w) for w in top["word"].to_pylist()], top["n"].to_numpy(), total["n"], total["v"])
    if END not in v.head:  # over HEAD words more frequent than documents
        v.head[-1], v.counts = END, np.concatenate([v.counts[:-1], [total["docs"]]])

    # tail: each word's discounted share of its class, and the class's unknown share
    rest = counts.join(F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in v.head], "word binary")), "word", "left_anti")
    n1, n2 = (F.count(F.when(F.col("n") == k, 1)) for k in (1, 2))
    by_class = rest.groupBy("class").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"), (n1 / F.greatest(n1 + 2 * n2, F.lit(1))).alias("d"))
    stats = by_class.withColumn("d", F.least(F.greatest(F.col("d"), F.lit(0.1)), F.lit(0.95))).toArrow()  # TAIL rows at most
    classes = {c: (n, t, d) for c, n, t, d in zip(*(stats[x].to_pylist() for x in ("class", "total", "types", "d")), strict=True)}
    unigram = np.zeros(CLASSES)
    unigram[: len(v.head)] = v.counts
    for c, (n, *_) in classes.items():
        unigram[HEAD + c] = n
    unigram[HEAD:] += 0.5  # a tail class without a training word can be met
    unigram /= unigram.sum()

    coded = stored(encoded(texts, v), "word-classes", by="slice")
    hmm, _ = train(coded.where("slice >= 0").select("slice", "seq"), unigram)

    model = docs.sparkSession.sparkContext.broadcast(hmm)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = [np.frombuffer(s, np.uint16) for s in b.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), pa.array(forward(model.value, seqs) / np.log(10))], [*(b.schema.names[:6]), "chain"])

    chained = coded.select("row", "doc_id", "train", "n_tokens", "n_head", "base_head", "seq").mapInArrow(run, "row long, doc_id long, train boolean, n_tokens long, n_head long, base_head double, chain double")

    known = docs.sparkSession.createDataFrame([(c, float(n), float(t), float(d)) for c, (n, t, d) in classes.items()], "class int, total double, types double, d double")
    worth = rest.join(F.broadcast(known), "class").select("word", "n", F.log10((F.col("n") - F.col("d")) / F.col("total")).alias("inside"))
    # an unknown word's class isn't at hand natively: its last bytes are looked up among the TAIL classes
    each = coded.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("x")).select("row", F.col("x.tail").alias("word"), F.col("x.tail_n").alias("k"))
    tail_of = F.pmod(F.crc32(F.expr("substring(word, greatest(1, length(word) - 2), 3)")), F.lit(TAIL)).cast("int")
    unseen = known.select("class", F.log10(F.col("d") * F.col("types") / F.col("total")).alias("outside"))
    met = each.join(worth, "word", "left").withColumn("class", tail_of).join(F.broadcast(unseen), "class", "left")
    inside = F.coalesce("inside", "outside", F.lit(0.0))  # a class without a training word is all unknown
    base = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(v.tokens + v.types + 1)))
    tail = met.groupBy("row").agg(F.sum(F.col("k") * inside).alias("tail_score"), F.sum(F.col("k") * base).alias("tail_base"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("tail_known"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return chained.join(tail, "row", "left").select(
        "doc_id", "train", "n_tokens", (F.col("n_head") + zero("tail_known")).cast("long").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base_head") + zero("tail_base")).alias("base_score"), (F.col("chain") + zero("tail_score")).alias("score"),
    )
