"""Quality classifier: attention-based multiple-instance learning (numpy only).

A document is a bag of passages of PASSAGE words.  A passage is encoded by the
shares of its byte-class pairs, word lengths and immediate word repetitions, put
through one learned layer.  Gated attention (tanh times sigmoid, learned from the
document labels alone) weighs the passages; the weighted sum is scored.

Fitting uses a bounded hash sample of the labelled rows: about FIT_DOCS documents, in
the order of a hash of their doc_id until they have FIT_BYTES of text, whole and of any length
(a passage has at least 2 * PASSAGE bytes, so features take at most 4.3 times FIT_BYTES on the
driver, and twice that as floats).  Scoring reads every passage of every document,
in slabs of SLAB bytes with a running softmax, so memory doesn't grow with a text.

Defined cases: a text without a word, or null, is one passage without content and
gets a score too; null labels aren't learned from; several labels of a document
count by their mean; without labels of both kinds every score is the share of label
1 (0.5 without labels); repeated rows each get a row; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, remainder, stored

PASSAGE = 64
SLAB = 1 << 18
FIT_DOCS, FIT_BYTES = 6000, 1 << 26
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 24, 12, 30, 128, 0.01, 1e-4
THRESHOLD = 0.7

#: Byte classes by example; bytes from 128 (in UTF-8 parts of other letters) are one class, the rest another.
CLASSES = ["aeiou", "tnrsldhm", "bcfgjkpqvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", " ", "\n", ".", ",;:", "!?", "\"'`()[]{}", "|<>=\\/", "#$%&*@^~+_-"]
_CLASS = np.full(256, len(CLASSES), np.int64)
for _k, _chars in enumerate(CLASSES):
    _CLASS[[*_chars.encode()]] = _k
_CLASS[128:] = len(CLASSES) + 1
N = len(CLASSES) + 2
WIDTH = N * N + N + 4
_SPACE = np.zeros(256, bool)
_SPACE[[*b" \t\n\x0b\x0c\r"]] = True
_POWER = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def slabs(text: bytes) -> Iterator[bytes]:
    """The text in parts of at most SLAB bytes, cut behind white space where there is any."""
    at = 0
    while at < len(text) or at == 0:
        end = min(len(text), at + SLAB)
        if end < len(text):
            cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            end = cut + 1 if cut > at else end
        yield text[at:end]
        if end >= len(text):
            return
        at = end


def passages(slab: bytes) -> np.ndarray:
    """Features [passages, WIDTH]; one row of zeros if there is no word."""
    raw = np.frombuffer(slab, np.uint8)
    space = _SPACE[raw]
    begin = ~space
    begin[1:] &= space[:-1]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros((1, WIDTH), np.float32)
    word = np.cumsum(begin) - 1
    word[word < 0] = 0
    of = word // PASSAGE
    n = int(of[-1]) + 1
    kind = _CLASS[raw]
    single = np.bincount(of * N + kind, minlength=n * N).reshape(n, N)
    pair = np.bincount((of[1:] * N + kind[:-1]) * N + kind[1:], minlength=n * N * N).reshape(n, N * N)
    inside = ~space
    weight = np.where(inside, (raw | 32).astype(np.uint64) * _POWER[(np.arange(len(raw)) - starts[word]) & 63], np.uint64(0))
    code = np.add.reduceat(weight, starts)
    own = np.arange(len(starts)) // PASSAGE
    words = np.bincount(own, minlength=n)
    same = [np.bincount(own[k:][code[k:] == code[:-k]], minlength=n) if len(code) > k else np.zeros(n) for k in (1, 2)]
    length = np.bincount(of[inside], minlength=n) / np.maximum(words, 1)
    size = np.maximum(single.sum(axis=1), 1)[:, None]
    extra = np.stack([same[0] / np.maximum(words, 1), same[1] / np.maximum(words, 1), np.minimum(length, 40) / 10, words / PASSAGE], axis=1)
    return np.concatenate([np.sqrt(single / size), np.sqrt(pair / size), extra], axis=1).astype(np.float32)


def bag(text: bytes | None) -> np.ndarray:
    return np.concatenate([passages(s) for s in slabs(text or b"")])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    #: W, b: encoder; V, U, w: gated attention; c, d: output
    p: dict[str, np.ndarray]
    prior: float | None = None

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.p["W"] + self.p["b"])

    def attend(self, h: np.ndarray) -> np.ndarray:
        return (np.tanh(h @ self.p["V"]) * _sigmoid(h @ self.p["U"])) @ self.p["w"]

    def score(self, text: bytes | None) -> float:
        """Probability of label 1; a running softmax over the slabs' passages."""
        if self.prior is not None:
            return self.prior
        top, total, z = -np.inf, 0.0, np.zeros(HIDDEN)
        for s in slabs(text or b""):
            h = self.encode(passages(s))
            e = self.attend(h)
            now = max(top, float(e.max()))
            a = np.exp(e - now)
            keep = np.exp(top - now)
            total, z, top = total * keep + a.sum(), z * keep + a @ h, now
        return float(_sigmoid(z / total @ self.p["c"] + self.p["d"])[()])


def loss_and_gradients(p: dict[str, np.ndarray], x: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss of documents with `size` consecutive passages in x, and its gradients."""
    begin = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(size)), size)
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * s) @ p["w"]
    a = np.exp(e - np.maximum.reduceat(e, begin)[doc])
    a /= np.add.reduceat(a, begin)[doc]
    z = np.add.reduceat(a[:, None] * h, begin, axis=0)
    out = _sigmoid(z @ p["c"] + p["d"])
    loss = -np.mean(np.where(y > 0, np.log(out + 1e-12), np.log(1 - out + 1e-12)))
    g = (out - y) / len(size)
    gz = g[:, None] * p["c"]
    ga = (gz[doc] * h).sum(axis=1)
    ge = a * (ga - np.add.reduceat(a * ga, begin)[doc])
    gt, gs = ge[:, None] * p["w"] * s * (1 - t * t), ge[:, None] * p["w"] * t * s * (1 - s)
    gh = (a[:, None] * gz[doc] + gt @ p["V"].T + gs @ p["U"].T) * (1 - h * h)
    return float(loss), {"W": x.T @ gh, "b": gh.sum(axis=0), "V": h.T @ gt, "U": h.T @ gs, "w": (t * s).T @ ge, "c": z.T @ g, "d": g.sum()}


def fit_bags(bags: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> Model:
    """Adam on the mean log loss of documents."""
    share = float(np.mean(labels)) if len(labels) else 0.5
    zero = Model(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), {}, share)
    if not len(labels) or labels.min() == labels.max():
        return zero
    x = np.concatenate(bags, dtype=np.float32)
    size = np.array([len(b) for b in bags])
    first = np.cumsum(size) - size
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-2
    for i in range(0, len(x), 1 << 14):  # in place
        x[i : i + (1 << 14)] = np.clip((x[i : i + (1 << 14)] - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    shape = {"W": (WIDTH, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": ()}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if s and k not in "b" else np.zeros(s) for k, s in shape.items()}
    p["d"] = np.array(np.log(share / (1 - share)))
    m, v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            n = size[own]
            rows = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            _, grad = loss_and_gradients(p, x[rows], n, labels[own])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k in p:
                d = grad[k] + DECAY * p[k] * (k in "WVUwc")
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean.astype(np.float32), scale.astype(np.float32), {k: q.astype(np.float32) for k, q in p.items()})


def _within(rows: list[tuple[int, int]], most: int) -> int | None:
    """rows: (draw, bytes) by draw; the first draw whose text doesn't fit any more (the first row always does)."""
    total = 0
    for k, (draw, n) in enumerate(rows):
        total += n
        if total > most and k:
            return draw
    return None


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None) -> Model:
    """Fit on about FIT_DOCS labelled documents; labels (doc_id, quality)."""
    own = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    own = own if learn_from is None else own.where(learn_from)
    own = own.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    total = own.count()
    share = min(1.0, FIT_DOCS / total) if total else 0.0
    draw = F.xxhash64("doc_id", F.lit("quality"))
    drawn = own.where(F.pmod(draw, F.lit(1 << 20)) < int(share * (1 << 20))).withColumn("draw", draw)
    # about FIT_DOCS rows of 20 bytes, whatever the input
    met = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(drawn), "doc_id")
    met = stored(met.select("doc_id", "text", "quality", "draw"), "labelled-sample")
    sizes = sorted((r["draw"], r["n"]) for r in met.select("draw", F.length("text").alias("n")).collect())  # about FIT_DOCS pairs of numbers
    end = _within(sizes, FIT_BYTES)
    taken = met if end is None else met.where(F.col("draw") < end)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(2).slice(i, 1), pa.array([bag(t).astype(np.float16).tobytes()], pa.binary())], ["doc_id", "quality", "bag"])

    rows = taken.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, bag binary").toArrow()
    forget(met)
    found = sorted(zip(rows["doc_id"].to_pylist(), rows["quality"].to_pylist(), rows["bag"].to_pylist(), strict=True))
    bags = [np.frombuffer(x, np.float16).reshape(-1, WIDTH) for *_, x in found]
    return fit_bags(bags, np.array([q for _, q, _ in found], np.float64))


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([held.value.score(t) for t in b.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, score double, predicted int")


def learnable(doc_id: Column) -> Column:
    return remainder(doc_id, 4) != 2
