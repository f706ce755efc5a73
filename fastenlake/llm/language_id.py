"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays.

Text is reduced to letters: lower-cased code points, each run of anything else one
blank, ORDER - 1 boundary marks in front.  Per language an interpolated Kneser-Ney
model of ORDER characters is trained (absolute discount from the counts of
counts; lower orders on continuation counts; order one mixed with a uniform share).
All languages share one sorted array of n-gram hashes per order, with a row of
log2 probabilities (one per language) beside each, and one of context hashes with
the back-off weights.  A batch of texts is scored by vectorised binary search;
only positions that an order doesn't know go on to the next.  The language with
the lowest cross-entropy per character wins.

Training reads a bounded hash sample of the labelled rows, about SAMPLE_DOCS per
language (whole texts, all their n-grams).  One labelled row in CALIBRATE is never
learned from; about CHECK_DOCS of these per language calibrate rejection: a text is
rejected if its cross-entropy exceeds their mean by more than SLACK times the excess of
their QUANTILE, and by more than SLACK times the QUANTILE of such excesses in units of
one over the square root of the length.  So a few odd calibration texts change nothing.

Defined cases: null text or one without a letter is `und`, rejected, score 0;
without any labelled row every text is; null lang rows aren't learned from; equal
cross-entropies go to the alphabetically first language; repeated rows each get a
row; extra columns are ignored (``accepted`` keeps them); an empty table gives no
rows; a very long text is scored in blocks, its code points held whole by one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder

ORDER = 4
SAMPLE_DOCS, CHECK_DOCS = 400, 1_000
CALIBRATE = 5
QUANTILE, SLACK = 0.99, 3.0
#: Characters scored at once.
BLOCK = 1 << 17
UNKNOWN = "und"
MARK, BLANK = 1, 32
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _letter_table() -> np.ndarray:
    """Code point to its lower-case letter, or BLANK; MARK stays."""
    out = np.full(0x110000, BLANK, np.uint32)
    for i in range(0x110000):
        if chr(i).isalpha():
            low = chr(i).lower()
            out[i] = ord(low) if len(low) == 1 else i
    out[MARK] = MARK
    return out


_letters: list[np.ndarray] = []


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each with its boundary marks, and where each begins."""
    if not _letters:
        _letters.append(_letter_table())
    marks = "\x01" * (ORDER - 1)
    raw = np.frombuffer((marks + marks.join(t.replace("\x01", " ") for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate(([0], np.cumsum([len(t) + ORDER - 1 for t in texts])))
    cp = _letters[0][raw]
    blank = cp == BLANK
    keep = ~blank
    keep[1:] |= cp[:-1] > BLANK  # one blank after a letter
    return cp[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def rolling(cp: np.ndarray) -> list[np.ndarray]:
    """[k]: hash of the k + 1 code points that end at each position."""
    out, x = [], cp.astype(np.uint64) + np.uint64(1)
    now = np.zeros(len(cp), np.uint64)
    for k in range(ORDER):
        # hash of the last k + 1 = (hash of the k before the last) * M + the last
        now = np.concatenate((np.zeros(min(1, len(cp)), np.uint64), now[:-1])) * _MULT + x
        out.append(now ^ (now >> np.uint64(29)))
    return out


def grams(texts: list[str]) -> Counter:
    """How often each run of ORDER characters (ending at a letter or blank) occurs."""
    out: Counter = Counter()
    for t in texts:
        cp, _ = letters_of([t])
        s = "".join(map(chr, cp.tolist()))
        out.update(s[i - ORDER + 1 : i + 1] for i in range(ORDER - 1, len(s)))
    return out


@dataclass
class Models:
    langs: list[str]
    #: per order from 1: sorted hashes, log2 probabilities [n, langs]
    known: list[tuple[np.ndarray, np.ndarray]]
    #: per order from 1: sorted context hashes, log2 back-off weights [n, langs]
    weight: list[tuple[np.ndarray, np.ndarray]]
    unknown: np.ndarray
    #: per language: mean, quantile, quantile of the excess times root length of cross-entropies
    limits: np.ndarray

    def _row(self, table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, _ = table
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        return at, keys[at] == h if len(keys) else np.zeros(len(h), bool)

    def log2(self, cp: np.ndarray) -> np.ndarray:
        """log2 probability of each position's character, per language."""
        h = rolling(cp)
        before = [np.concatenate((np.zeros(min(1, len(cp)), np.uint64), x[:-1])) for x in h]
        out = np.zeros((len(cp), len(self.langs)), np.float32)
        left = np.arange(len(cp))
        for n in range(ORDER, 0, -1):
            at, found = self._row(self.known[n - 1], h[n - 1][left])
            out[left[found]] += self.known[n - 1][1][at[found]]
            left = left[~found]
            if n > 1 and len(left):
                at, has = self._row(self.weight[n - 1], before[n - 2][left])
                out[left[has]] += self.weight[n - 1][1][at[has]]
        out[left] += self.unknown
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters scored and bits per character [texts, langs]."""
        cp, at = letters_of(texts)
        total = np.zeros((len(texts), len(self.langs)))
        n = np.diff(at) - (ORDER - 1)
        for low in range(0, len(cp), BLOCK):
            begin = max(0, low - ORDER + 1)  # the context in front
            part = cp[begin : low + BLOCK]
            bits = self.log2(part)
            bits[part == MARK] = 0
            bits = bits[low - begin :]
            first = np.searchsorted(at, low, "right") - 1
            end = np.searchsorted(at, low + len(bits), "left")
            cuts = np.maximum(at[first:end] - low, 0)
            some = cuts < len(bits)
            total[first:end][some] += np.add.reduceat(bits, cuts[some], axis=0, dtype=np.float64)
        return n, -total / np.maximum(n, 1)[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool, float | None]]:
        """Language, score, rejected, bits per character of each text."""
        if not self.langs:
            return [(UNKNOWN, 0.0, True, None)] * len(texts)
        n, ce = self.entropies([t or "" for t in texts])
        best = ce.argmin(axis=1)
        rows = np.arange(len(texts))
        # posterior of the whole text under equal priors; the exponent is bounded, so a score is never exactly rounded away
        score = 1 / np.exp2(np.minimum((ce.min(axis=1)[:, None] - ce) * n[:, None], 0)).sum(axis=1)
        mean, most, excess = self.limits[best].T
        low = ce[rows, best]
        out = (low - mean > SLACK * (most - mean)) & ((low - mean) * np.sqrt(np.maximum(n, 1)) > SLACK * excess)
        return [(self.langs[b], float(s), bool(o), float(x)) if k else (UNKNOWN, 0.0, True, None) for b, s, o, x, k in zip(best, score, out, low, n > 0, strict=True)]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, bool, float | None]]:
        """predict(), some texts at a time."""
        out: list[tuple] = []
        held, n = [], 0
        for t in texts:
            held.append(t)
            n += len(t or "")
            if n > BLOCK:
                out += self.predict(held)
                held, n = [], 0
        return out + (self.predict(held) if held else [])


def _hash(s: str) -> int:
    return int(rolling(np.array([ord(c) for c in s], np.uint32))[len(s) - 1][-1])


def _discount(counts: Iterable[int]) -> float:
    seen = Counter(counts)
    return min(0.95, max(0.1, seen[1] / (seen[1] + 2 * seen[2]))) if seen[1] else 0.5


def train(counts: dict[str, Counter]) -> Models:
    """Interpolated Kneser-Ney models from the counts of ORDER-character runs of each language."""
    langs = sorted(x for x in counts if counts[x])
    known: list[dict[str, np.ndarray]] = [{} for _ in range(ORDER)]
    weight: list[dict[str, np.ndarray]] = [{} for _ in range(ORDER)]
    alphabet = max(2, len({c for x in langs for g in counts[x] for c in g}) + 1)
    base = {}
    for x in langs:
        level: dict[int, Counter] = {ORDER: counts[x]}
        for n in range(ORDER - 1, 0, -1):
            level[n] = Counter(g[1:] for g in level[n + 1])  # in how many contexts it continues
        base[x] = level
    unknown = np.zeros(len(langs))
    prob: dict[tuple[str, int], dict[str, float]] = {}
    back: dict[tuple[str, int], dict[str, float]] = {}
    for k, x in enumerate(langs):
        for n in range(1, ORDER + 1):
            c = base[x][n]
            d = _discount(c.values())
            total: Counter = Counter()
            kinds: Counter = Counter()
            for g, v in c.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            back[x, n] = {h: d * kinds[h] / total[h] for h in total}
            lower = prob.get((x, n - 1), {})
            prob[x, n] = {g: (v - d) / total[g[:-1]] + back[x, n][g[:-1]] * (lower[g[1:]] if n > 1 else 1 / alphabet) for g, v in c.items()}
        unknown[k] = back[x, 1][""] / alphabet

    def p(x: str, g: str) -> float:
        if not g:
            return 1 / alphabet
        found = prob[x, len(g)].get(g)
        return found if found is not None else back[x, len(g)].get(g[:-1], 1.0) * p(x, g[1:])

    for n in range(1, ORDER + 1):
        for g in {g for x in langs for g in prob[x, n]}:
            known[n - 1][g] = np.log2([p(x, g) for x in langs])
        for h in {h for x in langs for h in back[x, n]} if n > 1 else ():
            weight[n - 1][h] = np.log2([back[x, n].get(h, 1.0) for x in langs])

    def table(d: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array([_hash(g) for g in d], np.uint64)
        rows = np.array([*d.values()], np.float32).reshape(len(d), len(langs))
        order = np.argsort(keys)
        return keys[order], rows[order]

    return Models(langs, [table(d) for d in known], [table(d) for d in weight], np.log2(unknown).astype(np.float32), np.zeros((len(langs), 3)))


def _sampled(docs: DataFrame, learn: int, check: int) -> DataFrame:
    """text, lang, check: about `learn` rows of each language to learn from and `check` to calibrate on, chosen by a hash; all if there are fewer."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20))
    checks = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATE)) == 0

    def share(most: int, part: float) -> Column:
        each = [F.when(F.col("lang") == x, F.lit(int(min(1, most / (n * part)) * (1 << 20)))) for x, n in count.items()]
        return F.coalesce(*each) if each else F.lit(0)

    return rows.withColumn("check", checks).where(draw < F.when(F.col("check"), share(check, 1 / CALIBRATE)).otherwise(share(learn, 1 - 1 / CALIBRATE))).select("text", "lang", "check")


def fit(docs: DataFrame, learn: int = SAMPLE_DOCS, check: int = CHECK_DOCS) -> Models:
    """docs: doc_id, text, lang.  What is collected are the n-grams of the sample and a few numbers of each calibration text."""
    sample = _sampled(docs.select("doc_id", "text", "lang"), learn, check)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Counter] = {}
        for b in batches:
            for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own.setdefault(x, Counter()).update(grams([t]))
        for x, c in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(c)), pa.array([*c]), pa.array([*c.values()], pa.int64())], ["lang", "gram", "n"])

    counts: dict[str, Counter] = {}
    summed = sample.where(~F.col("check")).select("text", "lang").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    for r in summed.toArrow().to_pylist():
        counts.setdefault(r["lang"], Counter())[r["gram"]] = r["n"]
    models = train(counts)
    held = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(1).to_pylist()
            n, ce = held.value.entropies(b.column(0).to_pylist()) if b.num_rows else ([], [])
            rows = [(x, float(e[held.value.langs.index(x)]), int(k)) for x, e, k in zip(langs, ce, n, strict=True) if x in held.value.langs and k > 0]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64()))], ["lang", "ce", "n"])

    measured = sample.where("check").select("text", "lang").mapInArrow(measure, "lang string, ce double, n long").toArrow().to_pylist()
    for k, x in enumerate(models.langs):
        own = np.array([(r["ce"], r["n"]) for r in measured if r["lang"] == x]).reshape(-1, 2)
        if len(own) < 2:  # nothing to calibrate on: nothing is rejected
            models.limits[k] = (0, np.inf, np.inf)
            continue
        mean = np.average(own[:, 0], weights=own[:, 1])
        models.limits[k] = (mean, np.quantile(own[:, 0], QUANTILE), np.quantile((own[:, 0] - mean) * np.sqrt(own[:, 1]), QUANTILE))
    return models


PREDICTION = "lang_pred string, score double, rejected boolean, bits_per_char double"


def predicted(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score, rejected, bits_per_char for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.float64(), pa.bool_(), pa.float64()]
        for b in batches:
            out = held.value.predict_all(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], ["doc_id", "lang_pred", "score", "rejected", "bits_per_char"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + PREDICTION)


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 4) == 2


def identify_language(docs: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """Fit on the rows of docs where learn_from holds (default: all), predict all rows."""
    return predicted(docs, fit(docs if learn_from is None else docs.where(learn_from)))


def accepted(docs: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """docs without the rows that language ID rejects; one pass, nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs if learn_from is None else docs.where(learn_from)))
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not r[2] for r in held.value.predict_all(b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
