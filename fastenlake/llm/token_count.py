"""Count-only Viterbi: unigram token counts without making the tokens.

The vocabulary is the pieces of a sentencepiece file (a path); the file's ranks
give Zipf log-probabilities, rounded to multiples of 2**-20, so that every sum of
scores is exact and ties are ties.  Text is split at ASCII white space, each word
gets the word mark in front, and, as no piece has the mark behind another
character, words are segmented one by one.

An Aho-Corasick automaton enumerates the pieces that end at each position, longest
first; dynamic programming carries the best score and the count of its pieces.
Tie rules of the unigram tokenizer: only a strictly better candidate replaces one,
and candidates come in the order of their starts; a character that is no piece
scores UNKNOWN_PENALTY below the worst piece, as one unknown; neighbouring unknowns
count as one token, or with byte fallback as one per byte.

Counts per distinct word are remembered by each worker (MEMO words), so a text
costs little more than its split.

Defined cases: null text counts as empty and has 0 tokens and score 0; repeated
rows each get a row; extra columns are ignored; an empty table gives no rows; a run of
white space of any kind and length counts as one mark (as unigram tokenizers normalise it);
a very long text's words are held whole by one task, and so is a very long word, unremembered.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
SCALE = 1 << 20
UNKNOWN_PENALTY = 10.0
MEMO = 250_000


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(piece, exact score) by rank, and whether every byte has a piece of its own."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [model.id_to_piece(i) for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    plain = [p for p in plain if MARK not in p.lstrip(MARK)]
    return [(p, round(-math.log(k + 2) * SCALE) / SCALE) for k, p in enumerate(plain)], sum(model.is_byte(i) for i in range(size)) == 256


class Counter(dict):
    """word in UTF-8 -> (token count, score in units of 1 / SCALE)."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), round(s * SCALE)))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(round(s * SCALE) for _, s in pieces) - round(UNKNOWN_PENALTY * SCALE)
        self.byte_fallback = byte_fallback

    def count(self, sentence: str) -> tuple[int, int]:
        """Pieces and score of the best segmentation of marked text."""
        n = len(sentence)
        score: list[int | None] = [0, *[None] * n]
        pieces = [0] * (n + 1)
        unknown = [False] * (n + 1)  # the best path ends in an unknown
        found = self.automaton.iter(sentence)
        end, hit = next(found, (n, None))
        for at in range(n):
            to = at + 1
            best, of, lost = None, 0, False
            while end == at:
                length, value = hit
                before = score[to - length] + value
                if best is None or before > best:
                    best, of, lost = before, pieces[to - length] + 1, False
                end, hit = next(found, (n, None))
            if sentence[at] not in self.single:
                before = score[at] + self.unknown
                if best is None or before > best:
                    more = len(sentence[at].encode("utf-8", "surrogatepass")) if self.byte_fallback else int(not unknown[at])
                    best, of, lost = before, pieces[at] + more, True
            score[to], pieces[to], unknown[to] = best, of, lost
        return pieces[n], score[n]

    def __missing__(self, word: bytes) -> tuple[int, int]:
        found = self.count(MARK + word.decode("utf-8", "replace"))
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = found
        return found


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(*vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, score (natural log) for every row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                words = text.split()
                got = np.fromiter((x for w in words for x in known[w]), np.int64, 2 * len(words)).reshape(-1, 2).sum(axis=0)
                rows.append((len(words), *got.tolist()))
            words, tokens, score = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(tokens), pa.array(score / SCALE)], ["doc_id", "n_words", "n_tokens", "score"])

    source = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_tokens long, score double")
