"""Benchmark decontamination by template canonicalisation.

Texts become word tokens (lower-cased, punctuation dropped); numbers, units behind
a number, and names (capitalised words) become typed
placeholders, their values *slots*.  A benchmark item is found in a document if at
least COVERAGE of its distinct template windows of WINDOW tokens occur there, in
one place and with consistent slots: one item value always stands for one document
value of its type and the other way round.  So a re-parameterised question is
caught, and a passage that merely has the same frame with values mixed up isn't.
Windows with fewer than LITERALS words that aren't placeholders say nothing and
don't count.  A text has up to three forms: names inside a sentence as placeholders, all
names as words (finds passages whose capitals were changed), and every capitalised word
that isn't in COMMON as a placeholder wherever it stands (finds renamed subjects that
begin sentences).  Equal forms are compared.

Places and slots: an equal window at item token q and document token p lies on the
alignment p - q.  Every alignment is tried as an anchor, with a binding of its own:
each pair (type, item value, document value) has as many votes as the anchor has
windows that hold it; pairs are bound by most votes, then equal values first, then
earliest, each value once.  The anchor's windows that keep to the binding are
covered.  Then come the windows of alignments at most one item length away (most
windows first, then nearest, then lower): those not covered yet that agree with the
binding are covered and bind their values.  The best anchor counts: most coverage, then
one without changed values.  A verbatim copy is thus always covered in full.

Items without a window that counts ("Who wrote Hamlet?", rows of numbers) are
found where all their tokens, at least SHORT of them, stand in a row with equal
values; items with fewer tokens can't be searched, and ``unsearchable`` lists them.

The window hashes of the items are joined with those of the documents: by binary
search in a broadcast sorted array if there are at most BROADCAST_WINDOWS, else by
a shuffle join of each item's rarest windows, of which a document that covers the item must
hold one, so no window that is common in the documents is joined unless all
of its item's are.  Pairs that meet are verified token by token.

Defined cases: null texts count as empty; a null doc_id is reported as such; rows are
judged by their own text, also where a doc_id repeats; a repeated row or item is
reported again; extra columns are ignored or kept as they are, whatever their names;
an empty table gives no pairs; a text is held whole by one task, with about 100
bytes a token.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WINDOW = 5
COVERAGE = 0.8
LITERALS = 3
SHORT = 3
#: Item windows that are broadcast, 24 bytes each.
BROADCAST_WINDOWS = 2_000_000
MEMO = 200_000
#: Units that are replaced behind a number.
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb ml cl l s sec min h hr hrs ms day days week weeks month months year years hour hours minute minutes second seconds meter meters metre metres mile miles foot feet inch inches gram grams litre litres liter liters percent dollar dollars euro euros cent cents degree degrees volt volts watt watts".split()
#: Words that begin sentences in capitals and aren't names: English, German, French and Spanish.
COMMON = """
the an and or but if then so as at by for from in into of on to with after before during while when where why who whom whose what which how that this these those there here it its he she they we you his her their our my your is are was were be been do does did has have had can could should would shall must not no yes all each every some any many most more both one two three during since because although until calculate compute determine estimate evaluate find give given explain suppose let assume consider
der die das den dem des ein eine einen einem einer eines und oder aber wenn dann als bei von vom aus mit nach vor im zu zum zur auf an wie was wer wem wen wessen wo wann warum wieviel viele welche welcher welches dies diese dieser dieses es er sie wir ihr sein seine ihre ist sind war waren hat haben hatte kann wird nicht kein keine alle jeder jede jedes berechne bestimme
le la les un une des du de et ou mais si alors comme chez par pour dans en sur avec sans quand combien comment pourquoi qui que quoi quel quelle quels quelles ce cet cette ces il elle ils elles nous vous son sa ses leur leurs est sont ne pas au aux chaque tous toutes calculez trouvez
el los las uno una unos unas del al y pero sin con para por desde hasta cuando cuanto cuantos cuántas cuántos cuánto cómo dónde qué quién cuál cuáles este esta estos estas eso ese esa su sus es son fue era ha han no se lo cada todos todas calcule halle
""".split()
WORD, CAPITALISED, NUMBER, BREAK, UNIT, COMMON_CAPITALISED = range(6)
NUM_HASH, NAME_HASH, UNIT_HASH = (xxhash.xxh64_intdigest(x) & ~7 for x in (b"<num>", b"<name>", b"<unit>"))
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?:\n]")
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Tokens(dict):
    """token -> 61 bits of its hash and its kind in the lowest three."""

    def __missing__(self, token: str) -> int:
        low = token.lower()
        kind = NUMBER if token[0].isdecimal() else BREAK if token in ".!?:\n" else UNIT if low in _units else WORD if len(token) < 2 or not token[0].isupper() or not token[1:].islower() else COMMON_CAPITALISED if low in _common else CAPITALISED
        found = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")) & ~7 | kind
        if len(self) >= MEMO:
            self.clear()
        self[token] = found
        return found


_units, _common = frozenset(UNITS), frozenset(COMMON)
_tokens = Tokens()


class Template(NamedTuple):
    words: np.ndarray  # uint64 hashes, placeholders put in
    slots: np.ndarray  # uint64: the value's hash where a placeholder stands, else 0
    windows: np.ndarray  # uint64 hash of each window, by first token
    counts: np.ndarray  # bool: the window has enough literal words


#: Names inside sentences as placeholders, names as words, capitalised words as placeholders anywhere.
Forms = tuple[Template | None, Template, Template | None]
N_FORMS, PLAIN = 3, 1
_SEEDS = np.array([1, 0, 2, 3], np.uint64)


class Stacked(NamedTuple):
    """The forms a text has, one row each."""

    made: list[int]
    words: np.ndarray
    placed: np.ndarray  # bool: a placeholder stands here
    value: np.ndarray  # hashes of the words themselves, one row for all forms
    windows: np.ndarray
    counts: np.ndarray


def stacked(text: str | None) -> Stacked:
    raw = np.fromiter(map(_tokens.__getitem__, _TOKEN.findall(text or "")), np.uint64)
    kind = (raw & np.uint64(7)).astype(np.int8)
    begins = np.concatenate(([True], kind[:-1] == BREAK))[: len(kind)]
    after_number = np.concatenate(([False], kind[:-1] == NUMBER))[: len(kind)]
    real = kind != BREAK
    kind, begins, after_number, value = kind[real], begins[real], after_number[real], raw[real] & ~np.uint64(7)
    words, placed = value.copy(), np.zeros(len(value), bool)
    for which, placeholder in ((kind == NUMBER, NUM_HASH), ((kind == UNIT) & after_number, UNIT_HASH)):
        words[which] = placeholder
        placed |= which
    anywhere = kind == CAPITALISED
    names = {0: (anywhere | (kind == COMMON_CAPITALISED)) & ~begins, PLAIN: None, 2: anywhere}
    made = [f for f, name in names.items() if name is None or name.any()]
    w, p = np.repeat(words[None], len(made), axis=0), np.repeat(placed[None], len(made), axis=0)
    for i, f in enumerate(made):
        if names[f] is not None:
            w[i, names[f]] = NAME_HASH
            p[i] |= names[f]
    h = _rolled(w, WINDOW, _SEEDS[made])
    literal = np.zeros(h.shape, np.int8)
    for k in range(WINDOW):
        literal += ~p[:, k : k + h.shape[1]]
    return Stacked(made, w, p, value, h, literal >= LITERALS)


def _rolled(words: np.ndarray, length: int, seeds: np.ndarray) -> np.ndarray:
    """Hash of the `length` words from each position, by row."""
    n = max(0, words.shape[1] - length + 1)
    h = np.repeat(seeds[:, None], n, axis=1)
    for k in range(length):
        h ^= words[:, k : k + n]
        h *= _MULT
        h ^= h >> np.uint64(31)
    return h


def starts(values: np.ndarray) -> np.ndarray:
    """Hash of the SHORT values from each position."""
    return _rolled(values[None], SHORT, _SEEDS[N_FORMS:])[0]


def forms(s: Stacked) -> Forms:
    out: list[Template | None] = [None] * N_FORMS
    for i, f in enumerate(s.made):
        out[f] = Template(s.words[i], np.where(s.placed[i], s.value, np.uint64(0)), s.windows[i], s.counts[i])
    return tuple(out)


def templates(text: str | None) -> Forms:
    """The three forms; those with names are None without one."""
    return forms(stacked(text))


class Found(NamedTuple):
    coverage: float
    windows: int
    changed: bool  # some slot value differs from the item's


def consistent(doc: Template, item: Template) -> Found:
    """The best anchor's share of the item's distinct windows; zero where it's below COVERAGE."""
    q_all = np.flatnonzero(item.counts)
    known, kind = np.unique(item.windows[q_all], return_inverse=True)
    n, width, best = len(known), len(item.words), Found(0.0, len(known), False)
    if not n:
        return best
    by_kind, size = q_all[np.argsort(kind, kind="stable")], np.bincount(kind)
    p = np.flatnonzero(doc.counts)
    at = np.minimum(np.searchsorted(known, doc.windows[p]), n - 1)
    met = known[at] == doc.windows[p]
    p, at = p[met], at[met]
    least = COVERAGE * n
    for s in np.unique(np.concatenate([p // width, p // width - 1])).tolist():  # anchors from s * width, and all that lies near them
        low, high = np.searchsorted(p, ((s - 1) * width, (s + 3) * width))
        if len(np.unique(at[low:high])) < max(least, best.coverage * n):
            continue
        many = size[at[low:high]]
        ps, ks = np.repeat(p[low:high], many), np.repeat(at[low:high], many)
        first = np.cumsum(size) - size
        qs = by_kind[np.repeat(first[at[low:high]] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        same = np.ones(len(ps), bool)  # equal hash, equal tokens
        for k in range(WINDOW):
            same &= item.words[qs + k] == doc.words[ps + k]
        ps, qs, ks = ps[same], qs[same], ks[same]
        on = ps - qs
        anchors, support = np.unique(on[(on >= s * width) & (on < (s + 1) * width)], return_counts=True)
        for d in anchors[np.argsort(-support, kind="stable")].tolist():
            near = np.abs(on - d) <= width
            if len(np.unique(ks[near])) < max(least, best.coverage * n):
                continue
            best = max(best, _anchored(doc, item, d, on[near], qs[near], ks[near], n), key=_rank)
            if best.coverage == 1 and not best.changed:
                return best
    return best if best.coverage >= COVERAGE else Found(0.0, n, False)


def _anchored(doc: Template, item: Template, d: int, on: np.ndarray, qs: np.ndarray, kinds: np.ndarray, n: int) -> Found:
    """Coverage with the binding of alignment d, over windows (on: alignment, qs: item token, kinds: window number)."""

    def pairs(line: int, q: int) -> list[tuple[int, int, int]]:
        return [*dict.fromkeys((int(item.words[i]), int(item.slots[i]), int(doc.slots[i + line])) for i in range(q, q + WINDOW) if item.slots[i])]

    forth: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], int] = {}
    lines, support = np.unique(on, return_counts=True)
    order = sorted(zip(lines.tolist(), support.tolist(), strict=True), key=lambda x: (x[0] != d, -x[1], abs(x[0] - d), x[0]))
    by_line = {line: np.flatnonzero(on == line)[np.argsort(qs[on == line], kind="stable")].tolist() for line, _ in order}
    votes: dict[tuple[int, int, int], int] = {}  # in order of first sight
    for i in by_line[d]:
        for x in pairs(d, int(qs[i])):
            votes[x] = votes.get(x, 0) + 1
    for (t, a, b), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0][1] != v[0][2])):
        if (t, a) not in forth and (t, b) not in back:
            forth[t, a], back[t, b] = b, a
    seen: set[int] = set()
    changed = False
    for line, _ in order:
        for i in by_line[line]:
            if int(kinds[i]) in seen:
                continue
            held = pairs(line, int(qs[i]))
            if all(forth.get((t, a), b) == b and back.get((t, b), a) == a for t, a, b in held) and len({x[:2] for x in held}) == len(held) == len({x[::2] for x in held}):
                for t, a, b in held:
                    forth[t, a], back[t, b] = b, a
                    changed |= a != b
                seen.add(int(kinds[i]))
    return Found(len(seen) / n, n, changed)


def _rank(f: Found) -> tuple[float, bool]:
    return f.coverage, not f.changed


def contains(doc: Forms, item: Forms) -> Found:
    """The best of the forms that both have."""
    return max((consistent(d, i) for d, i in zip(doc, item, strict=True) if d and i), key=_rank)


def window_hashes(forms: Forms) -> list[np.ndarray]:
    return [np.unique(t.windows[t.counts]) if t else np.zeros(0, np.uint64) for t in forms]


class Item(NamedTuple):
    forms: Forms
    short: np.ndarray | None  # all values, of an item without a window that counts


def item_of(text: str | None) -> Item:
    s = stacked(text)
    return Item(forms(s), None if s.counts.any() else s.value)


def in_a_row(values: np.ndarray, short: np.ndarray, places: Iterable[int]) -> bool:
    return any((values[p : p + len(short)] == short).all() for p in places if p + len(short) <= len(values))


def found_in(doc: Stacked, item: Item) -> Found:
    if item.short is None:
        return contains(forms(doc), item.forms)
    own = starts(item.short)
    return Found(float(len(own) > 0 and in_a_row(doc.value, item.short, np.flatnonzero(starts(doc.value) == own[0]).tolist())), 1, False)


PAIRS = "doc_id long, item_id long, coverage double, n_windows int, reparameterised boolean"
PAIR_COLUMNS = [c.split()[0] for c in PAIRS.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.bool_()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)], PAIR_COLUMNS)


def _window_rows(key: str, of_items: bool):
    """Rows (key, form, n, h) of a text's windows; form N_FORMS: the starts for items without one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = stacked(text)
                first = np.unique(starts(s.value)) if not of_items else np.zeros(0, np.uint64) if s.counts.any() else starts(s.value)[:1]
                for form, h in enumerate([*window_hashes(forms(s)), first]):
                    same = [pa.array([v] * len(h), t) for v, t in ((k, pa.int64()), (form, pa.int32()), (len(h), pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(h.view(np.int64))], [key, "form", "n", "h"])

    return run


class Finder:
    """Which of the items a text contains."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        self.known = [item_of(t) for _, t in items]
        own = [h for k in self.known for h in window_hashes(k.forms)]  # item i: rows N_FORMS * i and on
        self.size = [len(x) for x in own]
        h, of = np.concatenate([*own, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(own)), self.size)
        order = np.argsort(h, kind="stable")
        self.h, self.of = h[order], of[order]
        # most windows of a text are in no item: a table by their first bits tells so
        bits = min(24, max(16, (64 * len(h)).bit_length()))
        self.shift, self.may = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.may[h >> self.shift] = True
        self.short: dict[int, list[int]] = {}
        for i, k in enumerate(self.known):
            if k.short is not None and len(k.short) >= SHORT:
                self.short.setdefault(int(starts(k.short[:SHORT])[0]), []).append(i)
        self.starts = np.array(sorted(self.short), np.uint64)

    def __call__(self, text: str | None) -> list[tuple]:
        doc = stacked(text)
        out = self._by_windows(doc) if len(self.h) else []
        return out + self._by_starts(doc) if len(self.starts) else out

    def _by_windows(self, doc: Stacked) -> list[tuple]:
        hit = doc.windows[self.may.take((doc.windows >> self.shift).view(np.int64)) & doc.counts]
        if len(hit):
            hit = hit[self.h[np.minimum(np.searchsorted(self.h, hit), len(self.h) - 1)] == hit]
        if not len(hit):
            return []
        hit = np.unique(hit)  # forms have seeds of their own: none meets another's windows
        met = [self.of[a:z] for a, z in zip(np.searchsorted(self.h, hit), np.searchsorted(self.h, hit, "right"), strict=True)]
        rows, n = np.unique(np.concatenate(met), return_counts=True)
        near = {r // N_FORMS for r, k in zip(rows.tolist(), n.tolist(), strict=True) if k >= COVERAGE * self.size[r]}
        own = forms(doc) if near else None
        return [(self.ids[i], *f) for i in sorted(near) if (f := contains(own, self.known[i].forms)).coverage >= COVERAGE]

    def _by_starts(self, doc: Stacked) -> list[tuple]:
        own, places = starts(doc.value), {}
        for p in np.flatnonzero(np.isin(own, self.starts)).tolist():
            places.setdefault(int(own[p]), []).append(p)
        return [(self.ids[i], 1.0, 1, False) for h, at in places.items() for i in self.short[h] if in_a_row(doc.value, self.known[i].short, at)]


def _by_broadcast(docs: DataFrame, items: list[tuple[int | None, str | None]]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(held.value)
        for b in batches:
            yield _batch([(d, *f) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in find(t)])

    return docs.mapInArrow(run, PAIRS)


def _by_join(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """keyed: __dc_row, doc_id, text of stored rows; the pairs by row, for a benchmark of any size."""
    named = stored(items.withColumn("own", F.monotonically_increasing_id()), "items-by-row")
    left = keyed.select("__dc_row", "text").mapInArrow(_window_rows("row", False), "row long, form int, n int, h long").select("row", "form", "h")
    right = named.select("own", "text").mapInArrow(_window_rows("own", True), "own long, form int, n int, h long")
    hits = stored(left.join(right.select("form", "h").distinct(), ["form", "h"], "left_semi"), "windows-of-items")
    # a document with COVERAGE of an item's windows has one of any (1 - COVERAGE) * n + 1 of them: the rarest are asked for
    spread = hits.groupBy("form", "h").agg(F.count(F.lit(1)).alias("docs"))
    rarest = Window.partitionBy("own", "form").orderBy(F.coalesce("docs", F.lit(0)), "h")
    asked = right.join(spread, ["form", "h"], "left").withColumn("k", F.row_number().over(rarest)).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * F.lit(COVERAGE)) + 1)
    pairs = hits.join(asked.select("form", "h", "own"), ["form", "h"]).select("row", "own").distinct()

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row, doc_id, text, item_id, item in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if (f := found_in(stacked(text), item_of(item))).coverage >= COVERAGE:
                    rows.append((row, doc_id, item_id, *f))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *_batch([r[1:] for r in rows]).columns], ["row", *PAIR_COLUMNS])

    met = pairs.join(keyed, F.col("row") == F.col("__dc_row")).join(named.withColumnRenamed("text", "item"), "own")
    return met.select("row", "doc_id", "text", "item_id", "item").mapInArrow(verify, "row long, " + PAIRS)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a row number that no recomputation changes."""
    return stored(docs.withColumn("__dc_row", F.monotonically_increasing_id()), "documents-by-row")


def _small(items: DataFrame, most: int) -> list[tuple[int | None, str | None]] | None:
    """The items, if they have at most `most` windows: fewer than one per two characters."""
    size = items.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0)).alias("n")).first()["n"]
    return [(r["item_id"], r["text"]) for r in items.collect()] if size <= 2 * most else None


def unsearchable(benchmark: DataFrame) -> DataFrame:
    """item_id of the items that have no window that counts and fewer than SHORT tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [item_of(t).short for t in b.column(1).to_pylist()]
            yield b.select([0]).filter(pa.array([x is not None and len(x) < SHORT for x in made], pa.bool_()))

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long")


def contaminated(docs: DataFrame, benchmark: DataFrame, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """The pairs (doc_id, item_id) of a document and a benchmark item that it contains."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    small = _small(items, most)
    return _by_join(_numbered(docs), items).drop("row") if small is None else _by_broadcast(docs, small)


def decontaminate(docs: DataFrame, benchmark: DataFrame, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """docs without the rows that contain a benchmark item; one pass if that is small."""
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    small = _small(items, most)
    if small is None:
        numbered = _numbered(docs)
        bad = _by_join(numbered.select("__dc_row", F.col("doc_id").cast("long"), "text"), items).select(F.col("row").alias("__dc_row")).distinct()
        return numbered.join(bad, "__dc_row", "left_anti").select(docs.columns)
    held, at = docs.sparkSession.sparkContext.broadcast(small), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(held.value)
        for b in batches:
            yield b.filter(pa.array([not find(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
