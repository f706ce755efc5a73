"""Token-level text functions: cleaning, sizes, units, spelling.  Plain Python; the
Spark functions around them are in ``fastenlake.functions.parse``."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cache, lru_cache
from typing import NamedTuple

from fastenlake import vocab

#: White space as request forms produce it: ASCII, no-break and other Unicode spaces.
_SPACES = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_WORD = re.compile(f"[^{_SPACES}]+")
_EDGE = "0-9\"'/″”’" + "".join(vocab.FRACTIONS)
_CROSS_INSIDE = re.compile(f"(?<=[{_EDGE}])[x×](?=[0-9])")
_CROSS_LAST = re.compile(f"[{_EDGE}][x×]$")
_CROSS_FIRST = re.compile("[x×][0-9]")
_ENDS_SIZE = re.compile(f"[{_EDGE}]$")
_FRACTION = re.compile(f"([0-9]?)([{''.join(vocab.FRACTIONS)}])")
_GLUED = re.compile(r"([0-9][0-9./-]*?)(" + "|".join(map(re.escape, vocab.UNIT_WORDS)) + ")")


class Token(NamedTuple):
    """A word of a request; start and end cut it out of the original text."""

    text: str
    start: int
    end: int

    def saying(self, text: str) -> Token:
        return self if text == self.text else Token(text, self.start, self.end)


def _words(text: str) -> list[Token]:
    found = ((m.group().lower().rstrip(",.;:!?"), m.start()) for m in _WORD.finditer(text))
    return [Token(w, at, at + len(w)) for w, at in found if w]


def _crossed(words: list[Token]) -> list[Token]:
    """A cross between sizes becomes a word of its own; other crosses become the letter."""
    out = []
    for i, w in enumerate(words):
        before, after = words[i - 1].text if i else "", words[i + 1].text if i + 1 < len(words) else ""
        if "x" not in w.text and "×" not in w.text:
            out.append(w)
            continue
        cuts = {m.start() for m in _CROSS_INSIDE.finditer(w.text)}
        if after[:1] in tuple("0123456789") and _CROSS_LAST.search(w.text):
            cuts.add(len(w.text) - 1)
        if _ENDS_SIZE.search(before) and _CROSS_FIRST.match(w.text):
            cuts.add(0)
        if not cuts:
            out.append(w.saying(w.text.replace("×", "x")))
            continue
        edges = sorted({0, len(w.text)} | cuts | {c + 1 for c in cuts})
        out += [Token("x" if a in cuts else w.text[a:b], w.start + a, w.start + b) for a, b in zip(edges, edges[1:], strict=False)]
    return out


def _plain_characters(text: str) -> str:
    text = text.replace("’", "'").replace("‘", "'").replace("''", '"')
    text = re.sub("[″”“]", '"', text)
    return _FRACTION.sub(lambda m: (m[1] + "-" if m[1] else "") + vocab.FRACTIONS[m[2]], text)


@lru_cache(maxsize=100_000)
def _respelled(text: str) -> str:
    """Quotes, fractions and units in their plain spelling."""
    text = _plain_characters(text)
    if text in vocab.UNIT_WORDS:
        return vocab.UNIT_WORDS[text]
    m = _GLUED.fullmatch(text)
    return m[1] + vocab.UNIT_WORDS[m[2]] if m else text


def _numbered(words: list[Token]) -> list[Token]:
    """`no. 8`, `# 8` and `number 8` become `#8`."""
    out: list[Token] = []
    i = 0
    while i < len(words):
        w = words[i]
        if w.text in vocab.NUMBER_WORDS and i + 1 < len(words) and re.match("[0-9]", words[i + 1].text):
            i += 1
            w = Token("#" + words[i].text, w.start, words[i].end)
        out.append(w)
        i += 1
    return out


def _counted(words: list[Token]) -> set[int]:
    """Positions of the numbers that quantity words take along."""
    digits = [bool(re.fullmatch("[0-9]+", w.text)) for w in words] + [False]
    taken = set()
    for i, w in enumerate(words):
        if w.text not in vocab.QUANTITY_WORDS:
            continue
        left, right = i > 0 and digits[i - 1], digits[i + 1]
        if left and right:
            taken.add(i + 1 if w.text == "qty" else i - 1)
        elif left or right:
            n = i - 1 if left else i + 1
            ahead = words[n - 1].text if n else ""
            # a number behind a standards body names a standard; `x 50 each` stays a size
            if ahead not in vocab.STANDARD_BODIES and not (ahead == "x" and w.text in ("ea", "each")):
                taken.add(n)
    return taken


def cleaned(text: str) -> tuple[list[Token], list[str]]:
    """The words that say something, and which notes the dropped ones leave."""
    words = [w.saying(_respelled(w.text)) for w in _crossed(_words(text))]
    words = [w.saying(vocab.PLURALS.get(w.text, w.text)) for w in _numbered(words)]
    counted = _counted(words)
    why: list[str | None] = []
    for i, w in enumerate(words):
        why.append("quantityStripped" if w.text in vocab.QUANTITY_WORDS or i in counted else "noiseStripped" if w.text in vocab.NOISE_WORDS else None)
    for i, w in enumerate(words):
        if w.text == "of" and why[i] is None:
            why[i] = (why[i - 1] if i else None) or (why[i + 1] if i + 1 < len(words) else None)
    kept = [w for w, y in zip(words, why, strict=True) if y is None]
    return kept, [n for n in ("quantityStripped", "noiseStripped") if n in why]


# --- Sizes and units ---


@dataclass(frozen=True)
class Size:
    """A thread (nominal, perhaps pitch) or a length (value, perhaps unit)."""

    nominal: str | None = None
    pitch: str | None = None
    value: float | None = None
    unit: str | None = None

    @property
    def thread(self) -> bool:
        return self.nominal is not None


def half_up(x: float, scale: float = 1e4) -> float:
    return math.floor(x * scale + 0.5) / scale


def number(text: str) -> float | None:
    """`2`, `2.5`, `3/4`, `1-1/2`."""
    m = re.fullmatch(r"(?:([0-9]+)-)?([0-9]+)/([0-9]+)", text)
    if m:
        whole, top, bottom = (float(g or 0) for g in m.groups())
        value = whole + top / bottom if bottom else math.inf
    elif re.fullmatch(r"[0-9]+(?:\.[0-9]+)?", text):
        value = float(text)
    else:
        return None
    return value if math.isfinite(value) else None


@lru_cache(maxsize=100_000)
def size_of(text: str) -> Size | None:
    text = text.strip()
    low = text.lower()
    for suffix in ('"', "in", "ft", "mm"):
        if low.endswith(suffix):
            value = number(text[: -len(suffix)].rstrip())
            return None if value is None else Size(value=value, unit="in" if suffix == '"' else suffix)
    m = re.fullmatch(r"[mM]([0-9]+)(?:-([0-9]+(?:\.[0-9]+)?))?", text)
    if m:
        return Size("M" + m[1], m[2])
    m = re.fullmatch(r"(#[0-9]+|[0-9]+/[0-9]+)(?:-([0-9]+))?", text)
    if m:  # threads per inch within reason
        return Size(m[1], m[2]) if m[2] is None or 4 <= float(m[2]) <= 80 else None
    value = number(text)
    return None if value is None else Size(value=value)


def to_mm(value: float, unit: str) -> float:
    return half_up(value * {"mm": 1.0, "in": 25.4, "ft": 12.0}[unit] * (25.4 if unit == "ft" else 1.0))


def to_inches(value: float, unit: str) -> float:
    return half_up(value / 25.4 if unit == "mm" else value * (12.0 if unit == "ft" else 1.0))


_known = {d[0]: d for d in vocab.DIAMETERS}


def catalog_pitch(nominal: str) -> str | None:
    return _known[nominal][2] if nominal in _known else None


def diameter(nominal: str) -> dict | None:
    """system, nominal, mm and whether the catalog has it."""
    s = size_of(nominal)
    if s is None or not s.thread or s.pitch is not None:
        return None
    if s.nominal[0] == "M":
        system, mm = "metric", float(s.nominal[1:])
    elif s.nominal[0] == "#":
        system, mm = "number", to_mm(0.06 + 0.013 * float(s.nominal[1:]), "in")
    else:
        inches = number(s.nominal)
        if inches is None:
            return None
        system, mm = "imperial", to_mm(inches, "in")
    return {"system": system, "nominal": s.nominal, "mm": mm, "known": s.nominal in _known} if math.isfinite(mm) else None


def length(size: Size, d: dict | None) -> tuple[dict, str] | None:
    """The length and whether its unit was stated; a whole number takes the diameter's system."""
    if size.value is None:
        return None
    unit, how = size.unit, "explicit"
    if unit is None:
        how = "inferred"
        if not size.value.is_integer():
            unit = "in"
        elif d is None:
            return None
        else:
            unit = "mm" if d["system"] == "metric" else "in"
    mm = to_mm(size.value, unit)
    return ({"value": size.value, "unit": unit, "mm": mm}, how) if math.isfinite(mm) else None


# --- Spelling ---


def osa_distance(a: str, b: str, most: float = math.inf) -> float:
    """Optimal string alignment distance: insert, delete, replace, swap neighbours once.
    Anything beyond `most` comes back as most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[-1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        rows = [*rows[-1:], row]
    return rows[-1][-1] if rows[-1][-1] <= most else most + 1


@cache
def vocabulary() -> tuple[frozenset[str], dict[int, list[str]]]:
    words = frozenset(w for phrase in vocab.lexicon() for w in phrase.split())
    by_size: dict[int, list[str]] = {}
    for w in sorted(words):
        by_size.setdefault(len(w), []).append(w)
    return words, by_size


@cache
def corrected(word: str) -> str | None:
    """The vocabulary word meant by a misspelt one: the nearest, then the longest; None
    if nothing is near, two are equally good, or the word is no candidate."""
    words, by_size = vocabulary()
    if not re.fullmatch("[a-z]{4,64}", word) or word in words or word in vocab.PROTECTED_CODES:
        return None
    most = 2 if len(word) >= 8 else 1
    near: dict[tuple[float, int], list[str]] = {}
    for n in range(len(word) - most, len(word) + most + 1):
        for w in by_size.get(n, ()):
            d = osa_distance(word, w, most)
            if d <= most:
                near.setdefault((d, -n), []).append(w)
    best = near[min(near)] if near else []
    return best[0] if len(best) == 1 else None
