"""Requests and descriptions to structured specs.

``read_request`` never fails: what it can't place is residue.  ``read_description``
follows the catalog's grammar and returns None where a text doesn't.  ``query_spec`` and
``description_spec`` are functions of Python: rows come in Arrow batches, and each row is one
call; a worker remembers the last 50,000 texts, so a repeated one costs a look-up.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fastenlake import vocab
from fastenlake.functions import text as tx

_WEIGHTED = "struct<value:string,strength:double>"
SPEC = (
    "struct<diameter:struct<system:string,nominal:string,mm:double,known:boolean>,pitch:string,"
    f"length:struct<value:double,unit:string,mm:double>,type:array<{_WEIGHTED}>,material:{_WEIGHTED},finish:{_WEIGHTED},"
    "standard:string,residue:array<string>,evidence:map<string,string>,provenance:map<string,string>,intent:string>"
)
_DESIGNATOR = r"[a-z]?[0-9]+(?:\.[0-9]+)*[a-z]?"
_GLUED_STANDARD = re.compile(f"({'|'.join(vocab.STANDARD_BODIES)})({_DESIGNATOR})")


@lru_cache(maxsize=8)
def _phrases(config: vocab.Config) -> tuple[dict, int]:
    found = vocab.lexicon(config)
    return found, max(len(p.split()) for p in found)


class _Reading:
    """A request while it is read: which words are spoken for, and by what."""

    def __init__(self, text: str, config: vocab.Config):
        self.text, self.config = text, config
        self.tokens = tx.cleaned(text)[0]
        self.said = [t.text for t in self.tokens]
        fixes = [tx.corrected(w) for w in self.said]
        self.words = [f or w for f, w in zip(fixes, self.said, strict=True)]
        self.factor = [config.fuzzy_strength if f else 1.0 for f in fixes]
        self.taken = [False] * len(self.tokens)
        self.spec: dict = dict.fromkeys(("diameter", "pitch", "length", "type", "material", "finish", "standard"))
        self.evidence: dict[str, str] = {}
        self.provenance: dict[str, str] = {}

    def quote(self, a: int, b: int) -> str:
        return self.text[self.tokens[a].start : self.tokens[b - 1].end]

    def take(self, a: int, b: int, attribute: str | None = None, how: str = "") -> None:
        self.taken[a:b] = [True] * (b - a)
        if attribute:
            self.evidence[attribute], self.provenance[attribute] = self.quote(a, b), how

    def phrases(self, words: list[str], known, most: int):
        """Leftmost longest phrases over words not yet taken, without overlap."""
        i = 0
        while i < len(words):
            for b in range(min(len(words), i + most), i, -1):
                if not any(self.taken[i:b]) and (p := " ".join(words[i:b])) in known:
                    yield p, i, b
                    i = b - 1
                    break
            i += 1

    def intent(self) -> str | None:
        found = []
        for p, a, b in self.phrases(self.said, vocab.INTENT_PHRASES, max(len(p.split()) for p in vocab.INTENT_PHRASES)):
            found.append(p)
            self.take(a, b)
        return max(found, key=len, default=None)

    def standard(self) -> None:
        for i, w in enumerate(self.said):
            m, b = _GLUED_STANDARD.fullmatch(w), i + 1
            body, code = m.groups() if m else (w, None)
            if m is None and w in vocab.STANDARD_BODIES and b < len(self.said) and re.fullmatch(_DESIGNATOR, self.said[b]):
                code, b = self.said[b], b + 1
            if code is None or any(self.taken[i:b]) or ((s := tx.size_of(code)) and s.thread):
                continue
            self.spec["standard"] = f"{body} {code}".upper()
            return self.take(i, b, "standard", "explicit")
        return None

    def attributes(self) -> None:
        known, most = _phrases(self.config)
        for p, a, b in [*self.phrases(self.words, known, most)]:
            attribute, values = known[p]
            if attribute == "unknown":
                if "type" not in self.provenance:
                    self.take(a, b, "type", "unrecognized")
                continue
            if self.spec[attribute] is not None or attribute == "type" and self.provenance.get("type") == "unrecognized":
                continue
            factor = min(self.factor[a:b])
            weighted = [{"value": v, "strength": s * factor} for v, s in values]
            self.spec[attribute] = weighted if attribute == "type" else values[0][0] if attribute == "standard" else weighted[0]
            self.take(a, b, attribute, "corrected" if factor < 1 else "explicit")

    def sizes(self) -> None:
        slots = []  # (size, from, to, unit)
        i = 0
        while i < len(self.words):
            if self.taken[i] or self.words[i] == "x":
                self.taken[i] = True if self.words[i] == "x" else self.taken[i]
                i += 1
                continue
            bare, united = tx.size_of(self.words[i]), None
            unit = i + 1 < len(self.words) and not self.taken[i + 1] and self.words[i + 1] in ("in", "ft", "mm", '"')
            if unit:
                united = tx.size_of(f"{self.words[i]} {self.words[i + 1]}")
            size = bare if bare and bare.thread else united or bare
            if size is None:
                i += 1
                continue
            to = i + 2 if unit and (united or bare.thread) else i + 1
            slots.append((size, i, to, (united.unit if united and not united.thread else None) if size.thread else size.unit))
            i = to
        head = next((k for k, s in enumerate(slots) if s[0].thread), 0)
        rest, reach = slots, None
        if slots and self.head(*slots[head]):
            rest, reach = slots[head + 1 :], slots[head][2]
        for size, a, b, unit in rest:
            free = reach is None or unit is not None or a > 0 and self.words[a - 1] == "x" or all(self.taken[reach:a])
            if not free:
                continue
            if size.thread:
                value = None if size.pitch is not None else tx.number(size.nominal)
                size = tx.Size(value=value, unit=unit)
            found = tx.length(size, self.spec["diameter"])
            if found:
                self.spec["length"] = found[0]
                return self.take(a, b, "length", found[1])
        return None

    def head(self, size: tx.Size, a: int, b: int, unit: str | None) -> bool:
        """Reads a slot as the diameter, if it is one."""
        nominal = size.nominal
        if not size.thread:
            if size.unit == "mm" and size.value.is_integer():
                nominal = f"M{int(size.value)}"
            elif size.unit == "in":
                mm = tx.to_mm(size.value, "in")
                nominal = next((d[0] for d in vocab.DIAMETERS if d[1] == "imperial" and d[3] == mm), None)
        d = tx.diameter(nominal) if nominal else None
        if d is None:
            return False
        pitch = tx.catalog_pitch(nominal)
        if size.pitch is None:
            if pitch is not None:
                self.provenance["pitch"] = "inferred"
        else:
            self.evidence["pitch"], self.provenance["pitch"] = size.pitch, "explicit"
            if pitch is None or float(pitch) != float(size.pitch):
                d, pitch = {**d, "known": False}, size.pitch
        self.spec["diameter"], self.spec["pitch"] = d, pitch
        self.take(a, b, "diameter", "explicit" if size.thread else "inferred")
        return True

    def result(self, intent: str | None) -> dict:
        residue = [w for w, t in zip(self.said, self.taken, strict=True) if not t]
        return {**self.spec, "residue": residue, "evidence": self.evidence, "provenance": self.provenance, "intent": intent}


@lru_cache(maxsize=50_000)
def read_request(text: str | None, config: vocab.Config = vocab.DEFAULT) -> dict:
    """The request's spec; its words are read as: intent, standard code, lexicon, sizes."""
    reading = _Reading(text or "", config)
    intent = reading.intent()
    reading.standard()
    reading.attributes()
    reading.sizes()
    return reading.result(intent)


@lru_cache(maxsize=50_000)
def read_description(text: str | None) -> dict | None:
    """The spec of a catalog description, or None if it doesn't follow the grammar."""
    r = _Reading.__new__(_Reading)
    r.text, r.config, r.tokens = text or "", vocab.DEFAULT, tx.cleaned(text or "")[0]
    r.said = r.words = [t.text for t in r.tokens]
    r.taken, r.evidence, r.provenance = [False] * len(r.words), {}, {}
    size = tx.size_of(r.words[0]) if r.words else None
    d = tx.diameter(size.nominal) if size and size.thread else None
    if d is None:
        return None
    spec: dict = {"diameter": d, "pitch": size.pitch, "length": None, "type": None, "material": None, "finish": None, "standard": None}
    r.take(0, 1, "diameter", "explicit")
    if r.words[1:2] == ["x"]:
        measure = tx.size_of(r.words[2]) if len(r.words) > 2 else None
        found = tx.length(measure, d) if measure else None
        if found is None:
            return None
        spec["length"] = found[0]
        r.take(1, 3)
        r.take(2, 3, "length", found[1])
    known, most = _phrases(vocab.DEFAULT)
    covered = list(r.taken)
    for p, a, b in [*r.phrases(r.words, known, most)]:
        attribute, values = known[p]
        covered[a:b] = [True] * (b - a)
        if attribute == "unknown" or spec[attribute] is not None:
            continue
        weighted = [{"value": v, "strength": s} for v, s in values]
        spec[attribute] = weighted if attribute == "type" else values[0][0] if attribute == "standard" else weighted[0]
        r.take(a, b, attribute, "explicit")
    if any(spec[a] is None for a in ("type", "material", "finish")):
        return None
    residue = [w for w, t in zip(r.words, covered, strict=True) if not t]
    return {**spec, "residue": residue, "evidence": r.evidence, "provenance": r.provenance, "intent": None}


def spec_type() -> T.StructType:
    return T._parse_datatype_string(SPEC)


def query_spec(query: Column | str, config: vocab.Config = vocab.DEFAULT) -> Column:
    return F.udf(lambda q: read_request(q, config), spec_type(), useArrow=True)(query)


def description_spec(description: Column | str) -> Column:
    """Null where the description doesn't parse."""
    return F.udf(lambda d: read_description(d), spec_type(), useArrow=True)(description)


def lexical_tokens(text: Column | str, correct: bool = False) -> Column:
    """The cleaned words of a text, misspelt ones put right on demand."""

    def run(s: str | None) -> list[str]:
        words = [t.text for t in tx.cleaned(s or "")[0]]
        return [tx.corrected(w) or w for w in words] if correct else words

    return F.udf(run, T.ArrayType(T.StringType()), useArrow=True)(text)


def register(spark: SparkSession) -> None:
    """SQL names for the custom functions."""
    spark.udf.register("parse_query", F.udf(read_request, spec_type(), useArrow=True))
    spark.udf.register("parse_description", F.udf(read_description, spec_type(), useArrow=True))
    spark.udf.register("osa_distance", F.udf(lambda a, b: None if a is None or b is None else int(tx.osa_distance(a, b)), T.IntegerType(), useArrow=True))
    spark.udf.register("correct_token", F.udf(lambda w: tx.corrected(w) if w else None, T.StringType(), useArrow=True))
    spark.udf.register("normalize_tokens", F.udf(lambda s: [t.text for t in tx.cleaned(s or "")[0]], T.ArrayType(T.StringType()), useArrow=True))
