import json

import pytest

from fastenlake import vocab
from fastenlake.functions import text as tx
from fastenlake.functions.parse import query_spec, read_description, read_request, register


def brief(q):
    s = read_request(q)
    d, n = s["diameter"], s["length"]
    return {
        "d": d and (d["nominal"] if d["known"] else d["nominal"] + "?"), "pitch": s["pitch"], "len": n and (n["value"], n["unit"], n["mm"]),
        "type": s["type"] and [(t["value"], t["strength"]) for t in s["type"]], "mat": s["material"] and s["material"]["value"], "fin": s["finish"] and s["finish"]["value"],
        "std": s["standard"], "res": s["residue"],
    }


CASES = [
    ("M8 flat washer", {"d": "M8", "pitch": "1.25", "type": [("flat_washer", 1.0)]}),
    ("SHCS 7/16 x 2-1/2", {"d": "7/16", "len": (2.5, "in", 63.5), "type": [("socket_head_cap_screw", 1.0)]}),
    ("1/2 rod 6 foot", {"d": "1/2", "len": (6.0, "ft", 1828.8), "type": [("threaded_rod", 1.0)]}),
    ("HHB 3/4-10 x 5/8", {"d": "3/4", "len": (0.625, "in", 15.875), "type": [("hex_cap_screw", 1.0), ("tap_bolt", 1.0)]}),
    ("M5 x 30 threaded rod", {"d": "M5", "len": (30.0, "mm", 30.0)}),
    ("12 millimeter hex nut", {"d": "M12", "pitch": "1.75", "type": [("hex_nut", 1.0)]}),
    ("M8 x 3/4 hex cap screw", {"d": "M8", "len": (0.75, "in", 19.05)}),
    ("hex nutt", {"type": [("hex_nut", 0.9)]}),
    ("socket haed cap screw", {"type": [("socket_head_cap_screw", 0.9)]}),
    ("M8 hex nut nylon insert", {"d": "M8", "res": ["nylon", "insert"]}),
    ("grade 8 1/2-13 hex nut", {"d": "1/2", "len": None, "res": ["grade", "8"]}),
    ("please quote 200 pcs of M8 x 50 BHCS black oxide", {"d": "M8", "len": (50.0, "mm", 50.0), "fin": "black_oxide", "res": []}),
    ("brass hex nut 1/2-13", {"mat": "brass", "d": "1/2"}),
    ('1/2"', {"d": "1/2", "len": None}),
    ("6 ft", {"d": None, "len": (6.0, "ft", 1828.8), "type": None}),
    ("carriage bolt 3/8", {"d": "3/8", "type": None}),
    ("M14 hex nut", {"d": "M14?"}),
    ("1/2-20 hex nut", {"d": "1/2?", "pitch": "20"}),
    ("#6-32 screw", {"d": "#6?"}),
    ("M6-1 hex nut", {"d": "M6", "pitch": "1.0"}),
    ("din 316 M8 shcs", {"std": "DIN 316", "mat": None, "d": "M8"}),
    ("iso M8 hex nut", {"std": None, "d": "M8"}),
    ("din912 M8 x 20", {"std": "DIN 912", "len": (20.0, "mm", 20.0)}),
    ("no. 8 pan head 1½ inches", {"d": "#8", "len": (1.5, "in", 38.1)}),
    ("1/4x2 lag", {"d": "1/4", "len": (2.0, "in", 50.8)}),
    ("hex nut x 100 pcs M8", {"d": "M8", "len": None}),
    ("M8 shcs x 50 each", {"len": (50.0, "mm", 50.0)}),
    ("stainless washer M8", {"mat": "stainless", "type": [("flat_washer", 0.6), ("lock_washer", 0.6)]}),
    ("", {"d": None, "type": None, "res": []}),
]


@pytest.mark.parametrize(("query", "want"), CASES)
def test_requests(query, want):
    got = brief(query)
    assert {k: got[k] for k in want} == want


def test_evidence_quotes_the_request_and_intent_is_longest():
    s = read_request("Same SOCKET haed cap screw as last time, but in Brass")
    assert s["intent"] == "last time" and s["evidence"]["type"] == "SOCKET haed cap screw"
    assert s["provenance"]["type"] == "corrected" and s["evidence"]["material"] == "Brass"
    assert read_request("wing nut M6")["provenance"]["type"] == "unrecognized"


DESCRIPTIONS = [
    ("1/2-13 X 6FT FULL THREAD ROD STEEL ZINC", ("1/2", "13", 1828.8, "threaded_rod", "steel", "zinc", None)),
    ('1/4-20 X 3/4" HEX CAP SCREW STEEL ZINC', ("1/4", "20", 19.05, "hex_cap_screw", "steel", "zinc", None)),
    ("M8-1.25 x 20MM SHCS DIN 912 A2 SS PLAIN", ("M8", "1.25", 20.0, "socket_head_cap_screw", "ss_a2", "plain", "DIN 912")),
    ("M8 flat wshr 18-8 ss hdg", ("M8", None, None, "flat_washer", "ss_18_8", "hdg", None)),
    ("flat washer steel zinc", None),
    ("M8 X flat washer steel zinc", None),
    ("M8 flat washer zinc", None),
]


@pytest.mark.parametrize(("text", "want"), DESCRIPTIONS)
def test_descriptions(text, want):
    s = read_description(text)
    got = s and (s["diameter"]["nominal"], s["pitch"], s["length"] and s["length"]["mm"], s["type"][0]["value"], s["material"]["value"], s["finish"]["value"], s["standard"])
    assert got == want


@pytest.mark.parametrize(("a", "b", "d"), [("haed", "head", 1), ("ca", "abc", 3), ("", "ab", 2), ("kitten", "sitting", 3), ("nutt", "nut", 1)])
def test_osa(a, b, d):
    assert tx.osa_distance(a, b) == d == tx.osa_distance(b, a)
    assert tx.osa_distance(a, b, d) == d and tx.osa_distance(a, b, d - 1) == d


@pytest.mark.parametrize(("word", "want"), [("wahser", "washer"), ("same", "asme"), ("nut", None), ("zzzzzz", None), ("stanless", "stainless"), ("hdgg", "hdg"), ("brss", "brass")])
def test_corrections(word, want):
    assert tx.corrected(word) == want


def test_cleaning_is_idempotent_and_spans_slice_the_input():
    for q, _ in CASES:
        words, _ = tx.cleaned(q)
        canonical = " ".join(w.text for w in words)
        assert " ".join(w.text for w in tx.cleaned(canonical)[0]) == canonical
        assert all(0 <= w.start < w.end <= len(q) for w in words)
    assert tx.cleaned("please quote 5 pcs")[1] == ["quantityStripped", "noiseStripped"]


def test_units():
    assert tx.to_mm(6, "ft") == 1828.8 and tx.to_mm(0.4375, "in") == 11.1125 and tx.to_inches(25.4, "mm") == 1.0
    assert all(tx.diameter(n)["mm"] == mm and tx.diameter(n)["system"] == s for n, s, _, mm in vocab.DIAMETERS)
    assert tx.number("1/0") is None and tx.number("1-1/2") == 1.5


def test_spark_functions(spark):
    rows = spark.createDataFrame([(q,) for q, _ in CASES] + [(None,)], "q string").select("q", query_spec("q").alias("s")).collect()
    for r in rows:
        assert json.loads(json.dumps(r["s"].asDict(recursive=True))) == read_request(r["q"])
    register(spark)
    assert spark.sql("select osa_distance('haed', 'head') d, correct_token('wahser') c, size(normalize_tokens('2 pcs of M8')) n, parse_description('M8 nut brass plain').material.value m").first() == (1, "washer", 1, "brass")
