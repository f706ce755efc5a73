"""Whole answers over a small catalog: statuses, priors, references, relaxations, notes."""

import math

import pytest
from pyspark.sql import functions as F

from fastenlake import vocab
from fastenlake.operators import evaluate as ev
from fastenlake.operators import history as hs
from fastenlake.operators import lexical as lx
from fastenlake.operators import matching as mt
from fastenlake.plans.engine import REQUEST, Engine
from fastenlake.sources import tables as st

CATALOG = [
    # sku, description, active
    ("PXWASH812A2YZ0016", "M8 FLAT WASHER A2 SS YELLOW ZINC", True),
    ("PXWASH816A2BO0624", "M8 FLAT WASHER A2 SS BLACK OXIDE", True),
    ("PXWASH82536HG0974", "M8 FLAT WASHER 316 SS HDG", True),
    ("PXWASH825STYZ0009", "M8 FLAT WASHER STEEL YELLOW ZINC", True),
    ("PXWASH830BRZC0520", "M8 FLAT WASHER BRASS ZINC", True),
    ("PXWASH850BRPL0440", "M8 FLAT WASHER BRASS PLAIN", True),
    ("PXWASH88088PL0688", "M8 FLAT WASHER 18-8 SS PLAIN", True),
    ("PXWASH8OLD", "M8 FLAT WASHER STEEL PLAIN", False),
    ("PXSOC820", "M8-1.25 X 20MM SHCS DIN 912 STEEL BLACK OXIDE", True),
    ("PXSOC840", "M8-1.25 X 40MM SHCS DIN 912 STEEL BLACK OXIDE", True),
    ("PXSOC850", "M8-1.25 X 50MM SHCS STEEL ZINC", True),
    ("PXSOC8100", "M8-1.25 X 100MM SHCS STEEL ZINC", True),
    ("PXNUT121", "1/2-13 HEX NUT BRASS PLAIN", True),
    ("PXNUT122", "1/2-13 HEX NUT 18-8 SS PLAIN", True),
    ("PXHEX141", '1/4-20 X 3/4" HEX CAP SCREW STEEL ZINC', True),
    ("PXTAP141", '1/4-20 X 3/4" TAP BOLT STEEL ZINC', True),
]
LINES = [
    ("C1", "Acme", "2026-01-01", "PXWASH88088PL0688", "M8 FLAT WASHER 18-8 SS PLAIN", 100.0),
    ("C1", "Acme", "2026-04-25", "PXWASH88088PL0688", "M8 FLAT WASHER 18-8 SS PLAIN", 250.0),
    ("C1", "Acme", "2025-10-27", "PXNUT121", "1/2-13 HEX NUT BRASS PLAIN", 30.0),
    ("C1", "Acme", "2025-12-01", "PXGONE", "M10 LOCK WASHER STEEL ZINC", 5.0),
    ("C2", "Bolt Co", "2026-02-01", "PXWASH8OLD", "M8 FLAT WASHER STEEL PLAIN", 10.0),
    ("C2", "Bolt Co", "2026-02-02", "PXBAD", "no such thing", 10.0),
    ("C3", "Cap Inc", "2026-02-02", "PXBAD", "no such thing", 1.0),
]


@pytest.fixture(scope="module")
def items(spark):
    rows = [(f"c{i}", s, d, a, i) for i, (s, d, a) in enumerate(CATALOG)] + [("dup", "PXNUT121", "1/2-13 HEX NUT STEEL ZINC", False, 99)]
    return st.items(spark.createDataFrame(rows, "catalog_id string, sku string, description string, active boolean, line_no long")).cache()


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(*r, i) for i, r in enumerate(LINES)]
    return st.history_lines(spark.createDataFrame(rows, "customer_id string, customer_name string, order_date string, sku string, description string, quantity double, line_no long")).cache()


ASKED = [
    ("M8 flat washer", None, None), ("M8 flat washer", "C1", None), ("1/2-13 hex nut brass", None, None), ("carriage bolt 1/2", None, None), ("stainless", None, None),
    ("same washer as last time", "C1", None), ("same washer but brass", "C1", None), ("M8 x 45mm SHCS", None, None), ("reorder", None, None), ("reorder hdg", None, None), ("zinc stuff", None, None), ("M14 nut", None, None),
    ("M8 flat washer", "C2", None), ("same M8 lock washer as last time", "C1", None), ("M8 flat washer x 20 mm", None, None), ("1/2 hex nut brass inox foo", "C9", None), ("M8 flat washer brass", "C1", None), ("M8 x 3/4 shcs", None, 10),
    ("brass hdg", None, None), ("M8 SHCS DIN 912 x 50", None, None), ("usual", "C3", None), ("1/4 hex bolt", None, 1),
]


@pytest.fixture(scope="module")
def answers(spark, items, lines):
    engine = Engine(items, lines)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ASKED)], REQUEST)
    return {(r["query"], ASKED[r["request_id"]][1]): r for r in engine.match(df).collect()}


def skus(r):
    return [x["sku"] for x in r["results"]]


def notes(r):
    return [n["code"] for n in r["notes"]]


def test_seven_way_tie(answers):
    r = answers["M8 flat washer", None]
    assert (r["status"], r["compatible_count"]) == ("ambiguous", 7)
    assert [round(x["confidence"], 2) for x in r["results"]] == [0.14] * 3 and skus(r) == [s for s, *_ in CATALOG[:3]]
    assert notes(r) == ["tiedSet"] and r["disambiguate_by"] == ["material", "finish"]
    assert all(x["label"] == "Low" for x in r["results"])


def test_unique_and_residue(answers):
    r = answers["1/2-13 hex nut brass", None]
    assert r["status"] == "unique" and skus(r) == ["PXNUT121"] and r["results"][0]["confidence"] == pytest.approx(0.98) and r["results"][0]["label"] == "High"
    assert [(m["attr"], m["query"], m["item"], m["provenance"], m["partial"]) for m in r["results"][0]["matched"]] == [("diameter", "1/2-13", "1/2-13", "explicit", False), ("type", "hex nut", "hex nut", "explicit", False), ("material", "brass", "brass", "explicit", False)]
    assert r["results"][0]["unspecified"] == ["finish"]
    r = answers["1/2 hex nut brass inox foo", "C9"]
    assert r["results"][0]["confidence"] == pytest.approx(0.8448, abs=1e-4) and notes(r) == ["unverifiedResidue"]  # inox, foo


@pytest.mark.parametrize(("residue", "want"), [(0, 0.98), (1, 0.9423), (2, 0.8448), (3, 0.6447)])
def test_posterior_anchors(spark, residue, want):
    assert spark.range(1).select(mt.posterior(F.lit(1.0), F.lit(1.0), F.lit(residue))).first()[0] == pytest.approx(want, abs=1e-4)


def test_nothing_fits(answers):
    assert notes(answers["carriage bolt 1/2", None]) == ["unknownType"] and answers["carriage bolt 1/2", None]["status"] == "none"
    assert answers["M14 nut", None]["notes"][0]["message"] == "M14 is not a diameter in this catalog"
    r = answers["M8 x 45mm SHCS", None]
    assert r["status"] == "none" and r["notes"][0]["message"] == "no M8 socket head cap screw at 45 mm"
    assert [(x["sku"], x["closeness"], x["relaxed"]) for x in r["alternatives"]] == [("PXSOC840", pytest.approx(2 / 3), ["length"]), ("PXSOC850", pytest.approx(2 / 3), ["length"])]
    r = answers["M8 x 3/4 shcs", None]
    assert notes(r)[0] == "unitMismatch" and [x["sku"] for x in r["alternatives"]] == ["PXSOC820"]
    assert answers["brass hdg", None]["notes"][0]["message"] == "no brass item in hot-dip galvanized"
    r = answers["M8 SHCS DIN 912 x 50", None]
    assert r["notes"][0]["message"] == "no M8 socket head cap screw to DIN 912" and [x["sku"] for x in r["alternatives"]] == ["PXSOC850"] and r["alternatives"][0]["relaxed"] == ["standard"]


def test_words_only(answers):
    r = answers["stainless", None]
    assert r["status"] == "unparsed" and r["compatible_count"] == 5 and notes(r) == ["unrankedPool"] and skus(r) == []
    r = answers["zinc stuff", None]
    assert r["status"] == "unparsed" and r["results"][0]["confidence"] == pytest.approx(0.4) and notes(r) == ["unverifiedResidue"]


def test_length_that_no_washer_bears(answers):
    r = answers["M8 flat washer x 20 mm", None]
    assert r["compatible_count"] == 7 and notes(r) == ["tiedSet", "unboundLength"] and r["parsed"]["length"]["mm"] == 20.0
    assert r["notes"][1]["message"] == "a flat washer carries no length; 20 mm ignored"


def test_history_moves_the_first_place(answers):
    r = answers["M8 flat washer", "C1"]
    assert skus(r)[0] == "PXWASH88088PL0688" and r["compatible_count"] == 7
    assert r["results"][0]["reason"] == "bought 2x, last 2026-04-25" and notes(r) == []
    r = answers["M8 flat washer brass", "C1"]
    assert r["results"][0]["reason"] == "history prefers 18-8 SS plain; overridden by the query" and r["results"][0]["overriddenBy"] == ["material"]
    r = answers["M8 flat washer", "C2"]
    assert skus(r)[0] == "PXWASH825STYZ0009" and r["results"][0]["reason"] == "shares diameter, type and material family with PXWASH8OLD" and notes(r) == ["discontinued"]


def test_references(answers):
    r = answers["same washer as last time", "C1"]
    assert r["status"] == "history" and [(x["sku"], x["confidence"], x["reason"]) for x in r["results"]] == [("PXWASH88088PL0688", pytest.approx(0.7), "ordered 250 on 2026-04-25")]
    r = answers["same washer but brass", "C1"]
    assert r["status"] == "unique" and skus(r) == ["PXWASH850BRPL0440"] and r["notes"][-1]["message"] == "based on your 2026-04-25 order, material changed to brass"
    assert [x["sku"] for x in r["alternatives"]] == []
    assert notes(answers["reorder", None]) == ["customerRequired"] and answers["reorder", None]["status"] == "history"
    r = answers["reorder hdg", None]
    assert r["status"] == "unparsed" and notes(r) == ["customerRequired"]
    r = answers["same M8 lock washer as last time", "C1"]
    assert r["status"] == "none" and "historyReference" in notes(r)
    assert notes(answers["usual", "C3"])[-1] == "historyReference" and answers["usual", "C3"]["status"] == "unparsed"


def test_near_misses_fill_up(answers):
    r = answers["1/4 hex bolt", None]
    assert r["status"] == "ambiguous" and r["compatible_count"] == 2 and len(r["results"]) == 1 and r["alternatives"] == []
    assert all(m["partial"] for x in r["results"] for m in x["matched"] if m["attr"] == "type")


def test_laws(spark, items, lines, answers):
    engine = Engine(items, lines, most=100)
    df = spark.createDataFrame([(i, q, c, 100) for i, (q, c, _) in enumerate(ASKED)], REQUEST)
    full = {r["request_id"]: r for r in engine.match(df).collect()}
    for i, (q, c, _) in enumerate(ASKED):
        r, served = full[i], answers[q, c]
        assert (r["status"], r["compatible_count"]) == (served["status"], served["compatible_count"])
        assert skus(r)[: len(skus(served))] == skus(served)
        if r["status"] in ("unique", "ambiguous"):
            p = math.fsum(x["confidence"] for x in r["results"])
            null = 0.02 * 3 ** len(r["parsed"]["residue"])
            q_s = math.fsum(x["prior"] * x["compatibility"] for x in r["results"])
            assert len(r["results"]) == r["compatible_count"] and p + null / (0.98 * q_s + null) == pytest.approx(1, abs=1e-9)
            assert math.fsum(x["prior"] for x in r["results"]) == pytest.approx(1)
    asked = spark.createDataFrame([(i, *r) for i, r in enumerate(ASKED)], REQUEST)
    results = engine.match(asked).select("request_id", "parsed", F.explode("results.sku").alias("sku")).join(items.select("sku", F.col("spec").alias("item_spec")), "sku")
    assert {r["request_id"] for r in ev.violations(results).collect()} <= {5}  # a pure reference shows what was ordered


def test_requests_are_validated(spark, items):
    engine = Engine(items)
    df = spark.createDataFrame([(1, "  ", None, 3), (2, "M8 flat washer ", " ", 0), (3, " M8 flat washer", "", 2), (4, None, None, None), (5, "nut", None, 11)], REQUEST)
    assert [(r["request_id"], len(r["results"])) for r in engine.match(df).collect()] == [(3, 2)]
    assert engine.match_one("hex nut brass")["status"] == "unique"
    with pytest.raises(ValueError):
        engine.match_one(" ")


def test_profiles(lines, items):
    p = {r["customer_id"]: r for r in hs.profiles(lines).collect()}
    n = math.exp(-114 / 180) + 1 + math.exp(-180 / 180) + math.exp(-145 / 180)
    assert p["C1"]["n_eff"] == pytest.approx(n) and p["C1"]["lambda"] == pytest.approx(n / (n + 5)) and p["C3"]["n_eff"] == 0
    s = {(r["customer_id"], r["attribute"], r["value"]): r["share"] for r in hs.shares(lines).collect()}
    assert s["C1", "material", "brass"] == pytest.approx((math.exp(-1) + 1) / (n + 6)) and s["C3", "finish", "zinc"] == pytest.approx(1 / 6)
    assert sorted((r["sku"], r["message"].split()[-1]) for r in hs.warnings(lines, items).collect()) == [("PXBAD", 'thing"'), ("PXBAD", 'thing"'), ("PXGONE", "catalog")]


def test_customers(spark, items, lines):
    engine = Engine(items, lines)
    assert [r["customer_id"] for r in engine.list_customers(" C ").collect()] == ["C1", "C2", "C3"]
    assert [r["customer_id"] for r in engine.list_customers("bolt").collect()] == ["C2"]
    assert [r["customer_id"] for r in engine.list_customers("inc").collect()] == ["C3"]
    assert engine.list_customers().count() == 3 and engine.list_customers("zz").count() == 0


def test_lexical_control(spark, items):
    df = spark.createDataFrame([(1, "M8 flat wahser brass plain", None, 3), (2, "qqq", None, 3)], REQUEST)
    answers, hits = lx.lexical_only(df, items)
    got = {r["request_id"]: r for r in answers.collect()}
    assert got[1]["status"] == "unique" and got[2]["status"] == "none" and got[2]["residue"] == ["qqq"]
    first = hits.where("rank = 1").first()
    assert first["sku"] == "PXWASH850BRPL0440" and first["confidence"] == pytest.approx(0.4)


def test_config_changes_take_effect(spark, items):
    config = vocab.Config(backoff=("dropLength",), epsilon=0.5)
    r = Engine(items, config=config).match_one("M8 x 45mm SHCS")
    assert [x["sku"] for x in r["alternatives"]] == ["PXSOC840", "PXSOC850", "PXSOC820"]
    assert Engine(items, config=config).match_one("1/2-13 hex nut brass")["results"][0]["confidence"] == pytest.approx(0.5)


def test_metrics(spark):
    rows = [
        (1, "a", ["a"], "unique", "unique", ["a", "b"], 0.95), (2, "c", ["c", "d"], "ambiguous", "ambiguous", ["d", "c"], 0.3),
        (3, None, ["x", "y"], "ambiguous", "none", [], None), (4, "q", ["q"], "unique", "unparsed", ["z"], 1.0),
    ]
    df = spark.createDataFrame(rows, "request_id long, intended string, expected array<string>, expected_status string, status string, skus array<string>, confidence double")
    assert ev.retrieval(df).first() == (3, 0.333333, 0.666667, 0.5)
    assert ev.set_recovery(df).first() == (2, 0.5, 0.5, 0.5)
    assert ev.accuracy(df).first() == (4, 0.5)
    assert {(r["expected"], r["actual"]): r["cases"] for r in ev.confusion(df).collect() if r["cases"]} == {("unique", "unique"): 1, ("ambiguous", "ambiguous"): 1, ("ambiguous", "none"): 1, ("unique", "unparsed"): 1}
    bins = {r["bin"]: (r["cases"], r["precision"]) for r in ev.calibration(df).collect()}
    assert bins[9] == (1, 1.0) and bins[3] == (1, 0.0) and bins[0] == (0, None) and len(bins) == 10
    timed = spark.createDataFrame([(float(i),) for i in range(1, 21)], "latency_ms double")
    assert ev.latency(timed).first() == (20, 10.0, 19.0)
    one, other = (spark.createDataFrame([(q,)], "query string") for q in ("M8 nut!", "m8-NUT"))
    assert ev.leaks(one, other).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "catalog.csv").write_text('catalog_id,sku,catalog_description,active\n1,A,"1/4-20 X 3/4"" HEX CAP SCREW STEEL ZINC",Y\n2,A,M8 HEX NUT STEEL ZINC,Y\n3,B,m8 hex nut steel zinc,N\n')
    (tmp_path / "order_history.csv").write_text("customer_id,customer_name,order_date,sku,catalog_description,quantity\nC1,Acme,2026-01-01,B,M8 HEX NUT STEEL ZINC,7\nC1,Acme,2026-01-02,B,M8 HEX NUT STEEL ZINC,\n")
    engine = Engine.from_path(spark, str(tmp_path))
    assert sorted((r["sku"], r["i_mm"], r["active"]) for r in engine.items.collect()) == [("A", 19.05, True), ("B", None, False)]
    assert sorted(r["quantity"] for r in engine.lines.collect()) == [0.0, 7.0]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "catalog.csv").write_text("catalog_id,sku,catalog_description,active\n1,A,gibberish,Y\n")
    with pytest.raises(ValueError, match="gibberish"):
        st.load_catalog(spark, str(tmp_path / "bad" / "catalog.csv"))
    (tmp_path / "cases.jsonl").write_text('{"id":"1","query":"nut","expectedStatus":"unique","expected":["A"]}\n\n')
    assert st.load_cases(spark, str(tmp_path / "cases.jsonl")).first()["expected"] == ["A"]
    (tmp_path / "odd.jsonl").write_text('{"id":"1","query":"nut","colour":"red"}\n')
    with pytest.raises(ValueError, match="colour"):
        st.load_cases(spark, str(tmp_path / "odd.jsonl"))
    st.write_report(ev.accuracy(spark.createDataFrame([("a", "a")], "expected_status string, status string")), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["accuracy"] == 1.0
    assert st.markdown(spark.createDataFrame([(1, 0.5)], "n int, x double")) == "| n | x |\n| --- | --- |\n| 1 | 0.5000 |"
