"""The physical plans that the design counts on."""

import os

import pytest

from fastenlake.functions.parse import query_spec
from fastenlake.operators import history as hs
from fastenlake.operators import lexical as lx
from fastenlake.operators import matching as mt
from fastenlake.plans.engine import REQUEST, Engine
from fastenlake.plans.queries import QUERIES
from fastenlake.sources import tables as st

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_wildcard_join_is_an_equi_join_without_a_hot_key(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(mt, "SPLIT", 10)
    rows = [(f"c{i}", f"S{i}", f"M8 HEX NUT {m} PLAIN", True, i) for i, m in enumerate(["STEEL", "BRASS"] * 40)]
    items = st.items(spark.createDataFrame(rows, "catalog_id string, sku string, description string, active boolean, line_no long")).cache()
    asked = spark.createDataFrame([(1, "M8 nut", None, 3), (2, "brass", None, 3), (3, "M8", None, 3), (4, "nut steel", None, 3)], REQUEST).withColumn("spec", query_spec("query"))
    joined = mt.met(mt.classes(mt.flat(asked)), items)
    assert "SortMergeJoin" in plan(joined) and "Cartesian" not in plan(joined) and "NestedLoop" not in plan(joined)
    assert joined.groupBy("class_key").count().collect() and {r["count"] for r in joined.groupBy("class_key").count().collect()} == {80}
    assert {r["key"]: r["salts"] for r in mt.salts(mt.item_keys(items)).collect()} == dict.fromkeys(["M8|hex_nut", "M8|*", "*|hex_nut", "*|*"], 8)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([("C1", "n", "2026-01-01", "S", "M8 HEX NUT STEEL PLAIN", 1.0, 1)], "customer_id string, customer_name string, order_date string, sku string, description string, quantity double, line_no long").write.parquet(path)
    lines = spark.read.parquet(path)
    text = plan(hs.customers(lines).where("customer_id = 'C1'").select("customer_id", "order_count"))
    assert "EqualTo(customer_id,C1)" in text and "ReadSchema: struct<customer_id:string>" in text


def test_sums_are_combined_before_the_exchange(spark):
    lines = spark.createDataFrame([("C1", "n", "2026-01-01", "S", "d", 1.0, 1)], "customer_id string, customer_name string, order_date string, sku string, description string, quantity double, line_no long")
    text = plan(hs.latest_date(lines))
    assert "partial_max" in text


def test_the_control_scores_equal_texts_once(spark, no_broadcast):
    rows = [(f"c{i}", f"S{i:03}", f"M8 HEX NUT {'STEEL' if i < 60 else 'BRASS'} PLAIN", True, i) for i in range(61)]
    items = st.items(spark.createDataFrame(rows, "catalog_id string, sku string, description string, active boolean, line_no long"))
    made = []

    def keep(df):
        made.append(df.cache())
        return made[-1]

    answers, hits = lx.lexical_only(spark.createDataFrame([(1, "steel nut", None, 3), (2, "brass nut", None, 3), (3, "brass", None, 3)], REQUEST), items, keep=keep)
    assert sorted(answers.select("request_id", "compatible_count", "status").collect()) == [(1, 61, "ambiguous"), (2, 61, "unique"), (3, 1, "unique")]
    assert sorted((r["sku"], r["rank"]) for r in hits.where("request_id = 1").collect()) == [("S000", 1), ("S001", 2), ("S002", 3)]
    assert max(df.count() for df in made) <= 10


def test_classes_meet_kinds_of_items(spark, monkeypatch):
    rows = [(f"c{i}", f"S{i:03}", f"M8 HEX NUT {m} PLAIN", True, i) for i, m in enumerate(["STEEL", "BRASS", "BRASS"] * 20)]
    items = st.items(spark.createDataFrame(rows, "catalog_id string, sku string, description string, active boolean, line_no long"))
    joined, judged = [], mt.judged
    monkeypatch.setattr(mt, "judged", lambda df, *c: joined.append(df.count()) or judged(df, *c))
    asked = spark.createDataFrame([(1, "M8 nut", None, 3), (2, "brass", None, 2), (3, "M8 brass nut din 912", None, 4), (4, "M8 nut", None, 5)], REQUEST)
    got = {r["request_id"]: r for r in Engine(items).match(asked).collect()}
    assert joined == [6]  # 3 classes, 2 kinds
    assert [(r["status"], r["compatible_count"]) for _, r in sorted(got.items())] == [("ambiguous", 60), ("unparsed", 40), ("none", 0), ("ambiguous", 60)]
    skus = {k: [x["sku"] for x in r["results"] or r["alternatives"]] for k, r in got.items()}
    assert skus == {1: ["S000", "S001", "S002"], 2: ["S001", "S002"], 3: ["S001", "S002", "S004", "S005"], 4: ["S000", "S001", "S002", "S003", "S004"]}
    assert got[1]["disambiguate_by"] == ["material"]


def test_lists_of_a_kind_are_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(mt, "CHUNK", 10)
    listed = spark.range(205).selectExpr("if(id < 5, 'a', 'b') AS kind", "concat('S', id) AS sku")
    made = mt.lists(listed).collect()
    assert sorted(s for r in made for s in r["skus"]) == sorted(f"S{i}" for i in range(205))
    assert len(made) > 15 and max(len(r["skus"]) for r in made) <= 30


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["match_responses", "display_sentences"])
def test_the_generated_code_of_whole_answers_compiles(spark, name):
    """Code that is too long costs the driver hundreds of MB before it falls back."""
    key = "spark.sql.codegen.fallback"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        assert QUERIES[name](spark, FOLDER).count() > 0
    finally:
        spark.conf.set(key, before)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_whole_answers_are_planned_in_parts(spark):
    assert "collect_list" not in plan(QUERIES["match_responses"](spark, FOLDER))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pairs_are_listed_without_an_exchange_of_kinds(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(mt, "PAIRS", 100)
    made = QUERIES["compatible_set"](spark, FOLDER)
    assert "SortMergeJoin" not in plan(made) and plan(made).count("Exchange RoundRobin") == 1
    assert made.rdd.getNumPartitions() == -(-made.count() // 100)
