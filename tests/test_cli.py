import pytest
from pyspark.sql import functions as F

from fastenlake.__main__ import demo, evaluation, gated
from fastenlake.operators import display as dp
from fastenlake.operators import matching as mt
from fastenlake.plans.engine import Engine
from fastenlake.sources import tables as st


def test_evaluation_of_a_label_set(spark, tmp_path):
    rows = [("c1", "PXNUT1", "M8 HEX NUT STEEL ZINC", True, 1), ("c2", "PXNUT2", "M8 HEX NUT BRASS PLAIN", True, 2)]
    engine = Engine(st.items(spark.createDataFrame(rows, "catalog_id string, sku string, description string, active boolean, line_no long")), most=2)
    (tmp_path / "cases.jsonl").write_text(
        '{"id":"a","query":"M8 nut","expectedStatus":"ambiguous","expected":["PXNUT1","PXNUT2"],"tags":[]}\n'
        '{"id":"b","query":"M8 nut brass","expectedStatus":"unique","expected":["PXNUT2"],"tags":[]}\n'
        '{"id":"c","query":"M5 nut","expectedStatus":"unique","expected":["PXNUT1"],"tags":[]}\n'
    )
    got = evaluation(engine, st.load_cases(spark, str(tmp_path / "cases.jsonl")))
    assert got["status"].first() == (3, 0.666667)
    assert got["retrieval"].first() == (2, 0.5, 0.5, 0.5)
    assert got["sets"].first() == (1, 1.0, 1.0, 1.0)
    assert got["violations"].first() == (0,)
    assert got["agreement"].collect() == []
    assert got["control retrieval"].first()["cases"] == 2 and got["control status"].first()["cases"] == 3
    assert gated(got, 0.6667, 0, 3) and not gated(got, 0.67, 0, 3) and not gated(got, 0.6, 0, 4)
    (tmp_path / "odd.jsonl").write_text('{"id":"a","query":"M8 nut","customerId":"C9","expectedStatus":"unique","expected":["NONE"],"tags":[]}\n')
    with pytest.raises(ValueError, match="NONE"):
        evaluation(engine, st.load_cases(spark, str(tmp_path / "odd.jsonl")))
    text = demo(Engine(engine.items))
    assert text.count("\n") > len(dp.DEMO) and "10. M14 hex nut" in text and "M14 is not a diameter in this catalog" in text


def test_the_data_folder_is_found_above(tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "catalog.csv").write_text("")
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert st.find_data_dir(str(tmp_path / "a" / "b")) == str(tmp_path / "data")
    with pytest.raises(FileNotFoundError):
        st.find_data_dir("/proc")


def test_within_tolerance(spark):
    rows = spark.createDataFrame([(45.0, 40.0, True), (50.0, 40.0, True), (50.1, 40.0, False), (0.0, 0.0, True), (None, 4.0, None)], "a double, b double, want boolean")
    assert all(r["got"] == r["want"] for r in rows.withColumn("got", mt.within_tolerance(F.col("a"), F.col("b"), 0.25)).collect())
