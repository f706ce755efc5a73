import os

from fastenlake.plans.engine import REQUEST, Engine
from fastenlake.plans.stage import folder, scope
from fastenlake.sources import tables as st
from fastenlake.streaming.answers import answer_stream


def test_stream_answers_each_request_once(spark, tmp_path):
    rows = [("c1", "PXNUT1", "M8 HEX NUT STEEL ZINC", True, 1), ("c2", "PXNUT2", "M8 HEX NUT BRASS PLAIN", True, 2)]
    engine = Engine(st.items(spark.createDataFrame(rows, "catalog_id string, sku string, description string, active boolean, line_no long")))
    source = str(tmp_path / "in")

    def add(*asked):
        spark.createDataFrame(asked, REQUEST).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(REQUEST).parquet(source)
        answer_stream(engine, stream, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(120)
        return {r["request_id"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert add((1, "M8 nut", None, None), (2, "M8 nut brass", None, None)) == {1: "ambiguous", 2: "unique"}
    assert add((3, "M5 nut", None, None)) == {1: "ambiguous", 2: "unique", 3: "none"}


def test_answers_leave_no_stage_table_behind(spark, tmp_path):
    rows = [("c1", "PXNUT1", "M8 HEX NUT STEEL ZINC", True, 1)]
    engine = Engine(st.items(spark.createDataFrame(rows, "catalog_id string, sku string, description string, active boolean, line_no long")))
    engine.prepare()
    root = folder(spark).removeprefix("file:")
    before = sorted(os.listdir(root))
    for i in range(3):
        with scope():
            engine.match(spark.createDataFrame([(i, "M8 nut", None, None)], REQUEST)).write.parquet(str(tmp_path / f"out{i}"))
    assert engine.match_one("M8 nut")["status"] == "unique"
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "steel", None, None)], REQUEST).write.parquet(source)
    answer_stream(engine, spark.readStream.schema(REQUEST).parquet(source), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1 and sorted(os.listdir(root)) == before
