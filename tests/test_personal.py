"""Lists of every compatible item: what is exchanged for them, and what of a large history is met."""

import datetime
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from fastenlake.operators import history as hs
from fastenlake.plans import bridge as br
from fastenlake.plans import queries as qs
from fastenlake.plans.stage import kept
from fastenlake.sources import tables as st

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def own(spark):
    return qs._personal(spark, FOLDER)


@pytest.fixture
def large(spark):
    """Only what is marked is broadcast, as with large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffles(df):
    return re.findall(r"(?<!Broadcast)Exchange \w+", df._jdf.queryExecution().executedPlan().toString())


def test_no_exchange_holds_a_row_of_each_kind_or_item(own, large):
    rows = own.by_kind()
    assert not shuffles(rows) and not shuffles(own.every(rows, "prior"))


def test_a_stage_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, began = files(), time.time()
    made = kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    while files() - before and time.time() - began < 10:
        time.sleep(0.2)
    assert not files() - before
    assert made.count() == 7


def test_a_history_in_numbers_says_the_same(spark, own):
    m = qs._Matched(spark, FOLDER)
    lines = kept(hs.slim(br.history_with_specs(spark, FOLDER)))
    whole = hs.Customers.of(lines, m.items, keep=kept)
    flat = lambda df: sorted(map(str, df.withColumn("repeat", F.round("repeat", 9)).collect()))
    met = own.asked.select("request_id", "customer_id", "class_key").join(whole.purchases, "customer_id").join(own.listed, "sku")
    met = met.join(own.fits.select("class_key", "kind"), ["class_key", "kind"]).select(*own.own.columns)
    assert flat(own.own) == flat(met) and own.own.count() > 0
    assert sorted(own.known.siblings.collect()) == sorted(whole.siblings.collect())
    assert sorted(own.known.preferences.collect()) == sorted(whole.preferences.collect())
    assert own.known.purchases.count() < whole.purchases.count()


def test_reasons_are_made_beside_kinds_without_an_exchange(own, large):
    rows = own.by_kind(own.preferred())
    assert not shuffles(hs.reasoned(rows))
    asked = own.asked.select("request_id", "customer_id")
    told = hs.preferring(asked, own.known, among=own.cells()).drop("customer_id")
    assert sorted(own.preferred().collect()) == sorted(told.select(own.preferred().columns).collect())


def test_materials_bought_on_the_same_dates_tie_in_any_order_of_lines(spark):
    ages = [508, 780, 461, 484]  # whose weights' sum is larger by an ulp or two from the other end
    bought = [("C1", "BRASS", a) for a in ages] + [("C1", "STEEL", a) for a in ages[::-1]]
    bought += [("C2", m, a) for _, m, a in bought[::-1]] + [("C3", "ALLOY", 0)]
    date = lambda a: str(datetime.date(2026, 1, 1) - datetime.timedelta(a))
    rows = [(c, c, date(a), f"S{m}", f"M8 HEX NUT {m} PLAIN", 1.0, i) for i, (c, m, a) in enumerate(bought)]
    raw = spark.createDataFrame(rows, "customer_id string, customer_name string, order_date string, sku string, description string, quantity double, line_no long").coalesce(1)
    full = kept(hs.profiled_shares(st.history_lines(raw)))
    for r in full.where("customer_id <> 'C3'").collect():
        assert r["share_material"]["brass"] == r["share_material"]["steel"] > r["share_material"]["alloy"]
    assert {r["customer_id"]: r["material"] for r in hs.preferences(full).collect()} == {"C1": "brass", "C2": "brass", "C3": "alloy"}
