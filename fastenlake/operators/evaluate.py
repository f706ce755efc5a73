"""Quality metrics over outcomes: request_id, intended, expected_status, status, confidence
(of the first), and either skus (the whole ranking) with expected, or what the metrics need
of them, counted by joins: place (of the intended SKU, from 1), first, returned, hits, wanted."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fastenlake import vocab
from fastenlake.operators.lexical import lexical_only
from fastenlake.operators.matching import family, mm_key

DIGITS = 6


def _mean(x: Column) -> Column:
    return F.round(F.coalesce(F.avg(x), F.lit(0.0)), DIGITS)


def intended(top1: Column, expected: Column) -> Column:
    """The SKU a case means: its stated first, else its only expected one."""
    return F.coalesce(top1, F.when(F.size(expected) == 1, F.get(expected, F.lit(0))))


def bad_references(cases: DataFrame, items: DataFrame, customers: DataFrame) -> DataFrame:
    """id, kind, value: labels that name a SKU or customer that doesn't exist."""
    skus = F.array_distinct(F.array_compact(F.concat("expected", F.coalesce("expectedAlternatives", F.array().cast("array<string>")), F.array("expectedTop1"))))
    missing = cases.select("id", F.explode(skus).alias("value")).join(items.select(F.col("sku").alias("value")), "value", "left_anti")
    unknown = cases.where("customerId IS NOT NULL").select("id", F.col("customerId").alias("value")).join(customers.select(F.col("customer_id").alias("value")), "value", "left_anti")
    return missing.select("id", F.lit("sku").alias("kind"), "value").unionByName(unknown.select("id", F.lit("customer").alias("kind"), "value"))


def counted(outcomes: DataFrame) -> DataFrame:
    """Adds place, first, returned, hits, wanted where outcomes have lists (label sets, which are small)."""
    if "place" in outcomes.columns:
        return outcomes
    return outcomes.withColumns({
        "place": F.nullif(F.array_position("skus", F.col("intended")), F.lit(0)), "first": F.get(F.col("skus"), F.lit(0)), "returned": F.size(F.array_distinct("skus")),
        "hits": F.size(F.array_intersect("skus", "expected")), "wanted": F.size(F.array_distinct("expected")),
    })


def retrieval(outcomes: DataFrame) -> DataFrame:
    """cases, hit1, hit3, mrr over the cases with an intended SKU."""
    hit = lambda k: _mean(F.when(F.col("place") <= k, 1.0).otherwise(0.0))
    return counted(outcomes).where("intended IS NOT NULL").agg(F.count(F.lit(1)).alias("cases"), hit(1).alias("hit1"), hit(3).alias("hit3"), _mean(F.coalesce(1 / F.col("place"), F.lit(0.0))).alias("mrr"))


def set_recovery(outcomes: DataFrame) -> DataFrame:
    """cases, precision, recall, exact_rate over ambiguous cases with labels."""
    hits, got, want = F.col("hits"), F.col("returned"), F.col("wanted")
    rate = lambda n: F.when(n > 0, hits / n).otherwise(0.0)
    return counted(outcomes).where("expected_status = 'ambiguous' AND wanted > 0").agg(
        F.count(F.lit(1)).alias("cases"), _mean(rate(got)).alias("precision"), _mean(rate(want)).alias("recall"), _mean(F.when((got == want) & (hits == want), 1.0).otherwise(0.0)).alias("exact_rate")
    )


def alternative_recovery(outcomes: DataFrame) -> DataFrame:
    """cases, recall of labelled alternatives; outcomes with expected_alternatives, offered."""
    return outcomes.where("size(expected_alternatives) > 0").agg(F.count(F.lit(1)).alias("cases"), _mean(F.size(F.filter("expected_alternatives", lambda s: F.array_contains("offered", s))) / F.size("expected_alternatives")).alias("recall"))


def confusion(outcomes: DataFrame) -> DataFrame:
    """expected, actual, cases for every pair of statuses, zeros included."""
    pairs = outcomes.sparkSession.createDataFrame([(e, a) for e in vocab.STATUSES for a in vocab.STATUSES], "expected string, actual string")
    seen = outcomes.groupBy(F.col("expected_status").alias("expected"), F.col("status").alias("actual")).agg(F.count(F.lit(1)).alias("cases"))
    return pairs.join(seen, ["expected", "actual"], "left").na.fill(0, ["cases"])


def accuracy(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count(F.lit(1)).alias("cases"), _mean(F.when(F.col("expected_status") == F.col("status"), 1.0).otherwise(0.0)).alias("accuracy"))


def calibration(outcomes: DataFrame) -> DataFrame:
    """bin, lower, upper, cases, precision (null if empty) of ten confidence bins."""
    scored = counted(outcomes).where("intended IS NOT NULL AND status NOT IN ('history', 'unparsed') AND confidence IS NOT NULL")
    own = F.least(F.lit(9), F.floor(F.col("confidence") * 10)).cast("long")
    right = F.when(F.col("first") == F.col("intended"), 1)
    seen = scored.groupBy(own.alias("bin")).agg(F.count(F.lit(1)).alias("cases"), F.count(right).alias("hits"))
    bins = outcomes.sparkSession.range(10).withColumnRenamed("id", "bin")
    return bins.join(seen, "bin", "left").select("bin", F.round(F.col("bin") / 10, 1).alias("lower"), F.round((F.col("bin") + 1) / 10, 1).alias("upper"), F.coalesce("cases", F.lit(0)).alias("cases"), F.round(F.col("hits") / F.col("cases"), DIGITS).alias("precision"))


def latency(timed: DataFrame) -> DataFrame:
    """cases and nearest-rank percentiles of latency_ms."""
    return timed.agg(F.count(F.lit(1)).alias("cases"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95"))


def personalization(outcomes: DataFrame) -> DataFrame:
    """Hit@1 with and without the customer, and the mean margin of the first over the
    second; outcomes with customer_id, skus, skus_without, confidences."""
    own = outcomes.where("customer_id IS NOT NULL")
    hit = lambda c: _mean(F.when(F.col("intended").isNotNull(), F.when(F.get(F.col(c), F.lit(0)) == F.col("intended"), 1.0).otherwise(0.0)))
    margin = F.get(F.col("confidences"), F.lit(0)) - F.get(F.col("confidences"), F.lit(1))
    return own.agg(F.count(F.lit(1)).alias("cases"), F.count("intended").alias("hit1_cases"), hit("skus").alias("hit1"), hit("skus_without").alias("hit1_without_customer"), _mean(margin).alias("margin"), F.count(margin).alias("margin_cases"))


def violations(results: DataFrame) -> DataFrame:
    """results (request_id, sku, parsed, item_spec) in which a stated attribute is
    contradicted, with the first such attribute."""
    q, i = F.col("parsed"), F.col("item_spec")
    told = lambda a: F.coalesce(F.element_at(q["provenance"], a).isin("explicit", "corrected"), F.lit(False))
    differs = lambda a, b: ~F.coalesce(a == b, F.lit(False))

    def weighted(a: str, table: dict[str, str]) -> Column:
        value, want = i[a]["value"], q[a]["value"]
        return value.isNotNull() & differs(value, want) & differs(F.when(value.isin(*table), family(value, table)), want)

    wrong = {
        "diameter": i["diameter"].isNotNull() & (differs(i["diameter"]["system"], q["diameter"]["system"]) | differs(i["diameter"]["nominal"], q["diameter"]["nominal"])),
        "pitch": i["pitch"].isNotNull() & differs(i["pitch"], q["pitch"]),
        "length": i["length"].isNotNull() & q["length"].isNotNull() & (mm_key(i["length"]["mm"]) != mm_key(q["length"]["mm"])),
        "type": (F.coalesce(F.size(i["type"]), F.lit(0)) > 0) & ~F.coalesce(F.arrays_overlap(i["type"]["value"], q["type"]["value"]), F.lit(False)),
        "material": weighted("material", vocab.MATERIAL_FAMILY), "finish": weighted("finish", vocab.FINISH_FAMILY),
        "standard": i["standard"].isNotNull() & differs(i["standard"], q["standard"]),
    }
    first = F.coalesce(*[F.when(told(a) & w, a) for a, w in wrong.items()])
    return results.withColumn("attribute", first).where("attribute IS NOT NULL").select("request_id", "sku", "attribute")


def gate(measured: DataFrame, floor_accuracy: float, most_violations: int, cases: int) -> DataFrame:
    """One row: whether accuracy (of four digits, as a floor is written), violations and the number of cases (columns of measured) pass."""
    ok = (F.round("accuracy", 4) >= floor_accuracy) & (F.col("violations") <= most_violations) & (F.col("cases") >= cases)
    return measured.withColumn("passes", ok)


def normal_form(text: Column) -> Column:
    """Lower case, letters and digits only: two such labels are one query."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def leaks(one: DataFrame, other: DataFrame) -> DataFrame:
    """Normal forms of queries that both label sets hold."""
    return one.select(normal_form(F.col("query")).alias("form")).intersect(other.select(normal_form(F.col("query")).alias("form")))


def agreement(served: DataFrame, full: DataFrame) -> DataFrame:
    """Requests whose short answer isn't the head of the whole one: request_id, what."""
    j = served.alias("s").join(full.alias("f"), "request_id")
    head = F.slice(F.col("f.skus"), 1, F.greatest(F.size("s.skus"), F.lit(1)))
    what = F.when(F.col("s.status") != F.col("f.status"), "status").when(F.col("s.compatible_count") != F.col("f.compatible_count"), "count").when((F.size("s.skus") > 0) & (head != F.col("s.skus")), "results")
    return j.select("request_id", what.alias("what")).where("what IS NOT NULL")


def control(cases: DataFrame, items: DataFrame, config: vocab.Config = vocab.DEFAULT) -> DataFrame:
    """Outcomes of the lexical control, for retrieval() and accuracy(), with `budgeted`: its
    first as many results as a case has labels, for set_recovery() as skus.

    cases: request_id, query, intended, expected, expected_status."""
    most = max(1, items.count())
    wide = replace(config, max_limit=most)
    answers, hits = lexical_only(cases.select("request_id", "query", F.lit(most).alias("limit")), items, wide)
    ranked = hits.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("rank", "sku", "confidence"))).alias("hits"))
    out = cases.join(answers.select("request_id", "status"), "request_id").join(ranked, "request_id", "left")
    skus = F.coalesce("hits.sku", F.array().cast("array<string>"))
    return out.select(*cases.columns, "status", skus.alias("skus"), F.get("hits.confidence", F.lit(0)).alias("confidence"), F.slice(skus, 1, F.greatest(F.size("expected"), F.lit(1))).alias("budgeted"))


def customer_listing(lines: DataFrame, customer_id: str) -> DataFrame:
    """A customer's lines, newest first, lines of a date in their order."""
    return lines.where(F.col("customer_id") == customer_id).orderBy(F.desc("order_date"), "line_no").select("order_date", "sku", "quantity", "description")


def review_table(cases: DataFrame, items: DataFrame) -> DataFrame:
    """id, query, customer, status, expected (SKU and description), top1 of a label set."""
    known = items.select("sku", "description")
    named = F.concat("sku", F.lit(" — "), F.coalesce("description", F.lit("?")))
    each = cases.select("id", F.posexplode("expected").alias("pos", "sku")).join(known, "sku", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", named.alias("text")))).alias("x"))
    first = cases.select("id", F.col("expectedTop1").alias("sku")).join(known, "sku", "left").select("id", F.when(F.col("sku").isNotNull(), named).alias("top1"))
    return cases.join(each, "id", "left").join(first, "id", "left").select("id", "query", F.col("customerId").alias("customer"), F.col("expectedStatus").alias("status"), F.coalesce(F.array_join("x.text", "<br>"), F.lit("")).alias("expected"), F.coalesce("top1", F.lit("")).alias("top1"))
