"""python -m fastenlake match|customers|profile|eval|demo [FOLDER] ...: the engine from a shell."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fastenlake.operators import display as dp
from fastenlake.operators import evaluate as ev
from fastenlake.operators import history as hs
from fastenlake.operators import profile as pf
from fastenlake.plans.engine import REQUEST, Engine
from fastenlake.plans.stage import kept
from fastenlake.sources.tables import find_data_dir, load_cases, markdown


def evaluation(engine: Engine, cases: DataFrame) -> dict[str, DataFrame]:
    """The metric tables of a label set, by name; outcomes come from whole rankings.

    Labels that name a SKU or customer that doesn't exist are an error.  `agreement` holds
    the requests whose served answer isn't the head of the whole one: it should be empty."""
    none = engine.spark.createDataFrame([], "customer_id string")
    wrong = ev.bad_references(cases, engine.items, none if engine.lines is None else hs.customers(engine.lines)).limit(5).collect()
    if wrong:
        raise ValueError("labels name what doesn't exist: " + "; ".join(f"{r['id']}: {r['kind']} {r['value']}" for r in wrong))
    whole = Engine(engine.items, engine.lines, engine.config, most=max(1, engine.items.count()))
    numbered = kept(cases.withColumn("request_id", F.monotonically_increasing_id()))
    asked = numbered.select("request_id", "query", F.col("customerId").alias("customer_id"), F.lit(whole.most).alias("limit"))
    own = lambda df: df.select("request_id", "status", "compatible_count", "parsed", F.col("results.sku").alias("skus"), F.col("results.confidence").alias("confidences"), F.col("alternatives.sku").alias("offered"))
    full = kept(own(whole.match(asked)))
    served = own(engine.match(asked.withColumn("limit", F.lit(engine.config.default_limit))))
    alone = whole.match(asked.withColumn("customer_id", F.lit(None).cast("string"))).select("request_id", F.col("results.sku").alias("skus_without"))
    named = numbered.select("request_id", "query", F.col("customerId").alias("customer_id"), ev.intended(F.col("expectedTop1"), F.col("expected")).alias("intended"), "expected", F.col("expectedStatus").alias("expected_status"), F.col("expectedAlternatives").alias("expected_alternatives"))
    out = kept(named.drop("query").join(full, "request_id").join(alone, "request_id").withColumn("confidence", F.get("confidences", F.lit(0))))
    shown = full.select("request_id", "parsed", F.explode("skus").alias("sku")).join(engine.items.select("sku", F.col("spec").alias("item_spec")), "sku")
    violations = ev.violations(shown).select("request_id").distinct().agg(F.count(F.lit(1)).alias("violations"))
    lexical = kept(ev.control(named, engine.items, engine.config))
    return {
        "retrieval": ev.retrieval(out), "sets": ev.set_recovery(out), "alternatives": ev.alternative_recovery(out), "status": ev.accuracy(out), "confusion": ev.confusion(out),
        "personalization": ev.personalization(out), "calibration": ev.calibration(out).orderBy("bin"), "violations": violations, "agreement": ev.agreement(served, full),
        "control retrieval": ev.retrieval(lexical), "control sets": ev.set_recovery(lexical.withColumn("skus", F.col("budgeted"))), "control status": ev.accuracy(lexical),
    }


def gated(tables: dict[str, DataFrame], floor: float, violations: int, cases: int) -> bool:
    """Whether a run may pass: accuracy, violations and cases within their bounds, and no disagreement."""
    row = ev.gate(tables["status"].crossJoin(tables["violations"]), floor, violations, cases).first()  # two tables of one row
    return bool(row["passes"]) and tables["agreement"].isEmpty()


def demo(engine: Engine) -> str:
    steps = engine.spark.createDataFrame([(k, *step) for k, step in enumerate(dp.DEMO)], REQUEST)
    return dp.transcript(dp.displayed(engine.match(steps), engine.config).join(steps.select("request_id", "customer_id"), "request_id"))


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("what", choices=["match", "customers", "profile", "eval", "demo"])
    parser.add_argument("folder", nargs="?", help="holds catalog.csv and order_history.csv; `.` or none: the nearest folder data above")
    parser.add_argument("text", nargs="?", help="a request, a search text, or the label set's path")
    parser.add_argument("--customer")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--gate", nargs=3, metavar=("ACCURACY", "VIOLATIONS", "CASES"), help="eval: fail beyond these bounds")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("fastenlake").getOrCreate()
    engine = Engine.from_path(spark, find_data_dir() if args.folder in (None, ".") else args.folder)
    if args.what == "match":
        print(json.dumps(engine.match_one(args.text or "", args.customer, args.limit), indent=1))
    elif args.what == "customers":
        print(markdown(engine.list_customers(args.text)))
    elif args.what == "demo":
        print(demo(engine))
    elif args.what == "profile":
        tables = {"types": pf.types(engine.items), "materials and finishes": pf.material_finish(engine.items), "standards": pf.standards(engine.items), "diameters": pf.diameters(engine.items), "tuples": pf.tuples(engine.items), "customers": pf.history(engine.lines, engine.items), "missing SKUs": pf.missing_skus(engine.lines, engine.items)}
        print("\n\n".join(f"## {k}\n\n{markdown(v)}" for k, v in tables.items()))
    else:
        tables = evaluation(engine, load_cases(spark, args.text))
        print("\n\n".join(f"## {k}\n\n{markdown(v)}" for k, v in tables.items()))
        if args.gate and not gated(tables, float(args.gate[0]), int(args.gate[1]), int(args.gate[2])):
            sys.exit("the gate is closed")


if __name__ == "__main__":
    main()
