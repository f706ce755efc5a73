"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`value` is the sum of all seconds.  `requests_per_second` is the throughput of whole
answers (parse, match, rank, explain) for comparison with per-query latencies;
with BENCH_THOUSAND=1, `thousand_skus` is the same for 100,000 requests against a catalog of
1,000 SKUs (its size where the latencies were published), the parse apart.  Each query's
seconds also go to stderr as they are measured."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

QUERIES = ["request_parse", "description_parse", "description_fields", "compatible_set", "posterior_topk", "near_misses", "bm25_scores", "smoothed_shares", "repeat_weights", "history_prior", "order_reference", "match_responses", "match_with_history"]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pyspark.sql import functions as F

    from fastenlake.plans import bridge
    from fastenlake.plans.engine import Engine
    from fastenlake.plans.queries import QUERIES as known
    from fastenlake.plans.stage import kept

    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    small = re.sub(r"sf[0-9.]+/*$", "sf0.001", sf_dir)
    sink(known["match_responses"](spark, small if os.path.isdir(small) else sf_dir))  # compiles code, starts the workers
    seconds = {}
    for name in QUERIES:
        began = time.time()
        sink(known[name](spark, sf_dir))
        seconds[name] = round(time.time() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    answered = bridge.requests(spark, sf_dir).count()
    out = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "requests_per_second": round(answered / seconds["match_responses"], 1)}
    if os.environ.get("BENCH_THOUSAND"):
        engine = Engine(bridge.catalog_items(spark, sf_dir).orderBy("sku").limit(1000))
        engine.prepare()
        many = bridge.requests(spark, sf_dir).drop("request_id").crossJoin(spark.range(-(-100_000 // answered))).limit(100_000).withColumn("request_id", F.monotonically_increasing_id())
        many = kept(many.select("request_id", "query", "customer_id", "limit").repartition(int(cpus)))
        began = time.time()
        sink(engine.parsed(many))
        parsed = time.time()
        sink(engine.match(many))
        whole = time.time() - parsed
        out["thousand_skus"] = {"requests": many.count(), "parse": round(parsed - began, 3), "whole": round(whole, 3), "requests_per_second": round(many.count() / whole, 1)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
