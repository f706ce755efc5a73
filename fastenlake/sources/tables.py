"""Catalog, order history and label sets from CSV, JSON lines or plain DataFrames, and report sinks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fastenlake import vocab
from fastenlake.functions.parse import description_spec
from fastenlake.operators.matching import family

CATALOG = "catalog_id string, sku string, catalog_description string, active string"
HISTORY = "customer_id string, customer_name string, order_date string, sku string, catalog_description string, quantity string"
CASES = "id string, query string, customerId string, expectedStatus string, expected array<string>, expectedTop1 string, expectedAlternatives array<string>, tags array<string>, rationale string"


def find_data_dir(start: str = ".") -> str:
    """The nearest folder `data` with a catalog.csv, in a local folder or above it."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / "data" / "catalog.csv").is_file():
            return str(folder / "data")
    raise FileNotFoundError(f"no data/catalog.csv in {here} or above it")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with a header; doubled quotes and line ends inside cells; a missing cell
    is the empty string.  `line_no` restates the file's order."""
    raw = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)
    return raw.na.fill("").withColumn("line_no", F.monotonically_increasing_id())


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def with_spec(df: DataFrame, text: str = "description") -> DataFrame:
    """df with the spec of its descriptions (null where one doesn't parse)."""
    return df.withColumn("spec", description_spec(text))


def items(catalog: DataFrame) -> DataFrame:
    """catalog (catalog_id, sku, description, active boolean, line_no) to parsed items:
    the first row of each SKU, with the flat attribute columns that joins use."""
    parsed = with_spec(first_by(catalog, ["sku"], [F.col("line_no")]))
    s = F.col("spec")
    return parsed.select(
        "catalog_id", "sku", "description", "active", "spec",
        s["diameter"]["system"].alias("i_system"), s["diameter"]["nominal"].alias("i_nominal"), s["pitch"].alias("i_pitch"),
        s["length"]["mm"].alias("i_mm"), s["type"][0]["value"].alias("i_type"), F.coalesce(s["type"]["value"], F.array().cast("array<string>")).alias("i_types"),
        s["material"]["value"].alias("i_material"), family(s["material"]["value"], vocab.MATERIAL_FAMILY).alias("i_material_family"),
        s["finish"]["value"].alias("i_finish"), family(s["finish"]["value"], vocab.FINISH_FAMILY).alias("i_finish_family"), s["standard"].alias("i_standard"),
    )


def unparsable(parsed: DataFrame) -> DataFrame:
    """The rows whose description doesn't follow the grammar; a load should have none."""
    return parsed.where("spec IS NULL").select("catalog_id", "sku", "description")


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, CATALOG)
    found = items(raw.select("catalog_id", "sku", F.col("catalog_description").alias("description"), (F.col("active") == "Y").alias("active"), "line_no"))
    bad = unparsable(found).limit(1).collect()
    if bad:
        raise ValueError(f"cannot read the catalog row {bad[0]['description']!r}")
    return found


def load_history(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, HISTORY)
    return history_lines(raw.select("customer_id", "customer_name", "order_date", "sku", F.col("catalog_description").alias("description"), F.expr("coalesce(try_cast(nullif(trim(quantity), '') AS double), 0D)").alias("quantity"), "line_no"))


def history_lines(lines: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """Order lines with their parsed specs; line_no orders lines of one date.  Each distinct
    description is parsed once.  specs: description and spec of all of them, if known."""
    specs = with_spec(lines.select("description").distinct()) if specs is None else specs
    return lines.join(specs, lines["description"].eqNullSafe(specs["description"]), "left").drop(specs["description"])


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """A label set of JSON lines.  Unknown fields are an error, naming the first."""
    known = {c.split()[0] for c in CASES.split(", ")}
    raw = spark.read.text(path).where(F.trim("value") != "")
    odd = raw.select(F.explode(F.json_object_keys("value")).alias("field")).where(~F.col("field").isin(*known)).limit(1).collect()
    if odd:
        raise ValueError(f"unknown field {odd[0]['field']!r}")
    return spark.read.schema(CASES).option("mode", "FAILFAST").json(raw.select("value").rdd.map(lambda r: r[0]))


def write_report(df: DataFrame, path: str, kind: str = "json", digits: int = 4) -> None:
    """A metrics table as JSON lines, CSV or Parquet, doubles rounded."""
    rounded = df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    rounded.coalesce(1).write.mode("overwrite").format(kind).save(path)


def markdown(df: DataFrame) -> str:
    """A small table (a report's) as a Markdown table."""
    rows = df.collect()
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.4f}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])
