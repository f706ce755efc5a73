"""Profiles of the catalog and the history, and the native reading of descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fastenlake import vocab

#: How descriptions write materials and finishes
MATERIAL_TEXTS = {"ALLOY": "alloy", "STEEL": "steel", "18-8 SS": "ss_18_8", "316 SS": "ss_316", "A2 SS": "ss_a2", "BRASS": "brass"}
FINISH_TEXTS = {"YELLOW ZINC": "yellow_zinc", "YEL ZINC": "yellow_zinc", "YELLOW ZN": "yellow_zinc", "YEL ZN": "yellow_zinc", "MECH ZINC": "mech_zinc", "MECH ZN": "mech_zinc", "ZINC": "zinc", "ZN": "zinc", "HDG": "hdg", "PLAIN": "plain", "PLN": "plain", "BLACK OXIDE": "black_oxide", "BLK OXIDE": "black_oxide"}


def half_up(x: Column, scale: float = 1e4) -> Column:
    return F.floor(x * scale + 0.5).cast("double") / scale


def to_mm(value: Column, unit: Column) -> Column:
    return half_up(value * F.when(unit == "in", 25.4).when(unit == "ft", 12 * 25.4).when(unit == "mm", 1.0))


def to_inches(value: Column, unit: Column) -> Column:
    return half_up(F.when(unit == "in", value).when(unit == "ft", value * 12).when(unit == "mm", value / 25.4))


def number(text: Column) -> Column:
    """`2`, `2.5`, `3/4`, `1-1/2` as a double; null for anything else or a zero denominator."""
    part = lambda i: F.regexp_extract(text, r"^(?:(\d+)-)?(\d+)/(\d+)$", i)
    top = lambda i: F.expr("0D") + F.coalesce(F.nullif(part(i), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), text.cast("double")).when(text.rlike(r"^(?:\d+-)?\d+/\d+$"), top(1) + F.try_divide(top(2), top(3)))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def description_fields(rows: DataFrame) -> DataFrame:
    """Adds nominal, pitch, length, unit, mm, type_phrase, standard, material, finish, read
    natively: the description ends in its first material and a finish, begins with the
    diameter, and may go on with a length.  All are null where it doesn't follow that."""
    text = F.upper(F.regexp_replace(F.trim("description"), r"\s+", " "))
    materials, finishes = "|".join(MATERIAL_TEXTS), "|".join(FINISH_TEXTS)
    tail = f"^((?:(?!{materials}).)*)({materials}) ?({finishes})$"
    head = r'^(#\d+|M\d+|\d+(?:-\d+/\d+|/\d+)?)(?:-([\d.]+))? ?(?:X ?(\d+(?:-\d+/\d+)?(?:/\d+)?) ?(MM|FT|IN|")?)? ?(.*?) ?$'
    code = r"^(|.* )([A-Z]{3,4} [A-Z]?\d[\w.]*)$"
    out = rows.withColumns({"__text": text})
    out = out.withColumns({"__front": F.regexp_extract("__text", tail, 1), "__material": F.regexp_extract("__text", tail, 2), "__finish": F.regexp_extract("__text", tail, 3)})
    group = lambda i: F.nullif(F.regexp_extract("__front", head, i), F.lit(""))
    told = F.when(group(4) == '"', "in").otherwise(F.lower(group(4)))
    # without a unit: millimetres for whole numbers behind a metric diameter, else inches
    unit = F.when(group(3).isNotNull(), F.coalesce(told, F.when(group(1).startswith("M") & ~group(3).contains("/"), "mm").otherwise("in")))
    out = out.withColumns({"nominal": group(1), "pitch": group(2), "length": group(3), "unit": unit, "__rest": F.regexp_extract("__front", head, 5)})
    whole = F.col("nominal").isNotNull()
    return out.withColumns({
        "mm": to_mm(number(F.col("length")), F.col("unit")), "material": F.when(whole, _lookup(MATERIAL_TEXTS, F.col("__material"))), "finish": F.when(whole, _lookup(FINISH_TEXTS, F.col("__finish"))),
        "standard": F.nullif(F.regexp_extract("__rest", code, 2), F.lit("")),
        "type_phrase": F.when(whole, F.when(F.col("__rest").rlike(code), F.trim(F.regexp_extract("__rest", code, 1))).otherwise(F.col("__rest"))),
    }).drop("__text", "__front", "__rest", "__material", "__finish")


def sku_codes(rows: DataFrame) -> DataFrame:
    """Adds type, material, finish as the SKU's codes say."""
    kinds = sorted(vocab.SKU_TYPES, key=len, reverse=True)
    m, f = "|".join(vocab.SKU_MATERIALS), "|".join(vocab.SKU_FINISHES)
    whole = f"^PX({'|'.join(kinds)})[0-9]+?({m})({f})[0-9]*$"
    return rows.withColumns({"type": _lookup(vocab.SKU_TYPES, F.regexp_extract("sku", f"^PX({'|'.join(kinds)})", 1)), "material": _lookup(vocab.SKU_MATERIALS, F.regexp_extract("sku", whole, 2)), "finish": _lookup(vocab.SKU_FINISHES, F.regexp_extract("sku", whole, 3))})


def counts(catalog: DataFrame) -> DataFrame:
    off = ~F.col("active")
    return catalog.agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("sku").alias("skus"), (F.count(F.lit(1)) - F.countDistinct("sku")).alias("duplicates"),
        F.count(F.when(off, 1)).alias("inactive_rows"), F.countDistinct(F.when(off, F.col("sku"))).alias("inactive_skus"), F.count(F.when(F.col("description") == F.lower("description"), 1)).alias("lower_case"),
    )


def types(items: DataFrame) -> DataFrame:
    return items.groupBy(F.col("i_type").alias("type")).agg(F.count(F.lit(1)).alias("skus"), F.count("i_mm").alias("with_length"), F.count("i_standard").alias("with_standard"), F.countDistinct("i_nominal").alias("diameters"))


def material_finish(items: DataFrame) -> DataFrame:
    return items.groupBy(F.col("i_material").alias("material"), F.col("i_finish").alias("finish")).agg(F.count(F.lit(1)).alias("skus"))


def standards(items: DataFrame) -> DataFrame:
    return items.groupBy(F.col("i_standard").alias("standard")).agg(F.count(F.lit(1)).alias("skus"))


def diameters(items: DataFrame) -> DataFrame:
    return items.groupBy(F.col("i_system").alias("system"), F.col("i_nominal").alias("nominal"), F.col("i_pitch").alias("pitch")).agg(F.count(F.lit(1)).alias("skus"))


def tuples(items: DataFrame) -> DataFrame:
    """How far the attributes tell items apart."""
    each = items.groupBy("i_nominal", "i_type", "i_mm", "i_material", "i_finish", "i_standard").agg(F.count(F.lit(1)).alias("c"))
    return each.agg(F.count(F.lit(1)).alias("tuples"), F.count(F.when(F.col("c") == 1, 1)).alias("unique_tuples"), F.max("c").alias("most"))


def phrases(rows: DataFrame) -> DataFrame:
    """Type phrases of description_fields() with their counts."""
    return rows.groupBy("type_phrase").agg(F.count(F.lit(1)).alias("rows"))


def forms(rows: DataFrame) -> DataFrame:
    """letters (upper, lower, mixed), spaced (outer or double blanks), unit, separator, rows:
    how descriptions are written."""
    d = F.col("description")
    letters = F.when(d == F.upper(d), "upper").when(d == F.lower(d), "lower").otherwise("mixed")
    unit = F.when(d.rlike(r'\d"'), '"').when(d.rlike(r"(?i)\d ?mm\b"), "mm").when(d.rlike(r"(?i)\d ?ft\b"), "ft").when(d.rlike(r"(?i)\d ?in\b"), "in").otherwise("none")
    return rows.groupBy(letters.alias("letters"), (d.rlike("  ") | (d != F.trim(d))).alias("spaced"), unit.alias("unit"), d.rlike("(?i) x ").alias("separator")).agg(F.count(F.lit(1)).alias("rows"))


def lengths(items: DataFrame) -> DataFrame:
    """type, mm, skus of the items that have a length."""
    return items.where("i_mm IS NOT NULL").groupBy(F.col("i_type").alias("type"), F.col("i_mm").alias("mm")).agg(F.count(F.lit(1)).alias("skus"))


def history(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Per customer: lines, dates, skus, repeats, metric_share, inactive_skus."""
    off = items.where("NOT active").select("sku", F.lit(True).alias("off"))
    joined = lines.join(off, "sku", "left")
    return joined.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("order_date").alias("dates"), F.countDistinct("sku").alias("skus"), (F.count(F.lit(1)) - F.countDistinct("sku")).alias("repeats"),
        F.round(F.avg(F.when(F.col("spec.diameter.system") == "metric", 1.0).otherwise(0.0)), 6).alias("metric_share"), F.countDistinct(F.when(F.col("off"), F.col("sku"))).alias("inactive_skus"),
    )


def missing_skus(lines: DataFrame, items: DataFrame) -> DataFrame:
    """SKUs ordered that the catalog lacks."""
    return lines.select("sku").distinct().join(items.select("sku"), "sku", "left_anti")


def anchors(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """name, observed, expected, verdict of two (name, value) tables."""
    joined = expected.withColumnRenamed("value", "expected").join(observed.withColumnRenamed("value", "observed"), "name", "left")
    return joined.withColumn("verdict", F.when(F.col("observed").eqNullSafe(F.col("expected")), "match").otherwise("differs"))


def narrowed(items: DataFrame, nominal: str | None = None, types: list[str] | None = None, mm: float | None = None, materials: list[str] | None = None, finishes: list[str] | None = None, standard: str | None = None) -> DataFrame:
    """Active items by any of these attributes (lengths within a thousandth of a millimetre)."""
    tests = [(nominal, lambda: F.col("i_nominal") == nominal), (types, lambda: F.col("i_type").isin(*types)), (mm, lambda: F.abs(F.col("i_mm") - mm) <= 0.001), (materials, lambda: F.col("i_material").isin(*materials)), (finishes, lambda: F.col("i_finish").isin(*finishes)), (standard, lambda: F.col("i_standard") == standard)]
    out = items.where("active")
    for given, test in tests:
        out = out if given is None else out.where(test())
    return out.orderBy("sku")
