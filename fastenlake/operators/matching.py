"""Requests against the catalog: constraints, the wildcard join, status, credits,
posterior, relaxations.

Everything up to the personal prior depends only on a request's *spec class*, the
attributes it states; requests are first reduced to their distinct classes.  A class
meets the items by equal keys ``diameter|type`` in which an unstated side is ``*``; an
item carries all of its keys, so the wildcard predicate is an equi-join.  A key of more than
SPLIT items is dealt over as many salts as it has SPLITs, by a count of the items; classes
ask for every salt of their keys.  All other constraints are residual predicates on the joined rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fastenlake import vocab

#: The most items under one salt of a key
SPLIT = 10_000
RESIDUAL = ["length", "standard", "material", "finish"]
#: Columns of a class
CLASS = ["q_nominal", "q_system", "q_known", "q_pitch", "q_types", "q_barred", "q_mm", "q_standard", "q_material", "q_material_strength", "q_finish", "q_finish_strength", "q_residue"]


def family(value: Column, table: dict[str, str]) -> Column:
    """The family of a value; a family name is its own."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[value], value)


def mm_key(mm: Column) -> Column:
    """Millimetres as whole thousandths: lengths are equal if these are."""
    return F.floor(mm * 1000 + 0.5)


def within_tolerance(candidate: Column, stated: Column, tolerance: float) -> Column:
    """Lengths in millimetres at most `tolerance` (a share of the stated one) apart."""
    return F.abs(candidate - stated) <= F.abs(stated) * tolerance


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def flat(requests: DataFrame, spec: str = "spec") -> DataFrame:
    """requests with the class columns of their specs and class_key."""
    s = F.col(spec)
    out = requests.withColumns({
        "q_nominal": s["diameter"]["nominal"], "q_system": s["diameter"]["system"], "q_known": s["diameter"]["known"], "q_pitch": s["pitch"],
        "q_types": F.coalesce(s["type"], F.array().cast("array<struct<value:string,strength:double>>")),
        "q_barred": yes(F.element_at(s["provenance"], "type") == "unrecognized"),
        "q_mm": s["length"]["mm"], "q_standard": s["standard"], "q_material": s["material"]["value"], "q_material_strength": s["material"]["strength"],
        "q_finish": s["finish"]["value"], "q_finish_strength": s["finish"]["strength"], "q_residue": F.size(s["residue"]),
    })
    return out.withColumn("class_key", F.to_json(F.struct(*CLASS)))


def classes(flattened: DataFrame) -> DataFrame:
    """One row per distinct spec class."""
    return flattened.groupBy("class_key").agg(*[F.first(c).alias(c) for c in CLASS])


def numbered(flattened: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """flattened with a number for class_key; keep: stores the classes, so that numbers stay."""
    found = keep(flattened.select("class_key").distinct().withColumn("class_id", F.monotonically_increasing_id()))
    return flattened.join(found, "class_key").drop("class_key").withColumnRenamed("class_id", "class_key")


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A stored table, marked to be broadcast where a count finds few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# --- Kinds of items ---

#: All that matching reads of an item
KIND = ["i_system", "i_nominal", "i_pitch", "i_mm", "i_type", "i_types", "i_material", "i_material_family", "i_finish", "i_finish_family", "i_standard"]


def _kind_key() -> Column:
    return F.to_json(F.struct(*KIND))


def kinds(items: DataFrame) -> DataFrame:
    """One row for the active items that are alike in KIND: sku (the least of theirs, which
    names the kind), n, active.  Classes meet kinds; items come in where they are listed."""
    alike = items.where("active").withColumn("kind_key", _kind_key()).groupBy("kind_key")
    return alike.agg(*[F.first(c).alias(c) for c in KIND], F.min("sku").alias("sku"), F.count(F.lit(1)).alias("n")).withColumn("active", F.lit(True))


def members(items: DataFrame, alike: DataFrame) -> DataFrame:
    """kind, sku of the active items."""
    own = items.where("active").select("sku", _kind_key().alias("kind_key"))
    return own.join(alike.select("kind_key", F.col("sku").alias("kind")), "kind_key").select("kind", "sku")


#: The most items in one list of a kind
CHUNK = 1_000


def lists(listed: DataFrame) -> DataFrame:
    """kind, skus: members in lists, so that what lists a kind's items meets few rows."""
    part = listed.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    dealt = listed.join(part, "kind").withColumn("part", F.pmod(F.xxhash64("sku"), F.col("parts")))
    return dealt.groupBy("kind", "part").agg(F.collect_list("sku").alias("skus")).drop("part")


def first_members(best: DataFrame, listed: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """best: the first `most` kinds (sku) of each key.  Among their members are the first
    `most` items, since alike items follow each other by SKU; returns these, with kind and rank."""
    firsts = top(listed, ["kind"], [F.asc("sku")], most).drop("rank")
    return top(best.drop("rank").withColumnRenamed("sku", "kind").join(firsts, "kind"), keys, order, most)


#: The most pairs that one task lists, if requests are alike
PAIRS = 20_000_000


def pairs(asked: DataFrame, fits: DataFrame, skus: DataFrame) -> DataFrame:
    """request_id, sku of every compatible item; asked: request_id, class_key, fits: class_key, kind, n
    (stored), skus: lists().  Requests are dealt out by the number of pairs there will be, and
    meet kinds and lists where they are, so no exchange holds a row of each kind or item."""
    per = asked.groupBy("class_key").agg(F.count(F.lit(1)).alias("requests")).join(fits.groupBy("class_key").agg(F.sum("n").alias("n")), "class_key")
    many = per.agg(F.sum(F.col("requests") * F.col("n"))).first()[0] or 0
    parts = max(asked.sparkSession.sparkContext.defaultParallelism, -(-many // PAIRS))
    met = asked.repartition(parts).join(small(fits.select("class_key", "kind"), 1_000_000), "class_key").select("request_id", "kind")
    return met.join(skus, "kind").select("request_id", F.explode("skus").alias("sku"))


# --- Length binding ---


def length_bearing_types(items: DataFrame) -> DataFrame:
    """The product types of which an active item has a length (ten rows at most)."""
    return items.where("active AND i_mm IS NOT NULL").select(F.explode("i_types").alias("type")).distinct()


def bind_length(requests: DataFrame, items: DataFrame, spec: str = "spec") -> DataFrame:
    """Lifts a stated length off specs no reading of whose type bears one; `unbound` keeps it."""
    bearing = length_bearing_types(items).agg(F.collect_set("type").alias("bearing"))
    s = F.col(spec)
    lifts = s["length"].isNotNull() & (F.size(F.coalesce(s["type"], F.array().cast("array<struct<value:string,strength:double>>"))) > 0) & ~F.arrays_overlap(s["type"]["value"], "bearing")
    return (
        requests.crossJoin(F.broadcast(bearing))  # one row
        .withColumn("unbound", F.when(yes(lifts), s["length"]))
        .withColumn(spec, F.when(F.col("unbound").isNotNull(), s.withField("length", F.lit(None).cast("struct<value:double,unit:string,mm:double>"))).otherwise(s))
        .drop("bearing")
    )


# --- Constraints, each a Column over the columns of a class and of an item ---


def constraints(config: vocab.Config = vocab.DEFAULT, drop_standard: bool = False, widen: bool = False, length: str = "exact") -> dict[str, Column]:
    """attribute -> holds (true where the class doesn't state it), in probing order."""
    c = F.col
    within = {"exact": mm_key(c("i_mm")) == mm_key(c("q_mm")), "approximate": within_tolerance(c("i_mm"), c("q_mm"), config.length_tolerance), "drop": F.lit(True)}[length]

    def by_family(a: str, table: dict[str, str]) -> Column:
        own = c(f"i_{a}_family")
        wide = own == family(c(f"q_{a}"), table) if widen else (own == c(f"q_{a}")) & ~c(f"q_{a}").isin(*table)
        return c(f"q_{a}").isNull() | yes(c(f"i_{a}").isin(*table) & ((c(f"i_{a}") == c(f"q_{a}")) | wide))

    return {
        "diameter": c("q_nominal").isNull() | yes(c("q_known") & (c("i_nominal") == c("q_nominal")) & (c("i_system") == c("q_system"))),
        "type": ~c("q_barred") & ((F.size("q_types") == 0) | yes(F.arrays_overlap(c("q_types")["value"], "i_types"))),
        "length": F.lit(True) if length == "drop" else c("q_mm").isNull() | yes(within),
        "standard": F.lit(True) if drop_standard else c("q_standard").isNull() | yes(c("i_standard") == c("q_standard")),
        "material": by_family("material", vocab.MATERIAL_FAMILY),
        "finish": by_family("finish", vocab.FINISH_FAMILY),
    }


def all_of(holds: dict[str, Column], names: list[str] = RESIDUAL) -> Column:
    return reduce(lambda a, b: a & b, [holds[n] for n in names])


def stated_count() -> Column:
    """How many constraints a class has."""
    given = [F.col("q_nominal").isNotNull(), F.col("q_barred") | (F.size("q_types") > 0), F.col("q_mm").isNotNull(), F.col("q_standard").isNotNull(), F.col("q_material").isNotNull(), F.col("q_finish").isNotNull()]
    return reduce(lambda a, b: a + b, [g.cast("int") for g in given])


# --- The wildcard join ---


def item_keys(items: DataFrame) -> DataFrame:
    """Active items, one row for each key they answer to."""
    d, t = F.coalesce("i_nominal", F.lit("?")), F.explode(F.when(F.size("i_types") == 0, F.array(F.lit("?"))).otherwise(F.col("i_types")))
    each = items.where("active").withColumn("__t", t)
    keys = F.array(F.concat_ws("|", d, "__t"), F.concat_ws("|", d, F.lit("*")), F.concat_ws("|", F.lit("*"), "__t"), F.lit("*|*"))
    return each.withColumn("key", F.explode(keys)).drop("__t").dropDuplicates(["sku", "key"])


def class_keys(found: DataFrame) -> DataFrame:
    """Classes, one row for each key they ask for; impossible ones ask for none."""
    d = F.coalesce("q_nominal", F.lit("*"))
    by_type = F.transform(F.array_distinct(F.col("q_types")["value"]), lambda t: F.concat_ws("|", d, t))
    keys = F.when(F.size("q_types") == 0, F.array(F.concat_ws("|", d, F.lit("*")))).otherwise(by_type)
    possible = ~F.col("q_barred") & F.coalesce("q_known", F.lit(True))
    return found.where(possible).withColumn("key", F.explode(keys))


def salts(keyed: DataFrame) -> DataFrame:
    """key, salts of the keys with more than SPLIT items: fewer than four per SPLIT of the catalog's item rows."""
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT).select("key", F.ceil(F.col("n") / SPLIT).cast("int").alias("salts"))


def met(found: DataFrame, items: DataFrame) -> DataFrame:
    """(class, item) rows in which diameter and type agree."""
    keyed = item_keys(items)
    hot, many = salts(keyed), F.coalesce("salts", F.lit(1))
    there = keyed.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("sku"), many).cast("int")).drop("salts")
    asked = class_keys(found).join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("salts")
    return asked.join(there, ["key", "salt"]).drop("key", "salt").where(constraints()["diameter"])


# --- Judging a joined row ---


def _relaxations(config: vocab.Config) -> list[tuple[dict, Column, list[tuple[str, Column]]]]:
    """Per step of config.backoff: constraint options so far, whether the class opens
    anything by it, and the attributes it then names as relaxed."""
    stated = lambda c: F.col(c).isNotNull()
    families = [(a, _widens(a, t)) for a, t in (("material", vocab.MATERIAL_FAMILY), ("finish", vocab.FINISH_FAMILY))]
    kinds = {
        "standard": ({"drop_standard": True}, stated("q_standard"), [("standard", stated("q_standard"))]),
        "materialFinishFamily": ({"widen": True}, families[0][1] | families[1][1], families),
        "approximateLength": ({"length": "approximate"}, stated("q_mm"), [("length", stated("q_mm"))]),
        "dropLength": ({"length": "drop"}, stated("q_mm"), [("length", stated("q_mm"))]),
    }
    options: dict = {}
    return [(options := options | kinds[step][0], *kinds[step][1:]) for step in config.backoff]


def judged(joined: DataFrame, config: vocab.Config = vocab.DEFAULT) -> DataFrame:
    """Adds `failing` (index of the first residual constraint that fails, 4 if none),
    `credit` (the compatibility), and `step` (the first relaxation that admits it, 0: none needed)."""
    exact = constraints(config)
    failing = reduce(lambda rest, i: F.when(~exact[RESIDUAL[i]], i).otherwise(rest), range(3, -1, -1), F.lit(4))
    admits = [F.when(F.col("failing") == 4, F.lit(0))]
    admits += [F.when(opened & all_of(constraints(config, **options)), F.lit(k)) for k, (options, opened, _) in enumerate(_relaxations(config), 1)]
    return joined.withColumn("failing", failing).withColumn("step", F.coalesce(*admits)).withColumn("credit", credit(config))


def _widens(attribute: str, table: dict[str, str]) -> Column:
    """The stated value has siblings in its family."""
    alike = [v for v in table if list(table.values()).count(table[v]) > 1]
    return yes(F.col(f"q_{attribute}").isin(*alike))


def credit(config: vocab.Config = vocab.DEFAULT) -> Column:
    """Product of the six attribute credits; 0 where one contradicts."""
    c = F.col
    reading = F.array_max(F.transform(F.filter("q_types", lambda t: F.array_contains("i_types", t["value"])), lambda t: t["strength"]))

    def weighted(a: str, table: dict[str, str]) -> Column:
        share = F.when(c(f"i_{a}") == c(f"q_{a}"), 1.0).when(yes(c(f"i_{a}_family") == c(f"q_{a}")), config.family_credit).otherwise(0.0)
        return F.when(c(f"q_{a}").isNull(), 1.0).otherwise(c(f"q_{a}_strength") * share)

    one = lambda ok: F.when(ok, 1.0).otherwise(0.0)
    return (
        one(c("q_nominal").isNull() | yes(c("q_nominal") == c("i_nominal")))
        * F.when(F.size("q_types") == 0, 1.0).otherwise(F.coalesce(reading, F.lit(0.0)))
        * one(c("q_mm").isNull() | yes(mm_key(c("i_mm")) == mm_key(c("q_mm"))))
        * weighted("material", vocab.MATERIAL_FAMILY) * weighted("finish", vocab.FINISH_FAMILY)
        * one(c("q_standard").isNull() | yes(c("i_standard") == c("q_standard")))
    )


def compatible(rows: DataFrame) -> DataFrame:
    """The judged rows in which every constraint holds."""
    return rows.where("failing = 4")


#: attribute -> what tells items apart by it
KEYS = {
    "diameter": "concat_ws(':', i_system, i_nominal)",
    "pitch": "coalesce(i_pitch, '')", "length": "coalesce(cast(floor(i_mm * 1000 + 0.5) as string), '')", "type": "array_join(i_types, ',')",
    "material": "coalesce(i_material, '')", "finish": "coalesce(i_finish, '')", "standard": "coalesce(i_standard, '')",
}


def summary(found: DataFrame, rows: DataFrame, items: DataFrame) -> DataFrame:
    """Per class: compatible_count, failed, disambiguate_by, tied inputs, relax step; rows: of kinds.

    Counts and extremes only, so each class is combined before the exchange."""
    ok = F.col("failing") == 4
    differ = [F.when(F.min(F.when(ok, F.expr(k))) != F.max(F.when(ok, F.expr(k))), F.lit(a)) for a, k in KEYS.items()]
    per = rows.groupBy("class_key").agg(
        F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("compatible_count"), F.max("failing").alias("worst"),
        F.sum(F.when(ok, F.col("credit") * F.col("n"))).alias("credit_sum"), F.min(F.when(ok, F.col("credit"))).alias("credit_min"), F.max(F.when(ok, F.col("credit"))).alias("credit_max"),
        F.min(F.when(~ok, F.col("step"))).alias("relax_step"), F.array_compact(F.array(*differ)).alias("disambiguate_by"),
    )
    have = items.where("active").select(F.col("i_nominal").alias("q_nominal")).distinct().withColumn("stocked", F.lit(True))
    some = items.where("active").select(F.lit(True).alias("any_active")).limit(1)
    joined = found.join(per, "class_key", "left").join(have, "q_nominal", "left").join(F.broadcast(some), F.lit(True), "left")
    failed = (
        F.when(F.col("any_active").isNull(), None)
        .when(F.col("q_nominal").isNotNull() & ~(F.col("q_known") & F.coalesce("stocked", F.lit(False))), "diameter")
        .when(F.col("worst").isNull(), "type")
        .otherwise(F.array(*[F.lit(a) for a in RESIDUAL])[F.col("worst")])
    )
    n = F.coalesce("compatible_count", F.lit(0)).cast("long")
    bare = F.col("q_nominal").isNull() & (F.size("q_types") == 0)
    return joined.select(
        *found.columns, n.alias("compatible_count"), F.when(n == 0, failed).alias("failed"),
        F.when(n > 1, F.col("disambiguate_by")).otherwise(F.array().cast("array<string>")).alias("disambiguate_by"),
        "credit_sum", "credit_min", "credit_max", "relax_step",
        F.when(n == 0, "none").when(bare, "unparsed").when(n == 1, "unique").otherwise("ambiguous").alias("status"), bare.alias("bare"),
    )


# --- Posterior ---


def posterior(weight: Column, total: Column, residue: Column, config: vocab.Config = vocab.DEFAULT) -> Column:
    """weight: prior times credit; total: its sum over the compatible set."""
    return (1 - config.epsilon) * weight / ((1 - config.epsilon) * total + config.epsilon * F.pow(F.lit(config.kappa), residue))


def tied(low: Column, high: Column, config: vocab.Config = vocab.DEFAULT) -> Column:
    return high - low <= config.tie_tolerance * high


def label(p: Column, config: vocab.Config = vocab.DEFAULT) -> Column:
    if config.labels_provisional:
        return F.lit(None).cast("string")
    return F.when(p >= config.label_high, "High").when(p >= config.label_medium, "Medium").otherwise("Low")


def top(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key, with their rank from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def ranked_without_customer(rows: DataFrame, summed: DataFrame, listed: DataFrame, config: vocab.Config = vocab.DEFAULT, most: int | None = None) -> DataFrame:
    """class_key, sku, credit, prior, confidence, rank under the uniform prior; rows: of kinds, listed: their members."""
    per = summed.where("compatible_count > 0").select("class_key", "compatible_count", "credit_sum")
    scored = compatible(rows).join(per, "class_key").withColumn("prior", 1 / F.col("compatible_count"))
    scored = scored.withColumn("confidence", posterior(F.col("prior") * F.col("credit"), F.col("prior") * F.col("credit_sum"), F.col("q_residue"), config))
    order, most = [F.desc("credit"), F.asc("sku")], most or config.max_limit
    best = top(scored, ["class_key"], order, most).select("class_key", "sku", "credit", "prior", "confidence")
    return first_members(best, listed, ["class_key"], order, most).select("class_key", "sku", "credit", "prior", "confidence", "rank")


# --- Relaxations ---


def relaxed_names(step: Column, config: vocab.Config = vocab.DEFAULT) -> Column:
    """The attributes relaxed up to a step, each once, in the order of the steps."""
    named = [F.when((step >= k) & on, a) for k, (*_, names) in enumerate(_relaxations(config), 1) for a, on in names]
    return F.array_distinct(F.array_compact(F.array(*named)))


def near_misses(rows: DataFrame, summed: DataFrame, listed: DataFrame, config: vocab.Config = vocab.DEFAULT, most: int | None = None) -> DataFrame:
    """class_key, sku, closeness, relaxed, rank: what the first relaxation with any result
    admits beyond the compatible set, by distance in length, then SKU; rows: of kinds, listed: their members."""
    per = summed.where("relax_step IS NOT NULL").select("class_key", F.col("relax_step").alias("at"))
    found = rows.where("failing < 4").join(per, "class_key").where(F.col("step") <= F.col("at"))
    names = relaxed_names(F.col("at"), config)
    found = found.withColumns({"relaxed": names, "closeness": (stated_count() - F.size(names)) / stated_count(), "__far": F.when(F.col("q_mm").isNotNull(), F.coalesce(F.abs(F.col("i_mm") - F.col("q_mm")), F.lit(float("inf")))).otherwise(0.0)})
    order, most = [F.asc("__far"), F.asc("sku")], most or config.max_limit
    best = top(found, ["class_key"], order, most).select("class_key", "sku", "closeness", "relaxed", "__far")
    return first_members(best, listed, ["class_key"], order, most).select("class_key", "sku", "closeness", "relaxed", "rank")
