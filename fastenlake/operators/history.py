"""Order history: customers, recency-weighted profiles, the history prior, references to
earlier orders.  Lines have customer_id, customer_name, order_date (ISO text), sku,
description, quantity, line_no (orders lines) and spec (null where unparsable)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fastenlake import vocab
from fastenlake.operators import explain as ex
from fastenlake.operators.matching import first_members, family, lists, small, top, yes

SHARES = {"material": list(vocab.MATERIAL_FAMILY), "finish": list(vocab.FINISH_FAMILY), "threadSystem": vocab.THREAD_SYSTEMS}


# --- Customers ---


def customers(lines: DataFrame) -> DataFrame:
    """customer_id, customer_name (first seen), order_count (lines), last_order_date, first_line."""
    return lines.groupBy("customer_id").agg(
        F.min_by("customer_name", "line_no").alias("customer_name"), F.count(F.lit(1)).alias("order_count"),
        F.max("order_date").alias("last_order_date"), F.min("line_no").alias("first_line"),
    )


def search_customers(found: DataFrame, text: str | None = None) -> DataFrame:
    """Customers whose name or id begins with the text, then those that contain it, each in
    source order (tier, first_line); all of them without a text."""
    needle = (text or "").strip().lower()
    fields = [F.lower("customer_name"), F.lower("customer_id")]
    begins, holds = (yes(getattr(fields[0], how)(F.lit(needle))) | yes(getattr(fields[1], how)(F.lit(needle))) for how in ("startswith", "contains"))
    return found.withColumn("tier", F.when(begins, 0).when(holds, 1)).where("tier IS NOT NULL").orderBy("tier", "first_line")


def latest_date(lines: DataFrame) -> DataFrame:
    """One row: the latest order date of all lines, empty without lines."""
    return lines.agg(F.coalesce(F.max("order_date"), F.lit("")).alias("reference_date"))


# --- Profiles ---


def slim(lines: DataFrame, *others: str) -> DataFrame:
    """What Customers.of(), and referenced_lines() beside others, read of lines."""
    return slim_spec(lines).select("customer_id", "order_date", "sku", "line_no", "spec", *others)


def slim_spec(lines: DataFrame) -> DataFrame:
    """lines with what is read of an earlier order's spec."""
    s = F.col("spec")
    return lines.withColumn("spec", F.when(s.isNotNull(), F.struct(*[s[a].alias(a) for a in ("diameter", "pitch", "type", "material", "finish")])))


def weighted(lines: DataFrame, config: vocab.Config = vocab.DEFAULT, every: DataFrame | None = None) -> DataFrame:
    """The parsable lines with weight exp(-age / tau), aged from the latest date of all lines
    (every, where lines are some of them)."""
    dated = lines.crossJoin(F.broadcast(latest_date(lines if every is None else every)))
    age = F.datediff(F.to_date("reference_date"), F.to_date("order_date"))
    return dated.where("spec IS NOT NULL").withColumn("weight", F.exp(-age / config.tau_days))


def profiles(lines: DataFrame, config: vocab.Config = vocab.DEFAULT) -> DataFrame:
    """customer_id, n_eff, lambda for every customer, also one without a parsable line."""
    w = weighted(lines, config).groupBy("customer_id").agg(F.sum("weight").alias("n_eff"))
    n = F.coalesce("n_eff", F.lit(0.0))
    return lines.select("customer_id").distinct().join(w, "customer_id", "left").select("customer_id", n.alias("n_eff"), (n / (n + config.k)).alias("lambda"))


def shares(lines: DataFrame, config: vocab.Config = vocab.DEFAULT, profiled: DataFrame | None = None) -> DataFrame:
    """customer_id, attribute, value, share: smoothed, for every vocabulary value and any seen."""
    w = weighted(lines, config)
    s = F.col("spec")
    seen = w.select("customer_id", "weight", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), v.alias("value")) for a, v in (("material", s["material"]["value"]), ("finish", s["finish"]["value"]), ("threadSystem", s["diameter"]["system"]))])).alias("x"))
    mass = seen.select("customer_id", "weight", "x.*").where("value IS NOT NULL").groupBy("customer_id", "attribute", "value").agg(F.sum("weight").alias("mass"))
    profiled = profiles(lines, config) if profiled is None else profiled
    words = F.array(*[F.struct(F.lit(a).alias("attribute"), F.lit(v).alias("value")) for a, vs in SHARES.items() for v in vs])
    base = profiled.select("customer_id", F.explode(words).alias("x")).select("customer_id", "x.*", F.lit(0.0).alias("mass"))
    total = base.unionByName(mass).groupBy("customer_id", "attribute", "value").agg(F.sum("mass").alias("mass"))
    size = F.create_map(*[F.lit(x) for a, vs in SHARES.items() for x in (a, len(vs))])[F.col("attribute")]
    return total.join(profiled.select("customer_id", "n_eff"), "customer_id").select("customer_id", "attribute", "value", ((F.col("mass") + config.alpha) / (F.col("n_eff") + config.alpha * size)).alias("share"))


def profiled_shares(lines: DataFrame, config: vocab.Config = vocab.DEFAULT, specs: DataFrame | None = None) -> DataFrame:
    """profiles() with the values of shares() as maps share_material, share_finish and
    share_threadSystem.  A customer's lines meet once, as a few words and a weight, or as
    numbers whose specs (said, spec) come in afterwards."""
    s = F.col("spec")
    values = {"material": s["material"]["value"], "finish": s["finish"]["value"], "threadSystem": s["diameter"]["system"]}
    age = F.datediff(F.to_date("reference_date"), F.to_date("order_date"))

    def dated(of: DataFrame) -> DataFrame:
        found = of.crossJoin(F.broadcast(latest_date(lines))).select("customer_id", F.when(s.isNotNull(), F.exp(-age / config.tau_days)).alias("weight"), *[v.alias(a) for a, v in values.items()])
        return _split(found)

    mass = {(a, v): _exact_sum(F.col(a) == v) for a, vs in SHARES.items() for v in vs}
    if specs is None:
        every = dated(lines)
        by = every.repartition("customer_id")
    else:
        by = dated(lines.select("customer_id", "order_date", "said").repartition("customer_id").join(specs, "said", "left"))
        strange = reduce(lambda a, b: a | b, [yes(~v.isin(SHARES[a])) for a, v in values.items()])
        every = dated(lines.join(small(specs.where(strange)), "said"))
    summed = by.groupBy("customer_id").agg(F.sum("weight").alias("__n"), *[m.alias(f"{a}:{v}") for (a, v), m in mass.items()])
    # values that the vocabulary lacks: none where descriptions are parsed by it
    odd = every.select("customer_id", "high", "low", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in SHARES])).alias("x")).select("customer_id", "high", "low", "x.*")
    known = F.array(*[F.lit(f"{a}:{v}") for a, v in mass])
    odd = odd.where(F.col("value").isNotNull() & ~F.array_contains(known, F.concat_ws(":", "attribute", "value"))).groupBy("customer_id", "attribute", "value").agg(_exact_sum(F.lit(True)).alias("mass"))
    odd = odd.groupBy("customer_id").agg(*[F.collect_list(F.when(F.col("attribute") == a, F.struct("value", "mass"))).alias(f"odd_{a}") for a in SHARES])
    n = F.coalesce("__n", F.lit(0.0))

    def shared(a: str) -> Column:
        entry = lambda value, m: F.struct(value.alias("value"), ((m + config.alpha) / (n + config.alpha * len(SHARES[a]))).alias("share"))
        own = F.array(*[entry(F.lit(v), F.coalesce(F.col(f"`{a}:{v}`"), F.lit(0.0))) for v in SHARES[a]])
        more = F.transform(F.coalesce(F.col(f"odd_{a}"), F.array().cast("array<struct<value:string,mass:double>>")), lambda x: entry(x["value"], x["mass"]))
        return F.map_from_entries(F.concat(own, more)).alias(f"share_{a}")

    return summed.join(odd, "customer_id", "left").select("customer_id", n.alias("n_eff"), (n / (n + config.k)).alias("lambda"), *[shared(a) for a in SHARES])


#: Bits of a weight's upper part, and of its lower part behind them
PART = 30


def _split(rows: DataFrame) -> DataFrame:
    """rows with weight in two parts, high and low, whose sums are exact for up to 2^23 rows: values
    bought on the same dates tie, in whatever order lines come."""
    cut = lambda x, bits: F.floor(x * float(1 << bits)) / float(1 << bits)
    return rows.withColumn("high", cut(F.col("weight"), PART)).withColumn("low", cut(F.col("weight") - F.col("high"), 2 * PART))


def _exact_sum(where: Column) -> Column:
    return F.sum(F.when(where, F.col("high"))) + F.sum(F.when(where, F.col("low")))


def purchases(lines: DataFrame, config: vocab.Config = vocab.DEFAULT, every: DataFrame | None = None) -> DataFrame:
    """customer_id, sku, bought, last_order_date, spec of the latest line (of equal dates the
    later line), repeat."""
    return weighted(lines, config, every).groupBy("customer_id", "sku").agg(*_bought(), F.max_by("spec", F.struct("order_date", "line_no")).alias("spec"))


def _bought() -> list[Column]:
    return [F.count(F.lit(1)).alias("bought"), F.max("order_date").alias("last_order_date"), F.least(F.lit(1.0), F.sum("weight")).alias("repeat")]


def discontinued(bought: DataFrame, items: DataFrame) -> DataFrame:
    """Purchases (or lines) whose item is inactive."""
    return bought.join(items.where("NOT active").select("sku"), "sku", "left_semi")


def warnings(lines: DataFrame, items: DataFrame) -> DataFrame:
    """customer_id, sku, line_no, message: unparsable lines, SKUs that the catalog lacks or
    describes otherwise."""
    print_ = lambda s: F.to_json(F.struct(s["diameter"], s["pitch"], s["length"], s["type"][0]["value"].alias("t"), s["material"]["value"].alias("m"), s["finish"]["value"].alias("f"), s["standard"]))
    known = items.select("sku", print_(F.col("spec")).alias("theirs"))
    joined = lines.select("customer_id", "sku", "line_no", "description", "spec", print_(F.col("spec")).alias("ours")).join(known, "sku", "left")
    text = (
        F.when(F.col("spec").isNull(), F.concat("sku", F.lit(': cannot read the catalog row "'), "description", F.lit('"')))
        .when(F.col("theirs").isNull(), F.concat("sku", F.lit(" is not in the catalog")))
        .when(F.col("theirs") != F.col("ours"), F.concat("sku", F.lit(" disagrees with its catalog row")))
    )
    return joined.select("customer_id", "sku", "line_no", text.alias("message")).where("message IS NOT NULL")


def sibling_key(system: Column, nominal: Column, kind: Column, material_family: Column) -> Column:
    """Null where a part is missing."""
    return F.concat(system, F.lit(":"), nominal, F.lit(":"), kind, F.lit(":"), material_family)


def siblings(gone: DataFrame) -> DataFrame:
    """customer_id, sibling_key, sibling: per key the first discontinued SKU bought."""
    s = F.col("spec")
    key = sibling_key(s["diameter"]["system"], s["diameter"]["nominal"], s["type"][0]["value"], family(s["material"]["value"], vocab.MATERIAL_FAMILY))
    return gone.select("customer_id", "sku", key.alias("sibling_key")).where("sibling_key IS NOT NULL").groupBy("customer_id", "sibling_key").agg(F.min("sku").alias("sibling"))


# --- The prior ---


@dataclass
class Sales:
    """Order lines as numbers.  A SKU's lines have one description."""

    #: customer_id, order_date (a date), item, kind_no (null: not active), said
    lines: DataFrame
    #: item, sku, active, kind, kind_no
    items: DataFrame
    #: said, spec
    specs: DataFrame
    #: kind, kind_no
    kinds: DataFrame


@dataclass
class Customers:
    """What the history says about each customer, one table per question."""

    #: customer_id, n_eff, lambda, share_material, share_finish, share_threadSystem (maps)
    profiles: DataFrame
    #: customer_id, sku, bought, last_order_date, repeat
    purchases: DataFrame
    #: those whose item is inactive, with the spec of the latest line
    discontinued: DataFrame
    #: customer_id, sibling_key, sibling
    siblings: DataFrame
    #: customer_id, material, finish
    preferences: DataFrame

    @classmethod
    def of(cls, lines: DataFrame, items: DataFrame, config: vocab.Config = vocab.DEFAULT, keep=lambda df: df) -> Customers:
        """keep: applied to each table (a checkpoint, so that they are made once)."""
        full = keep(profiled_shares(lines, config))
        # specs are wide and only those of inactive items are read: they alone go through the exchange
        bought = keep(weighted(lines, config).groupBy("customer_id", "sku").agg(*_bought()))
        inactive = small(keep(items.where("NOT active").select("sku")))
        gone = keep(purchases(lines.join(inactive, "sku", "left_semi"), config, lines))
        return cls(full, bought, gone, keep(siblings(gone)), keep(preferences(full)))

    @classmethod
    def among(cls, sales: Sales, requests: DataFrame, fits: DataFrame, config: vocab.Config = vocab.DEFAULT, keep=lambda df: df) -> Customers:
        """of(), with those purchases only that are compatible with a request of their customer;
        requests: customer_id, class_key, fits: class_key, sku (names a kind).  What was bought
        is met with what fits before it is summed, and SKUs are looked up for the rest."""
        full = keep(profiled_shares(sales.lines, config, sales.specs))
        wanted = requests.select("customer_id", "class_key").distinct()
        pairs = small(keep(fits.select("class_key", F.col("sku").alias("kind")).join(small(sales.kinds), "kind").select("class_key", "kind_no")))
        near = sales.lines.where("kind_no IS NOT NULL").join(wanted, "customer_id").join(pairs, ["class_key", "kind_no"]).join(sales.specs, "said", "left")
        bought = weighted(near, config, sales.lines).groupBy("customer_id", "class_key", "item").agg(*_bought())
        # a customer's requests of two classes have counted the same lines
        bought = keep(bought.dropDuplicates(["customer_id", "item"])).join(sales.items.select("item", "sku"), "item")
        bought = keep(bought.select("customer_id", "sku", "bought", F.col("last_order_date").cast("string").alias("last_order_date"), "repeat"))
        inactive = small(keep(sales.items.where("NOT active").select("item", "sku")))
        gone = sales.lines.where("kind_no IS NULL").join(inactive, "item").join(sales.specs, "said", "left")
        gone = keep(purchases(gone.select("customer_id", F.col("order_date").cast("string").alias("order_date"), "sku", F.lit("").alias("line_no"), "spec"), config, sales.lines))
        return cls(full, bought, gone, keep(siblings(gone)), keep(preferences(full)))


#: What the prior and personal_reasons() need of a compatible row
CANDIDATE = ["class_key", "sku", "n", "credit", "q_material", "q_finish", "q_nominal", "q_residue", "i_system", "i_nominal", "i_type", "i_material", "i_material_family", "i_finish"]
STATED = ["q_material", "q_finish", "q_nominal", "q_residue"]
#: The most items whose lists are broadcast
LISTED = 2_000_000
#: Items of one cell of a class differ for a customer only by what the customer bought
CELL = ["i_material", "i_finish", "i_system", "credit"]


def with_profile(requests: DataFrame, known: Customers) -> DataFrame:
    """requests with what their customer's profile says; done before candidates join, it
    costs one row a request instead of one a candidate."""
    return requests.join(known.profiles, "customer_id", "left")


def _item_key() -> Column:
    return sibling_key(F.col("i_system"), F.col("i_nominal"), F.col("i_type"), F.col("i_material_family"))


def _weight(repeat: Column, config: vocab.Config) -> Column:
    return (1 + config.w_sku * repeat) * _factor()


def _factor() -> Column:
    factor = F.lit(1.0)
    for a, stated, value in (("material", "q_material", "i_material"), ("finish", "q_finish", "i_finish"), ("threadSystem", "q_nominal", "i_system")):
        factor = factor * F.when(F.col(stated).isNull(), F.coalesce(F.col(f"share_{a}")[F.col(value)], F.lit(1.0))).otherwise(1.0)
    return factor


@dataclass
class Personal:
    """The priors of requests with a customer, from sums over cells: a request meets a class's
    cells, what its customer bought and the siblings of that, not the compatible items.

    groups holds signed counts: every cell with all its items, and for items that were
    bought or are siblings one row that counts them where they belong and one that takes
    them off where they don't.  So sums over groups are sums over the compatible set."""

    #: request_id, customer_id, class_key, limit, STATED, profile columns
    asked: DataFrame
    #: compatible rows of kinds: CANDIDATE, with sku as kind, cell and sibling_key
    fits: DataFrame
    #: kind, sku
    listed: DataFrame
    #: request_id, kind, sku, bought, last_order_date, repeat: the compatible items that the customer bought
    own: DataFrame
    #: request_id, kind (cell, sibling, bought), key, cell, CELL, n, w, first (least SKU of a cell)
    groups: DataFrame
    #: request_id, mass, credited, n, credit_sum
    totals: DataFrame
    known: Customers
    config: vocab.Config
    keep: Callable[[DataFrame], DataFrame]

    @classmethod
    def of(cls, requests: DataFrame, fits: DataFrame, listed: DataFrame, known: Customers, config: vocab.Config = vocab.DEFAULT, keep=lambda df: df) -> Personal:
        asked = keep(with_profile(requests, known))
        cell = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CELL])
        fits = small(keep(fits.withColumnRenamed("sku", "kind").withColumns({"cell": cell, "sibling_key": _item_key()})))
        met = asked.select("request_id", "customer_id", "class_key").join(known.purchases, "customer_id").join(listed, "sku")
        own = keep(met.join(small(fits.select("class_key", "kind")), ["class_key", "kind"]).select("request_id", "kind", "sku", "bought", "last_order_date", "repeat"))
        groups = keep(_groups(asked, fits, own, known, config))
        n, w, credit = F.col("n"), F.col("w"), F.col("credit")
        totals = keep(groups.groupBy("request_id").agg(F.sum(n * w).alias("mass"), F.sum(n * w * credit).alias("credited"), F.sum(n).alias("n"), F.sum(n * credit).alias("credit_sum")).withColumnsRenamed({"n": "n_all"}))
        return cls(asked, fits, listed, own, groups, totals, known, config, keep)

    def _share(self) -> Column:
        """The prior of a row with weight w, beside totals and lambda."""
        lam, n = F.coalesce("lambda", F.lit(0.0)), F.col("n_all")
        return lam * F.when(F.col("mass") == 0, 1 / n).otherwise(F.col("w") / F.col("mass")) + (1 - lam) / n

    def _with_totals(self, rows: DataFrame) -> DataFrame:
        return self._valued(rows.join(self.totals, "request_id"))

    def _valued(self, rows: DataFrame) -> DataFrame:
        """rows beside totals with prior, and total: the sum of prior times credit over the compatible set."""
        lam, n = F.coalesce("lambda", F.lit(0.0)), F.col("n_all")
        total = lam * F.when(F.col("mass") == 0, F.col("credit_sum") / n).otherwise(F.col("credited") / F.col("mass")) + (1 - lam) * F.col("credit_sum") / n
        return rows.withColumns({"prior": self._share(), "total": total}).drop("mass", "credited", "n_all", "credit_sum")

    def _placed(self, found: DataFrame) -> DataFrame:
        """Rows of asked and fits with factor (what a row weighs beside its repeat), sibling and
        the totals; profile maps go before anything is exchanged."""
        narrow = found.withColumn("factor", _factor()).drop("cell", "n", *[f"share_{a}" for a in SHARES])
        narrow = narrow.join(self.known.siblings, ["customer_id", "sibling_key"], "left").drop("sibling_key")
        return narrow.join(self.totals, "request_id")

    def _rated(self, rows: DataFrame) -> DataFrame:
        """What _placed() returned, with repeat (the customer's own), bought and last_order_date:
        with prior, total, has_profile."""
        own = F.coalesce("repeat", F.lit(0.0))
        repeat = F.when(F.col("sibling").isNull(), own).otherwise(F.greatest(own, F.lit(self.config.sibling_credit)))
        rows = rows.withColumn("repeat", repeat).withColumn("w", (1 + self.config.w_sku * F.col("repeat")) * F.col("factor"))
        return self._valued(rows).withColumn("has_profile", F.col("lambda").isNotNull()).drop("w", "lambda", "factor")

    def scored(self, among: DataFrame) -> DataFrame:
        """(request, item) rows with prior, total, has_profile, repeat, bought, last_order_date,
        sibling; among: request_id, kind, sku of the rows that are wanted."""
        found = among.join(self.asked.drop(*STATED), "request_id").join(self.fits, ["class_key", "kind"])
        placed = self._placed(found).join(self.own.drop("kind"), ["request_id", "sku"], "left")
        return self._rated(placed)

    def by_kind(self, *more: DataFrame) -> DataFrame:
        """What scored() has, for every(): a row for each kind that a request's compatible set has,
        without sku, and one for each item of it that the customer bought; owned: these SKUs.
        more: further columns by request_id.  All that a customer and a request say is joined
        to the request first, so no exchange holds a row for each kind."""
        mine = self.own.groupBy("request_id").agg(F.collect_list(F.struct("kind", "sku", "bought", "last_order_date", "repeat")).alias("mine"))
        siblings_ = self.known.siblings.groupBy("customer_id").agg(F.map_from_entries(F.collect_list(F.struct("sibling_key", "sibling"))).alias("siblings"))
        asked = self.asked.drop(*STATED).join(siblings_, "customer_id", "left").join(self.totals, "request_id").join(mine, "request_id", "left")
        for columns in more:
            asked = asked.join(columns, "request_id")
        found = self.keep(asked).join(self.fits, "class_key")
        found = found.withColumns({"factor": _factor(), "sibling": F.col("siblings")[F.col("sibling_key")], "mine": F.filter("mine", lambda x: x["kind"] == F.col("kind"))})
        said = ["sku", "bought", "last_order_date", "repeat"]
        kinds_ = dict(self.own.dtypes)
        rest = F.array(F.struct(*[F.lit(None).cast(kinds_[c]).alias(c) for c in said]))
        each = F.when(F.size("mine") > 0, F.concat(rest, F.transform("mine", lambda x: F.struct(*[x[c].alias(c) for c in said])))).otherwise(rest)
        rows = found.withColumns({"owned": F.col("mine")["sku"], "each": each}).drop("cell", "n", "sibling_key", "siblings", "mine", *[f"share_{a}" for a in SHARES])
        return self._rated(rows.withColumn("each", F.explode("each")).select("*", "each.*").drop("each"))

    def every(self, rows: DataFrame, value: str) -> DataFrame:
        """request_id, sku and a value of by_kind() rows, for the whole compatible set.  Items come
        in last, from lists, so no exchange holds a row of each."""
        rows = self.keep(rows.select("request_id", "kind", "sku", "owned", value))
        skus = self.keep(lists(self.listed))
        skus = F.broadcast(skus) if self.listed.count() <= LISTED else skus
        others = F.when(F.size("owned") > 0, F.array_except("skus", "owned")).otherwise(F.col("skus"))
        rest = rows.where("sku IS NULL").drop("sku").join(skus, "kind").select("request_id", F.explode(others).alias("sku"), value)
        return rest.unionByName(rows.where("sku IS NOT NULL").select("request_id", "sku", value))

    def preferred(self) -> DataFrame:
        """request_id and what preferring() adds: whether a class has a material or finish is known by class."""
        prefers = self.known.preferences.select("customer_id", F.col("material").alias("p_material"), F.col("finish").alias("p_finish"))
        has = small(self.keep(self.fits.groupBy("class_key").agg(*[F.collect_set(f"i_{a}").alias(f"has_{a}") for a in ("material", "finish")])))
        met = self.asked.select("request_id", "customer_id", "class_key").join(prefers, "customer_id", "left").join(has, "class_key")
        return met.select("request_id", "p_material", "p_finish", *[yes(F.array_contains(f"has_{a}", F.col(f"p_{a}"))).alias(f"there_{a}") for a in ("material", "finish")])

    def cells(self) -> DataFrame:
        """request_id, customer_id, i_material, i_finish of every cell of each request's class."""
        return self.groups.where("first IS NOT NULL").join(self.asked.select("request_id", "customer_id"), "request_id").select("request_id", "customer_id", "i_material", "i_finish")

    def extremes(self) -> DataFrame:
        """request_id, low, high: of prior times credit over the compatible set."""
        there = self.groups.groupBy("request_id", "kind", "key", "cell").agg(F.sum("n").alias("n"), F.first("w").alias("w"), F.first("credit").alias("credit")).where("n > 0").drop("n")
        rated = self._with_totals(there.join(self.asked.select("request_id", "lambda"), "request_id"))
        worth = F.col("prior") * F.col("credit")
        return rated.groupBy("request_id").agg(F.min(worth).alias("low"), F.max(worth).alias("high"), F.first("total").alias("total"))

    def candidates(self, most: int) -> DataFrame:
        """request_id, kind, sku: a few rows that hold each request's `most` best.

        Of equal weight the lesser SKU is better, and bought items and siblings are at least
        as good as the rest of their cell: so an item among the best is bought, or among the
        first `most` SKUs of its sibling group or of one of the best cells.  These are `most`
        at most, and none that is worth less than cells which hold `most` items."""

        def firsts(rows: DataFrame, *keys: str) -> DataFrame:
            best = top(rows.select(*keys, F.col("kind").alias("sku")), list(keys), [F.asc("sku")], most)
            return small(self.keep(first_members(best, self.listed, list(keys), [F.asc("sku")], most).drop("rank")))

        rated = self._with_totals(self.groups.where("first IS NOT NULL").join(self.asked.select("request_id", "class_key", "lambda"), "request_id"))
        worth, per = F.col("prior") * F.col("credit"), Window.partitionBy("request_id")
        order = per.orderBy(F.desc("worth"), F.asc("first"))
        rated = rated.select("request_id", "class_key", "cell", "first", "n", worth.alias("worth")).withColumns({"place": F.row_number().over(order), "before": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))})
        needed = F.coalesce("before", F.lit(0)) < most
        rated = rated.where(F.col("place") <= most).withColumn("least", F.min(F.when(needed, F.col("worth"))).over(per))
        best = rated.where(needed | (F.col("worth") >= F.col("least") * (1 - 1e-9))).select("request_id", "class_key", "cell")
        by_cell = best.join(firsts(self.fits, "class_key", "cell"), ["class_key", "cell"]).select("request_id", "kind", "sku")
        alike = firsts(_alike(self.fits, self.known), "class_key", "sibling_key", "cell")
        by_sibling = self.asked.select("request_id", "customer_id", "class_key").join(self.known.siblings.drop("sibling"), "customer_id").join(alike, ["class_key", "sibling_key"]).select("request_id", "kind", "sku")
        return by_cell.unionByName(by_sibling).unionByName(self.own.select("request_id", "kind", "sku")).distinct()


def _alike(fits: DataFrame, known: Customers) -> DataFrame:
    return fits.join(known.siblings.select("sibling_key").distinct(), "sibling_key", "left_semi")


def _groups(asked: DataFrame, fits: DataFrame, own_: DataFrame, known: Customers, config: vocab.Config) -> DataFrame:
    one = lambda kind, key, n, repeat: F.struct(F.lit(kind).alias("kind"), key.alias("key"), n.cast("long").alias("n"), repeat.cast("double").alias("repeat"))
    none, zero, credit = F.lit(""), F.lit(0.0), F.lit(config.sibling_credit)
    n, own = F.col("n"), F.col("own")
    narrow = asked.select("request_id", "customer_id", "class_key", "q_material", "q_finish", "q_nominal", *[f"share_{a}" for a in SHARES])
    cells = small(fits.groupBy("class_key", "cell", *CELL).agg(F.sum("n").alias("n"), F.min("kind").alias("first")))
    alike = small(_alike(fits, known).groupBy("class_key", "sibling_key", "cell", *CELL).agg(F.sum("n").alias("n")))
    gone = known.siblings.select("customer_id", "sibling_key", F.lit(True).alias("is_sibling"))
    whole = narrow.join(cells, "class_key").withColumn("x", F.array(one("cell", none, n, zero)))
    siblings_ = narrow.join(gone, "customer_id").join(alike, ["class_key", "sibling_key"]).withColumn("x", F.array(one("sibling", F.col("sibling_key"), n, credit), one("cell", none, -n, zero)))
    met = own_.select("request_id", "kind", "sku", F.col("repeat").alias("own")).join(narrow, "request_id")
    met = met.join(fits.select("class_key", "kind", "sibling_key", "cell", *CELL), ["class_key", "kind"]).join(gone, ["customer_id", "sibling_key"], "left").drop("kind")
    off = F.when(F.col("is_sibling"), one("sibling", F.col("sibling_key"), F.lit(-1), credit)).otherwise(one("cell", none, F.lit(-1), zero))
    bought = met.withColumn("x", F.array(one("bought", F.col("sku"), F.lit(1), F.when(F.col("is_sibling"), F.greatest(own, credit)).otherwise(own)), off))
    every = [d.select("request_id", "cell", *CELL, F.explode("x").alias("x"), f.alias("first"), *[c for c in narrow.columns if c.startswith(("q_", "share_"))]) for d, f in ((whole, F.col("first")), (siblings_, F.lit(None).cast("string")), (bought, F.lit(None).cast("string")))]
    rows = every[0].unionByName(every[1]).unionByName(every[2])
    return rows.select("request_id", "x.kind", "x.key", "cell", *CELL, "x.n", _weight(F.col("x.repeat"), config).alias("w"), "first")


def preferences(profiled: DataFrame) -> DataFrame:
    """customer_id, material, finish: the value of the largest share (of equal ones the
    smallest string); only customers with a parsable line."""
    best = lambda a: F.array_min(F.transform(F.map_entries(f"share_{a}"), lambda e: F.struct((-e["value"]).alias("share"), e["key"].alias("value"))))["value"]
    return profiled.where("n_eff > 0").select("customer_id", *[best(a).alias(a) for a in ("material", "finish")])


def personal_reasons(rows: DataFrame, known: Customers, among: DataFrame | None = None) -> DataFrame:
    """rows: what Personal.scored() returned, or some of them; among: the materials and
    finishes of the same compatible sets (default: rows).  Adds reason and overridden_by."""
    return reasoned(preferring(rows, known, among))


def preferring(rows: DataFrame, known: Customers, among: DataFrame | None = None) -> DataFrame:
    """rows with what the customer prefers, and whether the compatible set has it."""
    prefers = known.preferences.select("customer_id", F.col("material").alias("p_material"), F.col("finish").alias("p_finish"))
    found = rows.join(prefers, "customer_id", "left")
    whole = (rows if among is None else among).select("request_id", "customer_id", "i_material", "i_finish").join(prefers, "customer_id", "left")
    there = whole.groupBy("request_id").agg(*[F.max(yes(F.col(f"i_{a}") == F.col(f"p_{a}"))).alias(f"there_{a}") for a in ("material", "finish")])
    return found.join(there, "request_id")


def reasoned(found: DataFrame) -> DataFrame:
    """The columns of personal_reasons(), of what preferring() returned."""
    tables = {"material": vocab.MATERIAL_FAMILY, "finish": vocab.FINISH_FAMILY}
    named = {"material": ex.material_name(F.col("p_material")), "finish": ex.finish_name(F.col("p_finish"))}
    over = {
        a: yes(F.col(f"p_{a}").isNotNull() & (F.col(f"q_{a}") != F.col(f"p_{a}")) & (F.col(f"q_{a}").isin(*t) | (family(F.col(f"q_{a}"), t) != family(F.col(f"p_{a}"), t))))
        for a, t in tables.items()
    }
    preferred = F.array_compact(F.array(*named.values()))
    missing = F.coalesce(*[F.when(~over[a] & F.col(f"p_{a}").isNotNull() & ~F.col(f"there_{a}"), ex.unmatched_reason(a, named[a])) for a in tables])
    reason = (
        F.when(over["material"] | over["finish"], ex.override_reason(preferred))
        .when(F.col("bought").isNotNull(), ex.repeat_reason(F.col("bought"), F.col("last_order_date")))
        .when(F.col("sibling").isNotNull(), ex.sibling_reason(F.col("sibling")))
        .when(missing.isNotNull(), missing)
        .when(F.size(preferred) > 0, ex.preference_reason(preferred))
    )
    by = F.array_compact(F.array(*[F.when(over[a], a) for a in tables]))
    return found.withColumn("reason", F.when(F.col("has_profile"), reason)).withColumn("overridden_by", by).drop("p_material", "p_finish", "there_material", "there_finish")


# --- References to earlier orders ---


def stated(spec: Column, attribute: str) -> Column:
    return F.coalesce(F.element_at(spec["provenance"], attribute).isin("explicit", "corrected"), F.lit(False))


def states_override(spec: Column) -> Column:
    return stated(spec, "material") | stated(spec, "finish") | stated(spec, "standard") | stated(spec, "length")


def referenced_lines(requests: DataFrame, lines: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """requests (request_id, customer_id, spec) to the latest agreeing line of each SKU (of
    equal dates the earlier line), ranked from 0: newest first, then by the SKU's first
    agreeing line.  specs: see routed(); without line_spec then."""
    q, s = F.col("spec"), F.col("line_spec")
    read = F.col("spec") if specs is None else F.struct(*[F.col("spec")[a].alias(a) for a in ("type", "pitch", "diameter")])
    own = lines.where("spec IS NOT NULL").select("customer_id", "order_date", "sku", "description", "quantity", "line_no", read.alias("line_spec"))
    agrees = (
        F.when(q["type"].isNull(), True).otherwise(F.coalesce(F.arrays_overlap(q["type"]["value"], s["type"]["value"]), F.lit(False)))
        & ~(stated(q, "pitch") & s["pitch"].isNotNull() & F.coalesce(s["pitch"] != q["pitch"], F.lit(True)))
        & (q["diameter"].isNull() | yes(s["diameter"]["nominal"] == q["diameter"]["nominal"]))
    )
    met = requests.select("request_id", "customer_id", "spec").join(own, "customer_id").where(agrees).drop("spec")
    met = met if specs is None else met.drop("line_spec")
    per = Window.partitionBy("request_id", "sku")
    met = met.withColumn("__first", F.min("line_no").over(per)).withColumn("__n", F.row_number().over(per.orderBy(F.desc("order_date"), F.asc("line_no")))).where("__n = 1")
    order = Window.partitionBy("request_id").orderBy(F.desc("order_date"), F.asc("__first"))
    return met.withColumn("place", F.row_number().over(order) - 1).drop("__first", "__n", "customer_id")


def merged_spec(query: Column, base: Column) -> Column:
    """The base line's spec (without its standard) with what the query states put over it."""
    threaded = stated(query, "pitch") & query["diameter"].isNotNull()
    take = {a: stated(query, a) for a in ("material", "finish", "standard", "length")}
    inherited = [a for a in vocab.ATTRIBUTES if a != "standard"]

    def notes(kind: str) -> Column:
        b, q = base[kind], query[kind]
        # an attribute that the base has a provenance for is inferred now
        entries = []
        for a in vocab.ATTRIBUTES:
            mine = F.element_at(q, a)
            has = F.lit(a in inherited) & F.element_at(base["provenance"], a).isNotNull()
            theirs = F.when(has, F.lit("inferred") if kind == "provenance" else F.element_at(b, a))
            over = threaded if a in ("diameter", "pitch") else take.get(a, F.lit(False))
            value = F.when(over, mine).otherwise(theirs)
            entries.append(F.when(value.isNotNull(), F.struct(F.lit(a).alias("key"), value.alias("value"))))
        return F.map_from_entries(F.array_compact(F.array(*entries)))

    pick = lambda a, other: F.when(take[a], query[a]).otherwise(other)
    return F.struct(
        F.when(threaded, query["diameter"]).otherwise(base["diameter"]).alias("diameter"), F.when(threaded, query["pitch"]).otherwise(base["pitch"]).alias("pitch"),
        pick("length", base["length"]).alias("length"), base["type"].alias("type"), pick("material", base["material"]).alias("material"),
        pick("finish", base["finish"]).alias("finish"), F.when(take["standard"], query["standard"]).alias("standard"),
        query["residue"].alias("residue"), notes("evidence").alias("evidence"), notes("provenance").alias("provenance"), query["intent"].alias("intent"),
    )


def changed(query: Column, base: Column) -> Column:
    """The attributes by which the query departs from the base line, in order."""
    differs = {
        "material": ~query["material"]["value"].eqNullSafe(base["material"]["value"]), "finish": ~query["finish"]["value"].eqNullSafe(base["finish"]["value"]),
        "standard": query["standard"].isNotNull(), "length": ~query["length"]["mm"].eqNullSafe(base["length"]["mm"]),
    }
    return F.array_compact(F.array(*[F.when(stated(query, a) & d, a) for a, d in differs.items()]))


def routed(requests: DataFrame, lines: DataFrame, known: DataFrame | None = None, specs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """requests (request_id, query, customer_id, limit, spec) with form and, for
    overrides, the merged spec, base_date and changed; and the referenced lines.
    known: customer_id of further customers; one without a line has an empty history.
    specs: description, spec of all lines; lines' own specs may then lack what slim() drops.

    form: plain (no intent), needsCustomer, unresolved, pure or override."""
    asking = requests.where("spec.intent IS NOT NULL AND customer_id IS NOT NULL")
    found = referenced_lines(asking, lines, specs)
    base = found.where("place = 0")
    base = base if specs is None else base.join(specs.select("description", F.col("spec").alias("line_spec")), "description")
    base = base.select("request_id", "order_date", "line_spec")
    names = lines.select("customer_id") if known is None else lines.select("customer_id").unionByName(known.select("customer_id"))
    known = names.distinct().withColumn("known_customer", F.lit(True))
    out = requests.join(known, "customer_id", "left").join(base, "request_id", "left")
    q, b = F.col("spec"), F.col("line_spec")
    form = (
        F.when(q["intent"].isNull(), "plain").when(F.col("known_customer").isNull(), "needsCustomer").when(b.isNull(), "unresolved")
        .when(states_override(q), "override").otherwise("pure")
    )
    out = out.withColumn("form", form).withColumn("changed", F.when(F.col("form") == "override", changed(q, b)))
    merged = F.when(F.col("form") == "override", merged_spec(q, b)).otherwise(q.cast(_plain(requests)))
    return out.withColumn("parsed", q).withColumn("spec", merged).withColumnRenamed("order_date", "base_date").drop("line_spec", "known_customer"), found


def _plain(df: DataFrame):
    return df.schema["spec"].dataType
