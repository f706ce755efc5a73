"""The engine's queries over the bridge tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fastenlake import vocab
from fastenlake.functions import text as tx
from fastenlake.functions.parse import lexical_tokens, query_spec, register
from fastenlake.operators import display as dp
from fastenlake.operators import evaluate as ev
from fastenlake.operators import explain as ex
from fastenlake.operators import history as hs
from fastenlake.operators import lexical as lx
from fastenlake.operators import matching as mt
from fastenlake.operators import profile as pf
from fastenlake.plans import bridge as br
from fastenlake.plans.engine import Engine
from fastenlake.plans.stage import kept
from fastenlake.sources.tables import first_by

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- SQL shared by the oracles ---

_MATERIAL_FAMILY = "(CASE WHEN {0} IN ('ss_18_8', 'ss_316', 'ss_a2') THEN 'stainless' ELSE {0} END)"
_FINISH_FAMILY = "(CASE WHEN {0} IN ('zinc', 'yellow_zinc', 'mech_zinc') THEN 'zinc_family' ELSE {0} END)"
_CAT = f"cat AS (SELECT * FROM ({br.CATALOG}) x WHERE copy = 0), act AS (SELECT * FROM cat WHERE active)"
_REQ = f"req AS (SELECT * FROM ({br.REQUESTS}) x)"
_HIST = f"hist AS (SELECT *, CAST(order_date AS DATE) AS d FROM ({br.HISTORY}) x)"
_SAME_MAT, _SAME_FIN = f"(r_material IS NULL OR r_material = b_material OR (r_material = 'stainless' AND {_MATERIAL_FAMILY.format('b_material')} = 'stainless'))", "(r_finish IS NULL OR r_finish = b_finish)"
_CREDIT = "(CASE WHEN r_type IS NULL THEN 1.0 WHEN b_type = r_type3 THEN r_ts3 ELSE r_ts END * CASE WHEN r_material IS NULL THEN 1.0 WHEN r_material = b_material THEN r_ms ELSE r_ms * 0.8 END)"
_SAME_STD, _SAME_LEN = "(r_standard IS NULL OR coalesce(r_standard = b_standard, FALSE))", "(r_mm IS NULL OR coalesce(r_mm = b_mm, FALSE))"
_JOINED = "joined AS (SELECT * FROM req JOIN act ON (r_nominal IS NULL OR r_nominal = b_nominal) AND (r_type IS NULL OR r_type = b_type OR coalesce(b_type IN (r_type2, r_type3), FALSE)))"
_PAIRS = f"pairs AS (SELECT *, CAST({_CREDIT} AS DOUBLE) AS credit, count(*) OVER (PARTITION BY request_id) AS n FROM joined WHERE {_SAME_MAT} AND {_SAME_FIN} AND {_SAME_STD} AND {_SAME_LEN})"
_MATCH = f"WITH {_CAT}, {_REQ}, {_JOINED}, {_PAIRS}"
_STATUS = "CASE WHEN n IS NULL THEN 'none' WHEN r_nominal IS NULL AND r_type IS NULL THEN 'unparsed' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END"
_COUNTS = "counts AS (SELECT req.*, c.n FROM req LEFT JOIN (SELECT request_id, count(*) AS n FROM pairs GROUP BY 1) c USING (request_id))"


def _engine(spark: SparkSession, sf_dir: str, history: bool = False) -> Engine:
    if not history:
        return Engine(br.catalog_items(spark, sf_dir))
    specs = br.line_specs(spark, sf_dir, kept)
    return Engine(br.catalog_items(spark, sf_dir), br.history_with_specs(spark, sf_dir, specs), known=br.customers(spark, sf_dir), specs=specs)


def _stored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored: the engine's filters would repeat the texts' long expressions, whose code is too long to compile."""
    return kept(br.requests(spark, sf_dir))


class _Matched:
    """The matching stages of all bridge requests."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.items = kept(br.catalog_items(spark, sf_dir))
        parsed = br.requests(spark, sf_dir).withColumn("spec", query_spec("query"))
        self.asked = kept(mt.numbered(kept(mt.flat(mt.bind_length(parsed, self.items))), kept))
        self.kinds = kept(mt.kinds(self.items))
        self.listed = kept(mt.members(self.items, self.kinds))
        self.classes = kept(mt.classes(self.asked))
        self.rows = kept(mt.judged(mt.met(self.classes, self.kinds)))

    @property
    def summary(self) -> DataFrame:
        return mt.summary(self.classes, self.rows, self.kinds)

    def by_request(self, per_class: DataFrame, *columns: str) -> DataFrame:
        return self.asked.select("request_id", "class_key", *columns).join(per_class, "class_key")


# --- Sources, parsing ---


@query(f"SELECT sku, catalog_id, active, description FROM ({br.CATALOG}) x WHERE copy = 0")
def catalog_dedupe(spark, sf_dir):
    return first_by(br.catalog(spark, sf_dir), ["sku"], [F.col("line_no")]).select("sku", "catalog_id", "active", "description")


_STRUCTURED = "sku, b_nominal AS nominal, b_system AS system, b_mm AS mm, b_type AS type, b_material AS material, b_finish AS finish, b_standard AS standard"


@query(f"WITH {_CAT} SELECT {_STRUCTURED}, CASE WHEN k % 2 = 0 THEN b_pitch END AS pitch FROM cat")
def description_parse(spark, sf_dir):
    return br.catalog_items(spark, sf_dir).select("sku", F.col("i_nominal").alias("nominal"), F.col("i_system").alias("system"), F.col("i_mm").alias("mm"), F.col("i_type").alias("type"), F.col("i_material").alias("material"), F.col("i_finish").alias("finish"), F.col("i_standard").alias("standard"), F.col("i_pitch").alias("pitch"))


@query(f"WITH {_CAT} SELECT sku, b_nominal AS nominal, b_mm AS mm, b_material AS material, b_finish AS finish, CASE WHEN b_standard <> 'CLASS 8' THEN b_standard END AS standard, upper(concat(CASE WHEN k % 3 = 0 THEN b_short ELSE b_phrase END, CASE WHEN b_standard = 'CLASS 8' THEN ' CLASS 8' ELSE '' END)) AS type_phrase FROM cat")
def description_fields(spark, sf_dir):
    rows = first_by(br.catalog(spark, sf_dir), ["sku"], [F.col("line_no")])
    return pf.description_fields(rows).select("sku", "nominal", "mm", "material", "finish", "standard", "type_phrase")


@query(f"WITH {_CAT} SELECT sku, b_type AS type, b_material AS material, b_finish AS finish FROM cat")
def sku_codes(spark, sf_dir):
    return pf.sku_codes(first_by(br.catalog(spark, sf_dir), ["sku"], [F.col("line_no")])).select("sku", "type", "material", "finish")


@query(f"WITH {_REQ} SELECT request_id, r_nominal AS nominal, r_system AS system, concat_ws(',', r_type, r_type2, r_type3) AS types, CASE WHEN r_type IS NOT NULL THEN CAST(r_ts AS DOUBLE) END AS strength, CASE WHEN r_material IS NOT NULL THEN CAST(r_ms AS DOUBLE) END AS material_strength, r_mm AS mm, r_standard AS standard, r_material AS material, r_finish AS finish, CASE WHEN r_residue = 1 THEN 'widget' ELSE '' END AS residue FROM req")
def request_parse(spark, sf_dir):
    s = F.col("s")
    got = br.requests(spark, sf_dir).withColumn("s", query_spec("query"))
    return got.select("request_id", s["diameter"]["nominal"].alias("nominal"), s["diameter"]["system"].alias("system"), F.coalesce(F.array_join(s["type"]["value"], ","), F.lit("")).alias("types"), F.get(s["type"], F.lit(0))["strength"].alias("strength"), s["material"]["strength"].alias("material_strength"), s["length"]["mm"].alias("mm"), s["standard"].alias("standard"), s["material"]["value"].alias("material"), s["finish"]["value"].alias("finish"), F.array_join(s["residue"], ",").alias("residue"))


@query("""
SELECT p_partkey AS k, p_size / 25.4 AS inches_raw, CAST(floor(p_size * 25.4 * 10000 + 0.5) AS DOUBLE) / 10000 AS mm_from_in, CAST(floor(p_size * 12 * 25.4 * 10000 + 0.5) AS DOUBLE) / 10000 AS mm_from_ft,
  CAST(floor(p_size / 25.4 * 10000 + 0.5) AS DOUBLE) / 10000 AS in_from_mm FROM part""")
def unit_conversion(spark, sf_dir):
    size = F.col("p_size").cast("double")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("k"), (size / 25.4).alias("inches_raw"), pf.to_mm(size, F.lit("in")).alias("mm_from_in"), pf.to_mm(size, F.lit("ft")).alias("mm_from_ft"), pf.to_inches(size, F.lit("mm")).alias("in_from_mm"))


@query(f"""
WITH w AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS a FROM part), v AS (SELECT unnest([{", ".join("'" + w + "'" for w in sorted(tx.vocabulary()[0]))}]) AS b)
SELECT a, b FROM w, v WHERE damerau_levenshtein(a, b) <= 1 UNION SELECT b, b FROM v""")
def osa_neighbours(spark, sf_dir):
    register(spark)
    words = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.split(F.lower("p_name"), " ")).alias("a")).distinct()
    known = spark.createDataFrame([(w,) for w in sorted(tx.vocabulary()[0])], "b string")  # the lexicon's words: fixed size
    near = words.join(F.broadcast(known), F.abs(F.length("a") - F.length("b")) <= 1).where("osa_distance(a, b) <= 1")
    return near.unionByName(known.select(F.col("b").alias("a"), "b")).distinct()


# --- Matching ---


@query(f"WITH {_CAT} SELECT DISTINCT b_type AS type FROM act WHERE b_mm IS NOT NULL")
def length_bearing(spark, sf_dir):
    return mt.length_bearing_types(br.catalog_items(spark, sf_dir))


@query(f"{_MATCH} SELECT request_id, sku FROM pairs")
def compatible_set(spark, sf_dir):
    m = _Matched(spark, sf_dir)
    fits = kept(mt.compatible(m.rows).select("class_key", F.col("sku").alias("kind"), "n"))
    skus = kept(mt.lists(m.listed))
    return mt.pairs(m.asked.select("request_id", "class_key"), fits, F.broadcast(skus) if m.listed.count() <= hs.LISTED else skus)


@query(f"{_MATCH}, {_COUNTS} SELECT request_id, coalesce(n, 0) AS compatible_count, {_STATUS} AS status FROM counts")
def request_status(spark, sf_dir):
    m = _Matched(spark, sf_dir)
    return m.by_request(m.summary).select("request_id", "compatible_count", "status")


@query(f"{_MATCH}, {_COUNTS} SELECT {_STATUS} AS status, count(*) AS requests, CAST(sum(coalesce(n, 0)) AS BIGINT) AS items FROM counts GROUP BY 1")
def status_counts(spark, sf_dir):
    m = _Matched(spark, sf_dir)
    return m.by_request(m.summary).groupBy("status").agg(F.count(F.lit(1)).alias("requests"), F.sum("compatible_count").alias("items"))


_FAILING = f"CASE WHEN NOT {_SAME_LEN} THEN 0 WHEN NOT {_SAME_STD} THEN 1 WHEN NOT {_SAME_MAT} THEN 2 WHEN NOT {_SAME_FIN} THEN 3 ELSE 4 END"
_WORST = f"worst AS (SELECT request_id, max({_FAILING}) AS w FROM joined GROUP BY 1)"


@query(f"""{_MATCH}, {_WORST}
SELECT request_id, CASE WHEN w = 0 THEN 'length' WHEN w = 1 THEN 'standard' WHEN w = 2 THEN 'material' WHEN w = 3 THEN 'finish'
  WHEN r_nominal IS NOT NULL AND r_nominal NOT IN (SELECT b_nominal FROM act) THEN 'diameter' ELSE 'type' END AS failed
FROM req LEFT JOIN worst USING (request_id) WHERE coalesce(w, -1) < 4""")
def failed_constraint(spark, sf_dir):
    m = _Matched(spark, sf_dir)
    return m.by_request(m.summary).where("failed IS NOT NULL").select("request_id", "failed")


_DISTINCT = " || ".join(f"CASE WHEN count(DISTINCT coalesce(CAST({c} AS VARCHAR), '')) > 1 THEN '{a},' ELSE '' END" for a, c in (("diameter", "b_nominal"), ("pitch", "CASE WHEN k % 2 = 0 THEN b_pitch END"), ("length", "b_mm"), ("type", "b_type"), ("material", "b_material"), ("finish", "b_finish"), ("standard", "b_standard")))


@query(f"{_MATCH} SELECT request_id, {_DISTINCT} AS disambiguate_by FROM pairs GROUP BY 1")
def disambiguate_by(spark, sf_dir):
    m = _Matched(spark, sf_dir)
    names = F.concat(F.array_join("disambiguate_by", ","), F.when(F.size("disambiguate_by") > 0, ",").otherwise(""))
    return m.by_request(m.summary).where("compatible_count > 0").select("request_id", names.alias("disambiguate_by"))


_P = "0.98 * credit / n / (0.98 / n * credit_sum + 0.02 * pow(3.0, r_residue))"
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(credit, 9) DESC, sku) AS place, sum(credit) OVER (PARTITION BY request_id) AS credit_sum, max(credit) OVER (PARTITION BY request_id) - min(credit) OVER (PARTITION BY request_id) < 1e-9 AS even FROM pairs)"


@query(f"""{_MATCH}, {_RANKED}
SELECT request_id, sku, place, round({_P}, 6) AS confidence, CASE WHEN {_P} >= 0.8 THEN 'High' WHEN {_P} >= 0.35 THEN 'Medium' ELSE 'Low' END AS label, n > 1 AND even AS tied
FROM ranked WHERE place <= "limit" AND (r_nominal IS NOT NULL OR r_type IS NOT NULL)""")
def posterior_topk(spark, sf_dir):
    m = _Matched(spark, sf_dir)
    summed = kept(m.summary)
    best = mt.ranked_without_customer(m.rows, summed, m.listed).join(summed.where("NOT bare").select("class_key", (mt.tied(F.col("credit_min"), F.col("credit_max")) & (F.col("compatible_count") > 1)).alias("tied")), "class_key")
    out = m.by_request(best, "limit").where(F.col("rank") <= F.col("limit"))
    return out.select("request_id", "sku", F.col("rank").cast("long").alias("place"), F.round("confidence", 6).alias("confidence"), mt.label(F.col("confidence")).alias("label"), "tied")


_WIDE_MAT = f"(r_material IS NULL OR {_MATERIAL_FAMILY.format('r_material')} = {_MATERIAL_FAMILY.format('b_material')})"
_WIDE_FIN = f"(r_finish IS NULL OR {_FINISH_FAMILY.format('r_finish')} = {_FINISH_FAMILY.format('b_finish')})"
_NEAR_LEN = "(r_mm IS NULL OR coalesce(abs(b_mm - r_mm) <= abs(r_mm) * 0.25, FALSE))"
_SIB = "(coalesce(r_material IN ('ss_18_8', 'ss_316', 'ss_a2'), FALSE) OR coalesce(r_finish IN ('zinc', 'yellow_zinc', 'mech_zinc'), FALSE))"
_STEPS = f"""steps AS (SELECT *, CASE WHEN r_standard IS NOT NULL AND {_SAME_LEN} AND {_SAME_MAT} AND {_SAME_FIN} THEN 1
    WHEN {_SIB} AND {_SAME_LEN} AND {_WIDE_MAT} AND {_WIDE_FIN} THEN 2 WHEN r_mm IS NOT NULL AND {_NEAR_LEN} AND {_WIDE_MAT} AND {_WIDE_FIN} THEN 3
    WHEN r_mm IS NOT NULL AND {_WIDE_MAT} AND {_WIDE_FIN} THEN 4 END AS step
  FROM joined WHERE ({_FAILING}) < 4),
first_step AS (SELECT *, min(step) OVER (PARTITION BY request_id) AS at_step FROM steps),
near AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN r_mm IS NULL THEN 0.0 ELSE coalesce(abs(b_mm - r_mm), 1e300) END, sku) AS place FROM first_step WHERE step <= at_step)"""
_GIVEN = "(CAST(r_nominal IS NOT NULL AS INT) + CAST(r_type IS NOT NULL AS INT) + CAST(r_mm IS NOT NULL AS INT) + CAST(r_standard IS NOT NULL AS INT) + CAST(r_material IS NOT NULL AS INT) + CAST(r_finish IS NOT NULL AS INT))"
_RELAXED = "concat(CASE WHEN r_standard IS NOT NULL THEN 'standard,' ELSE '' END, CASE WHEN at_step >= 2 AND coalesce(r_material IN ('ss_18_8', 'ss_316', 'ss_a2'), FALSE) THEN 'material,' ELSE '' END, CASE WHEN at_step >= 2 AND coalesce(r_finish IN ('zinc', 'yellow_zinc', 'mech_zinc'), FALSE) THEN 'finish,' ELSE '' END, CASE WHEN at_step >= 3 AND r_mm IS NOT NULL THEN 'length,' ELSE '' END)"


@query(f"{_MATCH}, {_STEPS} SELECT request_id, sku, place, {_RELAXED} AS relaxed, round(({_GIVEN} - (length({_RELAXED}) - length(replace({_RELAXED}, ',', '')))) * 1.0 / {_GIVEN}, 6) AS closeness FROM near WHERE place <= 10")
def near_misses(spark, sf_dir):
    m = _Matched(spark, sf_dir)
    near = m.by_request(mt.near_misses(m.rows, kept(m.summary), m.listed))
    names = F.concat(F.array_join("relaxed", ","), F.when(F.size("relaxed") > 0, ",").otherwise(""))
    return near.select("request_id", "sku", F.col("rank").cast("long").alias("place"), names.alias("relaxed"), F.round("closeness", 6).alias("closeness"))


# --- Lexical ---

@query(f"""
WITH {_CAT}, t AS (SELECT sku, unnest(string_split(lower(description), ' ')) AS term FROM act), tf AS (SELECT sku, term, count(*) AS tf FROM t GROUP BY 1, 2),
dl AS (SELECT sku, sum(tf) AS dl FROM tf GROUP BY 1), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)
SELECT sku, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)), 6) AS weight FROM tf JOIN dl USING (sku) JOIN df USING (term) CROSS JOIN c""")
def bm25_index(spark, sf_dir):
    return lx.index(kept(br.catalog_items(spark, sf_dir)), keep=kept).select("sku", "term", F.round("weight", 6).alias("weight"))


@query(f"""
WITH {_CAT}, {_REQ}, t AS (SELECT sku, unnest(string_split(lower(description), ' ')) AS term FROM act), tf AS (SELECT sku, term, count(*) AS tf FROM t GROUP BY 1, 2),
dl AS (SELECT sku, sum(tf) AS dl FROM tf GROUP BY 1), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
q AS (SELECT request_id, unnest(string_split(query, ' ')) AS term, r_material, r_finish FROM req WHERE r_nominal IS NULL AND r_type IS NULL),
s AS (SELECT request_id, sku, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM q JOIN tf USING (term) JOIN dl USING (sku) JOIN df USING (term) CROSS JOIN c GROUP BY 1, 2)
SELECT request_id, sku, place, round(score, 6) AS score, hits FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 6) DESC, sku) AS place, count(*) OVER (PARTITION BY request_id) AS hits FROM s) WHERE place <= 10""")
def bm25_scores(spark, sf_dir):
    read = br.requests(spark, sf_dir).withColumn("spec", query_spec("query"))
    # stored: the requests' long expressions would be inferred into every filter of the joins
    bare = kept(read.where("spec.diameter IS NULL AND spec.type IS NULL").select("request_id", lx.bag(lexical_tokens("query", correct=True)).alias("bag")))
    found = kept(lx.scores(bare.select("bag").distinct(), lx.index(kept(br.catalog_items(spark, sf_dir)), keep=kept)))
    hits = found.groupBy("bag").agg(F.count(F.lit(1)).alias("hits"))
    best = mt.top(found.withColumn("score", F.round("score", 6)), ["bag"], [F.desc("score"), F.asc("sku")], 10)
    return bare.join(best, "bag").join(hits, "bag").select("request_id", "sku", F.col("rank").cast("long").alias("place"), "score", "hits")


# --- History ---

_W = f"WITH {_CAT}, {_HIST}, w AS (SELECT *, exp(-date_diff('day', d, (SELECT max(d) FROM hist)) / 180.0) AS weight FROM hist)"
_PROFILE = "profile AS (SELECT customer_id, sum(weight) AS n_eff, sum(weight) / (sum(weight) + 5.0) AS lam FROM w GROUP BY 1)"
_BUY = "buy AS (SELECT customer_id, sku, b_type, b_system, b_nominal, b_material, active, count(*) AS bought, max(order_date) AS last_order_date, least(1.0, sum(weight)) AS repeat FROM w GROUP BY ALL)"


@query(f"WITH {_HIST} SELECT customer_id, arg_min(customer_name, line_no) AS customer_name, count(*) AS order_count, max(order_date) AS last_order_date, min(line_no) AS first_line FROM hist GROUP BY 1")
def customer_summary(spark, sf_dir):
    return hs.customers(br.history(spark, sf_dir))


@query(f"""
WITH {_HIST}, c AS (SELECT customer_id, arg_min(customer_name, line_no) AS customer_name, count(*) AS order_count FROM hist GROUP BY 1)
SELECT customer_id, customer_name, order_count, CASE WHEN starts_with(lower(customer_name), 'c1') OR starts_with(lower(customer_id), 'c1') THEN 0 ELSE 1 END AS tier
FROM c WHERE contains(lower(customer_name), 'c1') OR contains(lower(customer_id), 'c1')""")
def customer_search(spark, sf_dir):
    return hs.search_customers(hs.customers(br.history(spark, sf_dir)), " C1 ").select("customer_id", "customer_name", "order_count", "tier")


@query(f"{_W}, {_PROFILE} SELECT customer_id, round(n_eff, 6) AS n_eff, round(lam, 6) AS lam FROM profile")
def recency_profile(spark, sf_dir):
    return hs.profiles(br.history_with_specs(spark, sf_dir)).select("customer_id", F.round("n_eff", 6).alias("n_eff"), F.round("lambda", 6).alias("lam"))


_VALUES = ", ".join(f"('{a}', '{v}', {len(vs)})" for a, vs in hs.SHARES.items() for v in vs)
_SHARES = f"""v AS (SELECT * FROM (VALUES {_VALUES}) t(attribute, value, size)),
m AS (SELECT customer_id, attribute, value, sum(weight) AS mass FROM (SELECT customer_id, weight, 'material' AS attribute, b_material AS value FROM w UNION ALL SELECT customer_id, weight, 'finish', b_finish FROM w UNION ALL SELECT customer_id, weight, 'threadSystem', b_system FROM w) u GROUP BY 1, 2, 3),
share AS (SELECT p.customer_id, v.attribute, v.value, (coalesce(mass, 0) + 1.0) / (n_eff + size) AS share FROM profile p CROSS JOIN v LEFT JOIN m ON m.customer_id = p.customer_id AND m.attribute = v.attribute AND m.value = v.value)"""


@query(f"{_W}, {_PROFILE}, {_SHARES} SELECT customer_id, attribute, value, round(share, 6) AS share FROM share")
def smoothed_shares(spark, sf_dir):
    return hs.shares(br.history_with_specs(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(f"{_W}, {_BUY} SELECT customer_id, sku, bought, last_order_date, round(repeat, 6) AS repeat FROM buy")
def repeat_weights(spark, sf_dir):
    return hs.purchases(br.history_with_specs(spark, sf_dir)).select("customer_id", "sku", "bought", "last_order_date", F.round("repeat", 6).alias("repeat"))


@query(f"{_W}, {_BUY} SELECT customer_id, sku, bought FROM buy WHERE NOT active")
def discontinued_purchases(spark, sf_dir):
    return hs.discontinued(hs.purchases(br.history_with_specs(spark, sf_dir)), br.catalog_items(spark, sf_dir)).select("customer_id", "sku", "bought")


_SIBLING = f"sib AS (SELECT customer_id, concat(b_system, ':', b_nominal, ':', b_type, ':', {_MATERIAL_FAMILY.format('b_material')}) AS sibling_key, min(sku) AS sibling FROM buy WHERE NOT active GROUP BY 1, 2)"


@query(f"{_W}, {_BUY}, {_SIBLING} SELECT customer_id, sibling_key, sibling FROM sib")
def sibling_credit(spark, sf_dir):
    return hs.siblings(hs.discontinued(hs.purchases(br.history_with_specs(spark, sf_dir)), br.catalog_items(spark, sf_dir)))


_WEIGHTS = f"w AS (SELECT *, exp(-date_diff('day', d, (SELECT max(d) FROM hist)) / 180.0) AS weight FROM hist), {_PROFILE}, {_BUY}, {_SIBLING}, {_SHARES}"
_SCORED = f"""scored AS (
  SELECT p.*, lam, bought, last_order_date, sibling, (1 + 2 * CASE WHEN sibling IS NULL THEN coalesce(repeat, 0) ELSE greatest(coalesce(repeat, 0), 0.5) END)
    * CASE WHEN r_material IS NULL THEN coalesce(sm.share, 1) ELSE 1 END * CASE WHEN r_finish IS NULL THEN coalesce(sf.share, 1) ELSE 1 END * CASE WHEN r_nominal IS NULL THEN coalesce(st.share, 1) ELSE 1 END AS wt
  FROM pairs p LEFT JOIN profile f USING (customer_id) LEFT JOIN buy b ON b.customer_id = p.customer_id AND b.sku = p.sku
  LEFT JOIN sib s ON s.customer_id = p.customer_id AND s.sibling_key = concat(p.b_system, ':', p.b_nominal, ':', p.b_type, ':', {_MATERIAL_FAMILY.format("p.b_material")})
  LEFT JOIN share sm ON sm.customer_id = p.customer_id AND sm.attribute = 'material' AND sm.value = p.b_material
  LEFT JOIN share sf ON sf.customer_id = p.customer_id AND sf.attribute = 'finish' AND sf.value = p.b_finish
  LEFT JOIN share st ON st.customer_id = p.customer_id AND st.attribute = 'threadSystem' AND st.value = p.b_system),
priors AS (SELECT *, coalesce(coalesce(lam, 0) * wt / sum(wt) OVER (PARTITION BY request_id), 0) + (1 - coalesce(lam, 0)) / n AS prior FROM scored)"""
_PRIOR = f"""WITH {_CAT}, {_REQ}, {_HIST}, {_WEIGHTS}, {_JOINED},
pairs AS (SELECT *, CAST({_CREDIT} AS DOUBLE) AS credit, count(*) OVER (PARTITION BY request_id) AS n FROM joined WHERE customer_id IS NOT NULL AND (r_nominal IS NOT NULL OR r_type IS NOT NULL) AND {_SAME_MAT} AND {_SAME_FIN} AND {_SAME_STD} AND {_SAME_LEN}),
{_SCORED}"""


def _personal(spark, sf_dir) -> hs.Personal:
    m = _Matched(spark, sf_dir)
    asked = m.asked.where("customer_id IS NOT NULL AND (q_nominal IS NOT NULL OR size(q_types) > 0)").select("request_id", "customer_id", "class_key", "limit", *hs.STATED)
    fits = mt.compatible(m.rows).select(*hs.CANDIDATE)
    known = hs.Customers.among(br.sales(spark, sf_dir, m.items, m.listed, kept), asked, fits, keep=kept)
    return hs.Personal.of(asked, fits, m.listed, known, keep=kept)


@query(f"{_PRIOR} SELECT request_id, sku, round(prior, 6) AS prior FROM priors")
def history_prior(spark, sf_dir):
    own = _personal(spark, sf_dir)
    return own.every(own.by_kind().withColumn("prior", F.round("prior", 6)), "prior")


@query(f"""{_PRIOR}, posts AS (SELECT *, 0.98 * prior * credit / (0.98 * sum(prior * credit) OVER (PARTITION BY request_id) + 0.02 * pow(3.0, r_residue)) AS p FROM priors),
best AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(p, 15) DESC, sku) AS place FROM posts) SELECT request_id, sku, place, round(p, 6) AS confidence FROM best WHERE place <= 10""")
def personal_topk(spark, sf_dir):
    """The ten best items of each request with a customer, found from cells."""
    own = _personal(spark, sf_dir)
    p = mt.posterior(F.col("prior") * F.col("credit"), F.col("total"), F.col("q_residue"))
    best = mt.top(own.scored(own.candidates(10)).withColumn("p", p), ["request_id"], [F.desc(F.round("p", 15)), F.asc("sku")], 10)
    return best.select("request_id", "sku", F.col("rank").cast("long").alias("place"), F.round("p", 6).alias("confidence"))


@query(f"""{_PRIOR}, posts AS (SELECT *, 0.98 * prior * credit / (0.98 * sum(prior * credit) OVER (PARTITION BY request_id) + 0.02 * pow(3.0, r_residue)) AS p FROM priors)
SELECT request_id, round(max(p), 6) AS best, round(sum(p), 6) AS mass, count(*) AS items FROM posts GROUP BY 1""")
def posterior_history(spark, sf_dir):
    own = _personal(spark, sf_dir)
    residue = own.asked.select("request_id", "q_residue")
    p = mt.posterior(F.col("high"), F.col("total"), F.col("q_residue"))
    mass = mt.posterior(F.col("total"), F.col("total"), F.col("q_residue"))
    return own.extremes().join(own.totals, "request_id").join(residue, "request_id").select("request_id", F.round(p, 6).alias("best"), F.round(mass, 6).alias("mass"), F.col("n_all").alias("items"))


_NAME_M = "(CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.MATERIAL_NAMES.items()) + " END)"
_NAME_F = "(CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.FINISH_NAMES.items()) + " END)"


@query(f"""{_PRIOR}, pref AS (SELECT customer_id, arg_min(value, (-share, value)) FILTER (WHERE attribute = 'material') AS pm, arg_min(value, (-share, value)) FILTER (WHERE attribute = 'finish') AS pfin FROM share GROUP BY 1),
r AS (SELECT priors.*, pm, pfin, max(b_material = pm) OVER (PARTITION BY request_id) AS has_m, max(b_finish = pfin) OVER (PARTITION BY request_id) AS has_f,
  coalesce(r_material <> pm AND NOT (r_material = 'stainless' AND {_MATERIAL_FAMILY.format("pm")} = 'stainless'), FALSE) AS over_m, coalesce(r_finish <> pfin, FALSE) AS over_f FROM priors LEFT JOIN pref USING (customer_id))
SELECT request_id, sku, CASE WHEN lam IS NULL THEN NULL WHEN over_m OR over_f THEN concat('history prefers ', {_NAME_M.format("pm")}, ' ', {_NAME_F.format("pfin")}, '; overridden by the query')
  WHEN bought IS NOT NULL THEN concat('bought ', bought, 'x, last ', last_order_date) WHEN sibling IS NOT NULL THEN concat('shares diameter, type and material family with ', sibling)
  WHEN NOT over_m AND NOT has_m THEN concat('no ', {_NAME_M.format("pm")}, ' in the compatible set; material could not be matched')
  WHEN NOT over_f AND NOT has_f THEN concat('no ', {_NAME_F.format("pfin")}, ' in the compatible set; finish could not be matched')
  ELSE concat('history prefers ', {_NAME_M.format("pm")}, ' ', {_NAME_F.format("pfin")}) END AS reason FROM r""")
def personal_reasons(spark, sf_dir):
    own = _personal(spark, sf_dir)
    return own.every(hs.reasoned(own.by_kind(own.preferred())), "reason")


def _referenced(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    asked = br.requests(spark, sf_dir, references=True).withColumn("spec", query_spec("query"))
    specs = br.line_specs(spark, sf_dir, kept)
    return hs.routed(kept(asked), kept(hs.slim(br.history_with_specs(spark, sf_dir, specs), "description", "quantity")), br.customers(spark, sf_dir), specs)


_PLACED = f"""ref AS (SELECT * FROM ({br.REFERENCES}) x),
agree AS (SELECT request_id, form, h.* FROM ref JOIN hist h USING (customer_id) WHERE CASE form WHEN 0 THEN b_type IN ('flat_washer', 'lock_washer') WHEN 2 THEN b_type = 'hex_cap_screw' ELSE b_type = 'hex_nut' END),
latest AS (SELECT *, min(line_no) OVER (PARTITION BY request_id, sku) AS first_line, row_number() OVER (PARTITION BY request_id, sku ORDER BY order_date DESC, line_no) AS pick FROM agree),
placed AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY order_date DESC, first_line) - 1 AS place FROM latest WHERE pick = 1)"""
_REF = f"WITH {_CAT}, {_HIST}, {_PLACED}"


@query(f"{_REF} SELECT request_id, sku, place, order_date, quantity, round(0.7 * pow(0.8, place), 6) AS confidence FROM placed")
def order_reference(spark, sf_dir):
    _, found = _referenced(spark, sf_dir)
    return found.select("request_id", "sku", F.col("place").cast("long").alias("place"), "order_date", "quantity", F.round(0.7 * F.pow(F.lit(0.8), "place"), 6).alias("confidence"))


@query(f"""{_REF} SELECT request_id, CASE WHEN request_id % 10 IN (2, 3) THEN CASE WHEN placed.sku IS NULL THEN 'unresolved' ELSE 'override' END WHEN placed.sku IS NULL THEN 'unresolved' ELSE 'pure' END AS form,
  CASE WHEN request_id % 10 IN (2, 3) AND placed.sku IS NOT NULL THEN b_nominal END AS nominal, CASE WHEN request_id % 10 IN (2, 3) AND placed.sku IS NOT NULL THEN b_mm END AS mm,
  CASE WHEN placed.sku IS NOT NULL THEN CASE request_id % 10 WHEN 2 THEN 'brass' WHEN 3 THEN 'ss_316' END END AS material,
  CASE WHEN placed.sku IS NOT NULL THEN CASE request_id % 10 WHEN 2 THEN b_finish WHEN 3 THEN 'plain' END END AS finish,
  CASE WHEN placed.sku IS NULL OR request_id % 10 < 2 THEN '' WHEN request_id % 10 = 2 THEN CASE WHEN b_material <> 'brass' THEN 'material' ELSE '' END
    ELSE concat_ws(',', CASE WHEN b_material <> 'ss_316' THEN 'material' END, CASE WHEN b_finish <> 'plain' THEN 'finish' END) END AS changed
FROM (SELECT request_id FROM ref) r LEFT JOIN (SELECT * FROM placed WHERE place = 0) placed USING (request_id)""")
def override_reference(spark, sf_dir):
    out, _ = _referenced(spark, sf_dir)
    s = F.when(F.col("form") == "override", F.col("spec"))
    return out.select("request_id", "form", s["diameter"]["nominal"].alias("nominal"), s["length"]["mm"].alias("mm"), s["material"]["value"].alias("material"), s["finish"]["value"].alias("finish"), F.coalesce(F.array_join("changed", ","), F.lit("")).alias("changed"))


# --- Formatting ---


@query(f"""
WITH {_CAT} SELECT sku, CASE WHEN b_mm IS NULL THEN NULL WHEN b_system = 'metric' THEN concat(b_length, ' mm') ELSE concat(b_length, '"') END AS length,
  CASE WHEN b_system = 'metric' OR k % 2 = 1 THEN b_nominal ELSE concat(b_nominal, '-', b_pitch) END AS diameter, replace(b_type, '_', ' ') AS type, {_NAME_M.format("b_material")} AS material, {_NAME_F.format("b_finish")} AS finish FROM cat""")
def formatted_names(spark, sf_dir):
    s = F.col("spec")
    return br.catalog_items(spark, sf_dir).select("sku", ex.length_name(s["length"]).alias("length"), ex.diameter_name(s["diameter"]["system"], s["diameter"]["nominal"], s["pitch"]).alias("diameter"), ex.type_name(F.col("i_type")).alias("type"), ex.material_name(F.col("i_material")).alias("material"), ex.finish_name(F.col("i_finish")).alias("finish"))


# --- Whole answers ---


@query(f"""{_MATCH}, {_COUNTS}, {_STEPS}, {_RANKED},
best AS (SELECT request_id, CASE WHEN r_nominal IS NOT NULL OR r_type IS NOT NULL THEN string_agg(sku, ',' ORDER BY place) END AS skus, count(*) AS shown, bool_and(even) AS even FROM ranked WHERE place <= "limit" GROUP BY request_id, r_nominal, r_type),
alts AS (SELECT request_id, count(*) AS near, min(CASE WHEN place = 1 THEN sku END) AS first_alternative FROM (SELECT near.*, c.n, CASE WHEN c.n IS NULL THEN near."limit" ELSE near."limit" - c.n END AS room FROM near JOIN (SELECT request_id, n FROM counts) c USING (request_id)) x WHERE place <= room AND (n IS NULL OR r_nominal IS NOT NULL OR r_type IS NOT NULL) GROUP BY 1)
SELECT request_id, {_STATUS} AS status, coalesce(n, 0) AS compatible_count, skus, coalesce(shown, 0) AS shown, coalesce(near, 0) AS near, first_alternative,
  concat(CASE WHEN n IS NULL THEN 'failedConstraint,' ELSE '' END, CASE WHEN r_residue = 1 THEN 'unverifiedResidue,' ELSE '' END, CASE WHEN n > 1 AND even AND (r_nominal IS NOT NULL OR r_type IS NOT NULL) THEN 'tiedSet,' ELSE '' END) AS notes
FROM counts LEFT JOIN best USING (request_id) LEFT JOIN alts USING (request_id)""")
def match_responses(spark, sf_dir):
    """Every request's whole answer, by an engine without a history (the SKUs of lexical answers are bm25_ranked's)."""
    out = _engine(spark, sf_dir).match(_stored_requests(spark, sf_dir))
    skus = F.when(F.col("status").isin("unique", "ambiguous"), F.array_join("results.sku", ","))
    notes = F.concat(F.array_join("notes.code", ","), F.when(F.size("notes") > 0, ",").otherwise(""))
    return out.select("request_id", "status", "compatible_count", skus.alias("skus"), F.size("results").cast("long").alias("shown"), F.size("alternatives").cast("long").alias("near"), F.get(F.col("alternatives"), F.lit(0))["sku"].alias("first_alternative"), notes.alias("notes"))


_BY = "(SELECT request_id, list_filter([" + ", ".join(f"CASE WHEN count(DISTINCT coalesce(CAST({c} AS VARCHAR), '')) > 1 THEN '{a}' END" for a, c in (("diameter", "b_nominal"), ("pitch", "CASE WHEN k % 2 = 0 THEN b_pitch END"), ("length", "b_mm"), ("type", "b_type"), ("material", "b_material"), ("finish", "b_finish"), ("standard", "b_standard"))) + "], lambda x: x IS NOT NULL) AS words FROM pairs GROUP BY 1) d"


@query(f"""{_MATCH}, {_COUNTS} SELECT request_id, CASE WHEN n = 1 THEN '1 compatible item' WHEN n > 1 AND (r_nominal IS NOT NULL OR r_type IS NOT NULL) THEN concat(n, ' compatible items') END AS headline,
  CASE WHEN n = 1 THEN 'Exactly one catalog item satisfies this query.' WHEN len(words) = 0 THEN 'No further attribute would separate these options.'
    ELSE concat('Specify ', CASE WHEN len(words) = 1 THEN words[1] ELSE concat(array_to_string(words[1:-2], ', '), ' or ', words[-1]) END, ' to narrow these down.') END AS sentence,
  CAST(CASE WHEN n > 1 THEN greatest(least(n, 10) - least(n, "limit"), 0) ELSE 0 END AS BIGINT) AS more
FROM counts JOIN {_BY} USING (request_id) WHERE n > 0 AND (r_nominal IS NOT NULL OR r_type IS NOT NULL)""")
def display_sentences(spark, sf_dir):
    out = dp.displayed(_engine(spark, sf_dir).match(_stored_requests(spark, sf_dir)))
    return out.where("status IN ('unique', 'ambiguous')").select("request_id", "headline", "sentence", F.col("more").cast("long").alias("more"))


@query(f"""
WITH {_CAT}, {_REQ}, t AS (SELECT sku, unnest(string_split(lower(description), ' ')) AS term FROM act), tf AS (SELECT sku, term, count(*) AS tf FROM t GROUP BY 1, 2),
dl AS (SELECT sku, sum(tf) AS dl FROM tf GROUP BY 1), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
q AS (SELECT request_id, unnest(string_split(coalesce(r_words, query), ' ')) AS term FROM req),
s AS (SELECT request_id, sku, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM q JOIN tf USING (term) JOIN dl USING (sku) JOIN df USING (term) CROSS JOIN c GROUP BY 1, 2),
r AS (SELECT request_id, count(*) AS hits, list(score ORDER BY score DESC) AS best FROM s GROUP BY 1)
SELECT request_id, coalesce(hits, 0) AS compatible_count, CASE WHEN hits IS NULL THEN 'none' WHEN hits = 1 OR 1 - best[2] / best[1] >= 0.01 THEN 'unique' ELSE 'ambiguous' END AS status
FROM req LEFT JOIN r USING (request_id)""")
def lexical_control(spark, sf_dir):
    items = kept(br.catalog_items(spark, sf_dir))
    answers, _ = lx.lexical_only(kept(br.requests(spark, sf_dir)), items, keep=kept)
    return answers.select("request_id", "compatible_count", "status")


#: Every request that is matched, as REQUESTS has them: plain ones, references without an earlier line, and earlier lines with what is asked of them now.
_ASKS = f"""{_PLACED}, based AS (SELECT r.request_id, r.customer_id, r."limit", r.form, p.sku AS base, p.b_nominal, p.b_system, p.b_type, p.b_mm, p.b_finish FROM ref r LEFT JOIN (SELECT * FROM placed WHERE place = 0) p USING (request_id)),
req AS (SELECT request_id, customer_id, "limit", 'plain' AS form, r_nominal, r_system, r_type, r_type2, r_type3, r_ts, r_ts3, r_ms, r_mm, r_standard, r_material, r_finish, r_residue FROM ({br.REQUESTS}) y
  UNION ALL SELECT request_id + 10000000, customer_id, "limit", CASE WHEN base IS NULL THEN 'unresolved' ELSE 'override' END, b_nominal, b_system,
    CASE form WHEN 0 THEN 'flat_washer' WHEN 2 THEN 'hex_cap_screw' ELSE 'hex_nut' END, CASE form WHEN 0 THEN 'lock_washer' END, NULL, CASE form WHEN 0 THEN 0.6 ELSE 1.0 END, 0.4, 1.0, b_mm, NULL,
    CASE form WHEN 2 THEN 'brass' WHEN 3 THEN 'ss_316' END, CASE WHEN form = 3 THEN 'plain' ELSE b_finish END, CASE form WHEN 1 THEN 0 ELSE 1 END FROM based WHERE base IS NULL OR form >= 2)"""
_ROOM = 'CASE WHEN c.n IS NULL THEN near."limit" ELSE near."limit" - c.n END'


@query(f"""WITH {_CAT}, {_HIST}, {_ASKS}, {_WEIGHTS}, {_JOINED}, {_PAIRS}, {_COUNTS}, {_STEPS}, {_SCORED},
posts AS (SELECT *, prior * credit AS worth, 0.98 * prior * credit / (0.98 * sum(prior * credit) OVER (PARTITION BY request_id) + 0.02 * pow(3.0, r_residue)) AS p FROM priors WHERE r_nominal IS NOT NULL OR r_type IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(p, 15) DESC, sku) AS place, max(worth) OVER (PARTITION BY request_id) - min(worth) OVER (PARTITION BY request_id) <= 1e-9 * max(worth) OVER (PARTITION BY request_id) AS even FROM posts),
best AS (SELECT request_id, string_agg(sku, ',' ORDER BY place) AS skus, round(max(p), 6) AS confidence, bool_and(even) AS even FROM ranked WHERE place <= "limit" GROUP BY 1),
alts AS (SELECT request_id, string_agg(sku, ',' ORDER BY place) AS near FROM (SELECT near.*, c.n, {_ROOM} AS room FROM near JOIN (SELECT request_id, n FROM counts) c USING (request_id)) x WHERE place <= room AND (n IS NULL OR r_nominal IS NOT NULL OR r_type IS NOT NULL) GROUP BY 1),
gone AS (SELECT request_id, count(DISTINCT sku) AS n_gone FROM req JOIN (SELECT * FROM buy WHERE NOT active) b USING (customer_id) WHERE (r_nominal IS NULL OR r_nominal = b_nominal) AND (r_type IS NULL OR b_type = r_type OR coalesce(b_type IN (r_type2, r_type3), FALSE)) GROUP BY 1)
SELECT request_id, {_STATUS} AS status, coalesce(n, 0) AS compatible_count, skus, confidence, coalesce(near, '') AS alternatives,
  concat(CASE WHEN n IS NULL THEN 'failedConstraint,' ELSE '' END, CASE WHEN r_residue = 1 THEN 'unverifiedResidue,' ELSE '' END, CASE WHEN n > 1 AND even THEN 'tiedSet,' ELSE '' END, CASE WHEN form <> 'plain' THEN 'historyReference,' ELSE '' END, repeat('discontinued,', coalesce(n_gone, 0))) AS notes
FROM counts LEFT JOIN best USING (request_id) LEFT JOIN alts USING (request_id) LEFT JOIN gone USING (request_id)
UNION ALL SELECT request_id + 10000000, 'history', 0, string_agg(sku, ',' ORDER BY place), 0.7, '', CASE WHEN min(placed.form) = 0 THEN 'unverifiedResidue,' ELSE '' END
FROM placed WHERE form < 2 AND place < 5 GROUP BY request_id""")
def match_with_history(spark, sf_dir):
    """Every request with its customer: the whole answer, references included (the SKUs of lexical answers are bm25_scores's)."""
    asked = br.requests(spark, sf_dir).unionByName(br.requests(spark, sf_dir, references=True).withColumn("request_id", F.col("request_id") + 10_000_000))
    out = _engine(spark, sf_dir, history=True).match(asked)
    told = F.col("status").isin("unique", "ambiguous", "history")
    notes = F.concat(F.array_join("notes.code", ","), F.when(F.size("notes") > 0, ",").otherwise(""))
    first = F.round(F.get(F.col("results"), F.lit(0))["confidence"], 6)
    return out.select("request_id", "status", "compatible_count", F.when(told, F.array_join("results.sku", ",")).alias("skus"), F.when(told, first).alias("confidence"), F.array_join("alternatives.sku", ",").alias("alternatives"), notes.alias("notes"))


# --- Evaluation: every part's request labelled with the part's own SKU ---

_SEEN = """best AS (SELECT request_id, sku, row_number() OVER (PARTITION BY request_id ORDER BY round(credit, 9) DESC, sku) AS place, n FROM pairs),
label AS (SELECT k AS request_id, sku AS intended FROM cat), hit AS (SELECT label.request_id, intended, place FROM label JOIN req USING (request_id) LEFT JOIN best ON best.request_id = label.request_id AND best.sku = intended)"""


def _outcomes(spark, sf_dir) -> DataFrame:
    """request_id, intended, expected_status, status, place, first, returned, hits, wanted, confidence."""
    m = _Matched(spark, sf_dir)
    summed = kept(m.summary)
    full = kept(mt.ranked_without_customer(m.rows, summed, m.listed, most=1 << 30))
    first = full.where("rank = 1").select("class_key", F.col("sku").alias("first"), "confidence")
    labels = first_by(br.catalog(spark, sf_dir), ["sku"], [F.col("line_no")]).select(F.col("line_no").alias("request_id"), F.col("sku").alias("intended"))
    out = m.by_request(summed.join(first, "class_key", "left")).join(labels, "request_id")
    out = out.join(full.select("class_key", F.col("sku").alias("intended"), F.col("rank").alias("place")), ["class_key", "intended"], "left")
    expected = F.when(F.col("request_id") % 12 == 6, "unparsed").when(F.col("request_id") % 12 == 4, "unique").otherwise("ambiguous")
    hits = F.when(F.col("place").isNull(), 0).otherwise(1)
    return out.select("request_id", "intended", expected.alias("expected_status"), "status", "place", "first", F.col("compatible_count").alias("returned"), hits.alias("hits"), F.lit(1).alias("wanted"), "confidence")


@query(f"""{_MATCH}, {_SEEN} SELECT count(*) AS cases, round(avg(CAST(coalesce(place = 1, FALSE) AS INT)), 6) AS hit1, round(avg(CAST(coalesce(place <= 3, FALSE) AS INT)), 6) AS hit3, round(avg(coalesce(1.0 / place, 0)), 6) AS mrr FROM hit""")
def eval_retrieval(spark, sf_dir):
    return ev.retrieval(_outcomes(spark, sf_dir))


_EXPECTED = "CASE WHEN request_id % 12 = 6 THEN 'unparsed' WHEN request_id % 12 = 4 THEN 'unique' ELSE 'ambiguous' END"
_ALL = "(SELECT unnest(['unique', 'ambiguous', 'none', 'history', 'unparsed']))"


@query(f"""{_MATCH}, {_COUNTS}, o AS (SELECT {_EXPECTED} AS expected, {_STATUS} AS actual FROM counts), g AS (SELECT expected, actual, count(*) AS cases FROM o GROUP BY 1, 2),
e AS (SELECT unnest(['unique', 'ambiguous', 'none', 'history', 'unparsed']) AS expected), a AS (SELECT unnest(['unique', 'ambiguous', 'none', 'history', 'unparsed']) AS actual)
SELECT expected, actual, coalesce(cases, 0) AS cases FROM e CROSS JOIN a LEFT JOIN g USING (expected, actual)""")
def eval_confusion(spark, sf_dir):
    return ev.confusion(_outcomes(spark, sf_dir))


@query(f"""{_MATCH}, {_COUNTS}, got AS (SELECT request_id, count(*) AS returned, count(*) FILTER (WHERE k = request_id) AS hits FROM pairs GROUP BY 1)
SELECT count(*) AS cases, round(avg(coalesce(hits * 1.0 / returned, 0)), 6) AS precision, round(avg(CAST(coalesce(hits, 0) AS DOUBLE)), 6) AS recall, round(avg(CASE WHEN returned = 1 AND hits = 1 THEN 1.0 ELSE 0.0 END), 6) AS exact_rate
FROM req LEFT JOIN got USING (request_id) WHERE {_EXPECTED} = 'ambiguous'""")
def eval_set_recovery(spark, sf_dir):
    return ev.set_recovery(_outcomes(spark, sf_dir))


@query(f"""{_MATCH}, {_RANKED}, top1 AS (SELECT request_id, sku, {_P} AS p, place, n, r_nominal, r_type FROM ranked),
b AS (SELECT least(9, CAST(floor(p * 10) AS INT)) AS bin, count(*) AS cases, count(*) FILTER (WHERE cat.k = request_id) AS hits FROM top1 JOIN cat USING (sku) WHERE place = 1 AND (top1.r_nominal IS NOT NULL OR top1.r_type IS NOT NULL) GROUP BY 1)
SELECT i AS bin, round(i / 10.0, 1) AS lower, round((i + 1) / 10.0, 1) AS upper, coalesce(cases, 0) AS cases, round(hits * 1.0 / cases, 6) AS precision FROM (SELECT unnest(range(10)) AS i) r LEFT JOIN b ON bin = i""")
def eval_calibration(spark, sf_dir):
    return ev.calibration(_outcomes(spark, sf_dir))


@query("SELECT count(*) AS cases, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events WHERE value IS NOT NULL")
def eval_latency(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL")
    return ev.latency(events.select(F.col("value").alias("latency_ms")))


@query("""SELECT md5(q) AS form FROM (SELECT regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS q FROM documents WHERE source = 'src0'
  INTERSECT SELECT regexp_replace(lower(text), '[^a-z0-9]', '', 'g') FROM documents WHERE source <> 'src0') x""")
def eval_leaks(spark, sf_dir):
    """Texts of one source that another source repeats, apart from case and punctuation."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.col("text").alias("query"))
    return ev.leaks(docs.where("source = 'src0'"), docs.where("source <> 'src0'")).select(F.md5("form").alias("form"))


# --- Profiling ---


@query(f"WITH c AS (SELECT * FROM ({br.CATALOG}) x) SELECT count(*) AS row_count, count(DISTINCT sku) AS skus, count(*) - count(DISTINCT sku) AS duplicates, count(*) FILTER (WHERE NOT active) AS inactive_rows, count(DISTINCT CASE WHEN NOT active THEN sku END) AS inactive_skus, count(*) FILTER (WHERE description = lower(description)) AS lower_case FROM c")
def catalog_profile_counts(spark, sf_dir):
    return pf.counts(br.catalog(spark, sf_dir))


@query(f"WITH {_CAT} SELECT b_type AS type, count(*) AS skus, count(b_mm) AS with_length, count(b_standard) AS with_standard, count(DISTINCT b_nominal) AS diameters FROM cat GROUP BY 1")
def catalog_profile_types(spark, sf_dir):
    return pf.types(br.catalog_items(spark, sf_dir))


@query(f"WITH c AS (SELECT * FROM ({br.CATALOG}) x) SELECT CASE WHEN k % 4 = 0 THEN 'lower' ELSE 'upper' END AS letters, FALSE AS spaced, CASE WHEN b_length IS NULL THEN 'none' WHEN b_system = 'metric' THEN 'mm' ELSE '\"' END AS unit, b_length IS NOT NULL AS separator, count(*) AS rows FROM c GROUP BY 1, 2, 3, 4")
def catalog_profile_forms(spark, sf_dir):
    return pf.forms(br.catalog(spark, sf_dir))


@query(f"WITH {_CAT} SELECT upper(concat(CASE WHEN k % 3 = 0 THEN b_short ELSE b_phrase END, CASE WHEN b_standard = 'CLASS 8' THEN ' CLASS 8' ELSE '' END)) AS type_phrase, count(*) AS rows FROM cat GROUP BY 1")
def catalog_profile_phrases(spark, sf_dir):
    return pf.phrases(pf.description_fields(first_by(br.catalog(spark, sf_dir), ["sku"], [F.col("line_no")])))


@query(f"WITH {_CAT} SELECT b_type AS type, b_mm AS mm, count(*) AS skus FROM cat WHERE b_mm IS NOT NULL GROUP BY 1, 2")
def catalog_profile_lengths(spark, sf_dir):
    return pf.lengths(br.catalog_items(spark, sf_dir))


@query(f"WITH {_CAT} SELECT b_material AS material, b_finish AS finish, count(*) AS skus FROM cat GROUP BY 1, 2")
def catalog_profile_material_finish(spark, sf_dir):
    return pf.material_finish(br.catalog_items(spark, sf_dir))


@query(f"WITH {_CAT} SELECT b_standard AS standard, count(*) AS skus FROM cat GROUP BY 1")
def catalog_profile_standards(spark, sf_dir):
    return pf.standards(br.catalog_items(spark, sf_dir))


@query(f"WITH {_CAT} SELECT b_system AS system, b_nominal AS nominal, CASE WHEN k % 2 = 0 THEN b_pitch END AS pitch, count(*) AS skus FROM cat GROUP BY 1, 2, 3")
def catalog_profile_diameters(spark, sf_dir):
    return pf.diameters(br.catalog_items(spark, sf_dir))


@query(f"WITH {_CAT}, t AS (SELECT b_nominal, b_type, b_mm, b_material, b_finish, b_standard, count(*) AS c FROM cat GROUP BY ALL) SELECT count(*) AS tuples, count(*) FILTER (WHERE c = 1) AS unique_tuples, max(c) AS most FROM t")
def catalog_profile_tuples(spark, sf_dir):
    return pf.tuples(br.catalog_items(spark, sf_dir))


@query(f"""WITH {_HIST} SELECT customer_id, count(*) AS lines, count(DISTINCT order_date) AS dates, count(DISTINCT sku) AS skus, count(*) - count(DISTINCT sku) AS repeats,
  round(avg(CASE WHEN b_system = 'metric' THEN 1.0 ELSE 0.0 END), 6) AS metric_share, count(DISTINCT CASE WHEN NOT active THEN sku END) AS inactive_skus FROM hist GROUP BY 1""")
def history_profile(spark, sf_dir):
    return pf.history(br.history_with_specs(spark, sf_dir), br.catalog_items(spark, sf_dir))
