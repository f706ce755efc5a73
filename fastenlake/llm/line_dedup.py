"""Cross-site boilerplate line removal; DataFrame functions only.

A line is boilerplate if it stands on at least MIN_SITES distinct sites.

1. Lines become 128-bit keys (two seeded 64-bit hashes of the line without outer
   blanks).  A HyperLogLog sketch of the sites of each key is built map-side and
   merged by aggregation, so a line that stands everywhere costs one sketch per
   task and not one row per occurrence.
2. Estimates clear of the threshold by MARGIN standard errors decide; the lines
   between get exact distinct counts.
3. The first occurrence (smallest doc_id, then position) stays, so that the text
   of widely copied documents survives once; later ones are removed.
4. Only (document key, positions) are gathered.  If all these lists together are small
   they are broadcast and no text is moved; else texts meet their own list by a
   shuffle join.

Defined cases: null text counts as empty and comes back empty; a null site is a
site of its own; blank lines are never boilerplate and stay; a repeated row is
the same document; of a doc_id's several texts with one line at one position each
counts as first; null doc_ids are behind all others; all other columns are kept as
they are, whatever their names; an empty table stays empty; a very long text's lines
are held whole by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_SITES = 3
SKETCH_BITS = 10
MARGIN = 5
#: The most boilerplate keys that are broadcast (24 bytes each); beyond, a shuffle join.
BROADCAST_KEYS = 200_000
#: The most documents and line positions of removal lists that are broadcast (about 40 and 4 bytes); beyond, a shuffle join.
BROADCAST_PLACES = 500_000
BLANKS = " \t\r\x0b\x0c"


def line_keys(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2")]


def _lines(docs: DataFrame, site: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64(text).alias("t1"), F.length(text).alias("t2"), F.coalesce(F.col(site), F.lit("")).alias("site"), text.alias("text"))
    each = base.select("doc_id", "t1", "t2", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    each = each.withColumn("line", F.btrim(F.col("line"), F.lit(BLANKS))).where("line <> ''")
    return each.select("doc_id", "t1", "t2", "site", "pos", *line_keys(F.col("line")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 of the lines on at least min_sites sites."""
    error = MARGIN * 1.04 / 2 ** (SKETCH_BITS / 2)
    low, high = min_sites * (1 - error), min_sites * (1 + error)
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch"))
    rated = stored(sketches.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low), "line-spread")
    sure = rated.where(F.col("sites") > high).select("h1", "h2")
    near = rated.where(F.col("sites") <= high).select("h1", "h2")
    counted = _met(lines, near, rated.count()).groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
    exact = counted.groupBy("h1", "h2").agg(F.count("one").alias("n")).where(F.col("n") >= min_sites).select("h1", "h2")
    return sure.unionByName(exact)


def _met(lines: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    return lines.join(F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys, ["h1", "h2"])


def removals(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, t1, t2 (text key), gone: positions of the lines that go."""
    lines = _lines(docs, site)
    found = stored(boilerplate(lines, min_sites), "boilerplate")
    n_keys = found.count()
    hits = stored(_met(lines, found, n_keys).select("doc_id", "t1", "t2", "pos", "h1", "h2"), "boilerplate-lines")
    at = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "pos")
    first = hits.groupBy("h1", "h2").agg(F.min(at).alias("first"))
    first = first.select("h1", "h2", F.col("first.doc_id").alias("d0"), F.col("first.pos").alias("p0"))
    later = _met(hits, first, n_keys).where(~(F.col("doc_id").eqNullSafe(F.col("d0")) & (F.col("pos") == F.col("p0"))))
    return later.groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("gone"))


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, counts: bool = False) -> DataFrame:
    """docs with boilerplate lines removed from text; counts adds n_lines, n_removed."""
    gone = stored(removals(docs, site, min_sites).select(F.col("doc_id").alias("id"), "t1", "t2", "gone"), "removals")
    size = gone.agg(F.coalesce(F.count(F.lit(1)) + F.sum(F.size("gone")), F.lit(0)).alias("n")).first()["n"]
    text = F.coalesce(F.col("text"), F.lit(""))
    # the row as one struct: no name of its columns can clash
    own = docs.select(F.struct(*[_named(c) for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc"), F.xxhash64(text).alias("k1"), F.length(text).alias("k2"), text.alias("body"))
    same = F.col("doc").eqNullSafe(F.col("id")) & (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2"))
    met = own.join(F.broadcast(gone) if size <= BROADCAST_PLACES else gone, same, "left").withColumn("lines", F.split("body", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.transform(stay, lambda p: F.col("lines")[p])
    clean = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n"))
    more = [F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")] if counts else []
    kept_names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    return met.select(*[clean.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in kept_names], *more)


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")
