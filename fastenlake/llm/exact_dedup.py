"""Exact dedup by content-defined chunk recipes; DataFrame functions only.

A text is normalised (every character of ``[\\x20\\x09-\\x0D]`` deleted) and cut
where its own content says so: a cut falls behind the first anchor, ANCHOR_RUN
characters of the anchor class in a row, found MIN_CHUNK or more characters into
the chunk, and at MAX_CHUNK at the latest.  Equal texts cut equally, so a text is
its *recipe*, the ordered list of its chunk identifiers.

1. ``recipes``: one pass turns each text into (code points, sha-256, recipe), with a
   SHA-256 digest beside each 64-bit identifier, and is stored.  Texts are read once and
   stay where they are; from here on only recipes move.
2. ``collisions``: identifiers meet once, grouped by (identifier, digest) with map-side
   combining.  An identifier with one digest is verified: equal identifiers then mean
   equal chunks, by the same 256 bits that the result gives for whole texts.
3. Documents with an unverified identifier (two digests under one hash) carry those
   chunks' digests in their key, so they too are told apart.
4. Documents group by recipe; the group rows are stored and join back on the
   recipe.  One hot group is partly combined before the exchange, and adaptive skew
   handling splits the documents' side of the join.

Defined cases: null text counts as empty; all empty texts are one group; a null
doc_id sorts behind every other one; repeated rows of one doc_id are each
returned and counted; extra columns are ignored; an empty table gives no rows; a
very long text's recipe (40 bytes for 512 to 4,096 characters) is held whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_CHUNK, MAX_CHUNK, ANCHOR_RUN = 512, 4096, 5
#: Anchor class: the ASCII letters and digits whose code point leaves 1 or 4 divided
#: by 5 (a class beyond Latin-1 makes the regular expression several times slower;
#: other scripts are cut by length, which is as exact).
ANCHOR_CLASS = "".join(c for c in map(chr, range(48, 123)) if c.isalnum() and ord(c) % 5 in (1, 4))
CUT = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?[{ANCHOR_CLASS}]{{{ANCHOR_RUN}}}|.{{1,{MAX_CHUNK}}}"
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def chunk_id(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def chunks(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CUT), F.lit(0))


def recipes(docs: DataFrame, identify: Callable[[Column], Column] = chunk_id) -> DataFrame:
    """doc_id, n_cp, text_sha256, recipe (ordered chunk identifiers), digests (of the same chunks)."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.select("doc_id", F.length("text").alias("n_cp"), normalised(F.col("text")).alias("norm"))
    base = base.select("doc_id", "n_cp", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm")).alias("chunks"))
    digest = lambda c: F.unhex(F.sha2(c, 256))
    return base.select("doc_id", "n_cp", "text_sha256", F.transform("chunks", identify).alias("recipe"), F.transform("chunks", digest).alias("digests"))


def _chunk_rows(named: DataFrame, *keys: str) -> DataFrame:
    return named.select(*keys, F.posexplode(F.arrays_zip("recipe", "digests")).alias("pos", "x")).select(*keys, "pos", F.col("x.recipe").alias("id"), F.col("x.digests").alias("digest"))


def collisions(named: DataFrame) -> DataFrame:
    """Identifiers under which more than one chunk digest exists."""
    distinct = _chunk_rows(named).groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy("id").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("id")


def _refined(named: DataFrame, bad: DataFrame) -> DataFrame:
    """Adds exact: the digests of unverified chunks, in order.  text_sha256 stands for a row here: equal texts have equal chunks."""
    met = _chunk_rows(named, "text_sha256").join(bad, "id", "left_semi").distinct()
    exact = met.groupBy("text_sha256").agg(F.sort_array(F.collect_list(F.struct("pos", "digest")))["digest"].alias("exact"))
    return named.join(exact, "text_sha256", "left").withColumn("exact", F.coalesce("exact", _none()))


def _none() -> Column:
    return F.array().cast("array<binary>")


def exact_dedup(docs: DataFrame, identify: Callable[[Column], Column] = chunk_id) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    read = stored(recipes(docs, identify), "recipes")
    bad = stored(collisions(read), "chunk-collisions")
    named = read.withColumn("exact", _none()) if bad.isEmpty() else stored(_refined(read, bad), "refined-recipes")
    named = named.drop("digests")
    order = F.struct("n_cp", (-F.col("doc_id")).alias("first"))
    groups = named.groupBy("recipe", "exact").agg(F.count(F.lit(1)).alias("group_size"), (-F.max(order)["first"]).alias("keep_id"))
    groups = stored(groups, "copy-groups")  # on its own, so that the join below can split a hot group's rows
    return named.join(groups, ["recipe", "exact"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
