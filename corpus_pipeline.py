"""Corpus pipeline: each stage applies one operator of ``fastenlake.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the docs of
the next stage.  All but the last return the columns of documents, further columns included.

Defined cases, for every stage: rows are judged by themselves, so a doc_id that repeats with
another text is another document and loses nothing with its namesake; null texts count
as empty; an empty table stays empty.  In stage order: a text without a letter (null, empty)
is in no language and goes, a null doc_id is drawn for fitting like the text ``''``; a null
source is a site of its own; of a near-duplicate group the rows of the least doc_id stay,
null doc_ids only where there is no other; contaminated rows go whatever their doc_id;
rows with a null or repeated doc_id are packed like any other, each for itself.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fastenlake.llm.common import forget, remainder, small_batches, stored_alone, table
from fastenlake.llm.decontaminate import decontaminate
from fastenlake.llm.language_id import accepted
from fastenlake.llm.line_dedup import line_dedup
from fastenlake.llm.packing import packed
from fastenlake.llm.simhash import simhash_dedup

TOKENIZER = "word_bpe_49k.json"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language the models know, go; the labelled rows
    outside the held-out quarter are learned from."""
    small_batches(spark)
    return accepted(docs, remainder(F.col("doc_id"), 4) != 2)


def strip_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines leave the texts but for their first place; every document stays."""
    return line_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (at most three fingerprint bits a link) the document with the least doc_id stays."""
    small_batches(spark)
    return simhash_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, verbatim or re-parameterised, go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document that is left lies in the training sequences."""
    small_batches(spark)
    return packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", strip_boilerplate),
    ("simhash_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("best_fit_packing", pack),
]

#: The stages use learned models and fingerprints that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        before, docs = docs, stored_alone(partial(stage, spark, docs, sf_dir), f"pipeline-{name}")
        forget(before)
    return docs
