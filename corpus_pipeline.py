"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet in the shared folder and rereads as the next stage's docs.
All but the last return the columns of documents; the last returns the packed
pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, packing, pii_sanitize, simhash_dedup, source_mix, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, learned from the labels of sf_dir, does not reject.

    Null ids are never labelled; null, empty and very long texts are scored like
    any other; repeated rows share their fate; without labels nothing is
    rejected; an empty table stays empty; further columns pass through.
    """
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates.

    Texts without a word are one class; null ids name a class only if it has no
    other; of repeated rows one stays; very long texts are compared whole; an
    empty table stays empty; further columns pass through.
    """
    return simhash_dedup.keep_one(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms replaced by markers; n_chars counts the new text.

    Null and empty texts stay as they are; very long texts are rewritten whole;
    null ids and repeated rows keep their rows; an empty table stays empty;
    further columns pass through.
    """
    return pii_sanitize.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask.

    A null source is a source; null and empty texts have no words and stay as
    their source's rate says; repeated rows are documents of their own; an empty
    table stays empty; further columns pass through.
    """
    return source_mix.repeat_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and place.

    Null and empty texts are one token; very long texts are several pieces; null
    ids and repeated rows are packed like others; an empty table gives an empty
    result; only ids and texts are read.
    """
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("pii", sanitise),
    ("source_mix", mix_sources),
    ("packing", pack),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents of sf_dir.

    Once a stage's rows are written, its intermediate tables and the rows it read
    are deleted, so the shared folder holds two copies of the corpus at most. The
    tables that the last stage's lazy result reads stay.
    """
    docs, last = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        before = common.made()
        docs, path = common.materialize(stage(spark, docs, sf_dir))
        common.release(spark, before, path)
        if last:
            common.discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
