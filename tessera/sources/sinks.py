"""Result files: one row for each S1 record, ids comma-joined, as tab-separated text."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_lists(s1: DataFrame, pairs: DataFrame, list_name: str = "matched_entity_ids", sep: str = ",") -> DataFrame:
    """(source1_entity_id, list_name) for every s1(id); the ids of pairs(s1_id, pool_id) in order, none as an empty string."""
    found = pairs.groupBy("s1_id").agg(F.array_sort(F.collect_set("pool_id")).alias("ids"))
    joined = s1.select(F.col("id").alias("s1_id")).join(found, "s1_id", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(F.col("s1_id").alias("source1_entity_id"), F.array_join(ids, sep).alias(list_name))


def write_tsv(rows: DataFrame, path: str) -> None:
    """A folder with part files in the order of the first column; an empty list is an empty field."""
    rows.orderBy(rows.columns[0]).write.csv(path, sep="\t", header=True, emptyValue="", quote="", mode="overwrite")


def write_results(s1: DataFrame, matches: DataFrame, path: str, candidates: DataFrame | None = None) -> None:
    write_tsv(as_lists(s1, matches), f"{path}/matching_results.tsv")
    if candidates is not None:
        write_tsv(as_lists(s1, candidates, "candidate_entity_ids"), f"{path}/candidate_pairs.tsv")


def write_dictionary(spark, words: dict[str, str], path: str) -> None:
    """The transliteration dictionary as (indic_word, latin_word)."""
    write_tsv(spark.createDataFrame(sorted(words.items()), "indic_word string, latin_word string"), path)


def write_config(config, path: str, **more) -> None:
    """A configuration dataclass and what is known about it, as JSON on the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"configuration": asdict(config)} | more, f, indent=2)
