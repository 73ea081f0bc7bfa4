"""What the operators share: tables in the shared folder, bounded Arrow batches, table readers."""

from __future__ import annotations

import ctypes
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.store import shared_dir

#: One run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of one Arrow batch; texts differ in length by orders of magnitude, so batches stay short.
BATCH_ROWS = 512

_made: list[str] = []


def bound_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches at BATCH_ROWS or fewer, so that a worker holds few texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def materialize(df: DataFrame, *partition_by: str) -> tuple[DataFrame, str]:
    """Writes df once as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of materialize() that no later plan reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
        if p in _made:
            _made.remove(p)


def made() -> set[str]:
    """The tables of materialize() that still stand."""
    return set(_made)


def release(spark: SparkSession, before: set[str], keep: str | None = None) -> None:
    """Deletes the tables made since before = made(), but for keep: for when what read them has been written."""
    discard(spark, *(p for p in list(_made) if p not in before and p != keep))


_remembered: dict[str, dict] = {}


def remembered(owner: str) -> dict:
    """What this Python worker keeps from task to task for the operator; what it kept for another is given back first.

    Workers outlive a stage, so that each stage would otherwise hold what all before it remembered.
    """
    if owner not in _remembered:
        _remembered.clear()
        _remembered[owner] = {}
        give_back()
    return _remembered[owner]


def give_back() -> None:
    """Free pages of this process go back to the system, where the C library can do that."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null text counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with underscores appended until no column of df has that name (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: Keys that hold more than this share of the rows are joined apart; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def join_hot(rows: DataFrame, named: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """rows joined with named on key, where named has one row per key and, as n, how many of the total rows hold it.

    The named rows of hot keys are broadcast, so no key's rows gather in one task. n goes.
    """
    many = F.col(n) > max(1.0, HOT_SHARE * total)
    hot = F.broadcast(named.filter(many).drop(n))  # 1 / HOT_SHARE rows at most
    cold = rows.join(F.broadcast(named.filter(many).select(key)), key, "left_anti").join(named.filter(~many).drop(n), key)
    return rows.join(hot, key).unionByName(cold)


#: Places of sift()'s bitmap.
SIFT_BITS = 1 << 24


def sift(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows whose long key is surely not among keys, and those whose key may be: an equi-join of the latter decides.

    A broadcast bitmap of SIFT_BITS hashed places tells them apart, so that wide rows of other keys are not shuffled.
    """
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(SIFT_BITS).cast("long"))
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    word, bits = fresh(rows, "word"), fresh(rows, "bits")
    words = keys.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias(word)).agg(F.bit_or(bit).alias(bits))
    known = F.broadcast(words)  # SIFT_BITS / 64 rows at most
    at = fresh(rows, "place")
    placed = rows.withColumn(at, place).withColumn(word, F.shiftright(at, 6)).join(known, word, "left")
    held = F.coalesce(F.col(bits).bitwiseAND(F.expr(f"shiftleft(1L, cast(`{at}` % 64 as int))")) != 0, F.lit(False))
    return placed.filter(~held).select(*rows.columns), placed.filter(held).select(*rows.columns)
