"""Mixes sources to target weights by capped water-filling and seeded repetition.

Every source has a weight; its target is that share of all words, but no more
than MAX_EPOCHS times the source. What a clamped source cannot take is shared
again among the others by weight until no target is above its cap. That fixed
point is the water level over sources ordered by size per weight, which running
sums over the small table of sources give at once.

A document is repeated floor(target / size of source) times; for the fraction
that is left, some documents are taken once more. Documents fall into size
classes of at most ten percent. Class by class, from the largest, a seeded
rounding says how many of a class are taken, as long as the smaller classes can
still make up for it; so a source comes near its target even if a few long
documents hold most of it. Within a class, every so-many-th document in a seeded
order is taken. Places in that order come from counts of (source, size class,
salt), so no source and no class is ever sorted in one task; the salts grow with
the number of documents, so a cell stays small. What is ordered in one task is
the table of sources, which must be small enough for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

MAX_EPOCHS = 3
SEED = "mix-1"
#: Documents for each salt of one hex digit less.
SALTED = 1 << 20


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) for sizes(source, size).

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. All sums
    are exact integers; a target is one division.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.select("source", "source_size", ((F.row_number().over(by_name) - 1) % 3 + 1).alias("weight"))
    exact = weighed.withColumn("s", F.col("source_size").cast("decimal(20,0)")).withColumn("w", F.col("weight").cast("decimal(10,0)"))
    # sources that fill first come first: size per weight, without a division
    order = Window.orderBy((F.col("source_size") * F.lit(6) / F.col("weight")).cast("long"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = exact.select(
        "*",
        F.sum("s").over(whole).cast("decimal(20,0)").alias("total"),
        F.coalesce(F.sum("s").over(before), F.lit(0)).cast("decimal(20,0)").alias("filled"),
        F.sum("w").over(after).cast("decimal(10,0)").alias("open_w"),
    )
    left = F.col("total") - MAX_EPOCHS * F.col("filled")
    level = level.withColumn("clamped", left * F.col("w") > MAX_EPOCHS * F.col("s") * F.col("open_w"))
    rest = level.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("clamped"), F.col("s"))).over(whole), F.lit(0)).cast("decimal(20,0)").alias("clamped_s"),
        F.coalesce(F.sum(F.when(~F.col("clamped"), F.col("w"))).over(whole), F.lit(0)).cast("decimal(10,0)").alias("rest_w"),
    )
    shared = ((F.col("total") - MAX_EPOCHS * F.col("clamped_s")) * F.col("w")).cast("double") / F.col("rest_w").cast("double")
    target = F.when(F.col("clamped"), (MAX_EPOCHS * F.col("source_size")).cast("double")).otherwise(shared)
    return rest.select("source", "source_size", target.alias("target"))


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """The columns carry of docs and id, source, size, tie, mark (a seeded order) and cell (source, size class, salt)."""
    digits = F.length(F.hex(F.lit(docs.count() // SALTED)))
    known = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(id_col).alias("id"), F.col(source_col).alias("source"), common.word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie"))
    mark = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    marked = known.withColumn("mark", mark).withColumn("salt", F.col("mark").substr(F.lit(1), digits))
    name = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    return marked.withColumn("cell", F.concat_ws("|", _size_class().cast("string"), "salt", name))


def _size_class() -> Column:
    """Digits and first two digits of a size, as one number: a class spans ten percent at most."""
    digits = F.col("size").cast("string")
    return F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")


def _step(state: Column, one: Column) -> Column:
    """Takes some documents of a size class: as many as a seeded rounding says, unless the rest could not make up for it."""
    share = F.when(state["left"] > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), state["need"] / state["left"]))).otherwise(F.lit(0.0))
    low = F.floor(one["n"] * share)
    pick = F.least(one["n"], F.floor(one["n"] * share + one["u"]))
    other = F.when(pick == low, F.least(one["n"], low + 1)).otherwise(low)
    mean, rest = one["s"] / one["n"], state["left"] - one["s"]
    nothing = F.lit(0.0)
    miss = lambda m: F.greatest(nothing, m * mean - state["need"]) + F.greatest(nothing, state["need"] - m * mean - rest)
    taken = F.when(miss(pick) <= miss(other), pick).otherwise(other)
    done = F.concat(state["done"], F.array(F.struct(one["size_class"].alias("size_class"), one["n"].alias("n"), taken.alias("m"))))
    return F.struct((state["need"] - taken * mean).alias("need"), rest.alias("left"), done.alias("done"))


def _plan(sized: DataFrame) -> DataFrame:
    """A row per cell of sized(source, size, salt, cell): where its places begin, how many of its class are taken, and its source's rates."""
    goal = targets(sized.select("source", "size")).withColumnRenamed("source", "g_source")
    counted = sized.groupBy("source", "cell", _size_class().alias("size_class"), "salt")
    cells = counted.agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    earlier = Window.partitionBy("source", "size_class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("source", "size_class", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    classes = cells.groupBy("source", "size_class").agg(F.sum("n").alias("n"), F.sum("s").cast("double").alias("s"))
    seeded = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce("source", F.lit("")), F.col("size_class").cast("string")).cast("binary"))
    u = F.conv(F.substring(seeded, 1, 8), 16, 10).cast("double") / float(1 << 32)
    # at most 90 classes for each digit of the longest size
    listed = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size_class", "n", "s", u.alias("u"))), asc=False).alias("classes"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = goal.withColumn("whole", F.floor(rate))
    rated = listed.join(rated, F.col("source").eqNullSafe(F.col("g_source")))
    start = F.struct(
        (F.col("target") - F.col("whole") * F.col("source_size")).cast("double").alias("need"),
        F.col("source_size").cast("double").alias("left"),
        F.array().cast("array<struct<size_class:int,n:bigint,m:bigint>>").alias("done"),
    )
    walked = rated.select("g_source", "source_size", "target", "whole", F.explode(F.aggregate("classes", start, _step)["done"]).alias("d"))
    taken = walked.select("g_source", "source_size", "target", "whole", F.col("d.size_class").alias("g_class"), F.col("d.n").alias("n"), F.col("d.m").alias("m"))
    same = F.col("source").eqNullSafe(F.col("g_source")) & (F.col("size_class") == F.col("g_class"))
    return bases.join(taken, same).select("cell", "base", "n", "m", "source_size", "target", "whole")


def _repeated(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """sized with copies: how often the mix takes each document."""
    inside = Window.partitionBy("cell").orderBy(F.desc("size"), "mark", "id", "tie")
    placed = sized.withColumn("inside", F.row_number().over(inside) - 1).join(plan, "cell").withColumn("place", F.col("base") + F.col("inside"))
    once_more = F.expr("(place + 1) * m div n - place * m div n")
    return placed.withColumn("copies", (F.col("whole") + once_more).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row per row of docs: (id, source, size, source_size, target, copies, taken).

    Null texts have size 0, null sources are one source that comes last, null
    ids are ordered like an empty id; repeated rows are documents of their own;
    with no words at all every target is 0; an empty table gives an empty
    result; other columns are ignored. Reruns agree.
    """
    sized, _ = common.materialize(_sized(docs, id_col, source_col, text_col, []))
    out = _repeated(sized, _plan(sized))
    return out.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs as the mix takes them: each row as many times as its copies say, perhaps never.

    Nulls, empty and very long texts, empty tables and repeated rows as in mix();
    of rows with equal id and size the text decides which is taken once more, so
    reruns agree; other columns, whatever their names, pass through.
    """
    sized, _ = common.materialize(_sized(docs, id_col, source_col, text_col, []))
    whole = _repeated(_sized(docs, id_col, source_col, text_col, docs.columns), _plan(sized)).filter("copies > 0")
    copied = whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return copied.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
