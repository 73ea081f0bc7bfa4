"""Checks of result files, as rows of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = "source1_entity_id\tmatched_entity_ids"
CANDIDATE_HEADER = "source1_entity_id\tcandidate_entity_ids"


def file_issue(spark: SparkSession, path: str) -> str | None:
    """missing or empty, if the file is; else None."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return "missing"
    return "empty" if files.getContentSummary(at).getLength() == 0 else None


def candidate_issues(lines: DataFrame) -> DataFrame:
    """(severity, line, s1_id, rule): a warning where a candidate file's header is wrong."""
    wrong = lines.filter("line = 1").filter(F.trim("value") != CANDIDATE_HEADER)
    return wrong.select(F.lit("warning").alias("severity"), F.col("line").cast("int").alias("line"), F.lit("").alias("s1_id"), F.lit("candidate_header").alias("rule"))


def summary(found: DataFrame, most: int = 10) -> tuple[bool, list[str]]:
    """Whether there is no error, and the first issues as text."""
    first = found.orderBy(F.col("severity"), "line", "rule").limit(most).collect()
    return found.filter("severity = 'error'").isEmpty(), [f"{r['severity']}: line {r['line']}: {r['s1_id']}: {r['rule']}" for r in first]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of one text file; line numbers begin at 1. Parts of the file are numbered apart and offset by the lines before."""
    place = F.monotonically_increasing_id()  # the part in the upper bits, the place in it in the lower 33
    rows = spark.read.text(path).select("value", F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    before, total = [], 0
    for r in sorted(rows.groupBy("part").agg(F.count("*").alias("n")).collect(), key=lambda r: r["part"]):  # a row for each part of the file
        before.append((r["part"], total))
        total += r["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    return rows.join(offsets, "part").select((F.col("at") + F.col("before") + 1).cast("int").alias("line"), "value").filter("value <> '' or line = 1")


def parsed(lines: DataFrame, id_sep: str = ",") -> DataFrame:
    fields = F.split("value", "\t")
    ids = F.filter(F.transform(F.split(F.coalesce(F.get(fields, F.lit(1)), F.lit("")), id_sep), lambda x: F.trim(x)), lambda x: x != "")
    return lines.filter("line > 1").select("line", F.size(fields).alias("n_fields"), F.trim(F.get(fields, F.lit(0))).alias("s1_id"), F.get(fields, F.lit(1)).alias("raw"), ids.alias("ids"))


def issues(lines: DataFrame, dialect: str = "batch", expected: DataFrame | None = None, pool: DataFrame | None = None) -> DataFrame:
    """(severity, line, s1_id, rule): what is wrong with a result file.

    expected(id): the S1 records that must all be there; pool(id): the ids that may be listed.
    """
    rows = parsed(lines, "," if dialect == "batch" else r"\s+")
    whole = rows.filter("n_fields <= 2")
    say = lambda df, severity, rule: df.select(F.lit(severity).alias("severity"), F.col("line").cast("int").alias("line"), F.col("s1_id").alias("s1_id"), F.lit(rule).alias("rule"))
    header = lines.filter("line = 1").filter(F.trim("value") != HEADER).select("line", F.lit("").alias("s1_id"))
    again = whole.withColumn("nth", F.row_number().over(Window.partitionBy("s1_id").orderBy("line"))).filter("nth > 1")
    found = [say(header, "error", "header"), say(rows.filter("n_fields > 2"), "error", "columns"), say(again, "error", "duplicate_s1")]
    repeated = whole.filter(F.size("ids") != F.size(F.array_distinct("ids")))
    found.append(say(repeated, "warning" if dialect == "studio" else "error", "repeated_match"))
    found.append(say(whole.filter("s1_id = ''"), "error", "empty_s1"))
    if dialect == "studio":
        found.append(say(whole.filter(F.col("raw").contains(",")), "error", "comma"))
    listed = whole.select("line", "s1_id", F.explode("ids").alias("id"))
    if dialect == "batch":
        found.append(say(listed.filter(~F.col("id").rlike("^S[23]-")).select("line", "s1_id").distinct(), "error", "foreign_id"))
    if expected is not None:
        absent = expected.select(F.col("id").alias("s1_id")).join(whole, "s1_id", "left_anti").withColumn("line", F.lit(0))
        found.append(say(absent, "error", "missing_s1"))
    if pool is not None:
        unknown = listed.join(pool.select("id"), "id", "left_anti").select("line", "s1_id").distinct()
        found.append(say(unknown, "error", "unknown_id"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def subset_issues(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(s1_id, pool_id, rule): matches(s1_id, ids) that candidates(s1_id, ids) lacks, and S1 records that it lacks."""
    absent = matches.join(candidates, "s1_id", "left_anti").select("s1_id", F.lit(None).cast("string").alias("pool_id"), F.lit("missing_in_candidates").alias("rule"))
    m = matches.select("s1_id", F.explode("ids").alias("pool_id"))
    c = candidates.select("s1_id", F.explode("ids").alias("pool_id"))
    return absent.unionByName(m.join(c, ["s1_id", "pool_id"], "left_anti").select("s1_id", "pool_id", F.lit("match_not_candidate").alias("rule")))


def statistics(lists: DataFrame) -> DataFrame:
    """Totals of lists(s1_id, ids)."""
    n = F.size("ids")
    return lists.agg(
        F.count("*").alias("n_s1"), F.sum(F.when(n == 0, 1).otherwise(0)).alias("n_singletons"), F.coalesce(F.sum(n), F.lit(0)).alias("n_pairs"),
        F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_ids"), F.round(F.coalesce(F.avg(n), F.lit(0.0)), 2).alias("mean_ids"),
    )
