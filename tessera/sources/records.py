"""Records: the standard columns (src, id, name, address, country), from files or from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = FILE_SCHEMA) -> DataFrame:
    """A tab-separated file with a header; quoted fields may hold tabs and newlines; values trimmed, nulls empty."""
    raw = spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True, enforceSchema=False)
    return raw.select(*[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in raw.columns])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, matches): the list split at commas, trimmed, empties dropped."""
    raw = read_tsv(spark, path, TRUTH_SCHEMA)
    return raw.select(F.col("source1_entity_id").alias("s1_id"), id_list(F.col("matched_entity_ids")).alias("matches"))


def id_list(c):
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def standardise(raw: DataFrame, default_country: str = "US") -> DataFrame:
    """id, name, address, country, from either spelling of the columns; the default stands in for a missing country column only."""
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in raw.columns], F.lit(""))
    country = F.coalesce(F.col("country"), F.lit("")) if "country" in raw.columns else F.lit(default_country)
    return raw.select(pick("entity_id", "id").alias("id"), pick("business_name", "name").alias("name"), pick("business_address", "address").alias("address"), country.alias("country"))


def with_source(records: DataFrame) -> DataFrame:
    """src is the first part of the id."""
    return records.withColumn("src", F.get(F.split("id", "-"), F.lit(0)))


def pool_of(*sources: DataFrame) -> DataFrame:
    """The bag union of the sources that are searched."""
    first, *rest = sources
    for r in rest:
        first = first.unionByName(r)
    return first


def flatten_pool(cases: DataFrame) -> DataFrame:
    """Every record of the pools of cases(id, pool: array of records)."""
    return cases.select(F.explode("pool").alias("r")).select("r.*")


HOST = r"://([^/?#]*)"
PATH = r"://[^/?#]*([^?#]*)"


def from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of web pages: plain addresses are source S1, those with a query S2, all other forms S3.

    The name is the site's host without the www, m or blog prefix, the address
    its path, the country the path's language.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    host = F.lower(F.regexp_extract("url", HOST, 1))
    src = F.when(F.col("url").contains("?"), "S2").when(F.col("url").rlike(r"(\.html|/|#[^#]*)$"), "S3").otherwise("S1")
    path = F.regexp_extract("url", PATH, 1)
    return pages.select(
        src.alias("src"),
        F.concat(src, F.lit("-"), F.lpad(F.col("page_id").cast("string"), 8, "0")).alias("id"),
        F.replace(F.regexp_replace(host, r"^(www|m|blog)\.", ""), F.lit("."), F.lit(" ")).alias("name"),
        path.alias("address"),
        F.regexp_extract(path, "^/([a-z]{2})/", 1).alias("country"),
    )


def proxy_truth(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """(s1_id, pool_id): a stand-in for truth: pages of one site and language whose numbers share their hundreds."""
    number = lambda: F.expr("try_cast(regexp_extract(address, '([0-9]+)', 1) as bigint) div 100")
    a = s1.select(F.col("id").alias("s1_id"), "name", "country", number().alias("block"))
    b = pool.select(F.col("id").alias("pool_id"), "name", "country", number().alias("block"))
    return a.join(b, ["name", "country", "block"]).select("s1_id", "pool_id")


def sample_by_country(records: DataFrame, share: float = 0.1, seed: int = 42, buckets: int = 4096) -> DataFrame:
    """A share of each country's records, at least one, in a seeded order.

    The order's upper digits are buckets; counts of (country, bucket) say which buckets lie below the share, so only
    the one bucket of a country that the share cuts is ranked.
    """
    marked = records.withColumn("mark_", F.md5(F.concat(F.lit(f"{seed}:"), "id").cast("binary")))
    marked = marked.withColumn("bucket_", (F.conv(F.substring("mark_", 1, 8), 16, 10).cast("long") % (1 << 32) * buckets / (1 << 32)).cast("int"))
    counts = marked.groupBy(F.col("country").alias("country_"), F.col("bucket_").alias("b_")).agg(F.count("*").alias("n"))
    of_country = Window.partitionBy("country_")
    counts = counts.withColumn("before", F.sum("n").over(of_country.orderBy("b_")) - F.col("n")).withColumn("size", F.sum("n").over(of_country))
    counts = counts.withColumn("wanted", F.greatest(F.lit(1), F.floor(F.col("size") * share)) - F.col("before")).filter("wanted > 0")
    met = marked.join(F.broadcast(counts.select("country_", "b_", "n", "wanted")), F.col("country").eqNullSafe(F.col("country_")) & (F.col("bucket_") == F.col("b_")))
    cut = met.filter("wanted < n").withColumn("rank_", F.row_number().over(Window.partitionBy("country_", "b_").orderBy("mark_", "id"))).filter("rank_ <= wanted")
    return met.filter("wanted >= n").select(*records.columns).unionByName(cut.select(*records.columns))


def sample_pool(pool: DataFrame, truth: DataFrame, sample: DataFrame, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Pool records that truth(s1_id, pool_id) matches to the sample, and a seeded share of the others."""
    needed = truth.join(sample.select(F.col("id").alias("s1_id")), "s1_id", "left_semi").select(F.col("pool_id").alias("id")).distinct().withColumn("needed", F.lit(True))
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "id").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return pool.join(needed, "id", "left").filter(F.coalesce("needed", F.lit(False)) | (bucket < share)).drop("needed")
