"""A small synthetic linkage benchmark: records with copies, decoys and singletons, and their truth."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "src string, id string, name string, address string, country string, owner string"
#: country: entities, words of names, legal forms, street names, share of decoys
COUNTRIES = {
    "US": (200, "summit harbor maple granite liberty cascade pioneer beacon", ("LLC", "Inc", "Corp"), ("Main St", "Oak Ave", "Pine Rd"), 0.35),
    "India": (230, "शिवम भारत गणेश महाराजा kaveri lotus surya himalaya", ("Private Limited", "Pvt Ltd", "Enterprises"), ("MG Road", "Sector 12", "Park Street"), 0.30),
    "France": (80, "lumiere rhone alpine normande atelier comptoir", ("SARL", "SAS", "S.A.S."), ("Rue Victor Hugo", "Avenue Foch"), 0.45),
}
SINGLETONS = 0.055
BRANCHES = ("Midtown", "Airport", "North", "Express")


def synthetic_rows(seed: int = 42) -> list[tuple]:
    """(src, id, name, address, country, owner); owner is the S1 id that a pool record belongs to, empty for decoys and S1."""
    rng, rows, n = random.Random(seed), [], 0
    for country, (entities, words, forms, streets, decoys) in COUNTRIES.items():
        for _ in range(entities):
            n += 1
            s1, number, street = f"S1-{n:05d}", rng.randint(1, 9999), rng.choice(streets)
            core = " ".join(rng.sample(words.split(), 2)).title()
            name, address = f"{core} {rng.choice(forms)}", f"{number} {street}"
            rows.append(("S1", s1, name, address, country, ""))
            pool = lambda owner, *record: rows.append((src := rng.choice(("S2", "S3")), f"{src}-{len(rows):05d}", *record, country, owner))
            if rng.random() >= SINGLETONS:
                for _ in range(rng.randint(1, 3)):
                    pool(s1, core if rng.random() < 0.3 else name, "" if rng.random() < 0.03 else address)
            if rng.random() < decoys:
                pool("", f"{name} {rng.choice(BRANCHES)}", f"{number + rng.randint(10, 400)} {street}")
    return rows


def synthetic_records(spark: SparkSession, seed: int = 42) -> DataFrame:
    return spark.createDataFrame(synthetic_rows(seed), SCHEMA)


def scaled_records(spark: SparkSession, entities: int, seed: int = 42) -> DataFrame:
    """Five records for each of so many entities, made by column expressions: for timings at sizes that matter.

    An S1 record, a copy, one without its legal form, one with another form, and a decoy at another number. Names are
    two words out of 20,000 and a form out of eight; streets are one of 5,000.
    """
    mark = lambda *of: F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if c in ("e", "copy") else F.lit(c) for c in of]).cast("binary"))
    number = lambda name, below: F.conv(F.substring(mark("e", name), 1, 8), 16, 10).cast("long") % below
    letters = lambda n, name: F.initcap(F.translate(F.substring(F.md5(F.concat(F.lit(name), n.cast("string")).cast("binary")), 1, 7), "0123456789abcdef", "bcdfglmnprstaeio"))
    form = lambda n: F.element_at(F.lit(["Inc", "LLC", "Ltd", "Corp", "Co", "Group", "Partners", "Services"]), (n % 8 + 1).cast("int"))
    rows = spark.range(entities).withColumnRenamed("id", "e").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(4))))
    core = F.concat_ws(" ", letters(number("first", 20_000), "w"), letters(number("second", 20_000), "w"))
    legal = F.when(F.col("copy") == 3, form(number("form", 8) + 1)).otherwise(form(number("form", 8)))
    name = F.when(F.col("copy") == 2, core).when(F.col("copy") == 4, F.concat_ws(" ", core, F.lit("North"))).otherwise(F.concat_ws(" ", core, legal))
    street = F.concat_ws(" ", (number("number", 9000) + F.when(F.col("copy") == 4, 57).otherwise(0)).cast("string"), letters(number("street", 5_000), "s"), F.lit("Street"))
    src = F.when(F.col("copy") == 0, "S1").otherwise(F.when(F.col("copy") % 2 == 1, "S2").otherwise("S3"))
    return rows.select(src.alias("src"), F.format_string("%s-%09d", src, F.col("e") * 5 + F.col("copy")).alias("id"), name.alias("name"), street.alias("address"), F.when(F.col("e") % 3 == 0, "India").otherwise("US").alias("country"))
