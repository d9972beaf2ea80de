"""Application-shaped input derived from the driver's star-schema tables.

The driver's tables are not lending data, so these views only *shape* rows
into the application schema (one row per line item, with deliberate dirt:
null keys, junk numerals, negative amounts, an out-of-scope state,
undecided actions).  They do none of the analysis; every operator that runs
on them is the library's own code, and works on any data of this schema.
The same derivation is written in SQL for the oracle (``plans/oracle.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlend.functions import schema as S
from fairlend.operators.clean import clean_applications
from fairlend.plans.session import TARGET_PARTITION_BYTES, input_bytes

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

# Fixed values of the fixture: customer key mod 12 → race code (None = missing).
_RACE_BY_MOD12 = [1, 2, 21, 27, 3, 3, 4, 5, 5, 5, 6, None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Parquet bytes of line items per task of the join with orders, where they are above TARGET_PARTITION_BYTES.
JOIN_BYTES = 8 * 1024 * 1024


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, dealt by order to as many partitions as their bytes ask for.

    Spark packs join partitions by their compressed bytes; as rows, to be
    sorted, they take about ten times as much.  Small tables stay as they are,
    for orders are broadcast to them.
    """
    li = table(spark, sf_dir, "lineitem")
    size = input_bytes(spark, [f"{sf_dir.rstrip('/')}/lineitem.parquet"])
    return li.repartition(-(-size // JOIN_BYTES), "l_orderkey") if size > TARGET_PARTITION_BYTES else li


def raw_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty application rows (text measures), see FIXTURES.md §2."""
    li = lineitem(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    j = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(c, F.col("o_custkey") == F.col("c_custkey"))
         .join(n, F.col("c_nationkey") == F.col("n_nationkey")))

    mod12 = (F.col("c_custkey") % 12).cast("int")
    race = None
    for k, code in enumerate(_RACE_BY_MOD12):
        val = F.lit(code).cast("int")
        race = F.when(mod12 == k, val) if race is None else race.when(mod12 == k, val)
    race = race.otherwise(F.lit(None).cast("int"))

    ok = F.col("o_orderkey")
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.year("o_orderdate").cast("int").alias("activity_year"),
        F.when(F.col("n_regionkey") < 2, "CA").when(F.col("n_regionkey") < 4, "TX")
         .otherwise("NV").alias("state_code"),
        F.when(ok % 53 == 0, F.lit(None).cast("double"))
         .otherwise((48000 + F.col("n_nationkey") * 7 + F.col("c_custkey") % 7).cast("double"))
         .alias("county_code"),
        F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_quantity") > 48, 4).otherwise(1)
         .cast("int").alias("action_taken"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(None).cast("int"))
         .otherwise((F.col("c_custkey") % 5).cast("int")).alias("applicant_ethnicity_1"),
        race.alias("applicant_race_1"),
        F.when(F.col("l_suppkey") % 50 == 0, F.lit(None).cast("int"))
         .otherwise(((F.col("l_linenumber") - 1) % 4 + 1).cast("int")).alias("loan_type"),
        F.when(F.col("l_partkey") % 97 == 0, -F.col("l_extendedprice"))
         .otherwise(F.col("l_extendedprice")).cast("string").alias("loan_amount"),
        F.when(F.col("l_suppkey") % 23 == 0, F.lit(None).cast("string"))
         .when(F.col("l_partkey") % 89 == 0, F.lit("Exempt"))
         .otherwise((F.col("l_extendedprice") * 2).cast("string")).alias("property_value"),
        F.when(ok % 37 == 0, F.lit(None).cast("string"))
         .when(ok % 41 == 0, F.lit("Exempt"))
         .when(ok % 43 == 0, F.lit("0"))
         .otherwise((F.col("c_acctbal") / 10).cast("string")).alias("income"),
        F.when(F.col("l_returnflag") == "R", F.lit(None).cast("string"))
         .when(F.col("l_suppkey") % 31 == 0, F.lit("NA"))
         .otherwise((F.col("l_discount") * 300).cast("string")).alias("interest_rate"),
    )


# The fixture's row keys ride along with the library's schemas.
_KEYS = [T.StructField("l_orderkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType())]
RAW = T.StructType([*_KEYS, T.StructField("l_partkey", T.LongType()), T.StructField("l_suppkey", T.LongType()),
                    *S.RAW_APPLICATION.fields])
APPLICATION = T.StructType([*_KEYS, *S.APPLICATION.fields])

APPLICATION_COLUMNS = [
    "l_orderkey", "l_linenumber", "activity_year", "state_code", "county_code",
    "action_taken", "approved", "applicant_race_1", "loan_type", "loan_amount",
    "property_value", "income", "interest_rate",
]


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, typed applications: the library's cleaning run on the raw view."""
    return clean_applications(raw_applications(spark, sf_dir)).select(*APPLICATION_COLUMNS)


def county_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County attribute table (fips, state fips, name), see FIXTURES.md §4."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    # seven county slots per nation, generated in place (no join)
    n = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return n.select(
        F.lpad((48000 + F.col("n_nationkey") * 7 + F.col("k")).cast("string"), 5, "0")
         .alias("county_fips"),
        F.when(F.col("n_regionkey") < 2, "06").when(F.col("n_regionkey") < 4, "48")
         .otherwise("32").alias("statefp"),
        F.concat_ws("_", F.col("n_name"), F.col("k").cast("string")).alias("name"),
    )
