"""Readers (O1–O6).  All take explicit schemas: no inference pass over the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlend.functions import schema as S
from fairlend.sources import sinks


def typed(column: str, kind: T.DataType) -> Column:
    """Text → ``kind``; what does not parse is null.

    A whole number may be written with a decimal point (``5.0``), as dataframe
    libraries write integer columns that have gaps.
    """
    x = F.col(f"`{column}`")
    if not isinstance(kind, T.IntegralType):
        return x.try_cast(kind)
    number = x.try_cast("double")
    whole = F.when(number == F.floor(number), number).try_cast(kind)
    return F.coalesce(x.try_cast(kind), whole)


def bind(df: DataFrame, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """Text columns of ``df`` as ``schema``, matched by name; absent columns are null.

    Raises if a column of ``required`` is absent.  Columns that ``schema``
    lacks are left out.
    """
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"the input lacks {', '.join(absent)}; it has {', '.join(df.columns)}")
    return df.select(*[(typed(f.name, f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType))
                       .alias(f.name) for f in schema.fields])


def read_delimited(spark: SparkSession, path: str | Sequence[str], sep: str = "|",
                   schema: T.StructType | None = None, header: bool = True,
                   required: Sequence[str] = (), multi_line: bool = False) -> DataFrame:
    """O1: delimited text with a header row (pipe by default).

    Every column is read as text, without an inference pass, and with
    ``schema`` bound by header name (see :func:`bind`).  All files of ``path``
    must have one header; a file with another one fails the read.  Without a
    header the columns of ``schema`` are taken in order.  ``multi_line`` reads
    quoted values that hold line breaks; such files cannot be split.
    """
    r = (spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
         .option("escape", '"').option("multiLine", multi_line).option("enforceSchema", not header))
    if schema is not None and not header:
        return r.schema(schema).csv(path)
    df = r.csv(path)
    return bind(df, schema, required) if schema is not None else df


def preview(df: DataFrame, n: int = 5) -> tuple[list[str], DataFrame]:
    """O1: column names and the first ``n`` rows (a limit, not a scan of all rows)."""
    return df.columns, df.limit(n)


def read_csv_typed(spark: SparkSession, path: str | Sequence[str],
                   schema: T.StructType | None = S.APPLICATION, infer: bool = False,
                   required: Sequence[str] | None = None, multi_line: bool = False) -> DataFrame:
    """O2: CSV with header, bound to ``schema`` by name; ``infer=True`` keeps the
    study's inference (costs a full extra pass).

    ``required`` columns must be there; for the cleaned applications those of
    ``REQUIRED_APPLICATION`` by default.
    """
    if infer:
        return spark.read.option("header", True).option("escape", '"').option("inferSchema", True).csv(path)
    if required is None:
        required = S.REQUIRED_APPLICATION if schema == S.APPLICATION else ()
    return read_delimited(spark, path, ",", schema, required=required, multi_line=multi_line)


def read_lossless_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
                      sep: str = ",", required: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``sinks.write_lossless_csv``, bound to ``schema`` by name.

    Every column of ``schema`` must be there unless ``required`` names fewer.
    """
    text = read_delimited(spark, path, sep)
    names = {sinks._escaped_name(f.name): f.name for f in schema.fields}
    known = text.select(*[sinks.unescaped(F.col(f"`{c}`")).alias(names.get(c, c)) for c in text.columns])
    return bind(known, schema, schema.names if required is None else required)


def read_yearly_files(spark: SparkSession, paths: Sequence[str], schema: T.StructType,
                      sep: str = ",", with_source: bool = False,
                      required: Sequence[str] = ()) -> DataFrame:
    """O3: one file (or folder) per year, columns matched by header name.

    Years may lack columns (a column added later): each file is read as text
    with its own header, bound by name to ``schema`` (missing → null,
    unparseable → null), and the years are combined with UNION ALL by name.
    Only the header line is read up front; the scans run in parallel.
    ``required`` columns must be in every year.
    """
    frames = []
    for p in paths:
        df = read_delimited(spark, p, sep)
        year = bind(df, schema, required)
        if with_source:
            names = [F.col(f"`{c}`") for c in df.columns]
            df = df.select(*names, F.col("_metadata.file_path").alias("source_file"))
            year = bind(df, T.StructType([*schema.fields, T.StructField("source_file", T.StringType())]), required)
        frames.append(year)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_parquet_partitioned(spark: SparkSession, path: str, states: Sequence[str] | None = None,
                             years: Sequence[int] | None = None) -> DataFrame:
    """The Parquet dataset partitioned by state and year.

    Filters on the partition columns prune directories before any file is
    opened (``PartitionFilters`` in the plan); other filters reach the
    row-group statistics (``PushedFilters``).
    """
    df = spark.read.parquet(path)
    if states is not None:
        df = df.where(F.col("state_code").isin(list(states)))
    if years is not None:
        df = df.where(F.col("activity_year").isin(list(years)))
    return df


def read_county_dimension(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """County attribute table; census names GEOID/STATEFP/NAME are renamed.

    Geometry is not carried: only the attributes the report joins on.
    """
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    df = r.load(path)
    ren = {"GEOID": "county_fips", "STATEFP": "statefp", "NAME": "name"}
    df = df.withColumnsRenamed({old: new for old, new in ren.items() if old in df.columns})
    df = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns if c in ren.values()])
    bound = bind(df, S.COUNTY_DIMENSION, S.COUNTY_DIMENSION.names)
    return bound.withColumns({"county_fips": F.lpad("county_fips", 5, "0"), "statefp": F.lpad("statefp", 2, "0")})


def read_gap_table(spark: SparkSession, path: str) -> DataFrame:
    """Read back a county gap table written as CSV."""
    return read_delimited(spark, path, ",", S.COUNTY_GAP, required=S.COUNTY_GAP.names)


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """``df`` over ``partitions`` tasks, by a round-robin exchange.

    For inputs with fewer splits than that (one Parquet row group, one gzip
    file), whose narrow steps would all run in one task.
    """
    return df.repartition(partitions)
