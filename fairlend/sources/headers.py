"""Delimited files of one folder under different headers (O1–O3), in batch and as a stream.

A yearly delivery may come in parts whose columns stand in another order or
lack some.  Here the files are read as lines with the file each came from.  A
header is a line whose fields hold all required names; every file has its own,
the few distinct ones ("layouts") are parsed by the driver, and each line is
parsed by ``from_csv`` under its file's layout and bound to the schema by name.

The text is passed over twice: once for the header lines (a substring test per
line, in the first split of a file), once for the rows.  The table of files, one
row per file, is written so that Spark joins it by its real size.  Values cannot
hold line breaks (``sinks.write_lossless_csv`` escapes them).
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fairlend.functions.lineage import stored
from fairlend.sources import store
from fairlend.sources.readers import typed

_BOM = "\ufeff"


def with_file(lines: DataFrame) -> DataFrame:
    """(value, file, first): lines of a text reader, their file, and whether they are of its first split."""
    return lines.select("value", F.col("_metadata.file_path").alias("file"),
                        (F.col("_metadata.file_block_start") == 0).alias("first"))


def is_header(value: Column, sep: str, required: Sequence[str]) -> Column:
    """Whether the line's fields, without quotes and blanks around them, hold every required name."""
    named = reduce(lambda a, b: a & b, [F.contains(value, F.lit(c)) for c in required])
    bare = F.transform(F.split(F.replace(value, F.lit(_BOM), F.lit("")), re.escape(sep)),
                       lambda x: F.trim(F.btrim(F.trim(x), F.lit('"'))))
    return named & reduce(lambda a, b: a & b, [F.array_contains(bare, c) for c in required])


def header_names(header: str, sep: str) -> list[str]:
    """The names of a header line; raises if one occurs twice."""
    names = [c.strip().strip('"') for c in next(csv.reader([header.replace(_BOM, "")], delimiter=sep, skipinitialspace=True))]
    twice = sorted({c for c in names if names.count(c) > 1})
    if twice:
        raise ValueError(f"a header names {', '.join(twice)} twice: {header}")
    return names


def file_layouts(lines: DataFrame, sep: str, required: Sequence[str]) -> DataFrame:
    """(file, header, last) of every file that has a header: its least and greatest header line."""
    found = lines.where(F.col("first") & is_header(F.col("value"), sep, required))
    return found.groupBy("file").agg(F.min("value").alias("header"), F.max("value").alias("last"))


def parse(lines: DataFrame, schema: T.StructType, sep: str, required: Sequence[str],
          with_source: bool = False) -> DataFrame:
    """Rows of ``schema`` from lines (value, file, first), each by the header of its file.

    Columns that a file lacks are null, columns that ``schema`` lacks are left
    out, blank lines and repeats of a file's own header are no rows.  Raises if
    a file has two headers that differ, or none and rows (when the rows are read).
    """
    if not required:
        raise ValueError("a header is known by its required columns; name at least one")
    layouts = stored(file_layouts(lines, sep, required), "layouts")
    torn = layouts.where("header <> last").first()
    if torn:
        raise ValueError(f"{torn.file} has two headers: {torn.header} and {torn.last}")
    headers = sorted(r.header for r in layouts.select("header").distinct().collect())
    number = reduce(lambda e, k: e.when(F.col("header") == headers[k], F.lit(k)), range(1, len(headers)),
                    F.when(F.col("header") == headers[0], F.lit(0))) if headers else F.lit(None).cast("int")
    files = layouts.select(F.col("file").alias("__file"), F.col("header").alias("__header"), number.alias("__layout"))
    rows = lines.join(files, F.col("file") == F.col("__file"), "left").where(F.trim("value") != "")
    rows = rows.where(F.col("__header").isNull() | (F.col("value") != F.col("__header")))
    lost = F.raise_error(F.concat(F.col("file"), F.lit(f" has no header with the columns {', '.join(required)}")))
    names = [header_names(h, sep) for h in headers]
    # a file without a header fails here; the other layouts parse the line as text columns
    rows = rows.withColumn("__layout", F.when(F.col("__layout").isNull(), lost.cast("int")).otherwise(F.col("__layout")))
    rows = rows.withColumns({
        f"__as{k}": F.when(F.col("__layout") == k, F.from_csv("value", ", ".join(f"c{i} STRING" for i in range(len(cols))),
                                                              {"sep": sep, "escape": '"', "mode": "PERMISSIVE"}))
        for k, cols in enumerate(names)})
    fields = []
    for f in schema.fields:
        places = [F.col(f"__as{k}")[f"c{cols.index(f.name)}"] for k, cols in enumerate(names) if f.name in cols]
        fields.append((F.coalesce(*places) if places else F.lit(None).cast("string")).alias(f.name))
    source = [F.col("file").alias("source_file")] if with_source else []
    # __layout stays until here: a plan that drops it would not fail for a file without a header
    texts = rows.where(F.col("__layout").isNotNull()).select(*fields, *source)
    return texts.select(*(typed(f.name, f.dataType).alias(f.name) for f in schema.fields),
                        *(["source_file"] if with_source else []))


def read_mixed_headers(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, sep: str = ",",
                       required: Sequence[str] = (), with_source: bool = False) -> DataFrame:
    """O1–O3: delimited files, each under its own header, bound to ``schema`` by name (see :func:`parse`)."""
    return parse(with_file(spark.read.text(path)), schema, sep, required, with_source)


def start_ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: T.StructType, sep: str = ",",
                 required: Sequence[str] = (), available_now: bool = True,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Files as they arrive in ``folder``, each under its own header, as Parquet rows of ``schema``.

    Every micro-batch holds whole files and is written once as ``epoch=<n>`` of
    ``out``: a batch that runs again after a failure leaves an epoch whose write
    was committed as it is, so that a stream over ``out`` sees each row once.
    """
    r = spark.readStream
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = with_file(r.text(folder))

    def write(batch: DataFrame, epoch: int) -> None:
        if not store.exists(spark, f"{out}/epoch={epoch}/_SUCCESS"):
            parse(batch, schema, sep, required).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    w = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def ingested_stream(spark: SparkSession, out: str, schema: T.StructType,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """The rows that :func:`start_ingest` writes, as a stream."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(f"{out}/epoch=*")
