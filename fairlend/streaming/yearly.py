"""Yearly application files as a stream (O3 + O19–O25 + O42–O44, incrementally).

The study receives one delimited file per year.  Here the same cleaning and
county aggregation run as a Structured Streaming job over the folder the
files land in: each new file is cleaned (stateless, per micro-batch) and
folded into the per-county state (one state row per county, so state size
is bounded by the number of counties, not by the number of applications).
Offsets and state live in the checkpoint folder: a restarted query resumes
from the last committed batch and loses no file.  A batch that is re-run
after a failure rewrites the whole (complete-mode) table, so the published
result stays exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fairlend.functions import codes
from fairlend.functions import schema as S
from fairlend.operators import models
from fairlend.operators.clean import clean_applications, prep_gap
from fairlend.operators.features import add_comparison_group, add_race_group
from fairlend.operators.gaps import add_gap, group_gap, min_sample
from fairlend.sources import readers, store


def read_yearly_stream(spark: SparkSession, folder: str, sep: str = ",",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw application files arriving in ``folder``, bound by the header they share.

    The header is read once from the files that are there when the stream
    starts; a later file with another header fails its batch instead of being
    read into the wrong columns.
    """
    names = readers.read_delimited(spark, folder, sep).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in names])
    r = (spark.readStream.schema(text).option("header", True).option("sep", sep).option("escape", '"')
         .option("enforceSchema", False))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return readers.bind(r.csv(folder), S.RAW_APPLICATION, S.REQUIRED_RAW)


def county_stats_stream(raw: DataFrame) -> DataFrame:
    """Streaming county statistics: the batch operators applied to a stream."""
    apps = clean_applications(raw)
    rows = add_comparison_group(add_race_group(prep_gap(apps)))
    return group_gap(rows)


def start_county_gaps(spark: SparkSession, folder: str, out_path: str, checkpoint: str,
                      min_n: int = codes.MIN_GROUP_N, available_now: bool = True,
                      max_files_per_trigger: int | None = None, keep: int = 2,
                      raw: DataFrame | None = None) -> StreamingQuery:
    """Run the stream; every micro-batch publishes the whole gap table at ``out_path``.

    Complete output mode: each batch carries the full per-county table
    (bounded by the number of counties), thresholded and with the gap.  It is
    published with the last ``keep`` ones kept (:func:`publish`), so a reader
    never meets a table that is being replaced.  ``raw``: the raw rows as a
    stream, where they do not come from files under one header in ``folder``
    (``sources.headers.ingested_stream``).
    """
    if raw is None:
        raw = read_yearly_stream(spark, folder, max_files_per_trigger=max_files_per_trigger)
    stats = county_stats_stream(raw)

    def each(batch: DataFrame, epoch: int) -> None:
        publish(add_gap(min_sample(batch, min_n)), out_path, epoch, keep)

    w = (stats.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
         .foreachBatch(each))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def start_scoring(spark: SparkSession, model_path: str, folder: str, schema: T.StructType, out: str, checkpoint: str,
                  available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """O56 as a stream: Parquet files of prepared rows as they arrive, scored by a saved model, appended as Parquet.

    The file sink's own log makes each row appear once, also after a restart.
    """
    saved = models.load_model(spark, model_path)
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    scored = models.score_rows(saved, r.parquet(folder))
    w = scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


_POINTER = "_current"


def publish(table: DataFrame, out_path: str, epoch: int, keep: int = 2) -> None:
    """Write ``table`` as ``epoch=<n>``, point to it, then remove all but the last ``keep`` epochs.

    The pointer is a small file that is replaced in one step once the epoch is
    whole; whoever reads it before finds the epoch before, which stays for
    ``keep - 1`` further epochs.  An epoch that runs again after a failure is
    written anew; epochs that a failed run left without pointing to them go
    with the older ones.
    """
    spark = table.sparkSession
    table.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
    store.write_text(spark, f"{out_path}/{_POINTER}", str(epoch))
    folders = {int(f.rstrip("/").rsplit("=", 1)[1]): f for f in store.matching(spark, f"{out_path}/epoch=*", folders=True)}
    for old in sorted(folders)[:-max(1, keep)]:
        if old < epoch:
            store.delete(spark, folders[old])


def published_epoch(spark: SparkSession, out_path: str) -> int:
    """The epoch that the pointer names."""
    text = store.read_text(spark, f"{out_path}/{_POINTER}")
    if text is None:
        raise ValueError(f"no epoch has been published at {out_path}")
    return int(text)


def read_county_gaps(spark: SparkSession, out_path: str) -> DataFrame:
    """The gap table that was published last."""
    return spark.read.parquet(f"{out_path}/epoch={published_epoch(spark, out_path)}")
