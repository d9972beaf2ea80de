import pytest
from pyspark.sql import functions as F

from fairlend.functions import schema as S
from fairlend.plans import fixture as fx
from fairlend.plans.session import shared_dir
from fairlend.sources import readers, sinks
from tests.conftest import SF001


def test_pipe_roundtrip_and_preview(spark, tmp_out):
    raw = fx.raw_applications(spark, SF001)
    sinks.write_csv(raw, tmp_out, sep="|")
    back = readers.read_delimited(spark, tmp_out, "|", fx.RAW)
    assert back.exceptAll(raw).count() == 0 and raw.exceptAll(back).count() == 0
    cols, head = readers.preview(readers.read_delimited(spark, tmp_out, "|"))
    assert cols == raw.columns and head.count() == 5


def test_yearly_files_with_missing_column(spark):
    a, b = shared_dir(spark, "ya"), shared_dir(spark, "yb")
    spark.createDataFrame([(2022, "10")], "activity_year int, income string").write.option("header", True).csv(a)
    spark.createDataFrame([(2023, "20", "6.5")], "activity_year int, income string, interest_rate string") \
        .write.option("header", True).csv(b)
    sch = S.RAW_APPLICATION
    out = readers.read_yearly_files(spark, [a, b], sch, with_source=True).orderBy("activity_year").collect()
    assert out[0].interest_rate is None and out[1].interest_rate == "6.5"
    assert out[0].source_file != out[1].source_file


def test_single_file_sink(spark):
    df = spark.range(50)
    path = shared_dir(spark, "single")
    sinks.write_single_csv(df, path)
    import os
    local = path[len("file:"):] if path.startswith("file:") else path
    parts = [f for f in os.listdir(local) if f.startswith("part-")]
    assert len(parts) == 1


def test_gap_table_roundtrip(spark, tmp_out):
    from fairlend.operators import gaps
    g = gaps.county_gaps(fx.applications(spark, SF001), min_n=0)
    sinks.write_csv(g, tmp_out)
    back = readers.read_gap_table(spark, tmp_out)
    assert back.exceptAll(g.select(*[f.name for f in S.COUNTY_GAP])).count() == 0


def test_county_dimension_rename(spark, tmp_out):
    spark.createDataFrame([("6037", "6", "Los Angeles")], "GEOID string, STATEFP string, NAME string") \
        .write.option("header", True).csv(tmp_out)
    r = readers.read_county_dimension(spark, tmp_out).first()
    assert (r.county_fips, r.statefp, r.name) == ("06037", "06", "Los Angeles")


def test_partition_pruning(spark, tmp_out):
    sinks.write_parquet(fx.applications(spark, SF001), tmp_out, ["state_code", "activity_year"])
    df = readers.read_parquet_partitioned(spark, tmp_out, states=["TX"]).where(F.col("approved") == 1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "state_code" in plan.split("PartitionFilters")[1][:200]
    assert "PushedFilters: [IsNotNull(approved), EqualTo(approved,1)]" in plan


def test_stream_equals_batch(spark):
    from fairlend.operators import gaps
    from fairlend.streaming import yearly
    landing, out, ck = (shared_dir(spark, n) for n in ("land", "out", "ck"))
    sinks.write_csv(fx.raw_applications(spark, SF001).repartition(3), landing)
    q = yearly.start_county_gaps(spark, landing, out, ck, min_n=0, max_files_per_trigger=1)
    q.awaitTermination()
    streamed = yearly.read_county_gaps(spark, out)
    batch = gaps.county_gaps(fx.applications(spark, SF001), min_n=0)
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0


def test_csv_sink_flattens_vectors(spark, tmp_out):
    import json
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(1, Vectors.dense([0.25, 0.75])), (2, Vectors.sparse(3, [1], [2.0]))],
                               ["id", "probability"])
    sinks.write_csv(df, tmp_out)
    back = {r.id: json.loads(r.probability) for r in
            spark.read.option("header", True).schema("id int, probability string").csv(tmp_out).collect()}
    assert back == {1: [0.25, 0.75], 2: [0.0, 2.0, 0.0]}
