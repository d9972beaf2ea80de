"""Files under different headers, in batch and as a stream; publishing with retention."""

import os

import pytest
from pyspark.sql import types as T

from fairlend.functions import schema as S
from fairlend.operators import gaps
from fairlend.plans import fixture as fx
from fairlend.plans.session import shared_dir
from fairlend.sources import headers, sinks, store
from fairlend.streaming import yearly
from tests.conftest import SF001

AB = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("x", T.DoubleType())])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def put(folder, **files):
    root = folder.removeprefix("file:")
    os.makedirs(root, exist_ok=True)
    for name, text in files.items():
        with open(f"{root}/{name}.csv", "w", encoding="utf-8", newline="") as f:
            f.write(text)


def test_shuffled_columns_equal_the_ordered_ones(spark):
    raw = fx.raw_applications(spark, SF001)
    path = shared_dir(spark, "mixed")
    early, late = raw.where("activity_year <= 1995"), raw.where("activity_year > 1995")
    sinks.write_csv(early, path)
    sinks.write_csv(late.select(*reversed(late.columns)), path, mode="append")
    got = headers.read_mixed_headers(spark, path, S.RAW_APPLICATION, required=S.REQUIRED_RAW)
    want = raw.select(*S.RAW_APPLICATION.names)
    assert got.schema == S.RAW_APPLICATION
    assert got.count() == want.count() and rows_of(got.groupBy(*got.columns).count()) == rows_of(
        want.groupBy(*want.columns).count())


def test_odd_files(spark):
    path = shared_dir(spark, "odd")
    put(path, a="id,name,x\n1,one,1.5\n2,\"two, too\",2\n\n", b="\ufeffx, \"name\" ,other,id\r\n3.5,three,zzz,3\r\n,,,4\r\n",
        c="name,id\nid and name,5\nname,id\n\"say \"\"hi\"\"\",6.0\n", d="", e="id,name,x\n")
    got = headers.read_mixed_headers(spark, path, AB, required=["id", "name"], with_source=True)
    assert got.columns == ["id", "name", "x", "source_file"]
    assert rows_of(got.drop("source_file")) == sorted(
        [(1, "one", 1.5), (2, "two, too", 2.0), (3, "three", 3.5), (4, None, None), (5, "id and name", None),
         (6, 'say "hi"', None)], key=str)
    assert {r.source_file.rsplit("/", 1)[1] for r in got.where("id >= 5").collect()} == {"c.csv"}


def test_other_separators(spark):
    path = shared_dir(spark, "pipes")
    put(path, a="id|name|x\n1|one|1.5\n", b="x|id|name\n2.5|2|a,b\n")
    assert rows_of(headers.read_mixed_headers(spark, path, AB, sep="|", required=["id"])) == [(1, "one", 1.5), (2, "a,b", 2.5)]


def test_missing_and_torn_headers_raise(spark):
    path = shared_dir(spark, "none")
    put(path, a="id,name,x\n1,one,1.5\n", b="2,two,2.5\n")
    with pytest.raises(Exception, match="b.csv has no header with the columns id, name"):
        headers.read_mixed_headers(spark, path, AB, required=["id", "name"]).select("x").collect()
    path = shared_dir(spark, "torn")
    put(path, a="id,name,x\n1,one,1.5\nname,id,x\n")
    with pytest.raises(ValueError, match="two headers"):
        headers.read_mixed_headers(spark, path, AB, required=["id", "name"])
    path = shared_dir(spark, "twice")
    put(path, a="id,name,id\n1,one,1.5\n")
    with pytest.raises(ValueError, match="names id twice"):
        headers.read_mixed_headers(spark, path, AB, required=["id", "name"])
    with pytest.raises(ValueError, match="required"):
        headers.read_mixed_headers(spark, path, AB)


def test_no_rows(spark):
    path = shared_dir(spark, "empty")
    put(path, a="", b="id,name\n")
    assert headers.read_mixed_headers(spark, path, AB, required=["id"]).collect() == []


def test_stream_of_shuffled_columns_equals_batch(spark):
    raw = fx.raw_applications(spark, SF001)
    landing, rows, out, ck1, ck2 = (shared_dir(spark, n) for n in ("land", "rows", "out", "ck1", "ck2"))
    sinks.write_csv(raw.where("activity_year <= 1995").coalesce(1), landing)
    q = headers.start_ingest(spark, landing, rows, ck1, S.RAW_APPLICATION, required=S.REQUIRED_RAW, max_files_per_trigger=1)
    q.awaitTermination()
    late = raw.where("activity_year > 1995")
    sinks.write_csv(late.select(*reversed(late.columns)).repartition(2), landing, mode="append")
    for _ in range(2):  # the second run finds nothing new
        q = headers.start_ingest(spark, landing, rows, ck1, S.RAW_APPLICATION, required=S.REQUIRED_RAW, max_files_per_trigger=1)
        q.awaitTermination()
    stream = headers.ingested_stream(spark, rows, S.RAW_APPLICATION, max_files_per_trigger=1)
    yearly.start_county_gaps(spark, "", out, ck2, min_n=0, raw=stream).awaitTermination()
    batch = gaps.county_gaps(fx.applications(spark, SF001), min_n=0)
    assert rows_of(yearly.read_county_gaps(spark, out)) == rows_of(batch.select(*yearly.read_county_gaps(spark, out).columns))


def test_two_epochs_are_left_and_readers_see_whole_tables(spark):
    out = shared_dir(spark, "epochs")
    with pytest.raises(ValueError, match="no epoch"):
        yearly.read_county_gaps(spark, out)
    for epoch in range(10):
        before = yearly.read_county_gaps(spark, out) if epoch else None
        yearly.publish(spark.range(epoch + 1, numPartitions=2), out, epoch)
        if before is not None:  # opened before this epoch, read after it
            assert before.count() == epoch
        assert yearly.read_county_gaps(spark, out).count() == epoch + 1
    left = sorted(f.rsplit("=", 1)[1] for f in store.matching(spark, f"{out}/epoch=*", folders=True))
    assert left == ["8", "9"]
    yearly.publish(spark.range(3), out, 9)  # the epoch again, after a failure
    assert yearly.published_epoch(spark, out) == 9 and yearly.read_county_gaps(spark, out).count() == 3


def test_a_write_without_its_pointer_stays_unseen(spark):
    out = shared_dir(spark, "unseen")
    yearly.publish(spark.range(5), out, 0)
    spark.range(99).write.parquet(f"{out}/epoch=1")
    assert yearly.read_county_gaps(spark, out).count() == 5


def test_small_files_are_replaced(spark):
    path = shared_dir(spark, "text")
    assert store.read_text(spark, f"{path}/a") is None
    store.write_text(spark, f"{path}/a", "one")
    store.write_text(spark, f"{path}/a", "two é")
    assert store.read_text(spark, f"{path}/a") == "two é" and len(store.matching(spark, f"{path}/*")) == 1
