"""The join of line items and orders is dealt by the bytes of the line items."""

import os

from fairlend.plans import fixture as fx
from fairlend.plans.catalog import QUERIES
from fairlend.plans.session import TARGET_PARTITION_BYTES
from tests.conftest import SF001, SF01


def test_join_partitions_follow_bytes(spark, monkeypatch):
    size = os.path.getsize(f"{SF01}/lineitem.parquet")
    whole = sorted(map(tuple, QUERIES["union_years"](spark, SF01).collect()))
    monkeypatch.setattr(fx, "TARGET_PARTITION_BYTES", 1 << 10)
    monkeypatch.setattr(fx, "JOIN_BYTES", size // 10)
    dealt = fx.lineitem(spark, SF01)
    assert dealt.rdd.getNumPartitions() == -(-size // (size // 10))
    assert "REPARTITION_BY_NUM" in fx.raw_applications(spark, SF01)._jdf.queryExecution().toString()
    assert sorted(map(tuple, QUERIES["union_years"](spark, SF01).collect())) == whole


def test_small_tables_are_not_dealt(spark):
    assert os.path.getsize(f"{SF001}/lineitem.parquet") < TARGET_PARTITION_BYTES
    assert "REPARTITION" not in fx.raw_applications(spark, SF001)._jdf.queryExecution().toString()
