"""Stored, bucketed tables: no exchange on their key, kept until an input file changes."""

import os
import time

import pytest
from pyspark.sql import functions as F

from matchloom.operators import profile
from matchloom.plans import fixtures as fx
from matchloom.settings import TABLES
from matchloom.sources import store

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_meets_without_exchange(spark):
    a = store.bucketed(spark.range(1000).select((F.col("id") % 50).alias("code"), "id"), "code")
    b = store.bucketed(spark.range(300).select((F.col("id") % 50).alias("code"), F.col("id").alias("n")), "code")
    assert "Exchange" not in plan(a.groupBy("code").agg(F.sum("id"))) and "Exchange" not in plan(a.hint("merge").join(b, "code"))
    assert a.count() == 1000 and a.join(b, "code").count() == 6000


def test_once_until_a_file_changes(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(10).write.parquet(path)
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(path)

    assert store.once(spark, [path], "t", build, "id").count() == 10 and store.once(spark, [path], "t", build, "id").count() == 10
    assert len(built) == 1
    time.sleep(1.1)
    spark.range(4).write.mode("append").parquet(path)
    assert store.once(spark, [path], "t", build, "id").count() == 14 and len(built) == 2
    store.forget(spark)
    assert store.once(spark, [path], "t", build, "id").count() == 14 and len(built) == 3


def test_profiles_are_met_in_place(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    nodes = fx.nodes(spark, FOLDER, TABLES)
    units = plan(profile.concentration(nodes, TABLES))
    # Units are told apart in place; what is shuffled has been summed by code and institution before.
    assert units.count("Exchange") <= 2 and "InMemoryTableScan" not in units and "Exchange" not in plan(nodes.select("code", "unit", "inst").distinct())
    items = fx.unit_items(spark, FOLDER)
    assert "Exchange" not in plan(profile.unit_nodes(items, TABLES))
    again = fx.nodes(spark, FOLDER, TABLES)
    assert again.inputFiles() == nodes.inputFiles()
    found = profile.unit_nodes(items, TABLES)
    assert found.exceptAll(nodes.select(found.columns)).count() == 0 == nodes.select(found.columns).exceptAll(found).count()
