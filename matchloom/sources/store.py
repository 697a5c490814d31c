"""Derived tables that several steps read: written once, bucketed by the key that they are met by.

A bucketed table joins and groups by its key without an exchange. `once` keeps a table for as long as
the files that it was derived from stay as they are, so queries of one session share the unit, node,
profile and evidence tables. Tables lie below spark.checkpoint.dir and outlive executors; `forget`
removes them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.sources.files import scratch

_KEPT: dict[tuple, str] = {}


def bucket_count(spark: SparkSession) -> int:
    """Buckets of a stored table."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The rows in one partition for each bucket: what is joined or grouped on so needs no other exchange before `save`."""
    return df.repartition(bucket_count(df.sparkSession), *by)


def save(df: DataFrame, *by: str, buckets: int | None = None, lies: bool = False) -> str:
    """Write a table in buckets of `by` (one file each); its name. Rows that lie in the buckets' partitions already aren't exchanged again."""
    spark = df.sparkSession
    n = buckets or bucket_count(spark)
    name = f"matchloom_{uuid.uuid4().hex}"
    (df if lies else df.repartition(n, *by)).write.format("parquet").option("path", scratch(spark, name)).bucketBy(n, *by).sortBy(*by).saveAsTable(name)
    return name


def bucketed(df: DataFrame, *by: str) -> DataFrame:
    """The table, written in buckets of `by`, read back."""
    return df.sparkSession.table(save(df, *by))


def fingerprint(spark: SparkSession, paths: list[str]) -> tuple:
    """Names, sizes and times of all files of some tables."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    out = []
    for path in paths:
        target = hadoop.Path(path)
        listed = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(target, True)
        while listed.hasNext():
            status = listed.next()
            out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


def once(spark: SparkSession, paths: list[str], name: str, build: Callable[[], DataFrame], *by: str, lies: bool = False) -> DataFrame:
    """The table that `build` derives from the files of `paths`, bucketed by `by`; built where it isn't yet or where a file has changed."""
    key = (spark.sparkContext.applicationId, name, fingerprint(spark, paths))
    if key not in _KEPT or not spark.catalog.tableExists(_KEPT[key]):
        _KEPT[key] = save(build(), *by, lies=lies)
    return spark.table(_KEPT[key])


def forget(spark: SparkSession) -> None:
    """Drop every kept table of the session."""
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        spark.sql(f"DROP TABLE IF EXISTS {_KEPT.pop(key)}")
