"""What the corpus operators share: input handling, ASCII folding and shared scratch folders."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the operators read it: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take Spark's fast path, where both mean the same."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Internal column names, each with as many underscores before it as it takes not to clash with the input's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names an operator's results take (in any case)."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a session whose tasks run in the driver's process (local mode, as in
    tests) gets a temporary folder, which goes with the process; on a cluster its absence is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = getattr(spark.sparkContext, "_matchloom_scratch", None)
        if top is None:
            top = tempfile.mkdtemp(prefix="matchloom-")
            atexit.register(shutil.rmtree, top, ignore_errors=True)
            spark.sparkContext._matchloom_scratch = top
    return f"{top.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table to a shared folder and read it back: cuts lineage and outlives its executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def growing(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: never sent through the driver, as a broadcast is, while it is still under Spark's threshold."""
    return df.hint("merge")


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a shared folder that nothing will read again."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def slices(batches: Iterator[pa.RecordBatch], at: int | None = None, rows: int = 512, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that little waits in Python and on the way back to the JVM.

    Each has `rows` rows at most and, if column `at` holds texts, about `size` bytes of them (a longer
    text comes alone).
    """
    for batch in batches:
        begin = 0
        ends = np.arange(batch.num_rows) if at is None else np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while begin < batch.num_rows:
            stop = begin + rows
            if at is not None:
                stop = min(stop, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size, "right")))
            stop = min(max(stop, begin + 1), batch.num_rows)
            yield batch.slice(begin, stop - begin)
            begin = stop
    pa.default_memory_pool().release_unused()
