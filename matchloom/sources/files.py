"""Sources and sinks at the edges of the engine. Inputs are never changed or deleted."""

from __future__ import annotations

import atexit
import io
import re
import shutil
import struct
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.sources import compound


def json_folder(spark: SparkSession, path: str, schema: T.StructType, source: str, key: str = "seq", order: str = "_file") -> DataFrame:
    """Every JSON document below a path, one row per key (the last file by name wins), with its source.

    A corrupt document gives no row; it is kept where it is.
    """
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(whole).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    named = rows.withColumn("_file", F.col("_metadata.file_name")).where(F.col("_corrupt").isNull() & F.col(key).isNotNull())
    picked = named.groupBy(key).agg(F.max_by(F.struct(*schema.fieldNames()), order).alias("r"))
    return picked.select("r.*").withColumn("src", F.lit(source))


def xml_list(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def missing_keys(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a cache does not hold yet."""
    return wanted.join(cached.select(*keys), keys, "left_anti")


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below spark.checkpoint.dir; in local mode without that setting, one that goes with the process."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="matchloom-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
    return f"{top.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a path below `scratch`, and the path within it; s3a means s3."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def rows_of(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none yet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if files.exists(target) else None


def publish(new: DataFrame, target: str, share: float = 0.8) -> bool:
    """Replace a table unless the new one is empty or under `share` of the old one's rows.

    The new table is written beside the old one, counted there, and takes its place by renaming, so
    it may be computed from the old one and a failure before that leaves it as it was. Between the
    two renames there is no table for a moment.
    """
    spark = new.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    aside, away = f"{target}.new-{uuid.uuid4().hex}", f"{target}.old-{uuid.uuid4().hex}"
    new.write.parquet(aside)
    count, old = spark.read.schema(new.schema).parquet(aside).count(), rows_of(spark, target)
    files = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not count or (old is not None and count < share * old.count()):
        files.delete(path(aside), True)
        return False
    if old is not None:
        files.rename(path(target), path(away))
    files.rename(path(aside), path(target))
    files.delete(path(away), True)
    return True


def save_store(tables: dict[str, DataFrame], path: str) -> None:
    """Several named tables as Parquet below one folder (units, matrix, evidence, clusters, descriptions, tracker)."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def load_store(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """The named tables of a store; those it lacks are left out."""
    found = {name: rows_of(spark, f"{path}/{name}") for name in names}
    return {name: rows for name, rows in found.items() if rows is not None}


def export_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, UTF-8, replacing what is there."""
    rows.write.mode("overwrite").json(path)


def valid_vectors(names: DataFrame, store: DataFrame | None) -> DataFrame | None:
    """A vector store (name, embedding) if it holds exactly the wanted names, else None: it has to be computed anew."""
    if store is None:
        return None
    gone = names.select("name").exceptAll(store.select("name")).limit(1).count()
    extra = store.select("name").exceptAll(names.select("name")).limit(1).count()
    return None if gone or extra else store


def hwp_text(stream: bytes) -> str:
    """Text of one decompressed body section: records with a 32-bit head of tag, level and size; tag 67 holds UTF-16.

    Characters beyond the first plane are two units; a lone half becomes the replacement character.
    """
    out, at = [], 0
    while at + 4 <= len(stream):
        head = struct.unpack_from("<I", stream, at)[0]
        at, tag, size = at + 4, head & 0x3FF, head >> 20
        if size == 0xFFF:
            if at + 4 > len(stream):
                break
            size = struct.unpack_from("<I", stream, at)[0]
            at += 4
        if tag == 67:
            units, line, i = stream[at : at + size], bytearray(), 0
            while i + 1 < len(units):
                code = units[i] | units[i + 1] << 8
                if code in (10, 13):
                    line += b"\n\0"
                elif code >= 32:
                    line += units[i : i + 2]
                elif code not in (0, 24, 25, 26, 27, 28, 29, 30, 31):
                    i += 14  # an inline control takes eight units in all
                i += 2
            out.append(line.decode("utf-16-le", "replace"))
        at += size
    return "\n".join(out)


def section_text(xml: str) -> str:
    """Text of a section's XML: the text runs of each paragraph, a line for each paragraph."""
    runs = lambda part: unescape("".join(re.findall(r"<(?:\w+:)?t(?:\s[^>]*)?>(.*?)</(?:\w+:)?t>", part, re.S)))
    return "\n".join(re.sub(r"<[^>]+>", "", runs(part)) for part in re.split(r"</(?:\w+:)?p>", xml)[:-1])


def shown_name(name: str) -> str:
    """A member's name as archives of the region mean it: bytes that were taken for code page 437 are 949."""
    try:
        return name.encode("cp437").decode("cp949")
    except UnicodeError:
        return name


def attachment_text(name: str, data: bytes, depth: int = 2) -> str:
    """Text of a HWP document (compound or zipped), or of an archive of them, each below its name; what can't be read is empty."""
    try:
        if data[:8] == compound.MAGIC:
            parts = [hwp_text(section) for section in compound.body_sections(data)]
        elif data[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(data)) as box:
                parts = [section_text(box.read(inner).decode("utf-8", "replace")) for inner in sorted(box.namelist()) if re.search(r"(?i)Contents/section\d*\.xml$", inner)]
                if not parts and depth:
                    found = [(shown_name(inner), attachment_text(inner, box.read(inner), depth - 1)) for inner in box.namelist() if re.search(r"(?i)\.(zip|hwpx?)$", inner)]
                    return "\n\n".join(f"[{shown}]\n{text}" for shown, text in found if text)
        elif name.lower().endswith(".section"):
            parts = [hwp_text(zlib.decompress(data, -15))]
        else:
            parts = []
        return re.sub(r"[ \t]+", " ", "\n".join(p for p in parts if p)).strip()
    except (zipfile.BadZipFile, zlib.error, struct.error, RuntimeError, ValueError, KeyError):
        return ""


# Fixed value: names of attachments that describe a job.
DESCRIBES = r"(?i)직무기술서|직무\s?설명|직무\s?소개|직무설명자료|job\s?description"


def attachments(spark: SparkSession, path: str, describes: str = DESCRIBES) -> DataFrame:
    """(path, text, chars, usable) of the attachments below a path; usable ones are named for a job and have 300 characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [attachment_text(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame({"path": pdf["path"], "text": text})

    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return read.mapInPandas(run, "path string, text string").withColumn("chars", F.length("text")).withColumn("usable", F.regexp_extract("path", r"([^/]*)$", 1).rlike(describes) & (F.length("text") >= 300))
