"""Line dedup with levelled sorted runs (native: DataFrame functions only).

Method. Documents come in batches of ascending identifiers. A batch's line keys are hashed, reduced
to the smallest identifier of each, merge-anti-joined with the runs of keys seen before, and what is
new becomes a sorted run of level 0. When a level has FANOUT runs they are merged into one sorted run
of the next level. The runs then say which document owns each line; every other document's copies go.

A run is a table in the shared folder, bucketed and sorted by the hash, all with the same buckets. So
the new keys, dealt to the buckets once, meet run after run in place: no run is shuffled or sorted
again for a batch. Merging the runs of a level deals and sorts them once more, into one file a bucket.

Skew. The keys of a batch are combined before their shuffle, so a line that stands in a third of all
documents is one row per task. Occurrences meet their owners by (hash, identifier), never by the
hash alone, so no line gathers its occurrences in one task. A document's dropped line numbers are
gathered by document, which its own length bounds. Hashes have 128 bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.common import BLANKS, ascii_lower, drop_path, shared_dir, table, unused, without

MIN_CHARS, BATCHES, FANOUT = 10, 6, 3
RESULTS = ("n_lines", "n_dropped", "kept_text")
KEY = ["h1", "h2"]
#: Lets a scan of a run, whose buckets are one sorted file each, count as sorted.
SORTED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SORTED_SCAN)
    spark.conf.set(SORTED_SCAN, "true")
    try:
        yield
    finally:
        spark.conf.set(SORTED_SCAN, before)


class LineRuns:
    """Sorted runs of (hash, owner) by level; their hashes are disjoint."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout, self.made = spark, folder, fanout, 0
        self.levels: list[list[str]] = [[]]
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> str:
        name, self.made = f"{self.name}_{self.made}", self.made + 1
        with sorted_scans(self.spark):
            rows.write.format("parquet").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, f"{self.folder}/{name}")

    def owners(self) -> DataFrame:
        """All runs' rows, from their files; the tables' names leave the catalogue."""
        names = [name for level in self.levels for name in level]
        schema = self.spark.table(names[0]).schema
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{name}" for name in names])

    def add(self, occurrences: DataFrame) -> None:
        """Merge-anti-join one batch (hashes and id) with the runs and add what is new."""
        new = occurrences.groupBy(*KEY).agg(F.min("id").alias("owner")).repartition(self.buckets, *KEY)
        for name in [name for level in self.levels for name in level]:
            new = new.join(self.spark.table(name).select(*KEY).hint("merge"), KEY, "left_anti")
        self.levels[0].append(self._write(new))
        for depth in range(len(self.levels)):
            if len(self.levels[depth]) >= self.fanout:
                runs = [self.spark.table(name) for name in self.levels[depth]]
                # As computed columns the keys don't count as dealt already, so a bucket's parts meet in one task and make one sorted file.
                rows = reduce(DataFrame.unionByName, runs).withColumns({k: F.coalesce(k, F.lit(0).cast("long")) for k in KEY})
                merged = self._write(rows.repartition(self.buckets, *KEY))
                for name in self.levels[depth]:
                    self._forget(name)
                self.levels[depth] = []
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(merged)


def lines_of(text):
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def line_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Drop lines whose key stands in a document with a smaller identifier.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys under
    `min_chars` code points never go. Returns every input row with its columns (those named like a
    result give way to it) and n_lines, n_dropped long, kept_text.

    Defined cases: null text is one empty line. Rows with one identifier are one document: a line
    they share stays in each. Rows without an identifier stay whole and own no line. Identifiers
    that are not numbers are taken in one batch. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = without(docs, *RESULTS)
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    folder = shared_dir(spark, "line-dedup")
    numeric = isinstance(docs.schema[id_col].dataType, T.NumericType)
    cuts = docs.select(ident.alias("id")).approxQuantile("id", [i / batches for i in range(1, batches)], 0.01) if numeric and batches > 1 else []
    batch = sum([(ident > F.lit(c)).cast("int") for c in sorted(set(cuts))], F.lit(0))
    found = (
        rows.where(ident.isNotNull())
        .select(batch.alias("batch"), ident.alias("id"), F.xxhash64(text).alias("row"), F.posexplode(lines_of(text)).alias("pos", "line"))
        .withColumn("key", ascii_lower(F.btrim(F.col("line"), F.lit(BLANKS))))
        .where(F.length("key") >= min_chars)
        .select("batch", "id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    found.write.partitionBy("batch").parquet(f"{folder}/lines")
    lines = spark.read.schema(found.schema).parquet(f"{folder}/lines")
    runs = LineRuns(spark, f"{folder}/runs", fanout)
    for number in range(len(set(cuts)) + 1):
        runs.add(lines.where(F.col("batch") == number))
    owners = runs.owners().select(*KEY, F.col("owner").alias("id"))
    of, row, gone, parts = unused(rows, "of", "row", "gone", "parts")
    dropped = (
        lines.join(owners.hint("merge"), [*KEY, "id"], "left_anti")
        .groupBy(F.col("id").alias(of), F.col("row").alias(row))
        .agg(F.collect_set("pos").alias(gone))
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    joined = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    return (
        rows.join(dropped, (ident == F.col(of)) & (F.xxhash64(text) == F.col(row)), "left")
        .withColumn(parts, lines_of(text))
        .withColumn("n_lines", F.size(parts).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
        .withColumn("kept_text", F.when(F.col(gone).isNull(), F.coalesce(text.cast("string"), F.lit(""))).otherwise(joined))
        .select(*[F.col(f"`{c}`") for c in rows.columns], *RESULTS)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, p[i] AS line,
         translate(trim(p[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))
), o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k),
m AS (SELECT l.doc_id, l.i, l.line, o.owner IS NOT NULL AND o.owner <> l.doc_id AS gone FROM l LEFT JOIN o ON l.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
