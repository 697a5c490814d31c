"""Exact duplicates by content sort (native: DataFrame functions only).

Method. Sampled splitters range-partition the normalised texts; each partition is sorted, so equal
texts are neighbours and are compared in full; the smallest identifier of a run stays.

The splitters hold the head of the normalised text and its 64-bit hash, not the text, which keeps
Spark's sample of them small and spreads texts that share a long head. The comparison itself is on
the whole normalised text.

Skew. A count of the hashes (combined before its shuffle) finds contents that hold more than
1/HOT_SHARE of all rows; there are fewer than HOT_SHARE of those, whatever the input, so they may be
broadcast. Their rows are dealt over several neighbouring pieces by a hash of the identifier, and
the pieces' minima and counts are merged afterwards, again combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.common import table, unused, without

#: A content with more than this part (1/HOT_SHARE) of the rows is dealt over several pieces.
HOT_SHARE = 1024
#: Code points of the normalised text that the splitters hold.
HEAD = 48
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text):
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Mark each row with its group of equal texts.

    Returns every input row with its columns (those named like a result give way to it) and
    keep_id, group_size, kept, text_sha256.

    Defined cases: null text equals empty text. Of repeated rows with the smallest identifier
    exactly one is kept. Null identifiers rank last; a group of only null identifiers keeps one
    row and has a null keep_id. An empty table gives an empty table.
    """
    rows = without(docs, *RESULTS)
    all_least_, all_size_, copies_, first_, hash_, head_, least_, norm_, piece_, pieces_, sha_, size_ = unused(rows, "all_least", "all_size", "copies", "first", "hash", "head", "least", "norm", "piece", "pieces", "sha", "size")
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    hashed = F.xxhash64(normalised(text))
    total = rows.count()
    hot = (
        rows.select(hashed.alias(hash_))
        .groupBy(hash_)
        .agg(F.count(F.lit(1)).alias(copies_))
        .where(F.col(copies_) * HOT_SHARE > F.lit(max(total, HOT_SHARE)))
        .select(hash_, F.ceil(F.col(copies_) * HOT_SHARE / F.lit(max(total, 1))).alias(pieces_))
    )
    keyed = (
        rows.withColumn(hash_, hashed)
        .withColumn(head_, F.left(normalised(text), F.lit(HEAD)))
        .join(F.broadcast(hot), hash_, "left")  # fewer than HOT_SHARE rows
        .withColumn(piece_, F.coalesce(F.pmod(F.xxhash64(ident), F.col(pieces_)) + 1, F.lit(0)))
        .drop(pieces_)
    )
    run = Window.partitionBy(head_, hash_, piece_, norm_)
    dealt = (
        keyed.repartitionByRange(head_, hash_, piece_)
        .withColumn(norm_, normalised(text))
        .withColumn(first_, F.row_number().over(run.orderBy(ident.asc_nulls_last())))
        .withColumn(least_, F.min(ident).over(run))
        .withColumn(size_, F.count(F.lit(1)).over(run))
        .withColumn("text_sha256", F.sha2(norm_, 256))
        .drop(norm_, head_, hash_)
    )
    merged = (
        dealt.where(F.col(piece_) > 0)
        .groupBy(F.col("text_sha256").alias(sha_))
        .agg(F.min(ident).alias(all_least_), F.count(F.lit(1)).alias(all_size_))
    )
    is_hot = F.col(piece_) > 0
    return (
        dealt.join(F.broadcast(merged), is_hot & (F.col("text_sha256") == F.col(sha_)), "left")  # fewer than HOT_SHARE rows
        .withColumn("keep_id", F.when(is_hot, F.col(all_least_)).otherwise(F.col(least_)))
        .withColumn("group_size", F.when(is_hot, F.col(all_size_)).otherwise(F.col(size_)))
        .withColumn("kept", (F.col(first_) == 1) & ident.eqNullSafe(F.col("keep_id")))
        .select(*[F.col(f"`{c}`") for c in rows.columns], *RESULTS)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", *RESULTS)


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n
"""
