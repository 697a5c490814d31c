"""Repeated passages by fixed-block anchors.

Method. A passage that matters has SPAN words; blocks have BLOCK = (SPAN + 1) / 2, so each window of
SPAN words holds exactly one whole block of its own document's grid of non-overlapping blocks.

1. Index: the hashes of all grid blocks.
2. Probe: every rolling window of BLOCK words of every document against the index. Anchors are
   hashes with two places at least.
3. Extend: each of a block's places extends to every window of SPAN words around it. Windows with
   equal content at two places or more are parts of an exact repeat; overlapping ones merge to the
   maximal repeats, whose words go.

A bitmap of fixed size with the index's hashes travels to the probes, and one with the anchors' to
the extension, so that most rows never reach a shuffle; a wrongly set bit costs a row, not a result.
Counts are combined before their shuffles and extended windows meet their counts in a join that
Spark splits if skewed, so a passage that stands in a third of all documents is spread. Only
documents with a repeat are shuffled as texts. Windows count as equal if both of two independent 64-bit
hashes of their words are; among the 10**13 windows of 100 TB the chance of one false match is 10**-12.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.common import shared_dir, slices, stored, table, unused, without
from matchloom.llm.hashing import SECOND, bitmap, hashed_words, marked, rolled

SPAN = 35
#: Bits of the maps of blocks, anchors, repeated windows and documents.
BLOCK_BITS, ANCHOR_BITS, WINDOW_BITS, DOC_BITS = 27, 26, 27, 23
RESULTS = ("n_words", "n_removed", "kept_text")


def _places(texts: list[str | None], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row, place in its document, words left in it) of each word of a chunk, and its hashes."""
    for begin, words, per_row in hashed_words(texts, False):
        ends = np.cumsum(per_row)
        row = np.repeat(np.arange(len(per_row)), per_row)
        at = np.arange(len(words)) - np.repeat(ends - per_row, per_row)
        yield begin, row, at, np.repeat(per_row, per_row) - at, words


def _emit(docs: DataFrame, make: Callable, fields: list[T.StructField], *columns: str) -> DataFrame:
    """mapInArrow over (key, text): `make` gives columns of numpy arrays for each chunk; the first is a row number if "key" is emitted."""
    kinds = {"long": pa.int64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            keys = batch.column(0).to_numpy()
            for arrays in make(batch.column(1).to_pylist(), keys):
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(a, kinds[f.dataType.simpleString().replace("bigint", "long")]) for a, f in zip(arrays, fields)], names=list(columns))

    return docs.select("key", "text").mapInArrow(run, T.StructType(fields))


def repeated_windows(docs: DataFrame, folder: str, span: int = SPAN) -> DataFrame:
    """(key, at): windows of `span` words of docs (key, text) whose content stands at two places or more."""
    block = (span + 1) // 2
    sc = docs.sparkSession.sparkContext
    as_long = lambda h: h.view(np.int64)

    def blocks(texts, keys):
        for _, _, at, left, words in _places(texts, block):
            grams = rolled(words, block)
            n = len(grams)
            yield (as_long(grams[(at[:n] % block == 0) & (left[:n] >= block)]),)

    hash_field = [T.StructField("hash", T.LongType())]
    index = sc.broadcast(bitmap(_emit(docs, blocks, hash_field, "hash"), F.col("hash"), BLOCK_BITS))

    def probes(texts, keys):
        for _, _, at, left, words in _places(texts, block):
            grams = as_long(rolled(words, block))
            n = len(grams)
            grams = grams[left[:n] >= block]
            yield (grams[marked(index.value, grams)],)

    probed = _emit(docs, probes, hash_field, "hash").groupBy("hash").agg(F.count(F.lit(1)).alias("places"))
    anchors = stored(probed.where("places > 1").select("hash"), f"{folder}/anchors")
    anchored = sc.broadcast(bitmap(anchors, F.col("hash"), ANCHOR_BITS))

    def windows(texts, keys, chosen=None):
        again = hashed_words(texts, False, SECOND)
        for (begin, row, at, left, words), (_, others, _) in zip(_places(texts, block), again):
            grams, wide = as_long(rolled(words, block)), as_long(rolled(words, span))
            n = len(wide)
            whole = np.flatnonzero(left[:n] >= span)
            own = whole - at[whole] + (at[whole] + block - 1) // block * block
            hit = whole[marked(anchored.value, grams[own])]
            if chosen is not None:
                hit = hit[marked(chosen, wide[hit])]
            yield wide[hit], as_long(rolled(others, span, SECOND))[hit], keys[begin + row[hit]], at[hit].astype(np.int32)

    both = [*hash_field, T.StructField("second", T.LongType())]
    counted = _emit(docs, lambda texts, keys: (found[:2] for found in windows(texts, keys)), both, "hash", "second").groupBy("hash", "second").agg(F.count(F.lit(1)).alias("places"))
    several = stored(counted.where("places > 1").select("hash", "second"), f"{folder}/several")
    repeated = sc.broadcast(bitmap(several, F.col("hash"), WINDOW_BITS))
    fields = [*both, T.StructField("key", T.LongType()), T.StructField("at", T.IntegerType())]
    extended = _emit(docs, lambda texts, keys: windows(texts, keys, repeated.value), fields, "hash", "second", "key", "at")
    return extended.join(several.hint("merge"), ["hash", "second"]).select("key", "at")


def kept_words(text: str | None, starts: list[int] | None, span: int) -> tuple[int, int, str]:
    """(words, removed words, the others joined by one space); starts: of the repeated windows."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not starts:
        return len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass")
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.asarray(starts) + span, -1)
    stay = np.cumsum(change[:-1]) == 0
    return len(words), int((~stay).sum()), b" ".join([w for w, s in zip(words, stay.tolist()) if s]).decode("utf-8", "surrogatepass")


def substring_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", span: int = SPAN) -> DataFrame:
    """Remove every word that lies in a window of `span` words which stands anywhere else too.

    All places of a repeat go, the first too, as judged on the input. Returns every input row with
    its columns (those named like a result give way to it) and n_words, n_removed long, kept_text
    (the other words, joined by one space).

    Defined cases: null, empty and short texts keep their words; an empty table gives an empty table;
    rows with a null identifier count like any other; texts of any length are read whole. Repeated rows are places of their
    own, so rows of `span` words or more with equal texts lose all words, whatever their identifiers.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "substring-dedup")
    rows = without(docs, *RESULTS)
    own_key, own_starts, own_hit = unused(rows, "key", "starts", "hit")
    keyed = rows.withColumn(own_key, F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    found = repeated_windows(keyed.select(F.col(own_key).alias("key"), F.col(f"`{text_col}`").alias("text")), folder, span)
    hits = stored(found.groupBy("key").agg(F.collect_set("at").alias(own_starts)), f"{folder}/hits")  # a document's own windows
    touched = spark.sparkContext.broadcast(bitmap(hits, F.col("key"), DOC_BITS))
    at, last = keyed.columns.index(text_col), len(keyed.columns) - 1

    kept = T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def chosen(batch: pa.RecordBatch, hit: bool) -> pa.RecordBatch:
        return batch.filter(pa.array(marked(touched.value, batch.column(last).to_numpy()) == hit))

    def finished(batch: pa.RecordBatch, starts: list) -> pa.RecordBatch:
        done = list(zip(*[kept_words(t, s, span) for t, s in zip(batch.column(at).to_pylist(), starts)])) or [(), (), ()]
        results = [pa.array(v, k) for v, k in zip(done, (pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays([*batch.columns[:last], *results], names=[*batch.schema.names[:last], *RESULTS])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            own = chosen(batch, False)
            yield finished(own, [None] * own.num_rows)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield chosen(batch, True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield finished(batch, batch.column(last + 1).to_pylist())

    joined = keyed.mapInArrow(suspects, keyed.schema).join(hits.withColumnRenamed("key", own_hit), F.col(own_key) == F.col(own_hit), "left").drop(own_hit)
    return keyed.mapInArrow(whole, kept).unionByName(joined.mapInArrow(cut, kept))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS p
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), rep AS (SELECT p FROM win GROUP BY p HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM win SEMI JOIN rep USING (p)),
lost AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ks IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ks, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""
