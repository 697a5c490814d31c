"""Language identification by nearest centroid.

Method. Letter n-grams of one to three characters (each run of other characters is one space) are
hashed into WIDTH numbers; log counts times inverse document frequencies, scaled to length one, form
a document's vector. Each language has up to CENTROIDS centroids from spherical k-means; a document
gets the language of the centroid with the largest cosine and is rejected if that is under a floor.

A text's cosine grows with the number of slots that it fills, for hash collisions alone too. So the
floor is fitted by language and by that number (octaves): SLACK times the QUANTILE of the cosines that
the sample's own texts, and their beginnings of PIECES characters, have with their language. An octave
with under LEAST of them takes the floor of the next smaller one that has enough.

Document frequencies are counted over all labelled training rows. The centroids are fitted on a
bounded sample of them: PER_LANG rows of each language, those with the smallest hash of doc_id. Rows of
each language are counted first, so that hashes over a threshold (which SPARE times as many rows are
expected to pass) never reach a shuffle, however large the input is. Prediction is one mapInArrow over whole texts with the model (WIDTH numbers per centroid) broadcast.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.common import drop_path, shared_dir, slices, stored, table, without

WIDTH, CENTROIDS, PER_LANG, SPARE, ROUNDS = 4096, 4, 300, 4, 12
#: Cosine under which a document is like no learned language, whatever its size; where nothing was fitted, the floor.
FLOOR = 0.04
QUANTILE, SLACK, LEAST = 0.01, 0.5, 20
PIECES = tuple(8 << i for i in range(10))
#: Characters that are turned into vectors at once, in one task (a longer text is taken alone), and rows.
CHUNK, ROWS = 1 << 18, 128
RESULTS = ("lang_pred", "score", "rejected")


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(sys.maxunicode + 1)], dtype=np.uint32)


def counts_of(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, counts of hashed n-grams, whether there is a letter) by chunks of rows."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end] or "") < CHUNK) and end - begin < ROWS:
            size += len(texts[end] or "")
            end += 1
        parts = [np.frombuffer(f" {t or ''} ".lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts[begin:end]]
        row = np.repeat(np.arange(end - begin), [len(p) for p in parts])
        chars = letters()[np.concatenate(parts)]
        space = chars == 32
        keep = np.concatenate(([True], ~(space[1:] & space[:-1] & (row[1:] == row[:-1]))))
        chars, row, space = chars[keep].astype(np.uint64), row[keep], space[keep]
        total = np.zeros((end - begin) * WIDTH, dtype=np.int64)
        gram = chars * np.uint64(0x9E3779B97F4A7C15)
        for n in (1, 2, 3):
            if n > 1:
                gram = gram[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + chars[n - 1 :] * np.uint64(0x9E3779B97F4A7C15)
            m = len(gram)
            ok = (row[:m] == row[n - 1 :]) & ~(space[:m] if n == 1 else space[:m] & space[n - 1 :])
            mixed = gram[ok] ^ (gram[ok] >> np.uint64(29))
            slot = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(52)).astype(np.int64)
            total += np.bincount(row[:m][ok] * WIDTH + slot, minlength=len(total))
        grid = total.reshape(end - begin, WIDTH)
        yield begin, grid, np.bincount(row[~space], minlength=end - begin) > 0
        begin = end


def vectors(grid: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(grid).astype(np.float32) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def likeness(grid: np.ndarray, idf: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cosine of each row with each centroid, from the slots that the row has."""
    row, slot = np.nonzero(grid)
    weight = np.log1p(grid[row, slot]).astype(np.float32) * idf[slot]
    begin = np.searchsorted(row, np.arange(len(grid)))
    full = np.flatnonzero(np.diff(np.append(begin, len(row))) > 0)
    out = np.zeros((len(grid), len(centres)), dtype=np.float32)
    if len(full):
        out[full] = np.add.reduceat(weight[:, None] * np.ascontiguousarray(centres.T)[slot], begin[full], axis=0)
        out[full] /= np.sqrt(np.add.reduceat(weight.astype(np.float64) ** 2, begin[full]))[:, None]
    return out


def spherical_kmeans(rows: np.ndarray, k: int) -> np.ndarray:
    """Centroids of length one; each next seed is the row least like those chosen."""
    chosen = [0]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argmin((rows @ rows[chosen].T).max(axis=1))))
    centres = rows[chosen]
    for _ in range(ROUNDS):
        home = np.argmax(rows @ centres.T, axis=1)
        sums = np.stack([rows[home == j].sum(axis=0) if (home == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def octave(grid: np.ndarray) -> np.ndarray:
    """Size of each row: the binary logarithm of the number of slots it has, rounded down."""
    return np.log2(np.maximum((grid > 0).sum(axis=1), 1)).astype(np.int64)


def floors(like: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Floor by octave, from the cosines of a language's own texts."""
    out, last = np.zeros(WIDTH.bit_length()), FLOOR
    for i in range(len(out)):
        own = like[sizes == i]
        if len(own) >= LEAST:
            last = max(FLOOR, SLACK * float(np.quantile(own, QUANTILE)))
        out[i] = last
    return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG, centroids: int = CENTROIDS) -> dict:
    """Learn from rows with a language: {"langs": name of each centroid, "centres", "idf", "floors": of each centroid by octave}.

    Rows with null language or text, or without a letter, teach nothing; repeated rows teach again. No
    rows give a model without languages, which rejects everything.
    """
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.xxhash64(F.col(f"`{id_col}`")).alias("h")).where("text is not null and lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros(WIDTH, dtype=np.int64), 0
        for batch in slices(batches, 0):
            for _, grid, has in counts_of(batch.column(0).to_pylist()):
                seen += (grid > 0).sum(axis=0)
                docs += int(has.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs, *seen.tolist()], pa.int64()), pa.array(range(-1, WIDTH), pa.int32())], names=["n", "slot"])

    by_slot = {r["slot"]: r["n"] for r in rows.select("text").mapInArrow(frequencies, "n long, slot int").groupBy("slot").agg(F.sum("n").alias("n")).collect()}  # WIDTH + 1 rows
    total = by_slot.get(-1, 0)
    idf = np.array([np.log((1 + total) / (1 + by_slot.get(i, 0))) + 1 for i in range(WIDTH)], dtype=np.float32)
    # Hashes of a language's sample lie under its threshold; a row for each language, as in the model itself.
    counted = labelled.groupBy(F.col(f"`{lang_col}`").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).where("lang is not null").collect()
    limits = [x for r in counted for x in (F.lit(r["lang"]), F.lit(min(1.0, SPARE * per_lang / r["n"]) * 2.0**64 - 2.0**63))]
    chosen = rows.where(F.col("h").cast("double") <= F.create_map(*limits)[F.col("lang")]) if limits else rows.where("false")
    order = Window.partitionBy("lang").orderBy("h", "text")
    spark, folder = labelled.sparkSession, shared_dir(labelled.sparkSession, "language-sample")
    sample = stored(chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang).select("text", "lang", "h"), folder)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            for begin, grid, has in counts_of(batch.column(0).to_pylist()):
                part = batch.slice(begin, len(grid)).filter(pa.array(has))
                counts = [zlib.compress(g.tobytes(), 1) for g in np.minimum(grid[has], 65535).astype(np.uint16)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(counts, pa.binary())], names=["lang", "h", "counts"])

    by_lang: dict[str, list] = {}
    for r in sample.mapInArrow(sketched, "lang string, h long, counts binary").collect():  # per_lang rows of each language, packed
        by_lang.setdefault(r["lang"], []).append((r["h"], r["counts"]))
    langs = sorted(by_lang)
    centres = {lang: spherical_kmeans(vectors(np.stack([np.frombuffer(zlib.decompress(c), dtype=np.uint16) for _, c in sorted(by_lang.pop(lang))]), idf), centroids) for lang in langs}
    shared = spark.sparkContext.broadcast((idf, centres))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, nearest = shared.value
        for batch in slices(batches, 0):
            for n in (None, *PIECES):
                texts, tongues = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                own = [(t[:n], k) for t, k in zip(texts, tongues) if k in nearest and (n is None or len(t) > n)]
                for begin, grid, has in counts_of([t for t, _ in own]):
                    kinds = np.array([k for _, k in own[begin : begin + len(grid)]], dtype=object)
                    for kind in set(kinds.tolist()):
                        some = grid[has & (kinds == kind)]
                        if len(some):
                            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(some)), pa.array(octave(some), pa.int32()), pa.array(likeness(some, known, nearest[kind]).max(axis=1), pa.float32())], names=["lang", "size", "like"])

    cosines: dict[str, list] = {lang: [] for lang in langs}
    for r in sample.mapInArrow(measured, "lang string, size int, like float").collect():  # a number for each sampled text and piece
        cosines[r["lang"]].append((r["size"], r["like"]))
    drop_path(spark, folder)
    least = [floors(np.array([x for _, x in cosines[lang]]), np.array([n for n, _ in cosines[lang]])) for lang in langs]
    return {
        "langs": [lang for lang in langs for _ in centres[lang]],
        "centres": np.concatenate([centres[lang] for lang in langs]) if langs else np.zeros((0, WIDTH), dtype=np.float32),
        "idf": idf,
        "floors": np.array([low for lang, low in zip(langs, least) for _ in centres[lang]]),
    }


def predict(docs: DataFrame, model: dict, text_col: str = "text", floor: float | None = None) -> DataFrame:
    """Add lang_pred, score (cosine, 0 to 1) and rejected to every row.

    Texts that are null or have no letter get und, score 0 and are rejected; so does every text if
    the model has no language. Other texts get the nearest centroid's language and are rejected if
    the score is under that language's fitted floor for the text's size, or under `floor` if that is
    given. Ties go to the language that sorts first. An empty table gives an empty table; texts of any
    length are read whole; input columns named like a result give way.
    """
    rows = without(docs, *RESULTS)
    at = rows.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, at):
            langs, scores, gone = [], [], []
            for _, grid, has in counts_of(batch.column(at).to_pylist()):
                if not known["langs"]:
                    langs += ["und"] * len(grid)
                    scores += [0.0] * len(grid)
                    gone += [True] * len(grid)
                    continue
                like = likeness(grid, known["idf"], known["centres"])
                best = np.argmax(like, axis=1)
                top = np.clip(like[np.arange(len(like)), best].astype(np.float64), 0, 1)
                langs += [known["langs"][b] if ok else "und" for b, ok in zip(best.tolist(), has.tolist())]
                scores += np.where(has, top, 0.0).tolist()
                gone += (~has | (top < (known["floors"][best, octave(grid)] if floor is None else floor))).tolist()
            done = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(gone, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *done], names=[*batch.schema.names, *RESULTS])

    return rows.mapInArrow(run, schema)


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~is_held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "rejected")
