"""N-gram Jaccard join in the Jaccard metric space, by pivots, windows and recursion; exact.

Distances between unrelated texts all lie near 1, so document pivots alone would put every document
within every other's window. The join therefore has two levels.

1. Sizes and signatures (the coarse regions). A pair within the limit has sizes within a factor, so
   documents go to size intervals, and those whose size lies within the factor below the next
   interval are replicated to it. The hash space is cut into ranges. Two sets that differ in at most
   D shingles agree on all but D ranges, so of their first D + 1 + slack ranges at least 1 + slack
   agree; the content of a range (as a hash) names a region. Ranges that are empty, or whose content
   more than HEAVY documents share, say little; a document uses the shortest start of its ranges that
   has D + 1 others, for one of those then agrees. A document without such a start, and every small one, is
   also put in the regions of its first floor((1 - limit) * n) + 1 shingles by hash, of which two
   sets within the limit share one; if both sets of a pair lack ranges, they meet there.
2. Pivots (inside the regions). The regions that have the same smallest identifier merge to a cell,
   so documents near the borders of cells are replicated to several. A cell of BLOCK documents or
   fewer is compared directly. In a larger one PIVOTS documents, the least of each hash bucket, become
   pivots. Its documents are dealt in blocks, each with all pivots, which gives every distance to a
   pivot and the links inside the blocks. Each document goes to the Voronoi region of its nearest
   pivot, and by the triangle inequality to that of each other pivot that is at most twice the limit
   farther away: a document within the limit of one of that region's can't be elsewhere. Regions whose
   documents already are one component are done; the others are cells with pivots of their own, and
   so on. Where the regions of a cell hold over DENSE times its documents, pivots don't part it (its
   documents are about equally far from all of them); it, and what is still large after DEPTH levels,
   is compared block by block.

Sets are compared by 64 bits of their shingles' hashes. Distances are computed in the tasks that hold
a block or two; only links that join two components of it leave the task, so a group of copies never
becomes its pairs. Tables between steps go to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.common import drop_path, growing, shared_dir, slices, stored, table, unused, without
from matchloom.llm.components import components
from matchloom.llm.hashing import bitmap, hashed_words, marked, mix

#: Ratio of an interval's ends; sizes that are too small for ranges; documents of a region that says little.
GROWTH, SMALL, HEAVY = 1.5, 40, 16
#: Documents that are compared in one task at once; pivots of a cell, levels of them, copies that they may make.
BLOCK, PIVOTS, DEPTH, DENSE = 128, 8, 4, 3
#: Bits of the maps of used and of heavy regions (8 MB each) and of documents in them (1 MB).
REGION_BITS, DOC_BITS = 26, 23
RESULTS = ("n_shingles", "component_id")


def differing(n: int, high: int, percent: int) -> int:
    """Shingles in which a set of n and one of its interval (up to `high`) can differ and be linked."""
    return (n + min(high, n * 100 // percent)) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=4)
def intervals(percent: int) -> list[tuple[int, int, int, int, int]]:
    """(least size, least size that is replicated here, largest size, ranges, slack) of the size intervals.

    The slack is about what empty ranges need; it changes the work, never the result.
    """
    out, low = [], 1
    while low < 1 << 40:
        high = max(low, int(low * GROWTH))
        least, ranges, slack = -(-low * percent // 100), 0, 0
        if high > SMALL:
            most, slack = differing(high, high, percent) + 1, 1
            for _ in range(30):
                ranges = most + slack
                used = {n: differing(n, high, percent) + 1 + slack for n in (least, low, high)}
                empty = max(e * exp(-n / ranges) for n, e in used.items())
                slack = min(most // 2 + 2, ceil(empty + 2 * sqrt(empty) + 2 + 0.03 * most))
            ranges = most + slack
        out.append((low, least, high, ranges, slack))
        low = high + 1
    return out


def shingle_sets(texts: list[str | None], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of its shingles)."""
    for begin, words, per_row in hashed_words(texts, True):
        odd = [np.uint64(((2 * i + 1) * 0xD6E8FEB86659FD93) % (1 << 64)) for i in range(size)]
        n = max(0, len(words) - size + 1)
        grams = np.zeros(n, dtype=np.uint64)
        for i in range(size):
            grams += words[i : i + n] * odd[i]
        grams = mix(grams)
        ends = np.cumsum(per_row)
        for i, (end, count) in enumerate(zip(ends.tolist(), per_row.tolist())):
            if count >= size:
                yield begin + i, np.unique(grams[end - count : end - size + 1])
            elif count:
                own = np.uint64(count)
                for w in words[end - count : end]:
                    own = mix(np.array([own ^ w], dtype=np.uint64))[0] + np.uint64(count)
                yield begin + i, np.array([own], dtype=np.uint64)
            else:
                yield begin + i, np.array([], dtype=np.uint64)


@lru_cache(maxsize=4096)
def edges(ranges: int) -> np.ndarray:
    return np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)


def regions_of(grams: np.ndarray, percent: int, heavy: np.ndarray | None, used: np.ndarray | None) -> np.ndarray:
    """Hashes of the regions that a set belongs to; without bitmaps, those that are to be counted."""
    n, out = len(grams), []
    if not n:
        return np.array([], dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(grams ^ np.uint64(0x5851F42D4C957F2D)))))
    for k, (low, least, high, ranges, slack) in enumerate(intervals(percent)):
        if least > n:
            break
        if n > high:
            continue
        lacking = not ranges
        if ranges:
            first = min(ranges, differing(n, high, percent) + 1 + slack)
            cuts = np.concatenate(([0], np.searchsorted(grams, edges(ranges)[:first]), [n]))[: first + 1]
            name = mix(sums[cuts[1:]] - sums[cuts[:-1]] + mix(np.arange(first, dtype=np.uint64) + np.uint64((k << 32) + 1)))
            tells = cuts[1:] > cuts[:-1]
            if heavy is not None:
                tells &= ~marked(heavy, name.view(np.int64))
                # The shortest start of the ranges in which no more than the spare ones say little will do.
                enough = np.flatnonzero(np.arange(1, first + 1) - np.cumsum(~tells) > first - 1 - slack)
                tells[enough[0] + 1 if len(enough) else first :] = False
                lacking = not len(enough)
            name = name[tells]
            out.append(name if used is None else name[marked(used, name.view(np.int64))])
        if lacking:
            out.append(mix(grams[: n - -(-n * percent // 100) + 1] + np.uint64(k + 1)))
    return np.concatenate(out)


def _regions(docs: DataFrame, size: int, percent: int, heavy: np.ndarray | None = None, used: np.ndarray | None = None) -> DataFrame:
    """(region, doc) rows of docs (doc, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((heavy, used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows, found, held = [], [], 0

            def block() -> pa.RecordBatch:
                names = np.concatenate(found).view(np.int64)
                at = np.repeat(rows, [len(f) for f in found])
                return pa.RecordBatch.from_arrays([pa.array(names), batch.column(0).take(pa.array(at))], names=["region", "doc"])

            for row, grams in shingle_sets(batch.column(1).to_pylist(), size):
                names = regions_of(grams, percent, *shared.value)
                if len(names):
                    rows.append(row)
                    found.append(names)
                    held += len(names)
                if held > 200_000:
                    yield block()
                    rows, found, held = [], [], 0
            if rows:
                yield block()

    return docs.mapInArrow(run, T.StructType([T.StructField("region", T.LongType()), T.StructField("doc", docs.schema["doc"].dataType)]))


def _sets(docs: DataFrame, size: int, used: np.ndarray) -> DataFrame:
    """(doc, grams) of the documents whose bit is set, from (doc, text, h); grams are the hashes, sorted, as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches, 1):
            own = whole.filter(pa.array(marked(shared.value, whole.column(2).to_numpy())))
            sets = [s.tobytes() for _, s in shingle_sets(own.column(1).to_pylist(), size)]
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(sets, pa.binary())], names=["doc", "grams"])

    return docs.mapInArrow(run, T.StructType([T.StructField("doc", docs.schema["doc"].dataType), T.StructField("grams", T.BinaryType())]))


def _sizes(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """Input rows and n_shingles."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            n = [len(s) for _, s in shingle_sets(batch.column(at).to_pylist(), size)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n_shingles"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_shingles", T.LongType())]))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of a few sets of sorted distinct hashes."""
    n = len(sets)
    out = np.diag([float(len(x)) for x in sets])
    if n <= 4:
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    slot = np.cumsum(np.concatenate(([0], flat[1:] != flat[:-1]))) if len(flat) else flat
    often = np.bincount(slot) > 1
    keep = often[slot]
    slot, row = (np.cumsum(often) - 1)[slot[keep]], row[keep]
    out = np.zeros((n, n), dtype=np.float64)
    for begin in range(0, int(slot[-1]) + 1 if len(slot) else 0, 8192):
        a, b = np.searchsorted(slot, (begin, begin + 8192))
        grid = np.zeros((n, 8192), dtype=np.float32)
        grid[row[a:b], slot[a:b] - begin] = 1
        out += grid @ grid.T
    np.fill_diagonal(out, [len(x) for x in sets])
    return out


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """Links and Voronoi members (region, a, b, linked) of blocks (region, part, doc, pivot, grams).

    Links are those of a spanning forest of the block. Where linked is false, b belongs to the region
    of pivot a: its nearest, or one that is at most twice the limit farther away.
    """
    kind = rows.schema["doc"].dataType
    schema = T.StructType([T.StructField("region", T.LongType()), T.StructField("a", kind), T.StructField("b", kind), T.StructField("linked", T.BooleanType())])
    window = 2 * (100 - percent) / 100 + 1e-9

    def block(rows: pa.Table) -> pa.Table:
        sets = [np.frombuffer(g, dtype=np.uint64) for g in rows["grams"].to_pylist()]
        both = overlaps(sets)
        n = np.array([len(x) for x in sets], dtype=np.float64)
        union = np.maximum(n[:, None] + n[None, :] - both, 1)
        out: list[tuple[int, int, bool]] = []
        head = list(range(len(sets)))

        def top(i: int) -> int:
            while head[i] != i:
                head[i] = head[head[i]]
                i = head[i]
            return i

        for i, j in zip(*np.nonzero(np.triu(100 * both >= percent * union, 1))):
            x, y = top(int(i)), top(int(j))
            if x != y:
                head[max(x, y)] = min(x, y)
                out.append((int(i), int(j), True))
        pivots = np.flatnonzero(rows["pivot"].to_numpy())
        if len(pivots):
            apart = (1 - both / union)[:, pivots]
            near = apart <= apart.min(axis=1, keepdims=True) + window
            out += [(int(pivots[p]), int(i), False) for i, p in zip(*np.nonzero(near))]
        docs, (a, b, linked) = rows["doc"].combine_chunks(), (zip(*out) if out else ((), (), ()))
        region = pa.array(np.full(len(out), rows["region"][0].as_py(), dtype=np.int64))
        return pa.table({"region": region, "a": docs.take(pa.array(a, pa.int64())), "b": docs.take(pa.array(b, pa.int64())), "linked": pa.array(linked, pa.bool_())})

    return rows.groupBy("region", "part").applyInArrow(block, schema)


def _dealt(sized: DataFrame) -> DataFrame:
    """Cells (region, doc, size) over BLOCK with the number of their blocks and each document's own."""
    parts = F.ceil(2 * F.col("size") / BLOCK).cast("int")
    return sized.where(F.col("size") > BLOCK).withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("doc", "region"), F.col("parts")).cast("int"))


def _by_blocks(large: DataFrame) -> DataFrame:
    """All pairs of blocks of dealt cells (region, part, doc, pivot)."""
    pairs = large.select("region", "doc", "own", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    part = F.least("own", "other") * F.col("parts").cast("long") + F.greatest("own", "other")
    return pairs.select("region", part.alias("part"), "doc", F.lit(False).alias("pivot"))


def jaccard_links(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 5, percent: int = 80, folder: str | None = None) -> DataFrame:
    """Links (a, b) between documents whose shingle sets have a Jaccard similarity of percent/100 or more.

    The links span: each class of linked documents is connected by them, though pairs that two
    links to one pivot imply are not listed. Documents with null identifier or without words have
    no links; an empty table has none. Rows with one identifier are one document, linked by its
    nearest row. `folder` is where tables between the steps go.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "jaccard-join")
    texts = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))

    counted = stored(_regions(texts, size, percent).groupBy("region").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1"), f"{folder}/counted")
    used = bitmap(counted, F.col("region"), REGION_BITS)
    heavy = bitmap(counted.where(F.col("docs") > HEAVY), F.col("region"), REGION_BITS)
    regions = stored(_regions(texts, size, percent, heavy, used), f"{folder}/regions")

    # Stored tables on both sides of a join let adaptive execution split a region that most documents share.
    first = stored(regions.groupBy("region").agg(F.min("doc").alias("head"), F.max("doc").alias("most")).where("head < most").drop("most"), f"{folder}/first")
    member = regions.join(growing(first), "region").select(F.xxhash64("head").alias("region"), "doc", "head")
    cells = stored(member.select("region", "doc").unionByName(member.select("region", F.col("head").alias("doc"))).distinct(), f"{folder}/cells-0")
    found: list[str] = []
    dense: list[str] = []
    for level in range(DEPTH + 1):
        sized = cells.join(growing(stored(cells.groupBy("region").agg(F.count(F.lit(1)).alias("size")), f"{folder}/sizes-{level}")), "region")
        large = _dealt(sized)
        rows = sized.where(F.col("size") <= BLOCK).select("region", F.lit(0).cast("long").alias("part"), "doc", F.lit(False).alias("pivot"))
        if level < DEPTH:
            chosen = large.groupBy("region", "parts", F.pmod(F.xxhash64("doc"), F.lit(PIVOTS)).alias("bucket")).agg(F.min("doc").alias("doc"))
            heads = chosen.select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), "doc", F.lit(True).alias("pivot"))
            each = large.join(chosen.select("region", "doc"), ["region", "doc"], "left_anti").select("region", F.col("own").cast("long").alias("part"), "doc", F.lit(False).alias("pivot"))
            rows = rows.unionByName(each).unionByName(heads)
        else:
            rows = rows.unionByName(_by_blocks(large))
            if dense:
                again = spark.read.schema("region long, doc " + cells.schema["doc"].dataType.simpleString()).parquet(*dense)
                rows = rows.unionByName(_by_blocks(_dealt(again.join(again.groupBy("region").agg(F.count(F.lit(1)).alias("size")), "region"))))
        sets = _sets(texts.withColumn("h", F.xxhash64("doc")), size, bitmap(rows, F.xxhash64("doc"), DOC_BITS))
        path = f"{folder}/compared-{level}"
        compared = stored(_compare(rows.join(growing(sets), "doc"), percent), path)
        found.append(path)
        if level == DEPTH:
            break
        members = compared.where("not linked").select("region", F.col("a").alias("pivot"), F.col("b").alias("doc")).distinct()
        if members.limit(1).count() == 0:
            if not dense:
                break
            cells = cells.where("false")
            continue
        # Cells that pivots don't part: their regions would hold DENSE times their documents.
        spread = members.groupBy("region").agg(F.count(F.lit(1)).alias("copies")).join(large.groupBy("region").agg(F.count(F.lit(1)).alias("size")), "region")
        stuck = stored(spread.where(F.col("copies") > DENSE * F.col("size")).select("region"), f"{folder}/stuck-{level}")
        links = spark.read.schema(compared.schema).parquet(*found).where("linked")
        classes = components(links.select("a", "b")).withColumnRenamed("node", "doc")
        windows = members.select(F.col("region").alias("cell"), F.xxhash64("region", "pivot").alias("region"), "doc").join(growing(classes), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        open_ = windows.groupBy("cell", "region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("cell", "region")
        opened = stored(windows.join(open_, ["cell", "region"]).select("cell", "region", "doc"), f"{folder}/open-{level}")
        if stuck.limit(1).count():
            dense.append(f"{folder}/dense-{level}")
            stored(opened.join(stuck.withColumnRenamed("region", "cell"), "cell").select(F.col("cell").alias("region"), "doc").distinct(), dense[-1])
            opened = opened.join(stuck.withColumnRenamed("region", "cell"), "cell", "left_anti")
        cells = stored(opened.select("region", "doc"), f"{folder}/cells-{level + 1}")
    return spark.read.schema(compared.schema).parquet(*found).where("linked and a <> b").select("a", "b")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """Add n_shingles and component_id (least identifier that links reach, itself included) to every row.

    Words are runs of [^\\x20\\x09-\\x0D] with A-Z lower-cased; a set is the distinct shingles of
    `size` words, or the whole sequence if there are fewer. Null, empty and blank texts have empty
    sets and link with nothing. Rows with a null identifier get a null component. Input columns
    named like a result give way to it; an empty table gives an empty table; texts of any length are
    read whole; rows that repeat each get their class.
    """
    spark = docs.sparkSession
    rows = without(docs, *RESULTS)
    node, component = unused(rows, "node", "component")
    folder = shared_dir(spark, "jaccard-join")
    classes = components(jaccard_links(rows, text_col, id_col, size, percent, folder)).select(F.col("node").alias(node), F.col("component").alias(component))
    drop_path(spark, folder)  # the components have been written
    ident = F.col(f"`{id_col}`")
    return (
        _sizes(rows, text_col, size)
        .join(growing(classes), ident == F.col(node), "left")
        .withColumn("component_id", F.coalesce(component, ident))
        .select(*[F.col(f"`{c}`") for c in rows.columns], *RESULTS)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, size=3, percent=90).select("doc_id", *RESULTS)


# Pairs that share a shingle, and the least identifier that their links reach.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""
