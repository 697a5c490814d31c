"""How far the word use of the sources of a language lies apart, by exact joint tables of count levels.

A group is a (lang, source). Its price for a term depends on nothing but its count of it, so what two
groups differ by over all terms follows from their joint table: how many terms have count level a
in the one and b in the other.

Method. Terms are taken in blocks. In a block each (group, level) is an indicator column, level 0
included; the columns' matrix times its transpose (numpy, float32, exact because a block has fewer
than 2**24 terms) holds every joint table of the block's groups, which are priced in whole numbers
and added up. Terms come in ascending order of their total, so most blocks have few levels; a block
with more than COLUMNS columns is halved. Groups beyond TILE are multiplied tile by tile, each pair of
tiles for itself. Terms that no group of a pair of tiles has are priced at once: all are (0, 0).

Spark counts terms (tasks count batches of texts and send sums), keeps those in enough documents,
deals (pair of tiles, bucket of terms) over tasks and adds up what they priced. No task holds more
than a block and one tile's groups, and the group that holds most documents costs no more than another.

Defined cases: null text, lang and source are ''; repeated rows count each; a group without terms
has the price of count 0 everywhere, and a language without kept terms the value 0 for all pairs; equal
values are ordered by the item's UTF-8 bytes; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.common import shared_dir, slices, stored, table

#: Distinct (group, term) of a task's count before it is sent on.
HELD = 1 << 18
#: Groups of a tile; indicator columns and terms of a block; cells of a bucket of terms.
TILE, COLUMNS, TERMS, CELLS = 48, 1024, 4096, 1 << 17
#: Prices are whole numbers of this share.
UNIT = 1_000_000_000
#: Bytes of terms: letters and whatever isn't ASCII; A-Z as a-z, the rest is space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial sums: lang, source, term, n (occurrences), docs (documents that have it)."""
    names = ["lang", "source", "term", "n", "docs"]

    def sent(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 1 << 14):
                part = terms[at : at + (1 << 14)]
                same = lambda value: pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(part), dtype=np.int8)), pa.array([value])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part]), pa.array([docs[t] for t in part])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in slices(batches, 2):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                words = Counter(text.encode().translate(FOLD).split())
                size -= len(n)
                n.update(words)
                docs.update(words.keys())
                size += len(n)
            if size > HELD:
                yield from sent(held)
                held, size = {}, 0
        yield from sent(held)

    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, source, term, n of terms that at least `least` documents of the language have; total over the language, and one row of each term with lead."""
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")  # a row for each source at most
    return counts.withColumns({"total": F.sum("n").over(of_term), "docs": F.sum("docs").over(of_term), "lead": F.col("source") == F.min("source").over(of_term)}).where(F.col("docs") >= least).drop("docs")


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every group: lang, source, n_group and n_lang (occurrences of kept terms), terms (V), g (its number in the language), groups."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.sum(F.col("lead").cast("long")).alias("leads"))
    of_lang = Window.partitionBy("lang")  # a row for each source
    return (
        groups.join(sums, ["lang", "source"], "left")
        .fillna(0)
        .withColumns({"n_lang": F.sum("n_group").over(of_lang), "terms": F.sum("leads").over(of_lang), "g": F.row_number().over(of_lang.orderBy("source")) - 1, "groups": F.count(F.lit(1)).over(of_lang)})
        .drop("leads")
    )


def price(count: int, total: int, terms: int) -> int:
    return 1 + UNIT * (count + 2) // (total + 2 * terms)


def price_block(place: np.ndarray, group: np.ndarray, count: np.ndarray, price_of, n_left: int, n_groups: int) -> np.ndarray:
    """Values of all pairs of groups over the terms of a block.

    place, group and count are its cells with a count over 0: number of the term, of the group, level.
    Groups below n_left are the rows of the result, those from n_left on its columns; with n_left = 0
    all groups are both.
    """
    terms = int(place[-1]) + 1
    levels, level = np.unique(count, return_inverse=True)
    wide = len(levels) + 1
    codes = group * wide + level + 1
    zeros = np.arange(n_groups) * wide
    columns = np.union1d(codes, zeros)
    if len(columns) > COLUMNS and terms > 1:
        half = np.searchsorted(place, terms // 2)
        return price_block(place[:half], group[:half], count[:half], price_of, n_left, n_groups) + price_block(place[half:] - terms // 2, group[half:], count[half:], price_of, n_left, n_groups)
    hot = np.zeros((terms, len(columns)), dtype=np.float32)
    zero_at = np.searchsorted(columns, zeros)
    hot[:, zero_at] = 1
    hot[place, zero_at[group]] = 0
    hot[place, np.searchsorted(columns, codes)] = 1
    owner = columns // wide
    prices = np.array([price_of(int(g), int(levels[c - 1]) if c else 0) for g, c in zip(owner, columns % wide)], dtype=np.int64)
    split = zero_at[n_left] if n_left else 0
    left, right = (hot[:, :split], hot[:, split:]) if n_left else (hot, hot)
    joint = (left.T @ right).astype(np.int64)
    p, q = (prices[:split, None], prices[None, split:]) if n_left else (prices[:, None], prices[None, :])
    priced = joint * ((p - q) ** 2 // (p + q))
    rows, cols = (zero_at[:n_left], zero_at[n_left:] - split) if n_left else (zero_at, zero_at)
    return np.add.reduceat(np.add.reduceat(priced, rows, axis=0), cols, axis=1)


def pair_values(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, item (another source), value: f summed over all kept terms."""
    spark = kept.sparkSession
    buckets = max(1, math.ceil(kept.count() / CELLS))
    tiles = F.ceil(F.col("groups") / TILE).cast("int")
    tile = F.floor(F.col("g") / TILE).cast("int")
    both = F.explode(F.sequence(F.lit(0), tiles - 1))
    ends = [F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b")]
    heads = sizes.withColumns({"tile": tile, "other": both, "bucket": F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))}).select("lang", *ends, "bucket", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("total"), F.lit("").alias("term"), "source", "g", F.lit(0).cast("long").alias("n"), "n_group", "terms")
    cells = kept.join(sizes, ["lang", "source"]).withColumns({"tile": tile, "other": both, "bucket": F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")}).select("lang", *ends, "bucket", F.lit(1).alias("kind"), "total", "term", F.lit("").alias("source"), "g", "n", F.lit(0).cast("long").alias("n_group"), F.lit(0).cast("long").alias("terms"))
    rows = heads.unionByName(cells).repartition("lang", "a", "b", "bucket").sortWithinPartitions("lang", "a", "b", "bucket", "kind", "total", "term", "g")
    names = ["lang", "source", "item", "value", "seen", "zero", "terms"]

    class Pair:
        """One pair of tiles and bucket: its groups, the cells that wait for a block, the values so far."""

        def __init__(self, key):
            self.key, self.groups, self.numbers, self.waiting, self.cells, self.terms, self.last = key, [], {}, [], [], 0, None
            self.values, self.seen = None, 0

        def head(self, source, g, n_group, terms) -> None:
            self.numbers[g] = len(self.groups)
            self.groups.append((source, n_group, terms))

        def price_of(self, g: int, count: int) -> int:
            _, total, terms = self.groups[g]
            return price(count, total, terms) if terms else 0

        def cell(self, total, term, g, n) -> None:
            if (total, term) != self.last:
                if self.terms == TERMS:
                    self.block()
                self.last = (total, term)
                self.terms += 1
                self.seen += 1
            self.cells.append((self.terms - 1, self.numbers[g], n))

        def n_left(self) -> int:
            return 0 if self.key[1] == self.key[2] else sum(g < (self.key[1] + 1) * TILE for g in self.numbers)

        def block(self) -> None:
            if self.cells:
                place, group, count = (np.array(c, dtype=np.int64) for c in zip(*self.cells))
                found = price_block(place, group, count, self.price_of, self.n_left(), len(self.groups))
                self.values = found if self.values is None else self.values + found
            self.cells, self.terms = [], 0

        def done(self) -> pa.RecordBatch:
            self.block()
            n = self.n_left()
            left, right = (range(n), range(n, len(self.groups))) if n else (range(len(self.groups)),) * 2
            out = []
            for i in left:
                for k in right:
                    if i != k:
                        (one, _, terms), (two, _, _) = self.groups[i], self.groups[k]
                        p, q = self.price_of(i, 0), self.price_of(k, 0)
                        rest = (int(self.values[i, k - n]) if self.values is not None else 0, self.seen, (p - q) ** 2 // (p + q) if terms else 0, terms)
                        out.append((self.key[0], one, two, *rest))
                        if n:
                            out.append((self.key[0], two, one, *rest))
            kinds = [pa.string()] * 3 + [pa.int64()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = None
        for batch in batches:
            for lang, a, b, bucket, kind, total, term, source, g, n, n_group, terms in zip(*(c.to_pylist() for c in batch.columns)):
                if pair is None or pair.key != (lang, a, b, bucket):
                    if pair is not None:
                        yield pair.done()
                    pair = Pair((lang, a, b, bucket))
                if kind:
                    pair.cell(total, term, g, n)
                else:
                    pair.head(source, g, n_group, terms)
        if pair is not None:
            yield pair.done()

    parts = rows.mapInArrow(run, "lang string, source string, item string, value long, seen long, zero long, terms long")
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("zero").alias("zero"), F.max("terms").alias("terms"))
    return sums.select("lang", "source", "item", (F.col("value") + (F.col("terms") - F.col("seen")) * F.col("zero")).alias("value"))


def divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: every other source of the language. Part `term`: the `top` terms that the group uses
    more than its language, by how far. Terms that fewer than `least` documents of a language have don't count.
    """
    kept = stored(kept_counts(docs, least), f"{shared_dir(docs.sparkSession, 'divergence')}/kept")
    sizes = group_sizes(docs, kept)
    share = f"1 + (cast({UNIT} as decimal(10)) * cast({{}} + 2 as decimal(19))) div cast({{}} + 2 * terms as decimal(20))"
    priced = kept.join(sizes, ["lang", "source"]).withColumns({"p": F.expr(share.format("n", "n_group")), "q": F.expr(share.format("total", "n_lang"))})
    terms = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    pairs = pair_values(kept, sizes).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # The rank's limit reaches the tasks before the shuffle (a group limit), so a group's terms don't meet in one.
    best = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), used AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), groups AS (
  SELECT lang, source, coalesce(sum(u.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN used u USING (lang, source) GROUP BY lang, source
), priced AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 2)) // (g.n + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v) AS q
  FROM groups g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), items AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM priced WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM items
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
