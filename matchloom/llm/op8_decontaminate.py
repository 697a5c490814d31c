"""Benchmark decontamination with an FM-index per shard of the documents.

Method. The benchmark's windows (13 consecutive words, or a whole shorter item) are the stated
query set; they go to the executors in blocks of bounded size. In each shard of a partition the
documents' words become numbers and are indexed: suffix array, Burrows-Wheeler transform, a wavelet
matrix for ranks, every SAMPLE-th text position kept. All windows are searched backward at once,
their occurrences located by walking to sampled suffix positions, and the spans merged.

A window can only lie where all its pairs of neighbouring words are pairs of the benchmark. Other
stretches can't hold an occurrence and are left out of the index; that is exact and keeps shards
small. Documents never move: there is no shuffle, and a lost executor costs its own partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import drop_path, shared_dir, slices, stored, table, unused, without

WINDOW = 13
#: Bytes of benchmark text in one block (broadcast at once), and words in one shard's index.
BLOCK_BYTES, SHARD_WORDS, SAMPLE = 16 << 20, 1 << 17, 8
#: A-Z to a-z; bytes that [^\x00-\x2F\x3A-\x60\x7B-\x7F] leaves out, to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RESULTS = ("n_words", "n_hit", "spans", "items", "contaminated")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Phrases:
    """One block of the benchmark: its words' numbers (from 2), its windows by length, its word pairs."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            row = tuple(self.number.setdefault(w, len(self.number) + 2) for w in words_of(text))
            for at in range(max(1, len(row) - window + 1) if row else 0):
                owners.setdefault(row[at : at + window], set()).add(item)
        self.wide = len(self.number) + 2
        pairs = {a * self.wide + b for row in owners for a, b in zip(row, row[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.single = np.zeros(self.wide, dtype=bool)
        for row in owners:
            if len(row) == 1:
                self.single[row[0]] = True
        self.shortest = min((len(row) for row in owners if len(row) > 1), default=1 << 30)
        self.by_length: list[tuple[np.ndarray, list[list[str]]]] = []
        for n in sorted({len(row) for row in owners}):
            rows = [row for row in owners if len(row) == n]
            self.by_length.append((np.array(rows, dtype=np.int64), [sorted(owners[row]) for row in rows]))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    rank, k = text.astype(np.int64), 1
    while True:
        ahead = np.zeros(len(rank), dtype=np.int64)
        ahead[:-k or None] = rank[k:] + 1
        key = rank * (int(ahead.max()) + 1) + ahead
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        steps = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        rank[order] = steps
        if steps[-1] == len(rank) - 1 or k >= len(rank):
            return order
        k *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, for many (symbol, position) at once."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = []
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bits = (sequence >> shift) & 1
            ones = np.concatenate(([0], np.cumsum(bits)))
            zeros = len(sequence) - int(ones[-1])
            self.levels.append((shift, ones, zeros))
            sequence = np.concatenate((sequence[bits == 0], sequence[bits == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        start, end = np.zeros(len(symbol), dtype=np.int64), upto
        for shift, ones, zeros in self.levels:
            high = ((symbol >> shift) & 1).astype(bool)
            start = np.where(high, zeros + ones[start], start - ones[start])
            end = np.where(high, zeros + ones[end], end - ones[end])
        return end - start


class FMIndex:
    """Backward search and sampled location over numbers from 1; 0 ends the text."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text, 0)
        order = suffix_order(text)
        self.last = text[order - 1]
        self.ranks = WaveletMatrix(self.last, symbols)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.length = len(text)
        self.place = np.where(order % SAMPLE == 0, order, -1)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase the range of suffixes that begin with it."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.length, dtype=np.int64)
        for column in phrases.T[::-1]:
            low = self.before[column] + self.ranks.rank(column, low)
            high = np.maximum(low, self.before[column] + self.ranks.rank(column, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by stepping left until a sampled one."""
        out, steps = np.full(len(rows), -1, dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        todo, rows = np.arange(len(rows)), rows.copy()
        while len(todo):
            found = self.place[rows] >= 0
            out[todo[found]] = self.place[rows[found]] + steps[todo[found]]
            todo, rows = todo[~found], rows[~found]
            steps[todo] += 1
            symbol = self.last[rows]
            rows = self.before[symbol] + self.ranks.rank(symbol, rows)
        return out


def occurrences(flat: np.ndarray, doc: np.ndarray, block: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, int, list[list[str]]]]:
    """(starts in flat, window numbers, window length, owners by window number) of one Arrow batch."""
    known = flat >= 0
    linked = np.zeros(len(flat), dtype=bool)  # with the next word
    both = np.flatnonzero(known[:-1] & known[1:] & (doc[:-1] == doc[1:])) if len(flat) else np.array([], dtype=np.int64)
    if len(both) and len(block.pairs):
        key = flat[both] * block.wide + flat[both + 1]
        at = np.minimum(np.searchsorted(block.pairs, key), len(block.pairs) - 1)
        linked[both[block.pairs[at] == key]] = True
    from_left = np.concatenate(([False], linked[:-1])) if len(flat) else linked
    first = np.flatnonzero(known & ~from_left)
    last = np.flatnonzero(known & ~linked) + 1  # runs of linked words: [first, last)
    alone = np.concatenate(([0], np.cumsum(known & block.single[np.where(known, flat, 0)])))
    keep = (last - first >= block.shortest) | (alone[last] > alone[first])
    first, last = first[keep], last[keep]
    sizes = last - first + 1  # and a separator
    bounds, total = [0], 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > SHARD_WORDS:
            bounds.append(i)
            total = 0
        total += size
    for a, b in zip(bounds, [*bounds[1:], len(sizes)]):
        if a == b:
            continue
        n = sizes[a:b]
        ends = np.cumsum(n)
        place = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(first[a:b], n)
        text = np.where(place < len(flat), flat[np.minimum(place, len(flat) - 1)], 1)
        text[ends - 1] = 1
        index = FMIndex(text, block.wide)
        for phrases, owners in block.by_length:
            low, high = index.search(phrases)
            hit = np.flatnonzero(high > low)
            if len(hit):
                count = (high - low)[hit]
                rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[hit], count)
                yield place[index.locate(rows)], np.repeat(hit, count), phrases.shape[1], owners


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Find the benchmark's windows in each whole document.

    Returns every input row with its columns (those named like a result give way to it) and
    n_words, n_hit long, spans array<struct<start,stop>> (merged, in words, stop exclusive), items
    array<string> (sorted, those with an occurring window), contaminated (n_hit > 0 and
    share * n_hit >= n_words).

    Defined cases: null or empty texts have no words and are clean; null or empty items have no
    windows; items without identifier are all named '' (their words are hit as others' are); repeated
    items and rows each count by themselves; empty tables give clean documents or no rows; texts of any
    length are read whole, in shards of SHARD_WORDS.

    With more than one block of the benchmark, what a block found is stored in the shared folder
    before the next is read, so one block at a time is held.
    """
    spark = docs.sparkSession
    rows = without(docs, *RESULTS)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = 1 + size // block_bytes
    own_spans, own_items, own_words = unused(rows, "spans", "items", "words")
    marked = rows.withColumns({own_spans: F.expr("cast(array() as array<int>)"), own_items: F.expr("cast(array() as array<string>)"), own_words: F.lit(0).cast("long")})
    at, schema = rows.columns.index(text_col), marked.schema
    folder = shared_dir(spark, "decontaminate") if blocks > 1 else None
    for number in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number)
        block = spark.sparkContext.broadcast(Phrases([(r["item"], r["text"]) for r in part.toLocalIterator()]))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            number = block.value.number.get
            for batch in slices(batches, at):
                numbers = []
                for text in batch.column(at):
                    words = words_of(text.as_py())
                    numbers.append(np.fromiter(map(number, words, repeat(-1)), dtype=np.int64, count=len(words)))
                size = np.array([len(x) for x in numbers], dtype=np.int64)
                ends = np.cumsum(size)
                flat = np.concatenate(numbers) if numbers else np.array([], dtype=np.int64)
                doc = np.repeat(np.arange(len(numbers)), size)
                change = np.zeros(len(flat) + 1, dtype=np.int64)
                old_spans, old_items = batch.column(len(batch.columns) - 3), batch.column(len(batch.columns) - 2)
                found: dict[int, set[str]] = {}
                for starts, windows, length, owners in occurrences(flat, doc, block.value):
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + length, -1)
                    for d, w in set(zip(doc[starts].tolist(), windows.tolist())):
                        found.setdefault(d, set()).update(owners[w])
                spans, all_items = [], []
                cover = np.cumsum(change[:-1]) > 0
                for d, (end, n) in enumerate(zip(ends.tolist(), size.tolist())):
                    before = old_spans[d].as_py()
                    own = cover[end - n : end]
                    if d not in found:
                        spans.append(before)
                    else:
                        own = own.copy()
                        for a, b in zip(before[::2], before[1::2]):
                            own[a:b] = True
                        edges = np.flatnonzero(np.diff(np.concatenate(([False], own, [False]))))
                        spans.append(edges.tolist())
                    all_items.append(sorted({*old_items[d].as_py(), *found.get(d, ())}))
                done = [pa.array(spans, pa.list_(pa.int32())), pa.array(all_items, pa.list_(pa.string())), pa.array(size, pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *done], names=batch.schema.names)

        marked = marked.mapInArrow(run, schema)
        if number + 1 < blocks:
            marked = stored(marked, f"{folder}/{number}")
            block.destroy()
            if number:
                drop_path(spark, f"{folder}/{number - 1}")
    flat = F.col(own_spans)
    halves = F.sequence(F.lit(0), (F.size(flat) / 2).cast("int") - 1)
    pairs = F.transform(halves, lambda i: F.struct(F.get(flat, 2 * i).alias("start"), F.get(flat, 2 * i + 1).alias("stop")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return (
        marked.withColumn("spans", F.when(F.size(flat) > 0, pairs).otherwise(F.expr("cast(array() as array<struct<start:int,stop:int>>)")))
        .withColumn("n_words", F.col(own_words))
        .withColumn("n_hit", hit)
        .withColumn("items", F.col(own_items))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
        .select(*[F.col(f"`{c}`") for c in rows.columns], *RESULTS)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


# Windows as joined words; a document's windows of each length that occurs are compared with them.
SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.p = bw.p),
cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
