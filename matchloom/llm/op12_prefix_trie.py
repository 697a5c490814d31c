"""Prefix trie of conversations with subtree totals, by time-forward processing.

A turn counts as the SHA-256 of its role and text, a node as the 128-bit hash of its path; texts
themselves are never shuffled. Sums by node are combined before their shuffle, so a node that all
conversations share is no hot key.

Method. A node's own values (its saved words, and whether it is childless) belong to its smallest
member's row at its depth. Conversations are range-partitioned into shards by their first node and
identifier, whole conversations each, so a shard holds a trie of its own, complete up to the root.
Spark sorts the shard externally by reverse level order; one pass over it pops what children have
sent to a node from a priority queue, adds the node's own values, and sends the total on to the
parent. The queue spills sorted runs to the shared folder. Nodes that stand in several shards are
then summed across them.

The digest of a node's ends needs its members one after another: tasks join sorted identifiers to
pieces of some KB, and one pass hashes the pieces of each node in order, holding none of them.

Defined cases: rows without conv_id belong to no conversation and are left out; turns of one number
are ordered by the SHA-256 of role and text; repeated rows are turns of their own; other columns don't
matter; an empty table gives no node, not even a root. A conversation's turns pass through one task
(32 bytes each, sorted by Spark, streamed), as a document's words do.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.common import shared_dir, stored, table
from matchloom.llm.op11_token_files import file_system

#: Targets that a queue holds in memory.
QUEUE = 1 << 17
#: Rows of an output batch, and bytes of a piece of joined identifiers.
ROWS, PIECE = 8192, 1 << 14
ROOT = bytes(16)
EMPTY = hashlib.sha256().hexdigest()


def light_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (0 for the conversation itself, then 1 for its first turn, ...), digest and words of the turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    turns = turns.withColumn("depth", F.row_number().over(place).cast("long")).select("conv_id", "depth", "digest", "words")
    return turns.unionByName(turns.where("depth = 1").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words")))


def shared_heads(turns: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """Rebuilt conversations: the first h turns of the block's first conversation, then the own turns behind the first h.

    h is crc32 of the decimal conv_id modulo `most`. `turns` and the result are as from light_turns.
    """
    head = F.col("conv_id") - F.col("conv_id") % block
    convs = turns.where("depth = 0").select("conv_id", head.alias("head"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    first = turns.where((F.col("depth") >= 1) & (F.col("depth") < most) & (head == F.col("conv_id"))).select(F.col("conv_id").alias("head"), "depth", "digest", "words")
    taken = convs.join(first, "head").where("depth <= h").select("conv_id", "depth", "digest", "words")
    long = convs.join(first.groupBy("head").agg(F.max("depth").alias("n")), "head", "left").select("conv_id", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("k"))
    own = turns.join(long, "conv_id").where("depth = 0 or depth > h").select("conv_id", F.when(F.col("depth") == 0, 0).otherwise(F.col("depth") - F.col("h") + F.col("k")).alias("depth"), "digest", "words")
    return own.unionByName(taken)


def paths(turns: DataFrame) -> DataFrame:
    """Each conversation's nodes: conv_id, depth, key, parent (key), words, top (key of its first turn), last (whether it ends there)."""
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, key, top = None, ROOT, ROOT  # held: the row before, whose `last` (and at depth 0 `top`) the next one decides
        for batch in batches:
            for conv, depth, digest, words in zip(*(batch.column(i).to_pylist() for i in range(4))):
                same = held is not None and held[0] == conv
                before = key if same else ROOT
                key = hashlib.blake2b(before + digest, digest_size=16).digest() if depth else ROOT
                if depth <= 1:
                    top = key
                if held is not None:
                    out.append((*held[:5], top if same and held[1] == 0 else held[5], not same))
                held = (conv, depth, key, before if depth else None, words, top)
                if len(out) >= ROWS:
                    yield batch_of(out, names, types)
                    out = []
        if held is not None:
            yield batch_of([*out, (*held, True)], names, types)

    names, types = ["conv_id", "depth", "key", "parent", "words", "top", "last"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.bool_()]
    return rows.select("conv_id", "depth", "digest", "words").mapInArrow(run, "conv_id long, depth long, key binary, parent binary, words long, top binary, last boolean")


def batch_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


class SpillingQueue:
    """Totals on their way to parents, in reverse level order; what exceeds `limit` targets waits in sorted runs in a folder.

    A target is (-depth, key). What is sent to one target is summed as far as it meets in memory.
    """

    NAMES, TYPES = ["level", "key", "leaves", "saved"], [pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder, limit
        self.sums: dict[tuple[int, bytes], tuple[int, int]] = {}
        self.heap: list[tuple[int, bytes]] = []
        self.heads: list[tuple[int, bytes, int, int, int]] = []  # the next of each run, with the run's number
        self.runs: list[Iterator[tuple[int, bytes, int, int]]] = []
        self.files: list[tuple] = []

    def push(self, level: int, key: bytes, leaves: int, saved: int) -> None:
        found = self.sums.get((level, key))
        if found is None:
            if len(self.sums) >= self.limit:
                self.spill()
            heapq.heappush(self.heap, (level, key))
            found = (0, 0)
        self.sums[level, key] = (found[0] + leaves, found[1] + saved)

    def spill(self) -> None:
        files, inner = file_system(self.folder)
        files.create_dir(inner, recursive=True)
        name = f"{inner}/{uuid.uuid4().hex}.arrow"
        with files.open_output_stream(name) as out, pa.ipc.new_stream(out, pa.schema(list(zip(self.NAMES, self.TYPES)))) as stream:
            order = sorted(self.sums)
            for at in range(0, len(order), ROWS):
                stream.write_batch(batch_of([(*t, *self.sums[t]) for t in order[at : at + ROWS]], self.NAMES, self.TYPES))
        self.files.append((files, name))
        self.sums, self.heap = {}, []
        self.runs.append(self.read(files, name))
        self.step(len(self.runs) - 1)

    def read(self, files, name: str) -> Iterator[tuple[int, bytes, int, int]]:
        with files.open_input_stream(name) as file, pa.ipc.open_stream(file) as stream:
            for batch in stream:
                yield from zip(*(c.to_pylist() for c in batch.columns))

    def step(self, run: int) -> None:
        found = next(self.runs[run], None)
        if found is not None:
            heapq.heappush(self.heads, (*found[:2], run, *found[2:]))

    def pop(self, level: int, key: bytes) -> tuple[int, int]:
        """All that was sent to the target; targets are asked for in order, and none is passed over."""
        leaves = saved = 0
        while self.heap and self.heap[0] == (level, key):
            a, b = self.sums.pop(heapq.heappop(self.heap))
            leaves, saved = leaves + a, saved + b
        while self.heads and self.heads[0][:2] == (level, key):
            _, _, run, a, b = heapq.heappop(self.heads)
            leaves, saved = leaves + a, saved + b
            self.step(run)
        return leaves, saved

    def close(self) -> None:
        left = len(self.sums) + len(self.heads)
        self.runs = []
        for files, name in self.files:
            files.delete_file(name)
        self.files = []
        if left:
            raise ValueError(f"{left} totals found no node")


def shard_totals(rows: DataFrame, folder: str, limit: int) -> DataFrame:
    """key, n_leaves, saved of each node in each partition of (depth, key, parent, leaf, value), by time-forward processing."""
    sorted_rows = rows.sortWithinPartitions(F.col("depth").desc(), "key").select("depth", "key", "parent", "leaf", "value")
    names, types = ["key", "n_leaves", "saved"], [pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, out, node = SpillingQueue(folder, limit), [], None

        def settle() -> None:
            depth, key, parent, leaves, saved = node
            a, b = queue.pop(-depth, key)
            leaves, saved = leaves + a, saved + b
            out.append((key, leaves, saved))
            if parent is not None and (leaves or saved):
                queue.push(1 - depth, parent, leaves, saved)

        for batch in batches:
            for depth, key, parent, leaf, value in zip(*(c.to_pylist() for c in batch.columns)):
                if node is not None and node[1] == key and node[0] == depth:
                    node = (depth, key, parent, node[3] + leaf, node[4] + value)
                    continue
                if node is not None:
                    settle()
                    if len(out) >= ROWS:
                        yield batch_of(out, names, types)
                        out.clear()
                node = (depth, key, parent, leaf, value)
        if node is not None:
            settle()
            yield batch_of(out, names, types)
        queue.close()

    return sorted_rows.mapInArrow(run, "key binary, n_leaves long, saved long")


def end_digests(ends: DataFrame) -> DataFrame:
    """key and the SHA-256 of its conv_ids, ascending, joined by commas; from rows (key, conv_id)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, size, told = None, 0, 0, []
        for batch in batches:
            out = []
            for now, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if told and (now != key or size >= PIECE):
                    out.append((key, first, ",".join(told)))
                    told, size = [], 0
                if not told:
                    key, first = now, conv
                told.append(str(conv))
                size += len(told[-1]) + 1
            if out:
                yield batch_of(out, ["key", "first", "piece"], [pa.binary(), pa.int64(), pa.string()])
        if told:
            yield batch_of([(key, first, ",".join(told))], ["key", "first", "piece"], [pa.binary(), pa.int64(), pa.string()])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for now, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if now == key:
                    state.update(b"," + piece.encode())
                    continue
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = now, hashlib.sha256(piece.encode())
            if out:
                yield batch_of(out, ["key", "ends"], [pa.binary(), pa.string()])
        if key is not None:
            yield batch_of([(key, state.hexdigest())], ["key", "ends"], [pa.binary(), pa.string()])

    pieces = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(join, "key binary, first long, piece string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends string")


def prefix_trie(turns: DataFrame, queue: int = QUEUE) -> DataFrame:
    """The trie's nodes from turns as light_turns gives them.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes
    of the subtree), saved_tokens (over the subtree, members but one times words of the node's turn),
    ends_sha256 (of the members that end there).
    """
    spark = turns.sparkSession
    folder = shared_dir(spark, "trie")
    rows = stored(paths(turns), f"{folder}/paths")
    nodes = stored(
        rows.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.min(F.col("last").cast("int")).alias("leaf")
        ),
        f"{folder}/nodes",
    )
    own = nodes.select("conv_id", "depth", F.col("leaf").cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("value"))
    shards = rows.select("conv_id", "depth", "key", "parent", "top").join(own, ["conv_id", "depth"], "left").fillna(0, ["leaf", "value"])
    totals = shard_totals(shards.repartitionByRange("top", "conv_id"), f"{folder}/queue", queue)
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = {"conv_id": "long", "depth": "long", "parent_conv_id": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long", "saved": "long", "ends": "string"}
    parts = [
        nodes.join(above, "parent", "left"),  # many children of one node: the skew join of adaptive execution splits them
        nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children")),
        totals,
        end_digests(rows.where("last").select("key", "conv_id")),
    ]
    every = None
    for part in parts:
        part = part.select("key", *[F.col(c) if c in part.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()])
        every = part if every is None else every.unionByName(part)
    total = every.groupBy("key").agg(*[F.sum(c).alias(c) if c in ("n_children", "n_leaves", "saved") else F.max(c).alias(c) for c in none])
    return total.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(shared_heads(light_turns(table(spark, sf_dir, "conversations"))))


SQL = r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos, d, words
  FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS head,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                 lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), sized AS (
  SELECT c.conv_id, c.head, c.h, (SELECT count(*) FROM own o WHERE o.conv_id = c.head AND o.pos <= c.h) AS k FROM convs c
), steps AS (
  SELECT conv_id, 0 AS depth, '' AS d, 0 AS words FROM convs
  UNION ALL SELECT s.conv_id, o.pos, o.d, o.words FROM sized s JOIN own o ON o.conv_id = s.head AND o.pos <= s.h
  UNION ALL SELECT s.conv_id, s.k + o.pos - s.h, o.d, o.words FROM sized s JOIN own o ON o.conv_id = s.conv_id AND o.pos > s.h
), paths AS (
  SELECT conv_id, depth, words, list(d) OVER w AS key, max(depth) OVER (PARTITION BY conv_id) AS last
  FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)
), nodes AS (
  SELECT key, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, max(words) AS words, max(last) = min(depth) AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256
  FROM paths GROUP BY key
), totals AS (
  SELECT a.key, count(*) FILTER (n.leaf) AS n_leaves, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens
  FROM nodes n JOIN paths a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.key
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs,
       (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.key[:-2] = n.key) AS n_children,
       t.n_leaves, t.saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t ON t.key = n.key LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.key[:-2]
"""
