"""Token ids in bit-packed binary files: write in the order of identifiers, read in parallel or at random.

Method. Each id takes the minimum bits that the vocabulary needs. Ids are packed in blocks of a
fixed number, whose byte offsets stand in the file, so numpy unpacks any run of blocks at once and a
reader of ids a to b only fetches the blocks that hold them.

A shard file is: a header; the blocks; the blocks' offsets; the table of documents (identifier and
place of the first id); a trailer that says where the tables begin. A manifest (Parquet, a row for
each shard) names the files and the number of ids before each.

Writing range-partitions the texts by identifier, sorts each part (Spark spills), encodes it with the
tokenizers library and packs it as it goes, so a task holds some MB whatever its part's size. A file
has the task attempt in its name and counts only if the manifest names it; a lost executor's tasks
write anew. Files are written through pyarrow's file systems (local or shared mounts, hdfs, s3, gs).

Texts are cut at plain spaces where the tokenizer's own splitting keeps every piece between white
space (SPACED, checked in the vocabulary file); each distinct stretch of a batch is then encoded once.
Other tokenizers get whole texts.

Defined cases: null text is empty and has the end id alone; null identifiers come first; rows with
one identifier are ordered by a hash of the text, then the text, so repeats stand together, each with
its place; identifiers have to be integers; an empty table gives files of no rows; other input columns
aren't kept. A text may be as long as a row can be.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.common import drop_path, shared_dir, slices, table

# The marks and layout of a file, little-endian.
MAGIC = b"mloomtok"
HEADER = struct.Struct("<8sII")  # magic, bits of an id, ids of a block
TRAILER = struct.Struct("<QQQ8s")  # documents, ids, where the tables begin, magic
#: Ids of a block (a multiple of 8, so that blocks end with a byte), and blocks packed at once.
BLOCK, AT_ONCE = 4096, 64
#: Documents that one reading step takes, and ids that it unpacks at once (a longer document comes alone).
PIECE, IDS = 2048, 1 << 20
#: Words that an encoder remembers at the end of a batch, over tasks too (some 40 bytes each).
WORDS = 1 << 20
#: A word of ASCII letters, perhaps with one of the marks behind it.
MARKS = tuple(".,;:!?")
WORD = "[A-Za-z]+[.,;:!?]?"
# A normaliser and a splitter under which no piece and no composed character reaches over a plain space.
SPACED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


def bits_of(vocabulary: int) -> int:
    """The least number of bits in which every id below `vocabulary` fits."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (uint32, a multiple of 8 of them) at `bits` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(rows[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int) -> np.ndarray:
    """The ids (uint32) of whole packed blocks."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}").astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")
    rows = np.zeros((len(flat) // bits, 32), dtype=np.uint8)
    rows[:, :bits] = flat.reshape(-1, bits)
    return np.packbits(rows, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def file_system(path: str):
    """pyarrow's file system of a path and the path within it; s3a means s3."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class ShardWriter:
    """Packs ids into one file as they come."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.rest = np.array([], dtype=np.uint32)
        self.at = HEADER.size
        self.n_ids, self.offsets, self.names, self.valid, self.sizes = 0, [], [], [], []
        out.write(HEADER.pack(MAGIC, bits, BLOCK))

    def add(self, names: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents: their identifiers (int64, may be null), all their ids, ids of each."""
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id needs more than {self.bits} bits")
        self.names.append(pc.fill_null(names, 0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.valid.append(names.is_valid().to_numpy(zero_copy_only=False))
        self.sizes.append(sizes.astype(np.uint64))
        self.n_ids += len(ids)
        self.rest = np.concatenate((self.rest, ids.astype(np.uint32)))
        while len(self.rest) >= BLOCK:
            blocks = min(AT_ONCE, len(self.rest) // BLOCK)
            self.put(self.rest[: blocks * BLOCK])
            self.rest = self.rest[blocks * BLOCK :]

    def put(self, ids: np.ndarray) -> None:
        step = BLOCK * self.bits // 8
        self.offsets += range(self.at, self.at + step * (len(ids) // BLOCK), step)
        self.at += step * (len(ids) // BLOCK)
        self.out.write(pack(ids, self.bits))

    def close(self) -> tuple[int, int]:
        """Write the last block (filled up with 0) and the tables; the numbers of documents and ids."""
        if len(self.rest):
            self.put(np.pad(self.rest, (0, -len(self.rest) % BLOCK)))
        docs = sum(map(len, self.names))
        first = np.zeros(docs + 1, dtype="<u8")
        if docs:
            np.cumsum(np.concatenate(self.sizes), out=first[1:])
            self.out.write(np.array(self.offsets, dtype="<u8").tobytes())
            self.out.write(np.concatenate(self.names).tobytes())
            self.out.write(np.packbits(np.concatenate(self.valid), bitorder="little").tobytes())
        self.out.write(first.tobytes())
        self.out.write(TRAILER.pack(docs, self.n_ids, self.at, MAGIC))
        self.out.close()
        return docs, self.n_ids


class Shard:
    """Random access to one file; each call reads the bytes that it needs."""

    def __init__(self, path: str):
        files, inner = file_system(path)
        self.file = files.open_input_file(inner)
        magic, self.bits, self.block = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        self.docs, self.n_ids, at, end = TRAILER.unpack(self.file.read_at(TRAILER.size, self.file.size() - TRAILER.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{path} isn't a token file")
        self.offsets = at
        self.names = at + 8 * -(-self.n_ids // self.block)
        self.valid = self.names + 8 * self.docs
        self.first = self.valid + -(-self.docs // 8)

    def numbers(self, at: int, begin: int, count: int, kind: str) -> np.ndarray:
        return np.frombuffer(self.file.read_at(8 * count, at + 8 * begin), kind)

    def documents(self, begin: int, end: int) -> tuple[pa.Array, np.ndarray]:
        """Identifiers of documents `begin` to `end`, and the places of their first ids, with the end of the last."""
        low = begin // 8
        marks = np.frombuffer(self.file.read_at(-(-end // 8) - low, self.valid + low), np.uint8)
        valid = np.unpackbits(marks, bitorder="little")[begin - 8 * low : end - 8 * low].astype(bool)
        return pa.array(self.numbers(self.names, begin, end - begin, "<i8"), mask=~valid), self.numbers(self.first, begin, end - begin + 1, "<u8").astype(np.int64)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids `begin` to `end` of the file; only the blocks that hold them are read."""
        begin, end = max(begin, 0), min(end, self.n_ids)
        if begin >= end:
            return np.array([], dtype=np.uint32)
        low, high = begin // self.block, (end - 1) // self.block
        at = self.numbers(self.offsets, low, high - low + 1, "<u8")
        data = self.file.read_at(int(at[-1] - at[0]) + self.block * self.bits // 8, int(at[0]))
        return unpack(data, self.bits)[begin - low * self.block : end - low * self.block]

    def close(self) -> None:
        self.file.close()


class Encoder:
    """A tokenizer of the tokenizers library; special tokens are neither added nor, with `plain`, recognised.

    Distinct stretches between white space are encoded once and remembered, in Arrow arrays: `words`
    and the ids of each. A word of ASCII letters counts in lower case, and without the mark behind
    it, which is a piece of its own. New words go to the library together, parted by a special token.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = plain
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.added = told.get("added_tokens") or []
        odd = [a for a in self.added if " " in a["content"] or a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or re.fullmatch(WORD, a["content"])]
        self.spaced = (told.get("normalizer"), told.get("pre_tokenizer")) == SPACED and not odd and not told.get("truncation") and not told.get("padding")
        self.part = next((a for a in self.added if a["special"]), None) if not plain else None
        self.forget()

    def forget(self) -> None:
        self.words, self.lists = pa.array([], pa.large_string()), pa.array([], pa.large_list(pa.int32()))
        if self.spaced:
            self.remember(pa.array(["", *MARKS], pa.large_string()))

    def remember(self, words: pa.Array) -> None:
        self.lists = pa.concat_arrays([self.lists, self.encoded(words.to_pylist())])
        self.words = pa.concat_arrays([self.words, words])

    def encoded(self, words: list[str]) -> pa.Array:
        """The ids of each word."""
        parts, sizes = [], []
        for begin in range(0, len(words), 8192):
            some = words[begin : begin + 8192]
            told = " ".join(some)
            together = self.part is not None and not any(a["content"] in told for a in self.added)
            if together:
                ids = np.array(self.model.encode_batch_fast([self.part["content"].join(some)], add_special_tokens=False)[0].ids, dtype=np.int32)
                borders = np.flatnonzero(ids == self.part["id"])
                together = len(borders) == len(some) - 1
            if together:
                parts.append(np.delete(ids, borders))
                sizes.append(np.diff(np.concatenate(([-1], borders, [len(ids)]))) - 1)
            else:
                found = [np.array(e.ids, dtype=np.int32) for e in self.model.encode_batch_fast(some, add_special_tokens=False)]
                parts += found
                sizes.append(np.array([len(x) for x in found], dtype=np.int64))
        bounds = np.concatenate([np.zeros(1, dtype=np.int64), *sizes]).cumsum()
        return pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.array([], dtype=np.int32), *parts])))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32) of the texts, and where each text's begin and end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.spaced:
            lists = self.encoded(texts.to_pylist())
            return lists.flatten().to_numpy(), lists.offsets.to_numpy()
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = cut.flatten().dictionary_encode()
        names = words.dictionary
        simple = pc.match_substring_regex(names, f"^{WORD}$")
        low = pc.if_else(simple, pc.ascii_lower(names), names)
        marked = pc.and_(simple, pc.match_substring_regex(names, "[^A-Za-z]$"))
        cores = pc.if_else(marked, pc.utf8_slice_codeunits(low, 0, -1), low).dictionary_encode()
        mark = pc.if_else(marked, pc.utf8_slice_codeunits(low, -1), "")
        at = pc.fill_null(pc.index_in(cores.dictionary, self.words), -1).to_numpy().copy()
        fresh = at < 0
        at[fresh] = len(self.words) + np.arange(fresh.sum())
        self.remember(cores.dictionary.filter(pa.array(fresh)))
        both = np.empty(2 * len(names), dtype=np.int64)  # a word's core and its mark
        both[::2] = at[cores.indices.to_numpy()]
        both[1::2] = pc.index_in(mark, self.words[: len(MARKS) + 1]).to_numpy()
        lists = self.lists.take(pa.array(both))
        lists = pa.LargeListArray.from_arrays(pa.array(lists.offsets.to_numpy()[::2]), lists.values)
        taken = lists.take(words.indices)
        places = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        ends = taken.offsets.to_numpy()[places]
        if len(self.words) > WORDS:
            self.forget()
        return taken.flatten().to_numpy(), ends - ends[0]


@lru_cache(maxsize=1)
def encoder(path: str, plain: bool) -> Encoder:
    return Encoder(path, plain)


def size_of(path: str) -> int:
    """One more than the largest id of a vocabulary file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, text_col: str = "text", id_col: str = "doc_id", plain: bool = False) -> DataFrame:
    """Encode every whole text, put `end_id` behind each, write shards below `folder` in ascending order of identifiers.

    Returns the manifest, which is stored there too: shard, file, n_docs, n_ids, start (ids before the shard).
    """
    spark = docs.sparkSession
    bits = bits_of(max(size_of(path), end_id + 1))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.select("doc", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("at"), "text")
    rows = rows.repartitionByRange(F.col("doc").asc_nulls_first(), "hash", "at").sortWithinPartitions(F.col("doc").asc_nulls_first(), "hash", "text").select("doc", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, writer, context = encoder(path, plain), None, TaskContext.get()
        for batch in slices(batches, 1, rows=8192, size=8 << 20):
            if writer is None:
                files, inner = file_system(folder)
                files.create_dir(inner, recursive=True)
                name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.tok"
                writer = ShardWriter(files.open_output_stream(f"{inner}/{name}"), bits)
            ids, ends = words.encode(batch.column(1))
            writer.add(batch.column(0), np.insert(ids, ends[1:], end_id), np.diff(ends) + 1)
        if writer is not None:
            yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "file": [name], **dict(zip(("n_docs", "n_ids"), ([n] for n in writer.close())))})

    found = rows.mapInArrow(run, "shard long, file string, n_docs long, n_ids long")
    found.write.mode("overwrite").parquet(f"{folder}/written")
    told = spark.read.schema(found.schema).parquet(f"{folder}/written")
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    told.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).write.mode("overwrite").parquet(f"{folder}/manifest")
    drop_path(spark, f"{folder}/written")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("shard long, file string, n_docs long, n_ids long, start long").parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32).

    Files are read in steps of PIECE documents, dealt over spark.sql.shuffle.partitions tasks, so a
    large file isn't one task's.
    """
    steps = manifest(spark, folder).where("n_docs > 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1, F.lit(PIECE))))
    steps = steps.select("file", "start", "at").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "at")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False), T.StructField("ids", T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in batch.to_pylist():
                shard = Shard(f"{folder}/{step['file']}")
                names, first = shard.documents(step["at"], min(step["at"] + PIECE, shard.docs))
                at = 0
                while at < len(names):
                    stop = min(len(names), max(at + 1, int(np.searchsorted(first, first[at] + IDS, "right")) - 1))
                    bounds = first[at : stop + 1]
                    data = pa.py_buffer(shard.ids(int(bounds[0]), int(bounds[-1])).astype("<u4").tobytes())
                    ids = pa.BinaryArray.from_buffers(pa.binary(), stop - at, [None, pa.py_buffer(((bounds - bounds[0]) * 4).astype(np.int32).tobytes()), data])
                    yield pa.RecordBatch.from_arrays([names[at:stop], pa.array(bounds[:-1] + step["start"]), pa.array(np.diff(bounds)), ids], names=schema.names)
                    at = stop
                shard.close()

    return steps.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
