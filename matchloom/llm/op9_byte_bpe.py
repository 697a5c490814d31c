"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton.

Method. Every byte maps to the Latin-1 character of the same number, so pyahocorasick (which takes
str) sees bytes. For each piece of text the automaton gives the longest vocabulary token from every
position. The encoder goes from left to right, takes the longest token that is compatible with its
left neighbour, and falls back to shorter prefixes, or steps back and marks the position as a dead
end, when none is. A sequence of tokens is the BPE encoding of its bytes exactly when each pair of
neighbours is, so compatibility is decided on pairs and memoised. No position is tried twice after
it was marked, hence time is linear in the piece.

Equal stretches of a batch are cut into pieces once, and equal pieces are encoded once: Arrow numbers
the distinct ones and then takes each place's ids from theirs. The pieces that the memo lacks go
through the automaton and the encoder in blocks, all pieces of a block one trial at a time in NumPy;
the automaton has the tokens of three bytes and more, a table those of one and two. Decoding takes
the tokens' bytes by id, also in Arrow.

Both directions run as mapInArrow over Spark's partitions, with no shuffle; a lost executor only
costs its own partitions. The vocabulary file (path is a parameter) has to be installed on the
executors, as a Python package is.

Defined cases, here as in `encode` and `decode`: null and empty texts have no tokens, repeated rows
each get theirs, an empty table gives an empty table, and input columns named like a result give way.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.common import slices, table, unused, without

#: Pairs of tokens that a worker remembers (a power of two), and those of pieces that go alone.
PAIRS, MEMO = 1 << 19, 1 << 15
#: Pieces that a task remembers.
KNOWN = 1 << 16
#: Bytes of pieces that go on together, and of the longest of them.
BLOCK, LONG = 1 << 16, 64
NEVER, ID = 1 << 60, (1 << 20) - 1
MIX = np.uint64(0x9E3779B97F4A7C15)
# Fixed value: the pattern whose pieces never go on over a plain space between two characters that
# aren't white space. The one before ends there and the next begins with it.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space but the plain space and the line feed; what marks a space beside white space.
RARE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
BESIDE = ("  ", " \n", "\n ")
#: Stands before each space that begins a stretch; texts that have it are awkward.
BORDER = "\x1f"


def awkward(text: str) -> bool:
    """A space beside white space or at an end of the text, or white space of a rare kind."""
    return text[:1] == " " or text[-1:] == " " or any(c in text for c in BESIDE) or any(c in text for c in RARE)


class BytePairs:
    """A vocabulary of byte tokens in merge order."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        token = {i: b for b, i in self.rank.items()}
        self.find = regex.compile(pattern).findall
        self.size = np.array([len(token.get(i, b"")) for i in range(max(token) + 1)])
        self.joined = {self.rank[w[:k]] << 20 | self.rank[w[k:]]: i for w, i in self.rank.items() for k in range(1, len(w)) if w[:k] in self.rank and w[k:] in self.rank}
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        self.single, self.double = np.full(1 << 8, -1), np.full(1 << 16, -1, dtype=np.int32)
        reachable = {}
        for word, i in self.rank.items():
            parts = self.merged(word, until=2)
            if len(word) == 1 or len(parts) == 2 and parts[0] + parts[1] == word:
                reachable[word] = i
                if len(word) > 1:
                    self.halves[i] = (self.rank[parts[0]], self.rank[parts[1]])
                if len(word) > 2:
                    self.automaton.add_word(word.decode("latin-1"), len(word) << 20 | i)
                else:
                    (self.single, self.double)[len(word) - 1][int.from_bytes(word, "big")] = i
        self.automaton.make_automaton()  # without tokens that merging can't reach: they only match whole pieces
        self.shorter = np.full(len(self.size), -1)  # the longest reachable proper prefix
        for word, i in reachable.items():
            self.shorter[i] = next((reachable[word[:end]] for end in range(len(word) - 1, 0, -1) if word[:end] in reachable), -1)
        self.spaced = pattern == SPACED
        self.tokens = Tokens(token)  # for a decoder in the same pass
        self.pairs = np.full(PAIRS, -1)  # each with its answer, at a place given by its hash; a newer one takes it over
        self.alone: dict[int, bool] = {}
        self.forget()
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}

    def merged(self, word: bytes, until: int = 1) -> list[bytes]:
        """The definition: merge the neighbours of lowest rank, leftmost first, down to `until` parts."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > until:
            ranks = [self.rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least == NEVER:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at a token's left (0) or right (1) edge while it is merged, each with the rank that ends it."""
        out, ends = [], NEVER
        while True:
            out.append((token, ends))
            if token not in self.halves:
                return out
            token, ends = self.halves[token][side], token

    def compatible(self, a: int, b: int) -> bool:
        """No merge across the border comes before the merges that end its two parts (a tie goes to the left)."""
        right = self.right.get(a) or self.right.setdefault(a, self.edge(a, 1))
        left = self.left.get(b) or self.left.setdefault(b, self.edge(b, 0))
        joined = self.joined.get
        for last, last_ends in right:
            for first, first_ends in left:
                across = joined(last << 20 | first)
                if across is not None and across < last_ends and across <= first_ends:
                    return False
        return True

    def compatible_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`compatible` for many pairs; what was decided before is looked up."""
        pairs = a << 20 | b
        places = (pairs.astype(np.uint64) * MIX >> np.uint64(64 - PAIRS.bit_length() + 1)).astype(np.int64)
        known = self.pairs[places]
        fits, new = known & 1 == 1, np.flatnonzero(known >> 1 != pairs)
        if len(new):
            distinct, first, back = np.unique(pairs[new], return_index=True, return_inverse=True)
            found = np.array([self.compatible(p >> 20, p & ID) for p in distinct.tolist()])
            fits[new] = found[back]
            self.pairs[places[new[first]]] = distinct << 1 | found
        return fits

    def longest(self, data: bytes, stop: np.ndarray) -> np.ndarray:
        """The longest token from each place of data that ends by the place's stop."""
        codes = np.frombuffer(data, dtype=np.uint8)
        out = np.append(self.single[codes], -1)
        pair = self.double[codes[:-1].astype(np.int64) << 8 | codes[1:]]
        starts = np.flatnonzero((pair >= 0) & (stop[:-1] > np.arange(1, len(data))))
        out[starts] = pair[starts]
        hits = np.fromiter(chain.from_iterable(self.automaton.iter(data.decode("latin-1"))), dtype=np.int64) if len(self.automaton) else np.zeros(0, dtype=np.int64)
        ends, found = hits[::2] + 1, hits[1::2]
        starts = ends - (found >> 20)
        inside = ends <= stop[starts]
        out[starts[inside]] = found[inside] & ID  # ends ascend, so the longest comes last
        return out

    def encode_block(self, data: bytes, bounds: np.ndarray) -> np.ndarray:
        """The tokens of the pieces of data, each at the place where it begins; -1 elsewhere.

        All go on together, one trial each at a time, by the steps of `encode_long`.
        """
        stop = bounds[1:]
        longest = self.longest(data, np.repeat(stop, np.diff(bounds)))
        size, shorter = self.size, self.shorter
        out, left = np.full(len(data), -1), np.full(len(data) + 1, -1)  # left: the token that ends at a place
        dead = np.zeros(len(data) + size.max() + 1, dtype=bool)
        begin, at = bounds[:-1], bounds[:-1].copy()
        token, last = longest[at], np.full(len(at), -1)
        while len(at):
            end = at + size[token]
            fits = (token >= 0) & ~dead[end]
            asked = np.flatnonzero(fits & (last >= 0))
            fits[asked] = self.compatible_all(last[asked], token[asked])
            back = np.flatnonzero(token < 0)
            on = np.flatnonzero(fits)
            out[at[on]] = left[end[on]] = token[on]
            others = shorter[token]
            if len(back):  # step back and mark the dead end
                dead[at[back]] = True
                others[back] = last[back]
                at[back] -= size[last[back]]
                if (at[back] < begin[back]).any() or (last[back] < 0).any():
                    raise ValueError("bytes that the vocabulary doesn't have")
                out[at[back]] = -1
                last[back] = np.where(at[back] > begin[back], left[at[back]], -1)
            at = np.where(fits, end, at)
            last = np.where(fits, token, last)
            token = np.where(fits, longest[at], others)
            going = np.flatnonzero(at < stop)
            if len(going) < len(at):
                at, begin, stop, token, last = at[going], begin[going], stop[going], token[going], last[going]
        return out

    def encode_long(self, word: bytes) -> np.ndarray:
        """`encode_block` for one piece, so long that others would wait for it."""
        pairs, compatible, shorter, size = self.alone, self.compatible, self.shorter.item, self.size.item
        longest = self.longest(word, np.full(len(word), len(word))).tolist()
        dead: set[int] = set()
        out: list[int] = []
        at, token, last = 0, longest[0], 0  # last: the token on the left and a gap for the next
        while at < len(word):
            while token >= 0:
                end = at + size(token)
                if end not in dead:
                    if not out:
                        break
                    fits = pairs.get(last | token)
                    if fits is None:
                        if len(pairs) >= MEMO:
                            pairs.clear()
                        fits = pairs[last | token] = compatible(last >> 20, token)
                    if fits:
                        break
                token = shorter(token)
            if token >= 0:
                out.append(token)
                at, last, token = end, token << 20, longest[end]
            elif out:
                dead.add(at)
                token = out.pop()
                at -= size(token)
                last = out[-1] << 20 if out else 0
            else:
                raise ValueError("bytes that the vocabulary doesn't have")
        found, tokens = np.full(len(word), -1), np.array(out)
        found[np.cumsum(self.size[tokens]) - self.size[tokens]] = tokens
        return found

    def encode_pieces(self, pieces: pa.Array) -> pa.LargeListArray:
        """The ids of distinct pieces: a token's own, or those of the tokens that merging leaves."""
        whole = pc.index_in(pieces, value_set=self.tokens.bytes)
        lengths, alone = pc.binary_length(pieces).to_numpy(), whole.is_valid().to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~alone)
        rest = rest[np.argsort(lengths[rest] > LONG, kind="stable")]
        bounds, short = np.concatenate(([0], np.cumsum(lengths[rest]))), int((lengths[rest] <= LONG).sum())
        cuts = np.unique(np.concatenate((np.searchsorted(bounds, np.arange(0, bounds[short], BLOCK)), np.arange(short, len(rest) + 1))))
        data = joined(pieces.take(pa.array(rest)))
        counts, parts = alone.astype(np.int64), [np.zeros(0, dtype=np.int32)]
        for a, b in pairwise(cuts.tolist()):
            part, edges = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
            found = self.encode_block(part, edges) if b <= short else self.encode_long(part)
            counts[rest[a:b]] = np.add.reduceat(found >= 0, edges[:-1], dtype=np.int64)
            parts.append(found[found >= 0].astype(np.int32))
        ends = np.cumsum(counts)
        ids, sizes = np.empty(counts.sum(), dtype=np.int32), counts[rest]
        ids[ends[alone] - 1] = whole.drop_null().to_numpy()
        ids[np.repeat(ends[rest] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())] = np.concatenate(parts)
        return lists(ends, ids)

    def forget(self) -> None:
        """Empty the memo of pieces."""
        self.known, self.known_ids = pa.array([], pa.large_binary()), lists(np.zeros(0), np.zeros(0))

    def recall_pieces(self, pieces: pa.Array) -> pa.LargeListArray:
        """`encode_pieces`, with the ids of known ones from the memo, which keeps what was used last."""
        pieces = pieces.cast(pa.large_binary())
        at = pc.index_in(pieces, value_set=self.known)
        new = at.is_null()
        made = self.encode_pieces(pieces.filter(new))
        which = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh, unused = new.to_numpy(zero_copy_only=False), np.ones(len(self.known), dtype=bool)
        unused[which[~fresh]] = False
        which[fresh] = len(self.known) + np.arange(len(made))
        found = pa.concat_arrays([self.known_ids, made]).take(pa.array(which))
        keep = np.flatnonzero(pc.binary_length(pieces).to_numpy() <= LONG)[:KNOWN]
        stay = np.flatnonzero(unused)[: KNOWN - len(keep)]
        self.known = pa.concat_arrays([pieces.take(pa.array(keep)), self.known.take(pa.array(stay))])
        self.known_ids = pa.concat_arrays([found.take(pa.array(keep)), self.known_ids.take(pa.array(stay))])
        return found

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text.

        Texts in which every space is a border of pieces are cut there, and each distinct stretch of
        the batch is cut into pieces once; other texts, and all with another pattern than SPACED, as a
        whole. Of all pieces, each distinct one is encoded once.
        """
        values = ["" if t is None else t for t in texts.to_pylist()]
        whole = [i for i, t in enumerate(values) if not self.spaced or awkward(t)]
        alone = [values[i] for i in whole]
        for i in whole:
            values[i] = ""
        cut = pc.split_pattern(pc.replace_substring(pa.array(values, pa.large_string()), " ", BORDER + " "), BORDER)
        words = cut.flatten().dictionary_encode()
        # Stretches with a space before them are cut into pieces in one go: no piece goes on into the next space.
        glued = pc.starts_with(words.dictionary, " ")
        joint, others = words.dictionary.filter(glued), words.dictionary.filter(pc.invert(glued))
        pieces = [self.find(joined(joint).decode()), *map(self.find, [*others.to_pylist(), *alone])]
        counts = [len(p) for p in pieces]
        found = pa.array(chain.from_iterable(pieces), pa.large_string(), size=sum(counts))
        ends = np.cumsum(pc.binary_length(found[: counts[0]]).to_numpy())
        last = np.concatenate((np.searchsorted(ends, np.cumsum(pc.binary_length(joint).to_numpy())) + 1, np.cumsum(counts)[1:]))
        found = found.dictionary_encode()
        taken = self.recall_pieces(found.dictionary).take(found.indices)
        table = lists(taken.offsets.to_numpy()[last], taken.flatten())
        places = np.empty(len(words.dictionary), dtype=np.int64)
        first = glued.to_numpy(zero_copy_only=False)
        places[first], places[~first] = np.arange(len(joint)), len(joint) + np.arange(len(others))
        which = places[words.indices.to_numpy()]
        which[cut.offsets.to_numpy()[whole]] = len(places) + np.arange(len(whole))
        taken = table.take(pa.array(which))
        bounds = taken.offsets.to_numpy()[cut.offsets.to_numpy()]  # of the texts, in ids
        return pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), taken.flatten())


def joined(words: pa.Array) -> bytes:
    """The bytes of all words, of a large type."""
    if not len(words):
        return b""
    places = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    return words.buffers()[2][places[0] : places[-1]].to_pybytes() if places[-1] > places[0] else b""


def lists(ends: np.ndarray, ids: np.ndarray | pa.Array) -> pa.LargeListArray:
    """Ids in rows, by the end of each."""
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int64()), pa.array(ids, pa.int32()))


class Tokens:
    """The bytes of each id, as an Arrow array."""

    def __init__(self, known: dict[int, bytes]):
        self.bytes = pa.array([known.get(i) for i in range(max(known) + 1)], pa.large_binary())

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes of each row's ids; null for null ids. An unknown id raises an error."""
        flat = ids.flatten()
        taken = self.bytes.take(flat)
        if taken.null_count:
            raise ValueError("ids that the vocabulary doesn't have")
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        ends = taken.buffers()[1]
        places = np.frombuffer(ends, dtype=np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, dtype=np.int64)
        bounds = places[np.concatenate(([0], np.cumsum(sizes)))]
        whole = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(bounds.astype(np.int32)), taken.buffers()[2]])
        return pc.if_else(ids.is_valid(), whole, None) if ids.null_count else whole


@lru_cache(maxsize=1)
def tokens_of(path: str) -> Tokens:
    with open(path, "rb") as lines:
        return Tokens({int(b): base64.b64decode(a) for a, b in (line.split() for line in lines if line.strip())})


@lru_cache(maxsize=1)
def vocabulary(path: str, pattern: str) -> BytePairs:
    return BytePairs(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids", decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add the token ids of each whole text as array<int>.

    Null and empty texts have no tokens. Every input row and column stays (a column named like
    `out` gives way), or with `keep` only the columns named there. Text that looks like a special
    token is ordinary text. With `decoded`, a column of that name gets the bytes that the ids decode
    to, in the same pass.
    """
    results = [out] + ([decoded] if decoded else [])
    rows = without(docs, *results)
    stay = [c for c in rows.columns if keep is None or c in keep]
    rows = rows.select(*[F.col(f"`{c}`") for c in stay], F.col(f"`{text_col}`").cast("string").alias(*unused(rows, "input")))
    fields = [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.BinaryType(), True)] if decoded else [])
    schema = T.StructType([*rows.schema.fields[: len(stay)], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in slices(batches, len(stay), rows=4096, size=1 << 20):
            done = [words.encode(batch.column(len(stay)))]
            if decoded:
                done.append(words.tokens.decode(done[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(stay)], *done], names=[*stay, *results])
        words.forget()

    return rows.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for. Null ids give null; an unknown id fails the job."""
    rows = without(tokens, out)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType(), True)])
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens_of(path).decode(batch.column(at))], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, path, pattern, decoded="decoded", keep=["doc_id"]).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
