"""Vectorised word hashes of whole texts, and fixed-size bitmaps that thin out later passes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that are hashed at once in one task (a longer text is taken alone).
CHUNK = 1 << 18
#: Bases of the two hashes; the second makes 128 bits of the first where equality counts.
BASE, SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
FOLD = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))
PLAIN = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def powers(size: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    out = []
    for base in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


@lru_cache(maxsize=2)
def byte_codes(base: int = BASE) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))


def hashed_words(texts: list[str | None], fold: bool, base: int = BASE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of the words of a chunk of rows, words per row); words are runs of [^\x20\x09-\x0D].

    With `fold` A-Z count as a-z.
    """
    table, begin = FOLD if fold else PLAIN, 0
    while begin < len(texts):
        coded, size = [], 0
        while begin + len(coded) < len(texts) and (not coded or size < CHUNK):
            coded.append((texts[begin + len(coded)] or "").encode("utf-8", "surrogatepass"))
            size += len(coded[-1]) + 1
        end = begin + len(coded)
        joined = np.frombuffer((b" " + b" ".join(coded) + b" ").translate(table), dtype=np.uint8)
        power, inverse = powers(1 << max(19, len(joined).bit_length()), base)
        blank = joined == 32
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        stops = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        sums = np.zeros(len(joined) + 1, dtype=np.uint64)
        np.cumsum(byte_codes(base)[joined] * power[: len(joined)], out=sums[1:])
        words = mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
        edges = 1 + np.cumsum([0] + [len(c) + 1 for c in coded])
        yield begin, words, np.diff(np.searchsorted(starts, edges))
        begin = end


def bitmap(values: DataFrame, hashed: Column, log2_bits: int) -> np.ndarray:
    """Bits of hash mod 2**log2_bits that occur, as bytes: a fixed size, whatever the number of rows.

    Used to skip what can't match before a shuffle. A wrongly set bit only costs work.
    """
    slot = F.pmod(hashed, F.lit(1 << log2_bits)) + 1
    rows = values.groupBy(F.bitmap_bucket_number(slot).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()  # at most 2**log2_bits / 8 bytes
    out = np.zeros((1 << log2_bits) // 8, dtype=np.uint8)
    for r in rows:
        out[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def marked(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which of the hashes (int64) have their bit set."""
    slot = hashed & (len(bits) * 8 - 1)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def rolled(words: np.ndarray, size: int, base: int = BASE) -> np.ndarray:
    """Hash of `size` consecutive words from each position on (of all words given, over row borders too)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.array([], dtype=np.uint64)
    power, inverse = powers(1 << max(19, len(words).bit_length()), base)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * inverse[:n])
