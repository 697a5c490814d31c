"""The best profiles of each user by upper bounds: no table of users and codes.

The profile matrix (codes times top_k items, a bounded table whose size is checked) is an inverted
index: for each node the codes that hold it, their weights and the largest of them. A user's nodes
are taken by falling largest weight. Once what the remaining nodes could give is under the user's
k-th best score so far, no new code can come in, and codes that can't reach that score any more are
dropped: only the others are scored to the end. Users are spread by Spark; a user is their nodes
that some profile holds, which the matrix bounds. Where the codes are few, bounds save less than
they cost: then blocks of users are scored at once, as sums over the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.operators import matching

#: Rows of a profile matrix that may be sent to every task; a larger one is matched by joins.
MATRIX_ROWS = 1 << 20
#: Up to so many codes, users are scored in blocks, of so many cells (users times codes) and index entries.
FEW_CODES, BLOCK_CELLS = 1024, 1 << 20
#: Scores count to so many digits; under a half of the last one sums in another order may differ.
DIGITS, MARGIN = 9, 1e-8


class Index:
    """Codes by node, with weights."""

    def __init__(self, codes: list[str], nodes: list[str], weights: list[float]):
        self.codes = sorted(set(codes))
        place = {c: i for i, c in enumerate(self.codes)}
        self.number = {n: i for i, n in enumerate(dict.fromkeys(nodes))}
        node = np.fromiter((self.number[n] for n in nodes), dtype=np.int64, count=len(nodes))
        order = np.argsort(node, kind="stable")
        self.code = np.fromiter((place[c] for c in codes), dtype=np.int64, count=len(codes))[order]
        self.weight = np.asarray(weights, dtype=np.float64)[order]
        self.at = np.concatenate(([0], np.cumsum(np.bincount(node, minlength=len(self.number)))))
        self.most = np.maximum.reduceat(self.weight, self.at[:-1]) if len(nodes) else np.array([])
        self.bounded = not len(nodes) or self.weight.min() >= 0

    def best(self, nodes: list[str], k: int, out: list[str] = ()) -> tuple[list[tuple[str, float, int, int]], int]:
        """((code, score, overlap, rank) of the codes that share a node and rank up to k; how many codes were scored to the end).

        Codes of `out` take no rank. Ranks are over all codes: by score, equal ones and scores of 0 by code.
        """
        known = np.array(sorted({self.number[n] for n in nodes if n in self.number}, key=lambda n: (-self.most[n], n)), dtype=np.int64)
        score, overlap = np.zeros(len(self.codes)), np.zeros(len(self.codes), dtype=np.int64)
        allowed = np.ones(len(self.codes), dtype=bool)
        allowed[[i for i, c in enumerate(self.codes) if c in set(out)]] = False
        left = np.cumsum(self.most[known][::-1])[::-1] if len(known) else np.array([])
        alive = None  # the codes that may still come in, once they are known
        for i, n in enumerate(known):
            if self.bounded and len(self.codes) > k:
                worst = np.partition(np.where(allowed, score, 0.0), -k)[-k]
                if worst > 0 and left[i] < worst - MARGIN:
                    may = allowed & (score + left[i] >= worst - MARGIN)
                    alive = may if alive is None else alive & may
            codes, weights = self.code[self.at[n] : self.at[n + 1]], self.weight[self.at[n] : self.at[n + 1]]
            if alive is not None:
                some = alive[codes]
                codes, weights = codes[some], weights[some]
            score[codes] += weights
            overlap[codes] += 1
        scored = np.flatnonzero((overlap > 0) & allowed if alive is None else alive)
        key = np.round(score, DIGITS)
        good = scored[key[scored] > 0]
        good = good[np.lexsort((good, -key[good]))]
        rank = {int(c): i + 1 for i, c in enumerate(good[:k])}
        if len(good) < k:  # then every code that shares a node is scored, and the rest rank by code
            rest = np.flatnonzero(allowed & ~(key > 0))
            rank |= {int(c): len(good) + i + 1 for i, c in enumerate(rest[: k - len(good)]) if overlap[c]}
        return [(self.codes[c], float(score[c]), int(overlap[c]), r) for c, r in rank.items()], len(scored)

    def best_of_all(self, nodes: pa.ListArray, k: int, out: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, code, score, overlap, rank) as arrays, block by block: what `best` gives of each row's distinct nodes and of the codes that take no rank."""
        many = len(self.codes)
        if not many:
            return
        places = lambda rows, names: (np.repeat(np.arange(len(rows)), pc.list_value_length(rows).to_numpy()), pc.index_in(rows.flatten(), pa.array(names, rows.type.value_type)).to_numpy(zero_copy_only=False))
        row, node = places(nodes, list(self.number))
        row, node = row[node >= 0], node[node >= 0].astype(np.int64)
        gone_row, gone = places(out, self.codes)
        gone_row, gone = gone_row[gone >= 0], gone[gone >= 0].astype(np.int64)
        entries = self.at[node + 1] - self.at[node]
        before = np.concatenate(([0], np.cumsum(np.bincount(row, weights=entries, minlength=len(nodes)))))
        begin = 0
        while begin < len(nodes):
            stop = min(begin + max(1, BLOCK_CELLS // many), len(nodes), max(begin + 1, int(np.searchsorted(before, before[begin] + BLOCK_CELLS, "right")) - 1))
            a, b = np.searchsorted(row, (begin, stop))
            n, starts = entries[a:b], self.at[node[a:b]]
            at = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())
            cell = np.repeat(row[a:b] - begin, n) * many + self.code[at]
            shape = (stop - begin, many)
            score = np.bincount(cell, weights=self.weight[at], minlength=shape[0] * many).reshape(shape)
            overlap = np.bincount(cell, minlength=shape[0] * many).reshape(shape)
            key = np.maximum(np.round(score, DIGITS), 0)
            a, b = np.searchsorted(gone_row, (begin, stop))
            key[gone_row[a:b] - begin, gone[a:b]] = -1
            order = np.argsort(-key, axis=1, kind="stable")[:, :k]
            i = np.arange(shape[0])[:, None]
            i, rank = np.nonzero((overlap[i, order] > 0) & (key[i, order] >= 0))
            code = order[i, rank]
            yield i + begin, code, score[i, code], overlap[i, code], rank + 1
            begin = stop


def best_profiles(users: DataFrame, profiles: DataFrame, k: int, exclude: DataFrame | None = None, matrix_rows: int = MATRIX_ROWS) -> DataFrame:
    """(user, code, score, overlap, rank) of the profiles up to rank k that share a node with the user.

    The same rows as `ranked(scores(...))` up to that rank; pairs of `exclude` (user, code) take no
    rank. Beyond `matrix_rows` profile items it is that join.
    """
    rows = profiles.select("code", "node", "weight").limit(matrix_rows + 1).toArrow()  # `matrix_rows` at most are used
    if rows.num_rows > matrix_rows:
        return matching.ranked(matching.scores(users, profiles), profiles, exclude).where(F.col("rank") <= k).select("user", "code", "score", "overlap", "rank")
    spark = users.sparkSession
    shared = spark.sparkContext.broadcast(Index(*(rows[c].to_pylist() for c in ("code", "node", "weight"))))
    held = F.broadcast(profiles.select(F.col("node").alias("held")).distinct())  # `matrix_rows` at most
    # Nodes may be of any type; where users and profiles differ in it, the profiles' nodes are looked up.
    mine = users.select("user", "node").distinct().join(held, F.col("node") == F.col("held")).select("user", F.col("held").alias("node"), F.lit(None).cast("string").alias("out"))
    if exclude is not None:
        mine = mine.unionByName(exclude.select("user", F.lit(None).cast(profiles.schema["node"].dataType).alias("node"), F.col("code").alias("out")))
    whole = mine.groupBy("user").agg(F.collect_set("node").alias("nodes"), F.collect_set("out").alias("out"))  # nodes and codes of the matrix
    columns = ["user", "code", "score", "overlap", "rank"]
    schema = T.StructType([T.StructField("user", users.schema["user"].dataType), T.StructField("code", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("overlap", T.LongType()), T.StructField("rank", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, best = shared.value, shared.value.best
        for batch in batches:
            if len(index.codes) <= FEW_CODES:
                names = pa.array(index.codes, pa.string())
                for at, code, score, overlap, rank in index.best_of_all(batch.column(1), k, batch.column(2)):
                    found = [batch.column(0).take(pa.array(at)), names.take(pa.array(code)), pa.array(score), pa.array(overlap.astype(np.int64)), pa.array(rank.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(found, names=columns)
                continue
            found, at = [], []
            for i, (nodes, out) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                some, _ = best(nodes, k, out)
                found += some
                at += [i] * len(some)
            parts = list(zip(*found)) if found else [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(p, t) for p, t in zip(parts, kinds)]], names=columns)

    return whole.mapInArrow(run, schema)
