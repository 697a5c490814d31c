"""Streaming forms of the snapshot operators (Structured Streaming)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchloom.operators import assist, persona
from matchloom.sources.files import rows_of


def daily_windows(events: DataFrame) -> DataFrame:
    """Count and sum of each day and type; with a watermark on `ts` it also runs on a stream (an extension)."""
    by_day = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return by_day.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def accumulate(target: str, keys: list[str], order: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch: append rows whose keys are new to the target, stamped with their batch (first seen).

    Of a batch's rows with one key the first by `order` (by all other columns without it) counts. A
    batch that is run again after a failure replaces its own part, so nothing is doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        by = order or [c for c in batch.columns if c not in keys]
        rest = [c for c in batch.columns if c not in keys]
        least = F.min_by(F.struct(*rest), F.struct(*by)) if rest else F.lit(None)
        picked = batch.groupBy(*keys).agg(least.alias("r"))
        rows = picked.select(*keys, *[F.col("r")[c].alias(c) for c in rest]).select(*batch.columns, F.lit(number).alias("first_seen"))
        old = rows_of(batch.sparkSession, target)
        if old is not None:
            rows = rows.join(old.where(F.col("first_seen_batch") != number).select(*keys), keys, "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/first_seen_batch={number}")

    return write


def drift_history(target: str, key: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: each batch is a new state; what it adds and drops against the one before is appended to the history."""
    from matchloom.operators import corpus

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = batch.select(key).distinct()
        before = rows_of(spark, f"{target}/state/{number - 1}")
        if before is None:
            before = now.where("false")
        corpus.drift(before, now, key).write.mode("overwrite").parquet(f"{target}/history/batch={number}")
        now.write.mode("overwrite").parquet(f"{target}/state/{number}")

    return write


def interviews(answers: DataFrame, items: list[tuple[str, list[str]]], action: str = persona.ACTION, result: str = persona.RESULT) -> DataFrame:
    """(session, seq, item, score, next) of answers (session, seq, answer), a stream or a table: a session walks through `items` (label, keywords).

    An answer is scored together with those before it to the same item: a sentence of five
    characters or more with a keyword, an action, a result. Under two points the item is asked once
    more (followup), else the session goes on (main), until no item is left (done); answers after
    that count for nothing. On a stream, answers of one session are taken by seq within a
    micro-batch, and the state is the item's number, whether it is asked again, and the text so far.
    """
    acts, results = re.compile(action), re.compile(result)

    def score(text: str, words: list[str]) -> int:
        said = [s.lower() for s in re.split(persona.SENTENCE_END, text) if len(s.strip()) >= 5]
        return sum((any(w and w.lower() in s for s in said for w in words), bool(acts.search(text)), bool(results.search(text))))

    columns = ["session", "seq", "item", "score", "next"]

    def walk(session, answers: list[tuple[int, str]], at: int, again: bool, text: str) -> tuple[list[tuple], tuple[int, bool, str]]:
        out = []
        for seq, answer in sorted(answers):
            if at >= len(items):
                break
            label, words = items[at]
            text = f"{text}\n{answer}" if again else answer
            points = score(text, words)
            if points < 2 and not again:
                again, then = True, "followup"
            else:
                at, again, then = at + 1, False, "main" if at + 1 < len(items) else "done"
            out.append((session, seq, label, points, then))
        return out, (at, again, text)

    def said(pdf: pd.DataFrame) -> list[tuple[int, str]]:
        return list(zip(pdf["seq"].tolist(), pdf["answer"].fillna("").tolist()))

    def live(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, after = walk(key[0], [a for pdf in parts for a in said(pdf)], *(state.get if state.exists else (0, False, "")))
        state.update(after)
        yield pd.DataFrame(out, columns=columns)

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(walk(key[0], said(pdf), 0, False, "")[0], columns=columns)

    kind = answers.schema["session"].dataType.simpleString()
    schema = f"session {kind}, seq long, item string, score int, next string"
    sessions = answers.select("session", "seq", "answer").groupBy("session")
    if answers.isStreaming:
        return sessions.applyInPandasWithState(live, schema, "at int, again boolean, text string", "append", GroupStateTimeout.NoTimeout)
    return sessions.applyInPandas(whole, schema)


def latest_per_day(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: one point per key and day, the last by time, in a table that is partitioned by day.

    Only the days that a batch has are read and written again; files of other days stay as they are.
    A batch that is run again after a failure gives what it gave, since the last point of all is kept.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows, old = batch, rows_of(spark, path)
        if old is not None:
            days = batch.select("as_of").distinct()
            rows = rows.unionByName(old.select(*batch.columns).join(days, "as_of", "left_semi").select(*batch.columns))
        latest = assist.daily_snapshots(rows)
        latest.repartition("as_of").write.partitionBy("as_of").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    return write


def late_once(events: DataFrame, keys: list[str], wait: str = "1 day") -> DataFrame:
    """Drop repeats of a key within the watermark (an extension: the reference merges by key at any age)."""
    return events.withWatermark("ts", wait).dropDuplicatesWithinWatermark(keys)
