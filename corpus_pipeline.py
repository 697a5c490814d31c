"""The corpus pipeline: language ID, exact and near duplicates, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import op1_jaccard_join, op6_language, op8_decontaminate, op9_byte_bpe, op10_exact_dedup
from matchloom.llm.common import drop_path, shared_dir, stored, table


#: Columns that stages read; all others only pass through.
READ = ("doc_id", "text", "lang", "source")


def kept_rows(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], keep: str) -> DataFrame:
    """The rows of docs for which `keep` holds of what `operator` adds; columns of any names come back as they were.

    Operators' results take the place of input columns of their names, so those that no stage reads
    go through under other names.
    """
    aside = {c: c if c.lower() in READ else f"passing_{i}" for i, c in enumerate(docs.columns)}
    found = operator(docs.select([F.col(f"`{c}`").alias(name) for c, name in aside.items()])).where(keep)
    return found.select([F.col(f"`{name}`").alias(c) for c, name in aside.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those that the classifier rejects (no letters, too far) go.

    Null, empty and letterless texts go; repeated rows share one fate; an empty table stays empty; texts
    of any length are read whole.
    """
    model = op6_language.fit(docs.where(~op6_language.is_held_out()))
    return kept_rows(docs, lambda rows: op6_language.predict(rows, model), "not rejected")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id.

    Null and empty texts are equal; of repeated rows one stays; null identifiers rank last.
    """
    return kept_rows(docs, op10_exact_dedup.exact_dedup, "kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its shingles of five words.

    Texts without words link with nothing and stay, as do rows without identifier; rows that repeat
    the group's smallest identifier all stay (the stage before leaves no repeats).
    """
    return kept_rows(docs, lambda rows: op1_jaccard_join.near_duplicates(rows, size=5, percent=80), "component_id <=> doc_id")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is benchmark text.

    Texts without words are clean; an empty benchmark leaves every row.
    """
    benchmark = table(spark, sf_dir, "benchmark")
    return kept_rows(docs, lambda rows: op8_decontaminate.find_contamination(rows, benchmark), "not contaminated")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text; null and empty texts have none."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    found = op9_byte_bpe.encode(docs, path, pattern, decoded="decoded", keep=["doc_id", "lang", "source", "text"])
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express the classifier and the tokenizer; tests hold each stage against a plain version of its rule.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is stored in the shared folder until the next has it."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = shared_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if before:
            drop_path(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
