"""Coverage, fit, urgency, priority, briefing and snapshots of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import text as X

CREDIT = {"covered": 1.0, "partial": 0.5, "missing": 0.0}


def name_tokens(name: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(name), "[/,]", " "), r"\s+"), lambda t: F.length(t) >= 2)


def coverage(wanted: DataFrame, sections: DataFrame) -> DataFrame:
    """(posting, competency, status, section, evidence) of wanted (posting, competency) against sections (posting, pos, question, answer).

    Covered if every token of the name stands in the joined answers, partial if any does in one
    section, else missing; the section is the first that has a token, the evidence its first line
    with the name's first token that stands there. Names without a usable token are missing.
    """
    tokens = wanted.select("posting", "competency", F.posexplode_outer(F.array_distinct(name_tokens(F.col("competency")))).alias("nth", "token"))
    told = sections.where("trim(answer) <> ''").select("posting", "pos", "question", "answer")
    hits = tokens.join(told, "posting").where(F.contains(F.lower("answer"), F.col("token")))
    lines = F.filter(F.split("answer", "\n"), lambda x: F.contains(F.lower(x), F.col("token")))
    hits = hits.withColumn("evidence", F.regexp_replace(F.get(lines, F.lit(0)), r"^(?U)\s+|\s+$", ""))
    by_token = hits.groupBy("posting", "competency", "token").agg(F.min(F.struct("pos", "nth", "question", "evidence")).alias("first"))
    full = tokens.join(by_token, ["posting", "competency", "token"], "left")
    found = full.groupBy("posting", "competency").agg(F.count("token").alias("tokens"), F.count("first").alias("hit"), F.min("first").alias("first"))
    status = F.when(F.col("hit") == 0, "missing").when(F.col("hit") == F.col("tokens"), "covered").otherwise("partial")
    return found.select("posting", "competency", status.alias("status"), F.col("first.question").alias("section"), F.col("first.evidence").alias("evidence"))


def weighted_coverage(results: DataFrame) -> DataFrame:
    """Importance-weighted credit of each posting; 0 where no importance counts."""
    credit = F.when(F.col("status") == "covered", 1.0).when(F.col("status") == "partial", 0.5).otherwise(0.0)
    rate = F.coalesce(F.try_divide(F.sum(F.col("importance") * credit), F.sum("importance")), F.lit(0.0))
    return results.groupBy("posting").agg(F.round(rate, 6).alias("rate"), *[F.count_if(F.col("status") == s).alias(s) for s in CREDIT])


def importance(counts: DataFrame) -> DataFrame:
    """(term, importance): counts as a share of the largest, three digits."""
    most = counts.agg(F.max("n").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("term", F.round(F.col("n") / F.col("most"), 3).alias("importance"))


def priorities(postings: DataFrame, exponent: float = 1.5, digits: int = 4) -> DataFrame:
    """Rank of open work: gap * urgency * fit**1.5, rounded; fit is clamped, null counts as 1."""
    fit = F.coalesce(F.least(F.greatest("fit", F.lit(0.0)), F.lit(1.0)), F.lit(1.0))
    score = F.round((1 - F.col("rate")) * X.urgency(F.col("days_left")) * F.pow(fit, F.lit(exponent)), digits)
    return postings.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("score"), "posting")))


def briefing(ranked: DataFrame) -> DataFrame:
    """Per owner the focus and the next posting (the first with score and gap; else the first), and how many are urgent."""
    able = (F.col("score") > 0) & (F.col("rate") < 1)
    nth = F.row_number().over(Window.partitionBy("owner").orderBy(F.when(able, 0).otherwise(1), "rank"))
    marked = ranked.withColumn("able", able).withColumn("nth", nth)
    urgent = (F.col("days_left").between(0, 1)) & (F.col("rate") < 1)
    return marked.groupBy("owner").agg(
        F.max(F.when(F.col("nth") == 1, F.col("posting"))).alias("focus"),
        F.max(F.when((F.col("nth") == 2) & F.col("able"), F.col("posting"))).alias("next_up"),
        F.count_if(urgent).alias("urgent"),
        F.count(F.lit(1)).alias("open"),
    )


def urgent(ranked: DataFrame) -> DataFrame:
    """Place of each posting that ends today or tomorrow and has a gap: fewest days, then the largest gap."""
    due = ranked.where(F.col("days_left").between(0, 1) & (F.col("rate") < 1))
    return due.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy("days_left", "rate", "posting")))


def nudge(ranked: DataFrame, pattern: str = "D-%d %s %.4f") -> DataFrame:
    line = F.format_string(pattern, F.col("days_left").cast("int"), F.col("posting").cast("string"), F.col("score"))
    return ranked.where("rank = 1").select("owner", line.alias("line"))


def daily_snapshots(points: DataFrame) -> DataFrame:
    """One point per key and day: the last by time, then by id."""
    order = Window.partitionBy("as_of", "key").orderBy(F.desc("ts"), F.desc("id"))
    return points.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def progress(snapshots: DataFrame) -> DataFrame:
    """Change of the rate since the key's previous snapshot."""
    before = F.lag("rate").over(Window.partitionBy("key").orderBy("as_of"))
    return snapshots.withColumn("delta", F.round(F.col("rate") - before, 6))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed table after an upsert: new rows replace old ones."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def live(postings: DataFrame, as_of: str, within: int | None = None, query: str = "", job: str | None = None, major: str | None = None) -> DataFrame:
    """Postings that are open at as_of (no deadline passes), end within the days, and hold all terms of the query.

    With `job` only those of that job family, with `major` only those whose majors (an array) hold its first two digits.
    """
    day = F.lit(as_of).cast("date")
    found = postings.where(F.col("deadline").isNull() | (F.col("deadline") >= day))
    found = found.where(F.coalesce(F.col("deadline") <= F.date_add(day, 365), F.lit(True)))
    if within is not None:
        found = found.where(F.col("deadline").isNull() | (F.col("deadline") <= F.date_add(day, within)))
    if job is not None:
        found = found.where(F.col("job") == job)
    if major is not None:
        found = found.where(F.array_contains("majors", major[:2]))
    if query:
        found = found.where(X.all_terms(F.col("title"), F.lit(query)))
    return found


def focus(postings: DataFrame, as_of: str) -> DataFrame:
    """Per owner the nearest coming deadline, else the first without one, else the first."""
    days = F.date_diff(F.col("deadline"), F.lit(as_of).cast("date"))
    rank = F.when(days >= 0, 0).when(F.col("deadline").isNull(), 1).otherwise(2)
    order = Window.partitionBy("owner").orderBy(rank, F.when(rank == 0, days), "posting")
    return postings.withColumn("days", days).withColumn("k", F.row_number().over(order)).where("k = 1").select("owner", "posting", "days")


def calendar(tasks: DataFrame) -> DataFrame:
    """Day of each task: its own, else D-n before the deadline, else the deadline for deadline tasks."""
    n = F.regexp_extract("label", r"D-(\d+)", 1)
    offset = F.when(n != "", F.date_sub(F.col("deadline"), F.coalesce(n.try_cast("int"), F.lit(0))))
    return tasks.withColumn("day", F.coalesce("day", offset, F.when(F.contains("label", F.lit("마감일")), F.col("deadline"))))


def timeline(tasks: DataFrame) -> DataFrame:
    """Labels D-ceil(days * (1 - i / (n - 1))) over a posting's tasks in order."""
    i = F.row_number().over(Window.partitionBy("posting").orderBy("pos")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("posting"))
    left = F.ceil(F.col("days") * (1 - i / F.greatest(n - 1, F.lit(1))))
    return tasks.withColumn("label", F.concat(F.lit("D-"), left.cast("string")))
