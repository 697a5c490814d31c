"""Evaluation: coverage report and plan, leave-one-out, cross-domain hits, bias."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators import profile, topk
from matchloom.settings import Settings
from matchloom.sources.store import bucketed


def coverage_report(nodes: DataFrame, s: Settings, goal: int) -> DataFrame:
    """Concentration of each code, the institutions still needed for the goal, and why it fails."""
    found = profile.gate(nodes, s)
    needed = F.ceil(F.greatest(F.lit(goal) - F.col("effective_units"), F.lit(0)) / s.institution_cap)
    reason = F.concat_ws(
        ",",
        F.when(F.col("effective_units") < s.min_effective_units, "units"),
        F.when(F.col("hhi") >= s.max_hhi, "concentration"),
    )
    return found.withColumn("needed_institutions", needed.cast("long")).withColumn("reason", reason)


def top_institutions(nodes: DataFrame, n: int = 3) -> DataFrame:
    by = nodes.select("code", "unit", "inst").distinct().groupBy("code", "inst").agg(F.count(F.lit(1)).alias("units"))
    return by.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("units"), "inst"))).where(F.col("rank") <= n)


def leave_one_out_cells(nodes: DataFrame, s: Settings, top_ks: tuple[int, ...], min_dfs: tuple[int, ...]) -> DataFrame:
    """(top_k, min_df, own, unit, place, predicted) for every pair of cuts: place of each unit's own code, the unit taken out of that profile, and the best code.

    The own profile loses one from each of the unit's items and from its units, and is cut anew; the
    IDF stays global. All codes are ranked, equal scores (and 0) by code. Frequencies are over all
    units. No profile is built by query: an item's new rank in its profile is its reduced key's place
    among the full keys (one window by code), corrected for the unit's own items. All cuts come from
    one pass: min_df is a key of the tables, and each top_k a sum over ranks up to it.
    """
    base = profile.frequencies(nodes, replace(s, min_df=1), sampled=False).select("code", "node", "df", "units")
    base = base.withColumn("d", F.explode(F.array(*[F.lit(d) for d in min_dfs]))).where(F.col("df") >= F.col("d"))
    appear = base.groupBy("d", "node").agg(F.count(F.lit(1)).alias("appear"))
    jobs = profile.gate(nodes, s).where("included").agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("jobs"))
    freq = base.join(appear, ["d", "node"]).crossJoin(F.broadcast(jobs)).withColumn("idf", F.log(F.col("jobs") / F.col("appear"))).drop("jobs", "appear")
    freq = bucketed(freq.withColumn("key", F.round(F.col("df") * F.col("idf"), 9)), "code")  # five steps read it
    ranks = freq.withColumn("rank", F.row_number().over(Window.partitionBy("d", "code").orderBy(F.desc("key"), "node"))).where(F.col("rank") <= max(top_ks))
    weighted = ranks.withColumn("weight", profile.scaled(F.col("idf"), F.col("df") / F.col("units"), s.df_weight))
    codes = ranks.select("d", "code").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("d").orderBy("code")))  # one row for each category
    query = nodes.select("code", "unit", "node").join(F.broadcast(codes.select("d", "code")), "code")

    less = freq.withColumn("key", F.round((F.col("df") - 1) * F.col("idf"), 9)).withColumn("full", F.lit(0))
    before = Window.partitionBy("d", "code").orderBy(F.desc("key"), "node", "full").rowsBetween(Window.unboundedPreceding, -1)
    placed = freq.withColumn("full", F.lit(1)).unionByName(less).withColumn("above", F.coalesce(F.sum("full").over(before), F.lit(0))).where("full = 0")
    item = placed.select("d", "code", "node", "idf", "df", "units", F.col("key").alias("less"), "above").join(freq.select("d", "code", "node", "key"), ["d", "code", "node"])
    own = query.join(item, ["d", "code", "node"])
    stays = F.col("df") - 1 >= F.greatest(F.col("d"), F.lit(1))
    mate = own.select("d", "code", "unit", F.col("node").alias("other"), F.col("key").alias("other_key"), F.col("less").alias("other_less"), stays.alias("other_stays"))
    wins = lambda key: (F.col(key) > F.col("less")) | ((F.col(key) == F.col("less")) & (F.col("other") < F.col("node")))
    better = F.when(F.col("other_stays") & wins("other_less") & (F.col("other") != F.col("node")), 1).otherwise(0) - F.when(wins("other_key"), 1).otherwise(0)
    left = own.where(stays).join(mate, ["d", "code", "unit"]).groupBy("d", "code", "unit", "node", "idf", "df", "units", "above").agg(F.sum(better).alias("shift"))
    weight = profile.scaled(F.col("idf"), (F.col("df") - 1) / F.greatest(F.col("units") - 1, F.lit(1)), s.df_weight)
    mine = left.groupBy("d", "code", "unit").agg(F.array(*[F.sum(F.when(F.col("above") + F.col("shift") < k, weight)) for k in top_ks]).alias("mine"))
    cuts = F.explode(F.arrays_zip(F.array(*[F.lit(k) for k in top_ks]).alias("k"), F.coalesce("mine", F.array(*[F.lit(None).cast("double")] * len(top_ks))).alias("v")))
    units = query.select("d", "code", "unit").distinct().join(mine, ["d", "code", "unit"], "left").join(F.broadcast(codes), ["d", "code"])
    units = units.select("d", F.col("code").alias("own"), "unit", "nth", cuts.alias("c")).select("d", "c.k", "own", "unit", "nth", F.round(F.coalesce("c.v", F.lit(0.0)), 9).alias("mine"))

    others = query.withColumnRenamed("code", "own").join(weighted.select("d", "code", "node", "weight", "rank"), ["d", "node"]).where("own <> code")
    others = others.groupBy("d", "own", "unit", "code").agg(F.array(*[F.round(F.sum(F.when(F.col("rank") <= k, F.col("weight"))), 9) for k in top_ks]).alias("scores"))
    others = others.select("d", "own", "unit", "code", F.explode(F.arrays_zip(F.array(*[F.lit(k) for k in top_ks]).alias("k"), F.col("scores").alias("v"))).alias("c")).select("d", "c.k", "own", "unit", "code", F.col("c.v").alias("score")).where("score > 0")
    ahead = units.join(others, ["d", "k", "own", "unit"], "left").groupBy("d", "k", "own", "unit", "nth", "mine").agg(
        F.count("code").alias("good"),
        F.count_if((F.col("score") > F.col("mine")) | ((F.col("score") == F.col("mine")) & (F.col("code") < F.col("own")))).alias("ahead"),
        F.count_if(F.col("code") < F.col("own")).alias("good_below"),
        F.min(F.when(F.col("code").isNotNull(), F.struct((-F.col("score")).alias("neg"), "code"))).alias("best"),
    )
    # Without a score of its own, a code stands behind the positive ones, in the order of codes.
    place = F.when(F.col("mine") > 0, F.col("ahead") + 1).otherwise(F.col("good") + F.col("nth") - F.col("good_below"))
    first = codes.groupBy("d").agg(F.min("code").alias("first"))
    best = F.when(F.col("best").isNull() | (F.col("mine") > -F.col("best.neg")) | ((F.col("mine") == -F.col("best.neg")) & (F.col("own") < F.col("best.code"))), F.when(F.col("mine") > 0, F.col("own")).otherwise(F.col("first"))).otherwise(F.col("best.code"))
    return ahead.join(F.broadcast(first), "d").select(F.col("k").alias("top_k"), F.col("d").alias("min_df"), "own", "unit", place.cast("int").alias("place"), best.alias("predicted"))


def leave_one_out(nodes: DataFrame, s: Settings) -> DataFrame:
    """(own, unit, place, predicted) with the settings' own cuts; see `leave_one_out_cells`."""
    return leave_one_out_cells(nodes, s, (s.top_k,), (s.min_df,)).drop("top_k", "min_df")


def leave_one_out_summary(places: DataFrame, units: DataFrame, *by: str) -> DataFrame:
    """Top-1, Top-3, MRR and bias (units of the predicted code against the unit-weighted mean), of each value of `by`."""
    joined = places.join(F.broadcast(units.select(F.col("code").alias("predicted"), F.col("units").alias("n"))), "predicted")
    base = units.agg((F.sum(F.col("units") * F.col("units")) / F.sum("units")).alias("base"))
    return (
        joined.groupBy(*by).agg(
            F.count(F.lit(1)).alias("queries"),
            F.count_if(F.col("place") == 1).alias("top1"),
            F.count_if(F.col("place") <= 3).alias("top3"),
            F.round(F.avg(1 / F.col("place")), 6).alias("mrr"),
            F.avg("n").alias("mean_units"),
        )
        .join(F.broadcast(base), F.lit(True))
        .select(*by, "queries", "top1", "top3", "mrr", F.round(F.col("mean_units") / F.col("base"), 6).alias("bias"))
    )


def sweep(nodes: DataFrame, s: Settings, top_ks: tuple[int, ...] = (150, 300, 500), min_dfs: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Leave-one-out figures of every pair of cuts (top_k, min_df), from one pass."""
    kept = profile.gate(nodes, s).where("included").select("code", "units")
    return leave_one_out_summary(leave_one_out_cells(nodes, s, top_ks, min_dfs), kept, "top_k", "min_df")


def enough_nodes(users: DataFrame, least: int = 3) -> DataFrame:
    """The nodes (user, node) of users that have `least` or more: fewer are no query."""
    size = users.groupBy("user").agg(F.countDistinct("node").alias("n")).where(F.col("n") >= least)
    return users.join(size.select("user"), "user", "left_semi")


def cross_hits(ranked: DataFrame, queries: DataFrame, gold: DataFrame) -> DataFrame:
    """By job: queries, answered (a positive top score), Top-1 and Top-3 hits of the gold majors.

    `ranked` holds ranks up to 3 at least. `queries` (user, job) are those that count: take them from users that `enough_nodes` keeps.
    """
    hit = ranked.withColumn("major", F.substring("code", 1, 2)).join(gold.withColumn("good", F.lit(1)), ["job", "major"], "left")
    by_query = hit.groupBy("user").agg(
        F.max(F.when((F.col("rank") == 1) & (F.col("score") > 0), 1).otherwise(0)).alias("answered"),
        F.max(F.when((F.col("rank") == 1) & (F.col("good") == 1), 1).otherwise(0)).alias("top1"),
        F.max(F.when((F.col("rank") <= 3) & (F.col("good") == 1), 1).otherwise(0)).alias("top3"),
    )
    full = queries.join(by_query, "user", "left").fillna(0, ["answered", "top1", "top3"])
    return full.groupBy("job").agg(F.count(F.lit(1)).alias("queries"), F.sum("answered").alias("answered"), F.sum("top1").alias("top1"), F.sum("top3").alias("top3"))


def similarity_profile(best: DataFrame, over: float = 0.55) -> DataFrame:
    """(n, mean, median, over) of the best similarities (sentence, best) of a query set; sentences without any count as 0."""
    sim = F.coalesce("best", F.lit(0.0))
    return best.agg(F.count(F.lit(1)).alias("n"), F.avg(sim).alias("mean"), F.median(sim).alias("median"), F.avg((sim >= over).cast("double")).alias("over"))


def user_set(nodes: DataFrame, queries: DataFrame, profiles: DataFrame, gold: DataFrame) -> DataFrame:
    """By job: sentences, those that were read (have nodes), Top-1 and Top-3 hits of the gold majors.

    Each sentence (user, job) is one query with its nodes (user, node). Sentences that weren't read
    count among the queries only. Where no profile holds a sentence's nodes, codes rank by themselves.
    """
    read = nodes.select("user").distinct()
    best = topk.best_profiles(nodes, profiles, 3).select("user", "code", "rank")
    codes = profiles.select("code").distinct().withColumn("nth", F.row_number().over(Window.orderBy("code")))  # one row for each category
    # Ranks that no scored pair holds belong to the first codes that aren't scored for the sentence.
    first = read.join(F.broadcast(codes.where("nth <= 6").select("code")), F.lit(True)).join(best.select("user", "code"), ["user", "code"], "left_anti")
    free = read.withColumn("rank", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)]))).join(best.select("user", "rank"), ["user", "rank"], "left_anti")
    nth = lambda order: F.row_number().over(Window.partitionBy("user").orderBy(order))
    filled = free.withColumn("k", nth("rank")).join(first.withColumn("k", nth("code")), ["user", "k"]).select("user", "code", "rank")
    hit = best.unionByName(filled).withColumn("major", F.substring("code", 1, 2)).join(queries, "user").join(gold.withColumn("good", F.lit(1)), ["job", "major"], "left")
    by_query = hit.groupBy("user").agg(F.max(F.when((F.col("rank") == 1) & (F.col("good") == 1), 1).otherwise(0)).alias("top1"), F.max(F.when(F.col("good") == 1, 1).otherwise(0)).alias("top3"))
    full = queries.join(read.withColumn("answered", F.lit(1)), "user", "left").join(by_query, "user", "left").fillna(0, ["answered", "top1", "top3"])
    return full.groupBy("job").agg(F.count(F.lit(1)).alias("queries"), F.sum("answered").alias("answered"), F.sum("top1").alias("top1"), F.sum("top3").alias("top3"))
