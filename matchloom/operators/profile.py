"""Profile build: gate, stratified sample, frequencies, weights and the evidence index.

All operators work on the long table unit_items(code, unit, inst, item, node). What several steps read
(nodes, profiles, evidence) is best stored between them, bucketed (sources/store.py), as the queries do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.settings import Settings


#: Rows of a table beside the large one that may be sent to every task.
SMALL_ROWS = 1 << 18


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Sent to every task where its size, which is checked, allows that: then the large side of a join stays where it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def at_level(items: DataFrame, level: int) -> DataFrame:
    """Keep rows whose code is long enough and cut it to the level's prefix."""
    return items.where(F.length("code") >= level).withColumn("code", F.substring("code", 1, level))


def fold(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace items by their node of mapping (item, node); items without one are their own node."""
    return items.drop("node").join(mapping, "item", "left").withColumn("node", F.coalesce("node", F.col("item").cast("string")))


def unit_nodes(items: DataFrame, s: Settings) -> DataFrame:
    """Distinct (code, unit, inst, node) of the units that hold enough nodes."""
    pairs = at_level(items, s.level).select("code", "unit", "inst", "node").distinct()
    size = F.count(F.lit(1)).over(Window.partitionBy("code", "unit", "inst"))  # a unit's own nodes
    return pairs.withColumn("n_nodes", size).where(F.col("n_nodes") >= s.min_nodes).drop("n_nodes")


def concentration(units: DataFrame, s: Settings) -> DataFrame:
    """By code: units, effective units (each institution up to the cap), HHI, largest share and its institution."""
    by_inst = units.select("code", "unit", "inst").distinct().groupBy("code", "inst").agg(F.count(F.lit(1)).alias("n"))
    by_code = by_inst.groupBy("code").agg(
        F.sum("n").alias("units"),
        F.count(F.lit(1)).alias("institutions"),
        F.sum(F.least("n", F.lit(s.institution_cap))).alias("effective_units"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.max(F.struct("n", (-F.col("inst")).alias("neg"))).alias("top"),
    )
    return by_code.select(
        "code",
        "units",
        "institutions",
        "effective_units",
        (F.col("squares") / (F.col("units") * F.col("units"))).alias("hhi"),
        (F.col("top.n") / F.col("units")).alias("top_share"),
        (-F.col("top.neg")).alias("top_inst"),
    )


def gate(units: DataFrame, s: Settings) -> DataFrame:
    """Concentration of each code and whether it is included; with min_units (fine codes) the number of units alone decides."""
    enough = (F.col("effective_units") >= s.min_effective_units) & (F.col("hhi") < s.max_hhi) if s.min_units is None else F.col("units") >= s.min_units
    return concentration(units, s).withColumn("included", enough)


def sample_units(units: DataFrame, s: Settings) -> DataFrame:
    """Round robin over institutions: the i-th unit of each in turn, until the cap."""
    one = units.select("code", "unit", "inst").distinct()
    turn = one.withColumn("turn", F.row_number().over(Window.partitionBy("code", "inst").orderBy("unit"))).where(F.col("turn") <= s.profile_unit_cap)  # a place is no less than the turn
    place = turn.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("turn", "inst")))
    return place.where(F.col("place") <= s.profile_unit_cap)


def scaled(idf: Column, rate: Column, mode: str) -> Column:
    """Weight of an item from its IDF and its share of the code's units."""
    return {"none": idf, "rate": idf * rate, "sqrt": idf * F.sqrt(rate), "log": idf * F.log(1 + 10 * rate)}[mode]


def frequencies(nodes: DataFrame, s: Settings, sampled: bool = True) -> DataFrame:
    """(code, node, df, full_df, units, appear, idf): df over the sample, full_df and units over all."""
    kept = gate(nodes, s).where("included").select("code", "units")
    inside = nodes.join(F.broadcast(kept), "code")  # one row for each category
    full = inside.groupBy("code", "node", "units").agg(F.count(F.lit(1)).alias("full_df"))
    used = inside.join(small(sample_units(inside, s).select("code", "unit", "inst")), ["code", "unit", "inst"], "left_semi") if sampled else inside
    df = used.groupBy("code", "node").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= s.min_df)
    appear = df.groupBy("node").agg(F.count(F.lit(1)).alias("appear"))
    jobs = kept.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("jobs"))
    return df.join(full, ["code", "node"]).join(appear, "node").crossJoin(F.broadcast(jobs)).withColumn("idf", F.log(F.col("jobs") / F.col("appear"))).drop("jobs")


def profile_items(nodes: DataFrame, s: Settings, sampled: bool = True) -> DataFrame:
    """(code, node, rank, df, full_df, units, idf, weight): the top items of each code by df * idf."""
    freq = frequencies(nodes, s, sampled).withColumn("key", F.round(F.col("df") * F.col("idf"), 9))
    ranked = freq.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("key"), "node"))).where(F.col("rank") <= s.top_k)
    return ranked.withColumn("weight", scaled(F.col("idf"), F.col("full_df") / F.col("units"), s.df_weight)).drop("key")


def evidence(items: DataFrame, profiles: DataFrame, s: Settings, top: int = 3) -> DataFrame:
    """(code, node, text, n, rank, doc_ids): the most frequent raw items behind each profile item.

    Counts are of occurrences; ties go to the item seen first; up to three source units, sorted.
    """
    raw = at_level(items, s.level).select("code", "node", "item", "unit").join(small(profiles.select("code", "node")), ["code", "node"], "left_semi")
    raw = raw.repartition("code", "node", "item")  # the one exchange of all occurrences: counts and sources need no other
    counted = raw.groupBy("code", "node", "item").agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("first_unit"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("code", "node").orderBy(F.desc("n"), "first_unit", "item"))).where(F.col("rank") <= top)
    first = raw.distinct().withColumn("k", F.row_number().over(Window.partitionBy("code", "node", "item").orderBy("unit"))).where("k <= 3")
    docs = first.groupBy("code", "node", "item").agg(F.sort_array(F.collect_list("unit")).alias("doc_ids"))
    return ranked.join(docs, ["code", "node", "item"]).select("code", "node", F.col("item").alias("text"), "n", "rank", "doc_ids")


def hierarchy(nodes: DataFrame) -> DataFrame:
    """Units and distinct nodes by code prefix of two, four and six digits and in total (an extension: ROLLUP)."""
    cut = nodes.select(F.substring("code", 1, 2).alias("c2"), F.substring("code", 1, 4).alias("c4"), F.substring("code", 1, 6).alias("c6"), "unit", "node")
    return cut.rollup("c2", "c4", "c6").agg(F.countDistinct("unit").alias("units"), F.countDistinct("node").alias("nodes"))
