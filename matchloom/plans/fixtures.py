"""Profile-matching inputs derived from the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.operators import profile
from matchloom.settings import Settings
from matchloom.sources import store

#: Postings are judged as of this day.
AS_OF = "2001-07-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """A table dealt over all cores by its key: a small file is read in a task or two, however long the work on a row takes."""
    return table(spark, d, name).repartition(spark.sparkContext.defaultParallelism * 4, key)


def codes(spark: SparkSession, d: str) -> DataFrame:
    """(c_custkey, code): region, nation and segment as six digits."""
    customer = table(spark, d, "customer")
    segments = customer.select("c_mktsegment").distinct().withColumn("s", F.lpad(F.dense_rank().over(Window.orderBy("c_mktsegment")).cast("string"), 2, "0"))  # a handful of segments
    nation = table(spark, d, "nation")
    joined = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(segments), "c_mktsegment")
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    return joined.select("c_custkey", F.concat(two("n_regionkey"), two("n_nationkey"), F.col("s")).alias("code"))


def once(spark: SparkSession, d: str, name: str, build, *by: str, lies: bool = False) -> DataFrame:
    """A table derived from the order tables, kept while these stay as they are."""
    return store.once(spark, [f"{d}/{t}.parquet" for t in ("customer", "nation", "orders", "lineitem", "part")], name, build, *by, lies=lies)


def unit_items(spark: SparkSession, d: str) -> DataFrame:
    """(code, unit, inst, item, node): orders are units, customers institutions, parts items, brand and name nodes."""
    return once(spark, d, "items", lambda: _items(spark, d), "unit", lies=True)


def user_items(spark: SparkSession, d: str) -> DataFrame:
    """(code, inst, node), each once, by institution: what `users` and `home` take without an exchange."""
    return once(spark, d, "user items", lambda: store.dealt(unit_items(spark, d).select("code", "inst", "node"), "inst").distinct(), "inst", lies=True)


def fine_items(spark: SparkSession, d: str) -> DataFrame:
    """(code, node, units) of all six-digit codes, by node."""

    def build() -> DataFrame:
        items = unit_items(spark, d)
        units = items.select("code", "unit").distinct().groupBy("code").agg(F.count(F.lit(1)).alias("units"))
        return items.select("code", "node").distinct().join(F.broadcast(units), "code")  # one row for each category

    return once(spark, d, "fine items", build, "node")


def nodes(spark: SparkSession, d: str, s: Settings) -> DataFrame:
    """The node table of the settings, by unit: units are many and even, codes are few and one may hold a third of all rows."""
    return once(spark, d, f"nodes {s.level} {s.min_nodes}", lambda: profile.unit_nodes(unit_items(spark, d), s), "unit", lies=True)


def profiles(spark: SparkSession, d: str, s: Settings) -> DataFrame:
    """The profiles of the settings, by node."""
    return once(spark, d, f"profiles {s}", lambda: profile.profile_items(nodes(spark, d, s), s), "node")


def evidence(spark: SparkSession, d: str, s: Settings) -> DataFrame:
    """The evidence of all profile items, by node."""
    return once(spark, d, f"evidence {s}", lambda: profile.evidence(unit_items(spark, d), profiles(spark, d, s), s), "node")


def _items(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(codes(spark, d), F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_name").alias("node"))
    named = store.dealt(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_partkey", "node"), "l_orderkey")
    owned = store.dealt(orders.select("o_orderkey", "o_custkey", "code"), "o_orderkey")
    return named.join(owned, F.col("l_orderkey") == F.col("o_orderkey")).select("code", F.col("l_orderkey").alias("unit"), F.col("o_custkey").alias("inst"), F.col("l_partkey").alias("item"), "node")


def users(items: DataFrame) -> DataFrame:
    """(user, node): every customer with the nodes of their orders."""
    return items.select(F.col("inst").alias("user"), "node").distinct()


def home(items: DataFrame, level: int = 6) -> DataFrame:
    """(user, code): the customer's own code."""
    return items.select(F.col("inst").alias("user"), F.substring("code", 1, level).alias("code")).distinct()


def postings(spark: SparkSession, d: str) -> DataFrame:
    """(posting, owner, days_left, fit, rate): orders as postings; coverage from discounts, fit from quantities."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg("l_discount") * 10, 6).alias("rate"), F.round(F.avg("l_quantity") / 50, 6).alias("fit"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("posting"), F.col("o_custkey").alias("owner"), F.to_date("o_orderdate").alias("deadline"))
    joined = orders.join(lines, F.col("posting") == F.col("l_orderkey"))
    return joined.select("posting", "owner", F.date_diff("deadline", F.lit(AS_OF).cast("date")).alias("days_left"), "fit", F.least("rate", F.lit(1.0)).alias("rate"))


CODES_SQL = """
seg AS (SELECT c_mktsegment AS m, lpad(CAST(dense_rank() OVER (ORDER BY c_mktsegment) AS VARCHAR), 2, '0') AS s FROM (SELECT DISTINCT c_mktsegment FROM customer)),
codes AS (SELECT c_custkey, lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || s AS code
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN seg ON c_mktsegment = m)
"""
ITEMS_SQL = CODES_SQL + """,
items AS (SELECT code, l_orderkey AS unit, o_custkey AS inst, l_partkey AS item, p_brand || '|' || p_name AS node
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN codes ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)
"""
POSTINGS_SQL = f"""
ls AS (SELECT l_orderkey, round(avg(l_discount) * 10, 6) AS rate, round(avg(l_quantity) / 50, 6) AS fit FROM lineitem GROUP BY 1),
postings AS (SELECT o_orderkey AS posting, o_custkey AS owner, date_diff('day', DATE '{AS_OF}', CAST(o_orderdate AS DATE)) AS days_left, fit, least(rate, 1.0) AS rate
  FROM orders JOIN ls ON o_orderkey = l_orderkey)
"""


def nodes_sql(level: int = 6, min_nodes: int = 3) -> str:
    return ITEMS_SQL + f""",
pairs AS (SELECT DISTINCT left(code, {level}) AS code, unit, inst, node FROM items WHERE length(code) >= {level}),
nodes AS (SELECT * FROM pairs SEMI JOIN (SELECT code, unit, inst FROM pairs GROUP BY ALL HAVING count(*) >= {min_nodes}) USING (code, unit, inst)),
units AS (SELECT DISTINCT code, unit, inst FROM nodes)
"""


def gate_sql(level: int = 6, least: float = 70.0, hhi: float = 0.12) -> str:
    return nodes_sql(level) + f""",
per AS (SELECT code, inst, count(*) AS n FROM units GROUP BY ALL),
gate AS (SELECT code, CAST(sum(n) AS BIGINT) AS units, count(*) AS institutions, CAST(sum(least(n, 8)) AS BIGINT) AS effective_units,
   sum(n * n) / CAST(sum(n) * sum(n) AS DOUBLE) AS hhi, max(n) / CAST(sum(n) AS DOUBLE) AS top_share, arg_min(inst, (-n, inst)) AS top_inst FROM per GROUP BY code),
kept AS (SELECT code, units FROM gate WHERE effective_units >= {least} AND hhi < {hhi})
"""


def profile_sql(level: int = 6, least: float = 70.0, hhi: float = 0.12, top_k: int = 300, sampled: bool = True, min_df: int = 1) -> str:
    sample = """
used AS (SELECT n.* FROM nodes n JOIN kept USING (code) SEMI JOIN (
  SELECT code, unit, inst, row_number() OVER (PARTITION BY code ORDER BY turn, inst) AS place FROM (
    SELECT code, unit, inst, row_number() OVER (PARTITION BY code, inst ORDER BY unit) AS turn FROM units JOIN kept USING (code)) QUALIFY place <= 60) s USING (code, unit, inst))
""" if sampled else "used AS (SELECT n.* FROM nodes n JOIN kept USING (code))"
    return gate_sql(level, least, hhi) + f""", {sample},
df AS (SELECT code, node, count(*) AS df FROM used GROUP BY ALL HAVING count(*) >= {min_df}),
ful AS (SELECT code, node, count(*) AS full_df FROM nodes JOIN kept USING (code) GROUP BY ALL),
app AS (SELECT node, count(*) AS appear FROM df GROUP BY ALL),
freq AS (SELECT code, node, df, full_df, units, appear, ln((SELECT greatest(count(*), 1) FROM kept) / appear) AS idf
  FROM df JOIN ful USING (code, node) JOIN app USING (node) JOIN kept USING (code)),
prof AS (SELECT code, node, df, full_df, units, idf, rank, idf * sqrt(full_df / units) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY round(df * idf, 9) DESC, node) AS rank FROM freq) WHERE rank <= {top_k})
"""


def scores_sql(**options) -> str:
    """Every user with every profile, scores of 0 included: the definition of the ranks."""
    return profile_sql(**options) + """,
us AS (SELECT DISTINCT inst AS usr, node FROM items),
hit AS (SELECT usr, code, sum(weight) AS score, count(*) AS overlap FROM us JOIN prof USING (node) GROUP BY ALL),
sc AS (SELECT usr, code, coalesce(score, 0) AS score, coalesce(overlap, 0) AS overlap FROM (SELECT DISTINCT usr FROM us) CROSS JOIN (SELECT DISTINCT code FROM prof) LEFT JOIN hit USING (usr, code)),
rk AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY round(score, 9) DESC, code) AS rank FROM sc)
"""
