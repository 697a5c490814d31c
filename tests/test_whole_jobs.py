"""Queries do their whole job: no user, pair or row is left out to make it smaller."""

import os

import pytest
from pyspark.sql import functions as F

from matchloom.plans import catalogue

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def test_subdivision_prefix_tells_small_overlaps(spark):
    """Each user has up to three finer profiles, those that share one node or none too."""
    found = catalogue.queries()["subdivision_prefix"](spark, FOLDER)
    assert found.where("overlap < 2").count() > 0


def test_cross_eval_asks_every_user(spark):
    """Each customer with an order is a query, whatever the number of nodes."""
    asked = catalogue.queries()["cross_eval_major"](spark, FOLDER).groupBy().sum("queries").first()[0]
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").join(spark.read.parquet(f"{FOLDER}/lineitem.parquet"), [F.col("o_orderkey") == F.col("l_orderkey")])
    assert asked == orders.select("o_custkey").distinct().count()


@pytest.mark.parametrize("name", ["section_bodies", "section_items", "l1_normalise"])
def test_parser_queries_use_all_cores(spark, name):
    """A part table of one small file is dealt over the cores before the long work on its rows."""
    plan = catalogue.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_have_lack_does_not_meet_whole_profiles(spark):
    """No row of a target and an item that the user lacks goes to an exchange: what lacks comes from places."""
    from matchloom.operators import matching

    users = spark.createDataFrame([(1, "n3"), (1, "n5"), (2, "zz")], "user long, node string")
    profiles = spark.createDataFrame([("a", f"n{i}", 0.5, 100 - i) for i in range(50)], "code string, node string, weight double, full_df long")
    targets = spark.createDataFrame([(1, "a"), (2, "a"), (3, "none")], "user long, code string")
    found = matching.have_lack(users, targets, profiles, lack_limit=4)
    got = sorted((r.user, r.side, r.place, r.node) for r in found.collect())
    assert got == [(1, "have", 1, "n3"), (1, "have", 2, "n5")] + [(1, "lack", k + 1, n) for k, n in enumerate(("n0", "n1", "n2", "n4"))] + [(2, "lack", k + 1, f"n{k}") for k in range(4)]
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_subdivisions_count_shared_nodes_only(spark):
    """Users and finer items meet by prefix and node, not all nodes of a prefix with each user."""
    from matchloom.operators import matching

    users = spark.createDataFrame([(1, "x"), (1, "y"), (2, "q")], "user long, node string")
    fine = spark.createDataFrame([("000101", "x", 9), ("000101", "y", 9), ("000102", "x", 4), ("000201", "x", 7)], "code string, node string, units long")
    targets = spark.createDataFrame([(1, "0001"), (2, "0001")], "user long, code string")
    found = matching.subdivisions(users, targets, fine, min_overlap=0)
    assert sorted((r.user, r.place, r.code, r.overlap) for r in found.collect()) == [(1, 1, "000101", 2), (1, 2, "000102", 1), (2, 1, "000101", 0), (2, 2, "000102", 0)]
    assert "LeftOuter" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_of_users_equal_single_users():
    """Scores of blocks are those of one user after another, with codes that take no rank."""
    import random

    import pyarrow as pa

    from matchloom.operators import topk

    rng = random.Random(3)
    index = topk.Index(*zip(*[(f"{c:03d}", f"n{n}", rng.choice((0.0, 0.25, rng.random()))) for c in range(40) for n in rng.sample(range(90), 20)]))
    nodes = [list({f"n{rng.randrange(99)}" for _ in range(rng.choice((0, 1, 30)))}) for _ in range(200)]
    out = [rng.sample(index.codes, rng.choice((0, 2))) for _ in nodes]
    got = [[] for _ in nodes]
    for row, code, score, overlap, rank in index.best_of_all(pa.array(nodes, pa.list_(pa.string())), 7, pa.array(out, pa.list_(pa.string()))):
        for r, c, s, o, k in zip(row, code, score, overlap, rank):
            got[r].append((index.codes[c], round(s, 9), o, k))
    assert [sorted(g) for g in got] == [sorted((c, round(s, 9), o, k) for c, s, o, k in index.best(n, 7, x)[0]) for n, x in zip(nodes, out)]
