"""The best profiles by upper bounds, against the ranks of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import matching, topk


def matrix(rng, codes=60, nodes=300, items=40):
    rows = []
    for c in range(codes):
        for n in rng.sample(range(nodes), items):
            rows.append((f"{c:04d}", f"n{n}", rng.choice((0.0, round(rng.random() ** 6 * 4, 3), 0.5))))
    return rows


def plain(rows, nodes, k, out):
    codes = sorted({c for c, _, _ in rows})
    score = {c: round(sum(w for d, n, w in rows if d == c and n in nodes), 9) for c in codes}
    overlap = {c: sum(d == c and n in nodes for d, n, _ in rows) for c in codes}
    order = sorted((c for c in codes if c not in out), key=lambda c: (-score[c], c))
    return [(c, score[c], overlap[c], i + 1) for i, c in enumerate(order[:k]) if overlap[c]]


def test_index_equals_all_pairs():
    """Same rows as scoring every pair, and fewer pairs scored to the end."""
    rng = random.Random(1)
    rows = matrix(rng)
    index = topk.Index(*zip(*rows))
    scored = touched = 0
    for _ in range(400):
        nodes = {f"n{rng.randrange(320)}" for _ in range(rng.choice((0, 1, 5, 60)))}
        out = rng.sample(index.codes, rng.choice((0, 0, 3)))
        k = rng.choice((1, 3, 20, 100))
        got, n = index.best(list(nodes), k, out)
        want = plain(rows, nodes, k, out)
        assert [(c, round(s, 9), o, r) for c, s, o, r in sorted(got, key=lambda x: x[3])] == want
        if k < 20:
            scored += n
            touched += len({c for c, x, _ in rows if x in nodes and c not in out})
    assert scored < 0.5 * touched


@pytest.mark.parametrize("rows", [topk.MATRIX_ROWS, 100])
def test_best_profiles(spark, rows):
    """As `ranked`, from the index and, where the matrix is too large for it, from joins."""
    rng = random.Random(2)
    profiles = spark.createDataFrame(matrix(rng, 30, 100, 20), "code string, node string, weight double")
    users = spark.createDataFrame([(u, f"n{rng.randrange(130)}") for u in range(50) for _ in range(rng.choice((1, 4, 30)))] + [(99, "nowhere")], "user long, node string")
    exclude = spark.createDataFrame([(u, f"{rng.randrange(30):04d}") for u in range(0, 60, 2)], "user long, code string")
    show = lambda df: sorted((r.user, r["rank"], r.code, round(r.score, 9), r.overlap) for r in df.collect())
    for gone in (None, exclude):
        want = show(matching.ranked(matching.scores(users, profiles), profiles, gone).where("rank <= 7"))
        assert show(topk.best_profiles(users, profiles, 7, gone, matrix_rows=rows)) == want
    assert topk.best_profiles(users, profiles.where("false"), 3).count() == 0


@pytest.mark.parametrize("few", [topk.FEW_CODES, 0])
@pytest.mark.parametrize("mine, theirs", [("int", "int"), ("long", "int"), ("int", "long"), ("string", "string")])
def test_nodes_of_any_type(spark, monkeypatch, few, mine, theirs):
    """Nodes that are numbers, also of another width in the profiles, and codes that a user takes no rank for."""
    monkeypatch.setattr(topk, "FEW_CODES", few)
    rng = random.Random(3)
    rows = [(f"{c:04d}", n, round(rng.random(), 3)) for c in range(12) for n in rng.sample(range(20), 6)]
    profiles = spark.createDataFrame(rows + [("0099", 2**40 if theirs == "long" else 50, 1.0)], "code string, node long, weight double").withColumn("node", F.col("node").cast(theirs))
    users = spark.createDataFrame([(u, rng.randrange(30)) for u in range(20) for _ in range(4)], "user long, node long").withColumn("node", F.col("node").cast(mine))
    exclude = spark.createDataFrame([(u, f"{u % 12:04d}") for u in range(0, 20, 3)], "user long, code string")
    show = lambda df: sorted((r.user, r["rank"], r.code, round(r.score, 9), r.overlap) for r in df.collect())
    for gone in (None, exclude):
        want = show(matching.ranked(matching.scores(users, profiles), profiles, gone).where("rank <= 5"))
        assert want and show(topk.best_profiles(users, profiles, 5, gone)) == want
