"""Posting corpora: merging, first-seen dedupe, boilerplate, classification, tiers, extensions and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import text as X


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first by `order`."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def merged(sources: DataFrame, *ties: str) -> DataFrame:
    """One text of each seq: an ocr text overrides, else the longest; the source name, then `ties`, break ties."""
    order = Window.partitionBy("seq").orderBy(F.when(F.col("src") == "ocr", 0).otherwise(1), F.desc("len"), "src", *ties)
    return sources.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def boilerplate(docs: DataFrame, min_docs: int = 3, share: float = 0.5, longest: int = 60) -> DataFrame:
    """(dom, line) of short lines that stand in at least `share` of a domain's documents."""
    lines = docs.select("dom", "doc", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.btrim("line")).where((F.length("line") > 0) & (F.length("line") < longest)).distinct()
    size = docs.groupBy("dom").agg(F.countDistinct("doc").alias("docs")).where(F.col("docs") >= min_docs)
    return lines.groupBy("dom", "line").agg(F.count(F.lit(1)).alias("n")).join(size, "dom").where(F.col("n") >= share * F.col("docs")).select("dom", "line", "n", "docs")


def stripped(docs: DataFrame, boiler: DataFrame) -> DataFrame:
    """Documents without their domain's boilerplate lines, put together again in order."""
    lines = docs.select("dom", "doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    kept = lines.withColumn("key", F.btrim("line")).join(boiler.select("dom", F.col("line").alias("key")), ["dom", "key"], "left_anti")
    text = kept.groupBy("dom", "doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n").alias("clean"))  # a document's own lines
    return docs.select("dom", "doc").join(text, ["dom", "doc"], "left").withColumn("clean", F.coalesce("clean", F.lit("")))


def classify(docs: DataFrame, rules: tuple[tuple[str, tuple[str, ...]], ...], none: str, body_chars: int | None = 4000) -> DataFrame:
    """The job with the highest score: ten for each keyword in the title, one in the body; the first rule of equals; under two none.

    The body is read to `body_chars` (None: whole). Single words are looked up among all that one
    pass over the text finds; other keywords are searched one by one.
    """
    body = F.col("text") if body_chars is None else F.left("text", F.lit(body_chars))
    single = sorted({w for _, words in rules for w in words if X.is_word(w)})
    docs = docs.withColumns({"in_title": X.words_in(F.col("title"), single), "in_body": X.words_in(body, single)})

    def score(words: tuple[str, ...]) -> Column:
        there = lambda text, found, w: (F.array_contains(found, F.lit(w)) if w in single else X.mentions(text, w)).cast("int")
        return sum([10 * there(F.col("title"), "in_title", w) + there(body, "in_body", w) for w in words], F.lit(0))

    cases = F.array(*[F.struct(score(words).alias("score"), F.lit(-i).alias("neg"), F.lit(name).alias("job")) for i, (name, words) in enumerate(rules)])
    best = F.array_max(cases)
    return docs.withColumn("best", best).select("doc", F.when(F.col("best.score") >= 2, F.col("best.job")).otherwise(none).alias("job"), F.col("best.score").alias("score"))


def tier(docs: DataFrame, techs: tuple[str, ...], expressions: tuple[str, ...], groups: tuple[str, ...]) -> DataFrame:
    """A: concrete skills; B: requirements; C: neither, or a group title with little else."""
    n_tech = sum([X.mentions(F.col("text"), t).cast("int") for t in techs], F.lit(0))
    n_expr = X.count_contained(F.col("text"), expressions)
    group = X.count_contained(F.col("title"), groups) > 0
    with_counts = docs.select("doc", n_tech.alias("n_tech"), n_expr.alias("n_expr"), group.alias("group"))
    grade = F.when(F.col("group") & (F.col("n_tech") < 2) & (F.col("n_expr") < 5), "C").when((F.col("n_tech") >= 2) | (F.col("n_expr") >= 6), "A").when(F.col("n_expr") >= 3, "B").otherwise("C")
    return with_counts.withColumn("tier", grade)


def term_counts(docs: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """(term, docs): documents that mention each term, each counted once."""
    row = docs.agg(*[F.sum(X.mentions(F.col("text"), t).cast("long")).alias(f"t{i}") for i, t in enumerate(terms)])
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.coalesce(F.col(f"t{i}"), F.lit(0)).alias("docs")) for i, t in enumerate(terms)])
    return row.select(F.explode(pairs).alias("x")).select("x.term", "x.docs")


def candidates(terms: DataFrame) -> DataFrame:
    """(term, df, corps, examples) of (doc, corp, term): documents, distinct sources, the first three by doc."""
    once = terms.select("doc", "corp", "term").distinct()
    ranked = once.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy("doc")))
    return ranked.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.countDistinct("corp").alias("corps"), F.sort_array(F.collect_list(F.when(F.col("k") <= 3, F.col("doc")))).alias("examples"))


def renamed(terms: DataFrame, alias: DataFrame) -> DataFrame:
    """Terms under their canonical names, from alias (low, name) by lower-case form; others keep theirs."""
    known = alias.select("low", "name").dropDuplicates(["low"])
    return terms.join(known, F.lower("term") == F.col("low"), "left").withColumn("term", F.coalesce("name", "term")).drop("low", "name")


def attrition(found: DataFrame, known: DataFrame, blocked: tuple[str, ...], min_df: int, min_corps: int) -> DataFrame:
    """Each candidate's first failed rule: rare, narrow, known, blocked; or kept."""
    marked = found.join(known.select(F.col("term"), F.lit(1).alias("known")).distinct(), "term", "left")
    reason = F.when(F.col("df") < min_df, "rare").when(F.col("corps") < min_corps, "narrow").when(F.col("known") == 1, "known").when(F.lower("term").isin(*blocked), "blocked").otherwise("kept")
    return marked.withColumn("reason", reason).drop("known")


def drift(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, change): what is new and what is gone."""
    new = now.select(key).distinct().join(before.select(key), key, "left_anti").withColumn("change", F.lit("new"))
    gone = before.select(key).distinct().join(now.select(key), key, "left_anti").withColumn("change", F.lit("gone"))
    return new.unionByName(gone)


def interleaved(rows: DataFrame, have: DataFrame, most: int) -> DataFrame:
    """Queue over (cat, inst, pos): categories take turns in order of first sight; inside one, institutions with fewest held rows drain first.

    `have` (cat, inst, have) are the rows held of each institution in a category. Institutions with
    `most` or more there are passed over, and don't count for the order of categories either.
    """
    held = rows.join(have, ["cat", "inst"], "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("have") < most)
    turn = held.withColumn("turn", F.row_number().over(Window.partitionBy("cat").orderBy("have", "inst", "pos")))
    seen = turn.withColumn("seen", F.min("pos").over(Window.partitionBy("cat")))
    # The queue is an order, not a number: sort by these columns to read it.
    return seen.select("cat", "inst", "pos", "turn", "seen")


def within_budget(rows: DataFrame, group: str, order: str, cost: str, budget: float) -> DataFrame:
    """The prefix of each group whose running cost stays within the budget."""
    run = F.sum(cost).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("spent", run).where(F.col("spent") <= budget)


def market(nodes: DataFrame, noisy: str) -> DataFrame:
    """Per node the first example of each corp, at most three, with noisy roles blank."""
    one = first_seen(nodes, ["node", "corp"], ["doc"])
    top = one.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("doc"))).where("k <= 3")
    return top.withColumn("role", F.when(F.col("role").rlike(noisy), "").otherwise(F.col("role"))).select("node", "k", "corp", "role", "doc")


def best_context(live: DataFrame, contexts: DataFrame) -> DataFrame:
    """Of each live posting's contexts (same url) the best: role in title with skills, skills, role in title, first.

    Contexts and postings never meet as pairs. What needs no title (the first of an url's contexts, with
    and without skills) is a row for each url. A role in a title has its first three letters
    there, so roles, each once, are looked up by these among the title's; only those are searched.
    """
    rows = contexts.select("url", "ctx", F.lower("role").alias("role"), F.coalesce(F.col("skills") > 0, F.lit(False)).alias("skilled"))
    of_url = rows.groupBy("url").agg(*[F.min(F.when(c, F.col("ctx"))).alias(n) for n, c in (("skilled", F.col("skilled")), ("first", F.lit(True)), ("blank_skilled", F.col("skilled") & (F.col("role") == "")), ("blank", F.col("role") == ""))])
    roles = rows.where("role <> ''").groupBy("url", "role", "skilled").agg(F.min("ctx").alias("ctx")).withColumn("g", F.least(F.length("role"), F.lit(3)))
    roles = roles.withColumn("gram", F.substring("role", 1, 3))
    titles = live.select("url", "posting", F.lower("title").alias("title"))

    def pieces(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("title") - k + 1, F.lit(1))), lambda i: F.struct(F.lit(k).alias("g"), F.substr("title", i, F.lit(k)).alias("gram")))

    sizes = F.array(*[pieces(k) for k in (1, 2, 3)])
    grams = titles.where("title <> ''").select("url", "posting", "title", F.explode(F.array_distinct(F.flatten(sizes))).alias("x")).select("url", "posting", "title", "x.g", "x.gram")
    inside = grams.join(roles, ["url", "g", "gram"]).where(F.contains("title", F.col("role"))).groupBy("posting").agg(F.min(F.struct(F.when(F.col("skilled"), 0).otherwise(2).alias("rule"), "ctx")).alias("inside"))
    rule = lambda n, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(n).alias("rule"), F.col(c).alias("ctx")))
    has_title = F.col("title").isNotNull()
    found = titles.join(of_url, "url").join(inside, "posting", "left")
    best = F.least(F.col("inside"), F.when(has_title, rule(0, "blank_skilled")), rule(1, "skilled"), F.when(has_title, rule(2, "blank")), rule(3, "first"))
    return found.select("posting", best.alias("b")).select("posting", "b.ctx", "b.rule")
