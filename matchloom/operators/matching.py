"""Matching users (user, node) with profiles: scores, have and lack, gaps, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.profile import small
from matchloom.settings import Settings


def scores(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """(user, code, score, overlap) for every user and profile that share a node; weight 0 still overlaps."""
    hits = users.select("user", "node").distinct().join(profiles.select("code", "node", "weight"), "node")
    return hits.groupBy("user", "code").agg(F.sum("weight").alias("score"), F.count(F.lit(1)).alias("overlap"))


def scores_of_all(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """(user, code, score, overlap) of a stated set of users with every profile, those without a shared node too."""
    every = users.select("user").distinct().join(profiles.select("code").distinct(), F.lit(True))
    found = every.join(scores(users, profiles), ["user", "code"], "left")
    return found.select("user", "code", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("overlap", F.lit(0)).alias("overlap"))


def ranked(scored: DataFrame, profiles: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Rank of each scored pair among all profiles: score descending, then code; those that aren't here have score 0.

    Pairs of `exclude` (user, code) take no rank. Profiles without a shared node need no row: a
    score of 0 ranks behind all positive ones by the code's place among the codes that aren't positive.
    """
    codes = profiles.select("code").distinct().withColumn("nth", F.row_number().over(Window.orderBy("code")))  # one row for each category
    rows = scored.withColumn("out", F.lit(0))
    if exclude is not None:
        gone = exclude.select("user", "code").distinct().withColumn("out", F.lit(1))
        rows = scored.join(gone.drop("out"), ["user", "code"], "left_anti").withColumn("out", F.lit(0)).unionByName(gone, allowMissingColumns=True)
    rows = rows.join(F.broadcast(codes), "code").withColumn("key", F.round("score", 9)).withColumn("good", (F.coalesce("key", F.lit(0.0)) > 0).cast("int"))
    before = Window.partitionBy("user").orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("passed", F.coalesce(F.sum(F.col("good") + F.col("out")).over(before), F.lit(0)))
    rows = rows.withColumn("all_good", F.sum("good").over(Window.partitionBy("user")))
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("good"), F.desc("key"), "code"))
    rank = F.when(F.col("good") == 1, F.col("place")).otherwise(F.col("all_good") + F.col("nth") - F.col("passed"))
    return rows.withColumn("place", place).withColumn("rank", rank.cast("int")).where("out = 0").drop("out", "nth", "key", "good", "passed", "all_good", "place")


def reverse(users: DataFrame, profiles: DataFrame, limit: int = 5, min_overlap: int = 2, exclude: DataFrame | None = None) -> DataFrame:
    """The best profiles of each user: rank limit * 4, keep those with enough overlap, take limit.

    `exclude` (user, code) leaves pairs out before ranking. The pre-limit comes before the filter.
    """
    from matchloom.operators.topk import best_profiles

    first = best_profiles(users, profiles, limit * 4, exclude).where(F.col("overlap") >= min_overlap)
    again = Window.partitionBy("user").orderBy("rank")
    return first.withColumn("place", F.row_number().over(again)).where(F.col("place") <= limit)


def unexpected(users: DataFrame, profiles: DataFrame, seen: DataFrame, limit: int = 3, min_overlap: int = 2) -> DataFrame:
    """Profiles of majors (two digits) that the user has not seen; limit * 32 ranked before the filters."""
    from matchloom.operators.topk import best_profiles

    wide = best_profiles(users, profiles, limit * 8 * 4).where(F.col("overlap") >= min_overlap)
    cut = wide.withColumn("k", F.row_number().over(Window.partitionBy("user").orderBy("rank"))).where(F.col("k") <= limit * 8)
    other = cut.withColumn("major", F.substring("code", 1, 2)).join(seen, ["user", "major"], "left_anti")
    return other.withColumn("place", F.row_number().over(Window.partitionBy("user").orderBy("rank"))).where(F.col("place") <= limit)


def proved(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """The grounding rule: only pairs (code, node) that the evidence index can quote."""
    return pairs.join(small(evidence.select("code", "node").distinct()), ["code", "node"], "left_semi")


def quotes(pairs: DataFrame, evidence: DataFrame, limit: int = 2, coarse: int = 6) -> DataFrame:
    """(code, node, source, k, text, n) of each pair: its own quotes, else those of the code's prefix of `coarse` digits."""
    asked = pairs.select("code", "node").distinct()
    rows = evidence.select("code", "node", "rank", "text", "n")
    own = asked.join(rows, ["code", "node"]).withColumn("source", F.lit("own"))
    rest = asked.join(own.select("code", "node"), ["code", "node"], "left_anti").where(F.length("code") > coarse)
    above = rest.withColumn("parent", F.substring("code", 1, coarse)).join(rows.withColumnRenamed("code", "parent"), ["parent", "node"]).drop("parent").withColumn("source", F.lit("prefix"))
    found = own.unionByName(above)
    return found.withColumn("k", F.row_number().over(Window.partitionBy("code", "node").orderBy("rank"))).where(F.col("k") <= limit).select("code", "node", "source", "k", "text", "n")


def by_frequency(profiles: DataFrame) -> DataFrame:
    """The profile items with their place (nth) in their profile, the most frequent first."""
    return profiles.withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("full_df"), "node")))


def held(users: DataFrame, targets: DataFrame, items: DataFrame) -> DataFrame:
    """The items of each target (user, code) that the user has: users meet their targets first, and the items come to them."""
    mine = users.select("user", "node").distinct()
    return targets.select("user", "code").distinct().join(mine, "user").join(items, ["code", "node"])


def lacking(targets: DataFrame, had: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """The first `limit` items (by nth, counted as k) of each target (user, code) that aren't in `had` (user, code, nth).

    They are among the first limit + n items where n are had, so no user meets the whole profile.
    """
    rows = targets.select("user", "code", F.lit(None).cast("int").alias("nth")).unionByName(had.select("user", "code", "nth"))
    taken = rows.groupBy("user", "code").agg(F.collect_set("nth").alias("taken")).join(F.broadcast(items.groupBy("code").agg(F.max("nth").alias("most"))), "code")  # of one profile
    free = F.slice(F.array_except(F.sequence(F.lit(1), F.least("most", F.size("taken") + limit)), F.col("taken")), 1, limit)
    return taken.select("user", "code", F.posexplode(free).alias("k", "nth")).withColumn("k", F.col("k") + 1).join(items, ["code", "nth"])


def have_lack(users: DataFrame, targets: DataFrame, profiles: DataFrame, lack_limit: int = 10, evidence: DataFrame | None = None, said: DataFrame | None = None) -> DataFrame:
    """For each target (user, code): profile items the user has, and the most frequent ones lacking.

    With `evidence` only items that it can quote are told. With `said` (user, node), the user's nodes outside it are neither had nor lacking.
    """
    items = small(by_frequency(profiles if evidence is None else proved(profiles, evidence)))
    had = held(users, targets, items)
    told = had if said is None else had.join(said, ["user", "node"], "left_semi")
    have = told.withColumn("side", F.lit("have")).withColumn("place", F.row_number().over(Window.partitionBy("user", "code").orderBy(F.desc(F.round("weight", 9)), "node")))
    lack = lacking(targets, had, items, lack_limit).withColumn("side", F.lit("lack")).withColumnRenamed("k", "place")
    columns = ["user", "code", "side", "place", "node", "full_df"]
    return have.select(columns).unionByName(lack.select(columns))


def compare(users: DataFrame, targets: DataFrame, profiles: DataFrame, evidence: DataFrame, descriptions: DataFrame, limit: int = 2, coarse: int | None = None, said: DataFrame | None = None) -> DataFrame:
    """(user, code, side, place, node, full_df, quotes, description): what each user has and lacks of a target, as far as it can be quoted.

    With `coarse`, codes without quotes of their own take those of their prefix of so many digits.
    With `said` (user, node, sentence, sim), the user's own side: of a node's sentences the most
    similar, the first of equals, is told as sentence and sim, and nothing counts as had without one.
    """
    if said is not None:
        best = said.groupBy("user", "node").agg(F.min(F.struct((-F.col("sim")).alias("neg"), "sentence")).alias("s")).select("user", "node", F.col("s.sentence").alias("sentence"), (-F.col("s.neg")).alias("sim"))
        told = have_lack(users, targets, profiles, evidence=evidence, said=best).join(best, ["user", "node"], "left")
    else:
        told = have_lack(users, targets, profiles, evidence=evidence)
    found = evidence.select("code", "node", F.col("rank").alias("k"), "text").where(F.col("k") <= limit) if coarse is None else quotes(profiles, evidence, limit, coarse)
    lines = found.groupBy("code", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda q: q["text"]).alias("quotes"))  # `limit` at most
    return told.join(small(lines), ["code", "node"], "left").join(descriptions.select("code", "description"), "code", "left")


def code_postings(have: DataFrame, evidence: DataFrame, limit: int = 3) -> DataFrame:
    """(user, code, place, doc, nodes): of each target the source units that prove most of the items (user, code, node) that the user has."""
    proofs = evidence.select("code", "node", F.explode("doc_ids").alias("doc")).distinct()
    docs = have.select("user", "code", "node").distinct().join(small(proofs), ["code", "node"]).groupBy("user", "code", "doc").agg(F.sort_array(F.collect_list("node")).alias("nodes"))  # of one profile
    order = Window.partitionBy("user", "code").orderBy(F.desc(F.size("nodes")), "doc")
    return docs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("user", "code", "place", "doc", "nodes")


def match_summary(users: DataFrame, targets: DataFrame, profiles: DataFrame, evidence: DataFrame, fine: DataFrame, coarse: int = 4, postings: int = 3, finer: int = 3) -> DataFrame:
    """(user, code, units, score, have, lack, postings, subdivisions): one row for each target (user, code), the head of `compare`.

    have and lack are how many items are told, postings the source units that prove most of those
    had, subdivisions the finer codes with the largest overlap as "code:overlap:units".
    """
    told = have_lack(users, targets, profiles, evidence=evidence)
    sides = told.groupBy("user", "code").agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("have", "lack")])
    found = held(users, targets, small(profiles.select("code", "node", "weight"))).groupBy("user", "code").agg(F.sum("weight").alias("score"))
    proofs = code_postings(told.where("side = 'have'"), evidence, postings).groupBy("user", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc"))), lambda p: p["doc"]).alias("postings"))  # `postings` at most
    below = subdivisions(users, targets, fine, finer, coarse).select("user", F.col("parent").alias("code"), "place", F.concat_ws(":", "code", F.col("overlap").cast("string"), F.col("units").cast("string")).alias("line"))
    below = below.groupBy("user", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda p: p["line"]).alias("subdivisions"))  # `finer` at most
    known = targets.select("user", "code").distinct().join(profiles.groupBy("code").agg(F.max("units").alias("units")), "code")
    for part in (sides, found.select("user", "code", "score"), proofs, below):
        known = known.join(part, ["user", "code"], "left")
    return known.select("user", "code", "units", F.coalesce("score", F.lit(0.0)).alias("score"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("have", "lack")], "postings", "subdivisions")


def breadth(profiles: DataFrame) -> DataFrame:
    """Number of profiles that hold each node."""
    return profiles.groupBy("node").agg(F.countDistinct("code").alias("breadth"))


def gaps(users: DataFrame, targets: DataFrame, profiles: DataFrame, s: Settings, near: DataFrame | None = None, limit: int = 6, pool: int = 40, evidence: DataFrame | None = None) -> DataFrame:
    """Missing items by kind: near (a similarity of min_best, if given as (user, node, sim)), core, broad; others drop.

    Instead of nodes, `near` may name another column of the profiles: then it holds for all nodes with that value.

    The pool are the missing items that most units ask for; of it, with `evidence`, those it can
    quote, and the first quote is told. If `near` has the sentence that comes nearest, so is that, with sim.
    """
    jobs = profiles.agg(F.countDistinct("code").alias("jobs"))
    items = small(by_frequency(profiles))
    lack = lacking(targets, held(users, targets, items), items, pool)
    if evidence is not None:
        lack = proved(lack, evidence)
    lack = lack.join(small(breadth(profiles)), "node").crossJoin(F.broadcast(jobs)).withColumn("rate", F.col("full_df") / F.col("units"))
    if near is not None:
        on = ["user", "node"] if "node" in near.columns else [c for c in near.columns if c not in ("sim", "sentence")]
        lack = lack.join(near.select(*on, "sim", *[c for c in ("sentence",) if c in near.columns]), on, "left")
    else:
        lack = lack.withColumn("sim", F.lit(None).cast("double"))
    kind = F.when(F.col("sim") >= s.min_best, "near").when(F.col("rate") >= s.core_rate, "core").when(F.col("breadth") >= s.broad_share * F.col("jobs"), "broad")
    order = [F.expr("case kind when 'near' then 0 when 'core' then 1 else 2 end"), F.desc(F.round(F.when(F.col("kind") == "near", F.col("sim")).otherwise(F.col("rate")), 9)), F.col("node")]
    found = lack.withColumn("kind", kind).where("kind is not null")
    placed = found.withColumn("place", F.row_number().over(Window.partitionBy("user", "code").orderBy(*order))).where(F.col("place") <= limit)
    columns = ["user", "code", "node", "kind", "place", F.round("rate", 6).alias("rate"), "breadth"]
    if evidence is not None:
        placed = placed.join(small(evidence.where("rank = 1").select("code", "node", F.col("text").alias("quote"))), ["code", "node"], "left")
        columns.append("quote")
    return placed.select(*columns, *(["sentence", "sim"] if "sentence" in placed.columns else []))


def subdivisions(users: DataFrame, targets: DataFrame, fine: DataFrame, limit: int = 3, coarse: int = 4, min_overlap: int = 2) -> DataFrame:
    """Finer profiles below each target code (of `coarse` digits) with enough overlap, by the user's overlap, then units.

    Users meet their targets first and then the finer items of the same prefix and node, so only what they share leaves a task.
    """
    below = fine.withColumn("parent", F.substring("code", 1, coarse))
    asked = targets.select("user", F.col("code").alias("parent")).distinct()
    mine = users.select("user", "node").distinct()
    scored = asked.join(mine, "user").join(small(below.select("parent", "code", "node")), ["parent", "node"]).select("user", "parent", "code", F.lit(1).alias("shared"))
    sizes = small(below.groupBy("parent", "code").agg(F.max("units").alias("units")))
    if min_overlap <= 0:  # those that share nothing too
        scored = scored.unionByName(asked.join(sizes, "parent").select("user", "parent", "code", F.lit(0).alias("shared")))
    scored = scored.groupBy("user", "parent", "code").agg(F.sum("shared").alias("overlap")).where(F.col("overlap") >= min_overlap).join(sizes, ["parent", "code"])
    order = Window.partitionBy("user", "parent").orderBy(F.desc("overlap"), F.desc("units"), "code")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("user", "parent", "code", "overlap", "units", "place")


def related_postings(users: DataFrame, evidence: DataFrame, limit: int = 5) -> DataFrame:
    """Source units by how many of the user's nodes they prove."""
    proofs = evidence.select("node", F.explode("doc_ids").alias("doc")).distinct()
    counted = users.select("user", "node").distinct().join(small(proofs), "node").groupBy("user", "doc").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("user").orderBy(F.desc("n"), "doc")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def resolve_targets(wanted: DataFrame, profiles: DataFrame, fine: DataFrame, taxonomy: DataFrame, level: int = 6) -> DataFrame:
    """(wanted, code, how) of each wanted string, white space around it apart.

    A code or the name of a profile (code, name), the code or name of a finer one, or what the
    taxonomy (pos, code, name) calls so at `level`, one letter off at most, if that has a profile;
    the first that holds. Of equal names the least code, in the taxonomy the first by pos.
    """
    from matchloom.operators.taxonomy import name_codes, plain_name

    out = wanted.select("wanted").distinct().withColumn("t", F.btrim(F.coalesce("wanted", F.lit("")))).withColumn("key", plain_name(F.col("t")))
    for table, code, name in ((profiles, "c1", "c2"), (fine, "c3", "c4")):
        out = out.join(table.select(F.col("code").alias(code)).distinct(), F.col("t") == F.col(code), "left")
        named = table.groupBy("name").agg(F.min("code").alias(name))
        out = out.join(named, F.col("t") == F.col("name"), "left").drop("name")
    first = name_codes(out, taxonomy, (level,)).groupBy("key").agg(F.min(F.struct("pos", "code")).alias("m"))
    known = first.select("key", F.col("m.code").alias("c5")).join(profiles.select(F.col("code").alias("c5")).distinct(), "c5", "left_semi")
    out = out.join(known, "key", "left")
    kinds = (("c1", "profile"), ("c2", "profile name"), ("c3", "fine"), ("c4", "fine name"), ("c5", "taxonomy"))
    how = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(k)) for c, k in kinds], F.lit("unresolved"))
    return out.select("wanted", F.coalesce(*[c for c, _ in kinds]).alias("code"), how.alias("how"))
