"""Prefix-coded taxonomy: levels, name resolution, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: marks that names write in different ways.
DOTS = r"[·․‧∙・･ㆍ⋅ž,]"


def plain_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, DOTS, ""), r"(?U)\s+", "")


def levels(codes: DataFrame) -> DataFrame:
    """(code, level, prefix) for the two, four, six and eight digit prefixes of each code."""
    cut = [F.struct(F.lit(k).alias("level"), F.substring("code", 1, k).alias("prefix")) for k in (2, 4, 6, 8)]
    return codes.select("code", F.explode(F.array(*cut)).alias("x")).select("code", "x.level", "x.prefix").where(F.length("prefix") == F.col("level"))


def one_letter_off(a: Column, b: Column) -> Column:
    """Equal length of five or more and at most one letter different (for equal lengths Levenshtein 1 is Hamming 1)."""
    return (F.length(a) == F.length(b)) & (F.length(a) >= 5) & (F.levenshtein(a, b) <= 1)


def lookup(names: DataFrame, index: DataFrame) -> DataFrame:
    """Resolve names (name, under) in index (pos, code, index_name): exact normal form, else one letter off.

    `under` is a code prefix or empty; the first entry by pos wins. The fuzzy step joins on the
    length and on one of the two halves being equal, which one differing letter always leaves.
    """
    wanted = names.withColumn("plain", plain_name(F.col("name")))
    known = index.withColumn("key", plain_name(F.col("index_name")))
    below = F.col("code").startswith(F.col("under"))
    exact = wanted.join(known, F.col("plain") == F.col("key")).where(below).withColumn("how", F.lit(0))
    half = lambda c: [F.struct(F.lit(i).alias("part"), F.length(c).alias("n"), p.alias("text")) for i, p in enumerate((F.left(c, F.floor(F.length(c) / 2).cast("int")), F.right(c, F.ceil(F.length(c) / 2).cast("int"))))]
    a = wanted.withColumn("h", F.explode(F.array(*half(F.col("plain")))))
    b = known.withColumn("g", F.explode(F.array(*half(F.col("key")))))
    fuzzy = a.join(b, F.col("h") == F.col("g")).where(below & one_letter_off(F.col("plain"), F.col("key")) & (F.col("plain") != F.col("key"))).withColumn("how", F.lit(1))
    both = exact.select("name", "under", "how", "pos", "code").unionByName(fuzzy.select("name", "under", "how", "pos", "code")).distinct()
    first = both.withColumn("k", F.row_number().over(Window.partitionBy("name", "under").orderBy("how", "pos"))).where("k = 1")
    return names.join(first.select("name", "under", "code", "how"), ["name", "under"], "left")


def vote(cells: DataFrame) -> DataFrame:
    """The most frequent code of each document's cells (doc, pos, code); the first seen of equals."""
    counted = cells.groupBy("doc", "code").agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"))
    return counted.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("votes"), "first", "code"))).where("k = 1").drop("k")


def inverted(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Sorted distinct values of each key (an export of sets as lists)."""
    return pairs.select(key, value).distinct().groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))


# A code before a name, headers of the levels, a code and its name in one cell.
LEAD_CODE = r"^\s*(\d{2})\s*[.．·:]?\s*"
HEAD_MAJOR = r"^\s*대\s*분\s*류\s*$"
HEAD_OTHER = r"^\s*[중소세]\s*분\s*류\s*$"
PAIRED = r"(\d{2})\s*[.．·]\s*([가-힣][가-힣A-Za-z·.ㆍ,／/\s]{1,24})"


def table_cells(docs: DataFrame, most: int | None = 80) -> DataFrame:
    """(doc, i, cell) of docs (doc, region): the filled lines of a classification table, the first `most` of them (None: all)."""
    filled = F.filter(F.transform(F.split(F.coalesce("region", F.lit("")), r"\r?\n"), lambda c: F.regexp_replace(c, r"^(?U)\s+|\s+$", "")), lambda c: c != "")
    return docs.select("doc", F.posexplode(filled if most is None else F.slice(filled, 1, most)).alias("i", "cell"))


def without_code(cell: Column) -> Column:
    return plain_name(F.regexp_replace(cell, LEAD_CODE, ""))


def majors(cells: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(doc, major): the two-digit code that a table names, by the first of four rules that finds one.

    A code and its own name in one cell; a cell that is a name; the code in the cell behind the
    header of the first level; the code in the cell behind the last header. Within a rule the first cell wins.
    """
    top = taxonomy.where(F.length("code") == 2).select("code", plain_name(F.col("name")).alias("key"))
    by_name = top.groupBy("key").agg(F.max("code").alias("code"))
    both = F.arrays_zip(F.regexp_extract_all("cell", F.lit(PAIRED), 1).alias("c"), F.regexp_extract_all("cell", F.lit(PAIRED), 2).alias("n"))
    paired = cells.select("doc", "i", F.posexplode(both).alias("k", "p")).select("doc", "i", "k", F.col("p.c").alias("code"), plain_name(F.col("p.n")).alias("key")).join(top, ["code", "key"])
    named = cells.withColumn("key", without_code(F.col("cell"))).join(by_name, "key")
    order = Window.partitionBy("doc").orderBy("i")
    is_major, is_head = F.col("cell").rlike(HEAD_MAJOR), F.col("cell").rlike(HEAD_MAJOR) | F.col("cell").rlike(HEAD_OTHER)
    ahead = cells.withColumn("next", F.lead("cell").over(order)).withColumn("code", F.regexp_extract("next", LEAD_CODE, 1))
    last_head = F.max(F.when(is_head, F.col("i"))).over(Window.partitionBy("doc"))
    coded = ahead.withColumn("last", last_head).where("code <> ''").join(top.select("code"), "code", "left_semi")
    found = [
        paired.select("doc", F.lit(1).alias("rule"), "i", "k", "code"),
        named.select("doc", F.lit(2).alias("rule"), "i", F.lit(0).alias("k"), "code"),
        coded.where(is_major & ~F.col("next").rlike(HEAD_OTHER)).select("doc", F.lit(3).alias("rule"), "i", F.lit(0).alias("k"), "code"),
        coded.where(F.col("i") == F.col("last")).select("doc", F.lit(4).alias("rule"), "i", F.lit(0).alias("k"), "code"),
    ]
    every = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return every.groupBy("doc").agg(F.min(F.struct("rule", "i", "k", "code")).alias("m")).select("doc", F.col("m.code").alias("major"), F.col("m.rule").alias("rule"))


def name_codes(keys: DataFrame, taxonomy: DataFrame, levels: tuple[int, ...] = (8, 6, 4)) -> DataFrame:
    """(key, level, pos, code): all codes of a level that a normal form (key) names, else those of the first name one letter off.

    `taxonomy` (pos, code, name); pos is the order of the names.
    """
    known = taxonomy.withColumn("level", F.length("code")).where(F.col("level").isin(*levels)).select("level", "pos", "code", plain_name(F.col("name")).alias("known"))
    asked = keys.select("key").distinct().where(F.length("key") >= 2)
    exact = asked.join(known, F.col("key") == F.col("known")).select("key", "level", "pos", "code")
    names = known.groupBy("level", "known").agg(F.min("pos").alias("first"))
    halves = lambda c: F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.length(c).alias("n"), p.alias("text")) for i, p in enumerate((F.left(c, F.floor(F.length(c) / 2).cast("int")), F.right(c, F.ceil(F.length(c) / 2).cast("int"))))]))
    near = asked.where(F.length("key") >= 5).withColumn("h", halves(F.col("key"))).join(names.withColumn("g", halves(F.col("known"))), F.col("h") == F.col("g"))
    near = near.where(one_letter_off(F.col("key"), F.col("known"))).join(exact.select("key", "level").distinct(), ["key", "level"], "left_anti")
    nearest = near.groupBy("key", "level").agg(F.min(F.struct("first", "known")).alias("m")).select("key", "level", F.col("m.known").alias("known"))
    return exact.unionByName(nearest.join(known, ["level", "known"]).select("key", "level", "pos", "code"))


def resolve(docs: DataFrame, taxonomy: DataFrame, most: int | None = 80) -> DataFrame:
    """(doc, code, level, how) of classification tables (doc, region, hint): the code that most of a table's cells name.

    The major is that of `hint` (a name, or null), else what `majors` finds. Under it, the deepest
    level at which any cell names a code decides (how: name); of its codes the most frequent, the
    first seen of equals. Without such a cell the major alone stands (major, level 2), without that
    nothing (none; empty for tables without text).
    """
    cells = table_cells(docs, most)
    top = taxonomy.where(F.length("code") == 2).groupBy(plain_name(F.col("name")).alias("key")).agg(F.max("code").alias("hinted"))
    told = docs.select("doc", plain_name(F.coalesce("hint", F.lit(""))).alias("key"), (F.coalesce("region", F.lit("")) == "").alias("empty")).join(top, "key", "left")
    under = told.join(majors(cells, taxonomy), "doc", "left").select("doc", "empty", F.coalesce("hinted", "major").alias("major"))
    keyed = cells.withColumn("key", without_code(F.col("cell")))
    hits = keyed.join(name_codes(keyed, taxonomy), "key").join(under.where("not empty").select("doc", "major"), "doc").where(F.col("major").isNull() | F.startswith("code", "major"))
    counted = hits.groupBy("doc", "level", "code").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("i", "pos")).alias("first"))
    best = counted.groupBy("doc").agg(F.min(F.struct((-F.col("level")).alias("l"), (-F.col("votes")).alias("v"), "first", "code")).alias("b"))
    found = under.join(best, "doc", "left")
    how = F.when(F.col("empty"), "empty").when(F.col("b").isNotNull(), "name").when(F.col("major").isNotNull(), "major").otherwise("none")
    code = F.when(F.col("how") == "name", F.col("b.code")).when(F.col("how") == "major", F.col("major"))
    return found.withColumn("how", how).select("doc", code.alias("code"), F.length(code).alias("level"), "how")
