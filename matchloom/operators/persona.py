"""Rubrics, reviews and interviews by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.parsing import split_outside

# What shows an action and a result, and the weights of kinds.
ACTION = "제가|저는|직접|담당|주도|구현|개발|설계|분석|개선|작성|운영"
RESULT = "\\d|결과|성과|개선|단축|증가|감소|달성|수상|배포"
PARTICLE = "(을|를|이|가|은|는|의|에|로|으로|과|와)$"
STOP = ("및", "등", "관련", "경험", "이해", "능력", "역량", "보유", "우대", "가능", "업무", "있는", "분", "자", "이상", "대한", "위한", "활용", "기반", "통한")
KIND_RANK = {"required": 0, "duty": 1, "preferred": 2}
SENTENCE_END = "(?<=[.!?。])\\s+|\\n+"


def header_kind(line: Column) -> Column:
    plain = F.replace(line, F.lit(" "), F.lit(""))
    return F.when(F.contains(plain, F.lit("우대")), "preferred").when(plain.rlike("자격|필수|요건|역량|조건|스킬"), "required").when(plain.rlike("업무|하는일|담당|주요"), "duty")


def keywords(text: Column, techs: Column) -> Column:
    """Techs that the text names, then its words without particles and stop words; the first four."""
    named = F.filter(techs, lambda t: F.contains(F.lower(text), F.lower(t)))
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9+#./-]{1,}|[가-힣]{2,})"), 1), lambda w: F.regexp_replace(w, PARTICLE, ""))
    good = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP))
    return F.slice(F.array_distinct(F.concat(named, good)), 1, 4)


def rubric_lines(docs: DataFrame, header: Column | None = None, longest: int = 90) -> DataFrame:
    """(doc, pos, kind, line): lines below a header take its kind, by a forward fill."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.btrim("line")).where("line <> ''")
    own = header if header is not None else F.when(F.length("line") <= 16, header_kind(F.col("line")))
    marked = lines.withColumn("head", own)
    kind = F.last("head", ignorenulls=True).over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("kind", kind).where(F.col("head").isNull() & F.col("kind").isNotNull() & (F.length("line") <= longest)).select("doc", "pos", "kind", "line")


# Bullets, headers that share a line with their items, and lines that are no item.
BULLET = "^\\s*(?:[-•·ㆍ*○●▶▪■□◦]|\\d+[.)])\\s*"
INLINE = "^\\s*(주요\\s*업무|담당\\s*업무|필요\\s*역량|자격\\s*요건|지원\\s*자격|우대\\s*사항|우대)\\s*[:：]\\s*(.+)"
SKIP = (
    "병역|결격|해외여행|쿠키|채용\\s*절차|전형|접수|마감|근무지|연봉|복리|학사\\s*이상|학력|졸업|채용\\s*시\\s*까지|장애인|보훈|취업지원|유의|문의|합격|내규|미충족|제출|허위|어학성적|기간|지원하|해당 시|입사|영업비밀|개인정보|^전공"
)


def rubric_items(docs: DataFrame, most: int = 6) -> DataFrame:
    """(doc, place, kind, label, jd_quote) of docs (doc, text, techs): requirements, duties and preferences by the posting's own lines.

    A line "header: a, b" gives items of the header's kind (a duty if unknown). A short header line
    sets the kind of the bullets and plain lines below it; what follows a bracket in it is an item
    too. Items have 4 to 70 characters, none twice; required ones that name techs come first. A
    posting without any gets its techs and sentences as requirements, but not what equals its company,
    role or title (columns corp, role, title, as far as docs have them).
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\\r?\\n"), lambda x: F.btrim(F.replace(x, F.lit("\u200b"), F.lit("")))), lambda x: x != "")
    rows = docs.select("doc", "techs", F.posexplode(lines).alias("pos", "line"))
    inline = F.col("line").rlike(INLINE)
    head = F.when(~inline & (F.length("line") <= 16), header_kind(F.col("line")))
    rows = rows.withColumns({"inline": inline, "head": head})
    rows = rows.withColumn("kind", F.last("head", ignorenulls=True).over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    bullet = F.col("line").rlike(BULLET)
    after = F.regexp_replace("line", "^\\[[^\\]]*\\]\\s*", "")
    none = F.expr("cast(array() as array<string>)")
    parts = (
        F.when(F.col("inline"), split_outside(F.regexp_extract("line", INLINE, 2)))
        .when(F.col("head").isNotNull(), F.when((after != F.col("line")) & (F.length(after) >= 4), F.array(after)).otherwise(none))
        .when(bullet, split_outside(F.regexp_replace("line", BULLET, "")))
        .when(F.col("kind").isNotNull() & (F.length("line") <= 90) & ~F.col("line").rlike(SKIP), F.array("line"))
        .otherwise(none)
    )
    kind = F.when(F.col("inline"), F.coalesce(header_kind(F.regexp_extract("line", INLINE, 1)), F.lit("duty"))).otherwise(F.col("kind"))
    items = rows.select("doc", "techs", "pos", kind.alias("kind"), F.posexplode(parts).alias("part", "item")).where("kind is not null").withColumn("item", F.btrim("item", F.lit(" -·")))
    good = items.where(F.length("item").between(4, 70) & ~F.col("item").rlike(SKIP))
    fallback = F.concat("techs", F.transform(F.split(F.coalesce("text", F.lit("")), "[\\n.!?。！？]"), lambda x: F.btrim(F.regexp_replace(x, "(?U)\\s+", " "), F.lit(" -·"))))
    named_by = [c for c in ("corp", "role", "title") if c in docs.columns]
    without = docs.join(good.select("doc").distinct(), "doc", "left_anti").withColumn("names", F.array(*[F.coalesce(c, F.lit("")) for c in named_by]).cast("array<string>"))
    bare = without.select("doc", "techs", "names", F.posexplode(fallback).alias("pos", "item")).where(~F.array_contains("names", F.col("item"))).drop("names")
    bare = bare.where(F.length("item").between(4, 70) & ~F.col("item").rlike(SKIP) & ~F.col("item").rlike("20\\d{2}|고용형태|회사명|직무명"))
    every = good.unionByName(bare.withColumns({"kind": F.lit("required"), "part": F.lit(-1)}))
    once = every.withColumn("k", F.row_number().over(Window.partitionBy("doc", "item").orderBy("pos", "part"))).where("k = 1")
    named = F.when(F.col("part") < 0, 0).otherwise(F.size(F.filter("techs", lambda t: F.contains(F.lower("item"), F.lower(t)))))
    rank = F.when(F.col("kind") == "required", 0).when(F.col("kind") == "duty", 1).otherwise(2)
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(rank, F.desc(named), "pos", "part"))).where(F.col("place") <= most)
    return placed.select("doc", "place", "kind", F.left("item", F.lit(40)).alias("label"), F.col("item").alias("jd_quote"))


def weights(items: DataFrame) -> DataFrame:
    """Weight of each rubric item (rubric, item, kind_weight, share): kind * (1 + share), then its part of the sum; three digits, twice."""
    raw = F.round(F.col("kind_weight") * (1 + F.coalesce("share", F.lit(0.0))), 3)
    total = F.sum("raw").over(Window.partitionBy("rubric"))
    return items.withColumn("raw", raw).withColumn("weight", F.coalesce(F.round(F.try_divide(F.col("raw"), total), 3), F.lit(0.0))).drop("raw")


def first_sentence(text: Column, words: Column) -> Column:
    """The first sentence of five characters or more with one of the words, cut at 160."""
    parts = F.filter(F.split(text, SENTENCE_END), lambda s: F.length(F.btrim(s)) >= 5)
    hit = F.filter(parts, lambda s: F.exists(words, lambda w: (w != "") & F.contains(F.lower(s), F.lower(w))))
    return F.left(F.btrim(F.get(hit, F.lit(0))), F.lit(160))


def review(items: DataFrame, action: str = ACTION, result: str = RESULT) -> DataFrame:
    """Status of each item (rubric, item, words, letter, experience): strong, weak or missing; and what to do."""
    quote = first_sentence(F.col("letter"), F.col("words"))
    told = first_sentence(F.col("experience"), F.col("words"))
    with_quote = items.withColumn("quote", quote).withColumn("told", told)
    status = F.when(F.col("quote").isNull(), "missing").when(F.col("quote").rlike(action) & F.col("quote").rlike(result), "strong").otherwise("weak")
    done = F.when(F.col("status") == "strong", "keep").when((F.col("status") == "missing") & F.col("told").isNotNull(), "insert").when(F.col("status") == "missing", "prepare").otherwise("revise")
    return with_quote.withColumn("status", status).withColumn("todo", done)


def review_score(rows: DataFrame) -> DataFrame:
    """Hundred times the weighted status, rounded, and the counts of each status."""
    value = F.when(F.col("status") == "strong", 1.0).when(F.col("status") == "weak", 0.5).otherwise(0.0)
    return rows.groupBy("rubric").agg(F.round(100 * F.round(F.sum(F.col("weight") * value), 6)).cast("long").alias("score"), *[F.count_if(F.col("status") == s).alias(s) for s in ("strong", "weak", "missing")])


def weakest(rows: DataFrame) -> DataFrame:
    value = F.expr("case status when 'strong' then 2 when 'weak' then 1 else 0 end")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("rubric").orderBy(value, F.desc("weight"), "item")))


def interview_scores(answers: DataFrame, action: str = ACTION, result: str = RESULT) -> DataFrame:
    """Score 0 to 3 of each (session, item): a keyword sentence, an action, a result; answers joined in order, all in one fold."""
    joined = answers.groupBy("session", "item", "words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "answer"))), lambda s: s["answer"]), "\n").alias("text"), F.count(F.lit(1)).alias("answers"))  # one item's answers
    score = first_sentence(F.col("text"), F.col("words")).isNotNull().cast("int") + F.col("text").rlike(action).cast("int") + F.col("text").rlike(result).cast("int")
    return joined.withColumn("score", score).withColumn("followup", (F.col("score") < 2) & (F.col("answers") == 1)).drop("text")


def last_answers(log: DataFrame) -> DataFrame:
    """The last answer of each item wins."""
    return log.groupBy("session", "item").agg(F.max_by(F.struct("score", "text"), "seq").alias("a")).select("session", "item", "a.score", "a.text")
