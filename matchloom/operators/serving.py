"""What a posting service asks of its tables: look-ups with defaults, ranked picks, lists, sanitised rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import quote_verified

# What a user's own posting may hold (characters, items, characters of an item).
POSTING_LIMITS = {"companyName": 120, "positionTitle": 200, "postingTitle": 200, "jobFamily": 60, "sourceUrl": 500, "deadline": 10}
POSTING_LISTS = {"responsibilities": (12, 1500), "requiredSkills": (30, 60), "preferredSkills": (30, 60)}
UNNAMED = "직접 등록한 공고"
EXPERIENCE_HINTS = ("강점", "경험", "역량", "프로젝트", "활동", "성과")
DAY_MARK, LAST_DAY = "D-", "마감일"
#: Steps before a deadline: share of the days left, and the step's work.
STEPS = ((1.0, "공고 요구사항 확인", "high"), (0.65, "경험 근거 정리", "high"), (0.35, "자소서 초안 작성", "medium"), (0.0, "제출 전 확인", "low"))


def with_default(rows: DataFrame, known: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join on the keys; a value that is missing takes its default."""
    joined = rows.join(known.select(*keys, *defaults), keys, "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def importance_of(terms: DataFrame, table: DataFrame, neutral: float = 0.5) -> DataFrame:
    """(…, importance) of each term by its lower-case form; terms that the table lacks are neutral."""
    known = table.select(F.lower("term").alias("low"), "importance").groupBy("low").agg(F.max("importance").alias("importance"))
    return terms.withColumn("low", F.lower("term")).join(known, "low", "left").drop("low").withColumn("importance", F.coalesce("importance", F.lit(neutral)))


def loadable(postings: DataFrame, tier: str | None = "A", job: str | None = None, require_techs: bool = True, limit: int | None = None, order: str = "doc_id") -> DataFrame:
    """Postings of a tier and job (None: any) that name techs; with `limit` the first so many by `order`."""
    found = postings
    if tier is not None:
        found = found.where(F.col("tier") == tier)
    if job is not None:
        found = found.where(F.col("job") == job)
    if require_techs:
        found = found.where(F.size("techs") > 0)
    return found if limit is None else found.orderBy(order).limit(limit)


def line_with(text: Column, term: Column, longest: int = 120) -> Column:
    """The first line that holds the term in any case, trimmed and cut; empty if none."""
    hit = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.contains(F.lower(line), F.lower(term)))
    return F.coalesce(F.left(F.btrim(F.get(hit, F.lit(0))), F.lit(longest)), F.lit(""))


def excerpt(text: Column, name: Column, before: int = 120, length: int = 2200) -> Column:
    """`length` characters from a little before the name on; from the start where it isn't found."""
    at = F.when(F.coalesce(name, F.lit("")) != "", F.instr(text, name)).otherwise(F.lit(0))
    return F.substr(text, F.greatest(at - before, F.lit(1)), F.lit(length))


def by_either_url(rows: DataFrame, urls: list[str]) -> DataFrame:
    """(url, …) with a row for each of a posting's distinct addresses."""
    every = F.array_distinct(F.filter(F.array(*urls), lambda u: u.isNotNull() & (u != "")))
    return rows.withColumn("url", F.explode(every))


def aligned(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(name, match) of wanted (name) with known (pos, label): one is the other's beginning; the first label wins.

    Equal first characters are the join key, since the shorter name begins the longer one.
    """
    head = lambda c: F.left(c, F.lit(1))
    pairs = wanted.where("name <> ''").join(known.where("label <> ''"), head(F.col("name")) == head(F.col("label")))
    fits = pairs.where(F.startswith("name", F.col("label")) | F.startswith("label", F.col("name")))
    first = fits.groupBy("name").agg(F.min_by("label", "pos").alias("match"))
    return wanted.join(first, "name", "left")


def described(wanted: DataFrame, units: DataFrame, most: int = 10) -> DataFrame:
    """(code, names, definitions) of wanted (code, name) from units (pos, topic, code, unit, definition).

    The full name is asked first; if no unit of the code has that topic, the name's parts of two
    characters or more in turn. The first `most` by pos, names and definitions in pairs.
    """
    parts = F.filter(F.split("name", r"[·\s/]+"), lambda p: F.length(p) >= 2)
    asked = wanted.select("code", "name", F.posexplode(F.concat(F.array("name"), parts)).alias("turn", "topic"))
    hits = asked.join(units, ["code", "topic"])
    least = hits.groupBy("code", "name").agg(F.min("turn").alias("turn"))
    ranked = hits.join(least, ["code", "name", "turn"]).withColumn("k", F.row_number().over(Window.partitionBy("code", "name").orderBy("pos"))).where(F.col("k") <= most)
    lists = ranked.groupBy("code", "name").agg(F.array_sort(F.collect_list(F.struct("k", "unit", F.coalesce("definition", F.lit("")).alias("definition")))).alias("r"))  # `most` rows at most
    return wanted.join(lists, ["code", "name"], "left").select("code", "name", F.transform("r", lambda x: x["unit"]).alias("names"), F.transform("r", lambda x: x["definition"]).alias("definitions"))


def nth_document(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(posting, doc, text) of asked (posting, url, nth, own_text): the nth document (from 0) of the address, else the posting's own text."""
    order = Window.partitionBy("url").orderBy("doc")
    numbered = docs.where("url <> ''").withColumn("nth", F.row_number().over(order) - 1)
    return asked.join(numbered, ["url", "nth"], "left").select("posting", "doc", F.coalesce("text", "own_text").alias("text"))


def targets(profiles: DataFrame, fine: DataFrame, coarse: int = 6) -> DataFrame:
    """(code, name, label, units, level, parent, place): profiles and the finer ones below them, as a list to choose from."""
    top = profiles.select("code", "name", F.col("name").alias("label"), "units", F.lit(0).alias("level"), F.lit("").alias("parent"))
    names = profiles.select(F.col("code").alias("above"), F.col("name").alias("parent"))
    low = fine.withColumn("above", F.substring("code", 1, coarse)).join(names, "above")
    low = low.select("code", "name", F.concat_ws(" › ", "parent", "name").alias("label"), "units", F.lit(1).alias("level"), "parent")
    key = F.when(F.col("parent") != "", F.col("parent")).otherwise(F.col("name"))
    return top.unionByName(low).withColumn("family", key).orderBy("family", "level", F.desc("units"), "code")


def market_signals(users: DataFrame, market: DataFrame, limit: int = 5) -> DataFrame:
    """The market nodes (node, corps) that each user has, most companies first."""
    hits = users.select("user", "node").distinct().join(market.select("node", "corps"), "node")
    order = Window.partitionBy("user").orderBy(F.desc("corps"), "node")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def market_meta(nodes: DataFrame, noisy: str, most: int = 3) -> DataFrame:
    """(name, term, parent, df, corps, examples) of nodes (pos, term, parent, df, corps, examples array<struct<corp, role>>).

    A parent "NEW:x" makes x the name of a new axis. Of each company the first example counts, the
    first `most`; noisy roles are blank. Of nodes with one name the last stays.
    """
    new = F.startswith("parent", F.lit("NEW:"))
    named = nodes.withColumn("name", F.when(new, F.substr("parent", F.lit(5))).otherwise(F.col("term"))).withColumn("parent", F.when(new, "").otherwise(F.col("parent")))
    good = F.filter("examples", lambda e: F.coalesce(e["corp"], F.lit("")) != "")
    corps = F.transform("good", lambda e: e["corp"])
    role = lambda e: F.btrim(F.coalesce(e["role"], F.lit("")))
    first = F.filter(F.transform("good", lambda e, i: F.when(F.array_position(corps, e["corp"]) == i + 1, F.concat_ws("/", e["corp"], F.when(role(e).rlike(noisy), "").otherwise(role(e))))), lambda e: e.isNotNull())
    shown = named.withColumn("good", good).withColumn("shown", F.slice(first, 1, most))
    last = shown.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("pos")))).where("k = 1")
    return last.select("name", "term", "parent", "df", "corps", F.col("shown").alias("examples"))


def market_frequency(docs: DataFrame) -> DataFrame:
    """(job, tech, docs, of): documents of a job that name each tech (lower case, once a document)."""
    size = docs.groupBy("job").agg(F.count(F.lit(1)).alias("of"))
    named = docs.select("job", F.explode(F.array_distinct(F.transform("techs", F.lower))).alias("tech"))
    return named.groupBy("job", "tech").agg(F.count(F.lit(1)).alias("docs")).join(size, "job")


def demo_ready(docs: DataFrame, least_a: int = 3, least_techs: int = 3, repeats: int = 2) -> DataFrame:
    """By job: documents, those of tier A, techs that repeat, and whether both suffice for a demo."""
    by = docs.groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tier") == "A").alias("a"))
    often = market_frequency(docs).where(F.col("docs") >= repeats).groupBy("job").agg(F.count(F.lit(1)).alias("repeated"))
    full = by.join(often, "job", "left").withColumn("repeated", F.coalesce("repeated", F.lit(0)))
    return full.withColumn("ready", (F.col("a") >= least_a) & (F.col("repeated") >= least_techs))


def ocr_candidates(images: DataFrame, priority: tuple[str, ...], least_height: int = 1500, most_text: int = 1500) -> DataFrame:
    """(url, src, h, turn) of images (pos, url, title, text_len, src, w, h): pages whose largest image is tall and whose text is short.

    One row of each address; pages with an earlier priority word in the title come first, the others last.
    """
    largest = images.withColumn("k", F.row_number().over(Window.partitionBy("pos").orderBy(F.desc(F.col("w") * F.col("h")), "src"))).where("k = 1")
    good = largest.where((F.col("h") >= least_height) & (F.col("text_len") < most_text) & F.startswith("src", F.lit("http")))
    once = good.withColumn("k", F.row_number().over(Window.partitionBy("url").orderBy("pos"))).where("k = 1")
    turn = F.coalesce(*[F.when(F.contains("title", F.lit(w)), i) for i, w in enumerate(priority)], F.lit(len(priority)))
    return once.select("pos", "url", "src", "h", turn.alias("turn"))


def sanitised(raw: DataFrame) -> DataFrame:
    """A user's own posting within its limits: fields cut, lists cut and cleaned, address and date checked; without a title it goes."""
    cut = lambda c: F.left(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(POSTING_LIMITS[c]))
    clean = lambda c: F.filter(F.transform(F.slice(F.coalesce(F.col(c), F.expr("cast(array() as array<string>)")), 1, POSTING_LISTS[c][0]), lambda x: F.btrim(F.left(x, F.lit(POSTING_LISTS[c][1])))), lambda x: F.coalesce(x, F.lit("")) != "")
    title, url, day = F.btrim(cut("positionTitle")), cut("sourceUrl"), cut("deadline")
    or_else = lambda value, other: F.when(value != "", value).otherwise(other)
    return raw.select(
        F.left("postingId", F.lit(80)).alias("postingId"),
        or_else(F.btrim(cut("companyName")), F.lit(UNNAMED)).alias("companyName"),
        title.alias("positionTitle"),
        or_else(F.btrim(cut("postingTitle")), title).alias("postingTitle"),
        cut("jobFamily").alias("jobFamily"),
        *[clean(c).alias(c) for c in POSTING_LISTS],
        F.when(url.rlike("^https?://"), url).otherwise("").alias("sourceUrl"),
        F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day).alias("deadline"),
    ).where("positionTitle <> '' and startswith(postingId, 'user-')")


def history_window(turns: DataFrame, last: int = 6) -> DataFrame:
    """The last turns (posting, pos, …) of each posting, in order."""
    back = F.row_number().over(Window.partitionBy("posting").orderBy(F.desc("pos")))
    return turns.withColumn("back", back).where(F.col("back") <= last)


def agent_result(raw: DataFrame, most: int = 5) -> DataFrame:
    """(id, answer, actions, evidence) of raw (id, answer, actions array<struct<title, reason, priority>>, evidence array<struct<source, quote>>).

    Rows without an answer go; actions need a title, unknown priorities are medium; evidence needs a source and a quote.
    """
    told = lambda c: F.coalesce(c, F.lit("")) != ""
    level = lambda p: F.when(p.isin("high", "medium", "low"), p).otherwise("medium")
    actions = F.transform(F.slice(F.filter("actions", lambda a: told(a["title"])), 1, most), lambda a: F.struct(a["title"].alias("title"), F.coalesce(a["reason"], F.lit("")).alias("reason"), level(a["priority"]).alias("priority")))
    return raw.where(F.coalesce(F.btrim("answer"), F.lit("")) != "").select("id", F.btrim("answer").alias("answer"), actions.alias("actions"), F.filter("evidence", lambda e: told(e["source"]) & told(e["quote"])).alias("evidence"))


def day_label(days: Column, step: str) -> Column:
    """D-n, the last day's name for 0, the step's name without a deadline."""
    return F.when(days.isNull(), F.lit(step)).when(days > 0, F.concat(F.lit(DAY_MARK), days.cast("string"))).otherwise(LAST_DAY)


def fallback_actions(postings: DataFrame) -> DataFrame:
    """(posting, pos, label, title, priority) of postings (posting, days): the steps towards a deadline, days null if there is none."""
    rows = [F.struct(F.lit(i).alias("pos"), day_label(F.when(F.col("days").isNotNull(), F.greatest(F.ceil(F.col("days") * share), F.lit(0))), f"{i + 1}단계").alias("label"), F.lit(title).alias("title"), F.lit(level).alias("priority")) for i, (share, title, level) in enumerate(STEPS)]
    return postings.select("posting", F.explode(F.array(*rows)).alias("s")).select("posting", "s.*")


def target_section(sections: DataFrame, hints: tuple[str, ...] = EXPERIENCE_HINTS) -> DataFrame:
    """(posting, question): the first section that asks for experience, else the one with the longest answer."""
    hint = reduce(lambda a, b: a | b, [F.contains("question", F.lit(h)) for h in hints])
    rank = F.struct(hint.cast("int").alias("hint"), F.when(hint, 0).otherwise(F.length(F.coalesce("answer", F.lit("")))).alias("n"), (-F.col("pos")).alias("neg"))
    best = sections.groupBy("posting").agg(F.max_by("question", rank).alias("question"))
    return best.withColumn("question", F.when(F.col("question") != "", F.col("question")))


def today(tasks: DataFrame, day: str, most: int = 4) -> DataFrame:
    """(owner, k, task, source) of tasks (owner, task, day, done): those of the day, else pending ones; `most` of them."""
    dated = F.coalesce(F.col("day") == F.lit(day).cast("date"), F.lit(False))
    marked = tasks.withColumn("dated", dated).where(F.col("dated") | ~F.col("done"))
    any_dated = F.max("dated").over(Window.partitionBy("owner"))
    chosen = marked.withColumn("any_dated", any_dated).where(F.col("dated") == F.col("any_dated"))
    place = F.row_number().over(Window.partitionBy("owner").orderBy("task"))
    return chosen.withColumn("k", place).where(F.col("k") <= most).select("owner", "k", "task", F.when(F.col("dated"), "dated").otherwise("pending").alias("source"))


def progress_share(tasks: DataFrame) -> DataFrame:
    """(owner, percent) of done tasks, half up."""
    return tasks.groupBy("owner").agg(F.round(100 * F.avg(F.col("done").cast("double"))).cast("long").alias("percent"))


def families(jobs: DataFrame) -> DataFrame:
    """Sorted distinct job families."""
    return jobs.select("job").where("job <> ''").distinct().orderBy("job")


def by_deadline(rows: DataFrame) -> DataFrame:
    """Place of each posting by deadline, those without one last."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy(F.asc_nulls_last("deadline"), "posting")))


def rubric_order(items: DataFrame) -> DataFrame:
    """Place of each item (rubric, pos, kind, quote, techs): required, duty, preferred; then how many techs its quote names."""
    kind = F.when(F.col("kind") == "required", 0).when(F.col("kind") == "duty", 1).otherwise(2)
    named = F.size(F.filter("techs", lambda t: F.contains(F.lower("quote"), F.lower(t))))
    return items.withColumn("named", named).withColumn("place", F.row_number().over(Window.partitionBy("rubric").orderBy(kind, F.desc("named"), "pos")))


# What is asked after a short answer, by the item's kind (required ones last).
FOLLOWUPS = {
    "preferred": ("'", "'와 관련해 직접 해 본 것이 있다면, 어떤 상황에서 무엇을 했는지 말씀해 주세요."),
    "duty": ("입사하면 '", "' 업무를 맡게 됩니다. 비슷한 일을 해 본 경험과 그때 본인의 역할을 말씀해 주세요."),
    "required": ("'", "'을(를) 실제로 써 본 경험을 말씀해 주세요. 본인이 맡은 부분과 결과는 무엇이었나요?"),
}


def interview_export(items: DataFrame) -> DataFrame:
    """(rubric, place, label, keywords, followup, jd_quote) of ordered items (rubric, place, kind, quote, techs), as an interview reads them."""
    from matchloom.operators.persona import keywords

    label = F.left("quote", F.lit(40))
    asked = {kind: F.concat(F.lit(a), label, F.lit(b)) for kind, (a, b) in FOLLOWUPS.items()}
    followup = F.when(F.col("kind") == "preferred", asked["preferred"]).when(F.col("kind") == "duty", asked["duty"]).otherwise(asked["required"])
    return items.select("rubric", "place", label.alias("label"), keywords(F.col("quote"), F.col("techs")).alias("keywords"), followup.alias("followup"), F.col("quote").alias("jd_quote"))


def cached_rubrics(docs: DataFrame, rubrics: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, cached) of docs (doc, url, text): whether a stored rubric (doc, url) may be used again.

    It may if it was made for the document's address and the document holds every quote of its items
    (doc, jd_quote); else the rubric is to be built anew.
    """
    held = docs.join(rubrics.select("doc", F.col("url").alias("made_for")), "doc", "left")
    wrong = items.join(docs.select("doc", "text"), "doc").where(~F.coalesce(quote_verified(F.col("jd_quote"), F.col("text")), F.lit(False))).select("doc", F.lit(1).alias("wrong")).distinct()
    return held.join(wrong, "doc", "left").select("doc", (F.coalesce(F.col("made_for") == F.col("url"), F.lit(False)) & F.col("wrong").isNull()).alias("cached"))


def rubric_batch(items: DataFrame, least: int = 3) -> DataFrame:
    """(rubric, items, kept): rubrics and whether they have enough items to be written."""
    return items.groupBy("rubric").agg(F.count(F.lit(1)).alias("items")).withColumn("kept", F.col("items") >= least)


def fit(postings: DataFrame) -> DataFrame:
    """(posting, score, matched, partial, missing, total) of judged requirements (posting, pos, competency, importance, status)."""
    credit = F.when(F.col("status") == "covered", 1.0).when(F.col("status") == "partial", 0.5).otherwise(0.0)
    names = lambda status: F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == status, F.struct("pos", "competency")))), lambda x: x["competency"])  # noqa: E731  a posting's own requirements
    score = F.coalesce(F.round(F.try_divide(F.sum(F.col("importance") * credit), F.sum("importance")), 3), F.lit(0.0))
    return postings.groupBy("posting").agg(score.alias("score"), names("covered").alias("matched"), names("partial").alias("partial"), names("missing").alias("missing"), F.count(F.lit(1)).alias("total"))


def vocabulary(units: DataFrame) -> DataFrame:
    """(term, df): units that name each normal form of two characters or more, from (unit, code, term); units without a code don't count."""
    named = units.where("code is not null and code <> ''").where(F.length("term") >= 2).select("unit", "term").distinct()
    return named.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def dictionary_names(sources: list[DataFrame], noise: Column | None = None) -> DataFrame:
    """Distinct sorted names of several sources (node), without noise."""
    every = reduce(DataFrame.unionByName, [s.select("node") for s in sources]).distinct()
    return (every.where(~noise) if noise is not None else every).orderBy("node")


# What counts as a closed eye or a frown, as a move of shoulders and wrists, as tilted and off the centre (shares of the picture).
CLOSED, BODY_MOVE, ARM_MOVE, TILT, OFF_CENTRE = 0.45, 0.035, 0.05, 0.055, 0.22


def gated_before(value: Column, gate: Column, order: Window) -> Column:
    """The value at the last earlier row where `gate` holds: a state that stands still where it doesn't."""
    return F.last(F.when(gate, value), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))


def frame_metrics(frames: DataFrame) -> DataFrame:
    """One row for each session of frames (session, ms, face, hands, blink, frown, left, right, wrists, gesture).

    face and hands tell whether there are any; blink and frown are the means of both sides (null
    without a face); left, right and wrists are points (x, y) of the shoulders and between the
    wrists, null without a pose. An eye that closes after an open (or the first) face is a blink;
    frames without a face change nothing about that, and frames without a pose nothing about moves,
    which are Euclidean and against the last pose. Rates are over the frames with a face or a pose.
    """
    order = Window.partitionBy("session").orderBy("ms")
    face, pose = F.coalesce("face", F.lit(False)), F.col("left").isNotNull() & F.col("right").isNotNull()
    closed = face & (F.coalesce("blink", F.lit(0.0)) > CLOSED)
    middle = F.struct(((F.col("left.x") + F.col("right.x")) / 2).alias("x"), ((F.col("left.y") + F.col("right.y")) / 2).alias("y"))
    apart = lambda a, b: F.sqrt(F.pow(F.col(f"{a}.x") - F.col(f"{b}.x"), F.lit(2)) + F.pow(F.col(f"{a}.y") - F.col(f"{b}.y"), F.lit(2)))
    rows = frames.withColumns({"face": face, "pose": pose, "closed": closed, "middle": middle})
    rows = rows.withColumns({"was_closed": gated_before(F.col("closed"), face, order), "was_middle": gated_before(F.col("middle"), pose, order), "was_wrists": gated_before(F.col("wrists"), pose, order)})
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    of = lambda c, n: F.round(F.coalesce(F.try_divide(c, n), F.lit(0.0)), 3)
    faces, poses, all_ = count(F.col("face")), count(F.col("pose")), F.count(F.lit(1))
    seconds = (F.max("ms") - F.min("ms")) / 1000
    return rows.groupBy("session").agg(
        all_.alias("frames"),
        (F.floor((F.max("ms") - F.min("ms") + 5) / 10) / 100).alias("seconds"),  # two digits, half up
        F.round(F.coalesce(F.try_divide(all_, seconds), F.lit(0.0)), 2).alias("fps"),
        of(faces, all_).alias("face_rate"),
        of(count(F.col("hands")), all_).alias("hand_rate"),
        of(poses, all_).alias("pose_rate"),
        count(F.col("closed") & ~F.coalesce("was_closed", F.lit(False))).alias("blinks"),
        of(count(F.col("face") & (F.coalesce("frown", F.lit(0.0)) > CLOSED)), faces).alias("frown_rate"),
        count(F.col("pose") & (apart("middle", "was_middle") > BODY_MOVE)).alias("body_moves"),
        count(F.col("pose") & (apart("wrists", "was_wrists") > ARM_MOVE)).alias("arm_moves"),
        of(count(F.col("pose") & (F.abs(F.col("left.y") - F.col("right.y")) > TILT)), poses).alias("tilt_rate"),
        of(count(F.col("pose") & (F.abs(F.col("middle.x") - 0.5) > OFF_CENTRE)), poses).alias("off_centre_rate"),
        F.count("gesture").alias("gestures"),
    )


def collection_plan(report: DataFrame) -> DataFrame:
    """Categories that fail, most needed institutions first."""
    return report.where("not included").withColumn("place", F.row_number().over(Window.orderBy(F.desc("needed_institutions"), "code")))  # one row for each category
