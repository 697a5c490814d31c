"""Assist, persona, vector, queue and stream operators over orders, events, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.operators import assist, corpus, persona, vectors
from matchloom.plans import fixtures as fx
from matchloom.plans.catalogue import register
from matchloom.settings import Settings
from matchloom.streaming import snapshots

WITH_POSTINGS = "WITH " + fx.POSTINGS_SQL
URGENCY_SQL = "CASE WHEN days_left <= 0 THEN 1.0 WHEN days_left <= 1 THEN 0.95 WHEN days_left <= 3 THEN 0.8 WHEN days_left <= 7 THEN 0.5 WHEN days_left <= 14 THEN 0.3 ELSE 0.15 END"
RANKED_SQL = WITH_POSTINGS + f""",
pr AS (SELECT *, round((1 - rate) * {URGENCY_SQL} * pow(coalesce(least(greatest(fit, 0.0), 1.0), 1.0), 1.5), 8) AS score FROM postings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, posting) AS rank FROM pr)
"""


@register(RANKED_SQL + "SELECT posting, owner, rank, score FROM ranked")
def priority_rank(spark, d):
    return assist.priorities(fx.postings(spark, d), digits=8).select("posting", "owner", "rank", "score")


@register(RANKED_SQL + """,
m AS (SELECT *, score > 0 AND rate < 1 AS able, row_number() OVER (PARTITION BY owner ORDER BY CASE WHEN score > 0 AND rate < 1 THEN 0 ELSE 1 END, rank) AS nth FROM ranked)
SELECT owner, max(CASE WHEN nth = 1 THEN posting END) AS focus, max(CASE WHEN nth = 2 AND able THEN posting END) AS next_up,
  count(*) FILTER (WHERE days_left BETWEEN 0 AND 1 AND rate < 1) AS urgent, count(*) AS open FROM m GROUP BY owner""")
def briefing_focus(spark, d):
    return assist.briefing(assist.priorities(fx.postings(spark, d), digits=8))


@register(RANKED_SQL + "SELECT owner, printf('D-%d %d %.8f', days_left, posting, score) AS line FROM ranked WHERE rank = 1")
def nudge_line(spark, d):
    return assist.nudge(assist.priorities(fx.postings(spark, d), digits=8), "D-%d %s %.8f")


SNAP_SQL = "snap AS (SELECT CAST(ts AS DATE) AS as_of, user_id AS key, value AS rate, ts, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts DESC, event_id DESC) = 1)"


def _points(spark, d):
    return fx.table(spark, d, "events").select(F.to_date("ts").alias("as_of"), F.col("user_id").alias("key"), F.col("value").alias("rate"), "ts", F.col("event_id").alias("id"))


@register(f"WITH {SNAP_SQL} SELECT CAST(as_of AS VARCHAR) AS as_of, key, id, rate FROM snap")
def daily_snapshot_latest(spark, d):
    return assist.daily_snapshots(_points(spark, d)).select(F.col("as_of").cast("string").alias("as_of"), "key", "id", "rate")


@register(f"WITH {SNAP_SQL} SELECT CAST(as_of AS VARCHAR) AS as_of, key, rate, round(rate - lag(rate) OVER (PARTITION BY key ORDER BY as_of), 6) AS delta FROM snap")
def progress_lag(spark, d):
    return assist.progress(assist.daily_snapshots(_points(spark, d))).select(F.col("as_of").cast("string").alias("as_of"), "key", "rate", "delta")


@register("""WITH a AS (SELECT user_id AS key, max(event_id) AS id FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL), b AS (SELECT user_id AS key, max(event_id) AS id FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type = 'purchase' GROUP BY ALL)
SELECT key, id FROM a ANTI JOIN b USING (key) UNION ALL SELECT key, id FROM b""")
def keyed_upsert(spark, d):
    events = fx.table(spark, d, "events")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    old = events.where(F.col("ts") < cut).groupBy(F.col("user_id").alias("key")).agg(F.max("event_id").alias("id"))
    new = events.where((F.col("ts") >= cut) & (F.col("event_type") == "purchase")).groupBy(F.col("user_id").alias("key")).agg(F.max("event_id").alias("id"))
    return assist.upserted(old, new, ["key"])


@register("""WITH a AS (SELECT DISTINCT user_id AS key FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10'), b AS (SELECT DISTINCT user_id AS key FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-11')
SELECT key, 'new' AS change FROM b ANTI JOIN a USING (key) UNION ALL SELECT key, 'gone' FROM a ANTI JOIN b USING (key)""")
def snapshot_diff(spark, d):
    events = fx.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    on = lambda day: events.where(F.col("day") == F.lit(day).cast("date")).select(F.col("user_id").alias("key"))
    return corpus.drift(on("2024-01-10"), on("2024-01-11"), "key")


@register(f"""SELECT o_orderkey AS posting FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '{fx.AS_OF}' AND CAST(o_orderdate AS DATE) <= DATE '{fx.AS_OF}' + 20
AND contains(lower(o_orderpriority), 'high')""")
def live_postings(spark, d):
    rows = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("posting"), F.to_date("o_orderdate").alias("deadline"), F.col("o_orderpriority").alias("title"))
    return assist.live(rows, fx.AS_OF, 20, "high").select("posting")


@register(f"""WITH p AS (SELECT o_orderkey AS posting, o_custkey AS owner, date_diff('day', DATE '{fx.AS_OF}', CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END) AS days FROM orders)
SELECT owner, posting, days FROM p QUALIFY row_number() OVER (PARTITION BY owner ORDER BY CASE WHEN days >= 0 THEN 0 WHEN days IS NULL THEN 1 ELSE 2 END, CASE WHEN days >= 0 THEN days END, posting) = 1""")
def focus_deadline(spark, d):
    rows = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("posting"), F.col("o_custkey").alias("owner"), F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("deadline"))
    return assist.focus(rows, fx.AS_OF)


@register("""SELECT l_orderkey AS posting, l_linenumber AS pos, CAST(CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) WHEN l_returnflag = 'A' THEN CAST(o_orderdate AS DATE) - l_linenumber
 WHEN l_linenumber = 1 THEN CAST(o_orderdate AS DATE) END AS VARCHAR) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def calendar_days(spark, d):
    rows = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    label = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("D-"), "l_linenumber")).when(F.col("l_linenumber") == 1, "마감일").otherwise("")
    day = F.when(F.col("l_returnflag") == "R", F.to_date("l_shipdate"))
    tasks = rows.select(F.col("l_orderkey").alias("posting"), F.col("l_linenumber").alias("pos"), label.alias("label"), day.alias("day"), F.to_date("o_orderdate").alias("deadline"))
    return assist.calendar(tasks).select("posting", "pos", F.col("day").cast("string").alias("day"))


@register("""SELECT l_orderkey AS posting, l_linenumber AS pos, l_partkey, 'D-' || CAST(CAST(ceil(30 * (1 - CAST(row_number() OVER w - 1 AS DOUBLE) / greatest(count(*) OVER (PARTITION BY l_orderkey) - 1, 1))) AS BIGINT) AS VARCHAR) AS label
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)""")
def timeline_labels(spark, d):
    rows = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("posting"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.lit(30).alias("days"), "l_partkey")
    return assist.timeline(rows).select("posting", F.col("pos.l_linenumber").alias("pos"), "l_partkey", "label")


NAMES = ("the/of", "thing, ertion", "der die", "que", "a")
COVER_SQL = f"""
wn AS (SELECT DISTINCT conv_id AS posting, unnest({list(NAMES)!r}) AS competency FROM conversations),
tk AS (SELECT posting, competency, unnest(list_distinct(list_filter(string_split_regex(regexp_replace(lower(competency), '[/,]', ' ', 'g'), '\\s+'), lambda t: length(t) >= 2))) AS token FROM wn),
told AS (SELECT conv_id AS posting, turn AS pos, role AS question, lower(text) AS answer, text FROM conversations WHERE trim(text) <> ''),
ht AS (SELECT posting, competency, token, min(pos) AS pos FROM tk JOIN told USING (posting) WHERE contains(answer, token) GROUP BY ALL),
cv AS (SELECT wn.posting, wn.competency, count(tk.token) AS tokens, count(ht.token) AS hit, min(ht.pos) AS pos FROM wn LEFT JOIN tk USING (posting, competency) LEFT JOIN ht USING (posting, competency, token) GROUP BY ALL),
cov AS (SELECT cv.posting, competency, CASE WHEN hit = 0 THEN 'missing' WHEN hit = tokens THEN 'covered' ELSE 'partial' END AS status, cv.pos FROM cv)
"""


def _coverage(spark, d):
    talk = fx.table(spark, d, "conversations")
    wanted = talk.select(F.col("conv_id").alias("posting")).distinct().withColumn("competency", F.explode(F.array(*[F.lit(n) for n in NAMES])))
    sections = talk.select(F.col("conv_id").alias("posting"), F.col("turn").alias("pos"), F.col("role").alias("question"), F.col("text").alias("answer"))
    return assist.coverage(wanted, sections)


# The first line of the first section, with the first of the name's tokens in their order that the section has.
@register(f"""WITH {COVER_SQL},
ft AS (SELECT cov.posting, competency, status, t.question, t.text, list_filter(list_filter(string_split_regex(regexp_replace(lower(competency), '[/,]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 2), lambda x: contains(t.answer, x))[1] AS token
  FROM cov LEFT JOIN told t ON cov.posting = t.posting AND cov.pos = t.pos)
SELECT posting, competency, status, question AS section, trim(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), token))[1]) AS evidence FROM ft""")
def coverage_tokens(spark, d):
    return _coverage(spark, d)


@register(f"""WITH {COVER_SQL} SELECT posting, round(sum(i * CASE status WHEN 'covered' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END) / sum(i), 6) AS rate,
 count(*) FILTER (WHERE status = 'covered') AS covered, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'missing') AS missing
FROM (SELECT *, CAST(length(competency) AS DOUBLE) AS i FROM cov) GROUP BY posting""")
def weighted_coverage(spark, d):
    return assist.weighted_coverage(_coverage(spark, d).withColumn("importance", F.length("competency").cast("double")))


@register("WITH c AS (SELECT p_brand AS term, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT term, round(n / (SELECT max(n) FROM c), 3) AS importance FROM c")
def importance_terms(spark, d):
    counts = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return assist.importance(counts)


RUBRIC_SQL = """rb AS (SELECT l_orderkey AS rubric, l_partkey * 100 + l_linenumber AS item, CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.8 ELSE 0.6 END AS kw, l_discount AS share FROM lineitem),
rw AS (SELECT *, round(kw * (1 + coalesce(share, 0)), 3) AS raw FROM rb), wt AS (SELECT rubric, item, round(raw / sum(raw) OVER (PARTITION BY rubric), 3) AS weight FROM rw)"""


def _rubric(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", 1.0).when(F.col("l_returnflag") == "A", 0.8).otherwise(0.6)
    return persona.weights(fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rubric"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("item"), kind.alias("kind_weight"), F.col("l_discount").alias("share")))


@register(f"WITH {RUBRIC_SQL} SELECT rubric, count(*) AS items, round(sum(weight), 3) AS total, max(weight) AS top FROM wt GROUP BY rubric")
def rubric_weights(spark, d):
    return _rubric(spark, d).groupBy("rubric").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("weight"), 3).alias("total"), F.max("weight").alias("top"))


WORDS = ("ontion", "thing", "ment")
ACTION, RESULT = "tion|eux", "ing|heit|ción"
REVIEW_SQL = rf"""
it AS (SELECT conv_id AS rubric, turn AS item, text AS letter, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS experience FROM conversations),
sn AS (SELECT *, list_filter(string_split(regexp_replace(regexp_replace(letter, '([.!?。])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: length(trim(s)) >= 5 AND (contains(lower(s), 'ontion') OR contains(lower(s), 'thing') OR contains(lower(s), 'ment')))[1] AS q,
  list_filter(string_split(regexp_replace(regexp_replace(experience, '([.!?。])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: length(trim(s)) >= 5 AND (contains(lower(s), 'ontion') OR contains(lower(s), 'thing') OR contains(lower(s), 'ment')))[1] AS e FROM it),
rv AS (SELECT rubric, item, CASE WHEN q IS NULL THEN 'missing' WHEN regexp_matches(left(trim(q), 160), '{ACTION}') AND regexp_matches(left(trim(q), 160), '{RESULT}') THEN 'strong' ELSE 'weak' END AS status, e FROM sn),
rt AS (SELECT *, CASE status WHEN 'strong' THEN 'keep' WHEN 'weak' THEN 'revise' ELSE CASE WHEN e IS NULL THEN 'prepare' ELSE 'insert' END END AS todo FROM rv)
"""


def _review(spark, d):
    talk = fx.table(spark, d, "conversations").withColumn("experience", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    items = talk.select(F.col("conv_id").alias("rubric"), F.col("turn").alias("item"), F.array(*[F.lit(w) for w in WORDS]).alias("words"), F.col("text").alias("letter"), "experience")
    return persona.review(items, ACTION, RESULT)


@register(f"WITH {REVIEW_SQL} SELECT rubric, item, status, todo FROM rt")
def review_status(spark, d):
    return _review(spark, d).select("rubric", "item", "status", "todo")


@register(f"""WITH {REVIEW_SQL}, s AS (SELECT rubric, status, 1.0 / count(*) OVER (PARTITION BY rubric) AS w FROM rt)
SELECT rubric, CAST(round(100 * round(sum(w * CASE status WHEN 'strong' THEN 1.0 WHEN 'weak' THEN 0.5 ELSE 0.0 END), 6)) AS BIGINT) AS score,
 count(*) FILTER (WHERE status = 'strong') AS strong, count(*) FILTER (WHERE status = 'weak') AS weak, count(*) FILTER (WHERE status = 'missing') AS missing FROM s GROUP BY rubric""")
def review_score(spark, d):
    return persona.review_score(_review(spark, d).withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("rubric"))))


@register("SELECT conv_id AS session, role AS item, turn AS score, md5(text) AS text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1")
def interview_last_answer(spark, d):
    log = fx.table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("role").alias("item"), F.col("turn").alias("seq"), F.col("turn").alias("score"), F.md5("text").alias("text"))
    return persona.last_answers(log)


@register("""WITH h AS (SELECT o_orderpriority AS cat, o_custkey AS inst, count(*) AS have FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
r AS (SELECT o_orderpriority AS cat, o_custkey AS inst, o_orderkey AS pos, coalesce((SELECT have FROM h WHERE h.cat = o_orderpriority AND h.inst = o_custkey), 0) AS have FROM orders WHERE o_orderstatus <> 'F'),
k AS (SELECT * FROM r WHERE have < 2)
SELECT cat, inst, pos, row_number() OVER (PARTITION BY cat ORDER BY have, inst, pos) AS turn, min(pos) OVER (PARTITION BY cat) AS seen FROM k""")
def interleave_queue(spark, d):
    """A customer has orders of several priorities: what is held of one doesn't count for another."""
    orders = fx.table(spark, d, "orders").select("o_orderstatus", F.col("o_orderpriority").alias("cat"), F.col("o_custkey").alias("inst"), F.col("o_orderkey").alias("pos"))
    have = orders.where("o_orderstatus = 'F'").groupBy("cat", "inst").agg(F.count(F.lit(1)).alias("have"))
    return corpus.interleaved(orders.where("o_orderstatus <> 'F'").select("cat", "inst", "pos"), have, 2)


@register("SELECT o_custkey AS owner, o_orderkey AS posting, CAST(spent AS BIGINT) AS spent FROM (SELECT *, sum(l_n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS spent FROM orders JOIN (SELECT l_orderkey, count(*) AS l_n FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey) WHERE spent <= 20")
def budget_prefix(spark, d):
    cost = fx.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("cost"))
    rows = fx.table(spark, d, "orders").join(cost, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("posting"), "cost")
    return corpus.within_budget(rows, "owner", "posting", "cost", 20).select("owner", "posting", "spent")


@register("""WITH p AS (SELECT a.page_id AS posting, b.page_id AS ctx, contains(lower(a.url), lower(regexp_extract(b.url, '/([a-z]{2})/', 1))) AS inside, b.page_id % 3 > 0 AS skilled
  FROM pages a JOIN pages b ON regexp_extract(a.url, '^[a-z]+://([^/?#:]+)', 1) = regexp_extract(b.url, '^[a-z]+://([^/?#:]+)', 1))
SELECT posting, ctx, CASE WHEN inside AND skilled THEN 0 WHEN skilled THEN 1 WHEN inside THEN 2 ELSE 3 END AS rule FROM p QUALIFY row_number() OVER (PARTITION BY posting ORDER BY rule, ctx) = 1""")
def live_match_ranked(spark, d):
    pages = fx.table(spark, d, "pages").withColumn("host", F.parse_url("url", F.lit("HOST")))
    live = pages.select(F.col("page_id").alias("posting"), F.col("url").alias("title"), F.col("host").alias("url"))
    contexts = pages.select(F.col("page_id").alias("ctx"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("role"), (F.col("page_id") % 3).alias("skills"), F.col("host").alias("url"))
    return corpus.best_context(live, contexts)


VEC_SQL = """
mn AS (SELECT label AS node, i, avg(CAST(e AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL),
nv AS (SELECT node, list(m / norm ORDER BY i) AS nvec FROM mn JOIN (SELECT node, sqrt(sum(m * m)) AS norm FROM mn GROUP BY ALL) USING (node) GROUP BY node),
sim AS (SELECT vec_id AS sentence, node, round(list_dot_product(CAST(embedding AS DOUBLE[]), nvec), 6) AS sim FROM embeddings, nv)
"""
VECTORS = Settings(min_similarity=0.10, min_best=0.15)


def _vectors(spark, d):
    table = fx.table(spark, d, "embeddings")
    return table.select(F.col("vec_id").alias("sentence"), F.col("embedding").alias("vector")), vectors.centroids(table)


@register(f"WITH {VEC_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY sim DESC, node) AS rank, max(sim) OVER (PARTITION BY sentence) AS best FROM sim) SELECT sentence, node, rank, sim FROM r WHERE rank <= 5 AND best >= 0.15 AND sim >= 0.10")
def node_projection_topk(spark, d):
    return vectors.projection(*_vectors(spark, d), VECTORS)


@register(f"WITH {VEC_SQL}, b AS (SELECT sentence, max(sim) AS best FROM sim GROUP BY sentence) SELECT count(*) AS n, round(avg(best), 6) AS mean, round(median(best), 6) AS median, round(avg(CASE WHEN best >= 0.3 THEN 1.0 ELSE 0.0 END), 6) AS over FROM b")
def similarity_profile(spark, d):
    from matchloom.operators import evaluate

    best = vectors.nearest_nodes(*_vectors(spark, d), 1).select("sentence", F.col("sim").alias("best"))
    found = evaluate.similarity_profile(best, 0.3)
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "over")])


@register(f"WITH {VEC_SQL} SELECT sentence, max(sim) AS best FROM sim GROUP BY sentence HAVING max(sim) < 0.35")
def projection_unmatched(spark, d):
    return vectors.unmatched(*_vectors(spark, d), Settings(min_best=0.35))


@register(f"WITH {VEC_SQL} SELECT node, sentence, sim FROM sim QUALIFY row_number() OVER (PARTITION BY node ORDER BY sim DESC, sentence) = 1")
def node_proximity(spark, d):
    return vectors.proximity(*_vectors(spark, d))


@register(f"WITH {VEC_SQL}, b AS (SELECT sentence, node, sim FROM sim QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY sim DESC, node) = 1) SELECT sentence, CASE WHEN 1 - sim <= 0.65 THEN node END AS node, sim FROM b")
def cluster_tail_attach(spark, d):
    return vectors.attach_tail(*_vectors(spark, d), 0.65)


@register()
def avg_linkage(spark, d):
    return vectors.clusters(fx.table(spark, d, "embeddings"), 0.8)


@register()
def vocabulary_fit(spark, d):
    """Vectors as terms, with documents that name them; tests compare clusters with greedy merging and names with their rule."""
    table = fx.table(spark, d, "embeddings")
    terms = table.select(F.concat(F.lit("용어"), F.col("label").cast("string"), F.lit("."), F.col("vec_id").cast("string")).alias("term"), (F.col("vec_id") % 7 + 1).alias("df"), F.col("embedding"))
    return vectors.fit_vocabulary(terms, limit=0.8, tail_limit=0.9)


@register("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY CAST(ts AS DATE), event_type")
def event_days(spark, d):
    return snapshots.daily_windows(fx.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("day", F.col("day").cast("string"))


@register("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, sid""")
def event_sessions(spark, d):
    events = fx.table(spark, d, "events")
    return events.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), "n")
