"""Service look-ups, lists and sanitised rows over orders, parts, documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.operators import assist, corpus, evaluate, matching, persona, profile, serving
from matchloom.plans import fixtures as fx
from matchloom.plans import text_queries as tq
from matchloom.plans import work_queries as wq
from matchloom.plans.catalogue import register
from matchloom.plans.matching_queries import _nodes, _profiles
from matchloom.settings import TABLES, Settings
from matchloom.sources import files

TWENTY = Settings(min_nodes=3, min_effective_units=70.0, max_hhi=0.12, top_k=20)


def _joined(column):
    return F.array_join(column, "|")


@register("SELECT o_orderkey AS unit, c_name AS inst, c_mktsegment AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def unit_meta(spark, d):
    meta = fx.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("inst"), F.col("c_mktsegment").alias("segment"))
    return fx.table(spark, d, "orders").join(meta, "o_custkey", "left").select(F.col("o_orderkey").alias("unit"), "inst", "segment")


@register("SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def default_join(spark, d):
    return serving.with_default(tq.docs(spark, d).select("doc_id"), fx.table(spark, d, "labels"), ["doc_id"], {"quality": -1, "toxic": 0}).select("doc_id", "quality", "toxic")


@register("""WITH f AS (SELECT url, min(page_id) AS page FROM pages WHERE page_id % 2 = 0 GROUP BY url)
SELECT page_id AS role, url, f.page AS posting FROM pages LEFT JOIN f USING (url)""")
def roles_with_postings(spark, d):
    pages = fx.table(spark, d, "pages")
    postings = pages.where("page_id % 2 = 0").groupBy("url").agg(F.min("page_id").alias("posting"))
    return pages.join(postings, "url", "left").select(F.col("page_id").alias("role"), "url", "posting")


@register("""WITH c AS (SELECT lower(p_brand) AS low, count(*) AS n FROM part WHERE p_size > 40 GROUP BY ALL), t AS (SELECT low, round(n / (SELECT max(n) FROM c), 3) AS importance FROM c)
SELECT p_partkey, upper(p_brand) AS term, coalesce(importance, 0.5) AS importance FROM part LEFT JOIN t ON lower(p_brand) = low""")
def importance_lookup(spark, d):
    part = fx.table(spark, d, "part")
    table = assist.importance(part.where("p_size > 40").groupBy(F.col("p_brand").alias("term")).agg(F.count(F.lit(1)).alias("n")))
    return serving.importance_of(part.select("p_partkey", F.upper("p_brand").alias("term")), table)


TIER_SQL = f"""t0 AS (SELECT doc_id, source, string_split(text, chr(10))[1] AS title, {' + '.join(tq._mention_sql('text', w) for w in tq.TECHS)} AS n_tech, {tq._count_sql('text', tq.EXPRESSIONS)} AS n_expr,
  list_filter([{', '.join(f"CASE WHEN {tq._mention_sql('text', w)} = 1 THEN '{w}' END" for w in tq.TECHS)}], lambda x: x IS NOT NULL) AS techs FROM documents),
td AS (SELECT doc_id, source AS job, techs, CASE WHEN {tq._count_sql('title', tq.GROUPS)} > 0 AND n_tech < 2 AND n_expr < 5 THEN 'C' WHEN n_tech >= 2 OR n_expr >= 6 THEN 'A' WHEN n_expr >= 3 THEN 'B' ELSE 'C' END AS tier FROM t0)"""


def _tiered(spark, d):
    from matchloom.functions import text as X

    rows = tq.docs(spark, d)
    techs = F.filter(F.array(*[F.when(X.mentions(F.col("text"), t), F.lit(t)) for t in tq.TECHS]), lambda x: x.isNotNull())
    tiers = corpus.tier(tq._titled(spark, d), tq.TECHS, tq.EXPRESSIONS, tq.GROUPS).select(F.col("doc").alias("doc_id"), "tier")
    return rows.select("doc_id", F.col("source").alias("job"), techs.alias("techs")).join(tiers, "doc_id")


@register(f"WITH {TIER_SQL} SELECT doc_id, job, array_to_string(techs, '|') AS techs FROM td WHERE tier = 'A' AND len(techs) > 0 ORDER BY doc_id LIMIT 10")
def loader_limit(spark, d):
    """The loader's limit: the first ten by document."""
    return serving.loadable(_tiered(spark, d), "A", limit=10).select("doc_id", "job", _joined("techs").alias("techs"))


@register(f"WITH {TIER_SQL} SELECT doc_id, job, array_to_string(techs, '|') AS techs FROM td WHERE tier = 'A' AND job = 'src0' AND len(techs) > 0")
def loader_filter(spark, d):
    return serving.loadable(_tiered(spark, d), "A", "src0").select("doc_id", "job", _joined("techs").alias("techs"))


@register(f"WITH {TIER_SQL}, o AS (SELECT job, count(*) AS \"of\" FROM td GROUP BY job) SELECT job, tech, count(*) AS docs, any_value(\"of\") AS \"of\" FROM (SELECT job, lower(unnest(techs)) AS tech FROM td) JOIN o USING (job) GROUP BY job, tech")
def market_frequency(spark, d):
    return serving.market_frequency(_tiered(spark, d))


@register(f"""WITH {TIER_SQL}, r AS (SELECT job, count(*) AS repeated FROM (SELECT job, tech FROM (SELECT job, lower(unnest(techs)) AS tech FROM td) GROUP BY ALL HAVING count(*) >= 2) GROUP BY job)
SELECT job, count(*) AS n, count(*) FILTER (WHERE tier = 'A') AS a, coalesce(any_value(repeated), 0) AS repeated, count(*) FILTER (WHERE tier = 'A') >= 3 AND coalesce(any_value(repeated), 0) >= 3 AS ready FROM td LEFT JOIN r USING (job) GROUP BY job""")
def demo_ready(spark, d):
    return serving.demo_ready(_tiered(spark, d))


@register("SELECT doc_id, left(coalesce(trim(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'license'))[1]), ''), 120) AS line FROM documents")
def line_excerpt(spark, d):
    return tq.docs(spark, d).select("doc_id", serving.line_with(F.col("text"), F.lit("License")).alias("line"))


@register("SELECT doc_id, md5(substr(text, greatest(instr(text, 'License') - 120, 1), 2200)) AS part FROM documents")
def role_excerpt(spark, d):
    return tq.docs(spark, d).select("doc_id", F.md5(serving.excerpt(F.col("text"), F.lit("License"))).alias("part"))


@register("""SELECT o_orderkey AS posting, unnest(list_distinct(list_filter(['w/' || o_custkey, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'P' THEN '' ELSE 'w/' || (o_custkey // 2 * 2) END], lambda u: u IS NOT NULL AND u <> ''))) AS url FROM orders""")
def live_by_url(spark, d):
    key = F.col("o_custkey")
    rows = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("posting"), F.concat(F.lit("w/"), key).alias("u1"), F.when(F.col("o_orderstatus") == "F", None).when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("w/"), (F.floor(key / 2) * 2).cast("string"))).alias("u2"))
    return serving.by_either_url(rows, ["u1", "u2"]).select("posting", "url")


@register("""WITH w AS (SELECT left(n_name, 3) AS name FROM nation UNION SELECT n_name || 'X' FROM nation UNION SELECT 'zz'), k AS (SELECT n_nationkey AS pos, n_name AS label FROM nation)
SELECT w.name, arg_min(k.label, k.pos) AS match FROM w LEFT JOIN k ON starts_with(w.name, k.label) OR starts_with(k.label, w.name) GROUP BY w.name""")
def category_alignment(spark, d):
    nation = fx.table(spark, d, "nation")
    wanted = nation.select(F.left("n_name", F.lit(3)).alias("name")).union(nation.select(F.concat("n_name", F.lit("X")))).union(spark.range(1).select(F.lit("zz"))).distinct()
    return serving.aligned(wanted, nation.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("label")))


@register("""WITH u AS (SELECT p_partkey AS pos, split_part(p_name, ' ', 2) AS topic, p_brand AS code, p_name AS unit, p_type AS definition FROM part),
w AS (SELECT DISTINCT p_brand AS code, p_name AS name FROM part WHERE p_size > 45 UNION SELECT DISTINCT p_brand, split_part(p_name, ' ', 2) FROM part WHERE p_size < 3 UNION SELECT 'Brand#0', 'no·x'),
a AS (SELECT code, name, 0 AS turn, name AS topic FROM w UNION ALL SELECT code, name, i, p[i] FROM (SELECT code, name, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT code, name, list_filter(string_split_regex(name, '[·\\s/]+'), lambda x: length(x) >= 2) AS p FROM w))),
h AS (SELECT a.*, u.pos, u.unit, u.definition FROM a JOIN u USING (code, topic)),
m AS (SELECT * FROM h QUALIFY turn = min(turn) OVER (PARTITION BY code, name)),
r AS (SELECT *, row_number() OVER (PARTITION BY code, name ORDER BY pos) AS k FROM m QUALIFY k <= 10)
SELECT w.code, w.name, string_agg(unit, '|' ORDER BY k) AS names, string_agg(definition, '|' ORDER BY k) AS definitions FROM w LEFT JOIN r USING (code, name) GROUP BY ALL""")
def unit_descriptions(spark, d):
    part = fx.table(spark, d, "part")
    topic = F.split_part("p_name", F.lit(" "), F.lit(2))
    units = part.select(F.col("p_partkey").alias("pos"), topic.alias("topic"), F.col("p_brand").alias("code"), F.col("p_name").alias("unit"), F.col("p_type").alias("definition"))
    wanted = part.where("p_size > 45").select(F.col("p_brand").alias("code"), F.col("p_name").alias("name")).union(part.where("p_size < 3").select("p_brand", topic)).union(spark.range(1).select(F.lit("Brand#0"), F.lit("no·x"))).distinct()
    return serving.described(wanted, units).select("code", "name", _joined("names").alias("names"), _joined("definitions").alias("definitions"))


@register("""WITH n AS (SELECT page_id AS doc, url, row_number() OVER (PARTITION BY url ORDER BY page_id) - 1 AS nth, md5(html) AS text FROM pages),
a AS (SELECT page_id AS posting, url, page_id % 2 AS nth, 'own' || page_id AS own FROM pages)
SELECT posting, doc, coalesce(text, own) AS text FROM a LEFT JOIN n USING (url, nth)""")
def persona_document(spark, d):
    pages = fx.table(spark, d, "pages")
    asked = pages.select(F.col("page_id").alias("posting"), "url", (F.col("page_id") % 2).alias("nth"), F.concat(F.lit("own"), F.col("page_id")).alias("own_text"))
    return serving.nth_document(asked, pages.select(F.col("page_id").alias("doc"), "url", F.md5("html").alias("text")))


@register("WITH " + fx.gate_sql(4, 30.0, 0.25) + """
, top AS (SELECT code, 'N' || code AS name, units FROM kept),
per6 AS (SELECT left(code, 6) AS code, unit FROM items GROUP BY ALL), low AS (SELECT code, 'S' || code AS name, count(*) AS units FROM per6 GROUP BY code),
l AS (SELECT code, name, name AS label, units, 0 AS level, '' AS parent FROM top UNION ALL SELECT low.code, low.name, top.name || ' › ' || low.name, low.units, 1, top.name FROM low JOIN top ON left(low.code, 4) = top.code)
SELECT code, label, units, level, CASE WHEN parent <> '' THEN parent ELSE name END AS family FROM l""")
def target_list(spark, d):
    s = Settings(level=4, min_nodes=3, min_effective_units=30.0, max_hhi=0.25)
    items = fx.unit_items(spark, d)
    top = profile.gate(fx.nodes(spark, d, s), s).where("included").select("code", F.concat(F.lit("N"), "code").alias("name"), "units")
    fine = items.select("code", "unit").distinct().groupBy("code").agg(F.count(F.lit(1)).alias("units")).select("code", F.concat(F.lit("S"), "code").alias("name"), "units")
    return serving.targets(top, fine, 4).select("code", "label", "units", "level", "family")


MARKET_SQL = """mk AS (SELECT p_brand || '|' || p_name AS node, count(DISTINCT l_suppkey) AS corps FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO' GROUP BY ALL)"""


@register("WITH " + fx.ITEMS_SQL + f", {MARKET_SQL}, us AS (SELECT DISTINCT inst AS usr, node FROM items) SELECT usr AS user, node, corps, row_number() OVER (PARTITION BY usr ORDER BY corps DESC, node) AS place FROM us JOIN mk USING (node) QUALIFY place <= 5")
def market_signals(spark, d):
    lines = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "part").where("p_type = 'PROMO'"), F.col("l_partkey") == F.col("p_partkey"))
    market = lines.groupBy(F.concat_ws("|", "p_brand", "p_name").alias("node")).agg(F.countDistinct("l_suppkey").alias("corps"))
    return serving.market_signals(fx.users(fx.user_items(spark, d)), market).select("user", "node", "corps", "place")


@register("""WITH e AS (SELECT l_orderkey AS pos, l_linenumber AS i, p_brand AS corp, p_name AS role, p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT pos, count(*) AS df, count(DISTINCT corp) AS corps, 'T' || (pos % 40) AS term, CASE WHEN pos % 3 = 0 THEN 'NEW:axis' || (pos % 10) ELSE 'P' || (pos % 4) END AS parent FROM e GROUP BY pos),
m AS (SELECT *, CASE WHEN starts_with(parent, 'NEW:') THEN substr(parent, 5) ELSE term END AS name FROM n QUALIFY row_number() OVER (PARTITION BY name ORDER BY pos DESC) = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY i, corp, role) AS k FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY pos, corp ORDER BY i, role) = 1))
SELECT name, term, CASE WHEN starts_with(parent, 'NEW:') THEN '' ELSE parent END AS parent, df, corps, string_agg(corp || '/' || CASE WHEN contains(role, 'widget') THEN '' ELSE role END, ';' ORDER BY k) AS examples
FROM m JOIN f USING (pos) WHERE k <= 3 GROUP BY ALL""")
def market_meta(spark, d):
    lines = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pos = F.col("pos")
    nodes = lines.groupBy(F.col("l_orderkey").alias("pos")).agg(F.count(F.lit(1)).alias("df"), F.countDistinct("p_brand").alias("corps"), F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("p_brand").alias("corp"), F.col("p_name").alias("role")))).alias("examples"))  # an order's lines
    parent = F.when(pos % 3 == 0, F.concat(F.lit("NEW:axis"), (pos % 10).cast("string"))).otherwise(F.concat(F.lit("P"), (pos % 4).cast("string")))
    found = serving.market_meta(nodes.withColumn("term", F.concat(F.lit("T"), (pos % 40).cast("string"))).withColumn("parent", parent), "widget")
    return found.withColumn("examples", F.array_join("examples", ";"))


PRIORITY = ("Brand#7", "widget", "large")


@register("""WITH im AS (SELECT l_orderkey AS pos, 'u' || (l_orderkey // 2) AS url, (l_orderkey * 7) % 3000 AS text_len, CASE WHEN l_linenumber % 5 = 4 THEN 'data:' ELSE 'http://i/' END || l_partkey AS src, CAST(l_quantity * 20 AS BIGINT) AS w, CAST(l_discount * 40000 AS BIGINT) AS h FROM lineitem),
ti AS (SELECT l_orderkey AS pos, min(p_brand || ' ' || p_name) AS title FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
b AS (SELECT * FROM im QUALIFY row_number() OVER (PARTITION BY pos ORDER BY w * h DESC, src) = 1),
c AS (SELECT b.*, title FROM b JOIN ti USING (pos) WHERE h >= 1500 AND text_len < 1500 AND starts_with(src, 'http') QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1)
SELECT pos, url, src, h, CASE WHEN contains(title, 'Brand#7') THEN 0 WHEN contains(title, 'widget') THEN 1 WHEN contains(title, 'large') THEN 2 ELSE 3 END AS turn FROM c""")
def ocr_candidates(spark, d):
    lines = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    title = F.min(F.concat_ws(" ", "p_brand", "p_name")).over(Window.partitionBy("l_orderkey"))
    src = F.concat(F.when(F.col("l_linenumber") % 5 == 4, "data:").otherwise("http://i/"), F.col("l_partkey").cast("string"))
    images = lines.select(F.col("l_orderkey").alias("pos"), F.concat(F.lit("u"), F.floor(F.col("l_orderkey") / 2).cast("string")).alias("url"), title.alias("title"), (F.col("l_orderkey") * 7 % 3000).alias("text_len"), src.alias("src"), (F.col("l_quantity") * 20).cast("long").alias("w"), F.round(F.col("l_discount") * 40000).cast("long").alias("h"))
    return serving.ocr_candidates(images, PRIORITY)


@register("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'x-' ELSE 'user-' END || o_orderkey AS postingId, CASE WHEN o_custkey % 3 = 0 THEN '  ' ELSE c_name END AS companyName, CASE WHEN o_custkey % 7 = 0 THEN ' ' ELSE ' ' || repeat(o_orderpriority, 30) END AS positionTitle,
  CASE WHEN o_custkey % 2 = 0 THEN 'http://a.b/' ELSE 'ftp://a/' END || o_custkey AS sourceUrl, CASE WHEN o_custkey % 5 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS deadline FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT postingId, CASE WHEN trim(companyName) = '' THEN '직접 등록한 공고' ELSE trim(companyName) END AS companyName, trim(left(positionTitle, 200)) AS positionTitle, trim(left(positionTitle, 200)) AS postingTitle, '' AS jobFamily, 'a|b' AS responsibilities, '' AS requiredSkills, '' AS preferredSkills,
  CASE WHEN starts_with(sourceUrl, 'http') THEN sourceUrl ELSE '' END AS sourceUrl, CASE WHEN contains(deadline, '-') THEN deadline END AS deadline FROM r WHERE starts_with(postingId, 'user-') AND trim(positionTitle) <> ''""")
def user_posting_sanitised(spark, d):
    key = F.col("o_custkey")
    raw = fx.table(spark, d, "orders").join(fx.table(spark, d, "customer"), key == F.col("c_custkey")).select(
        F.concat(F.when(F.col("o_orderstatus") == "F", "x-").otherwise("user-"), F.col("o_orderkey").cast("string")).alias("postingId"),
        F.when(key % 3 == 0, "  ").otherwise(F.col("c_name")).alias("companyName"),
        F.when(key % 7 == 0, " ").otherwise(F.concat(F.lit(" "), F.repeat("o_orderpriority", F.lit(30)))).alias("positionTitle"),
        F.lit(None).cast("string").alias("postingTitle"), F.lit(None).cast("string").alias("jobFamily"),
        F.array(F.lit("a"), F.lit(" "), F.lit("b ")).alias("responsibilities"), F.lit(None).cast("array<string>").alias("requiredSkills"), F.expr("cast(array() as array<string>)").alias("preferredSkills"),
        F.concat(F.when(key % 2 == 0, "http://a.b/").otherwise("ftp://a/"), key.cast("string")).alias("sourceUrl"),
        F.when(key % 5 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("deadline"),
    )
    return serving.sanitised(raw).withColumns({c: _joined(c) for c in serving.POSTING_LISTS})


@register("SELECT conv_id AS posting, turn AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 6")
def history_window(spark, d):
    return serving.history_window(fx.table(spark, d, "conversations").select(F.col("conv_id").alias("posting"), F.col("turn").alias("pos")))


@register("""WITH r AS (SELECT conv_id AS id, max(CASE WHEN turn = 1 THEN text END) AS answer, list({'t': CASE WHEN turn % 4 = 3 THEN '' ELSE role || turn END, 'p': CASE WHEN turn % 2 = 0 THEN 'high' ELSE 'soon' END} ORDER BY turn) AS a, count(*) FILTER (WHERE turn % 3 = 0) AS ev FROM conversations GROUP BY conv_id)
SELECT id, md5(trim(answer)) AS answer, array_to_string(list_transform(list_slice(list_filter(a, lambda x: x.t <> ''), 1, 5), lambda x: x.t || ':' || CASE WHEN x.p = 'soon' THEN 'medium' ELSE x.p END), '|') AS actions, ev AS evidence FROM r WHERE trim(coalesce(answer, '')) <> ''""")
def agent_result(spark, d):
    talk, turn = fx.table(spark, d, "conversations"), F.col("turn")
    action = F.struct(F.when(turn % 4 == 3, "").otherwise(F.concat("role", turn.cast("string"))).alias("title"), F.lit(None).cast("string").alias("reason"), F.when(turn % 2 == 0, "high").otherwise("soon").alias("priority"))
    proof = F.struct(F.col("role").alias("source"), F.when(turn % 3 == 0, "q").alias("quote"))
    whole = talk.groupBy(F.col("conv_id").alias("id")).agg(F.max(F.when(turn == 1, F.col("text"))).alias("answer"), F.transform(F.array_sort(F.collect_list(F.struct("turn", action.alias("a")))), lambda x: x["a"]).alias("actions"), F.collect_list(proof).alias("evidence"))  # one conversation
    found = serving.agent_result(whole)
    return found.select("id", F.md5("answer").alias("answer"), _joined(F.transform("actions", lambda a: F.concat_ws(":", a["title"], a["priority"]))).alias("actions"), F.size("evidence").cast("long").alias("evidence"))


STEPS_SQL = "(VALUES (0, 1.0, '1단계'), (1, 0.65, '2단계'), (2, 0.35, '3단계'), (3, 0.0, '4단계')) v(pos, share, step)"


@register("WITH " + fx.POSTINGS_SQL + f", l AS (SELECT posting, CASE WHEN days_left >= 0 THEN days_left END AS days, pos, share, step FROM postings, {STEPS_SQL}), x AS (SELECT *, CAST(greatest(ceil(round(days * share, 9)), 0) AS BIGINT) AS n FROM l) SELECT posting, pos, CASE WHEN days IS NULL THEN step WHEN n > 0 THEN 'D-' || n ELSE '마감일' END AS label FROM x")
def fallback_actions(spark, d):
    rows = fx.postings(spark, d).select("posting", F.when(F.col("days_left") >= 0, F.col("days_left")).alias("days"))
    return serving.fallback_actions(rows).select("posting", "pos", "label")


@register("""WITH s AS (SELECT conv_id AS posting, turn AS pos, role AS question, text AS answer FROM conversations)
SELECT posting, arg_max(question, {'h': CASE WHEN contains(question, 'sys') THEN 1 ELSE 0 END, 'n': CASE WHEN contains(question, 'sys') THEN 0 ELSE length(coalesce(answer, '')) END, 'p': -pos}) AS question FROM s GROUP BY posting""")
def target_section(spark, d):
    rows = fx.table(spark, d, "conversations").select(F.col("conv_id").alias("posting"), F.col("turn").alias("pos"), F.col("role").alias("question"), F.col("text").alias("answer"))
    return serving.target_section(rows, ("sys",))


TASKS_SQL = "tk AS (SELECT o_custkey AS owner, o_orderkey AS task, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, o_orderstatus = 'F' AS done FROM orders)"


def _tasks(spark, d):
    return fx.table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("task"), F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("day"), (F.col("o_orderstatus") == "F").alias("done"))


@register(f"""WITH {TASKS_SQL}, m AS (SELECT *, coalesce(day = DATE '1998-03-02', false) AS dated FROM tk WHERE coalesce(day = DATE '1998-03-02', false) OR NOT done),
c AS (SELECT *, max(CAST(dated AS INT)) OVER (PARTITION BY owner) AS a FROM m)
SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY task) AS k, task, CASE WHEN dated THEN 'dated' ELSE 'pending' END AS source FROM c WHERE CAST(dated AS INT) = a QUALIFY k <= 4""")
def today_list(spark, d):
    return serving.today(_tasks(spark, d), "1998-03-02")


@register(f"WITH {TASKS_SQL} SELECT owner, CAST(round(100 * avg(CAST(done AS DOUBLE))) AS BIGINT) AS percent FROM tk GROUP BY owner")
def progress_percent(spark, d):
    return serving.progress_share(_tasks(spark, d))


@register("SELECT DISTINCT c_mktsegment AS job FROM customer")
def family_list(spark, d):
    return serving.families(fx.table(spark, d, "customer").select(F.col("c_mktsegment").alias("job")))


@register(f"WITH {TASKS_SQL} SELECT owner, task AS posting, row_number() OVER (PARTITION BY owner ORDER BY day NULLS LAST, task) AS place FROM tk")
def deadline_sort(spark, d):
    return serving.by_deadline(_tasks(spark, d).select("owner", F.col("task").alias("posting"), F.col("day").alias("deadline"))).select("owner", "posting", "place")


RUBRIC_ITEMS_SQL = "ri AS (SELECT l_orderkey AS rubric, l_partkey * 100 + l_linenumber AS pos, CASE l_returnflag WHEN 'R' THEN 'required' WHEN 'A' THEN 'duty' ELSE 'preferred' END AS kind, p_brand || ' ' || p_name AS quote FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _rubric_items(spark, d):
    lines = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("l_returnflag") == "R", "required").when(F.col("l_returnflag") == "A", "duty").otherwise("preferred")
    return lines.select(F.col("l_orderkey").alias("rubric"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("pos"), kind.alias("kind"), F.concat_ws(" ", "p_brand", "p_name").alias("quote"), F.array(F.lit("WIDGET"), F.lit("large"), F.lit("brand#1")).alias("techs"))


@register(f"""WITH {RUBRIC_ITEMS_SQL}, n AS (SELECT *, CAST(contains(lower(quote), 'widget') AS INT) + CAST(contains(lower(quote), 'large') AS INT) + CAST(contains(lower(quote), 'brand#1') AS INT) AS named FROM ri)
SELECT rubric, pos, kind, named, row_number() OVER (PARTITION BY rubric ORDER BY CASE kind WHEN 'required' THEN 0 WHEN 'duty' THEN 1 ELSE 2 END, named DESC, pos) AS place, left(quote, 40) AS label, quote AS jd_quote FROM n""")
def rubric_order(spark, d):
    found = serving.rubric_order(_rubric_items(spark, d))
    return found.select("rubric", "pos", "kind", "named", "place", F.left("quote", F.lit(40)).alias("label"), F.col("quote").alias("jd_quote"))


@register(f"""WITH {RUBRIC_ITEMS_SQL}, n AS (SELECT *, list_filter(['WIDGET', 'large', 'brand#1'], lambda t: contains(lower(quote), lower(t))) AS named FROM ri),
k AS (SELECT *, row_number() OVER (PARTITION BY rubric ORDER BY CASE kind WHEN 'required' THEN 0 WHEN 'duty' THEN 1 ELSE 2 END, len(named) DESC, pos) AS place, list_concat(named, list_filter(regexp_extract_all(quote, '[A-Za-z][A-Za-z0-9+#./-]+'), lambda w: length(w) >= 2)) AS ws FROM n),
f AS (SELECT *, list_filter(list_transform(ws, lambda w, i: CASE WHEN list_position(ws, w) = i THEN w END), lambda w: w IS NOT NULL)[:4] AS kw FROM k)
SELECT rubric, place, left(quote, 40) AS label, array_to_string(kw, '|') AS keywords, quote AS jd_quote,
 CASE kind WHEN 'preferred' THEN '''' || left(quote, 40) || '''와 관련해 직접 해 본 것이 있다면, 어떤 상황에서 무엇을 했는지 말씀해 주세요.' WHEN 'duty' THEN '입사하면 ''' || left(quote, 40) || ''' 업무를 맡게 됩니다. 비슷한 일을 해 본 경험과 그때 본인의 역할을 말씀해 주세요.' ELSE '''' || left(quote, 40) || '''을(를) 실제로 써 본 경험을 말씀해 주세요. 본인이 맡은 부분과 결과는 무엇이었나요?' END AS followup FROM f""")
def rubric_export(spark, d):
    found = serving.interview_export(serving.rubric_order(_rubric_items(spark, d)))
    return found.withColumn("keywords", _joined("keywords"))


# Conversations as documents, each turn's first line as a stored quote; some rubrics are of another address, some quotes not the document's.
@register(r"""WITH w AS (SELECT conv_id AS doc, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY ALL),
q AS (SELECT conv_id AS doc, CASE WHEN conv_id % 7 = 1 AND turn = 2 THEN 'never said' WHEN turn % 2 = 0 THEN '“' || string_split(text, chr(10))[1] || '”' ELSE regexp_replace(string_split(text, chr(10))[1], ' ', '  ', 'g') END AS quote FROM conversations),
v AS (SELECT q.doc, bool_and(length(c) >= 4 AND contains(trim(regexp_replace(w.text, '\s+', ' ', 'g')), c)) AS good FROM (SELECT doc, trim(regexp_replace(quote, '\s+', ' ', 'g'), ' “”') AS c FROM q) q JOIN w USING (doc) GROUP BY q.doc)
SELECT doc, doc % 5 > 0 AND doc % 3 > 0 AND coalesce(good, true) AS cached FROM w LEFT JOIN v USING (doc)""")
def rubric_cache(spark, d):
    talk = fx.table(spark, d, "conversations")
    docs = talk.groupBy(F.col("conv_id").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("text")).withColumn("url", F.concat(F.lit("u"), "doc"))  # one conversation's turns
    rubrics = docs.where("doc % 5 > 0").select("doc", F.when(F.col("doc") % 3 > 0, F.col("url")).otherwise("elsewhere").alias("url"))
    line = F.split("text", "\n")[0]
    quote = F.when((F.col("conv_id") % 7 == 1) & (F.col("turn") == 2), "never said").when(F.col("turn") % 2 == 0, F.concat(F.lit("“"), line, F.lit("”"))).otherwise(F.regexp_replace(line, " ", "  "))
    return serving.cached_rubrics(docs, rubrics, talk.select(F.col("conv_id").alias("doc"), quote.alias("jd_quote")))


@register(f"WITH {RUBRIC_ITEMS_SQL} SELECT rubric, count(*) AS items, count(*) >= 3 AS kept FROM ri GROUP BY rubric")
def rubric_batch(spark, d):
    return serving.rubric_batch(_rubric_items(spark, d))


@register(f"""WITH {wq.COVER_SQL}, j AS (SELECT posting, competency, status, CAST(length(competency) AS DOUBLE) AS i FROM cov)
SELECT posting, coalesce(round(sum(i * CASE status WHEN 'covered' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END) / sum(i), 3), 0) AS score,
 coalesce(string_agg(competency, '|' ORDER BY i, competency) FILTER (WHERE status = 'covered'), '') AS matched, coalesce(string_agg(competency, '|' ORDER BY i, competency) FILTER (WHERE status = 'partial'), '') AS partial,
 coalesce(string_agg(competency, '|' ORDER BY i, competency) FILTER (WHERE status = 'missing'), '') AS missing, count(*) AS total FROM j GROUP BY posting""")
def fit_detail(spark, d):
    judged = wq._coverage(spark, d).select("posting", F.length("competency").alias("pos"), "competency", F.length("competency").cast("double").alias("importance"), "status")
    found = serving.fit(judged)
    return found.withColumns({c: _joined(c) for c in ("matched", "partial", "missing")})


@register("WITH " + fx.ITEMS_SQL + "SELECT node AS term, count(DISTINCT unit) AS df FROM items WHERE code NOT LIKE '03%' GROUP BY node")
def vocabulary_df(spark, d):
    units = fx.unit_items(spark, d).select("unit", F.when(~F.startswith("code", F.lit("03")), F.col("code")).alias("code"), F.col("node").alias("term"))
    return serving.vocabulary(units)


@register("SELECT p_brand AS node FROM part UNION SELECT p_name FROM part WHERE NOT starts_with(p_name, 'cold') UNION SELECT p_type FROM part")
def dictionary_union(spark, d):
    part = fx.table(spark, d, "part")
    return serving.dictionary_names([part.select(F.col(c).alias("node")) for c in ("p_brand", "p_name", "p_type")], F.startswith("node", F.lit("cold")))


# Events as frames: an error has no face, a click a closed eye, a view no pose; coordinates from the value.
@register("""WITH f AS (SELECT user_id AS session, epoch_us(ts) // 1000 AS ms, event_id, event_type <> 'error' AS face, event_id % 5 < 2 AS hands, CASE WHEN event_type <> 'error' THEN CASE WHEN event_type = 'click' THEN 0.5 ELSE 0.2 END END AS blink,
  CASE WHEN event_type <> 'error' THEN (event_id % 10) / 10.0 END AS frown, event_type <> 'view' AS pose, (value % 10) / 20 + 0.2 AS lx, (value % 7) / 70 AS ly, (value % 9) / 20 + 0.4 AS rx, (value % 3) / 30 AS ry, (value % 4) / 8 AS wx, (value % 6) / 12 AS wy FROM events),
b AS (SELECT *, lag(blink > 0.45) OVER (PARTITION BY session ORDER BY ms) AS was FROM f WHERE face),
p AS (SELECT *, sqrt(pow((lx + rx) / 2 - lag((lx + rx) / 2) OVER w, 2) + pow((ly + ry) / 2 - lag((ly + ry) / 2) OVER w, 2)) AS body, sqrt(pow(wx - lag(wx) OVER w, 2) + pow(wy - lag(wy) OVER w, 2)) AS arm FROM f WHERE pose WINDOW w AS (PARTITION BY session ORDER BY ms)),
fb AS (SELECT session, count(*) AS faces, count(*) FILTER (WHERE blink > 0.45 AND NOT coalesce(was, false)) AS blinks, count(*) FILTER (WHERE frown > 0.45) AS frowns FROM b GROUP BY session),
pb AS (SELECT session, count(*) AS poses, count(*) FILTER (WHERE body > 0.035) AS body_moves, count(*) FILTER (WHERE arm > 0.05) AS arm_moves, count(*) FILTER (WHERE abs(ly - ry) > 0.055) AS tilts, count(*) FILTER (WHERE abs((lx + rx) / 2 - 0.5) > 0.22) AS offs FROM p GROUP BY session),
a AS (SELECT session, count(*) AS frames, max(ms) - min(ms) AS ms, (max(ms) - min(ms)) / 1000 AS seconds, count(*) FILTER (WHERE hands) AS hands, count(*) FILTER (WHERE event_id % 4 = 0) AS gestures FROM f GROUP BY session)
SELECT session, frames, floor((ms + 5) / 10) / 100 AS seconds, round(coalesce(frames / nullif(seconds, 0), 0), 2) AS fps, round(coalesce(faces, 0) / frames, 3) AS face_rate, round(hands / frames, 3) AS hand_rate, round(coalesce(poses, 0) / frames, 3) AS pose_rate, coalesce(blinks, 0) AS blinks,
  round(coalesce(frowns / faces, 0), 3) AS frown_rate, coalesce(body_moves, 0) AS body_moves, coalesce(arm_moves, 0) AS arm_moves, round(coalesce(tilts / poses, 0), 3) AS tilt_rate, round(coalesce(offs / poses, 0), 3) AS off_centre_rate, gestures
FROM a LEFT JOIN fb USING (session) LEFT JOIN pb USING (session)""")
def frame_metrics(spark, d):
    events = fx.table(spark, d, "events")
    face, pose, value = F.col("event_type") != "error", F.col("event_type") != "view", F.col("value")
    point = lambda x, y: F.when(pose, F.struct(x.alias("x"), y.alias("y")))
    frames = events.select(
        F.col("user_id").alias("session"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), face.alias("face"), (F.col("event_id") % 5 < 2).alias("hands"), F.when(face, F.when(F.col("event_type") == "click", 0.5).otherwise(0.2)).alias("blink"),
        F.when(face, F.col("event_id") % 10 / 10).alias("frown"), point(value % 10 / 20 + 0.2, value % 7 / 70).alias("left"), point(value % 9 / 20 + 0.4, value % 3 / 30).alias("right"), point(value % 4 / 8, value % 6 / 12).alias("wrists"), F.when(F.col("event_id") % 4 == 0, "wave").alias("gesture"),
    )
    return serving.frame_metrics(frames)


@register("WITH " + fx.gate_sql() + "SELECT code, units, CAST(ceil(greatest(90 - effective_units, 0) / 8) AS BIGINT) AS needed_institutions, row_number() OVER (ORDER BY ceil(greatest(90 - effective_units, 0) / 8) DESC, code) AS place FROM gate WHERE NOT (effective_units >= 70 AND hhi < 0.12)")
def collection_plan(spark, d):
    return serving.collection_plan(evaluate.coverage_report(_nodes(spark, d), TABLES, 90)).select("code", "units", "needed_institutions", "place")


@register("SELECT o_orderkey AS posting, o_custkey AS owner FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def known_keys_left_out(spark, d):
    wanted = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("posting"), F.col("o_custkey").alias("owner"))
    cached = fx.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("posting"))
    return files.missing_keys(wanted, cached, ["posting"])


@register("""WITH d AS (SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, n_name AS description FROM nation WHERE n_nationkey % 2 = 0),
c AS (SELECT DISTINCT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code FROM nation) SELECT code, description FROM c LEFT JOIN d USING (code)""")
def description_lookup(spark, d):
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    nation = fx.table(spark, d, "nation").withColumn("code", F.concat(two("n_regionkey"), two("n_nationkey")))
    known = nation.where("n_nationkey % 2 = 0").select("code", F.col("n_name").alias("description"))
    return nation.select("code").distinct().join(known, "code", "left")


@register(f"WITH {wq.REVIEW_SQL}, w AS (SELECT *, round(((item * 7) % 5) / 10.0, 1) AS weight FROM rt) SELECT rubric, item, status, row_number() OVER (PARTITION BY rubric ORDER BY CASE status WHEN 'strong' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END, weight DESC, item) AS place FROM w")
def weakest_items(spark, d):
    rows = wq._review(spark, d).withColumn("weight", F.round(F.col("item") * 7 % 5 / 10, 1))
    return persona.weakest(rows).select("rubric", "item", "status", "place")


@register(wq.WITH_POSTINGS + ", l AS (SELECT posting, owner, days_left, rate, row_number() OVER (PARTITION BY owner ORDER BY days_left, rate, posting) AS place FROM postings WHERE days_left BETWEEN 0 AND 1 AND rate < 1) SELECT * FROM l")
def urgent_list(spark, d):
    return assist.urgent(fx.postings(spark, d)).select("posting", "owner", "days_left", "rate", "place")


@register("""SELECT o_orderkey AS posting FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE (o_orderstatus = 'P' OR (CAST(o_orderdate AS DATE) >= DATE '1998-01-01' AND CAST(o_orderdate AS DATE) <= DATE '1998-03-02')) AND c_mktsegment = 'MACHINERY' AND n_regionkey = 2""")
def live_postings_filtered(spark, d):
    nation = F.broadcast(fx.table(spark, d, "nation"))
    rows = fx.table(spark, d, "orders").join(fx.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    postings = rows.select(F.col("o_orderkey").alias("posting"), F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("deadline"), F.col("c_mktsegment").alias("job"), F.array(F.lpad(F.col("n_regionkey").cast("string"), 2, "0")).alias("majors"), F.lit("").alias("title"))
    return assist.live(postings, "1998-01-01", within=60, job="MACHINERY", major="020199").select("posting")


@register("WITH " + fx.gate_sql() + "SELECT code, units, units >= 60 AS included FROM gate")
def profile_gate_fine(spark, d):
    s = Settings(min_nodes=3, min_units=60)
    return profile.gate(_nodes(spark, d), s).select("code", "units", "included")


@register("WITH " + fx.ITEMS_SQL + ", us AS (SELECT DISTINCT inst AS usr, node FROM items) SELECT usr AS user, count(*) AS nodes FROM us GROUP BY usr HAVING count(*) >= 30")
def query_minimum(spark, d):
    return evaluate.enough_nodes(fx.users(fx.user_items(spark, d)), 30).groupBy("user").agg(F.count(F.lit(1)).alias("nodes"))


@register("WITH " + fx.scores_sql() + """
, raw AS (SELECT code, node, item, unit FROM items SEMI JOIN prof USING (code, node)),
ev AS (SELECT code, node, item, row_number() OVER (PARTITION BY code, node ORDER BY count(*) DESC, min(unit), item) AS rank FROM raw GROUP BY code, node, item QUALIFY rank <= 2),
qt AS (SELECT code, node, string_agg(CAST(item AS VARCHAR), '|' ORDER BY rank) AS quotes FROM ev GROUP BY ALL),
w AS (SELECT usr, prof.* FROM (SELECT DISTINCT inst AS usr, code FROM items) tg JOIN prof USING (code)),
st AS (SELECT inst AS usr, node, unit, item, round(1 - 1.0 / (1 + count(*)), 6) AS sim FROM items WHERE item % 7 <> 0 GROUP BY ALL),
sd AS (SELECT usr, node, unit || ':' || item AS sentence, sim FROM st QUALIFY row_number() OVER (PARTITION BY usr, node ORDER BY sim DESC, unit || ':' || item) = 1),
have AS (SELECT usr, code, 'have' AS side, row_number() OVER (PARTITION BY usr, code ORDER BY round(weight, 9) DESC, node) AS place, node, full_df FROM w SEMI JOIN sd USING (usr, node)),
lack AS (SELECT usr, code, 'lack' AS side, row_number() OVER (PARTITION BY usr, code ORDER BY full_df DESC, node) AS place, node, full_df FROM w ANTI JOIN us USING (usr, node) QUALIFY place <= 10)
SELECT usr AS user, code, side, place, node, full_df, quotes, sentence, sim, n_name AS description FROM (FROM have UNION ALL FROM lack) JOIN qt USING (code, node) LEFT JOIN sd USING (usr, node) LEFT JOIN nation ON lpad(CAST(n_nationkey AS VARCHAR), 2, '0') = substr(code, 3, 2)""")
def compare_quoted(spark, d):
    items = fx.user_items(spark, d)
    profiles = _profiles(spark, d)
    proofs = fx.evidence(spark, d, TABLES)
    mine = fx.unit_items(spark, d).where("item % 7 <> 0").repartition("inst", "node").groupBy(F.col("inst").alias("user"), "node", "unit", "item").agg(F.round(1 - 1 / (1 + F.count(F.lit(1))), 6).alias("sim"))
    said = mine.select("user", "node", F.concat_ws(":", F.col("unit").cast("string"), F.col("item").cast("string")).alias("sentence"), "sim")
    named = fx.table(spark, d, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("nation"), F.col("n_name").alias("description"))
    about = profiles.select("code").distinct().withColumn("nation", F.substring("code", 3, 2)).join(named, "nation")
    found = matching.compare(fx.users(items), fx.home(items), profiles, proofs, about, said=said)
    return found.withColumn("quotes", _joined(F.col("quotes").cast("array<string>")))


@register("""SELECT p_partkey AS doc, place, kind, quote AS jd_quote FROM part, LATERAL (VALUES
 (1, 'required', p_name || ' SQL 개발'), (2, 'required', '통계 지식'), (3, 'duty', p_brand || ' 운영'), (4, 'duty', p_type || ' 설계 (A, B)'), (5, 'preferred', '영어 회화')) v(place, kind, quote)""")
def rubric_heuristic(spark, d):
    text = F.concat(F.lit("회사 소개\n자격요건\n[필수] 통계 지식\n2. "), F.col("p_name"), F.lit(" SQL 개발, 병역 필\n담당업무: "), F.col("p_brand"), F.lit(" 운영 / "), F.col("p_type"), F.lit(" 설계 (A, B)\n우대사항\n영어 회화\n\n영어 회화\n"))
    docs = fx.table(spark, d, "part").select(F.col("p_partkey").alias("doc"), text.alias("text"), F.array(F.lit("sql")).alias("techs"))
    return persona.rubric_items(docs).select("doc", "place", "kind", "jd_quote")


@register("""SELECT p_partkey AS doc, CASE WHEN p_size < 10 THEN repeat('long ', 120) ELSE 'short' || chr(10) || repeat(p_brand || ' ', 8) END AS text FROM part""")
def page_script_text(spark, d):
    from matchloom.functions import text as X

    brand = F.repeat(F.concat("p_brand", F.lit(" ")), F.lit(8))
    script = F.concat(F.lit('<script>var x = {"a": "'), brand, F.lit('", "b": "tiny", "c": "'), brand, F.lit('"};</script>'))
    html = F.concat(F.lit("<p>"), F.when(F.col("p_size") < 10, F.repeat(F.lit("long "), F.lit(120))).otherwise(F.lit("short")), F.lit("</p>"), script)
    text = X.page_text(html, "[A-Za-z]")
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.when(F.col("p_size") < 10, F.concat(F.btrim(text), F.lit(" "))).otherwise(F.concat(text, F.lit(" "))).alias("text"))


@register("SELECT p_partkey AS doc, CASE WHEN p_brand = 'Brand#1' THEN 'first' WHEN p_brand = 'Brand#2' THEN 'second' ELSE p_brand END AS term FROM part")
def term_alias(spark, d):
    alias = spark.createDataFrame([("brand#1", "first"), ("brand#2", "second")], "low string, name string")
    return corpus.renamed(fx.table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.col("p_brand").alias("term")), alias)
