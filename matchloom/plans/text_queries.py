"""Text, corpus and taxonomy operators over documents, pages and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import text as X
from matchloom.operators import corpus, taxonomy
from matchloom.plans import fixtures as fx
from matchloom.plans.catalogue import register

# Stand-ins for the Korean word lists on tables of invented prose.
CORE, AUX = ("oftheand", "tionthe", "andthe", "dela", "dela,", "undder"), ("thing", "ment", "heit", "ción", "eux", "tion")
RULES = (
    ("english", ("the", "and", "with", "thing", "that")),
    ("french", ("les", "est", "une", "dans", "pour")),
    ("german", ("und", "der", "nicht", "ein", "mit")),
    ("spanish", ("del", "las", "por", "con", "los")),
)
TECHS, EXPRESSIONS, GROUPS = ("token", "com", "License", "MIT", "scum", "R"), ("tion", "ment", "heit", "ción", "ing", "eau", "keit", "que"), ("On", "La", "De")
SIGNAL, NOISE, TAIL = "tion|ment|heit|ción", "token|[Ll]icense|@", "(?:ing|ed|er|tion|eux|ung|do)\\s*$"


def docs(spark, d):
    return fx.table(spark, d, "documents")


def _sql_list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _count_sql(text, words):
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words) + ")"


def _mention_sql(text, word):
    tail = "[^A-Za-z0-9&]" if word == "R" else "[^A-Za-z0-9]"
    return f"CAST(regexp_matches({text}, '(^|[^A-Za-z0-9]){word}({tail}|$)') AS INT)"


PLAIN = "regexp_replace(text, '\\s+', '', 'g')"


@register(f"""SELECT doc_id, CASE WHEN c >= 2 THEN greatest(4, c + a) ELSE c + a END AS score FROM (
  SELECT doc_id, {_count_sql('p', CORE)} AS c, {_count_sql('p', AUX)} AS a FROM (SELECT doc_id, {PLAIN} AS p FROM documents))""")
def signal_score(spark, d):
    return docs(spark, d).select("doc_id", X.page_score(F.col("text"), CORE, AUX).alias("score"))


@register(f"SELECT doc_id, {_count_sql('text', AUX)} AS signals FROM documents")
def signal_count(spark, d):
    return docs(spark, d).select("doc_id", X.count_contained(F.col("text"), AUX).alias("signals"))


@register(f"""SELECT source, lang, count(*) AS docs, CAST(sum(CASE WHEN CASE WHEN lang = 'fr' THEN n_chars >= 200 ELSE n_chars >= 1500 OR (n_chars >= 500 AND {_count_sql('text', AUX)} >= 4) END THEN 1 ELSE 0 END) AS BIGINT) AS usable
FROM documents GROUP BY ALL""")
def usable_postings(spark, d):
    ok = X.usable(F.lit("ok"), F.when(F.col("lang") == "fr", "ocr").otherwise("html"), F.col("n_chars"), X.count_contained(F.col("text"), AUX))
    return docs(spark, d).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if(ok).alias("usable"))


PIECES_SQL = r"""
pc AS (SELECT doc_id, i, trim(regexp_replace(p[i], '\s+', ' ', 'g'), ' .,·•-–—()[]') AS s FROM (
  SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '[\n·•○●▪□■]\s*') AS p FROM documents)))
"""


@register(f"WITH {PIECES_SQL} SELECT doc_id, count(*) AS n, string_agg(s, '|' ORDER BY i) AS found FROM pc WHERE length(s) BETWEEN 8 AND 90 AND regexp_matches(s, '[A-Za-z]') AND regexp_matches(s, '{SIGNAL}') AND NOT regexp_matches(s, '{NOISE}') GROUP BY doc_id")
def requirement_sentences(spark, d):
    found = docs(spark, d).select("doc_id", X.requirement_sentences(F.col("text"), SIGNAL, NOISE, "[A-Za-z]").alias("s")).where("size(s) > 0")
    return found.select("doc_id", F.size("s").cast("long").alias("n"), F.array_join("s", "|").alias("found"))


@register(f"""WITH {PIECES_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, regexp_replace(s, '\\s+', '', 'g') ORDER BY i) AS k FROM pc
  WHERE length(s) BETWEEN 12 AND 60 AND regexp_matches(s, '[A-Za-z]') AND regexp_matches(s, '{TAIL}') AND NOT regexp_matches(s, '{NOISE}'))
SELECT doc_id, count(*) AS n, string_agg(s, '|' ORDER BY i) AS found FROM g WHERE k = 1 GROUP BY doc_id""")
def duty_sentences(spark, d):
    found = docs(spark, d).select("doc_id", X.duty_sentences(F.col("text"), TAIL, NOISE, "[A-Za-z]").alias("s")).where("size(s) > 0")
    return found.select("doc_id", F.size("s").cast("long").alias("n"), F.array_join("s", "|").alias("found"))


@register(r"""SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS found FROM (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?\n·•]+'), lambda x: trim(x, ' -·,')), lambda x: length(x) >= 6) AS s FROM documents)""")
def sentence_split(spark, d):
    return docs(spark, d).select("doc_id", X.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("found"))


def _classify_sql():
    rows = []
    for i, (name, words) in enumerate(RULES):
        score = " + ".join(f"10 * {_mention_sql('title', w)} + {_mention_sql('body', w)}" for w in words)
        rows.append(f"SELECT doc_id, {score} AS score, {i} AS pos, '{name}' AS job FROM t")
    return f"""WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, text AS body FROM documents), s AS ({' UNION ALL '.join(rows)})
SELECT doc_id, CASE WHEN score >= 2 THEN job ELSE 'none' END AS job, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) = 1"""


def _titled(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("doc"), F.split("text", "\n")[0].alias("title"), "text")


@register(_classify_sql())
def job_classify(spark, d):
    return corpus.classify(_titled(spark, d), RULES, "none", body_chars=None).withColumnRenamed("doc", "doc_id")


@register(f"""WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, {' + '.join(_mention_sql('text', w) for w in TECHS)} AS n_tech, {_count_sql('text', EXPRESSIONS)} AS n_expr FROM documents)
SELECT doc_id, n_tech, n_expr, CASE WHEN {_count_sql('title', GROUPS)} > 0 AND n_tech < 2 AND n_expr < 5 THEN 'C' WHEN n_tech >= 2 OR n_expr >= 6 THEN 'A' WHEN n_expr >= 3 THEN 'B' ELSE 'C' END AS tier FROM t""")
def tier_abc(spark, d):
    return corpus.tier(_titled(spark, d), TECHS, EXPRESSIONS, GROUPS).select(F.col("doc").alias("doc_id"), "n_tech", "n_expr", "tier")


@register("SELECT unnest(" + _sql_list(TECHS) + ") AS term, unnest([" + ", ".join(f"(SELECT CAST(sum({_mention_sql('text', w)}) AS BIGINT) FROM documents)" for w in TECHS) + "]) AS docs")
def term_presence(spark, d):
    return corpus.term_counts(docs(spark, d), TECHS)


BOILER_SQL = """
l AS (SELECT DISTINCT source AS dom, doc_id, trim(x) AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE length(trim(x)) > 0 AND length(trim(x)) < 60),
sz AS (SELECT source AS dom, count(*) AS docs FROM documents GROUP BY ALL HAVING count(*) >= 3),
bp AS (SELECT dom, line, count(*) AS n, docs FROM l JOIN sz USING (dom) GROUP BY ALL HAVING count(*) >= 0.02 * docs)
"""


def _boiler(spark, d):
    rows = docs(spark, d).select(F.col("source").alias("dom"), F.col("doc_id").alias("doc"), "text")
    return rows, corpus.boilerplate(rows, share=0.02)


@register(f"WITH {BOILER_SQL} SELECT * FROM bp")
def boilerplate_lines(spark, d):
    return _boiler(spark, d)[1]


@register(f"""WITH {BOILER_SQL}, x AS (SELECT dom, doc_id, i, p[i] AS line FROM (SELECT source AS dom, doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT source, doc_id, string_split(text, chr(10)) AS p FROM documents))),
k AS (SELECT x.* FROM x LEFT JOIN bp ON x.dom = bp.dom AND trim(x.line) = bp.line WHERE bp.line IS NULL)
SELECT d.doc_id, md5(coalesce(string_agg(k.line, chr(10) ORDER BY i), '')) AS clean FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id""")
def boilerplate_stripped(spark, d):
    rows, boiler = _boiler(spark, d)
    return corpus.stripped(rows, boiler).select(F.col("doc").alias("doc_id"), F.md5("clean").alias("clean"))


@register("SELECT doc_id, source, md5(left(text, 300)) AS head FROM documents QUALIFY row_number() OVER (PARTITION BY source, left(text, 300) ORDER BY doc_id) = 1")
def dedupe_first_seen(spark, d):
    rows = docs(spark, d).withColumn("head", F.left("text", F.lit(300)))
    return corpus.first_seen(rows, ["source", "head"], ["doc_id"]).select("doc_id", "source", F.md5("head").alias("head"))


@register("""SELECT seq, src, doc_id, len FROM (SELECT doc_id // 3 AS seq, CASE WHEN lang = 'de' THEN 'ocr' WHEN doc_id % 2 = 0 THEN 'html' ELSE 'api' END AS src, doc_id, n_chars AS len FROM documents)
QUALIFY row_number() OVER (PARTITION BY seq ORDER BY CASE WHEN src = 'ocr' THEN 0 ELSE 1 END, len DESC, src, doc_id) = 1""")
def corpus_merge_priority(spark, d):
    src = F.when(F.col("lang") == "de", "ocr").when(F.col("doc_id") % 2 == 0, "html").otherwise("api")
    rows = docs(spark, d).select(F.floor(F.col("doc_id") / 3).alias("seq"), src.alias("src"), "doc_id", F.col("n_chars").alias("len"))
    return corpus.merged(rows, "doc_id").select("seq", "src", "doc_id", "len")


TERMS_SQL = "tm AS (SELECT DISTINCT doc_id AS doc, source AS corp, unnest(regexp_extract_all(text, '[A-Z][a-z]{6,}')) AS term FROM documents)"
BLOCKED = ("ontion", "therthe", "ertion")


def _terms(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("doc"), F.col("source").alias("corp"), F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{6,})"), 1)).alias("term"))


def _known(spark, d):
    return fx.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{6,})"), 1)).alias("term")).distinct()


@register(f"""WITH {TERMS_SQL}, kn AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{{6,}}')) AS term FROM benchmark),
c AS (SELECT term, count(*) AS df, count(DISTINCT corp) AS corps, array_to_string(list_slice(list_sort(list(doc)), 1, 3), ',') AS examples FROM tm GROUP BY term)
SELECT term, df, corps, examples, CASE WHEN df < 3 THEN 'rare' WHEN corps < 2 THEN 'narrow' WHEN kn.term IS NOT NULL THEN 'known' WHEN lower(term) IN ('ontion', 'therthe', 'ertion') THEN 'blocked' ELSE 'kept' END AS reason FROM c LEFT JOIN kn USING (term)""")
def ext_node_attrition(spark, d):
    found = corpus.attrition(corpus.candidates(_terms(spark, d)), _known(spark, d), BLOCKED, 3, 2)
    return found.select("term", "df", "corps", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"), "reason")


@register(f"""WITH {TERMS_SQL}, a AS (SELECT DISTINCT term FROM tm WHERE corp = 'src0'), b AS (SELECT DISTINCT term FROM tm WHERE corp <> 'src0')
SELECT term, 'new' AS change FROM b ANTI JOIN a USING (term) UNION ALL SELECT term, 'gone' FROM a ANTI JOIN b USING (term)""")
def drift_new_gone(spark, d):
    terms = _terms(spark, d)
    return corpus.drift(terms.where("corp = 'src0'").select("term"), terms.where("corp <> 'src0'").select("term"), "term")


@register("SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, count(*) AS pages, count(DISTINCT url) AS urls FROM pages WHERE NOT contains(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), 'blog') GROUP BY ALL")
def domain_counts(spark, d):
    pages = fx.table(spark, d, "pages").withColumn("host", F.parse_url("url", F.lit("HOST")))
    return pages.where(~F.contains("host", F.lit("blog"))).groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("url").alias("urls"))


def _html_sql():
    t = "html"
    for tag in ("script", "style", "noscript", "svg"):
        t = f"regexp_replace({t}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', chr(10), 'g')"
    for name, mark in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        t = f"replace({t}, '{name}', {mark})"
    return f"trim(regexp_replace(regexp_replace({t}, '[ \\t\u00a0]+', ' ', 'g'), '\\n\\s*\\n+|\\n{{2,}}', chr(10), 'g'), ' ' || chr(10))"


@register(f"SELECT page_id, md5({_html_sql()}) AS text FROM pages")
def html_text(spark, d):
    return fx.table(spark, d, "pages").select("page_id", F.md5(X.html_text(F.col("html"))).alias("text"))


@register("SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'es') AS es, count(*) AS total FROM documents GROUP BY ALL")
def pivot_source_lang(spark, d):
    rows = docs(spark, d)
    wide = rows.groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).count().fillna(0)
    return wide.join(rows.groupBy("source").agg(F.count(F.lit(1)).alias("total")), "source")


@register("SELECT quality, toxic, count(*) AS docs, round(avg(n_chars), 6) AS mean_chars, round(quantile_cont(n_chars, 0.5), 6) AS median_chars, round(avg(CASE WHEN n_chars >= 1500 THEN 1.0 ELSE 0.0 END), 6) AS long_share FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def label_distribution(spark, d):
    rows = fx.table(spark, d, "labels").join(docs(spark, d), "doc_id")
    return rows.groupBy("quality", "toxic").agg(
        F.count(F.lit(1)).alias("docs"),
        F.round(F.avg("n_chars"), 6).alias("mean_chars"),
        F.round(F.percentile("n_chars", F.lit(0.5)), 6).alias("median_chars"),
        F.round(F.avg((F.col("n_chars") >= 1500).cast("double")), 6).alias("long_share"),
    )


@register("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'license') AND contains(lower(text), 'version')")
def and_terms_search(spark, d):
    return docs(spark, d).where(X.all_terms(F.col("text"), F.lit("the  License version"))).select("doc_id")


PREV_SQL = "pv AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"


def _turns(spark, d):
    from pyspark.sql import Window

    return fx.table(spark, d, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")


@register(rf"""WITH {PREV_SQL}, w AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[\pL\pN_]{{2,}}') AS a, regexp_extract_all(lower(before), '[\pL\pN_]{{2,}}') AS b FROM pv WHERE before IS NOT NULL)
SELECT conv_id, turn, length(text) >= 6 AND len(a) > 0 AND 2 * len(list_filter(a, lambda x: list_contains(b, x))) >= len(a) AS grounded FROM w""")
def grounded_turns(spark, d):
    return _turns(spark, d).select("conv_id", "turn", X.grounded(F.col("text"), F.col("before")).alias("grounded"))


# Own and foreign first sentences, bare and in several kinds of quotation marks; some too short once the marks are off.
@register(rf"""WITH {PREV_SQL}, w AS (SELECT conv_id, turn, trim(regexp_replace(before, '\s+', ' ', 'g')) AS s,
  unnest([(0, regexp_extract(text, '^[^.!?\n]*')), (1, regexp_extract(before, '^[^.!?\n]*')), (2, regexp_extract(before, '^[^.!?\n]*')), (3, left(regexp_extract(before, '^[^.!?\n]*'), 3))]) AS x FROM pv WHERE before IS NOT NULL),
v AS (SELECT conv_id, turn, x[1] AS kind, s, trim(regexp_replace(x[2], '\s+', ' ', 'g')) AS q FROM w)
SELECT conv_id, turn, kind, length(q) >= 4 AND contains(s, q) AS verified FROM v""")
def quotes_verified(spark, d):
    first = lambda c: F.regexp_extract(c, r"^[^.!?\n]*", 0)
    told = [first("text"), F.concat(F.lit("“"), first("before"), F.lit("”")), F.concat(F.lit(" '\""), first("before"), F.lit("\u200b\"’")), F.concat(F.lit("‘"), F.left(first("before"), F.lit(3)), F.lit("’"))]
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), q.alias("quote")) for i, q in enumerate(told)]))
    return _turns(spark, d).select("conv_id", "turn", "before", kinds.alias("x")).select("conv_id", "turn", "x.kind", X.quote_verified(F.col("x.quote"), F.col("before")).alias("verified"))


@register("""WITH ix AS (SELECT n_nationkey AS pos, lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, n_name AS iname FROM nation),
nm AS (SELECT n_name AS name, '' AS under FROM nation UNION SELECT 'X' || substr(n_name, 2), '' FROM nation UNION SELECT n_name, lpad(CAST((n_regionkey + 1) % 5 AS VARCHAR), 2, '0') FROM nation),
m AS (SELECT name, under, code, pos, CASE WHEN name = iname THEN 0 ELSE 1 END AS how FROM nm JOIN ix ON starts_with(code, under) AND (name = iname OR (length(name) = length(iname) AND length(name) >= 5 AND levenshtein(name, iname) <= 1))),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY name, under ORDER BY how, pos) = 1)
SELECT nm.name, nm.under, f.code, f.how FROM nm LEFT JOIN f ON nm.name = f.name AND nm.under = f.under""")
def taxonomy_fuzzy_name(spark, d):
    nation = fx.table(spark, d, "nation")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    index = nation.select(F.col("n_nationkey").alias("pos"), F.concat(two(F.col("n_regionkey")), two(F.col("n_nationkey"))).alias("code"), F.col("n_name").alias("index_name"))
    same = nation.select(F.col("n_name").alias("name"), F.lit("").alias("under"))
    typo = nation.select(F.concat(F.lit("X"), F.substr("n_name", F.lit(2))), F.lit(""))
    other = nation.select("n_name", two((F.col("n_regionkey") + 1) % 5))
    return taxonomy.lookup(same.union(typo).union(other).distinct(), index)


@register("""WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS pos, p_type AS code FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT doc, code, count(*) AS votes, min(pos) AS first FROM c GROUP BY doc, code QUALIFY row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, min(pos), code) = 1""")
def taxonomy_vote(spark, d):
    part = fx.table(spark, d, "part").select("p_partkey", "p_type")
    cells = fx.table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.col("p_type").alias("code"))
    return taxonomy.vote(cells)


@register("WITH " + fx.CODES_SQL + ", c AS (SELECT DISTINCT code FROM codes) SELECT code, k AS level, left(code, k) AS prefix FROM c, (VALUES (2), (4), (6)) v(k)")
def taxonomy_levels(spark, d):
    return taxonomy.levels(fx.codes(spark, d).select("code").distinct())


@register("SELECT r_name AS key, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def taxonomy_export(spark, d):
    pairs = fx.table(spark, d, "nation").join(fx.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("key"), F.col("n_name").alias("value"))
    return taxonomy.inverted(pairs, "key", "value").select("key", F.array_join("values", ",").alias("names"))


# Customers' classification tables in eight layouts, over regions, nations, segments and (nation, segment) as the four levels.
_TAX_SQL = """
seg AS (SELECT m, lpad(CAST(row_number() OVER (ORDER BY m) AS VARCHAR), 2, '0') AS s FROM (SELECT DISTINCT c_mktsegment AS m FROM customer)),
rn AS (SELECT lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS rr, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS nn, '가' || r_name AS rname, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey),
tax AS (SELECT DISTINCT rr AS code, rname AS name FROM rn UNION ALL SELECT rr || nn, n_name FROM rn UNION ALL SELECT rr || nn || s, m FROM rn, seg UNION ALL SELECT rr || nn || s || '01', n_name || ' ' || m FROM rn, seg WHERE n_nationkey % 2 = 0),
doc AS (SELECT c_custkey AS doc, CASE c_custkey % 8
  WHEN 0 THEN rr || '. ' || rname || chr(10) || n_name || chr(10) || m WHEN 1 THEN rname || chr(10) || m || chr(10) || m
  WHEN 2 THEN '대분류' || chr(10) || rr || chr(10) || '중분류' || chr(10) || n_name WHEN 3 THEN '대분류' || chr(10) || '중 분류' || chr(10) || rr || ' x' || chr(10) || 'Q' || substr(n_name, 2)
  WHEN 4 THEN 'unknown cells' || chr(10) || 'of ' || rr WHEN 5 THEN ' 대 분 류 ' || chr(10) || rr || chr(10) || 'more'
  WHEN 6 THEN '01. ' || n_name || ' ' || m || chr(10) || chr(10) || m || chr(10) || n_name ELSE '' END AS region,
  CASE WHEN c_custkey % 3 = 0 THEN rname END AS hint FROM customer JOIN rn ON c_nationkey = n_nationkey JOIN seg ON c_mktsegment = m)"""


@register("WITH " + _TAX_SQL + r""",
k AS (SELECT code, length(code) AS level, regexp_replace(name, '[·․‧∙・･ㆍ⋅ž,]|\s', '', 'g') AS key FROM tax),
c AS (SELECT doc, i - 1 AS i, cell, regexp_replace(regexp_replace(cell, '^\s*\d{2}\s*[.．·:]?\s*', ''), '[·․‧∙・･ㆍ⋅ž,]|\s', '', 'g') AS key, lead(cell) OVER (PARTITION BY doc ORDER BY i) AS nxt
  FROM (SELECT doc, unnest(cs) AS cell, generate_subscripts(cs, 1) AS i FROM (SELECT doc, list_filter(list_transform(string_split(region, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS cs FROM doc))),
h AS (SELECT *, regexp_matches(cell, '^\s*대\s*분\s*류\s*$') AS ma, regexp_matches(cell, '^\s*[대중소세]\s*분\s*류\s*$') AS hd, regexp_extract(coalesce(nxt, ''), '^\s*(\d{2})\s*[.．·:]?\s*', 1) AS nc FROM c),
l AS (SELECT *, max(CASE WHEN hd THEN i END) OVER (PARTITION BY doc) AS last FROM h),
pr AS (SELECT doc, i, unnest(regexp_extract_all(cell, '(\d{2})\s*[.．·]\s*([가-힣][가-힣A-Za-z·.ㆍ,／/\s]{1,24})', 1)) AS code, unnest(regexp_extract_all(cell, '(\d{2})\s*[.．·]\s*([가-힣][가-힣A-Za-z·.ㆍ,／/\s]{1,24})', 2)) AS name FROM c),
m AS (SELECT doc, 1 AS rule, i, k.code FROM pr JOIN k ON k.code = pr.code AND k.key = regexp_replace(pr.name, '[·․‧∙・･ㆍ⋅ž,]|\s', '', 'g')
  UNION ALL SELECT doc, 2, i, k.code FROM c JOIN k ON c.key = k.key AND level = 2
  UNION ALL SELECT doc, 3, i, k.code FROM l JOIN k ON nc = k.code WHERE ma AND NOT regexp_matches(nxt, '^\s*[중소세]\s*분\s*류\s*$')
  UNION ALL SELECT doc, 4, i, k.code FROM l JOIN k ON nc = k.code WHERE i = last),
mj AS (SELECT doc.doc, region = '' AS empty, coalesce(hk.code, (SELECT arg_min(m.code, (rule, i)) FROM m WHERE m.doc = doc.doc)) AS major FROM doc LEFT JOIN k hk ON hk.level = 2 AND hk.key = regexp_replace(hint, '[·․‧∙・･ㆍ⋅ž,]|\s', '', 'g')),
ex AS (SELECT DISTINCT c.key, k.level FROM c JOIN k ON c.key = k.key AND level > 2),
fz AS (SELECT c.key, k.level, arg_min(k.key, k.code) AS known FROM (SELECT DISTINCT key FROM c WHERE length(key) >= 5) c JOIN k ON length(k.key) = length(c.key) AND levenshtein(k.key, c.key) <= 1 AND level > 2 ANTI JOIN ex ON ex.key = c.key AND ex.level = k.level GROUP BY ALL),
nm AS (SELECT ex.key, ex.level, k.code FROM ex JOIN k ON k.key = ex.key AND k.level = ex.level UNION ALL SELECT fz.key, fz.level, k.code FROM fz JOIN k ON k.key = fz.known AND k.level = fz.level),
ht AS (SELECT doc, level, nm.code, count(*) AS votes, min((c.i, nm.code)) AS first FROM c JOIN nm USING (key) JOIN mj USING (doc) WHERE NOT empty AND starts_with(nm.code, coalesce(major, '')) AND length(key) >= 2 GROUP BY ALL),
bs AS (SELECT doc, arg_min(code, (-level, -votes, first)) AS code FROM ht GROUP BY doc),
r AS (SELECT doc, CASE WHEN empty THEN 'empty' WHEN bs.code IS NOT NULL THEN 'name' WHEN major IS NOT NULL THEN 'major' ELSE 'none' END AS how, bs.code AS b, major FROM mj LEFT JOIN bs USING (doc))
SELECT doc, CASE how WHEN 'name' THEN b WHEN 'major' THEN major END AS code, length(CASE how WHEN 'name' THEN b WHEN 'major' THEN major END) AS level, how FROM r""")
def taxonomy_resolved(spark, d):
    from pyspark.sql import Window

    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    places = fx.table(spark, d, "nation").join(fx.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rn = places.select(two("r_regionkey").alias("rr"), two("n_nationkey").alias("nn"), F.concat(F.lit("가"), "r_name").alias("rname"), "n_name", "n_nationkey")
    seg = fx.table(spark, d, "customer").select(F.col("c_mktsegment").alias("m")).distinct().withColumn("s", F.lpad(F.row_number().over(Window.orderBy("m")).cast("string"), 2, "0"))  # a handful of segments
    fine = rn.join(F.broadcast(seg), F.lit(True))
    names = [rn.select(F.col("rr").alias("code"), F.col("rname").alias("name")).distinct(), rn.select(F.concat("rr", "nn"), "n_name"), fine.select(F.concat("rr", "nn", "s"), "m"), fine.where("n_nationkey % 2 = 0").select(F.concat("rr", "nn", "s", F.lit("01")), F.concat_ws(" ", "n_name", "m"))]
    tax = names[0].union(names[1]).union(names[2]).union(names[3]).withColumn("pos", F.col("code"))
    rows = fx.table(spark, d, "customer").join(rn, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("m", F.col("c_mktsegment"))
    lines = lambda *parts: F.concat_ws("\n", *[F.lit(p[1:]) if isinstance(p, str) and p[0] == "=" else p for p in parts])
    layouts = [
        lines(F.concat_ws(". ", "rr", "rname"), "n_name", "m"), lines("rname", "m", "m"), lines("=대분류", "rr", "=중분류", "n_name"), lines("=대분류", "=중 분류", F.concat("rr", F.lit(" x")), F.concat(F.lit("Q"), F.substr("n_name", F.lit(2)))),
        lines("=unknown cells", F.concat(F.lit("of "), "rr")), lines("= 대 분 류 ", "rr", "=more"), lines(F.concat(F.lit("01. "), "n_name", F.lit(" "), "m"), "=", "m", "n_name"), F.lit(""),
    ]
    region = F.element_at(F.array(*layouts), (F.col("c_custkey") % 8 + 1).cast("int"))
    docs = rows.select(F.col("c_custkey").alias("doc"), region.alias("region"), F.when(F.col("c_custkey") % 3 == 0, F.col("rname")).alias("hint"))
    return taxonomy.resolve(docs, tax)
