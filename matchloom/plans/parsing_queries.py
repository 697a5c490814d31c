"""Parsers over posting texts that are put together from parts and orders, so that SQL can state what they must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import text as X
from matchloom.operators import evaluate, parsing, persona, vectors
from matchloom.plans import fixtures as fx
from matchloom.plans import text_queries as tq
from matchloom.plans import work_queries as wq
from matchloom.plans.catalogue import register


def _parts(spark, d):
    return fx.spread(spark, d, "part", "p_partkey").withColumnRenamed("p_partkey", "doc")


def _joined(column):
    return F.array_join(column, "|")


FILL = "가나다 라마바 " * 60
UNITS_SQL = f"t AS (SELECT p_partkey AS doc, p_name, p_brand, p_partkey % 5 = 0 AS plain, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE '안내' || chr(10) || p_name || chr(10) || 'NCS 분류체계' || chr(10) || '대분류 하나' || chr(10) || '{FILL}' || chr(10) || '모집분야' || chr(10) || '둘 ' || p_brand || chr(10) || '2024-12호' || chr(10) || 'NCS분류체계 ' || p_type END AS text FROM part)"


def _unit_texts(spark, d):
    text = F.concat(F.lit("안내\n"), F.col("p_name"), F.lit(f"\nNCS 분류체계\n대분류 하나\n{FILL}\n모집분야\n둘 "), F.col("p_brand"), F.lit("\n2024-12호\nNCS분류체계 "), F.col("p_type"))
    return _parts(spark, d).select("doc", F.when(F.col("doc") % 5 == 0, F.col("p_name")).otherwise(text).alias("text"))


@register(f"""WITH {UNITS_SQL}, a AS (SELECT *, instr(text, 'NCS분류체계') - 1 AS second FROM t)
SELECT doc, 0 AS unit, CASE WHEN plain THEN '' ELSE p_name END AS title, md5(CASE WHEN plain THEN text ELSE left(text, second - 300) END) AS text FROM a
UNION ALL SELECT doc, 1, '둘 ' || p_brand, md5(substr(text, second - 300 + 1)) FROM a WHERE NOT plain""")
def job_units(spark, d):
    return parsing.units(_unit_texts(spark, d)).select("doc", "unit", "title", F.md5("text").alias("text"))


ROLES_SQL = "t AS (SELECT p_partkey AS doc, p_name, p_brand, p_partkey % 3 = 0 AS plain FROM part)"


@register(f"""WITH {ROLES_SQL} SELECT doc, 0 AS pos, CASE WHEN plain THEN '공고 ' || p_brand ELSE p_name END AS role, CASE WHEN plain THEN '소개 글' ELSE '주요업무: 가' || chr(10) || p_brand || chr(10) || '※ 주의' || chr(10) END AS text FROM t
UNION ALL SELECT doc, 1, p_brand, '담당 업무 나 다' FROM t WHERE NOT plain""")
def role_pieces(spark, d):
    text = F.concat(F.lit("회사\n"), F.col("p_name"), F.lit("\n\n주요업무: 가\n"), F.col("p_brand"), F.lit("\n※ 주의\n담당 업무 나 다"))
    rows = _parts(spark, d).select("doc", F.concat(F.lit("공고 "), "p_brand").alias("title"), F.when(F.col("doc") % 3 == 0, "소개 글").otherwise(text).alias("text"))
    return parsing.roles(rows)


@register("SELECT p_partkey AS doc, CASE WHEN p_partkey % 4 = 0 THEN 'zz' || chr(10) || 'none here' ELSE p_name || ' lead' || chr(10) || 'does things' END AS text FROM part")
def role_slices(spark, d):
    whole = F.concat(F.lit("intro\n"), F.col("p_name"), F.lit(" lead\ndoes things\n"), F.col("p_brand"), F.lit(" other\nmore"))
    text = F.when(F.col("doc") % 4 == 0, "zz\nnone here").otherwise(whole)
    return _parts(spark, d).select("doc", parsing.role_slice(text, F.col("p_name"), F.array("p_brand", "p_name", F.lit(""))).alias("text"))


SECTION_TEXT = (
    "기관소개\n우리 기관은 좋은 곳입니다\n■ 필요\n지식\n· {name} 시스템에\n대한 지식\n· 데이터 분석 지식, 통계 지식\n능력단위\n01. 코드 설명입니다\n필요기술\n· {brand} 도구 활용 기술\n"
    "우대사항: 교육요건(학력, 전공)/관련자격/경력 등 우대사항 안내입니다\n해당자\n직무수행태도\n· 성실한 업무 태도\n· 홈페이지 참고\n책임"
)


def _section_docs(spark, d):
    before, rest = SECTION_TEXT.split("{name}")
    middle, after = rest.split("{brand}")
    return _parts(spark, d).select("doc", F.concat(F.lit(before), F.col("p_name"), F.lit(middle), F.col("p_brand"), F.lit(after)).alias("text"))


@register("""SELECT p_partkey AS doc, section, body FROM part, LATERAL (VALUES ('필요지식', '· ' || p_name || ' 시스템에' || chr(10) || '대한 지식' || chr(10) || '· 데이터 분석 지식, 통계 지식'), ('능력단위', '01. 코드 설명입니다'),
 ('필요기술', '· ' || p_brand || ' 도구 활용 기술'), ('직무수행태도', '· 성실한 업무 태도' || chr(10) || '· 홈페이지 참고' || chr(10) || '책임')) v(section, body)""")
def section_bodies(spark, d):
    return parsing.sections(_section_docs(spark, d))


@register("""SELECT p_partkey AS doc, section, items FROM part, LATERAL (VALUES ('필요지식', p_name || ' 시스템에 대한 지식|데이터 분석 지식|통계 지식'), ('능력단위', ''), ('필요기술', p_brand || ' 도구 활용 기술'), ('직무수행태도', '성실한 업무 태도')) v(section, items)""")
def section_items(spark, d):
    return parsing.sections(_section_docs(spark, d)).select("doc", "section", _joined(parsing.items(F.col("body"))).alias("items"))


@register("""SELECT p_partkey AS doc, '대졸 ' || p_size || ' 이상' AS degree, p_type AS major, '' AS career, p_brand AS licence FROM part""")
def qualification_fields(spark, d):
    text = F.concat(F.lit("학 력: 대졸 "), F.col("p_size"), F.lit("  이상 직무수행 없음 전공 - "), F.col("p_type"), F.lit(" 필요지식 관련 자격: ["), F.col("p_brand"), F.lit("] 분류체계"))
    found = _parts(spark, d).select("doc", parsing.qualifications(text).alias("q"))
    return found.select("doc", *[F.col("q")[k].alias(a) for k, a in (("학력", "degree"), ("전공", "major"), ("경력", "career"), ("자격", "licence"))])


@register("SELECT p_partkey AS doc, CASE WHEN p_size % 2 = 0 THEN 'NCS 미개발 ' || p_name ELSE ' 하나 둘 ' || p_name || ' ' END AS region, p_size % 2 = 0 AS own FROM part")
def self_developed(spark, d):
    text = F.concat(F.lit("앞 분류체계"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("NCS 미개발 "), "p_name")).otherwise(F.concat(F.lit(" 하나 둘 "), F.col("p_name"), F.lit(" 능력단위 뒤"))))
    region = parsing.taxonomy_region(text)
    return _parts(spark, d).select("doc", region.alias("region"), parsing.self_developed(region).alias("own"))


@register("SELECT p_partkey AS doc, replace(p_name, ' ', '|') || '|' || p_type || '|데이터분석|웹앱서비스' AS terms FROM part")
def candidate_terms(spark, d):
    sentence = F.concat(F.col("p_name"), F.lit(", "), F.col("p_type"), F.lit(" 데이터분석 및 웹앱서비스 1 x"))
    return _parts(spark, d).select("doc", _joined(parsing.terms(sentence)).alias("terms"))


@register("SELECT p_partkey AS doc, p_name || '|' || p_brand || ' (a, b / c)|' || p_type || '/x' AS parts FROM part")
def split_outside_brackets(spark, d):
    text = F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand"), F.lit(" (a, b / c) / "), F.col("p_type"), F.lit("/x,"))
    return _parts(spark, d).select("doc", _joined(parsing.split_outside(text)).alias("parts"))


@register("SELECT p_partkey AS doc, CASE WHEN p_size % 2 = 0 THEN p_brand || ' 2024년 ' || p_name ELSE p_brand || ' ' || p_name END AS label FROM part")
def source_labels(spark, d):
    even = F.col("p_size") % 2 == 0
    title = F.when(even, F.concat(F.lit("2024년도 "), F.col("p_brand"), F.lit(" - "), F.col("p_name"))).otherwise(F.col("p_name"))
    # The institution goes from the title first, then the year and what it leaves at the ends.
    title = F.when(even, F.concat(F.lit("2024년도 "), F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")"))).otherwise(title)
    return _parts(spark, d).select("doc", parsing.source_label(F.col("p_brand"), title, F.when(even, 2024)).alias("label"))


@register("SELECT p_partkey AS doc, p_name || '|' || p_brand AS list, '{\"a\": \"' || p_type || '\"}' AS object, p_type || '|b' AS literal, '' AS broken FROM part")
def json_in_prose(spark, d):
    prose = F.concat(F.lit('답은\n```json\n[" '), F.col("p_name"), F.lit('", "", "'), F.col("p_brand"), F.lit('"]\n``` 입니다'))
    wrapped = F.concat(F.lit('```json\n{"a": "'), F.col("p_type"), F.lit('"}\n```'))
    literal = F.concat(F.lit("['"), F.col("p_type"), F.lit("', 'b']"))
    return _parts(spark, d).select("doc", _joined(parsing.listed(prose)).alias("list"), parsing.json_object(wrapped).alias("object"), _joined(parsing.list_literal(literal)).alias("literal"), _joined(parsing.listed(F.lit("nothing [here"))).alias("broken"))


@register("SELECT o_orderkey AS posting, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate + INTERVAL 8000 DAY, '%Y-%m-%d') END AS deadline FROM orders")
def posting_deadlines(spark, d):
    day = F.date_add(F.to_date("o_orderdate"), 8000)
    date = F.concat(F.year(day), F.lit("년 "), F.month(day), F.lit("월 "), F.dayofmonth(day), F.lit("일"))
    far = F.repeat(F.lit("가"), F.lit(200))
    text = F.concat(F.lit("졸업 2020년 1월 2일 "), far, F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit(" 접수 마감 "), date)), far, F.lit(" 발표 2031년 1월 1일"))
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("posting"), parsing.deadline(text).alias("deadline"))


@register("SELECT p_partkey AS doc, '01020304' AS path, p_brand || '|중|소|' || p_name AS names, '1234' AS keco_code, p_type AS keco_name FROM part")
def taxonomy_table(spark, d):
    text = F.concat(F.lit("표\n09. 버림\n08. a\n07. b\n06. c\n01. "), F.col("p_brand"), F.lit("\n\n02. 중\n03. 소\n말\n04. "), F.col("p_name"), F.lit("\n1234\n"), F.col("p_type"), F.lit("\n05. 끝"))
    return parsing.taxonomy_rows(_parts(spark, d).select("doc", text.alias("text"))).withColumn("names", _joined("names"))


LETTERS_SQL = "regexp_replace(lower({}), '[^a-z]', '', 'g')"


@register(f"""WITH {tq.PIECES_SQL}, s AS (SELECT doc_id AS doc, s FROM pc WHERE length(s) BETWEEN 8 AND 90 AND regexp_matches(s, '[A-Za-z]') AND regexp_matches(s, '{tq.SIGNAL}') AND NOT regexp_matches(s, '{tq.NOISE}')),
e AS (SELECT doc, {LETTERS_SQL.format('s')} AS item FROM s WHERE length({LETTERS_SQL.format('s')}) BETWEEN 2 AND 40 UNION SELECT doc, {LETTERS_SQL.format('w')} FROM (SELECT doc, unnest(string_split_regex(replace(s, ',', ' '), '\\s+')) AS w FROM s) WHERE length({LETTERS_SQL.format('w')}) >= 2),
n AS (SELECT doc, count(*) AS tokens, md5(string_agg(item, '|' ORDER BY item)) AS found FROM e GROUP BY doc HAVING count(*) >= 5) SELECT * FROM n""")
def string_queries(spark, d):
    sentences = X.requirement_sentences(F.col("text"), tq.SIGNAL, tq.NOISE, "[A-Za-z]")
    found = parsing.query_tokens(tq.docs(spark, d).select(F.col("doc_id").alias("doc"), "text"), sentences, lambda c: F.regexp_replace(F.lower(c), "[^a-z]", ""))
    return found.groupBy("doc").agg(F.count(F.lit(1)).alias("tokens"), F.md5(F.array_join(F.sort_array(F.collect_list("token")), "|")).alias("found"))  # one document's tokens


PROFILE_OF_LABELS = "pf AS (SELECT lpad(CAST(c AS VARCHAR), 2, '0') || '0000' AS code, l AS node, 1.0 / (1 + abs(l - 2 * c)) AS weight FROM range(5) x(c), range(10) y(l) WHERE abs(l - 2 * c) <= 2)"


@register(f"""WITH {wq.VEC_SQL}, {PROFILE_OF_LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY sim DESC, node) AS rank, max(sim) OVER (PARTITION BY sentence) AS best FROM sim),
h AS (SELECT sentence, node FROM r WHERE rank <= 5 AND best >= 0.35 AND sim >= 0.20),
q AS (SELECT vec_id AS sentence, label AS job FROM embeddings),
sc AS (SELECT s.sentence, c.code, coalesce(sum(pf.weight), 0) AS score FROM (SELECT DISTINCT sentence FROM h) s CROSS JOIN (SELECT DISTINCT code FROM pf) c LEFT JOIN (SELECT h.sentence, pf.code, pf.weight FROM h JOIN pf USING (node)) pf ON pf.sentence = s.sentence AND pf.code = c.code GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY round(score, 9) DESC, code) AS rank FROM sc),
g AS (SELECT sentence, max(CASE WHEN rank = 1 THEN ok ELSE 0 END) AS top1, max(CASE WHEN rank <= 3 THEN ok ELSE 0 END) AS top3 FROM (SELECT rk.*, CASE WHEN CAST(left(code, 2) AS INT) = job // 2 THEN 1 ELSE 0 END AS ok FROM rk JOIN q USING (sentence)) GROUP BY sentence)
SELECT job, count(*) AS queries, count(g.sentence) AS answered, CAST(sum(coalesce(top1, 0)) AS BIGINT) AS top1, CAST(sum(coalesce(top3, 0)) AS BIGINT) AS top3 FROM q LEFT JOIN g USING (sentence) GROUP BY job""")
def user_set_eval(spark, d):
    from matchloom.settings import Settings

    hits = vectors.projection(*wq._vectors(spark, d), Settings(min_similarity=0.20, min_best=0.35))
    asked = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("user"), F.col("label").alias("job"))
    codes, labels = spark.range(5).select(F.col("id").alias("c")), spark.range(10).select(F.col("id").cast("int").alias("node"))
    apart = F.abs(F.col("node") - 2 * F.col("c"))
    profiles = codes.join(labels, apart <= 2).select(F.concat(F.lpad(F.col("c").cast("string"), 2, "0"), F.lit("0000")).alias("code"), "node", (1 / (1 + apart)).alias("weight"))
    gold = labels.select(F.col("node").alias("job"), F.lpad(F.floor(F.col("node") / 2).cast("string"), 2, "0").alias("major"))
    return evaluate.user_set(hits.select(F.col("sentence").alias("user"), "node"), asked, profiles, gold)


@register("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '(' || p_brand || ') ' || p_name ELSE p_name END AS name FROM part")
def bracket_repair(spark, d):
    shape = F.element_at(F.array(F.concat(F.lit("(("), F.col("p_brand"), F.lit(")) "), F.col("p_name")), F.concat("p_name", F.lit(" (size "), "p_size"), F.concat("p_name", F.lit(") ["), "p_type")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return fx.spread(spark, d, "part", "p_partkey").select("p_partkey", X.repair_brackets(shape).alias("name"))


@register("SELECT p_partkey, replace(p_name, ' ', '') AS name, false AS noise FROM part")
def l1_normalise(spark, d):
    name = F.concat(F.lit("1) ["), F.col("p_brand"), F.lit("] "), F.col("p_name"), F.lit(" 관련 지식 등"))
    return fx.spread(spark, d, "part", "p_partkey").select("p_partkey", X.normal_name(name).alias("name"), X.is_noise(X.normal_name(name)).alias("noise"))


@register("""SELECT p_partkey, lower(p_brand) || replace(p_name, ' ', '') AS squashed, CASE WHEN p_size < 10 THEN '' ELSE lpad(CAST(p_size AS VARCHAR), 4, '0') END AS code, p_brand || ' · ' || p_name || ' · ' || p_type || ' · d · e' || CASE WHEN p_size % 2 = 0 THEN ' 외 2개' ELSE '' END AS summary FROM part""")
def small_text_functions(spark, d):
    uri = F.concat(F.lit("http://x/y_"), F.when(F.col("p_size") < 10, F.col("p_size").cast("string")).otherwise(F.lpad(F.col("p_size").cast("string"), 4, "0")), F.lit(" "))
    names = F.array("p_brand", "p_name", "p_type", F.lit("d"), F.lit("e"))
    names = F.when(F.col("p_size") % 2 == 0, F.concat(names, F.array(F.lit("f"), F.lit("g")))).otherwise(names)
    return fx.spread(spark, d, "part", "p_partkey").select("p_partkey", X.squash(F.concat_ws(" ", "p_brand", "p_name")).alias("squashed"), X.code_of_uri(uri).alias("code"), X.summary(names).alias("summary"))


@register("""SELECT p_partkey AS doc, pos, kind, line FROM part, LATERAL (VALUES (2, 'required', p_name || ' 개발 가능자'), (3, 'required', 'SQL 활용'), (5, 'duty', p_brand || ' 운영'), (7, 'preferred', '우대 조건을 만족하는 ' || p_type || ' 전문가이면 좋습니다')) v(pos, kind, line)""")
def rubric_lines(spark, d):
    text = F.concat(F.lit("소개 글\n자격요건\n"), F.col("p_name"), F.lit(" 개발 가능자\n SQL 활용\n담당 업무\n"), F.col("p_brand"), F.lit(" 운영\n우대사항\n우대 조건을 만족하는 "), F.col("p_type"), F.lit(" 전문가이면 좋습니다\n\n"))
    return persona.rubric_lines(_parts(spark, d).select("doc", text.alias("text")))


@register("SELECT p_partkey AS doc, list_aggregate(list_slice(['SQL', split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), 'sql'], 1, 4), 'string_agg', '|') AS words FROM part")
def rubric_keywords(spark, d):
    text = F.concat(F.col("p_name"), F.lit(" 관련 sql 모델을 활용"))
    return _parts(spark, d).select("doc", _joined(persona.keywords(text, F.array(F.lit("SQL"), F.lit("Rust")))).alias("words"))


@register(rf"""WITH a AS (SELECT conv_id AS session, role AS item, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS answers FROM conversations GROUP BY conv_id, role),
s AS (SELECT *, len(list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?。])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: length(trim(s)) >= 5 AND (contains(lower(s), 'ontion') OR contains(lower(s), 'thing') OR contains(lower(s), 'ment')))) > 0 AS q FROM a),
x AS (SELECT session, item, answers, CAST(q AS INT) + CAST(regexp_matches(text, '{wq.ACTION}') AS INT) + CAST(regexp_matches(text, '{wq.RESULT}') AS INT) AS score FROM s)
SELECT session, item, answers, score, score < 2 AND answers = 1 AS followup FROM x""")
def interview_fold(spark, d):
    talk = fx.table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("role").alias("item"), F.array(*[F.lit(w) for w in wq.WORDS]).alias("words"), F.col("turn").alias("seq"), F.col("text").alias("answer"))
    return persona.interview_scores(talk, wq.ACTION, wq.RESULT).select("session", "item", "answers", "score", "followup")
