"""Posting texts to units, roles, sections and fields: column expressions over a document's lines and marks.

All of it is built-in functions on arrays of one document; nothing is shuffled. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import let, squeezed

# Headers of sections, headers that only end one, and the rules for items.
SECTIONS = (
    ("필요지식", ("필요지식", "직무필요지식", "지식")),
    ("필요기술", ("필요기술", "직무필요기술", "기술")),
    ("직무수행태도", ("직무수행태도", "필요태도", "태도")),
    ("능력단위", ("능력단위", "주요능력단위")),
    ("직무수행내용", ("직무수행내용", "주요업무", "담당업무", "직무내용", "채용분야주요업무")),
    ("직업기초능력", ("직업기초능력",)),
    ("관련자격", ("관련자격", "우대자격", "필요자격", "자격증")),
)
STOP_HEADS = (
    "기관주요사업", "주요사업", "기관소개", "사업개요", "공단사업", "우대사항", "우대조건", "교육요건", "일반요건", "필요자격", "관련자격", "전형방법", "근무지", "근무부서", "채용분야", "모집분야", "직급", "직군", "참고사이트", "참고", "비고", "기타", "직업기초능력",
    "직무수행요건", "요구수준", "요구역량", "분류체계", "NCS분류체계", "대분류", "중분류", "지원요건", "응시자격", "지원자격", "자격요건", "연령", "성별", "학력", "전공", "경력", "채용인원", "소속", "직위", "직렬", "고용형태",
)
BULLET = "·•◦○●ㅇ□■▪▫◇◆⚬∘⦁‣▶▷►★☆❍¡-"
_BULLET_SET = BULLET.replace("-", "\\-")
ITEM_SPLIT = f"[\\n{_BULLET_SET}]\\s*|(?<=[다음])\\s*,\\s*|,\\s+(?=[가-힣A-Za-z(])"
WRAP_TAIL = "(?:[에의을를과와및]|[,·])\\s*$"
WRAP_HEAD = "(?U)^\\s*(?:대한|관한|대해|관해|및|등|있는|없는|위한|통한)\\b"
BULLET_HEAD = f"^\\s*[{_BULLET_SET}]"
LEAD_MARK = "^[\\s■□○●▪▫◆◇※◎ㅇ·•\\-–—]+"
TABLE_HEAD = (
    "대분류", "중분류", "소분류", "세분류", "분류체계", "채용분야", "직무", "직급", "근무지", "근무부서", "전형방법", "일반요건", "교육요건", "연령", "성별", "학력", "전공", "경력", "주요사업", "기관", "참고사이트", "우대사항", "관련자격", "직무수행",
    "직무수행내용", "능력단위", "직업기초능력", "필요지식", "필요기술", "직무수행태도", "필요태도", "기관주요사업", "채용인원", "비고",
)
BASIC_ABILITY = (
    "의사소통능력", "수리능력", "문제해결능력", "자기개발능력", "자원관리능력", "대인관계능력", "정보능력", "기술능력", "조직이해능력", "직업윤리",
)
FRAGMENT = (
    "직업기초", "기초능력", "수행태도", "필요지식", "필요기술", "직무수행", "분류", "체계", "요건", "사항", "내용", "단위", "능력",
)
DROP = "(?i)^(www\\.|http|참고|사이트|ncs|\\d+\\.?$|\\d{2}\\.\\s|기타|해당없음|없음|미개발|자체개발)"
NCS_CODE = "^\\s*\\d{2}[.\\s]"
BOILER = "국가직무능력표준|홈페이지|www\\.|http|별첨|자체 ?개발|붙임|세부 ?사항입니다|본 ?내용은|상기 ?직무|직무 ?설명자료|직무기술서|채용 ?공고|별도로"
GUIDE = "바랍니다|하시기|될 수 있|참고하|해당 없|제한 ?없|양지"
UNIT_ANCHOR = "(?:NCS\\s*)?분\\s?류\\s?체\\s?계|대\\s?분\\s?류(?=[\\s\\S]{0,40}?중\\s?분\\s?류)"
TABLE_END = "직\\s?무\\s?수\\s?행|능\\s?력\\s?단\\s?위|필\\s?요\\s?지\\s?식|주\\s?요\\s?업\\s?무|직\\s?무\\s?필\\s?요|담\\s?당\\s?업\\s?무|직\\s?무\\s?내\\s?용"
TITLE_NOISE = "^[\\s■□○●▪◆※\\-=_.]*$|^\\d{4}-\\d+호$|^(대|중|소|세)분류$"
TITLE_HEAD = "^(?:채\\s?용\\s?분\\s?야|모\\s?집\\s?분\\s?야|직\\s?무\\s?명?)$"
QUAL_FIELDS = {
    "학력": "학\\s?력|교육\\s?요건|학위",
    "전공": "전\\s?공",
    "경력": "경\\s?력",
    "자격": "관련\\s?자격|자격\\s?증|필수\\s?자격|우대\\s?자격|자격\\s?요건",
    "우대": "우대\\s?사항|우대\\s?조건|우대\\s?요건",
}
QUAL_STOP = "직무\\s?수행|능력\\s?단위|필요\\s?지식|필요\\s?기술|직무\\s?필요|직업\\s?기초|참고\\s?사이트|분류\\s?체계"
SELF_DEVELOPED = "자체\\s?개발|NCS\\s?미개발|미개발|해당\\s?없"
ROLE_ANCHOR = "(주요\\s?업무(?:내용)?|담당\\s?업무|담당\\s?직무|수행\\s?업무|직무\\s?상세(?:설명)?|세부업무내용|핵심\\s?업무|업무\\s?내용|직무소개)\\s*[:：]?"
ROLE_NOISE = (
    "^(https?://|[-=·•▪■□○◎※*]+$|\\d[\\d\\s.\\-~년월일]*$|.{0,1}$|.*[(/]\\s*(부문|직무|구분|신입|경력|모집|담당|자격)\\s*[/)]"
    "|(모집|채용|전형|지원|응시|접수|근무|학력|전공|우대|필수)[\\s가-힣]*[:：(]|.*(대한민국|특별시|광역시|[가-힣]+시\\s|[가-힣]+구\\s|[가-힣]+로\\d)"
    "|.*(채용\\s?공고|신입사원\\s?(채용|모집)|인재\\s?모집|수시채용|공개채용|공동채용)|※.*|\\[.*\\]$)"
)
EN_TERM = "(?U)\\b[A-Za-z][A-Za-z0-9+#./_-]{1,22}\\b"
KO_TERM = "([가-힣A-Za-z0-9]{2,14}?(?:개발|설계|분석|운영|관리|구축|처리|학습|모델링|모델|서비스|플랫폼|아키텍처|자동화|최적화|검증|튜닝|엔지니어링|마이닝|시각화|파이프라인|배포|보안|인프라))"
DATE = "20\\d{2}년\\s*\\d{1,2}월\\s*\\d{1,2}일"
CLOSING, OTHER_DATES = "마감|접수|지원", "유효|경력|입사|졸업"
LEVEL_LINE, KECO_LINE = "^(\\d{2})\\.\\s*(.+)$", "^\\d{4}$"


def _trim(text: Column) -> Column:
    return F.btrim(text)


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def lines_of(text: Column) -> Column:
    return F.split(_text(text), "\\r\\n|[\\n\\r\\x0b\\x0c\\u0085\\u2028\\u2029]", -1)


def marks(text: Column, pattern: str) -> Column:
    """(at, mark) of every match, in order; at counts code points from 0."""
    found, between = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.split(text, pattern, -1)

    def places(found: Column, between: Column) -> Column:
        length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p))
        return F.transform(found, lambda mark, i: F.struct((length(F.slice(between, 1, i + 1)) + length(F.slice(found, 1, i))).alias("at"), mark.alias("mark")))

    return let(found, lambda f: let(between, lambda b: places(f, b)))


def _last_line(before: Column, most: int, strip: str, good: Callable[[Column], Column]) -> Column:
    """The last of the final `most` lines that is good, or null."""
    tail = F.slice(F.reverse(F.split(before, "\n", -1)), 1, most)
    return F.get(F.filter(F.transform(tail, lambda x: F.btrim(x, F.lit(strip))), good), F.lit(0))


def units(docs: DataFrame) -> DataFrame:
    """(doc, unit, title, text): a document's job units, one for each classification table.

    Tables that begin within 80 characters of the mark before are one; a unit begins up to 300
    characters before its table, not before the last one. Without a table the text is one unit.
    """
    every = marks(F.col("body"), UNIT_ANCHOR)
    at = F.transform(every, lambda m: m["at"])
    kept = let(at, lambda a: F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (x - F.get(a, i - 1) > 80), x)), lambda x: x.isNotNull()))

    def block(a: Column, x: Column, i: Column) -> Column:
        head = F.greatest(F.when(i > 0, F.get(a, i - 1)).otherwise(0), x - 300)
        start = F.when(i > 0, head).otherwise(0)
        stop = F.when(i + 1 < F.size(a), F.greatest(F.get(a, i + 1) - 300, x + 1)).otherwise(F.length("body"))
        good = lambda line: (line != "") & ~line.rlike(TITLE_NOISE) & (F.length(line) <= 60) & ~line.rlike(TITLE_HEAD)
        title = F.coalesce(_last_line(F.substr("body", head + 1, x - head), 8, " ■□○●▪◆-–—", good), F.lit(""))
        return F.struct(i.alias("unit"), title.alias("title"), F.substr("body", start + 1, stop - start).alias("text"))

    whole = F.array(F.struct(F.lit(0).alias("unit"), F.lit("").alias("title"), F.col("body").alias("text")))
    found = docs.select("doc", _text(F.col("text")).alias("body")).withColumn("marks", kept)
    blocks = F.when(F.size("marks") > 0, F.transform("marks", lambda x, i: block(F.col("marks"), x, i))).otherwise(whole)
    return found.select("doc", F.explode(blocks).alias("u")).select("doc", "u.unit", "u.title", "u.text")


def taxonomy_region(text: Column, span: int = 1200) -> Column:
    """What follows the classification mark, up to the next section or `span` characters; empty without one."""
    after = F.regexp_extract(_text(text), f"(?s)(?:{UNIT_ANCHOR})(.*)", 1)
    return let(after, lambda a: F.when(a.rlike(TABLE_END), F.get(F.split(a, TABLE_END, 2), F.lit(0))).otherwise(F.left(a, F.lit(span))))


def self_developed(region: Column) -> Column:
    """The institution says that it doesn't use the standard classification."""
    return _text(region).rlike(SELF_DEVELOPED)


def qualifications(text: Column, span: int = 160, longest: int = 120) -> Column:
    """Map of the five conditions: what follows a condition's first mark, up to a stop word, squeezed and cut; empty if absent."""
    def value(pattern: str) -> Column:
        part = F.get(F.split(F.regexp_extract(_text(text), f"(?s)(?:{pattern})(.{{0,{span}}})", 1), QUAL_STOP, 2), F.lit(0))
        return F.left(F.btrim(F.regexp_replace(part, "(?U)\\s+", " "), F.lit(" :·-—[]()")), F.lit(longest))

    return F.create_map(*[x for name, pattern in QUAL_FIELDS.items() for x in (F.lit(name), value(pattern))])


def roles(docs: DataFrame) -> DataFrame:
    """(doc, pos, role, text) of docs (doc, title, text): a piece from each duty mark to the next, named by a short line before it.

    The name is the last good one of the six lines before (400 characters), else the title's start;
    a text without a mark is one piece.
    """
    good = lambda line: (line != "") & ~line.rlike(ROLE_NOISE) & F.length(line).between(2, 40)
    title = F.left(_text(F.col("title")), F.lit(40))

    def piece(m: Column, i: Column) -> Column:
        at = m["at"]
        stop = F.coalesce(F.get("marks", i + 1)["at"], F.length("body"))
        start = F.greatest(at - 400, F.lit(0))
        name = _last_line(F.substr("body", start + 1, at - start), 6, " ·•-–—■□○●[]()", good)
        return F.struct(i.alias("pos"), F.coalesce(name, title).alias("role"), F.substr("body", at + 1, stop - at).alias("text"))

    found = docs.select("doc", "title", _text(F.col("text")).alias("body")).withColumn("marks", marks(F.col("body"), ROLE_ANCHOR.replace("(주요", "(?:주요", 1)))
    whole = F.array(F.struct(F.lit(0).alias("pos"), title.alias("role"), F.col("body").alias("text")))
    pieces = F.when(F.size("marks") > 0, F.transform("marks", piece)).otherwise(whole)
    return found.select("doc", F.explode(pieces).alias("p")).select("doc", "p.pos", "p.role", "p.text")


def role_slice(text: Column, name: Column, others: Column, longest: int = 6000) -> Column:
    """From the first line that begins with the role's name to the next line that begins with another's; the whole text if it is absent."""
    def cut(lines: Column) -> Column:
        key = F.btrim(name)
        starts = lambda line, word: F.startswith(F.btrim(line), word)
        first = F.array_min(F.transform(lines, lambda x, i: F.when((key != "") & starts(x, key), i)))
        rivals = F.filter(F.transform(others, _trim), lambda o: (o != "") & (o != key))
        stop = F.array_min(F.transform(lines, lambda x, i: F.when((i > first) & F.exists(rivals, lambda o: starts(x, o)), i)))
        return F.when(first.isNull(), _text(text)).otherwise(F.array_join(F.slice(lines, first + 1, F.coalesce(stop, F.size(lines)) - first), "\n"))

    return F.left(let(lines_of(text), cut), F.lit(longest))


_HEADS = {head: canon for canon, heads in SECTIONS for head in heads} | dict.fromkeys(STOP_HEADS)
_LONG = sorted((h for h in _HEADS if len(h) > 2), key=lambda h: (-len(h), h))
#: The longest header that a line begins with; headers of two letters must be the whole line.
HEAD = f"^(?:{'|'.join(_LONG)}|(?:{'|'.join(sorted(h for h in _HEADS if len(h) < 3))})$)"


def sections(docs: DataFrame, last: int = 40) -> DataFrame:
    """(doc, section, body): the text below each section's header, several of one kind joined.

    A header may be broken over up to three short lines. Headers that only end a section may be
    longer lines. The last section holds `last` lines at most.
    """
    canon = F.create_map(*[F.lit(x) for head, name in _HEADS.items() for x in (head, name or "")])

    def hit(i: Column, span: int) -> Column:
        part = F.slice("lines", i + 1, span)
        plain = F.regexp_replace(F.regexp_replace(F.array_join(part, ""), "(?U)\\s+", ""), LEAD_MARK, "")
        fits = (F.size(part) == span) if span == 1 else (F.size(part) == span) & F.forall(part, lambda x: F.length(x).between(1, 8))

        def named(c: Column) -> Column:
            head = F.regexp_extract(c, HEAD, 0)
            name = canon[head]
            return F.when(fits & F.length(c).between(1, 60) & (head != "") & ((F.length(c) <= 24) | (name == "")), F.struct(i.alias("at"), F.lit(span).alias("span"), name.alias("name")))

        return let(plain, named)

    text = F.transform(lines_of(F.regexp_replace(_text(F.col("text")), "[ \\t]+", " ")), _trim)
    found = docs.select("doc", text.alias("lines")).withColumn("hits", F.filter(F.transform(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.coalesce(hit(i, 3), hit(i, 2), hit(i, 1))), lambda h: h.isNotNull()))
    # A header's own lines begin no other header.
    empty = F.struct(F.lit(0).alias("free"), F.filter("hits", lambda h: F.lit(False)).alias("kept"))
    step = lambda s, h: F.when(h["at"] < s["free"], s).otherwise(F.struct((h["at"] + h["span"]).alias("free"), F.concat(s["kept"], F.array(h)).alias("kept")))
    found = found.withColumn("kept", F.aggregate("hits", empty, step)["kept"])

    def body(h: Column, i: Column) -> Column:
        start = h["at"] + h["span"]
        stop = F.coalesce(F.get("kept", i + 1)["at"], F.least(F.size("lines"), h["at"] + last))
        return F.struct(i.alias("i"), h["name"].alias("section"), F.btrim(F.array_join(F.slice("lines", start + 1, F.greatest(stop - start, F.lit(0))), "\n"), F.lit(" \n")).alias("body"))

    rows = found.select("doc", F.explode(F.transform("kept", body)).alias("b")).select("doc", "b.*").where("section <> '' and body <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda x: x["body"]), "\n")  # one document's sections
    return rows.groupBy("doc", "section").agg(joined.alias("body"))


def join_wrapped(block: Column) -> Column:
    """Glue a line to the one before where that ends, or this begins, in the middle of a phrase; bullets begin anew."""
    def step(done: Column, line: Column) -> Column:
        last = F.element_at(done, -1)
        goes_on = (F.size(done) > 0) & ~line.rlike(BULLET_HEAD) & (F.coalesce(last, F.lit("")).rlike(WRAP_TAIL) | line.rlike(WRAP_HEAD))
        glued = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(F.rtrim(last), F.lit(" "), F.trim(line))))
        return F.when(goes_on, glued).otherwise(F.concat(done, F.array(line)))

    start = F.slice(F.array(F.lit("")), 1, 0)
    return F.array_join(F.aggregate(F.split(_text(block), "\n", -1), start, step), "\n")


def item_noise(item: Column) -> Column:
    """No item of a section: table heads, basic abilities, fragments, guide texts, codes, one short word, hardly a letter."""
    plain = F.regexp_replace(item, "(?U)[\\s.·0-9]", "")
    return (
        (F.length(F.regexp_replace(item, "[^가-힣A-Za-z]", "")) < 2)
        | (plain == "")
        | plain.isin(*TABLE_HEAD, *BASIC_ABILITY, *FRAGMENT)
        | item.rlike(NCS_CODE)
        | item.rlike(GUIDE)
        | item.rlike(BOILER)
        | ((F.length(plain) <= 4) & ~F.contains(F.btrim(item), F.lit(" ")))
    )


def items(block: Column) -> Column:
    """The items of a section's text: wrapped lines joined, split at bullets and commas, 3 to 80 characters, without noise."""
    parts = F.transform(F.split(join_wrapped(block), ITEM_SPLIT, -1), lambda x: F.btrim(squeezed(x), F.lit(" .–—()[]" + BULLET)))
    return F.filter(parts, lambda x: F.length(x).between(3, 80) & ~x.rlike(DROP) & ~item_noise(x))


def terms(sentence: Column) -> Column:
    """Candidate terms: Latin tokens, and Hangul compounds that end like a skill."""
    english = F.filter(F.regexp_extract_all(_text(sentence), F.lit(f"({EN_TERM})"), 1), lambda t: F.length(t) > 1)
    return F.array_distinct(F.concat(english, F.regexp_extract_all(_text(sentence), F.lit(KO_TERM), 1)))


def split_outside(text: Column) -> Column:
    """Parts between commas, and between slashes with spaces around, outside brackets."""
    def walk(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c.isin("(", "["), 1).when(c.isin(")", "]"), -1).otherwise(0)
        cut = (depth <= 0) & c.isin(",", "，", "\x01")
        return F.struct(depth.alias("depth"), F.when(cut, F.concat(s["text"], F.lit("\x02"))).otherwise(F.concat(s["text"], c)).alias("text"))

    marked = F.regexp_replace(_text(text), "(?<= )/(?= )", "\x01")
    done = F.aggregate(F.split(marked, ""), F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")), walk)["text"]
    return F.filter(F.transform(F.split(F.replace(done, F.lit("\x01"), F.lit("/")), "\x02", -1), _trim), lambda p: p != "")


def source_label(institution: Column, title: Column, year: Column) -> Column:
    """Institution, year and title without what the title repeats of the two."""
    t, inst = F.btrim(_text(title)), _text(institution)
    without = F.when((inst != "") & F.contains(t, inst), F.btrim(F.replace(t, inst, F.lit("")), F.lit(" -_·[]()"))).otherwise(t)
    bare = F.when(year.isNotNull(), F.btrim(F.regexp_replace(without, F.concat(F.lit("^"), year.cast("string"), F.lit("\\s*년도?\\s*")), F.lit("")), F.lit(" -_·"))).otherwise(without)
    rest = F.concat(F.when(year.isNotNull(), F.concat(year.cast("string"), F.lit("년 "))).otherwise(""), bare)
    return F.btrim(F.array_join(F.filter(F.array(inst, rest), lambda x: F.btrim(x) != ""), " "))


def listed(body: Column) -> Column:
    """The strings of the JSON list in a text, from its first bracket to its last, trimmed, without empty ones; an empty list if that is none."""
    # As the one value of a list inside an object, for a list alone would be read without regard to what follows it.
    inside = F.from_json(F.concat(F.lit('{"x":['), F.regexp_extract(_text(body), "(?s)\\[.*\\]", 0), F.lit("]}")), "x array<array<string>>")["x"]
    found = F.when(F.size(inside) == 1, inside[0])
    return F.coalesce(F.filter(F.transform(found, _trim), lambda s: s.isNotNull() & (s != "")), F.expr("cast(array() as array<string>)"))


def json_object(body: Column) -> Column:
    """The JSON object in a text, from its first brace to its last, fences or not; null if there is none."""
    found = F.regexp_extract(_text(body), "(?s)\\{.*\\}", 0)
    return F.when(found != "", found)


def list_literal(value: Column) -> Column:
    """A list that is written as text, in single or double quotes; what isn't one is empty."""
    return F.coalesce(F.from_json(_text(value), "array<string>", {"allowSingleQuotes": "true"}), F.expr("cast(array() as array<string>)"))


def deadline(text: Column) -> Column:
    """The date whose surroundings speak of closing most (+2), not of other dates (-2); the last of equals; null unless positive."""
    def scored(m: Column) -> Column:
        around = F.substr(_text(text), F.greatest(m["at"] - 120, F.lit(0)) + 1, m["at"] + 40 - F.greatest(m["at"] - 120, F.lit(0)))
        number = lambda k: F.regexp_extract(m["mark"], "(\\d{4})년\\s*(\\d{1,2})월\\s*(\\d{1,2})일", k)
        day = F.concat_ws("-", number(1), F.lpad(number(2), 2, "0"), F.lpad(number(3), 2, "0"))
        score = F.when(around.rlike(CLOSING), 2).otherwise(0) - F.when(around.rlike(OTHER_DATES), 2).otherwise(0)
        return F.struct(score.alias("score"), m["at"].alias("at"), day.alias("day"))

    best = F.array_max(F.transform(marks(_text(text), DATE), scored))
    return F.when(best["score"] > 0, best["day"])


def taxonomy_rows(docs: DataFrame) -> DataFrame:
    """(doc, path, names, keco_code, keco_name): rows of a classification table that stands line by line.

    Four lines "NN. name", a code of four digits and its name are a row; a level line after a full
    path begins a new row, other lines count for nothing.
    """
    lines = F.filter(F.transform(lines_of(F.col("text")), _trim), lambda x: x != "")
    none = F.expr("cast(array() as array<string>)")
    start = F.struct(none.alias("codes"), none.alias("names"), F.lit("").alias("keco"), F.expr("cast(array() as array<struct<path string, names array<string>, keco_code string, keco_name string>>)").alias("rows"))

    def step(s: Column, line: Column) -> Column:
        code, name = F.regexp_extract(line, LEVEL_LINE, 1), F.btrim(F.regexp_extract(line, LEVEL_LINE, 2))
        full = F.size(s["codes"]) >= 4
        level = F.struct(F.when(full, F.array(code)).otherwise(F.concat(s["codes"], F.array(code))).alias("codes"), F.when(full, F.array(name)).otherwise(F.concat(s["names"], F.array(name))).alias("names"), F.lit("").alias("keco"), s["rows"].alias("rows"))
        keco = F.struct(s["codes"].alias("codes"), s["names"].alias("names"), line.alias("keco"), s["rows"].alias("rows"))
        row = F.struct(F.array_join(s["codes"], "").alias("path"), s["names"].alias("names"), s["keco"].alias("keco_code"), line.alias("keco_name"))
        done = F.struct(none.alias("codes"), none.alias("names"), F.lit("").alias("keco"), F.concat(s["rows"], F.array(row)).alias("rows"))
        return F.when(line.rlike(LEVEL_LINE), level).when(line.rlike(KECO_LINE) & full & (s["keco"] == ""), keco).when(s["keco"] != "", done).otherwise(s)

    return docs.select("doc", F.explode(F.aggregate(lines, start, step)["rows"]).alias("r")).select("doc", "r.*")


def query_tokens(docs: DataFrame, sentences: Column, normal: Callable[[Column], Column], mapping: DataFrame | None = None, least: int = 5) -> DataFrame:
    """(doc, token): each sentence's normal form of 2 to 40 characters and its words' of 2 or more, folded; documents with `least` or more."""
    whole = docs.select("doc", F.explode(sentences).alias("s"))
    forms = whole.select("doc", normal(F.col("s")).alias("item")).where(F.length("item").between(2, 40))
    words = whole.select("doc", F.explode(F.split(F.replace("s", F.lit(","), F.lit(" ")), "(?U)\\s+")).alias("w")).select("doc", normal(F.col("w")).alias("item")).where(F.length("item") >= 2)
    every = forms.unionByName(words).distinct()
    if mapping is not None:
        every = every.join(mapping, "item", "left").select("doc", F.coalesce("node", "item").alias("item")).distinct()
    enough = every.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return every.join(enough.select("doc"), "doc", "left_semi").withColumnRenamed("item", "token")
