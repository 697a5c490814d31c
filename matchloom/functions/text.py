"""Column expressions for names, sentences and signals (no Python in the hot path)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide what counts as a name, a requirement or a duty.
STRAY = "[￮Ÿ⚫◯◻◼▶▷◆◇★☆ž※「」･╢]|[\uf000-\uf0ff]|[\\x00-\\x08\\x0b-\\x1f]"
LEAD_LETTER = "^[a-zA-Z][가-힣]"
CUT_TAIL = "(?:하려|하고자|할수있음|할수있는|하는|되는|으로|에서|에게|및|또는)$"
CUT_STEM = "^.{2,}(?:하|되)$"
HAS_LETTER = "[가-힣A-Za-z]"
HANGUL = "[가-힣]"
BULLETS = "·•○●▪□■"
PIECES = "[\\n·•○●▪□■]\\s*|(?<=[가-힣])\\s*/\\s*"
REQUIREMENT = "경험|능력|역량|이해|지식|보유|개발|설계|구현|분석|운영|활용|가능자|숙련|검증|구축|기획|관리"
NOT_REQUIREMENT = (
    "접수|지원서|전형|면접|홈페이지|문의|마감|입사지원|합격|공고|근무지|급여|근무형태|근무일시|약관|개인정보 처리|용어사전|EP\\.|뉴스|책임연구원|졸업"
    "|취소|명예|비방|COPYRIGHT|Rights|Reserved|TOEIC|OPIc|Speaking"
)
DUTY_TAIL = "(?:합니다|습니다|해요|한다|됩니다|수행|담당|진행|운영|관리|구축|개발|설계|분석|기획|지원|대응|개선|작성|검토|점검|제작|실시|추진)\\s*$"
NOT_DUTY = (
    "연봉|급여|월급|상여|인센티브|복리|복지|퇴직|보험|수당|휴가|연차|접수|지원서|제출|전형|면접|합격|마감|채용\\s?절차|우대\\s?사항"
    "|근무\\s?시간|근무\\s?지|근무\\s?형태|주\\s?\\d일|출퇴근|만원|억원|\\d{4}\\s?년\\s?\\d{1,2}\\s?월\\s?\\d{1,2}|문의|담당자|이메일"
    "|학력|전공|자격증|어학|토익|경력\\s?\\d+\\s?년\\s?이상|적격자|해당자|대상자|다음과\\s?같|아래와\\s?같|바랍니다|유의|안내"
    "|불이익|취소|허위|결격|제한될|경우에는|할\\s?수\\s?있습니다|모집\\s?분야|모집\\s?인원|채용\\s?인원|입사|입문|수습"
)
SIGNALS = ("자격요건", "주요업무", "담당업무", "수행업무", "업무내용", "우대", "지원자격", "모집분야", "모집부문", "직무", "경력", "전형")
LEAD_NUM = "^\\s*(?:\\d+[.)]|[가-힣][.)]|[○●ㅇ□■▪·•\\-])\\s*"
LEAD_TAG = "^\\s*(?:[(（\\[]([^)）\\]]{1,20})[)）\\]]|([^()（）\\[\\]]{1,20})[)）\\]])\\s*"
TAIL = (
    "(?:에\\s*관(?:한|하는)|에\\s*대(?:한|하는)|와?\\s*관련(?:한|된)?|을|를|의|이|가|은|는|및)?\\s*(?:기초|전문|기본|일반|관련)?\\s*"
    "(?:지식|이해|능력|역량|기술|스킬|기법|방법(?:론)?|절차|프로세스|태도|자세|마인드|의지|사고|노력|활용법|사용법|숙지|파악|수준|경험|사항|내용|요소|여부)\\s*(?:등)?\\s*$"
)
VERB_TAIL = "\\s*(?:하려(?:는|고)|하고자\\s*하는|할\\s*수\\s*있는|하는|되는|있는|없는)\\s*$"
DROP_TAIL = "\\s*(?:등|기타|외)\\s*$"
QUOTES = "\"'“”‘’ "
MAX_NAME = 30
OPEN, CLOSE = "([{（［", ")]}）］"


def squash(text: Column) -> Column:
    """Without white space (Unicode), lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_noise(term: Column, longest: int = MAX_NAME) -> Column:
    """Not usable as a name: too short or long, stray glyphs, cut endings, no letter."""
    t = F.trim(F.coalesce(term, F.lit("")))
    return (F.length(t) < 2) | (F.length(t) > longest) | t.rlike(STRAY) | t.rlike(LEAD_LETTER) | t.rlike(CUT_TAIL) | t.rlike(CUT_STEM) | ~t.rlike(HAS_LETTER)


def repair_brackets(text: Column) -> Column:
    """Fold doubled openers, cut at an opener that is never closed (if enough stands before it), drop lone brackets.

    Three folds over the characters, each with its state in a struct.
    """
    once = F.regexp_replace(text, r"([(（\[])\1+", "$1")
    chars = F.split(once, "")
    opens, closes = F.lit(OPEN), F.lit(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(-1).alias("cut"))

    def walk(s: Column, c: Column) -> Column:
        opener, closer = (c != "") & F.contains(opens, c), (c != "") & F.contains(closes, c)
        return F.struct(
            (s["at"] + 1).alias("at"),
            F.when(opener, s["depth"] + 1).when(closer & (s["depth"] > 0), s["depth"] - 1).otherwise(s["depth"]).alias("depth"),
            F.when(opener & (s["depth"] == 0), s["at"]).otherwise(s["cut"]).alias("cut"),
        )

    def cut_open(end: Column) -> Column:
        head = F.trim(F.left(once, end["cut"]))
        return F.when((end["depth"] > 0) & (end["cut"] >= 0) & (F.length(F.regexp_replace(head, r"(?U)\s+", "")) >= 2), head).otherwise(once)

    cut = let(F.aggregate(chars, start, walk), cut_open)

    def lonely(s: Column, c: Column, opener: str, closer: str) -> Column:
        """Keep a closer only while an opener waits; s holds the waiting openers and the text so far."""
        is_open, is_close = (c != "") & F.contains(F.lit(opener), c), (c != "") & F.contains(F.lit(closer), c)
        lone = is_close & (s["open"] == 0)
        return F.struct(
            F.when(is_open, s["open"] + 1).when(is_close & (s["open"] > 0), s["open"] - 1).otherwise(s["open"]).alias("open"),
            F.when(lone, s["text"]).otherwise(F.concat(s["text"], c)).alias("text"),
        )

    empty = F.struct(F.lit(0).alias("open"), F.lit("").alias("text"))
    forward = F.aggregate(F.split(cut, ""), empty, lambda s, c: lonely(s, c, OPEN, CLOSE))["text"]
    backward = F.aggregate(F.split(F.reverse(forward), ""), empty, lambda s, c: lonely(s, c, CLOSE, OPEN))["text"]
    return F.reverse(backward)


def let(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normal_name(text: Column) -> Column:
    """The normal form of a competency name: marks, tags and type words off, brackets repaired, no spaces.

    Endings come off in up to four rounds, until one changes nothing or would leave under two characters.
    """
    raw = F.coalesce(text, F.lit(""))
    bare = let(F.regexp_replace(F.btrim(raw), LEAD_NUM, ""), lambda t: let(F.regexp_replace(t, LEAD_TAG, ""), lambda u: F.when(F.length(u) >= 4, u).otherwise(t)))
    mended = let(F.regexp_replace(bare, "[·․‧∙・]", " "), lambda t: squeezed(repair_brackets(t)))

    def shorten(state: Column) -> Column:
        cut = F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(state["t"], DROP_TAIL, ""), TAIL, ""), VERB_TAIL, ""), F.lit(" ,./()[]"))

        def decide(n: Column) -> Column:
            go = state["go"] & (n != state["t"]) & (F.length(n) >= 2)
            return F.struct(F.when(go, n).otherwise(state["t"]).alias("t"), go.alias("go"))

        return let(cut, decide)

    short = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.struct(mended.alias("t"), F.lit(True).alias("go")), lambda s, _: shorten(s))["t"]
    done = let(short, lambda t: F.regexp_replace(F.btrim(repair_brackets(t), F.lit(" ,./")), r"(?U)\s+", ""))
    back = F.regexp_replace(F.btrim(repair_brackets(raw), F.lit(" ,./()[]")), r"(?U)\s+", "")
    return let(done, lambda t: F.when(t != "", t).otherwise(back))


def sentences(text: Column) -> Column:
    """Sentences of six characters or more."""
    parts = F.split(F.coalesce(text, F.lit("")), "[.!?\\n·•]+|(?<=다)\\s+(?=[가-힣])")
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" -·,"))), lambda s: F.length(s) >= 6)


def requirement_sentences(text: Column, signal: str = REQUIREMENT, noise: str = NOT_REQUIREMENT, script: str = HANGUL, least: int = 8, most: int = 90) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), PIECES), lambda s: F.btrim(F.regexp_replace(s, r"(?U)\s+", " "), F.lit(" .,·•-–—()[]")))
    return F.filter(parts, lambda s: F.length(s).between(least, most) & s.rlike(script) & s.rlike(signal) & ~s.rlike(noise))


def duty_sentences(text: Column, tail: str = DUTY_TAIL, noise: str = NOT_DUTY, script: str = HANGUL, least: int = 12, most: int = 60) -> Column:
    """Duties, each once by its letters without white space (the first stays)."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), PIECES), lambda s: F.btrim(F.regexp_replace(s, r"(?U)\s+", " "), F.lit(" .,·•-–—()[]")))
    good = F.filter(parts, lambda s: F.length(s).between(least, most) & s.rlike(script) & s.rlike(tail) & ~s.rlike(noise))
    keys = F.transform(good, lambda s: F.regexp_replace(s, r"(?U)\s+", ""))
    return F.filter(F.transform(good, lambda s, i: F.when(F.array_position(keys, F.regexp_replace(s, r"(?U)\s+", "")) == i + 1, s)), lambda s: s.isNotNull())


def count_contained(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words stand in the text."""
    return sum([F.contains(text, F.lit(w)).cast("int") for w in words], F.lit(0))


def term_pattern(term: str) -> str:
    """ASCII terms need word borders; `R` is no part of `R&D`."""
    plain = re.escape(term)
    if re.fullmatch(r"[A-Za-z0-9+#.\- ]+", term):
        return f"(?<![A-Za-z0-9]){plain}(?![A-Za-z0-9{'&' if term == 'R' else ''}])"
    return plain


def mentions(text: Column, term: str) -> Column:
    return text.rlike(term_pattern(term))


def is_word(term: str) -> bool:
    """A term that is one ASCII word, found as a whole word only."""
    return bool(re.fullmatch(r"[A-Za-z0-9]+", term)) and term != "R"


def words_in(text: Column, words: list[str]) -> Column:
    """Which of the words (see is_word) stand in the text as whole words, by one pass over it."""
    if not words:
        return F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?<![A-Za-z0-9])({'|'.join(words)})(?![A-Za-z0-9])"), 1))


def page_score(text: Column, core: tuple[str, ...], aux: tuple[str, ...]) -> Column:
    """Signals in the text without white space; two core signals make four points at least."""
    plain = F.regexp_replace(text, r"(?U)\s+", "")
    c, a = count_contained(plain, core), count_contained(plain, aux)
    return F.when(c >= 2, F.greatest(F.lit(4), c + a)).otherwise(c + a)


def usable(status: Column, source: Column, length: Column, signals: Column) -> Column:
    return (status == "ok") & F.when(source == "ocr", length >= 200).otherwise((length >= 1500) | ((length >= 500) & (signals >= 4)))


def quote_verified(quote: Column, source: Column) -> Column:
    """A quote of four characters or more, its outer quotation marks apart, that stands in the source, white space apart."""
    plain = lambda c: squeezed(F.regexp_replace(F.coalesce(c, F.lit("")), "\u200b", ""))
    return let(F.btrim(plain(quote), F.lit(QUOTES)), lambda q: (F.length(q) >= 4) & F.contains(plain(source), q))


def grounded(sentence: Column, source: Column) -> Column:
    """At least half of the sentence's words (two letters or more) stand among the source's words."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w{2,})"), 1)
    own = words(sentence)
    there = F.filter(own, lambda w: F.array_contains(words(source), w))
    return (F.length(sentence) >= 6) & (2 * F.size(there) >= F.size(own)) & (F.size(own) > 0)


def all_terms(text: Column, query: Column) -> Column:
    """Every white-space separated term of the query stands in the text (lower case)."""
    return F.forall(F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != ""), lambda t: F.contains(F.lower(text), t))


def html_text(html: Column) -> Column:
    """Markup to text: scripts and styles off, tags to line breaks, common entities, blanks squeezed."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", ""), r"<[^>]+>", "\n")
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(mark))
    return F.btrim(F.regexp_replace(F.regexp_replace(t, "[ \\t\u00a0]+", " "), r"\n\s*\n+|\n{2,}", "\n"), F.lit(" \n"))


def script_strings(html: Column, script: str = HANGUL, least: int = 40) -> Column:
    """Quoted strings of `least` characters or more in a page's scripts that hold a letter of the script, each once, in order."""
    scripts = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), 1), "\n")
    found = F.regexp_extract_all(scripts, F.lit(rf'"((?:[^"\\\n]|\\.){{{least},}})"'), 1)
    return F.array_distinct(F.filter(found, lambda s: s.rlike(script)))


def page_text(html: Column, script: str = HANGUL, enough: int = 500) -> Column:
    """The text of a page; if it is short, with the strings of its scripts behind it."""
    plain = html_text(html)
    return F.when(F.length(plain) >= enough, plain).otherwise(F.btrim(F.concat_ws("\n", plain, F.array_join(script_strings(html, script), "\n")), F.lit(" \n")))


def code_of_uri(uri: Column) -> Column:
    return F.regexp_extract(uri, r"_(\d{2,8})\s*$", 1)


def summary(names: Column, n: int = 5) -> Column:
    more = F.size(names) - n
    return F.concat(F.array_join(F.slice(names, 1, n), " · "), F.when(more > 0, F.concat(F.lit(" 외 "), more.cast("string"), F.lit("개"))).otherwise(""))


def urgency(days: Column) -> Column:
    """Step function of the days left."""
    return F.when(days <= 0, 1.0).when(days <= 1, 0.95).when(days <= 3, 0.8).when(days <= 7, 0.5).when(days <= 14, 0.3).otherwise(0.15)
