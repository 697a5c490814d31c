"""Main text of web pages by the maximum-scoring subsequence of words and tags.

Method. A page is a sequence of words and tags. A word scores by the log odds that words in its
context (enclosing block tag and class) are content, a tag by the log odds of standing outside, which
makes it negative. One linear scan finds the contiguous region with the largest sum; its blocks are
the text. The weights are counted over all labelled pages, which are those whose authors marked the
article with <article> or <main>; rules that need no data (PRIOR and the boilerplate names) smooth
them, so a page of an unknown kind works too. The label itself is no input of the scan: only contexts
and tags are. Menus, forms, notices and the like inside the region are left out; words of those that
were learned to stand inside articles count nothing, so that an advert between two paragraphs doesn't
cut it. A name that only contains a boilerplate word (post-header, related-work) is ambiguous: all
words under it have its context, and the learned weight of that decides. An article starts anew,
whatever the names around it, unless it lies in a menu, an aside, comments or the like.

Two mapInArrow passes over whole pages (counting and extracting); between them a sum per context,
combined before its shuffle, whose size TAGS and CLASSES bound.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import exp, log
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.common import slices, table, without

#: Elements whose content is no markup.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg")
START = re.compile(rf"<(?:!--|(?P<raw>{'|'.join(RAW)})\b|(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9]*)|[!?/])", re.I)
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
SPECIAL = re.compile("[>\"']")
CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Tags with weights of their own; all others share one.
TAGS = INLINE | frozenset(
    "address area article aside audio base blockquote body br button canvas caption col colgroup datalist dd details dialog div dl dt embed fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe input legend li link main map menu meta nav noscript object ol optgroup option output p param picture pre progress script "
    "search section select source style summary svg table tbody td template textarea tfoot th thead title tr track ul video center".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the same group ends.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Block elements that end an open p.
NO_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
BOILER_TAGS = frozenset("head title nav footer aside form button select option menu dialog script style noscript template iframe svg textarea object canvas audio video".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments disqus consent cookie cookies copyright footer header masthead menu nav navbar navigation "
    "newsletter notice notices pagination popup promo promoted promotion related recommended respond search share sharing sidebar signup social sponsor sponsored subscribe subscription "
    "tags toolbar widget contentinfo complementary".split()
)
#: With boilerplate words alone or with these, a name is boilerplate; with other parts it is ambiguous.
AROUND = frozenset("site global top bottom left right primary secondary main container wrapper wrap box block area inner outer list bar bars link links button buttons form item items posts articles stories icons icon".split())
#: Whole names of what may hold other articles than the page's.
OTHERS = frozenset("comment comments disqus respond related recommended sidebar promo promoted sponsored widget".split())
MARKED = ("article", "main")
CLASSES, SMOOTH = 512, 50.0
#: Log odds before any page is seen: words of plain blocks, words of boilerplate, tags.
PRIOR = {"word": 1.0, "boiler": -2.0, "tag": -1.0}


def parts_of(name: str) -> list[str]:
    return [x for x in re.split(r"[-_\s]+", name.lower()) if x]


def is_boiler(tag: str, names: list[str], inside: bool) -> bool:
    if tag in BOILER_TAGS or (tag == "header" and not inside):
        return True
    return tag not in ("html", "body", *MARKED) and any(BOILER_WORDS.intersection(p := parts_of(name)) and BOILER_WORDS.union(AROUND).issuperset(p) for name in names)


def ambiguous(tag: str, names: list[str]) -> str | None:
    """The first name that contains a boilerplate word among others."""
    if tag in ("html", "body", *MARKED):
        return None
    return next((n for n in names if BOILER_WORDS.intersection(p := parts_of(n)) and not BOILER_WORDS.union(AROUND).issuperset(p)), None)


def holds_others(tag: str, names: list[str]) -> bool:
    """Whether articles in this element aren't the page's."""
    return tag in BOILER_TAGS or (tag not in ("html", "body", *MARKED) and any(OTHERS.intersection(p := parts_of(n)) and BOILER_WORDS.union(AROUND).issuperset(p) for n in names))


class Tags:
    """Ends of tags, each in constant time on average, whatever is left open.

    A tag ends at the first > outside quotes. From a quote on, the way to that > is the same for every
    tag, so it is walked once and remembered; likewise the next special character.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.ends: dict[int, int] = {}  # by the place of an opening quote; -1: no end
        self.found = -1  # the next special character from some place on

    def close(self, at: int) -> int:
        """The place of the next >, or -1."""
        return self.html.find(">", at) if at <= self.last else -1

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose attributes begin here, or -1."""
        if at > self.last:
            return -1
        if self.found < at:
            self.found = SPECIAL.search(self.html, at).start()
        place, walked = self.found, []
        while self.html[place] != ">":
            if place in self.ends:
                place = self.ends[place]
                break
            walked.append(place)
            closed = self.html.find(self.html[place], place + 1)
            following = SPECIAL.search(self.html, closed + 1) if closed >= 0 else None
            place = following.start() if following else -1
            if place < 0:
                break
        self.ends |= dict.fromkeys(walked, place)
        return place


def tokens(html: str) -> Iterator[tuple[int, int, str, bool, str, str]]:
    """(start, stop, raw element, whether an end tag, tag, attributes) of what isn't text; comments and the like have no names."""
    tags, at = Tags(html), 0
    while m := START.search(html, at):
        at = m.start() + 1  # where no token begins here
        if m[0] == "<!--":
            stop = html.find("-->", m.end())
            at = stop + 3 if stop >= 0 else len(html)
            yield m.start(), at, "", False, "", ""
            continue
        stop = -1
        if m["raw"] and (stop := tags.close(m.end())) >= 0:
            closed = RAW_END[m["raw"].lower()].search(html, stop + 1)
            at = closed.end() if closed else len(html)
            yield m.start(), at, m["raw"], False, "", ""
        elif m["name"] and (stop := tags.end(m.end())) >= 0:
            at = stop + 1
            yield m.start(), at, "", bool(m["end"]), m["name"], html[m.end() : stop]
        elif html[m.start() + 1] in "!?/" and (stop := tags.close(m.start() + 2)) >= 0:
            at = stop + 1
            yield m.start(), at, "", False, "", ""


def events(html: str) -> Iterator[tuple[str, str, str, bool, bool]]:
    """(kind, context or tag, text, boilerplate, marked as the article) in page order; kind is word, tag or break."""
    stack: list[tuple[str, str, bool, bool, bool]] = []  # tag, context, boilerplate, marked, whether in what holds others
    open_tags: Counter[str] = Counter()
    context, boiler, marked, at = "body", False, False, 0

    def state() -> tuple[str, bool, bool, bool]:
        for _, *rest in reversed(stack):
            return tuple(rest)
        return "body", False, False, False

    def pop() -> str:
        gone = stack.pop()[0]
        open_tags[gone] -= 1
        return gone

    def push(*entry) -> None:
        stack.append(entry)
        open_tags[entry[0]] += 1

    for start, stop, raw, ends, tag, attributes in tokens(html):
        if start > at:
            yield "word", context, html[at:start], boiler, marked
        at = stop
        if raw:
            yield "tag", raw.lower(), "", boiler, marked
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            yield "tag", tag, "", boiler, marked
            continue
        if tag == "br":
            yield "tag", tag, "", boiler, marked
            yield "word", context, " ", boiler, marked
            continue
        yield "break", tag, "", boiler, marked
        if ends:
            if open_tags[tag]:
                while pop() != tag:
                    pass
        elif tag == "body":
            while stack and stack[-1][0] != "html":
                pop()
            push("body", "body", False, False, False)
        elif tag not in VOID:
            for ended in ENDS.get(tag, ()) + (("p",) if tag in NO_P else ()):
                if stack and stack[-1][0] == ended:
                    pop()
            c, b, inside, others = state()
            names = [n for x in CLASS.findall(attributes) for n in "".join(x).split()]
            own = is_boiler(tag, names, inside)
            known = tag if tag in TAGS else "other"
            key = f"{known}#{crc32(names[0].encode()) % CLASSES}" if names else known
            if tag in MARKED:
                b = others
            elif c.startswith("?"):
                key = c
            elif unsure := ambiguous(tag, names):
                key = f"?{known}#{crc32(unsure.encode()) % CLASSES}"
            push(tag, key, b or own, inside or tag in MARKED, others or holds_others(tag, names))
        context, boiler, marked, _ = state()
        yield "tag", tag if tag in TAGS else "other", "", boiler, marked
    if at < len(html):
        yield "word", context, html[at:], boiler, marked


def census(html: str) -> dict[tuple[str, str, bool], int]:
    """Words and tags of one labelled page by context and label; nothing for pages without a label."""
    out: dict[tuple[str, str, bool], int] = {}
    labelled = False
    for kind, key, text, boiler, marked in events(html):
        labelled |= marked
        if kind != "break":
            n = len(text.split()) if kind == "word" else 1
            name = (kind, ("!" if boiler else "") + key, marked)
            out[name] = out.get(name, 0) + n
    return out if labelled else {}


def learn(pages: DataFrame, html_col: str = "html") -> dict:
    """Log odds of words by context and of tags, from the labelled ones of all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str, bool], int] = {}
        for batch in slices(batches, 0):
            for html in batch.column(0):
                for name, n in census(html.as_py() or "").items():
                    total[name] = total.get(name, 0) + n
        columns = list(zip(*[(*name, n) for name, n in total.items()])) or [(), (), (), ()]
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["kind", "key", "inside", "n"])

    counted = pages.select(F.col(f"`{html_col}`").cast("string").alias("html")).mapInArrow(run, "kind string, key string, inside boolean, n long")
    key = F.when(F.col("kind") == "tag", F.ltrim("key", F.lit("!"))).otherwise(F.col("key"))
    found = counted.groupBy("kind", key.alias("key")).agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("no"))
    return weights_of([(r["kind"], r["key"], r["yes"], r["no"]) for r in found.collect()])  # TAGS times CLASSES times three at most


def weights_of(rows: list[tuple[str, str, int, int]]) -> dict:
    """Log odds from (kind, key, words or tags inside articles, and outside)."""
    weights: dict = {"word": {}, "tag": {}}
    tags = [(yes, no) for kind, _, yes, no in rows if kind == "tag"]
    inside, outside = (sum(n) + len(tags) or 1 for n in (zip(*tags) if tags else ((), ())))
    for kind, key, yes, no in rows:
        if kind == "tag":
            odds = log((yes + 1) / inside) - log((no + 1) / outside)
            weights["tag"][key] = max(-3.0, min(-0.05, odds / 2))
        elif key.startswith("!") and yes > no:
            weights["word"][key] = 0.0
        else:
            odds = exp(PRIOR["boiler" if key.startswith("!") else "word"])
            share = odds / (1 + odds)
            weights["word"][key] = max(-3.0, min(3.0, log((yes + SMOOTH * share) / (no + SMOOTH * (1 - share)))))
    return weights


def main_text(html: str, weights: dict) -> tuple[str, float]:
    """The best region's blocks, joined by newlines, and its score."""
    best, best_sum, run_sum, run_start = (0, 0), 0.0, 0.0, 0
    seen = list(events(html))
    words, tags = weights["word"], weights["tag"]
    for i, (kind, key, text, boiler, _) in enumerate(seen):
        if kind == "word":
            name = "!" + key if boiler else key
            weight = words.get(name)
            if weight is None:
                weight = words.get(name.split("#")[0].replace("?", ""), PRIOR["boiler" if boiler else "word"])
            run_sum += len(text.split()) * (min(weight, 0.0) if boiler else weight)
        elif kind == "tag":
            run_sum += tags.get(key, PRIOR["tag"])
        if run_sum <= 0:
            run_sum, run_start = 0.0, i + 1
        elif run_sum > best_sum:
            best, best_sum = (run_start, i + 1), run_sum
    blocks, parts = [], []
    for kind, key, text, boiler, _ in [*seen[best[0] : best[1]], ("break", "", "", False, False)]:
        if kind == "word" and not boiler and (not key.startswith("?") or words.get(key, 0.0) >= 0):
            parts.append(unescape(text))
        elif kind == "break" and parts:
            blocks.append(" ".join("".join(parts).split()))
            parts = []
    return "\n".join(b for b in blocks if b), best_sum


def extract(pages: DataFrame, html_col: str = "html", out: str = "text", weights: dict | None = None) -> DataFrame:
    """Add the main text of each whole page, and its region's score as `out`_score.

    Null and empty html give an empty text and score 0, as do pages where no word outweighs its
    tags. All input rows and columns stay (those named like a result give way). Without `weights`
    they are learned from `pages`. Repeated rows each get their text; an empty table gives an empty
    table; pages of any length are read whole.
    """
    rows = without(pages, out, f"{out}_score")
    at = rows.columns.index(html_col)
    shared = pages.sparkSession.sparkContext.broadcast(weights or learn(pages, html_col))
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType()), T.StructField(f"{out}_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            found = [main_text(html.as_py() or "", shared.value) for html in batch.column(at)]
            done = [pa.array([t for t, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *done], names=[*batch.schema.names, out, f"{out}_score"])

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "text_score")
