"""Classification tables to codes, against the rules written plainly."""

import random
import re
from collections import Counter

from matchloom.operators import taxonomy as tx

TAXONOMY = [
    ("01", "사업관리"), ("02", "경영·회계·사무"), ("20", "정보통신"),
    ("0101", "사업 관리"), ("0201", "기획사무"), ("0202", "총무,인사"), ("2001", "정보기술"),
    ("010101", "프로젝트관리"), ("020101", "경영기획"), ("020201", "총무"), ("020202", "법무"), ("200101", "정보기술개발"), ("200102", "법무"),
    ("01010101", "프로젝트 관리"), ("02010101", "경영 기획"), ("20010101", "응용SW엔지니어링"), ("20010202", "DB엔지니어링"), ("20010203", "DB엔지니어링"),
]
LEAD, PAIR = re.compile(r"^\s*(\d{2})\s*[.．·:]?\s*"), re.compile(r"(\d{2})\s*[.．·]\s*([가-힣][가-힣A-Za-z·.ㆍ,／/\s]{1,24})")
MAJOR, OTHER = re.compile(r"^\s*대\s*분\s*류\s*$"), re.compile(r"^\s*[중소세]\s*분\s*류\s*$")
norm = lambda s: re.sub(r"[·․‧∙・･ㆍ⋅ž,]|\s", "", s)
TOP = {c: n for c, n in TAXONOMY if len(c) == 2}
BY_NAME = {norm(n): c for c, n in TOP.items()}


def major_of(cells):
    for c in cells:
        for code, name in PAIR.findall(c):
            if code in TOP and norm(TOP[code]) == norm(name):
                return code, 1
    for c in cells:
        if norm(LEAD.sub("", c)) in BY_NAME:
            return BY_NAME[norm(LEAD.sub("", c))], 2
    for i, c in enumerate(cells[:-1]):
        m = LEAD.match(cells[i + 1])
        if MAJOR.match(c) and not OTHER.match(cells[i + 1]) and m and m[1] in TOP:
            return m[1], 3
    heads = [i for i, c in enumerate(cells) if MAJOR.match(c) or OTHER.match(c)]
    if heads and heads[-1] + 1 < len(cells):
        m = LEAD.match(cells[heads[-1] + 1])
        if m and m[1] in TOP:
            return m[1], 4
    return "", 0


def resolved(region, hint):
    if not region:
        return None, "empty", 0
    cells = [c.strip() for c in region.splitlines() if c.strip()][:80]
    major, rule = (BY_NAME[norm(hint)], 0) if hint and norm(hint) in BY_NAME else major_of(cells)
    for level in (8, 6, 4):
        names = {}
        for code, name in TAXONOMY:
            if len(code) == level:
                names.setdefault(norm(name), []).append(code)
        hits = []
        for c in cells:
            key = norm(LEAD.sub("", c))
            codes = names.get(key, []) if len(key) >= 2 else []
            if not codes and len(key) >= 5:
                codes = next((v for k, v in names.items() if len(k) == len(key) and sum(a != b for a, b in zip(k, key)) <= 1), [])
            hits += [x for x in codes if x.startswith(major)]
        if hits:
            return Counter(hits).most_common(1)[0][0], "name", rule
    return (major, "major", rule) if major else (None, "none", rule)


def test_resolve(spark):
    rng = random.Random(17)
    parts = ["대분류", " 대 분 류 ", "중분류", "소 분류", "세분류", "20", "20.", "02. 경영·회계·사무", "20.정보통신 02", "99. 없는것", "정보통신", "01 사업관리", "20.", "77", "코드 없음", "법무", "01. 법무", "DB엔지니어링",
             "총무인사", "정보기술개밭", "응용SW엔지니어림", "경영 기획", "프로젝트관리", "기획사무", "정", "긴 설명 글", "20. 경영·회계·사무", "02．경영 회계 사무 01. 사업관리"]
    docs = []
    for i in range(1500):
        cells = [rng.choice(parts) for _ in range(rng.choice((0, 1, 2, 3, 5, 8)))]
        hint = rng.choice((None, None, None, "정보 통신", "없는 이름", ""))
        docs.append((i, rng.choice(("\n", "\r\n", "\n \n")).join(cells), hint))
    docs += [(5000, None, None), (5001, "", "정보통신"), (5002, "  ", None), (5003, "\n".join(["글"] * 80 + ["법무"]), None)]
    table = spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(TAXONOMY)], "pos int, code string, name string")
    df = spark.createDataFrame(docs, "doc long, region string, hint string")
    got = {r.doc: (r.code, r.how) for r in tx.resolve(df, table).collect()}
    want = {d: resolved(r, h) for d, r, h in docs}
    assert {d: w for d, w in got.items() if w != want[d][:2]} == {} and len(got) == len(docs)
    # Each rule, each level and each outcome occurs.
    assert {w[2] for w in want.values()} == {0, 1, 2, 3, 4} and {w[1] for w in want.values()} == {"empty", "name", "major", "none"}
    assert {len(w[0]) for w in want.values() if w[0]} == {2, 4, 6, 8}
    assert {r.doc: r.code for r in tx.resolve(df.where("doc = 5003"), table, most=None).collect()} == {5003: "020202"}
