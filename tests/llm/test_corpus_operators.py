"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import op1_jaccard_join as op1
from matchloom.llm import op2_licenses as op2
from matchloom.llm import op3_secrets as op3
from matchloom.llm import op4_line_dedup as op4
from matchloom.llm import op5_html_text as op5
from matchloom.llm import op6_language as op6
from matchloom.llm import op7_substring_dedup as op7
from matchloom.llm import op8_decontaminate as op8
from matchloom.llm import op9_byte_bpe as op9
from matchloom.llm import op10_exact_dedup as op10
from matchloom.llm.components import components

tokenizers = pytest.importorskip("public_tokenizers")
WORDS = [a + b for a in ("al", "be", "Ci", "do", "é", "f1") for b in ("na", "ro", "X", "tu", "ß", "v")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(1, 90)) for _ in range(40)]
    base = prose(rng, 300)
    for i in range(25):  # near copies of one text
        words = base.split()
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 50)} {passage}\n{prose(rng, 20)}" for _ in range(10)]
    texts += [None, "", "  \n ", "one", "One", "one two", "a b c", "A\tb  c", texts[3], texts[3], prose(rng, 4000), "same line here\nsame line here\nother", "x\nSAME line here  \n"]
    return [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (6, "another text with the same number")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Extra columns, one named like results of several operators.
    return spark.createDataFrame([(i, t, "clash", None) for i, t in rows], "doc_id long, text string, kept string, spans int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, kept string")


def words(text, pattern=rb"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").encode())


def test_exact_dedup(spark, docs, rows):
    got = op10.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups[norm(t)].append(i)
    want = Counter((i, min(groups[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert op10.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_hot_group(spark):
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot  text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = op10.exact_dedup(many)
    assert got.where("text like 'hot%'").select("keep_id", "group_size").distinct().collect() == [(0, 2500)]
    assert got.where("kept").count() == 2501
    nulls = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.keep_id), r.kept) for r in op10.exact_dedup(nulls).collect()) == [("3", "3", True), ("None", "3", False), ("None", "3", False), ("None", "None", True)]


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_join(spark, docs, rows, size, percent):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in op1.near_duplicates(docs, size=size, percent=percent).collect()}
    sets = []
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        sets.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())))
    head = {i: i for i, _ in rows}

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                i, j = top(sets[a][0]), top(sets[b][0])
                head[max(i, j)] = min(i, j)
    assert got == {(i, len(s)): top(i) for i, s in sets}


def test_jaccard_join_large_cells(spark, monkeypatch):
    monkeypatch.setattr(op1, "BLOCK", 8)
    rng = random.Random(3)
    base = [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    test_jaccard_join(spark, df, list(enumerate(texts)), 3, 90)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21)] + [(30 + i, 31 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[9] == got[1] == 1 and got[21] == 20 and got[70] == 30


def test_licenses(spark):
    texts = ["Foo. Licensed under the Apache License, Version 2.0.", "Redistributions of source code must retain the above copyright notice; x.\nRedistributions in binary form must reproduce the above copyright notice.",
             "Redistributions of source code must retain the above copyright notice.\nRedistributions in binary form must reproduce the above copyright notice.\nNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products.",
             "Redistributions in binary form must reproduce the above copyright notice.\nRedistributions of source code must retain the above copyright notice.", None, "", "licence"]
    got = [r.licenses for r in op2.find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [["Apache-2.0"], ["BSD-2-Clause"], ["BSD-3-Clause"], [], [], [], []]
    assert all(re.search(op2.HINTS, s) for s in op2.SENTENCES.values())


MIT = """MIT License

Copyright (c) 2020 Someone. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at"""
BSD = """Copyright (c) 2010, Some Corp. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of Some Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """ * This program is free software{} you can redistribute it and/or modify
 * it under the terms of the GNU {}General Public License as published by
 * the Free Software Foundation{} either version {} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""


def test_licenses_whole_texts(spark):
    cases = [(MIT, ["MIT"]), (" ".join(MIT.split()), ["MIT"]), (APACHE, ["Apache-2.0"]), (BSD, ["BSD-2-Clause"]), (BSD + ENDORSE, ["BSD-3-Clause"]), (BSD.replace("\n", "\r\n"), ["BSD-2-Clause"]),
             (GPL.format(";", "", ";", "2"), ["GPL-2.0"]), (GPL.format(":", "", ",", "3"), ["GPL-3.0"]), (GPL.format(":", "Affero ", ",", "3"), ["AGPL-3.0"]), (MPL, ["MPL-2.0"]),
             ("Copyright 2020 Foo Inc. All rights reserved.", ["proprietary"]), ("Not all rights reserved here", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert [r.licenses for r in op2.find_licenses(df).orderBy("doc_id").collect()] == [want for _, want in cases]
    own = op2.find_licenses(df.limit(1).selectExpr("0 as doc_id", "'a\nfrobnicate\nfreely. b' as text"), sentences={"own": "frobnicate freely"}, rules=(("own", ("own",), ()),)).head()
    assert own.licenses == ["own"]


def test_secrets(spark):
    texts = ['x API_KEY = "abcdef12" y', "AKIA" + "A1B2" * 5, "z " + "0123456789abcdef" * 2, "token: abc", "pAssWord='Zx9'", None, "", "key 7fKq2LmZx9RtVb4NcY8W end", "example7fKq2LmZx9RtVb4NcY8W", "plainlowercasewordsarenosecrets"]
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in op3.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == [("assign", 2, 21)] and got[1][0] == ("access", 0, 24)
    assert ("hex", 2, 34) in got[2]
    assert all(got[i] == [] for i in (3, 4, 5, 6, 8, 9))
    assert [k for k, _, _ in got[7]] == ["entropy_alnum", "entropy_base64"]


def test_secrets_allowed_part():
    allow = re.compile("|".join(f"(?:{a})" if not a.startswith("(?i)") else f"(?i:{a[4:]})" for a in op3.ALLOW), re.S)
    key = "7fKq2LmZx9RtVb4NcY8W"
    for text in (f"sample_db={key}", f"/examples/{key}", f"{key}/dummy"):
        at = text.index(key)
        assert ("entropy_alnum", at, at + 20) in op3.secrets_of(text, allow)
        assert any(k == "entropy_base64" and a <= at and b >= at + 20 for k, a, b in op3.secrets_of(text, allow))
    for text in (f"example{key}", f"x/sample_{key}/y", "some/path/of-words/without/any-digits/qwertz", "id/123e4567-e89b-12d3-a456-426614174000"):
        assert not [s for s in op3.secrets_of(text, allow) if s[0] == "entropy_alnum"]


def test_entropy_windows():
    rng = random.Random(1)
    members = frozenset("abcdef0123")
    for _ in range(200):
        text = "".join(rng.choice("abcdef0123-") for _ in range(rng.randint(0, 60)))
        hit = [False] * (len(text) + 1)
        for i in range(len(text) - 7):
            part = text[i : i + 8]
            if set(part) <= members and -sum(c / 8 * np.log2(c / 8) for c in Counter(part).values()) >= 2.5 - 1e-9:
                hit[i : i + 8] = [True] * 8
        got = [False] * (len(text) + 1)
        for a, b in op3.dense_stretches(text, members, 2.5, 8):
            got[a:b] = [True] * (b - a)
        assert got == hit


def test_line_dedup(spark, docs, rows):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in op4.line_dedup(docs, batches=4, fanout=2).collect())
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    owner = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            owner[key(x)] = min(i, owner.get(key(x), i))
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == i]
        want[(i, len(lines), len(lines) - len(stay), "\n".join(stay))] += 1
    assert got == want
    assert op4.line_dedup(empty(spark)).count() == 0


def test_html_text(spark):
    page = ('<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a> menu words</nav><div class="cookie-notice">We use cookies here</div><article><h1>A &amp; B</h1><p>First <b>para</b>\n'
            'graph.<br><p>Second para &lt;x&gt; with more words.</p><aside>side words</aside><div class="ad">buy now</div><p>Third one.</p></article><section id="comments"><p>Great post indeed thanks a lot</p></section>'
            '<form><p>Sign up</p></form><footer>(c)</footer></body></html>')
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>only words without a frame, but many of them here</p>"), (5, "<nav>x</nav>")], "page_id long, html string")
    got = {r.page_id: r.text for r in op5.extract(pages).collect()}
    assert got[1] == "A & B\nFirst para graph.\nSecond para <x> with more words.\nThird one."
    assert got[2] == got[3] == got[5] == "" and got[4].startswith("only words")


def test_html_ambiguous_names(spark):
    article = ("<article><div class='post-header'><h1>A title</h1></div><p>First words of it.</p><section id='related-work'><p>Work before this.</p></section>"
               "<section id='social-history'><p>History of people.</p></section><div class='share-buttons'>tweet this</div></article>")
    want = "A title\nFirst words of it.\nWork before this.\nHistory of people."
    pages = [f"<body><div class='page has-sidebar'>{article}</div></body>", f"<body><div class='header'><main>{article}</main></div></body>",
             f"<body>{article}<section class='comments'><article class='c1'><p>me too</p></article></section><aside><article><p>other story</p></article></aside></body>"]
    got = [r.text for r in op5.extract(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).orderBy("page_id").collect()]
    assert got == [want] * 3
    # Outside a marked article, what was learned of the name decides.
    page = "<div><p>many good words stand here in a row" + " and more" * 20 + "</p><div class='post-tags'><p>one two</p></div><p>and many more of them" + " again" * 20 + " stand here</p></div>"
    key = next(k for kind, k, *_ in op5.events(page) if k.startswith("?"))
    said = {w: op5.main_text(page, {"word": {key: w}, "tag": {}})[0] for w in (1.0, -1.0)}
    assert "one two" in said[1.0] and "one two" not in said[-1.0] and said[-1.0].endswith("stand here")


def test_language(spark):
    rng = random.Random(5)
    lex = {"aa": ["shor", "then", "wick", "thing"], "bb": ["élan", "çois", "queux", "tre"], "cc": ["ñado", "ción", "rrez", "lla"]}
    data = [(i, " ".join(rng.choice(lex[k]) for _ in range(30)), k) for i, k in enumerate(list(lex) * 40)]
    df = spark.createDataFrame(data + [(900, None, "aa"), (901, "12 34", None), (902, "漢字漢字漢字", None)], "doc_id long, text string, lang string")
    model = op6.fit(df.where(~op6.is_held_out()))
    got = {r.doc_id: r for r in op6.predict(df, model).collect()}
    assert all(got[i].lang_pred == k and not got[i].rejected for i, _, k in data)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].rejected
    nothing = op6.predict(df, op6.fit(df.where("false")))
    assert nothing.where("lang_pred <> 'und'").count() == 0


def test_language_rejects_unlearned(spark):
    rng = random.Random(6)
    lex = {"aa": "the of and to in is that it was for on are with as his they at be this from have".split(), "bb": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split()}
    ends = {"aa": ["ing", "tion", "ly", "ness"], "bb": ["ung", "keit", "lich", "chen"]}
    text = lambda k, n: " ".join(rng.choice(lex[k]) + (rng.choice(ends[k]) if rng.random() < 0.3 else "") for _ in range(n))
    data = [(i, text(k, rng.randint(30, 400)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    model = op6.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    junk = {"cyrillic": [chr(c) for c in range(0x430, 0x450)], "han": [chr(c) for c in range(0x4E00, 0x5E00)], "consonants": list("bcdfghjklmnpqrstvwxz"), "latin": list("abcdefghijklmnopqrstuvwxyz")}
    bad = ["".join(rng.choice(letters) + " " * (rng.random() < 0.17) for _ in range(n)) for letters in junk.values() for n in (200, 1000, 4000, 20000)]
    good = [(text(k, n), k) for k in lex for n in (6, 12, 60, 4000) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate([*bad, *[t for t, _ in good]])), "doc_id long, text string")
    got = op6.predict(df, model).orderBy("doc_id").collect()
    assert all(r.rejected for r in got[: len(bad)])
    assert [(r.lang_pred, r.rejected) for r in got[len(bad) :]] == [(k, False) for _, k in good]
    assert not any(r.rejected for r in op6.predict(df, model, floor=0.0).collect())


def test_substring_dedup(spark, docs, rows):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in op7.substring_dedup(docs).collect())
    split = [(i, [x.decode() for x in words(t)]) for i, t in rows]
    seen = Counter(tuple(w[k : k + 35]) for _, w in split for k in range(len(w) - 34))
    want = Counter()
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))] += 1
    assert got == want
    assert op7.substring_dedup(empty(spark)).count() == 0


def test_decontaminate(spark, docs, rows, monkeypatch):
    items = [(1, " ".join(rows[45][1].split()[10:40])), (2, "one"), (10, rows[2][1]), (11, None), (12, " ,. "), (13, "do al do")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    fold = lambda t: re.findall(pattern, (t or "").encode().lower())
    want = Counter()
    for i, t in rows:
        w = fold(t)
        hit, owners = [False] * len(w), set()
        for item, text in items:
            q = fold(text)
            n = min(len(q), 13)
            for a in range(len(q) - n + 1 if q else 0):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == q[a : a + n]:
                        hit[k : k + n] = [True] * n
                        owners.add(str(item))
        want[(i, len(w), sum(hit), tuple(sorted(owners)), sum(hit) > 0 and 20 * sum(hit) >= len(w))] += 1
    for limit in (16 << 20, 64):  # one block, then several
        monkeypatch.setattr(op8, "BLOCK_BYTES", limit)
        monkeypatch.setattr(op8, "SHARD_WORDS", 200 if limit == 64 else 1 << 17)
        got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in op8.find_contamination(docs, bench).collect())
        assert got == want
    assert op8.find_contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_fm_index():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 5, 400)
    index = op8.FMIndex(text, 5)
    for n in (1, 2, 5):
        phrases = rng.integers(1, 5, (50, n))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_byte_bpe(spark, docs, rows):
    import base64

    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    odd = ["".join(rng.choice("ab1.'s \n\t  \xa0\x1cé中😀<|endoftext|>") for _ in range(rng.randint(0, 25))) for _ in range(500)] + ["a" * 3000, "thth" * 500]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = op9.decode(op9.encode(more, path, tokenizers.PATTERN), path).collect()
    assert all(list(r.ids) == own.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "") for r in got)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(4)
    texts = [prose(rng, 80) for _ in range(30)]
    item = prose(rng, 30)
    data = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    data += [(100, texts[0], "en", "s", 1), (101, texts[1] + " tail", "en", "s", 1), (102, "12 34", "en", "s", 5), (103, prose(rng, 40) + " " + item, "en", "s", 1), (104, None, None, None, None)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = cp.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == list(range(30))
    assert got.where("not round_trip").count() == 0
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "near_duplicates", "decontaminate", "byte_bpe"]
