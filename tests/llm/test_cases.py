"""Defined cases of every operator: empty tables, nulls, repeats, clashing names, long texts; and labelled or brute-force checks."""

import random
import re

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

tokenizers = pytest.importorskip("public_tokenizers")
_RNG = random.Random(1)
LONG = " ".join(_RNG.choice(("alpha", "Beta", "gamma,", "delta.\n")) + str(i % 97) for i in range(60_000))
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (6, "same text of five words"), (6, "same text of five words"), (7, "same  text of five\twords"), (None, "no number here"), (None, None), (8, "😀 \x00 odd\x1f")]
#: Names that operators use inside, and those of their results.
CLASH = ("__node __component __id __of __row __gone __parts __key __starts __hit __words __spans __items __hash __head __piece __norm __sha __input __rank "
         "n_shingles COMPONENT_ID sentence_ids licenses spans n_lines n_dropped kept_text lang_pred score rejected n_words n_removed n_hit items contaminated ids decoded keep_id group_size kept text_sha256").split()


def bench(spark, rows=((1, "of five words"), (2, None), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def model(docs):
    return op6.fit(docs.where("doc_id is not null").withColumn("lang", F.lit("xx")))


PATH, PATTERN = tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN
OPERATORS = {
    "op1": lambda s, d: op1.near_duplicates(d),
    "op2": lambda s, d: op2.find_licenses(d),
    "op3": lambda s, d: op3.find_secrets(d),
    "op4": lambda s, d: op4.line_dedup(d, batches=2),
    "op6": lambda s, d: op6.predict(d, model(d)),
    "op7": lambda s, d: op7.substring_dedup(d),
    "op8": lambda s, d: op8.find_contamination(d, bench(s)),
    "op9": lambda s, d: op9.encode(d, PATH, PATTERN, decoded="decoded"),
    "op10": lambda s, d: op10.exact_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_cases(spark, name):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in CLASH})
    got = {}
    for r in OPERATORS[name](spark, docs).collect():
        got.setdefault((r.doc_id, r.text), []).append(r)
    assert sorted(map(str, got)) == sorted(map(str, set(ROWS))) and len(got[(6, "same text of five words")]) == 2
    one = {k[0]: v[0] for k, v in got.items() if k[0] is not None}
    # Columns that aren't results keep their values.
    assert all(r["__node"] == r["__id"] == r["__hash"] == "clash" for rows in got.values() for r in rows)
    if name == "op1":
        assert [one[i].component_id for i in (1, 2, 3, 4, 5, 6, 7)] == [1, 2, 3, 4, 4, 6, 6] and one[1].n_shingles == 0
        assert got[(None, "no number here")][0].component_id is None
    elif name == "op2":
        assert all(r.licenses == [] for rows in got.values() for r in rows)
    elif name == "op3":
        assert one[1].spans == [] and one[4].spans == one[5].spans
    elif name == "op4":
        assert one[1].kept_text == "" and one[1].n_lines == 1 and one[4].kept_text == LONG and one[5].n_dropped > 10_000
        assert got[(None, "no number here")][0].kept_text == "no number here"
        assert all(r.n_dropped == 0 for r in got[(6, "same text of five words")])
    elif name == "op6":
        assert one[1].lang_pred == one[2].lang_pred == one[3].lang_pred == "und" and one[4].lang_pred == "xx" and one[4].score == one[5].score
    elif name == "op7":
        assert one[4].n_words == len(re.findall(r"[^\x20\x09-\x0D]+", LONG)) == one[4].n_removed == one[5].n_removed and one[6].n_removed == 0 and one[1].kept_text == ""
    elif name == "op8":
        assert all(r.n_hit == 3 and r.contaminated and r["items"] == ["1"] for r in got[(6, "same text of five words")]) and not one[4].contaminated and one[1].n_words == 0
    elif name == "op9":
        assert all(bytes(r.decoded).decode() == (r.text or "") for rows in got.values() for r in rows) and list(one[1].ids) == []
    elif name == "op10":
        assert one[1].keep_id == one[2].keep_id == 1 and one[7].keep_id == 6 and one[7].group_size == 3 and one[4].group_size == 2
        assert sum(r.kept for r in got[(6, "same text of five words")]) == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    empty = spark.createDataFrame([], "doc_id long, text string, `__id` string, kept string")
    found = OPERATORS[name](spark, empty)
    assert found.count() == 0 and {"doc_id", "text", "__id"} <= set(found.columns)


def test_html_cases(spark):
    body = "<article><h1>T</h1><p>" + "many words of one long page " * 20_000 + "</p></article>"
    rows = [(1, None), (2, ""), (3, body), (3, body), (None, "<p>words words words words</p>"), (4, "<xyz1><xyz2>odd tags hold words as well</xyz2>")]
    pages = spark.createDataFrame([(i, h, "clash", "clash") for i, h in rows], "page_id long, html string, text string, other string")
    got = op5.extract(pages).collect()
    assert sorted((str(r.page_id), len(r.text)) for r in got) == sorted([("1", 0), ("2", 0), ("3", 2 + len("many words of one long page ") * 20_000 - 1), ("3", 2 + len("many words of one long page ") * 20_000 - 1), ("None", 23), ("4", 27)])
    assert all(r.other == "clash" for r in got)
    assert op5.extract(pages.where("false")).count() == 0


def test_html_hidden_labels(spark):
    """Weights from marked pages find the same text where the marks are hidden."""
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet with of and words".split()) for _ in range(n))
    pages, want = [], []
    for i in range(40):
        paragraphs = [say(rng.randint(15, 60)) for _ in range(rng.randint(2, 6))]
        advert = f"<div class='ad'>{say(8)}</div>"
        inner = advert.join(f"<p>{p}</p>" for p in paragraphs)
        links = "".join(f"<li><a href='/'>{say(1)}</a></li>" for _ in range(12))
        pages.append((i, f"<html><body><nav><ul>{links}</ul></nav><div class='top'>{say(3)}</div><article><h1>{say(4)}</h1>{inner}</article><ul class='tail'>{links}</ul><footer>{say(5)}</footer></body></html>"))
        want.append(paragraphs)
    df = spark.createDataFrame(pages, "page_id long, html string")
    weights = op5.learn(df)
    hidden = df.withColumn("html", F.regexp_replace("html", "<(/?)article", "<$1div"))
    for table in (df, hidden):
        got = [r.text.split("\n") for r in op5.extract(table, weights=weights).orderBy("page_id").collect()]
        assert [g[-len(w) :] for g, w in zip(got, want)] == want and all(len(g) <= len(w) + 1 for g, w in zip(got, want))


def test_secret_base_kinds():
    """Base spans against a plain scan by the contract's rules."""
    rng = random.Random(3)
    allow = re.compile("(?!)")
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", ":", "=", " ", "  ", "'", '"', "abcdef", "x1", "AKIA", "ABCD1234EFGH5678", "deadbeef" * 3, "0" * 23, ".", "\n", "é", "\u212a"]

    def plain(text):
        out = []
        for kind, pattern, flags, keep in (
            ("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", 0, lambda m: len(m[2]) >= 6),
            ("access", "AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
            ("hex", "[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
        ):
            out += [(kind, *m.span()) for m in re.finditer(pattern, text, flags) if keep(m)]
        return sorted(out, key=lambda s: (s[1], op3.KINDS.index(s[0])))

    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert [s for s in op3.secrets_of(text, allow) if s[0] in op3.BASE_KINDS] == plain(text)


def test_secret_entropy_recall():
    """Random keys without a keyword are found; words, paths, dates and identifiers are not."""
    rng = random.Random(4)
    allow = re.compile("|".join(f"(?:{a})" if not a.startswith("(?i)") else f"(?i:{a[4:]})" for a in op3.ALLOW), re.S)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    found = lambda t: any(k.startswith("entropy") for k, _, _ in op3.secrets_of(t, allow))
    keys = ["".join(rng.choice(letters) for _ in range(n)) for n in (32, 40, 64) for _ in range(100)]
    keys += ["".join(rng.choice(letters + "+/") for _ in range(44)) + "=" for _ in range(100)]
    assert sum(found(f"see {k} there") for k in keys) >= 0.97 * len(keys)
    clean = ["internationalization-of-very-long-names", "2024-01-01T10:20:30-2024-02-03", "/usr/local/share/documentation/package", "123e4567-e89b-12d3-a456-426614174000", "-" * 60, "word_" * 12, "0123456789012345678901234567"]
    assert not [c for c in clean if found(c)]


def test_voronoi_regions(spark, monkeypatch):
    """At the normal BLOCK a cell of near copies is parted by pivots, and no link is lost."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for family in range(3):
        base = [rng.choice(words) for _ in range(200)]
        for _ in range(150):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    seen = []
    compare = op1._compare
    monkeypatch.setattr(op1, "_compare", lambda rows, percent: seen.append(rows.where("pivot").count()) or compare(rows, percent))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in op1.near_duplicates(df, size=3, percent=80).collect()}
    assert seen[0] >= 3 * op1.PIVOTS
    sets = [{tuple(t.split()[k : k + 3]) for k in range(198)} for t in texts]
    head = list(range(len(sets)))

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                i, j = top(a), top(b)
                head[max(i, j)] = min(i, j)
    assert got == {i: top(i) for i in range(len(sets))}


def test_benchmark_without_names_and_in_blocks(spark):
    """Items without identifier, repeated ones, and many blocks give what one block gives."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    items = [(i if i % 5 else None, " ".join(rng.choice(words) for _ in range(rng.choice((1, 3, 13, 40))))) for i in range(30)] + [(7, "the same number with another text"), (None, None)]
    texts = [" ".join(rng.choice(words) for _ in range(50)) + " " + (items[i % 30][1] or "") for i in range(40)] + [None, "the same number with another text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, op8.find_contamination(docs, table).collect()))
    assert one == sorted(map(str, op8.find_contamination(docs, table, block_bytes=500).collect())) and any("items=[''" in r for r in one)


def test_hostile_texts_take_linear_time():
    """A megabyte of open quotes, open tags, stray end tags or joined keys takes seconds, not hours."""
    import time

    pages = ['<b "' * 250_000, "<div>" * 100_000 + "</p>" * 100_000, "<b " * 300_000 + '"', "</x " * 250_000, "<script " * 120_000, "<b '\"" * 200_000, "<!-- " * 200_000]
    allow = re.compile("|".join(f"(?:{a})" if not a.startswith("(?i)") else f"(?i:{a[4:]})" for a in op3.ALLOW), re.S)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rng = random.Random(9)
    run = "/".join("".join(rng.choice(letters) for _ in range(24)) for _ in range(40_000))
    for work in [*((lambda p=p: op5.main_text(p, {"word": {}, "tag": {}})) for p in pages), lambda: op3.secrets_of(run, allow)]:
        began = time.process_time()
        work()
        assert time.process_time() - began < 30


def test_merged_runs_stay_sorted(spark):
    """A merged run has one file for each bucket and is met without sorting or dealing it again, like a fresh one."""
    from matchloom.llm.common import shared_dir

    runs = op4.LineRuns(spark, shared_dir(spark, "runs"), 3)
    for b in range(4):
        ids = spark.range(b * 1000, b * 1000 + 3000)
        runs.add(ids.select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit("second"), "id").alias("h2"), "id"))
    assert [len(level) for level in runs.levels] == [1, 1]
    new = ids.select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit("second"), "id").alias("h2"), "id").groupBy(*op4.KEY).agg(F.min("id").alias("owner")).repartition(runs.buckets, *op4.KEY)
    with op4.sorted_scans(spark):
        for name in [name for level in runs.levels for name in level]:
            table = spark.table(name)
            plan = new.join(table.select(*op4.KEY).hint("merge"), op4.KEY, "left_anti")._jdf.queryExecution().executedPlan().toString()
            assert len(table.inputFiles()) == runs.buckets and plan.count("Sort [") == 1 and plan.count("Exchange") == 1
    assert {(r.id, r.owner) for r in ids.unionByName(spark.range(3000)).select(F.xxhash64("id").alias("h1"), "id").distinct().join(runs.owners(), "h1").select("id", "owner").collect()} == {(i, i) for i in [*range(3000), *range(3000, 6000)]}


WHOLE_TEXTS = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL", "GFDL-1.3": "GFDL", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


def test_licenses_on_whole_texts(spark):
    """Each legal text that the system has is told as what it is, hard wraps, CRLF and a rights line above it notwithstanding."""
    import os

    top = "/usr/share/common-licenses"
    there = {name: want for name, want in WHOLE_TEXTS.items() if os.path.isfile(f"{top}/{name}")}
    if not there:
        pytest.skip("no licence texts here")
    rows = []
    for name, want in there.items():
        text = open(f"{top}/{name}", encoding="utf-8", errors="replace").read()
        rows += [(name, text, want), (name + "+", "Copyright (c) Somebody. All rights reserved.\n\n" + text.replace("\n", "\r\n"), want)]
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is hereby granted, provided that the above copyright notice\nand this permission notice appear in all copies."
    rows += [("isc", "Copyright X. All rights reserved.\n\n" + isc, "ISC"), ("own", "Copyright X. All rights reserved.\nNo part may be copied.", "proprietary"), ("talk", "We read the Apache License, Version 2.0 and its preamble and definitions.", None)]
    got = {r.name: r.licenses for r in op2.find_licenses(spark.createDataFrame([(n, t) for n, t, _ in rows], "name string, text string")).collect()}
    assert got == {n: [w] if w else [] for n, _, w in rows}


SQL_FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_jaccard_join", "op2_licenses", "op4_line_dedup", "op7_substring_dedup", "op8_decontaminate", "op10_exact_dedup"])
def test_query_equals_sql(spark, name):
    import os

    from matchloom.llm import registry

    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SQL_FOLDER):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SQL_FOLDER}/{table}.parquet')")
    found = con.execute(registry.oracle_sql()[name])
    names = sorted(d[0] for d in found.description)
    rows = [dict(zip((d[0] for d in found.description), r)) for r in found.fetchall()]
    got = registry.queries()[name](spark, SQL_FOLDER)
    assert sorted(got.columns) == names
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(tuple(r[c] for c in names) for r in rows)
