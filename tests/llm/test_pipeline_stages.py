"""Each stage of the pipeline against a plain version of its rule, with clashing columns, repeats, nulls and no rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

pytest.importorskip("public_tokenizers")
CLASH = "kept score rejected keep_id group_size n_hit spans items contaminated n_shingles component_id passing_0 passing_5 ids".split()
RNG = random.Random(21)
WORDS = [a + b for a in ("al", "be", "Ci", "do", "é") for b in ("na", "ro", "X", "tu", "ß", "v", "mi")]
say = lambda n: " ".join(RNG.choice(WORDS) for _ in range(n))
ITEM = say(30)
TEXTS = [say(60) for _ in range(25)]
ROWS = list(enumerate(TEXTS)) + [
    (100, TEXTS[0]), (101, TEXTS[1] + " tail"), (102, "12 34"), (103, say(40) + " " + ITEM), (104, None), (105, ""), (106, " \n"), (107, TEXTS[2].replace(" ", "\t", 3)),
    (108, "Zz " + TEXTS[3] + " " + TEXTS[4]), (109, say(9000)), (3, TEXTS[3]), (None, TEXTS[5]), (None, "no number " + say(20)), (110, ITEM), (111, say(2000) + " " + " ".join(ITEM.split()[:13])),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("mine") for c in CLASH})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def exact(rows):
    best = {}
    for i, t in rows:
        key = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        best[key] = min([x for x in (best.get(key, i), i) if x is not None], default=None)
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        key = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        if key not in seen and i == best[key]:
            seen.add(key)
            out.append((i, t))
    return out


def near(rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = [re.findall("[^\x20\x09-\x0d]+", low(t)) for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    head = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    head[a] = head[b] = min(head[a], head[b], key=lambda i: rows[i][0])
    return [r for i, r in enumerate(rows) if r[0] is None or rows[head[i]][0] == r[0]]


def clean(rows):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    item = words(ITEM)
    windows = {tuple(item[k : k + 13]) for k in range(len(item) - 12)}
    out = []
    for i, t in rows:
        w, hit = words(t), set()
        for k in range(len(w) - 12):
            if tuple(w[k : k + 13]) in windows:
                hit |= set(range(k, k + 13))
        if not hit or 20 * len(hit) < len(w):
            out.append((i, t))
    return out


@pytest.mark.parametrize(("stage", "rule"), [("exact_dedup", exact), ("near_duplicates", near), ("decontaminate", clean)])
def test_stage(spark, tables, stage, rule):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    found = dict(cp.STAGES)[stage](spark, docs, tables)
    assert found.columns == docs.columns and found.schema == docs.schema
    rows = found.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(rule(ROWS), key=str)
    assert all(r[c] == "mine" for r in rows for c in CLASH)


def test_language_stage(spark, tables):
    """Letterless texts go; the others, all in the one language there is, stay with their columns."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    found = cp.language_id(spark, docs, tables)
    rows = found.collect()
    assert found.columns == docs.columns and all(r[c] == "mine" for r in rows for c in CLASH)
    gone = {"12 34", None, "", " \n"}
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted((r for r in ROWS if r[1] not in gone), key=str)


def test_tokens_stage(spark, tables):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = cp.byte_bpe(spark, spark.read.parquet(f"{tables}/documents.parquet"), tables).collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=str) == sorted(((i, own.encode_ordinary(t or "")) for i, t in ROWS), key=str)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_no_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.count() == 0 and len(docs.columns) == 5 + len(CLASH)
    assert cp.byte_bpe(spark, docs, tables).count() == 0
