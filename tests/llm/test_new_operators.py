"""Token files, the prefix trie and the divergence of sources against the library, plain loops and SQL."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import op11_token_files as op11
from matchloom.llm import op12_prefix_trie as op12
from matchloom.llm import op13_source_divergence as op13

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("word_bpe_49k.json")


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


# ---- token files


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 8 * 1001, dtype=np.uint32)
    data = op11.pack(ids, bits)
    assert len(data) == len(ids) * bits // 8 and (op11.unpack(data, bits) == ids).all()
    assert int.from_bytes(data[:8], "little") & ((1 << bits) - 1) == ids[0]


def test_stretches_equal_library():
    """Cutting at plain spaces changes nothing: marks, odd white space, contractions, special tokens, cases that grow."""
    rng = random.Random(11)
    parts = ["a", "It's", "'s", "don't", " ", "  ", "\n", "\t", "́", "é", "가", "İ", "ΣΑΣ", "ß", "12", "½", "。", "😀", " ", "​", " ", "<|endoftext|>", "<|startoftext|>", "--'ll", "\x00", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + [None, "", " ", "   "]
    import pyarrow as pa

    encoder = op11.Encoder(PATH)
    assert encoder.spaced
    for at in range(0, len(texts), 250):
        ids, ends = encoder.encode(pa.array(texts[at : at + 250], pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == library(texts[at : at + 250])


def test_other_tokenizer_takes_whole_texts(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        told = json.load(file)
    told["normalizer"] = None
    (tmp_path / "own.json").write_text(json.dumps(told), encoding="utf-8")
    encoder = op11.Encoder(str(tmp_path / "own.json"))
    import pyarrow as pa
    from tokenizers import Tokenizer

    ids, ends = encoder.encode(pa.array(["two words", None, "x"]))
    assert not encoder.spaced
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [e.ids for e in Tokenizer.from_file(str(tmp_path / "own.json")).encode_batch(["two words", "", "x"], add_special_tokens=False)]


def test_token_files(spark, tmp_path):
    rng = random.Random(12)
    texts = [(i, " ".join(rng.choice(("word", "Two", "three3", "é!", "x-y")) + str(rng.randrange(300)) for _ in range(rng.randrange(60)))) for i in range(700)]
    texts += [(None, "no number"), (None, None), (-5, ""), (3, "again"), (3, "again"), (9, "long words " * 30_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"start": F.lit("clash"), "ids": F.lit("clash")}).repartition(5)
    folder = str(tmp_path / "tokens")
    made = op11.write_tokens(docs, folder, PATH, end_id=1).orderBy("shard").collect()
    assert [m.start for m in made] == [sum(x.n_ids for x in made[:i]) for i in range(len(made))] and sum(m.n_docs for m in made) == len(texts)
    got = op11.read_tokens(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((t[0] for t in texts), key=lambda i: (i is not None, i or 0))
    want = Counter((i, tuple([*ids, 1])) for (i, _), ids in zip(texts, library([t for _, t in texts])))
    ids = [tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in got]
    assert Counter(zip((r.doc_id for r in got), ids)) == want and [r.n_tokens for r in got] == [len(i) for i in ids]
    assert [r.start for r in got] == [sum(map(len, ids[:i])) for i in range(len(ids))]
    # Random access over the borders of blocks and of documents.
    flat = [x for i in ids for x in i]
    for m in made:
        shard = op11.Shard(f"{folder}/{m.file}")
        assert shard.bits == 16
        for _ in range(40):
            a = rng.randrange(shard.n_ids)
            b = min(shard.n_ids, a + rng.choice((1, 7, 4096, 9000)))
            assert shard.ids(a, b).tolist() == flat[m.start + a : m.start + b]
        assert shard.ids(-3, 2).tolist() == flat[m.start : m.start + 2] and len(shard.ids(5, 5)) == 0
        shard.close()


def test_token_files_of_nothing(spark, tmp_path):
    op11.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"), PATH, end_id=1)
    assert op11.read_tokens(spark, str(tmp_path / "t")).count() == 0


# ---- prefix trie


def plain_trie(rows, block=20):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0), digest, (role or "", text or "")))
    turns = {c: [t[2] for t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - c % block, [])[:h] + turns[c][h:]) if block else tuple(turns[c])
    nodes = {w[:d] for w in whole.values() for d in range(len(w) + 1)}
    members = {n: sorted(c for c, w in whole.items() if w[: len(n)] == n) for n in nodes}
    out = []
    for n in nodes:
        below = [m for m in nodes if m[: len(n)] == n]
        words = lambda m: len(m[-1][1].encode().split()) if m else 0
        ends = ",".join(str(c) for c in members[n] if len(whole[c]) == len(n))
        out.append((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), sum(len(m) == len(n) + 1 for m in below),
                    sum(not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in nodes) for m in below), sum((len(members[m]) - 1) * words(m) for m in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(5)
    say = [None, "", "one", "two words", "a b\tc\nd", "é x"]
    rows = []
    for conv in [*range(0, 70), 100, 119, 1000]:
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn if turn or rng.random() < 0.8 else None, rng.choice(("user", "assistant", None)) if turn else "user", rng.choice(say)))
    rows += [(i, t, "user", "copied turn") for i in range(200, 260) for t in range(5)]  # a large group of copies
    rows += [(300, t, "user", f"turn {t}") for t in range(400)]  # a long one
    rows += [(61, 0, "user", "tie"), (61, 0, "user", "tie"), (61, 0, "user", "other"), (None, 1, "user", "nobody's"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize(("queue", "block"), [(op12.QUEUE, 20), (3, 20), (3, 0)])
def test_trie(spark, queue, block):
    """Equal to a plain trie; with a queue of three targets it spills at each level."""
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("key", "depth", "leaf", "digest", "KEY_")}).repartition(3)
    turns = op12.light_turns(table)
    got = op12.prefix_trie(op12.shared_heads(turns, block) if block else turns, queue)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rows, block)


def test_trie_of_nothing(spark):
    empty = op12.light_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert op12.prefix_trie(op12.shared_heads(empty)).count() == 0
    nobody = op12.light_turns(spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string"))
    assert op12.prefix_trie(nobody).count() == 0


def test_queue_spills(tmp_path):
    rng = random.Random(3)
    sent = [(-rng.randrange(5), bytes([rng.randrange(40)]), rng.randrange(9), rng.randrange(99)) for _ in range(3000)]
    queue = op12.SpillingQueue(str(tmp_path), 7)
    for s in sent:
        queue.push(*s)
    assert len(list(tmp_path.iterdir())) > 50
    for target in sorted({s[:2] for s in sent}):
        assert queue.pop(*target) == tuple(sum(s[i] for s in sent if s[:2] == target) for i in (2, 3))
    queue.close()
    assert not list(tmp_path.iterdir())
    queue.push(0, b"x", 1, 1)
    with pytest.raises(ValueError, match="1 totals"):
        queue.close()


# ---- divergence of sources


def plain_divergence(rows, least, top):
    import re

    kept, df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang].add(source)
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in groups:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        total = Counter({t: sum(counts[lang, s][t] for s in groups[lang]) for t in kept})
        price = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * len(kept))
        p = {s: {t: price(counts[lang, s][t], sum(counts[lang, s][x] for x in kept)) for t in kept} for s in groups[lang]}
        q = {t: price(total[t], sum(total.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups[lang]:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups[lang] if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, i + 1) for i, (t, v) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


def spoken(seed=7, n=400):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Größe", "été", "İx", "中文", "ab\x00cd", "x_y", "don't"]
    rows = []
    for i in range(n):
        skew = rng.choice((1, 2, 4))
        text = rng.choice((" ", "\n", "9", "-")).join(words[int(len(words) * rng.random() ** skew)] for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(("en", "fr", None, "")), rng.choice(("big",) * 6 + tuple("abcdefg") + (None, "é", "Z")), text))
    rows += [("xx", "alone", "only once here"), ("yy", "s1", None), ("yy", "s2", ""), ("en", "big", "very long text " * 20_000)] + [("fr", "a", "same row")] * 30
    return rows


@pytest.mark.parametrize(("tile", "terms", "cells"), [(op13.TILE, op13.TERMS, op13.CELLS), (3, 7, 50)])
def test_divergence(spark, monkeypatch, tile, terms, cells):
    """Equal to plain counts, also with several tiles, small blocks and many buckets."""
    for name, value in (("TILE", tile), ("TERMS", terms), ("CELLS", cells)):
        monkeypatch.setattr(op13, name, value)
    rows = spoken()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit("clash") for c in ("term", "n", "g", "TILE")}).repartition(4)
    got = sorted(tuple(r) for r in op13.divergence(docs, least=10, top=10).collect())
    assert got == plain_divergence(rows, 10, 10)


def test_blocks():
    """Halving and tiles give what a plain sum gives."""
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.7, (60, 6)) * rng.integers(1, 50, (60, 1))
    counts = counts[counts.sum(axis=1) > 0]
    place, group = np.nonzero(counts)
    price = lambda g, c: 1 + 10**9 * (c + 2) // (100 + g + 120)
    want = np.zeros((6, 6), dtype=np.int64)
    for row in counts:
        for i in range(6):
            for k in range(6):
                p, q = price(i, int(row[i])), price(k, int(row[k]))
                want[i, k] += (p - q) ** 2 // (p + q)
    for columns in (10, 1024):
        op13.COLUMNS, before = columns, op13.COLUMNS
        try:
            assert (op13.price_block(place, group, counts[place, group], price, 0, 6) == want).all()
            assert (op13.price_block(place, group, counts[place, group], price, 2, 6) == want[:2, 2:]).all()
        finally:
            op13.COLUMNS = before


def test_divergence_of_nothing(spark):
    assert op13.divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_source_divergence"])
def test_query_equals_sql(spark, name):
    import os

    from matchloom.llm import registry

    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    found = con.execute(registry.oracle_sql()[name])
    names = sorted(d[0] for d in found.description)
    rows = [dict(zip((d[0] for d in found.description), r)) for r in found.fetchall()]
    got = registry.queries()[name](spark, folder)
    assert sorted(got.columns) == names
    assert sorted(str([r[c] for c in names]) for r in got.collect()) == sorted(str([r[c] for c in names]) for r in rows)


def test_token_query(spark):
    """The query against the library over a whole table."""
    import os

    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    rows = sorted((r["doc_id"], r["text"]) for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist())
    want, start = [], 0
    for (doc, _), ids in zip(rows, library([t for _, t in rows])):
        want.append((doc, start, len(ids) + 1, zlib.crc32(np.array([*ids, 1], dtype="<u4").tobytes())))
        start += len(ids) + 1
    assert sorted(tuple(r) for r in op11.query(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
