"""Operators, sources and streams that have no SQL, on small tables with stated results."""

import io
import os
import struct
import zipfile
import zlib
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions import text as X
from matchloom.operators import assist, parsing, persona, vectors
from matchloom.sources import files
from matchloom.streaming import snapshots


def hwp_record(tag, payload):
    size = len(payload)
    return struct.pack("<I", tag | (min(size, 0xFFF) << 20)) + (struct.pack("<I", size) if size >= 0xFFF else b"") + payload


def test_hwp_text():
    first = "가나 😀 b\r".encode("utf-16-le") + struct.pack("<8H", 2, 0, 0, 0, 0, 0, 0, 2) + "끝".encode("utf-16-le") + b"\x3d\xd8"
    stream = hwp_record(66, b"xx") + hwp_record(67, first) + hwp_record(67, ("긴" * 3000).encode("utf-16-le")) + b"\1"
    got = files.hwp_text(stream)
    assert got == "가나 😀 b\n끝\ufffd\n" + "긴" * 3000
    got.encode("utf-8")


def test_attachments(spark, tmp_path):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("Contents/section0.xml", "<hs:sec><hp:p><hp:run><hp:t>데이</hp:t></hp:run><hp:run><hp:t>터 &amp; 분석</hp:t></hp:run></hp:p><hp:p><hp:t>둘</hp:t></hp:p></hs:sec>" + "<hp:p><hp:t>" + "x" * 300 + "</hp:t></hp:p>")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a.hwpx", box.getvalue())
    press = zlib.compressobj(wbits=-15)
    section = press.compress(hwp_record(67, "문단".encode("utf-16-le"))) + press.flush()
    for name, data in (("직무 설명.hwpx", box.getvalue()), ("other.zip", outer.getvalue()), ("one.section", section), ("bad.zip", b"PK nonsense")):
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r.path): r for r in files.attachments(spark, str(tmp_path)).collect()}
    assert got["직무 설명.hwpx"].text == "데이터 & 분석\n둘\n" + "x" * 300 and got["직무 설명.hwpx"].usable
    assert got["other.zip"].text == "[a.hwpx]\n" + got["직무 설명.hwpx"].text and not got["other.zip"].usable
    assert got["one.section"].text == "문단" and got["bad.zip"].text == ""


def test_json_folder_and_keys(spark, tmp_path):
    for name, text in (("a.json", '{"seq": 1, "text": "old"}'), ("b.json", '{"seq": 1, "text": "new"}'), ("c.json", "{broken"), ("d.json", '{"seq": 2}')):
        (tmp_path / name).write_text(text)
    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("text", T.StringType())])
    got = files.json_folder(spark, str(tmp_path / "*.json"), schema, "web")
    assert sorted((r.seq, r.text, r.src) for r in got.collect()) == [(1, "new", "web"), (2, None, "web")]
    assert (tmp_path / "c.json").exists()
    wanted = spark.createDataFrame([(1,), (3,)], "seq long")
    assert [r.seq for r in files.missing_keys(wanted, got, ["seq"]).collect()] == [3]


def test_xml_list(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><total>2</total><job><seq>1</seq><name>x</name></job><job><seq>2</seq></job></r>")
    got = files.xml_list(spark, str(tmp_path / "a.xml"), "job", T.StructType([T.StructField("seq", T.LongType()), T.StructField("name", T.StringType())]))
    assert sorted((r.seq, r.name) for r in got.collect()) == [(1, "x"), (2, None)]


def test_publish(spark, tmp_path):
    target = str(tmp_path / "t")
    assert not files.publish(spark.range(0), target) and files.publish(spark.range(10), target)
    assert not files.publish(spark.range(7), target) and spark.read.parquet(target).count() == 10
    old = spark.read.parquet(target)
    assert files.publish(old.unionByName(spark.range(10, 15)), target)  # computed from the table that it replaces
    assert spark.read.parquet(target).count() == 15 and os.listdir(tmp_path) == ["t"]


def test_stores(spark, tmp_path):
    units, quals = spark.createDataFrame([("f", 1, ["a", "b"])], "fileNo string, unit int, items array<string>"), spark.range(3)
    files.save_store({"units": units, "quals": quals}, str(tmp_path / "s"))
    back = files.load_store(spark, str(tmp_path / "s"), "units", "quals", "none")
    assert set(back) == {"units", "quals"} and back["units"].collect() == units.collect()
    files.export_json(quals, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    store = names.withColumn("embedding", F.array(F.lit(1.0)))
    assert files.valid_vectors(names, store) is not None and files.valid_vectors(names, None) is None
    assert files.valid_vectors(names, store.limit(1)) is None and files.valid_vectors(names.limit(1), store) is None


@pytest.mark.parametrize("term,noise", [("데이터분석", False), ("a", True), ("x" * 31, True), ("☆별", True), ("\u2562표", True), ("\uf0a7점", True), ("\ue001가나", False), ("o업무", True), ("분석하는", True), ("분석하", True), ("부하", False), ("12", True), ("", True), (None, True)])
def test_is_noise(spark, term, noise):
    assert spark.createDataFrame([(term,)], "t string").select(X.is_noise(F.col("t")).alias("n")).head().n is noise


def test_parsers_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "t"), (3, "담당업무", "제목")], "doc long, text string, title string")
    assert sorted((r.doc, r.role, r.text) for r in parsing.roles(docs).collect()) == [(1, "", ""), (2, "t", ""), (3, "제목", "담당업무")]
    assert sorted((r.doc, r.unit, r.title, r.text) for r in parsing.units(docs).collect()) == [(1, 0, "", ""), (2, 0, "", ""), (3, 0, "", "담당업무")]
    assert parsing.sections(docs).count() == 0
    one = lambda c: spark.range(1).select(c.alias("x")).head().x
    assert one(parsing.join_wrapped(F.lit("정보에\n\n대한 지식\n· 둘\n셋"))) == "정보에 대한 지식\n· 둘\n셋"
    assert one(parsing.items(F.lit("· 직무윤리\n· 의사소통능력\n· 01. 코드 값\n· 재무\n· 서버 구축 기술, 보안 점검\n,,"))) == ["서버 구축 기술", "보안 점검"]
    assert one(parsing.deadline(F.lit("접수 2024년 3월 1일부터 2024년 3월 9일까지"))) == "2024-03-09"
    assert one(parsing.deadline(F.lit("입사 2024년 3월 1일"))) is None and one(parsing.deadline(F.lit(None).cast("string"))) is None
    assert one(parsing.split_outside(F.lit("C/C++ (C, C++), a / b，c"))) == ["C/C++ (C, C++)", "a", "b", "c"]
    assert one(parsing.list_literal(F.lit("no list"))) == [] and one(parsing.json_object(F.lit("none"))) is None


def greedy_linkage(rows, limit):
    """Merge the nearest pair of clusters, one at a time."""
    groups = [[i] for i in range(len(rows))]
    while len(groups) > 1:
        least, at = np.inf, None
        sums = np.stack([rows[g].sum(axis=0) / len(g) for g in groups])
        distance = 1 - sums @ sums.T
        np.fill_diagonal(distance, np.inf)
        i, j = divmod(int(np.argmin(distance)), len(groups))
        if distance[i, j] >= limit:
            break
        groups[min(i, j)] += groups[max(i, j)]
        del groups[max(i, j)]
    return {i: min(g) for g in groups for i in g}


@pytest.mark.parametrize("block", [4096, 40])
def test_clusters(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 8))
    rows = np.stack([centres[i % 9] + 0.5 * rng.normal(size=8) for i in range(110)])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.cluster for r in vectors.clusters(df, 0.4, block).collect()}
    assert got == greedy_linkage(rows, 0.4)


def test_clusters_equal_greedy_merging(spark):
    """500 vectors with tight and loose groups, in blocks of 60."""
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(40, 6))[rng.integers(0, 40, 500)] + rng.choice((0.1, 0.6), (500, 1)) * rng.normal(size=(500, 6))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.cluster for r in vectors.clusters(df, 0.35, 60).collect()}
    assert got == greedy_linkage(rows, 0.35)


def test_clusters_compare_what_merges_touch(spark):
    """Of 20,000 vectors the first round compares 4.0e8 pairs, the next three 1.6e8, 0.6e8 and 0.2e8; then one task ends it."""
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(6000, 12))[rng.integers(0, 6000, 20_000)] + 0.15 * rng.normal(size=(20_000, 12))
    rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float64)
    df = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<double>")
    compared = []
    got = vectors.clusters(df, 0.08, 2048, compared).toPandas()
    assert compared[0] == 20_000**2 and len(compared) > 2 and all(b < 0.5 * a for a, b in zip(compared, compared[1:]))
    # No two clusters are left within the limit, and each is as its members' mean says.
    label = got.sort_values("vec_id").cluster.to_numpy()
    ids, at, n = np.unique(label, return_inverse=True, return_counts=True)
    sums = np.zeros((len(ids), 12))
    np.add.at(sums, at, rows)
    sim = (sums / n[:, None]) @ (sums / n[:, None]).T
    np.fill_diagonal(sim, -1)
    assert (1 - sim >= 0.08 - 1e-9).all() and (ids[at] <= np.arange(20_000)).all() and n.max() > 5


def test_equal_vectors_are_one_cluster_from_the_start(spark):
    """64 vectors eight times each: 64 clusters are compared, not 512."""
    rng = np.random.default_rng(10)
    rows = np.tile(rng.normal(size=(64, 6)), (8, 1))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    compared = []
    got = {r.vec_id: r.cluster for r in vectors.clusters(df, 0.35, 40, compared).collect()}
    assert compared[0] == 64**2 and got == greedy_linkage(rows, 0.35)


def test_clusters_of_one_task_are_bounded():
    """3,000 clusters of one task take no table of all pairs (72 MB), and merge as greedily."""
    import tracemalloc

    rng = np.random.default_rng(11)
    rows = rng.normal(size=(300, 8))[rng.integers(0, 300, 3000)] + 0.2 * rng.normal(size=(3000, 8))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    tracemalloc.start()
    merges = vectors.merged_here(np.arange(3000), np.ones(3000), rows.copy(), 0.05)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    few = rows[:400]
    head = list(range(400))
    for gone, kept in reversed(vectors.merged_here(np.arange(400), np.ones(400), few.copy(), 0.05)):
        head[gone] = head[kept]
    assert merges and dict(enumerate(head)) == greedy_linkage(few, 0.05)


def test_nearest_tells_apart_what_single_precision_does_not():
    """Partners whose similarities differ by 1e-9, equal ones (the first), and nothing beyond the limit; both sides of one product."""
    rng = np.random.default_rng(12)
    rows = rng.normal(size=(1500, 16))
    rows[700:1400] = rows[:700] + 1e-9 * rng.normal(size=(700, 16))
    rows[1400:] = rows[:100]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    ids = rng.permutation(10_000)[:1500]
    whole = vectors.Means(ids, rows)
    sim = np.array([(whole.means * r).sum(axis=1) for r in whole.means])
    np.fill_diagonal(sim, -np.inf)
    want = {whole.ids[i]: whole.ids[j] for i, j in enumerate(sim.argmax(axis=1)) if 1 - sim[i, j] < 0.5}
    for mine, theirs, _ in vectors.nearest(whole, whole, 0.5, True):
        assert dict(zip(mine, theirs)) == want
    parts = [vectors.Means(ids[k], rows[k]) for k in (slice(0, 600), slice(600, 1500))]
    for (mine, theirs, _), a, b in zip(vectors.nearest(*parts, 0.5, True), parts, parts[::-1]):
        at, of = np.searchsorted(whole.ids, a.ids), np.searchsorted(whole.ids, b.ids)
        best = sim[np.ix_(at, of)]
        assert dict(zip(mine, theirs)) == {i: b.ids[j] for i, j, s in zip(a.ids, best.argmax(axis=1), best.max(axis=1)) if 1 - s < 0.5}


def test_fit_vocabulary(spark):
    """Core and tail, names that aren't noise, and a map that fold takes."""
    from matchloom.operators import profile

    unit = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    rows = [
        ("데이터분석능력을활용하는", 50, unit(0)), ("데이터분석", 9, unit(4)), ("데이터 분석", 9, unit(6)), ("자료분석", 3, unit(8)),  # the first is noise by its ending
        ("서버운영", 4, unit(80)), ("서버관리", 4, unit(84)), ("가" * 41, 99, unit(82)), ("서버", 1, unit(78)), ("먼것", 2, unit(200)), ("가나", 3, unit(150)),
    ]
    terms = spark.createDataFrame(rows, "term string, df long, embedding array<double>")
    mapping = vectors.fit_vocabulary(terms, limit=0.05, tail_limit=0.02)
    got = {r["item"]: r["node"] for r in mapping.collect()}
    assert got == {"데이터분석능력을활용하는": "데이터분석", "데이터분석": "데이터분석", "데이터 분석": "데이터분석", "자료분석": "데이터분석", "서버운영": "서버관리", "서버관리": "서버관리", "서버": "서버관리", "가나": "가나"}
    items = spark.createDataFrame([("0101", 1, 1, "서버"), ("0101", 1, 1, "먼것")], "code string, unit long, inst long, item string")
    assert {r.node for r in profile.fold(items.withColumn("node", F.lit("")), mapping).collect()} == {"서버관리", "먼것"}


def stream(spark, rows, schema, tmp_path, batches):
    """A file stream that gives `batches` (lists of rows), one after the other."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / f"p{i}"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(len(batches)):
        source = next(p for p in (folder / f"p{i}").iterdir() if p.suffix == ".parquet")
        target = flat / f"{i}.parquet"
        target.write_bytes(source.read_bytes())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(flat))


def run(df, write, tmp_path, mode="append"):
    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()


def test_stream_accumulate(spark, tmp_path):
    source = stream(spark, None, "key long, note string", tmp_path, [[(1, "b"), (1, "a"), (2, "x")], [(1, "0"), (3, "y")]])
    target = str(tmp_path / "seen")
    write = snapshots.accumulate(target, ["key"], ["note"])
    run(source, write, tmp_path)
    assert sorted((r.key, r.note, r.first_seen) for r in spark.read.parquet(target).collect()) == [(1, "a", 0), (2, "x", 0), (3, "y", 1)]
    write(spark.createDataFrame([(1, "0"), (3, "y")], "key long, note string"), 1)  # the same batch again
    assert spark.read.parquet(target).count() == 3


def test_stream_latest_per_day(spark, tmp_path):
    """The last point of each day and key; a batch touches its own days' files only, and may come again."""
    first, second, at = date(2024, 1, 1), date(2024, 1, 2), lambda d, h: datetime(2024, 1, d, h)
    schema, target = "as_of date, key long, rate double, ts timestamp, id long", str(tmp_path / "days")
    batches = [[(first, 1, 0.1, at(1, 1), 1), (first, 2, 0.5, at(1, 1), 2)], [(second, 1, 0.3, at(2, 5), 3), (second, 1, 0.2, at(2, 4), 4)], [(first, 1, 0.9, at(1, 9), 5), (first, 2, 0.4, at(1, 0), 6)]]
    source = stream(spark, None, schema, tmp_path, batches)
    run(source, snapshots.latest_per_day(target), tmp_path)
    rows = lambda: sorted((r.as_of.day, r.key, r.rate) for r in spark.read.parquet(target).collect())
    assert rows() == [(1, 1, 0.9), (1, 2, 0.5), (2, 1, 0.3)]
    files_of = lambda day: {(f.name, f.stat().st_mtime_ns) for f in (tmp_path / f"days/as_of=2024-01-0{day}").iterdir()}
    untouched = files_of(2)
    write = snapshots.latest_per_day(target)
    for _ in range(2):
        write(spark.createDataFrame(batches[2], schema), 2)
    assert files_of(2) == untouched and rows() == [(1, 1, 0.9), (1, 2, 0.5), (2, 1, 0.3)]
    write(spark.createDataFrame([(second, 7, 0.7, at(2, 6), 8)], schema), 3)
    assert rows() == [(1, 1, 0.9), (1, 2, 0.5), (2, 1, 0.3), (2, 7, 0.7)]


def test_stream_drift_history(spark, tmp_path):
    source = stream(spark, None, "term string", tmp_path, [[("a",), ("b",)], [("b",), ("c",)]])
    run(source, snapshots.drift_history(str(tmp_path / "d"), "term"), tmp_path)
    got = spark.read.parquet(str(tmp_path / "d/history"))
    assert sorted((r.batch, r.term, r.change) for r in got.collect()) == [(0, "a", "new"), (0, "b", "new"), (1, "a", "gone"), (1, "c", "new")]


def test_stream_interviews(spark, tmp_path):
    items = [("sql", ["SQL"]), ("team", ["팀"])]
    source = stream(spark, None, "session long, seq long, answer string", tmp_path, [[(1, 1, "SQL"), (2, 1, "제가 SQL 로 개선")], [(1, 2, "제가 했고 결과가 좋음"), (1, 3, "팀"), (2, 2, None)], [(1, 4, "아니요"), (1, 5, "더")]])
    rows = []
    run(snapshots.interviews(source, items), lambda batch, _: rows.extend(tuple(r) for r in batch.collect()), tmp_path)
    want = [(1, 1, "sql", 0, "followup"), (1, 2, "sql", 2, "main"), (1, 3, "team", 0, "followup"), (1, 4, "team", 0, "done"), (2, 1, "sql", 3, "main"), (2, 2, "team", 0, "followup")]
    assert sorted(rows) == want
    table = spark.createDataFrame([(1, 1, "SQL"), (2, 1, "제가 SQL 로 개선"), (1, 5, "더"), (1, 2, "제가 했고 결과가 좋음"), (1, 3, "팀"), (2, 2, None), (1, 4, "아니요")], "session long, seq long, answer string")
    assert sorted(tuple(r) for r in snapshots.interviews(table, items).collect()) == want


@pytest.mark.parametrize(("answer", "score"), [("SQL", 0), ("SQL 씀", 1), ("긴 문장입니다. SQL", 0), ("제가 SQL 을 3번 썼습니다.", 3), ("", 0)])
def test_interview_rule_is_one(spark, answer, score):
    """The walk and the fold score alike: a sentence of five characters or more has to hold the keyword."""
    walked = snapshots.interviews(spark.createDataFrame([(1, 1, answer)], "session long, seq long, answer string"), [("sql", ["SQL"])]).head().score
    told = persona.interview_scores(spark.createDataFrame([(1, "sql", 1, answer, ["SQL"])], "session long, item string, seq long, answer string, words array<string>")).head().score
    assert walked == told == score


@pytest.mark.parametrize(("quote", "good"), [("“led the data team”", True), ("'led  the data'", True), ("‘led’", False), ('"led the Data"', False), (None, False), ("the \u200bdata", True)])
def test_quote_marks(spark, quote, good):
    df = spark.createDataFrame([(quote, "She led the\ndata team.")], "q string, s string")
    assert bool(df.select(X.quote_verified(F.col("q"), F.col("s")).alias("v")).head().v) is good


def test_rubric_fallback_leaves_out_names(spark):
    docs = spark.createDataFrame([(1, "한빛회사\n데이터 분석가\n여러 문장을 씁니다. 한빛회사", ["Python"], "한빛회사", "데이터 분석가", None)], "doc long, text string, techs array<string>, corp string, role string, title string")
    assert [r.jd_quote for r in persona.rubric_items(docs).orderBy("place").collect()] == ["Python", "여러 문장을 씁니다"]


def test_late_once(spark, tmp_path):
    source = stream(spark, None, "ts timestamp, key long", tmp_path, [[(datetime(2024, 1, 1), 1), (datetime(2024, 1, 1), 1)], [(datetime(2024, 1, 1, 5), 1), (datetime(2024, 1, 1), 2)]])
    rows = []
    run(snapshots.late_once(source, ["key"]), lambda batch, _: rows.extend(r.key for r in batch.collect()), tmp_path)
    assert sorted(rows) == [1, 2]


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted((r.k, r.v) for r in assist.upserted(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_rubric_weights_are_shares(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, 0.5), (1, 2, 0.6, None)], "rubric long, item long, kind_weight double, share double")
    assert {r.item: r.weight for r in persona.weights(rows).collect()} == {1: 0.714, 2: 0.286}


def test_frame_metrics_by_hand(spark):
    """States stand still on frames without a face or a pose; moves are Euclidean and against the last pose."""
    from matchloom.operators import serving

    p = lambda x, y: (x, y)
    rows = [
        # session, ms, face, hands, blink, frown, left, right, wrists, gesture
        (1, 0, True, True, 0.9, 0.1, p(0.4, 0.5), p(0.6, 0.5), p(0.5, 0.9), "wave"),  # the first face is closed: a blink
        (1, 100, False, False, None, None, None, None, None, None),
        (1, 200, True, False, 0.8, 0.5, None, None, None, None),  # still closed over the gap
        (1, 300, True, False, 0.45, 0.46, p(0.42, 0.52), p(0.62, 0.52), p(0.53, 0.93), None),  # open at the limit; sqrt(0.02^2 + 0.02^2) < 0.035, and 0.042 < 0.05
        (1, 400, False, True, 0.9, 0.9, None, None, None, "stop"),  # no face: neither blink nor frown
        (1, 500, True, False, 0.46, None, p(0.45, 0.6), p(0.65, 0.54), p(0.56, 0.98), None),  # a blink; moved, tilted; sqrt(0.03^2 + 0.05^2) > 0.05
        (1, 600, True, None, None, None, p(0.7, 0.5), p(0.8, 0.5), p(0.56, 0.98), None),  # off the centre, moved
        (2, 50, False, False, None, None, None, None, None, None),
    ]
    point = "struct<x:double,y:double>"
    frames = spark.createDataFrame(rows, f"session long, ms long, face boolean, hands boolean, blink double, frown double, left {point}, right {point}, wrists {point}, gesture string")
    got = {r.session: r for r in serving.frame_metrics(frames).collect()}
    one = got[1]
    assert (one.frames, one.seconds, one.fps, one.face_rate, one.hand_rate, one.pose_rate) == (7, 0.6, 11.67, 0.714, 0.286, 0.571)
    assert (one.blinks, one.frown_rate, one.body_moves, one.arm_moves, one.tilt_rate, one.off_centre_rate, one.gestures) == (2, 0.4, 2, 1, 0.25, 0.25, 2)
    assert (got[2].frames, got[2].fps, got[2].face_rate, got[2].blinks, got[2].tilt_rate) == (1, 0.0, 0.0, 0, 0.0)


def test_best_context_equals_pairs(spark):
    """Against every pair of a posting and a context of its address; short, blank and missing roles and titles too."""
    import random

    from matchloom.operators import corpus

    rng = random.Random(3)
    roles = ["", "a", "SQL", "sql개발", "Data", "data engineer", "분석", None, "zz", "세 글"]
    titles = [None, "", "a", "SQL개발자 (Data)", "Senior DATA Engineer", "분석", "x분석가 세 글자", "no"]
    live = [(i, rng.choice(titles), rng.choice("uvw")) for i in range(80)]
    ctxs = [(1000 + i, rng.choice(roles), rng.choice((0, 0, 2, None)), rng.choice("uvx")) for i in range(60)]
    got = {r.posting: (r.rule, r.ctx) for r in corpus.best_context(spark.createDataFrame(live, "posting long, title string, url string"), spark.createDataFrame(ctxs, "ctx long, role string, skills long, url string")).collect()}
    want = {}
    for p, title, url in live:
        ranks = []
        for c, role, skills, other in ctxs:
            if other == url:
                inside, skilled = role is not None and title is not None and role.lower() in title.lower(), (skills or 0) > 0
                ranks.append((0 if inside and skilled else 1 if skilled else 2 if inside else 3, c))
        if ranks:
            want[p] = min(ranks)
    assert got == want
