"""Landed pages: the stop rule, the budget, offsets and a restart."""

import json

import pytest

from matchloom.sources.landing import LandedPages


def land(folder, request, number, n, first=0):
    (folder / request).mkdir(parents=True, exist_ok=True)
    (folder / request / f"page-{number}.json").write_text(json.dumps({"result": [{"sn": first + i, "이름": "가"} for i in range(n)]}), encoding="utf-8")


@pytest.fixture
def pages(tmp_path):
    folder = tmp_path / "in"
    for number, n in ((1, 10), (2, 10), (3, 4), (4, 10)):  # the third is short: the fourth isn't asked for
        land(folder, "a", number, n, 100 * number)
    for number in (1, 2, 4):  # the third is missing
        land(folder, "b", number, 10, 100 * number)
    land(folder, "c", 1, 0)
    land(folder, "d", 1, 10)
    (folder / "d" / "page-2.json").write_text("{broken")
    land(folder, "d", 3, 10)
    return folder


def counts(rows):
    out = {}
    for r in rows:
        out.setdefault(r.request, {}).setdefault(r.page, []).append((r.pos, json.loads(r.row)["sn"]))
    return {q: {p: len(v) for p, v in sorted(x.items())} for q, x in sorted(out.items())}


@pytest.mark.parametrize(
    ("options", "want"),
    [
        ({}, {"a": {1: 10, 2: 10, 3: 4}, "b": {1: 10, 2: 10}, "d": {1: 10}}),
        ({"count": 15}, {"a": {1: 10, 2: 5}, "b": {1: 10, 2: 5}, "d": {1: 10}}),
        ({"count": 10}, {"a": {1: 10}, "b": {1: 10}, "d": {1: 10}}),
        ({"budget": 1}, {"a": {1: 10}, "b": {1: 10}, "d": {1: 10}}),
        ({"count": 0}, {}),
    ],
)
def test_stop_rule(spark, pages, options, want):
    spark.dataSource.register(LandedPages)
    read = spark.read.format("landed_pages").option("path", str(pages)).option("page_size", 10)
    for name, value in options.items():
        read = read.option(name, value)
    rows = read.load().collect()
    assert counts(rows) == want
    assert all(json.loads(r.row) == {"sn": json.loads(r.row)["sn"], "이름": "가"} and (r.request == "c") is False for r in rows)


def test_no_folder(spark, tmp_path):
    spark.dataSource.register(LandedPages)
    assert spark.read.format("landed_pages").option("path", str(tmp_path / "none")).load().count() == 0


def test_stream_and_restart(spark, pages, tmp_path):
    """New pages are read once; a restart goes on from the checkpoint; a request at its end stays there."""
    spark.dataSource.register(LandedPages)
    out = str(tmp_path / "out")

    def run():
        stream = spark.readStream.format("landed_pages").option("path", str(pages)).option("page_size", 10).option("pages_per_trigger", 2).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return counts(spark.read.parquet(out).collect())

    first = {"a": {1: 10, 2: 10, 3: 4}, "b": {1: 10, 2: 10}, "d": {1: 10}}
    assert run() == first
    land(pages, "b", 3, 10, 300)  # now the fourth follows too
    land(pages, "a", 5, 10)  # behind the end
    land(pages, "e", 1, 3)
    assert run() == first | {"b": {1: 10, 2: 10, 3: 10, 4: 10}, "e": {1: 3}}
    assert run() == first | {"b": {1: 10, 2: 10, 3: 10, 4: 10}, "e": {1: 3}}
