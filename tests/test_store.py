"""Requests and the run store."""

import json
import os
from datetime import datetime, timedelta, timezone

import pytest

from linkloom.session import new_path
from linkloom.sources import runs as store
from linkloom.sources.requests import SCHEMA, accepted_requests, validate_requests

T0 = datetime(2031, 11, 3, 6, 7, 8, tzinfo=timezone.utc)
LONG = "https://lib.m.test/" + "w" * 300


def run(crawl_id, seed, hours=0, micros=0, status="success"):
    start = T0 + timedelta(hours=hours, microseconds=micros)
    page = {"url": seed, "depth": 0, "status_code": 200, "links_found": 2, "crawled_at": start, "error": None}
    return (crawl_id, seed, status, None, 1, 0, [seed, seed + "ü"], [], [tuple(page.values())], start, start + timedelta(seconds=1.5), 1.5)


def frame(spark, rows):
    return spark.createDataFrame(rows, store.RUN_SCHEMA)


def test_requests(spark):
    base = dict(max_depth=None, max_pages=None, concurrent_requests=None, politeness_delay=None, timeout=None, headers=None, proxy=None, respect_robots_txt=None)
    cases = [
        ({}, "https://h/a#b", None), ({}, "", "seed_url cannot be empty"), ({}, None, "seed_url cannot be empty"),
        ({}, "ftp://x", "seed_url must start with http:// or https://: ftp://x"),
        ({}, "HTTPS://x", "seed_url must start with http:// or https://: HTTPS://x"),
        ({"max_depth": -1, "max_pages": 0}, "http://h", "max_depth cannot be negative"),
        ({"max_pages": 0}, "http://h", "max_pages must be at least 1"),
        ({"concurrent_requests": 0}, "http://h", "concurrent_requests must be at least 1"),
        ({"politeness_delay": -1.0}, "http://h", "politeness_delay cannot be negative"),
        ({"timeout": 0}, "http://h", "timeout must be at least 1 second"), ({}, "http://h/x \n", None),
    ]
    rows = [(i, seed, *{**base, **change}.values()) for i, (change, seed, _) in enumerate(cases)]
    got = validate_requests(spark.createDataFrame(rows, SCHEMA)).orderBy("crawl_id").collect()
    assert [r.error for r in got] == [e for _, _, e in cases]
    assert got[0].seed_url == "https://h/a" and got[10].seed_url == "http://h/x"
    first = accepted_requests(spark.createDataFrame(rows, SCHEMA)).orderBy("crawl_id").first()
    assert (first.max_depth, first.max_pages, first.politeness_delay, first.timeout, first.respect_robots_txt) == (4, 1000, 1.0, 30, True)


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_store_life(spark, fmt):
    path = new_path(spark, "test-runs")
    near = ["https://h/3", "https://h/3/lib"]
    first = [run(1, near[0]), run(2, near[1], 5), run(3, "https://lib.m.test/v2/", 0, 7), run(9, near[0], status=None)]
    counts = store.save_many(frame(spark, first), path, fmt).first()
    assert (counts.saved, counts.failed, counts.total) == (3, 1, 4)
    store.save_runs(frame(spark, [run(4, near[0], 1)]), path, fmt)
    seeds = spark.createDataFrame([(near[0],), ("https://h/none",)], "seed_url string")

    latest = store.load_latest(spark, path, seeds, fmt).collect()
    assert [r.crawl_id for r in latest] == [4]
    want = run(4, near[0], 1)
    assert list(latest[0].urls_visited) == want[6] and latest[0].error is None and latest[0].duration_seconds == 1.5
    assert latest[0].started_at.replace(tzinfo=timezone.utc) == want[9]
    assert tuple(latest[0].pages[0])[:4] == (near[0], 0, 200, 2)
    assert {r.crawl_id for r in store.load_latest(spark, path, fmt=fmt).collect()} == {4, 2, 3}
    assert {r.seed_url: r.found for r in store.run_exists(spark, path, seeds, fmt).collect()} == {near[0]: True, "https://h/none": False}

    for expected, left in [(True, {1, 2, 3}), (True, {2, 3}), (False, {2, 3})]:
        answer = {r.seed_url: r.deleted for r in store.delete_latest(spark, path, seeds, fmt).collect()}
        assert answer == {near[0]: expected, "https://h/none": False}
        assert {r.crawl_id for r in store.read_runs(spark, path, fmt).collect()} == left
    store.save_runs(frame(spark, [run(4, near[0], 1)]), path, fmt)
    assert {r.crawl_id for r in store.read_runs(spark, path, fmt).collect()} == {2, 3, 4}

    listed = [(r.filename, r.started_at, r.total_pages) for r in store.list_crawls(spark, path, fmt).collect()]
    assert listed == [
        ("h_3_20311103_070708.json", "2031-11-03T07:07:08+00:00", 1),
        ("h_3_lib_20311103_110708.json", "2031-11-03T11:07:08+00:00", 1),
        ("lib.m.test_v2__20311103_060708.json", "2031-11-03T06:07:08.000007+00:00", 1),
    ]


def test_json_documents_keep_nulls_and_text(spark):
    path = new_path(spark, "test-json")
    store.save_runs(frame(spark, [run(1, "https://h/é")]), path, "json")
    files = [os.path.join(d, f) for d, _, fs in os.walk(path + "/runs") for f in fs if f.endswith(".json")]
    line = open(files[0], encoding="utf-8").read().strip()
    assert "https://h/éü" in line
    doc = json.loads(line)
    assert doc["error"] is None and doc["pages"][0]["error"] is None
    assert doc["started_at"] == "2031-11-03T06:07:08+00:00" and doc["duration_seconds"] == 1.5
    with open(files[0], "a", encoding="utf-8") as f:
        f.write("{broken\n")
    os.remove(os.path.join(os.path.dirname(files[0]), "." + os.path.basename(files[0]) + ".crc"))
    assert store.list_crawls(spark, path, "json").count() == 1


def test_long_names_are_cut(spark):
    df = frame(spark, [run(1, LONG)])
    name = df.select(store.run_filename(df.seed_url, df.started_at).alias("n")).first().n
    assert name == ("lib.m.test_" + "w" * 300)[:180] + "_20311103_060708.json"


def test_runs_without_crawl_id(spark):
    path = new_path(spark, "test-null-ids")
    rows = [run(None, f"https://m.test/{i}") for i in range(5)]
    counts = store.save_runs(frame(spark, rows), path).first()
    assert (counts.saved, counts.failed) == (5, 0)
    seeds = spark.createDataFrame([(r[1],) for r in rows], "seed_url string")
    assert store.load_latest(spark, path, seeds).count() == 5
    assert store.delete_latest(spark, path, seeds).filter("deleted").count() == 5
    assert store.read_runs(spark, path).isEmpty()


def test_crawl_is_saved_whole(spark):
    from linkloom.plans.crawl import crawl
    from linkloom.sources import crawl_store
    from linkloom.sources.snapshot import page_snapshot

    pages = spark.createDataFrame(
        [(1, "http://m.test/", "<a href=p><a href=q><a href=r>", 200), (2, "http://m.test/p", "leaf", 200),
         (3, "http://m.test/q", "not here", 404), (4, "http://m.test/r", "oops", 500)],
        "page_id long, url string, html string, status int",
    )
    requests = spark.createDataFrame([(None, "http://n.test/"), (7, "http://m.test/")], "crawl_id long, seed_url string")
    with pytest.raises(ValueError):
        crawl(requests, page_snapshot(pages))
    done = crawl(requests.filter("crawl_id = 7"), page_snapshot(pages), None, T0)
    path = new_path(spark, "test-crawl")
    assert crawl_store.save_crawl(done, path).first().saved == 1
    assert store.list_crawls(spark, path).first().total_pages == 2
    assert {r.url for r in crawl_store.latest_pages(spark, path).collect()} == {"http://m.test/", "http://m.test/p"}
    assert {r.url for r in crawl_store.latest_failed(spark, path).collect()} == {"http://m.test/q", "http://m.test/r"}
    out = new_path(spark, "documents")
    crawl_store.write_documents(done, out)
    lines = crawl_store.read_documents(spark, out).orderBy("line_no").collect()
    text = "\n".join(r.line for r in lines)
    found = json.loads(text)
    assert found["max_depth_reached"] == 1 and found["error"] is None and len(found["urls_failed"]) == 2
    assert text == json.dumps(found, indent=2, ensure_ascii=False)
    assert [r.line_no for r in lines] == list(range(1, len(lines) + 1)) and lines[0].filename.endswith(".json")
    seeds = requests.select("seed_url")
    store.delete_latest(spark, path, seeds)
    assert store.list_crawls(spark, path).isEmpty() and crawl_store.latest_pages(spark, path).isEmpty()


def test_a_store_that_nobody_has_written_to(spark):
    from linkloom.sources import crawl_store

    seeds = spark.createDataFrame([("http://m.test/",), ("http://n.test/",)], "seed_url string")
    for fmt in ("parquet", "json"):
        path = new_path(spark, "never")
        assert store.load_latest(spark, path, fmt=fmt).isEmpty() and store.load_latest(spark, path, seeds, fmt).isEmpty()
        assert store.read_runs(spark, path, fmt).isEmpty() and store.list_crawls(spark, path, fmt).isEmpty()
        assert {r.found for r in store.run_exists(spark, path, seeds, fmt).collect()} == {False}
        assert {r.deleted for r in store.delete_latest(spark, path, seeds, fmt).collect()} == {False}
        assert store.list_crawls(spark, path, fmt).columns == ["seed_url", "status", "total_pages", "started_at", "filename"]
    assert crawl_store.latest_pages(spark, path).isEmpty() and crawl_store.latest_failed(spark, path).isEmpty()


def test_documents_over_several_files(spark, monkeypatch):
    """A run that spans partitions is several files, in order one document."""
    from linkloom.plans.crawl import crawl
    from linkloom.sources import crawl_store
    from linkloom.sources.snapshot import page_snapshot

    urls = ["http://m.test/"] + [f"http://m.test/{k}\u00fc" for k in range(300)]
    body = "".join(f'<a href="{u}">' for u in urls)
    pages = spark.createDataFrame([(k, u, body if not k else "x") for k, u in enumerate(urls)], "page_id long, url string, html string")
    requests = spark.createDataFrame([(1, urls[0], 9), (2, urls[1], 0), (3, "http://none/", 1)], "crawl_id long, seed_url string, max_depth int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        run = crawl(requests, page_snapshot(pages), None, T0)
        out = new_path(spark, "documents")
        crawl_store.write_documents(run, out)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.text(out).inputFiles()
    assert len([f for f in files if "crawl_id=1" in f]) > 1
    rows = crawl_store.read_documents(spark, out).orderBy("crawl_id", "line_no").collect()
    texts = {k: "\n".join(r.line for r in rows if r.crawl_id == k) for k in (1, 2, 3)}
    docs = {k: json.loads(t) for k, t in texts.items()}
    assert all(t == json.dumps(docs[k], indent=2, ensure_ascii=False) for k, t in texts.items())
    assert docs[1]["urls_visited"] == sorted(docs[1]["urls_visited"]) and len(docs[1]["pages"]) == 301
    assert docs[3]["pages"] == [] and docs[3]["urls_failed"] == ["http://none/"] and docs[3]["status"] == "success"
