"""Rows chosen by where they are stored, and what is built on it: snapshots and fetch outcomes."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.functions import urls as U
from linkloom.operators import fetchlog, links
from linkloom.session import new_path, written
from linkloom.sources.rows import ROW, drop_rows, identified, keep_rows, row_marks
from linkloom.sources.snapshot import page_snapshot, snapshot_from_outcomes


def nodes(plan, ran=False):
    """Every node of a physical plan, as planned first or as it ``ran``."""
    while (name := plan.nodeName()) == "AdaptiveSparkPlan" or name.endswith("QueryStage"):
        plan = plan.plan() if name != "AdaptiveSparkPlan" else plan.executedPlan() if ran else plan.initialPlan()
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i), ran)


def moved(df):
    """The columns that are exchanged or sorted, but for broadcasts."""
    found = [n for n in nodes(df._jdf.queryExecution().executedPlan()) if n.nodeName().startswith(("Exchange", "Sort"))]
    return {n.output().apply(i).name() for n in found for i in range(n.output().size())}


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("mark_bytes", [None, 700])
def test_rows_are_chosen_in_place(spark, mark_bytes):
    table = written(spark.range(6_000).repartition(3).withColumn("body", F.lit("x")), "stored")
    rows = identified(table)
    some = rows.filter("id % 7 = 3 OR id > 5500")
    want = {i for i in range(6_000) if i % 7 == 3 or i > 5_500}
    ids = some.select(ROW).union(some.select(ROW))
    kept = keep_rows(rows, ids, mark_bytes)
    assert {r.id for r in kept.collect()} == want and moved(kept) == set()
    dropped = drop_rows(rows.withColumn("body", F.upper("body")), ids, mark_bytes).collect()
    assert {r.id for r in dropped} == set(range(6_000)) - want and dropped[0].body == "X"
    if mark_bytes:
        # Files are dealt into groups, each read by itself.
        ran = nodes(kept._jdf.queryExecution().executedPlan(), ran=True)
        scans = [n for n in ran if n.nodeName().startswith("Scan") and "stored-" in n.relation().location().rootPaths().toString()]
        read = [n.metrics().apply("numFiles").value() for n in scans]
        assert len(read) > 1 and sum(read) == 3


def test_no_ids_and_repeated_ids(spark):
    rows = identified(written(spark.range(50), "stored"))
    nothing = rows.select(ROW).limit(0)
    assert keep_rows(rows, nothing).count() == 0 and drop_rows(rows, nothing).count() == 50
    marks = row_marks(rows.select(ROW).union(rows.select(ROW)))
    bits = marks.select(F.aggregate("words", F.lit(0), lambda n, w: n + F.bit_count(w)).alias("n"))
    assert bits.agg(F.sum("n")).first()[0] == 50


def test_a_frame_without_files_is_written(spark):
    rows = identified(spark.createDataFrame([(1, "a"), (2, "b")], "id int, body string"))
    assert {r.id for r in keep_rows(rows, rows.filter("id = 2").select(ROW)).collect()} == {2}


def stored_pages(spark, rows, n_files=3):
    path = new_path(spark, "pages")
    spark.createDataFrame(rows, "page_id long, url string, html string, status int").repartition(n_files).write.parquet(path)
    return spark.read.parquet(path)


def test_snapshot_has_one_row_per_url(spark):
    rng = random.Random(4)
    rows = [(5, "http://a/y/p#1", "five y", 200), (6, "http://a/y/p", "six y", 200), (6, "http://b/z/", "six z", 200)]
    rows += [(7, "http://twice/x/", "same", 200)] * 3 + [(None, "http://n/x/", "nameless", 200)] * 2
    rows += [(None, "http://m/x/", "nameless", 200), (3, "http://m/x/", "three", 200), (9, "http://e/x/", "gone", 404)]
    rows += [(None, None, "no url", 200), (1, "mailto:x", "no page", 200), (2, None, "no url", 200)]
    for k in range(300):
        rows.append((rng.randrange(40), f"http://r/x/{rng.randrange(60)}?b=2&a=1#f{k}", f"body {k}", 200))
    got = page_snapshot(stored_pages(spark, rows)).collect()
    canon = spark.createDataFrame(rows, "page_id long, url string, html string, status int").withColumn("c", U.canonical_url(F.col("url")))
    best = {}
    for r in canon.filter("c IS NOT NULL").collect():
        rank = (r.page_id is None, r.page_id or 0)
        if r.c not in best or rank < best[r.c][0]:
            best[r.c] = (rank, set())
        if rank == best[r.c][0]:
            best[r.c][1].add("" if r.status >= 400 else r.html)
    assert sorted(r.url for r in got) == sorted(best)
    assert all(r.html in best[r.url][1] for r in got)
    assert {r.url: r.html for r in got}["http://b/z/"] == "six z"
    # Of equal ids the first one stored counts, in every run.
    again = page_snapshot(stored_pages(spark, rows, 1)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, page_snapshot(stored_pages(spark, rows, 1)).collect()))


@pytest.mark.parametrize("repeats", [False, True])
def test_no_body_is_moved(spark, no_broadcast, repeats):
    rows = [(k, f"http://h/s/{k}", f"<a href='/s/{k + 1}'>", 200) for k in range(40)]
    pages = stored_pages(spark, rows + rows[:5] * repeats)
    snapshot = page_snapshot(pages)
    requests = spark.createDataFrame([(1, "http://h/s/")], "crawl_id long, seed_url string")
    assert "html" not in moved(snapshot)
    assert "html" not in moved(links.link_graph(snapshot, requests))
    assert "html" not in moved(links.classify_links(snapshot, requests))
    assert "html" not in moved(links.adjacency(snapshot, requests, 4))
    assert links.link_graph(snapshot, requests).count() == 40


def test_repeats_are_marked_without_a_window(spark):
    pages = stored_pages(spark, [(1, "http://h/s/", "<a href=b><a href=a><a href=b#x><a href='#f'><a href='#f'><a href=b>", 200)])
    requests = spark.createDataFrame([(1, "http://h/s/")], "crawl_id long, seed_url string")
    found = links.classify_links(page_snapshot(pages), requests)
    names = [n.nodeName() for n in nodes(found._jdf.queryExecution().executedPlan())]
    assert "Window" not in names
    reasons = [r.reason for r in found.orderBy("pos").collect()]
    assert reasons == ["accepted", "accepted", "duplicate", "fragment", "fragment", "duplicate"]


def test_outcomes_read_bodies_in_place(spark, no_broadcast):
    rows = [(f"http://h/{k}", a, "response", 200 if a == 2 else 500, f"body {k} {a}") for k in range(50) for a in (1, 2, 3)]
    rows += [("http://h/0", 2, "response", 200, "stored twice"), ("not a url", 1, "response", 200, "x"), ("http://h/none", 1, "timeout", None, None)]
    rows += [("http://h/gone", 1, "response", 404, "blank it"), ("http://h/null", 1, "response", 200, None)]
    path = new_path(spark, "attempts")
    spark.createDataFrame(rows, fetchlog.SCHEMA).repartition(4).write.parquet(path)
    attempts = spark.read.parquet(path)
    won = fetchlog.winning_attempts(attempts)
    assert "html" not in moved(won)
    out = fetchlog.fetch_outcome(attempts)
    assert "html" not in moved(out) and "html" not in moved(fetchlog.split_outcomes(won))
    got = {r.url: (r.status, r.html) for r in out.collect()}
    assert len(got) == out.count() == 54
    assert got["http://h/7"] == (200, "body 7 2") and got["http://h/0"][1] in ("body 0 2", "stored twice")
    assert got["not a url"] == (-1, "") and got["http://h/none"] == (-1, "") and got["http://h/null"] == (200, "")
    assert got["http://h/gone"] == (404, "")
    split = {r.url: r.outcome for r in fetchlog.split_outcomes(won).collect()}
    assert split == {r.url: r.outcome for r in fetchlog.split_outcomes(out).collect()}


def test_snapshot_of_outcomes_has_one_row_per_url(spark):
    rows = [("http://h/a#2", 200, "second"), ("http://h/a", 200, "first"), ("http://h/b", 404, ""), ("bad", -1, "")]
    snapshot = snapshot_from_outcomes(spark.createDataFrame(rows, "url string, status int, html string"))
    got = {r.url: r.html for r in snapshot.collect()}
    assert snapshot.count() == len(got) and got["http://h/a"] == "first" and got["http://h/b"] == ""
