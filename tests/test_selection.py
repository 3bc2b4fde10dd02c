"""The k-th row of each key against sorted lists."""

import random

import pytest

from linkloom.operators import selection


@pytest.mark.parametrize("sorted_rows, pivots", [(None, 64), (20, 4), (1, 64)])
def test_kth_equals_sorted(spark, monkeypatch, sorted_rows, pivots):
    monkeypatch.setattr(selection, "PIVOTS", pivots)
    rng = random.Random(6)
    sizes = {1: 900, 2: 40, 3: 1, 4: 300, 5: 7}
    rows = {k: [[rng.randrange(9), *([rng.randrange(50)] * (i % 3)), i] for i in range(n)] for k, n in sizes.items()}
    frame = spark.createDataFrame([(k, o) for k, os in rows.items() for o in os], "crawl_id long, ord array<int>").repartition(4)
    for share in (0.5,) if sorted_rows == 1 else (0.0, 1.0):
        wanted = {k: max(1, int(n * share)) for k, n in sizes.items() if k != 4} | {5: 8, 9: 1}
        found = selection.kth(frame, "crawl_id", "ord", spark.createDataFrame(list(wanted.items()), "crawl_id long, k int"), sorted_rows)
        got = {r.crawl_id: r.ord for r in found.collect()}
        assert got == {k: sorted(rows[k])[n - 1] for k, n in wanted.items() if k in rows and n <= sizes[k]}
