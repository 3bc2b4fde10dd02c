"""Centroid clustering and vector codes against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import centroids, codes, queries
from linkloom.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"
CLASHES = "_c _v c n s0 part entry code cluster distance error _label".split()


def integers(vector):
    return [max(-(1 << 24), min(1 << 24, math.floor(256 * float(x)))) for x in vector]


def good(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def nearest(v, entries):
    distances = [squared(v, e) for e in entries]
    return distances.index(min(distances)), min(distances)


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, integers(v)) for i, v, _ in rows if good(v) and len(v) == 64]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest())
    cents = [v for _, v in order[:k]]
    for _ in range(rounds):
        found = [nearest(v, cents)[0] for _, v in kept]
        for c in range(len(cents)):
            own = [v for (_, v), f in zip(kept, found) if f == c]
            if own:
                cents[c] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v, cents)) for i, v in kept]
    inertia = sum(d for *_, d in found)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, c, d, sum(x for _, e, x in found if e == c), inertia, digest[c]) for i, c, d in found]


def plain_codes(rows, entries=64, rounds=2):
    kept = [(i, integers(v), label) for i, v, label in rows if good(v) and len(v) == 64]
    cut = [[v[p : p + 4] for p in range(0, 64, 4)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0))[:entries]
    books = [[cut[k][p] for k in first] for p in range(16)]
    for _ in range(rounds):
        for p, book in enumerate(books):
            found = [nearest(c[p], book)[0] for c in cut]
            for e in range(len(book)):
                own = [c[p] for c, f in zip(cut, found) if f == e]
                if own:
                    book[e] = [sum(x) // len(own) for x in zip(*own)]
    out = []
    for (i, _, label), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(16)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), label))
    errors = {}
    for *_, d, label in out:
        errors[label] = errors.get(label, 0) + d
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, d, errors[label], digest) for i, code, d, label in out]


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_rows(spark, sf):
    return [tuple(r) for r in table(spark, sf, "embeddings").select("vec_id", "embedding", "label").collect()]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, other lengths, non-finite and huge components, ties, repeated rows and clashing names."""
    rng = np.random.default_rng(5)
    base = [rng.normal(0, 0.1, 64).astype("float32").tolist() for _ in range(30)]
    rows = [(k, v, k % 3) for k, v in enumerate(base)]
    rows += [(k, base[k], None) for k in range(8)] + [(100 + k, [0.0] * 64, 7) for k in range(60)]
    rows += [(200 + k, [float(k % 2)] * 64, 8) for k in range(40)]
    rows += [(300, None, 1), (301, [], 1), (302, [1.0] * 63, 1), (303, [1.0] * 128, 1), (304, [1.0] * 63 + [None], 1)]
    rows += [(305, [math.nan] * 64, 1), (306, [math.inf] + [0.0] * 63, 1), (307, [-math.inf] * 64, 1)]
    rows += [(308, [3e38, -3e38] * 32, 1), (309, [5000.0, -70000.0] * 32, 1), (None, base[3], None)]
    folder = tmp_path_factory.mktemp("odd")
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in CLASHES})
    df.write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("where", ["given", "odd"])
def test_clusters(spark, odd, where):
    sf = SF if where == "given" else odd
    assert collected(queries.op11_centroids(spark, sf)) == sorted(plain_clusters(plain_rows(spark, sf)), key=repr)


@pytest.mark.parametrize("where", ["given", "odd"])
def test_codes(spark, odd, where):
    sf = SF if where == "given" else odd
    assert collected(queries.op13_codes(spark, sf)) == sorted(plain_codes(plain_rows(spark, sf)), key=repr)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [0.5] * 64, None)]])
def test_few_vectors(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    n = sum(good(v) for _, v, _ in rows)
    found = centroids.clusters(df)
    assert found.members.count() == len(found.centroids) == n
    coded = codes.compress(df)
    assert coded.members.count() == n and coded.codebooks.shape == (16, n, 4)
    assert coded.members.columns == ["vec_id", "code", "error"]


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    rows = rng.integers(-(1 << 24), 1 << 24, (200, 64))
    order = centroids.sequency(64)
    held = centroids.transformed(rows, order)
    changes = (np.diff(centroids.restored(64 * np.eye(64, dtype="int64"), order) > 0, axis=1)).sum(axis=1)
    assert changes.tolist() == list(range(64))
    assert (centroids.restored(held, order) == rows).all()
    number, least = centroids.nearest(held, held[::7])
    distances = ((rows[:, None].astype(object) - rows[None, ::7]) ** 2).sum(axis=2)
    assert (number == distances.argmin(axis=1)).all() and (least // 64 == distances.min(axis=1)).all()
    with pytest.raises(ValueError):
        centroids.sequency(48)


@pytest.mark.parametrize("spread, remembered", [(20, None), (400, None), (400, 1_000), (10**6, None)])
def test_cells_are_exact(spread, remembered):
    rng = np.random.default_rng(2)
    book = rng.integers(-60, 60, (64, 4))
    book[40:50] = book[3]
    cells = codes.Cells(book, remembered)
    for _ in range(3):
        parts = rng.integers(-spread, spread, (700, 4))
        index, least = cells.nearest(parts)
        distances = ((parts[:, None] - book) ** 2).sum(axis=2)
        assert (index == distances.argmin(axis=1)).all() and (least == distances.min(axis=1)).all()
        assert len(cells.begin) <= (remembered or codes.REMEMBERED)
