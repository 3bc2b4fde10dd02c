"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import bpe, fingerprints, html_text, licenses, mixing, quality, simhash, substrings, suffixes, toxicity

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside.
CLASHES = (
    "_id _hash _text _doc doc _key _row _k _k2 fp _fp component_id spans kept taken copy size ids score "
    "term _label n_words base_failed _windows target finish _chunk u v node root"
).split()
LONG = "ein langer Text mit vielen Wörtern und noch mehr " * 4_000

ROWS = [
    (1, None, "en", "a", None),
    (2, "", None, "b", 0),
    (3, " \n\t ", "en", None, 4),
    (4, LONG, "de", "a", len(LONG)),
    (5, "a" * 30_000, "en", "a", 30_000),
    (6, "Twice the same row, word for word, comma for comma.", "en", "b", 51),
    (6, "Twice the same row, word for word, comma for comma.", "en", "b", 51),
    (7, "Twice the same row, word for word, comma for comma.", "en", "c", 51),
    (8, "One key with", "en", "b", 12),
    (8, "two different texts", "en", "b", 19),
    (None, "A row without a key, its text like no other.", "en", "a", 44),
    (None, None, None, None, None),
]


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df


@pytest.fixture(scope="module", params=["edges", "empty"])
def docs(request, spark):
    return frame(spark, ROWS if request.param == "edges" else [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(4, 1, 1), (5, 1, 0), (6, None, 0), (None, 1, 1), (7, 1, None), (4, 1, 0)],
        "doc_id long, quality int, toxic int",
    )


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_quality(docs):
    rows = quality.judged(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    if rows:
        assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[1].base_failed
        assert by[4].n_words == 36_000 and by[4].n_repeat_words == 36_000
        assert not any(r.kept for r in rows) and by[6]._id == "x"


def test_mixing(docs):
    sized = mixing.sizes(docs)
    taken = mixing.schedule(sized).groupBy("_row").agg(F.sum("taken").alias("t"))
    rows = sized.join(taken, "_row", "left").collect()
    assert len(rows) == docs.count() and all((r.t or 0) <= 2 * r.size for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = mixed.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] or 0
    assert words == sum(r.t or 0 for r in rows)


def test_fingerprints(docs):
    rows = fingerprints.compared(docs).collect()
    assert len(rows) == docs.count()
    same = {r.fingerprint for r in rows if r.doc_id in (6, 7)}
    if rows:
        assert len(same) == 1 and {r.n_chars for r in rows if r.doc_id == 1} == {0}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_fingerprints_without_keys(spark):
    rows = fingerprints.compared(frame(spark, [(None, "a b c", None, None, 1), (None, "d", None, None, 1)])).collect()
    assert len(rows) == 2


def test_licenses(docs):
    model = licenses.train(docs)
    rows = licenses.scan(docs, model).collect()
    assert len(rows) == docs.count() and not any(r.notices for r in rows)


def test_html(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>" * 5_000 + "x"), (4, "<div>a&amp;b</div>")], "page_id int, html string")
    got = dict(pairs(pages.select("page_id", html_text.main_text(F.col("html")).alias("t")), "page_id", "t"))
    assert got == {1: "", 2: "", 3: "x", 4: "a&b"}
    assert pages.limit(0).select(html_text.main_text(F.col("html"))).count() == 0


def test_substrings(docs):
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    if texts:
        assert texts[1] is None and texts[2] == "" and len(texts[4]) < len(LONG) / 10


def test_suffixes(docs):
    rows = {r.doc_id: r for r in suffixes.remove(docs).collect()}
    assert suffixes.remove(docs).count() == docs.count()
    if rows:
        assert rows[1].n_bytes == 0 and rows[1].kept == b"" and not rows[6].spans
        assert rows[5].kept == b"" and rows[4].n_bytes == len(LONG.encode())


def test_bpe(docs):
    encoded = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    rows = bpe.decode(encoded, PATH).collect()
    wanted = sorted(((r.text or "").encode() for r in docs.select("text").collect()))
    assert sorted(bytes(r.decoded) for r in rows) == wanted
    once = bpe.encode(docs, PATH, public_tokenizers.PATTERN, decoded=True).collect()
    assert sorted(map(repr, once)) == sorted(map(repr, rows))


def test_simhash(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    if rows:
        found = {r.doc_id: (r.fp, r.component_id) for r in rows}
        assert found[1] == found[2] == found[3] == (0, 1) and found[7][1] == 6
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    if rows:
        assert ids.count(1) == 1 and ids.count(6) == 1 and 7 not in ids and 2 not in ids


def test_toxicity(docs, labels):
    index = toxicity.train(docs, labels)
    rows = toxicity.score(docs, index).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.train(docs, labels.limit(0)).none == 0.0
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("rows", [ROWS, []], ids=["edges", "empty"])
def test_stage(spark, tmp_path, labels, name, stage, rows):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(spark, rows, clash=name != "byte-level bpe")
    out = stage(spark, docs, str(tmp_path))
    assert out.count() >= 0
    if name != "byte-level bpe":
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
