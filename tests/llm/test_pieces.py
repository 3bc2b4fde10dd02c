"""SentencePiece encoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from linkloom.llm import pieces, queries
from linkloom.llm.common import table

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "   ", "a", "  a  b ", "\t\n x", "▁a ▁", "<s> <0x0A> </s> <unk>", "日本語テキスト " * 50,
    "\U0001f642 ﷽ \u0000 x", "x" * 500, " " * 300 + "y" + " " * 77, "﻿abc é é ", "same", "same",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_texts():
    rng = random.Random(1)
    letters = "abcdefgh  th▁\n0123é漢字\U0001f642"
    some = ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(800)]
    return some + ["".join(rng.choice("aeionrst") for _ in range(rng.randrange(90))) for _ in range(400)]


def test_texts_as_the_library_encodes_them(library):
    texts = ODD + random_texts()
    offsets, ids = pieces._Memory(pieces.vocabulary(PATH)).encode(texts)
    found = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert found == library.encode([t or "" for t in texts])


def test_tables_and_heaps_agree(monkeypatch):
    vocabulary = pieces.vocabulary(PATH)
    words = sorted({w for t in random_texts() for w in pieces._WORD.findall(" " + t.replace("▁", " "))})
    count, ids = vocabulary.encode(words)
    monkeypatch.setattr(pieces, "WIDTHS", ())
    monkeypatch.setattr(pieces, "WIDE", 0)
    other_count, other_ids = vocabulary.encode(words)
    assert np.array_equal(count, other_count) and np.array_equal(ids, other_ids)


def test_a_difference_raises():
    vocabulary = pieces.vocabulary(PATH)
    count, ids = vocabulary.encode([" the", " best"])
    vocabulary.check([" the", " best"], count, ids)
    with pytest.raises(ValueError, match="best"):
        vocabulary.check([" the", " best"], count, np.append(ids[:-1], 5))


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    memory = pieces._Memory(pieces.vocabulary(PATH))
    for t in random_texts()[:50]:
        offsets, ids = memory.encode([t])
        assert ids.tolist() == library.encode(t) and memory.characters < 50 + 2 * len(t) + 2


def test_other_models_raise(tmp_path):
    model = pieces.sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        pieces._check(model)


def test_long_word(library):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnop漢") for _ in range(150_000))
    offsets, ids = pieces._Memory(pieces.vocabulary(PATH)).encode([text])
    assert ids.tolist() == library.encode(text)


@pytest.mark.parametrize("texts", [ODD, []], ids=["edges", "empty"])
def test_encode_and_decode(spark, library, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    df = df.withColumns({c: F.lit("x") for c in ("ids", "decoded", "key")})
    wanted = [(k, i, library.decode(i)) for k, i in enumerate(library.encode([t or "" for t in texts]))]
    once = pieces.encode(df, PATH, decoded=True)
    assert sorted(map(tuple, once.collect())) == wanted
    twice = pieces.decode(pieces.encode(df, PATH), PATH)
    assert sorted(map(tuple, twice.collect())) == wanted
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(nothing, PATH).first().decoded == ""


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    rows = queries.op12_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
