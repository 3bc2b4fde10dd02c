"""Near copies of labelled toxic examples, with or without a marking term."""

import math
from collections import Counter

from linkloom.llm import queries, toxicity
from linkloom.llm.common import table

SF = "/root/testdata/sf0.01"


def test_every_copy_of_a_toxic_example_is_found(spark):
    docs, labels = queries.documents(spark, SF), table(spark, SF, "labels")
    index = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    sample = {r._id: r._label for r in toxicity._sample(labels, "doc_id", "toxic").collect() if r._id in texts}
    examples = {i: Counter(toxicity.words_of(texts[i])) for i in sample if toxicity.words_of(texts[i])}
    assert sorted(examples) == sorted(index.copies.ids.tolist())
    used = Counter(w for c in examples.values() for w in c)

    def vector(counts):
        v = {w: (1 + math.log(n)) * (math.log((1 + len(examples)) / (1 + used[w])) + 1) for w, n in counts.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    vectors = {i: vector(c) for i, c in examples.items()}
    unmarked = 0
    for i in [i for i in examples if sample[i]]:
        words = toxicity.words_of(texts[i])
        own = vector(Counter(words))
        every = {j: sum(x * v.get(w, 0.0) for w, x in own.items()) for j, v in vectors.items()}
        rows, cosines = index.copies.near(words)
        found = dict(zip(index.copies.ids[rows].tolist(), cosines.tolist()))
        assert found.keys() == {j for j, x in every.items() if x >= toxicity.COPY}
        assert all(math.isclose(x, every[j], abs_tol=1e-8) for j, x in found.items())
        if all(sample[j] for j in found):
            unmarked += not len(index.vector(words)[0])
            assert index.score(texts[i])[0] >= toxicity.THRESHOLD
            if len(words) > 60:
                assert index.score(texts[i] + " oneword")[0] >= toxicity.THRESHOLD
    assert unmarked


def test_the_words_searched_are_bounded(spark, monkeypatch):
    """Examples come in the order of the sample, and whole, until the bound is met."""
    docs, labels = queries.documents(spark, SF), table(spark, SF, "labels")
    all_ids = toxicity.train(docs, labels).copies.ids.tolist()
    monkeypatch.setattr(toxicity, "WORDS", 3_000)
    copies = toxicity.train(docs, labels).copies
    assert 0 < len(copies.ids) < len(all_ids) and set(copies.ids.tolist()) <= set(all_ids)
    assert copies.row_begin[-1] == copies.used.sum() <= 3_000


def test_texts_reach_python_few_at_a_time(spark, monkeypatch):
    """Whole texts in batches of 10,000 rows filled the executors; the session's setting is kept."""
    docs, labels = queries.documents(spark, SF), table(spark, SF, "labels")
    setting, seen, sample = "spark.sql.execution.arrow.maxRecordsPerBatch", [], toxicity._sample
    before = spark.conf.get(setting)

    def watched(*given):
        seen.append(int(spark.conf.get(setting)))
        return sample(*given)

    monkeypatch.setattr(toxicity, "_sample", watched)
    index = toxicity.train(docs, labels)
    kept, scored = toxicity.keep_clean(docs, labels), toxicity.score(docs, index)
    assert all(0 < n <= 500 for n in seen) and len(seen) == 2 and spark.conf.get(setting) == before
    for out in (kept, scored):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and plan.count("BatchEvalPython") == 1
    assert kept.columns == docs.columns and scored.columns == ["doc_id", "score", "neighbours", "cosines"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: (r.score, r.neighbours, r.cosines) for r in scored.collect()}
    assert scores.keys() == texts.keys() and all(scores[i] == index.score(texts[i]) for i in list(texts)[:200])
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s[0] < toxicity.THRESHOLD}
