"""The near-copy stage against all pairs of fingerprints."""

import corpus_pipeline
from linkloom.llm import queries, simhash

SF = "/root/testdata/sf0.01"


def smallest(prints):
    """Smallest key of each component of all pairs at two bits or fewer."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in prints}


def test_stage_keeps_one_of_each_group(spark):
    docs = queries.documents(spark, SF)
    prints = {r.doc_id: simhash.fingerprint_of(r.text) & ((1 << 64) - 1) for r in docs.collect()}
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted(set(smallest(prints).values())) and len(ids) < len(prints)


def test_stage_uses_the_contract_of_the_operator():
    assert (simhash.SHINGLE, simhash.DISTANCE) == (3, 2)
