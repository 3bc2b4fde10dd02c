"""Near-duplicates: SimHash by pigeonring chains.

A fingerprint has 64 bits in seven segments on a ring. If two fingerprints
differ in at most ``DISTANCE`` bits, then from some segment on every chain of
consecutive segments differs in at most its proportional share, length x
DISTANCE / 7. The first three segments of such a chain are equal: they are the
join key, one row per start. The longer prefixes of the chain prune the
candidates before the full Hamming check.

A key shared by more than ``LIGHT`` fingerprints would give too many pairs. Its
fingerprints are linked through the points at distance one from them instead:
two fingerprints differ in at most two bits exactly when they have such a point
(or one of them) in common, and a point has 65 at most. Links through the
smallest of those keep the components whole without pairs.

Equal fingerprints are one node, so copies never multiply. Defined results: a
null or wordless text has the fingerprint zero and is linked like any other; rows
without a key take part but cannot name a component (its id is null if no
member has a key); repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm.components import connected_components
from linkloom.session import written

SHINGLE, SEED = 3, 42
DISTANCE = 2
# Segment widths, the chain's part that must be equal (a share below one bit).
WIDTHS = (9, 9, 9, 9, 9, 9, 10)
EQUAL = 3
# Fingerprints of one key that are still compared in pairs.
LIGHT = 64


def fingerprint_of(text: str | None) -> int:
    """The 64 majority bits of the hashes of a text's word shingles, as a signed number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype="int64", count=len(words)) + 1) - 1
        begins = np.append(0, ends[:-1] + 1)
        last = len(words) - SHINGLE + 1
        hashes = [
            digest(joined[i:j], SEED) for i, j in zip(begins[:last].tolist(), ends[SHINGLE - 1 :].tolist())
        ]
    counts = np.zeros(64, dtype="int64")
    bits = np.array(hashes, dtype=">u8").view("uint8").reshape(-1, 8)
    for at in range(0, len(bits), 65_536):
        counts += np.unpackbits(bits[at : at + 65_536], axis=1).sum(axis=0, dtype="int64")
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def fingerprint(text: Column) -> Column:
    """The fingerprint as a long."""

    @F.pandas_udf("long")
    def work(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([fingerprint_of(t) for t in part], dtype="int64")

    return work(text)


def hex_digits(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def links(nodes: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` whose components are those of all pairs within ``DISTANCE`` bits.

    ``nodes`` has one row per fingerprint ``fp``.
    """
    keyed = nodes.select("fp", F.explode(_chain_keys(F.col("fp"))).alias("c")).select("fp", "c.*")
    sizes = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(keyed.join(sizes, ["start", "key"]), "chains")
    light = shared.filter(F.col("n") <= LIGHT).select("start", "key", "fp")
    pairs = (
        light.select("start", "key", F.col("fp").alias("a"))
        .join(light.select("start", "key", F.col("fp").alias("b")), ["start", "key"])
        .filter("a < b")
        .withColumn("x", F.col("a").bitwiseXOR(F.col("b")))
        .filter(_chain_holds(F.col("x"), F.col("start")) & (F.bit_count("x") <= DISTANCE))
        .select("a", "b")
    )
    points = F.concat(
        F.array("fp"), F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
    )
    around = (
        shared.filter(F.col("n") > LIGHT)
        .select("fp")
        .distinct()
        .select("fp", F.explode(points).alias("point"))
        .select("fp", F.min("fp").over(W.partitionBy("point")).alias("hub"))
        .filter("hub < fp")
        .select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    )
    return pairs.union(around).distinct()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _masks() -> list[int]:
    masks, at = [], 0
    for width in WIDTHS:
        masks.append(_signed(((1 << width) - 1) << at))
        at += width
    return masks


def _ring(start: int, length: int) -> int:
    """The mask of ``length`` consecutive segments."""
    out = 0
    for k in range(length):
        out |= _masks()[(start + k) % len(WIDTHS)]
    return _signed(out & ((1 << 64) - 1))


def _chain_keys(fp: Column) -> Column:
    return F.array(
        *[
            F.struct(F.lit(s).alias("start"), fp.bitwiseAND(F.lit(_ring(s, EQUAL))).alias("key"))
            for s in range(len(WIDTHS))
        ]
    )


def _chain_holds(x: Column, start: Column) -> Column:
    """Every prefix of the chain beyond the equal part keeps to its share."""
    segments = len(WIDTHS)
    return F.element_at(
        F.array(
            *[
                F.expr("true")
                if EQUAL + 1 >= segments
                else _all(
                    F.bit_count(x.bitwiseAND(F.lit(_ring(s, n)))) <= n * DISTANCE // segments
                    for n in range(EQUAL + 1, segments)
                )
                for s in range(segments)
            ]
        ),
        start + 1,
    )


def _all(tests: Iterator[Column]) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fp`` and ``component_id``, the smallest key of the document's component."""
    prints = written(docs.select(docs[key].alias("_key"), fingerprint(docs[text]).alias("fp")), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("_key").alias("_first")), "nodes")
    roots = written(connected_components(links(nodes.select("fp"))), "roots")
    named = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "_first")
    smallest = named.groupBy("root").agg(F.min("_first").alias("_least"))
    moved = named.join(smallest, "root").select("fp", "_least")
    classes = nodes.join(moved, "fp", "left").select("fp", F.coalesce("_least", "_first").alias("component_id"))
    # Written, so that the join can be split on a fingerprint that very many documents share.
    return prints.join(written(classes, "classes"), "fp").select(F.col("_key").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component of ``near_duplicates``, that with the smallest key; the columns of ``docs``.

    Of repeated rows of that key the smallest row is kept. Documents without a
    key stay where no member of their component has one.
    """
    found = near_duplicates(docs, key, text)
    heads = found.filter(F.col(key).isNotNull() & (F.col(key) == F.col("component_id")))
    heads = heads.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    heads = written(heads, "heads")
    once = docs.join(heads.filter("_rows = 1").select(key), key, "left_semi").select(*docs.columns)
    again = docs.join(heads.filter("_rows > 1").select(key), key, "left_semi")
    again = again.groupBy(key).agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    nameless = found.filter(F.col("component_id").isNull()).select(F.col("fp").alias("_fp")).distinct()
    unkeyed = docs.filter(docs[key].isNull()).select(
        F.struct(*docs.columns).alias("_doc"), fingerprint(docs[text]).alias("_fp")
    )
    unkeyed = unkeyed.join(nameless, "_fp", "left_semi").select("_doc.*")
    return once.unionByName(again).unionByName(unkeyed)
