"""Document fingerprints from prefix polynomial hashes.

A text's code points c give prefix arrays H[k] = sum of (c_j + 1) B^j for j < k,
modulo two primes. Any span's hash follows from two entries in constant time, so
spans of two texts are compared without reading them, and the longest common
extension from two positions is found by binary search.

A fingerprint is the hash of the whole text and a sketch of the spans of ``SPAN``
words: of the span hashes that fall into each of ``BINS`` bins the smallest is kept.
The likeness of two fingerprints is the share of equal bins among those that
either text fills, an estimate of the Jaccard similarity of their spans; equal
fingerprints are alike to 1.

Defined results: null counts as empty; a text of fewer words is one span; two
empty texts are alike to 1, an empty and another text to 0. "Next" means the next
document by descending key, the first after the last; equal keys follow by the hash
of their text, rows without a key come last; a single document is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN, BINS = 5, 64
PRIMES = ((2_147_483_647, 1_000_003), (2_147_483_629, 69_069_001))
EMPTY = 0xFFFFFFFF
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(128, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of a base and of its inverse modulo a prime, doubled when needed."""

    def __init__(self, prime: int, base: int):
        self.prime, self.base, self.inverse = prime, base, pow(base, -1, prime)
        self.up = self.down = np.ones(1, dtype="uint64")

    def grow(self, size: int) -> None:
        while len(self.up) < size:
            n, p = len(self.up), np.uint64(self.prime)
            self.up = np.append(self.up, self.up * np.uint64(pow(self.base, n, self.prime)) % p)
            self.down = np.append(self.down, self.down * np.uint64(pow(self.inverse, n, self.prime)) % p)


_POWERS = tuple(_Powers(*x) for x in PRIMES)


class Prefix:
    """The prefix arrays of a text."""

    def __init__(self, text: str):
        self.points = np.frombuffer(text.encode("utf-32-le"), dtype="uint32")
        self.size = len(self.points)
        self.sums = []
        shifted = self.points.astype("uint64") + np.uint64(1)
        for powers in _POWERS:
            powers.grow(self.size + 1)
            p = np.uint64(powers.prime)
            sums = np.zeros(self.size + 1, dtype="uint64")
            np.cumsum(shifted * powers.up[: self.size] % p, out=sums[1:])
            sums %= p
            self.sums.append(sums)

    def spans(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of many spans, equal for equal code points wherever they stand."""
        out = np.zeros(len(begins), dtype="uint64")
        for powers, sums in zip(_POWERS, self.sums):
            p = np.uint64(powers.prime)
            out = (out << np.uint64(31)) | ((sums[ends] + p - sums[begins]) % p * powers.down[begins] % p)
        return out

    def span(self, begin: int, end: int) -> int:
        out = 0
        for powers, sums in zip(_POWERS, self.sums):
            difference = (int(sums[end]) - int(sums[begin])) % powers.prime
            out = out << 31 | difference * int(powers.down[begin]) % powers.prime
        return out

    def extension(self, begin: int, other: Prefix, at: int) -> int:
        """Length of the longest common run of code points from two positions on."""
        low, high = 0, min(self.size - begin, other.size - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(begin, begin + middle) == other.span(at, at + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the words."""
        white = np.ones(self.size + 2, dtype=bool)
        low = self.points < 128
        white[1:-1] = low & _WHITE[np.where(low, self.points, 0)]
        return np.flatnonzero(white[:-1] & ~white[1:]), np.flatnonzero(~white[:-1] & white[1:])


@dataclass
class Fingerprint:
    whole: int
    sketch: np.ndarray

    def text(self) -> str:
        return f"{self.whole:016x}" + self.sketch.astype(">u4").tobytes().hex()


def fingerprint(prefix: Prefix) -> Fingerprint:
    begins, ends = prefix.words()
    if len(begins) >= SPAN:
        begins, ends = begins[: len(begins) - SPAN + 1], ends[SPAN - 1 :]
    else:
        begins, ends = np.array([0]), np.array([prefix.size])
    sketch = np.full(BINS, EMPTY, dtype="uint32")
    if prefix.size:
        h = prefix.spans(begins, ends)
        h = (h ^ (h >> np.uint64(29))) * _MIX
        h ^= h >> np.uint64(32)
        np.minimum.at(sketch, (h & np.uint64(BINS - 1)).astype("int64"), (h >> np.uint64(32)).astype("uint32"))
    # The length keeps apart the few texts whose hashes could agree.
    return Fingerprint(prefix.span(0, prefix.size) ^ prefix.size, sketch)


def alike(a: Fingerprint, b: Fingerprint) -> float:
    if a.whole == b.whole and (a.sketch == b.sketch).all():
        return 1.0
    filled = (a.sketch != EMPTY) | (b.sketch != EMPTY)
    return float(((a.sketch == b.sketch) & filled).sum() / max(1, filled.sum()))


def parse(text: str) -> Fingerprint:
    return Fingerprint(int(text[:16], 16), np.frombuffer(bytes.fromhex(text[16:]), dtype=">u4").astype("uint32"))


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints as written."""
    return alike(parse(a), parse(b))


def edit(text: str, following: str) -> str:
    """``text`` with its second half replaced by the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``text`` and ``next_text``.

    The keys are cut into ranges at keys that occur, as many as two for each shuffle
    partition. The first row of a range is also sent to the range before it, and the
    very first to the last one, so a window inside the ranges sees every successor.
    Texts move once. Keys are taken to be nearly unique.
    """
    spark = docs.sparkSession
    count = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(k / count) for k in range(1, count)])
    inner, last = docs.agg(F.percentile_approx(key, shares, F.lit(100 * count)), F.max(key)).first()
    cuts = np.array(sorted({*(inner or []), *([last] if last is not None else [])}))
    rows = docs.select(docs[key].alias("_key"), F.coalesce(docs[text], F.lit("")).alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    if len(cuts):

        @F.pandas_udf("array<int>")
        def ranges(keys: pd.Series, missing: pd.Series) -> pd.Series:
            """A row's range, numbered from the largest keys on, and the one it is also sent to."""
            known = ~missing.to_numpy(dtype=bool)
            values = keys.to_numpy()[known]
            at = np.searchsorted(cuts, values)
            own = len(cuts) - at
            before = np.where(own == 1, len(cuts), own - 1)
            lists = iter([[o, b] if c else [o] for o, b, c in zip(own.tolist(), before.tolist(), cuts[at] == values)])
            return pd.Series([next(lists) if k else [len(cuts)] for k in known.tolist()])

        order = [F.col("_tail"), F.desc_nulls_last("_key"), F.col("_hash")]
        within = W.partitionBy("_range").orderBy(*order)
        rows = rows.select("*", F.posexplode(ranges(F.coalesce("_key", F.lit(0)), F.col("_key").isNull())).alias("_tail", "_range"))
        rows = rows.withColumn("_next", F.lead("_text").over(within)).filter("_tail = 0")
    else:
        # No key at all: the rows follow each other by hash, in ranges of it.
        within = W.partitionBy(F.pmod("_hash", F.lit(count))).orderBy("_hash")
        rows = rows.withColumn("_next", F.coalesce(F.lead("_text").over(within), F.first("_text").over(within)))
    return rows.select(F.col("_key").alias(key), F.col("_text").alias(text), F.col("_next").alias("next_text"))


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, and how alike they are."""
    pairs = with_next(docs, key, text)
    schema = T.StructType([pairs.schema[key]])
    for name, kind in (
        ("n_chars", T.LongType()),
        ("edited_sha256", T.StringType()),
        ("fingerprint", T.StringType()),
        ("edited_fingerprint", T.StringType()),
        ("near_edited", T.DoubleType()),
        ("near_next", T.DoubleType()),
        ("shared_prefix", T.LongType()),
    ):
        schema = schema.add(name, kind, False)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str | None, Prefix | None, Fingerprint | None] = (None, None, None)

        def of(t: str) -> tuple[Prefix, Fingerprint]:
            prefix = Prefix(t)
            return prefix, fingerprint(prefix)

        for batch in batches:
            rows = []
            for own, following in zip(batch.column(text).to_pylist(), batch.column("next_text").to_pylist()):
                prefix, print_ = held[1:] if held[0] == own else of(own)
                changed = edit(own, following)
                changed_prefix, changed_print = of(changed)
                # Rows follow each other, so the next text is mostly the next row's.
                held = (following, *of(following))
                rows.append(
                    (
                        prefix.size,
                        hashlib.sha256(changed.encode()).hexdigest(),
                        print_.text(),
                        changed_print.text(),
                        alike(print_, changed_print),
                        alike(print_, held[2]),
                        prefix.extension(0, changed_prefix, 0),
                    )
                )
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=schema.names
            )

    return pairs.mapInArrow(work, schema)
