"""Toxicity from the nearest labelled examples under exact TF-IDF cosine.

Training is bounded: at most ``SAMPLE`` labelled documents (those with the
smallest hash of their id) and at most ``TERMS`` terms. Terms are lower-case runs
of letters or digits, and the beginnings (``PREFIX`` characters, with a star) that
longer runs share, if they mark toxic documents: most of a term's uses are in such
documents, and its log-likelihood ratio, counted once per distinct pair of neighbouring words, so that copies of a
document add nothing, is at least ``LEAST_RATIO``. Examples are vectors over the
terms, (1 + ln tf) x idf, of length one, in an inverted index whose postings lie
in blocks of ``BLOCK`` examples with the largest weight of each term per block.

A document's whole text is one query. The sum of its weights times the block's
largest weights bounds every cosine in a block; blocks are read in falling
order of the bound until it is below the ``NEIGHBOURS``-th best cosine, so the
neighbours are exact. Their votes, weighted by distance, are calibrated by logistic
regression on the examples' own leave-one-out votes. A document that holds no
term has no neighbour; its score is the rate among the examples without any.

Sampled examples are also held with all their words (``Copies``), as many in the order of the
sample as have ``WORDS`` words in all, and every document is searched there for examples with a TF-IDF cosine of ``COPY`` or more over all
words. This is exact too: rare and heavy words come first until the rest of the vector
cannot reach ``COPY`` alone, and whatever shares enough of them is compared whole. If
the vote of these near copies is the higher score, it counts, so a near copy of a
toxic example is found whether or not it holds a marking term.

Defined results: null and empty texts hold no term; rows without a key are
scored like others but never trained on; contradicting labels of a document
count as toxic; without examples every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.session import written

SAMPLE = 20_000
# Words of the examples searched for near copies, each counted once per example.
WORDS = 10_000_000
TERMS = 1_024
LEAST_RATIO = 20.0
# Candidates by plain document frequency pass a lower bar first.
LEAST_FIRST = 12.0
PREFIX = 4
BLOCK = 64
NEIGHBOURS = 10
# A vote weighs cosine / (1 - cosine + NEAR); DOUBT is a standing vote for clean.
NEAR = 0.1
DOUBT = 0.5
THRESHOLD = 0.7
# Cosine over all words from which an example is a near copy; the part of the vector not searched.
COPY, REST = 0.8, 0.75

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def prefix_of(word: str) -> str:
    return word[:PREFIX] + "*" if len(word) > PREFIX else ""


def held_out(key: str):
    """Whether a document's label is kept from training."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


@dataclass
class Copies:
    """All words of all examples: vectors by row, and the rows and weights by word.

    Only the packed counts travel; the vectors are made where they are first used.
    """

    words: np.ndarray  # hashes, rising
    used: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    row_begin: np.ndarray
    packed: list[tuple[bytes, bytes]]  # of each block, steps between the word numbers and the counts
    ready: bool = False

    def __getstate__(self) -> dict:
        names = ("words", "used", "ids", "labels", "row_begin", "packed")
        return {n: getattr(self, n) for n in names} | {"ready": False}

    def _open(self) -> None:
        """Word numbers and counts by row, and by word the rows with rounded weights, which only find candidates."""
        size, begin = int(self.row_begin[-1]), 0
        self.idf = np.log((1 + len(self.ids)) / (1 + self.used)) + 1
        # The idf of a word that no example holds.
        self.rarest = math.log(1 + len(self.ids)) + 1
        self.row_word, self.row_count = np.empty(size, dtype="int32"), np.empty(size, dtype="int32")
        for steps, counts in self.packed:
            end = begin + len(held := np.frombuffer(zlib.decompress(counts), dtype="int32"))
            self.row_count[begin:end] = held
            np.cumsum(np.frombuffer(zlib.decompress(steps), dtype="int32"), dtype="int32", out=self.row_word[begin:end])
            begin = end
        self.length = np.ones(len(self.ids))
        for row in range(len(self.ids)):
            held = self._weights(row)
            self.length[row] = math.sqrt(float(held @ held))
        small = "uint16" if len(self.ids) < 1 << 16 else "int32"
        row_of = np.repeat(np.arange(len(self.ids), dtype=small), np.diff(self.row_begin))
        self.begin = np.append(0, np.cumsum(self.used, dtype="int64"))
        self.post_row, self.post_weight = np.empty(size, dtype=small), np.empty(size, dtype="float32")
        # A range of words at a time, so that little is held beside the result.
        limits = np.searchsorted(self.begin, np.linspace(0, size, 17)).tolist()
        for low, high in pairwise(limits):
            at = np.flatnonzero((self.row_word >= low) & (self.row_word < high))
            at = at[np.argsort(self.row_word[at], kind="stable")]
            rows = row_of[at]
            own = slice(self.begin[low], self.begin[high])
            self.post_row[own] = rows
            self.post_weight[own] = (1 + np.log(self.row_count[at])) * self.idf[self.row_word[at]] / self.length[rows]
        self.ready = True

    def _weights(self, row: int) -> np.ndarray:
        own = slice(self.row_begin[row], self.row_begin[row + 1])
        return (1 + np.log(self.row_count[own])) * self.idf[self.row_word[own]] / self.length[row]

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the examples of cosine ``COPY`` or more, best first."""
        none = np.empty(0, dtype="int64"), np.empty(0)
        if not words or not len(self.words):
            return none
        if not self.ready:
            self._open()
        hashes, counts = _hashed(words)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = self.words[at] == hashes
        weights = (1 + np.log(counts)) * np.where(known, self.idf[at], self.rarest)
        weights /= math.sqrt(float(weights @ weights))
        at, weights = at[known], weights[known]
        # Words that no example holds only lengthen the vector.
        if float(weights @ weights) < COPY * COPY - 1e-9:
            return none
        order = np.argsort(-(weights**2) / self.used[at], kind="stable")
        left = np.sqrt(np.maximum(0.0, np.cumsum((weights[order] ** 2)[::-1])[::-1]))
        first = order[left >= REST]
        rest = float(left[len(first)]) if len(first) < len(order) else 0.0
        spans = [slice(self.begin[t], self.begin[t + 1]) for t in at[first].tolist()]
        rows = np.concatenate([self.post_row[s] for s in spans])
        parts = np.concatenate([self.post_weight[s] * w for s, w in zip(spans, weights[first].tolist())])
        # The rounded weights are off by less than this.
        candidates = np.flatnonzero(np.bincount(rows, parts) >= COPY - rest - 1e-5)
        cosines = np.empty(len(candidates))
        for k, row in enumerate(candidates.tolist()):
            own = slice(self.row_begin[row], self.row_begin[row + 1])
            other = self.row_word[own]
            place = np.minimum(np.searchsorted(other, at), len(other) - 1)
            cosines[k] = float(weights @ np.where(other[place] == at, self._weights(row)[place], 0.0))
        cosines = np.minimum(np.round(cosines, 9), 1.0)
        found = np.flatnonzero(cosines >= COPY)
        found = found[np.lexsort((self.ids[candidates[found]], -cosines[found]))]
        return candidates[found], cosines[found]

    def score(self, words: list[str]) -> tuple[float, list[int], list[float]]:
        rows, cosines = self.near(words)
        weights = cosines / (1 - cosines + NEAR)
        score = float((weights * self.labels[rows]).sum() / (weights.sum() + DOUBT))
        return score, self.ids[rows[:NEIGHBOURS]].tolist(), cosines[:NEIGHBOURS].tolist()


def _hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of words, rising, and how often each is used."""
    digest = xxhash.xxh3_64_intdigest
    counts = Counter(words)
    hashes = np.array([digest(w.encode("utf-8", "surrogatepass")) for w in counts], dtype="uint64").view("int64")
    order = np.argsort(hashes)
    return hashes[order], np.array(list(counts.values()), dtype="int32")[order]


@dataclass
class Index:
    """Examples as a block-max inverted index, with the calibration of votes."""

    number: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    highest: np.ndarray  # term x block
    begin: np.ndarray  # term x block, and one past the last
    post_row: np.ndarray
    post_weight: np.ndarray
    none: float
    slope: float = 1.0
    shift: float = 0.0
    copies: Copies | None = None

    def vector(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number = self.number
        counts = _count(words, number)
        terms = np.array(sorted(counts), dtype="int64")
        weights = np.array([1 + math.log(counts[t]) for t in terms.tolist()]) * self.idf[terms]
        return terms, weights / math.sqrt(float(weights @ weights)) if len(terms) else weights

    def nearest(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the nearest examples, best first, smaller ids first among equals."""
        bound = weights @ self.highest[terms]
        best_row = np.empty(0, dtype="int64")
        best = np.empty(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best) == NEIGHBOURS and bound[b] < best[-1] - 1e-9):
                break
            at = [slice(self.begin[t, b], self.begin[t, b + 1]) for t in terms.tolist()]
            rows = np.concatenate([self.post_row[s] for s in at]) - b * BLOCK
            scores = np.bincount(
                rows,
                np.concatenate([self.post_weight[s] * w for s, w in zip(at, weights)]),
                minlength=BLOCK,
            )
            found = np.flatnonzero(scores > 0)
            found = found[found + b * BLOCK != skip]
            best_row = np.concatenate([best_row, found + b * BLOCK])
            best = np.concatenate([best, np.round(scores[found], 9)])
            order = np.lexsort((self.ids[best_row], -best))[:NEIGHBOURS]
            best_row, best = best_row[order], best[order]
        return best_row, best

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        weights = cosines / (1 - cosines + NEAR)
        return float((weights * self.labels[rows]).sum() / (weights.sum() + DOUBT))

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        """Score, and as evidence the ids and cosines of the neighbours or near copies it rests on."""
        words = words_of(text)
        marked = self._marked(words)
        copied = self.copies.score(words) if self.copies else (0.0, [], [])
        return copied if copied[0] > marked[0] else marked

    def _marked(self, words: list[str]) -> tuple[float, list[int], list[float]]:
        terms, weights = self.vector(words)
        if not len(terms):
            return self.none, [], []
        rows, cosines = self.nearest(terms, weights)
        if not len(rows):
            return self.none, [], []
        score = _logistic(self.slope * self.vote(rows, cosines) + self.shift)
        return score, self.ids[rows].tolist(), cosines.tolist()


def _count(words: list[str], number: dict[str, int]) -> Counter:
    counts = Counter(number[w] for w in words if w in number)
    counts.update(number[p] for p in map(prefix_of, words) if p in number)
    return counts


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _calibrate(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit with smoothed targets (Newton steps, a slight ridge)."""
    toxic, clean = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (toxic + 1) / (toxic + 2), 1 / (clean + 2))
    x = np.stack([votes, np.ones_like(votes)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (target - p) - 1e-2 * beta * [1, 0]
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _sample(labels: DataFrame, key: str, label: str) -> DataFrame:
    """Bounded training labels, one row per document, chosen by hash."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(key).cast("long").alias("_id")).agg(F.max(F.col(label)).alias("_label"))
    return known.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)


def _ratio(toxic, total, all_toxic: float, all_clean: float):
    """Log-likelihood ratio of a term's counts against the label's rates."""
    clean = total - toxic
    share = all_toxic / (all_toxic + all_clean)

    def part(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(F.lit(0.0))

    return 2 * (part(toxic, total * share) + part(clean, total * (1 - share)))


def _words(texts: DataFrame, terms: list[str] | None) -> DataFrame:
    """Rows ``term, context, _label``: each distinct term of a text, or all its
    uses with a hash of the words beside it if ``terms`` are given."""
    wanted = None if terms is None else set(terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("_label").to_pylist()
            for text, label in zip(batch.column("_text").to_pylist(), labels):
                words = words_of(text)
                if wanted is None:
                    used = sorted({*words, *map(prefix_of, words)} - {""})
                    context = [0] * len(used)
                else:
                    at = [(k, t) for k, w in enumerate(words) for t in (w, prefix_of(w)) if t in wanted]
                    used = [t for _, t in at]
                    beside = ["", *words, ""]
                    context = [_hash(beside[k], beside[k + 2]) for k, _ in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.string()), pa.array(context, pa.int64()), pa.array([label] * len(used), pa.int32())],
                    names=["term", "context", "_label"],
                )

    return texts.select("_text", F.col("_label").cast("int").alias("_label")).mapInArrow(
        work, "term string, context long, _label int"
    )


def _hash(left: str, right: str) -> int:
    return xxhash.xxh64_intdigest(f"{left} {right}".encode()) >> 1


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Index:
    """The index of the labelled examples; what reaches the driver is bounded by ``SAMPLE`` and ``TERMS``."""
    with _few_rows(docs.sparkSession):
        return _train(docs, labels, key, text, label)


def _train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> Index:
    sample = _sample(labels, key, label)
    texts = docs.select(docs[key].cast("long").alias("_id"), docs[text].alias("_text")).join(F.broadcast(sample), "_id")
    texts = written(texts, "examples")
    toxic, total = texts.agg(F.coalesce(F.sum("_label"), F.lit(0)), F.count(F.lit(1))).first()
    none = Index({}, np.empty(0), np.empty(0), np.empty(0), np.empty((0, 0)), np.empty(0), np.empty(0), np.empty(0), 0.0)
    if not total:
        return none
    chosen: list[str] = []
    if 0 < toxic < total:
        def select(counts, least, most):
            counts = counts.withColumn("ratio", _ratio(F.col("t"), F.col("n"), toxic, total - toxic))
            rows = counts.filter((F.col("n") >= 2) & (2 * F.col("t") > F.col("n")) & (F.col("ratio") >= least))
            return [r.term for r in rows.orderBy(F.desc("ratio"), "term").limit(most).collect()]

        first = _words(texts, None).groupBy("term").agg(F.sum("_label").alias("t"), F.count(F.lit(1)).alias("n"))
        candidates = select(first, LEAST_FIRST, 8 * TERMS)
        second = _words(texts, candidates).groupBy("term", "context").agg(F.max("_label").alias("_label"))
        second = second.groupBy("term").agg(F.sum("_label").alias("t"), F.count(F.lit(1)).alias("n"))
        chosen = select(second, LEAST_RATIO, TERMS)
    index = _build(texts, chosen, int(toxic), int(total))
    index.copies = _copies(texts) if toxic else None
    return index


def _copies(texts: DataFrame) -> Copies:
    """The examples are counted, numbered and packed in tasks; the driver gets the distinct words and packed blocks."""

    def lists(parts: list[np.ndarray], kind: str) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, parts)]).astype("int32")
        return pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, kind), *parts]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            found = [_hashed(words_of(t)) for t in part.column("_text").to_pylist()]
            words, counts = lists([h for h, _ in found], "int64"), lists([c for _, c in found], "int32")
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("_label"), words, counts], names=["id", "label", "words", "counts"]
            )

    rows = texts.select("_id", "_text", F.col("_label").cast("int").alias("_label"))
    rows = rows.mapInArrow(count, "id long, label int, words array<long>, counts array<int>")
    rows = written(rows.filter(F.size("words") > 0), "counted")
    # In the order in which documents are sampled, as many as have WORDS words in all.
    sizes = rows.select("id", F.size("words").alias("n")).orderBy(F.xxhash64("id"), "id").toArrow()
    fits = np.cumsum(sizes.column("n").to_numpy()) <= WORDS
    if not fits.all():
        last = sizes.column("id").to_numpy()[: int(fits.sum())]
        rows = rows.join(F.broadcast(texts.sparkSession.createDataFrame(pd.DataFrame({"id": last}))), "id", "left_semi")
    used = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).cast("int").alias("n")).toArrow()
    order = np.argsort(used.column("word").to_numpy())
    words = used.column("word").to_numpy()[order]
    numbers = texts.sparkSession.sparkContext.broadcast(words)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("words").flatten().to_numpy()
            sizes = np.diff(batch.column("words").offsets.to_numpy())
            number = np.searchsorted(numbers.value, hashes).astype("int32")
            steps = zlib.compress(np.diff(number, prepend=np.int32(0)).tobytes(), 1)
            counts = zlib.compress(batch.column("counts").flatten().to_numpy().tobytes(), 1)
            longs = [batch.column("id").to_pylist(), batch.column("label").to_pylist(), sizes.tolist()]
            columns = [pa.array([x], pa.list_(pa.int64())) for x in longs] + [pa.array([x], pa.binary()) for x in (steps, counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "size", "steps", "counts"])

    schema = "id array<long>, label array<long>, size array<long>, steps binary, counts binary"
    blocks = rows.mapInArrow(pack, schema).toArrow()
    blocks = blocks.take(np.argsort([b[0] for b in blocks.column("id").to_pylist()], kind="stable"))

    def joined(name: str, kind: str) -> np.ndarray:
        return np.fromiter((x for b in blocks.column(name).to_pylist() for x in b), dtype=kind)

    return Copies(
        words,
        used.column("n").to_numpy()[order],
        joined("id", "int64"),
        joined("label", "float64"),
        np.append(0, np.cumsum(joined("size", "int64"))),
        list(zip(blocks.column("steps").to_pylist(), blocks.column("counts").to_pylist())),
    )


def _build(texts: DataFrame, chosen: list[str], toxic: int, total: int) -> Index:
    number = {w: k for k, w in enumerate(sorted(chosen))}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                _count(words_of(t), number)
                for t in batch.column("_text").to_pylist()
            ]
            keep = pa.array([bool(c) for c in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").filter(keep),
                    batch.column("_label").filter(keep),
                    pa.array([sorted(c) for c in found if c], pa.list_(pa.int32())),
                    pa.array([[c[k] for k in sorted(c)] for c in found if c], pa.list_(pa.int32())),
                ],
                names=["id", "label", "terms", "counts"],
            )

    rows = texts.select("_id", "_text", F.col("_label").cast("int").alias("_label")).mapInArrow(
        count, "id long, label int, terms array<int>, counts array<int>"
    )
    rows = sorted(rows.collect(), key=lambda r: (r.label, r.terms, r.id))
    ids = np.array([r.id for r in rows], dtype="int64")
    labels = np.array([r.label for r in rows], dtype="float64")
    # Examples without any term: their rate is the score of such documents.
    left_toxic, left = toxic - labels.sum(), total - len(rows)
    none = float(left_toxic / (left + 1))
    width, blocks = len(number), -(-len(rows) // BLOCK)
    term = np.array([t for r in rows for t in r.terms], dtype="int64")
    row = np.repeat(np.arange(len(rows)), [len(r.terms) for r in rows])
    used = np.bincount(term, minlength=width)
    idf = np.log((1 + total) / (1 + used)) + 1
    weight = (1 + np.log(np.array([c for r in rows for c in r.counts], dtype="float64"))) * idf[term]
    length = np.sqrt(np.bincount(row, weight * weight, minlength=len(rows)))
    weight = weight / length[row]
    order = np.lexsort((row, term))
    term, row, weight = term[order], row[order], weight[order]
    place = term * blocks + row // BLOCK
    begin = np.searchsorted(place, np.arange(width * blocks + 1))
    highest = np.zeros(width * blocks)
    np.maximum.at(highest, place, weight)
    ends = begin.reshape(-1)
    index = Index(
        number,
        idf,
        ids,
        labels,
        highest.reshape(width, blocks),
        np.stack([ends[t * blocks : (t + 1) * blocks + 1] for t in range(width)]) if width else np.empty((0, 1), dtype="int64"),
        row,
        weight,
        none,
    )
    votes = []
    by_row = np.lexsort((term, row))
    cuts = np.searchsorted(row[by_row], np.arange(len(rows) + 1))
    for k in range(len(rows)):
        own = by_row[cuts[k] : cuts[k + 1]]
        found, cosines = index.nearest(term[own], weight[own], skip=k)
        votes.append(index.vote(found, cosines))
    if rows:
        index.slope, index.shift = _calibrate(np.array(votes), labels)
    return index


def score(docs: DataFrame, index: Index, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``score`` (0 to 1), and as evidence ``neighbours`` and ``cosines``, one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = T.StructType(
        [
            T.StructField("score", T.DoubleType(), False),
            T.StructField("neighbours", T.ArrayType(T.LongType()), False),
            T.StructField("cosines", T.ArrayType(T.DoubleType()), False),
        ]
    )
    found = F.udf(lambda t: shared.value.score(t), schema, useArrow=False).asNondeterministic()
    return docs.select(docs[key], found(docs[text]).alias("_found")).select(key, "_found.*")


def keep_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold."""
    index = train(docs, labels, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    scored = F.udf(lambda t: shared.value.score(t)[0], T.DoubleType(), useArrow=False).asNondeterministic()
    return docs.filter(scored(docs[text]) < THRESHOLD)


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """Batches of few texts for the jobs that run inside: whole texts in Spark's usual 10,000 rows
    fill an executor with buffers. Documents to score go to Python as plain rows, a hundred at a time."""
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(min(500, int(before)) if int(before) > 0 else 500))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that a task holds few texts beside its index."""
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
