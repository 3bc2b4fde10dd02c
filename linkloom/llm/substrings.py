"""Substring dedup by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are cut where the gear hash of the last 32 bytes has
``BITS`` leading zeros, at least ``SMALLEST`` bytes after the last cut (and at
``LARGEST`` at the latest), moved to the start of a character. Cuts depend on
content only, so an insertion shifts chunks without changing them. A chunk whose
digest occurs earlier, in order of key, row hash and position, is a repeat. A run of
adjoining repeats is extended byte by byte, whole characters only, as long as the bytes
before its first chunk (after its last one) equal those beside that chunk's first copy,
so the chunks that straddle the edges of a passage are not lost. Runs that then meet are
one; those of at least ``LEAST_RUN`` bytes are removed, and the first copy stays: an
extended byte's copy lies beside an earlier chunk, so copies never lead back in a circle.

Digests are counted with map-side combining and only chunks of digests that
occur twice are looked at again, in a join that can be split on frequent digests.
Edges are compared by the ``CONTEXT`` bytes beside them, fetched once per place however
many runs lead there; an edge equal over all of them goes on with twice as many. That ends,
as equal bytes are cut alike soon, and within ``LARGEST`` bytes at the latest.

Defined results: null and empty texts have no chunks and stay as they are; rows
with the same key and text count as one document and come out alike; texts of any
length are cut in one pass; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import row_key, with_text
from linkloom.session import written

BITS, SMALLEST, LARGEST = 5, 16, 4_096
LEAST_RUN = 100
# Bytes compared beside each edge of a run in the first round.
CONTEXT = 160


def _gear() -> np.ndarray:
    """A random 32-bit number for each byte value."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], dtype="uint32")


_GEAR = _gear()


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``, the last being its length."""
    if not data:
        return []
    raw = np.frombuffer(data, dtype="uint8")
    h = _GEAR[raw]
    # After k doublings h holds the gear hash of the last 2**k bytes; older bytes
    # have been shifted out of the 32 bits after the fifth.
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    places = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    out, last, size = [], 0, len(data)
    for at in [*places.tolist(), size]:
        while at - last > LARGEST:
            last = _next_character(data, last + LARGEST)
            out.append(last)
        if at - last >= SMALLEST:
            at = _next_character(data, at)
            if at > last:
                out.append(at)
                last = at
    if last < size:
        out.append(size)
    return out


def _next_character(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _chunker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes = batch.column("_id"), batch.column("_hash")
        rows, begins, lengths, digests = [], [], [], []
        for row, text in enumerate(batch.column("_text").to_pylist()):
            data = text.encode() if text else b""
            begin = 0
            for end in cuts(data):
                rows.append(row)
                begins.append(begin)
                lengths.append(end - begin)
                digests.append(xxhash.xxh3_64_intdigest(data[begin:end]))
                begin = end
            if len(rows) >= 200_000:
                yield _chunk_batch(ids, hashes, rows, begins, lengths, digests)
                rows, begins, lengths, digests = [], [], [], []
        if rows:
            yield _chunk_batch(ids, hashes, rows, begins, lengths, digests)


def _chunk_batch(ids, hashes, rows, begins, lengths, digests) -> pa.RecordBatch:
    at = pa.array(rows, pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            ids.take(at),
            hashes.take(at),
            pa.array(begins, pa.int32()),
            pa.array(lengths, pa.int32()),
            pa.array(np.array(digests, dtype="uint64").view("int64")),
        ],
        names=["_id", "_hash", "_begin", "_length", "_digest"],
    )


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The chunks of every distinct (key, text): ``_id, _hash, _begin, _length, _digest``."""
    texts = docs.select(*row_key(key, text), F.col(text).alias("_text"))
    kind = docs.schema[key].dataType.simpleString()
    return texts.mapInArrow(_chunker, f"_id {kind}, _hash long, _begin int, _length int, _digest long")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of repeated chunks: ``_id, _hash``, ``spans`` (begin, end) of the runs to
    remove, ``n_repeated`` bytes in runs of chunks that occur elsewhere, this document's
    first copies included, and ``first_ids`` where the removed chunks occur first."""
    found = chunks(docs, key, text)
    twice = found.groupBy("_digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_digest")
    # Written, here and below, so that the join can be split on a digest that very many chunks share.
    twice = written(twice, "twice")
    found = written(found.join(twice, "_digest", "left_semi"), "chunks")
    place = F.struct("_id", "_hash", "_begin")
    first = found.groupBy("_digest").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    first = first.filter(~F.col("_first").eqNullSafe(F.col("_last"))).drop("_last")
    marked = found.join(written(first, "firsts"), "_digest").select(
        "_id",
        "_hash",
        "_begin",
        (F.col("_begin") + F.col("_length")).alias("_end"),
        (~place.eqNullSafe(F.col("_first"))).alias("_again"),
        "_first",
    )
    # A document's repeated chunks meet in one task, as its text does.
    document = W.partitionBy("_id", "_hash").orderBy("_begin")
    marked = marked.withColumn("_before", F.lag("_begin").over(document))
    marked = marked.filter(F.col("_before").isNull() | (F.col("_before") < F.col("_begin")))
    joins = F.lag("_end").over(document) == F.col("_begin")
    follows = joins & F.lag("_again").over(document) & F.col("_again")
    marked = marked.withColumns({"_new": F.coalesce(~joins, F.lit(True)), "_new_again": F.coalesce(~follows, F.lit(True))})
    marked = marked.withColumns(
        {
            "_run": F.sum(F.col("_new").cast("int")).over(document),
            "_run_again": F.sum(F.col("_new_again").cast("int")).over(document),
        }
    )
    runs = marked.groupBy("_id", "_hash", "_run", "_run_again").agg(
        F.min("_begin").alias("_begin"),
        F.max("_end").alias("_end"),
        F.min(F.struct("_begin", "_first", "_end", "_again")).alias("_head"),
        F.max(F.struct("_begin", "_first", "_end")).alias("_tail"),
        F.collect_set(F.when(F.col("_again"), F.col("_first._id"))).alias("_first_ids"),
    )
    runs = written(runs, "runs")
    long = runs.groupBy("_id", "_hash", "_run").agg((F.max("_end") - F.min("_begin")).alias("n"))
    long = long.filter(F.col("n") >= LEAST_RUN).groupBy("_id", "_hash").agg(F.sum("n").alias("_n"))
    grown = _grown(runs.filter("_head._again"), docs, key, text)
    return (
        _merged(grown)
        .select("_id", "_hash", "spans", "first_ids", F.lit(0).cast("long").alias("_n"))
        .unionByName(long, allowMissingColumns=True)
        .groupBy("_id", "_hash")
        .agg(
            F.coalesce(F.max("spans"), F.array().cast("array<struct<begin:int,end:int>>")).alias("spans"),
            F.sum("_n").alias("n_repeated"),
            F.coalesce(F.max("first_ids"), F.array()).alias("first_ids"),
        )
    )


def _grown(runs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_id, _hash, _begin, _end, _first_ids`` of the ``runs``, extended at both edges."""
    texts = docs.select(*row_key(key, text), F.col(text).cast("binary").alias("_data"))

    def edge(left: bool, at: str, first: str, beside) -> Column:
        return F.struct(
            F.lit(left).alias("left"),
            F.col(at).alias("at"),
            F.col(f"{first}._first._id").alias("from_id"),
            F.col(f"{first}._first._hash").alias("from_hash"),
            (F.col(f"{first}._first._begin") + beside).alias("from_at"),
        )

    length = F.col("_tail._end") - F.col("_tail._begin")
    both = F.array(edge(True, "_begin", "_head", F.lit(0)), edge(False, "_end", "_tail", length))
    edges = runs.select("_id", "_hash", "_run_again", F.explode(both).alias("edge")).select(
        "_id", "_hash", "_run_again", "edge.*"
    )
    rounds, width = [], CONTEXT
    while not rounds or not edges.isEmpty():
        rounds.append(written(_compared(edges, texts, width), "edges"))
        edges = rounds[-1].filter("further").drop("further")
        width *= 2
    every = reduce(DataFrame.unionByName, rounds).select("_id", "_hash", "_run_again", "left", "at")
    every = every.unionByName(runs.select("_id", "_hash", "_run_again", "_first_ids"), allowMissingColumns=True)
    return every.groupBy("_id", "_hash", "_run_again").agg(
        F.min(F.when(F.col("left"), F.col("at"))).alias("_begin"),
        F.max(F.when(~F.col("left"), F.col("at"))).alias("_end"),
        F.max("_first_ids").alias("_first_ids"),
    )


def _compared(edges: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The ``edges`` moved by as many of ``width`` bytes as are equal, and whether to go ``further``."""
    places = edges.select("_id", "_hash", F.struct("at", "left").alias("place")).union(
        edges.select("from_id", "from_hash", F.struct("from_at", "left"))
    )
    places = places.groupBy(F.col("_id").alias("_pid"), F.col("_hash").alias("_phash")).agg(
        F.collect_set("place").alias("places")
    )

    def beside(place) -> Column:
        begin = F.when(place["left"], F.greatest(place["at"] - width, F.lit(0))).otherwise(place["at"])
        count = F.when(place["left"], place["at"] - begin).otherwise(F.lit(width))
        return F.struct(
            place["at"].alias("_pat"), place["left"].alias("_pleft"), F.substring("_data", begin + 1, count).alias("bytes")
        )

    same = F.col("_id").eqNullSafe(F.col("_pid")) & (F.col("_hash") == F.col("_phash"))
    context = texts.join(places, same).select("_pid", "_phash", F.explode(F.transform("places", beside)).alias("c"))
    # Repeated rows give the same bytes again.
    context = context.select("_pid", "_phash", "c.*").dropDuplicates(["_pid", "_phash", "_pat", "_pleft"])
    context = written(context, "contexts")

    def fetch(rows: DataFrame, prefix: str, key: str, row: str, at: str) -> DataFrame:
        there = (
            F.col(key).eqNullSafe(F.col("_pid"))
            & (F.col(row) == F.col("_phash"))
            & (F.col(at) == F.col("_pat"))
            & (F.col("left") == F.col("_pleft"))
        )
        return rows.join(context, there).withColumn(prefix, F.col("bytes")).drop(*context.columns)

    rows = fetch(edges, "_own", "_id", "_hash", "at")
    rows = fetch(rows, "_from", "from_id", "from_hash", "from_at")
    names = edges.columns

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = batch.column("left").to_pylist()
            pairs = zip(batch.column("_own").to_pylist(), batch.column("_from").to_pylist(), left)
            equal = [_equal(own, other, side) for own, other, side in pairs]
            step = pa.array([-characters if side else characters for (_, characters), side in zip(equal, left)], pa.int32())
            moved = {"at": pc.add(batch.column("at"), step), "from_at": pc.add(batch.column("from_at"), step)}
            columns = [moved.get(n, batch.column(n)) for n in names]
            further = pa.array([n == width for n, _ in equal], pa.bool_())
            yield pa.RecordBatch.from_arrays([*columns, further], names=[*names, "further"])

    return rows.mapInArrow(compare, T.StructType([*edges.schema.fields, T.StructField("further", T.BooleanType())]))


def _equal(own: bytes, other: bytes, left: bool) -> tuple[int, int]:
    """How many bytes next to an edge are equal, and how many of them are whole characters."""
    if left:
        n = len(commonprefix([own[::-1], other[::-1]]))
        whole = n
        while whole and own[-whole] & 0xC0 == 0x80:
            whole -= 1
        return n, whole
    n = len(commonprefix([own, other]))
    return n, len(own[:n].decode("utf-8", "ignore").encode())


def _merged(runs: DataFrame) -> DataFrame:
    """``_id, _hash, spans, first_ids``: runs that overlap or meet as one, if long enough."""
    document = W.partitionBy("_id", "_hash").orderBy("_begin", "_end")
    before = F.max("_end").over(document.rowsBetween(W.unboundedPreceding, -1))
    apart = F.coalesce(F.col("_begin") > before, F.lit(True)).cast("int")
    runs = runs.withColumn("_apart", apart)
    runs = runs.withColumn("_group", F.sum("_apart").over(document.rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.groupBy("_id", "_hash", "_group").agg(
        F.min("_begin").alias("begin"), F.max("_end").alias("end"), F.flatten(F.collect_list("_first_ids")).alias("ids")
    )
    spans = spans.filter(F.col("end") - F.col("begin") >= LEAST_RUN)
    return spans.groupBy("_id", "_hash").agg(
        F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("first_ids"),
    )


def kept_text(text: Column, spans: Column) -> Column:
    """``text`` without the byte ``spans``, which are sorted and disjoint."""
    data = text.cast("binary")
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["begin"]), F.array(F.octet_length(text)))
    parts = F.zip_with(begins, ends, lambda b, e: F.substring(data, b + 1, e - b).cast("string"))
    return F.array_join(parts, "")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, the whole row of ``docs``, with ``kept``, the text without repeats, the
    ``spans`` removed (bytes), ``n_repeated`` and ``first_ids``."""
    found = repeats(docs, key, text).select(
        F.col("_id").alias("_rid"), F.col("_hash").alias("_rhash"), "spans", "n_repeated", "first_ids"
    )
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *row_key(key, text))
    same = F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_hash") == F.col("_rhash"))
    own = F.col("doc")[text]
    kept = F.when(F.size("spans") > 0, kept_text(own, F.col("spans"))).otherwise(own)
    return rows.join(found, same, "left").select("doc", kept.alias("kept"), "spans", "n_repeated", "first_ids")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeats removed from their texts; ``n_chars`` follows the text."""
    return with_text(dedup(docs, key, text), docs.schema, text, F.col("kept"))
