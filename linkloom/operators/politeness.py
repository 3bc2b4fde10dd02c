"""When requests may start, and when robots.txt has to be fetched again."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.running import WINDOW_ROWS, largest_group, running
from linkloom.session import written

LOG_SCHEMA = "domain STRING, seq BIGINT, arrival TIMESTAMP"

# Seconds a robots.txt stays fresh, default delay in seconds.
ROBOTS_TTL = 3600
DEFAULT_DELAY = 1.0


def politeness_schedule(
    request_log: DataFrame,
    delays: DataFrame,
    default_delay: float = DEFAULT_DELAY,
    window_rows: int | None = None,
) -> DataFrame:
    """Add ``start_at`` and ``wait_seconds`` to ``(domain, seq, arrival)``.

    Where both tables have a ``crawl_id`` every crawl keeps its own times, as
    delays are settings of a crawl. Without it a domain has one queue, and the
    longest delay stated for it holds.

    The first request of a domain starts at once, each later one at its arrival
    or one delay after the previous start, whichever is later. With ``i`` the
    number of earlier requests that is ``i*d + max(arrival_j - j*d)`` over the
    requests up to this one: a running count and a running maximum, which
    ``running`` also spreads when one domain holds most of the log. Works in
    whole microseconds.
    """
    delay = F.round(F.coalesce("delay", F.lit(default_delay)) * 1_000_000).cast("bigint")
    both = "crawl_id" in request_log.columns and "crawl_id" in delays.columns
    keys = ["crawl_id", "domain"] if both else ["domain"]
    stated = delays.groupBy(*keys).agg(F.max("delay").alias("delay"))
    log = request_log.join(stated, keys, "left").select(
        *keys,
        "seq",
        "arrival",
        F.unix_micros("arrival").alias("_at"),
        delay.alias("_delay"),
    )
    order = ["_at", "seq"]
    size = {"largest": largest_group(request_log, keys), "window_rows": window_rows}
    counted = running(log, keys, order, {"_i": ("sum", F.lit(1))}, before=True, **size)
    slack = F.col("_at") - F.col("_i") * F.col("_delay")
    peaks = running(counted, keys, order, {"_peak": ("max", slack)}, **size)
    start = F.col("_peak") + F.col("_i") * F.col("_delay")
    return peaks.select(
        *keys,
        "seq",
        "arrival",
        F.timestamp_micros(start).alias("start_at"),
        ((start - F.col("_at")) / 1_000_000).alias("wait_seconds"),
    )


def robots_fetch_plan(
    request_log: DataFrame, ttl: int = ROBOTS_TTL, window_rows: int | None = None
) -> DataFrame:
    """Add ``fetches``: does this request fetch robots.txt?

    A request fetches when nothing is cached or the last fetch is ``ttl`` or
    more old. Equal arrivals are one point in time, where the smallest ``seq``
    fetches. Without caching (``ttl`` of 0 or less) every request does. A null domain
    is a domain of its own.

    The points of a domain lie in one or more chunks, each in one task. A chunk is a map: the time of the
    last fetch before it goes in, that of its own last fetch comes out. The first pass
    works these maps out, whatever goes in. They are composed over the chunks of a domain; the second
    pass then marks the fetches of the later chunks, whose inputs are known by now. A
    domain that one window task may hold is one chunk, and the first pass is all.
    """
    if ttl <= 0:
        return request_log.withColumn("fetches", F.lit(True))
    limit = WINDOW_ROWS if window_rows is None else window_rows
    whole = limit > 0 and largest_group(request_log, ["domain"]) <= limit
    step = ttl * 1_000_000
    points = request_log.groupBy("domain", F.unix_micros("arrival").alias("at")).agg(F.min("seq").alias("seq"))
    points = points.repartition("domain") if whole else points.repartitionByRange("domain", "at")
    chains = _chains(points.withColumn("chunk", F.spark_partition_id()), step)
    if whole:
        fetches = chains.filter("first")
    else:
        chains = written(chains, "chains")
        fetches = _across_chunks(chains, step)
    hits = fetches.select(F.col("domain").alias("_domain"), F.col("seq").alias("_seq"))
    hit = F.col("domain").eqNullSafe(F.col("_domain")) & (F.col("seq") == F.col("_seq"))
    return request_log.join(hits, hit, "left").select(*request_log.columns, F.col("_seq").isNotNull().alias("fetches"))


_CHAIN_SCHEMA = "domain string, chunk int, at long, seq long, first boolean, entry boolean, last long"


def _chains(points: DataFrame, step: int) -> DataFrame:
    """``(domain, chunk, at, seq, first, entry, last)`` of every point: whether a chain of fetches from
    the chunk's first point meets it, whether a chain from an earlier chunk may enter at it (a fetch
    before the chunk has expired one ``step`` after its first point), and the last fetch of
    the chain that starts at it."""

    def follow(at: np.ndarray) -> tuple[np.ndarray, ...]:
        following = np.searchsorted(at, at + step).tolist()
        last, n = list(range(len(at))), len(at)
        # From the end, so that the chain of what follows is known.
        for k in range(n - 1, -1, -1):
            if following[k] < n:
                last[k] = last[following[k]]
        first = np.zeros(n, dtype=bool)
        k = 0
        while k < n:
            first[k] = True
            k = following[k]
        entry = np.arange(n) <= np.searchsorted(at, at[0] + step)
        return first, entry, at[last]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task holds the times of its points, which the partitioning bounds.
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        domains = table.column("domain").combine_chunks().dictionary_encode(null_encoding="encode").indices
        at = table.column("at").to_numpy()
        chunks = table.column("chunk").to_numpy()
        begins = np.flatnonzero((np.diff(domains.to_numpy(), prepend=-1) != 0) | (np.diff(chunks, prepend=-1) != 0))
        found = [follow(at[a:b]) for a, b in pairwise([*begins.tolist(), len(at)])]
        table = table.select(["domain", "chunk", "at", "seq"])
        for name, parts in zip(("first", "entry", "last"), zip(*found)):
            table = table.append_column(name, pa.array(np.concatenate(parts)))
        yield from table.to_batches(max_chunksize=10_000)

    points = points.select("domain", "chunk", "at", "seq").sortWithinPartitions("domain", "at")
    return points.mapInArrow(work, _CHAIN_SCHEMA)


def _across_chunks(chains: DataFrame, step: int) -> DataFrame:
    """``(domain, seq)`` of the fetches of domains that may lie in several chunks."""
    spans = chains.groupBy("domain", "chunk").agg(F.min("at").alias("begins"))
    starts = spans.groupBy("domain").agg(F.min("chunk").alias("chunk"), F.count(F.lit(1)).alias("n_chunks"))
    starts = written(starts, "starts")
    same = F.col("domain").eqNullSafe(F.col("_domain"))
    begun = starts.select(F.col("domain").alias("_domain"), F.col("chunk").alias("_chunk"), "n_chunks")
    placed = chains.join(begun, same)
    # A first chunk has nothing before it, so its own first chain holds.
    known = placed.filter("chunk = _chunk AND first").select("domain", "seq")
    split = begun.filter("n_chunks > 1")
    if split.isEmpty():
        return known
    later = placed.filter("n_chunks > 1")
    exits = _exits(later, step)
    # What goes into a chunk: the latest fetch before it begins. At most one row per chunk.
    entries = spans.join(split, same).select(
        "domain", F.col("begins").alias("when"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("exit"), "chunk"
    )
    ends = exits.select("domain", F.col("at").alias("when"), F.lit(1).alias("kind"), F.col("at").alias("exit"), F.lit(None).cast("int").alias("chunk"))
    entered = running(entries.unionByName(ends), ["domain"], ["when", "kind"], {"entered": ("max", F.col("exit"))})
    entered = entered.filter("kind = 0 AND entered IS NOT NULL")
    keyed = entered.select(F.col("domain").alias("_domain"), F.col("chunk").alias("_chunk"), "entered")
    walked = chains.join(keyed, same & (F.col("chunk") == F.col("_chunk"))).filter(F.col("at") >= F.col("entered") + step)
    walked = walked.select("domain", "chunk", "at", "seq")
    # Whole chunks, as in the first pass.
    again = _chains(walked.repartition("domain", "chunk"), step)
    return known.union(again.filter("first").select("domain", "seq"))


def _exits(chains: DataFrame, step: int) -> DataFrame:
    """``(domain, at)``: the last fetch of every chunk that has one, and of no other chunk.

    The map of a chunk has a row per point at which a chain may enter it, with the exit that it leads to.
    Over a domain, what follows an exit is the first such point at or after its expiry, and
    the exit of that. Chains over chunks are composed by doubling: the rounds grow with the
    logarithm of the number of chunks, and the rows are points that begin a chunk, not all of them.
    """
    steps = written(chains.filter("entry").select("domain", "at", "last"), "steps")
    exits = steps.select("domain", "last").distinct()
    probes = exits.select("domain", (F.col("last") + step).alias("when"), F.lit(0).alias("kind"), "last", F.lit(None).cast("bigint").alias("at"))
    marks = steps.select("domain", F.col("at").alias("when"), F.lit(1).alias("kind"), "last", "at")
    merged = probes.unionByName(marks).select("domain", (-F.col("when")).alias("r"), (-F.col("kind")).alias("k"), "last", "at")
    ahead = running(merged, ["domain"], ["r", "k"], {"enters": ("min", F.col("at"))})
    ahead = ahead.filter("k = 0 AND enters IS NOT NULL").select(F.col("domain").alias("_domain"), F.col("last").alias("_exit"), "enters")
    same = F.col("domain").eqNullSafe(F.col("_domain"))
    jumps = steps.join(ahead, same & (F.col("at") == F.col("enters")))
    jumps = written(jumps.select("domain", F.col("_exit").alias("at"), F.col("last").alias("next")), "jumps")
    origin = chains.filter("chunk = _chunk AND first").groupBy("domain").agg(F.max("at").alias("at"))
    reached = written(origin, "reached")
    while not jumps.isEmpty():
        # reached holds the first 2^k exits, jumps leads 2^k exits ahead.
        keyed = jumps.select(F.col("domain").alias("_domain"), F.col("at").alias("_at"), F.col("next").alias("_next"))
        landed = reached.join(keyed, same & (F.col("at") == F.col("_at"))).select("domain", F.col("_next").alias("at"))
        reached = written(reached.unionByName(landed), "reached")
        onward = jumps.join(keyed, same & (F.col("next") == F.col("_at")))
        jumps = written(onward.select("domain", "at", F.col("_next").alias("next")), "jumps")
    return reached
