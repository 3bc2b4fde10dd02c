"""Mixing sources to target weights by weighted fair queueing.

Sources weigh ``WEIGHTS`` in turn, by name in code-point order (null last), and
share ``BUDGET`` times all words; no source is asked for more than ``REPEATS``
times its words, the excess being shared by weight among the others. Documents of a
source queue in an order shuffled by hash, once per repeat. The virtual finish
time of a copy is the source's words up to its end over the source's target. All
copies are sorted globally by it and cut off at the total budget; the copy a source
is serving at time one is cut where its target is reached, so every source takes
its target to the word.

Shares come from running sums over the sources in order of the time at which
they would be exhausted: the water level is the largest of (budget - words of
the first k) / (weight of the rest).

Defined results: null and empty texts have no words and are never taken; a null
source is a source; without words every target is zero; repeated rows are separate
entries of the queue. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm.common import WORD, with_text
from linkloom.llm.prefix import running_sums
from linkloom.session import written

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
REPEATS = 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``."""
    totals = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    totals = totals.withColumn("_null", F.col("source").isNull())
    ranked = running_sums(totals, [], ["_null", "source"], {"_rank": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("_rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumns({"_weight": weight, "_full": (REPEATS * F.col("source_size")).cast("double")})
    ranked = written(ranked.withColumn("_time", F.col("_full") / F.col("_weight")), "weights")
    budget, weights = ranked.agg(F.sum("source_size"), F.sum("_weight")).first()
    budget = BUDGET * (budget or 0)
    sums = running_sums(
        ranked, [], ["_time", "_rank"], {"_words": F.col("_full"), "_weights": F.col("_weight")}
    )
    levels = sums.filter(F.col("_weights") < (weights or 0)).agg(
        F.max((F.lit(budget) - F.col("_words")) / (F.lit(weights) - F.col("_weights")))
    )
    level = max(levels.first()[0] or 0.0, budget / weights if weights else 0.0)
    target = F.least("_full", F.lit(level) * F.col("_weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def schedule(sized: DataFrame, seed: str = "mix") -> DataFrame:
    """The queue: rows of ``sized`` per copy with ``source_size, target, copy, finish``,
    ``mix_start`` (words of the mix before it) and ``taken`` (words the mix takes).
    """
    by = ["_id", "_row"]
    shuffled = F.md5(F.concat_ws(" ", F.lit(seed), F.col("_id").cast("string")).cast("binary"))
    queue = running_sums(
        sized.withColumn("_order", shuffled), ["source"], ["_order", *by], {"_end": F.col("size")}
    )
    goals = targets(sized).withColumnRenamed("source", "_source")
    queue = queue.join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    copies = queue.filter("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    end = F.col("copy") * F.col("source_size") + F.col("_end")
    copies = copies.withColumns({"_stop": end, "finish": end / F.col("target")})
    served = F.least(F.col("size"), F.floor(F.col("target") - F.col("_stop") + F.col("size")))
    # A copy whose turn comes after its source's target is no part of the mix.
    copies = copies.withColumn("_served", served).filter("_served > 0")
    mixed = running_sums(copies, [], ["finish", "_order", *by, "copy"], {"_until": F.col("_served")})
    budget = _budget(sized)
    start = F.col("_until") - F.col("_served")
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("_served"), F.lit(budget) - start))
    return mixed.withColumns({"mix_start": start, "taken": taken}).drop("_order", "_end", "_stop", "_served", "_until")


def _budget(sized: DataFrame) -> int:
    return int(BUDGET * (sized.agg(F.sum("size")).first()[0] or 0))


def _names(docs: DataFrame, key: str, text: str, source: str) -> list[Column]:
    """Two 64-bit hashes of key, source and text, nulls told apart."""
    parts = [docs[key], docs[key].isNull(), docs[source], docs[source].isNull(), docs[text]]
    return [F.xxhash64(*parts).alias("_k"), F.xxhash64(F.lit("2"), *reversed(parts)).alias("_k2")]


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``_id, source, size`` of every row, ``_k, _k2``, which name it by key, source
    and text, and a number ``_row``, written so that it stays."""
    return written(
        docs.select(
            docs[key].alias("_id"),
            *_names(docs, key, text, source),
            docs[source].alias("source"),
            n_words(docs[text]).alias("size"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "sizes",
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, once per copy.

    Of a copy that is cut the first words stay, joined by single spaces, and
    ``n_chars`` follows. Rows with the same key, source and text are taken as one
    document as often as their entries of the queue are.
    """
    takes = schedule(sizes(docs, key, text, source)).filter("taken > 0")
    takes = takes.groupBy("_k", "_k2", "copy", "taken", "size").agg(F.count(F.lit(1)).alias("_times"))
    # One row per name, numbered in the shuffle that the join needs as well.
    same = W.partitionBy("_k", "_k2").orderBy(F.lit(0))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *_names(docs, key, text, source))
    rows = rows.withColumn("_nth", F.row_number().over(same)).filter("_nth = 1")
    out = rows.join(takes, ["_k", "_k2"]).withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    own = F.col("doc")[text]
    cut = F.array_join(F.slice(F.regexp_extract_all(own, F.lit(WORD), F.lit(0)), 1, F.col("taken").cast("int")), " ")
    return with_text(out, docs.schema, text, F.when(F.col("taken") < F.col("size"), cut).otherwise(own))
