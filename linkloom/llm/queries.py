"""The queries of this folder's operators over the given tables, and their SQL twins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import (
    bpe, centroids, codes, fingerprints, html_text, licenses, mixing, pieces, quality, simhash, substrings, suffixes, toxicity,
)
from linkloom.llm.common import table
from linkloom.llm.vectors import decimals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


@query
def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Measures and verdict of every document."""
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
    judged = quality.judged(documents(spark, sf))
    return judged.select("doc_id", *names, "base_failed", "kept", F.array_join("failed", " ").alias("failed"))


ORACLE["op1_quality"] = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, t, w, l,
    list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g
  FROM cut),
spots AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS n
  FROM (SELECT doc_id, unnest(g) AS v, unnest(range(1, len(g) + 1)) AS i FROM windows)),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM spots, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id),
measured AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(l) AS n_lines,
    len(list_filter(w, lambda x: list_contains(STOP_WORDS, lower(x)))) AS n_stop_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_letter_words,
    len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullet_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_cut_lines
  FROM windows d LEFT JOIN covered c ON c.doc_id = d.doc_id),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    list_filter([
      CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 'word_length' END,
      CASE WHEN n_symbols > 0.1::DOUBLE * n_words THEN 'symbols' END,
      CASE WHEN n_stop_words < 2 THEN 'stop_words' END,
      CASE WHEN n_letter_words < 0.7::DOUBLE * n_words THEN 'no_letters' END,
      CASE WHEN n_dup_lines > 0.5::DOUBLE * n_lines THEN 'repeated_lines' END,
      CASE WHEN n_bullet_lines > 0.9::DOUBLE * n_lines THEN 'bullets' END,
      CASE WHEN n_cut_lines > 0.3::DOUBLE * n_lines THEN 'cut_lines' END], lambda x: x IS NOT NULL) AS f
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND len(f) = 0 AS kept, array_to_string(f, ' ') AS failed
FROM judged
""".replace("STOP_WORDS", str(list(quality.STOP_WORDS)))


@query
def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each document that the mix takes."""
    sized = mixing.sizes(documents(spark, sf))
    goals = mixing.targets(sized).withColumnRenamed("source", "_source")
    taken = mixing.schedule(sized).groupBy("_row").agg(F.sum("taken").alias("taken"))
    return (
        sized.join(goals, F.col("source").eqNullSafe(F.col("_source")))
        .join(taken, "_row", "left")
        .select(
            F.col("_id").alias("doc_id"),
            "size",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )


ORACLE["op2_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, k, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM totals)),
sums AS (
  SELECT sum(2.0::DOUBLE * source_size) OVER o AS full_words, sum(weight) OVER o AS weights
  FROM ranked WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, k ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT 1.5::DOUBLE * sum(source_size) AS budget, sum(weight) AS weights FROM ranked),
level AS (
  SELECT greatest(
    (SELECT max((w.budget - s.full_words) / (w.weights - s.weights)) FROM sums s WHERE s.weights < w.weights),
    w.budget / w.weights) AS x
  FROM whole w),
goals AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, x * weight) AS target FROM ranked, level),
queue AS (
  SELECT doc_id, size, source_size, target,
    sum(size) OVER (PARTITION BY s.source ORDER BY md5('mix ' || doc_id), doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS last
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
served AS (
  SELECT doc_id, size, source_size, target,
    greatest(0, least(size, floor(target - last + size)))
    + greatest(0, least(size, floor(target - source_size - last + size))) AS taken
  FROM queue)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken FROM served
"""


@query
def op3_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.compared(documents(spark, sf))


@query
def op4_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """Licence notices of every document."""
    docs = documents(spark, sf)
    found = licenses.scan(docs, licenses.train(docs))
    families = F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["family"])))
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("notices").cast("long").alias("n_notices"),
        F.array_join(families, " ").alias("families"),
        F.coalesce(F.array_max(F.transform("notices", lambda n: n["probability"])), F.lit(0.0)).alias("probability"),
        "notices",
    )


@query
def op5_html(spark: SparkSession, sf: str) -> DataFrame:
    """The article of every page."""
    pages = table(spark, sf, "pages")
    found = pages.select("page_id", "url", html_text.main_text(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op6_substrings(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated passages removed from each document, first copies kept."""
    out = substrings.dedup(documents(spark, sf))
    spans = F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>"))
    total = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return out.select(
        "doc.doc_id",
        F.coalesce(F.octet_length("doc.text"), F.lit(0)).cast("long").alias("n_bytes"),
        total.alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
        F.coalesce("n_repeated", F.lit(0)).cast("long").alias("n_repeated"),
        F.coalesce("first_ids", F.array().cast("array<long>")).alias("first_ids"),
    )


@query
def op7_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes inside strings of 200 that occur twice removed from each document."""
    out = suffixes.remove(documents(spark, sf))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return out.select(
        "doc_id",
        "n_bytes",
        total.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Every text encoded with a public vocabulary and decoded again."""
    path = public_tokenizers.path(RANKS)
    return digests(bpe.encode(documents(spark, sf), path, public_tokenizers.PATTERN, decoded=True))


def digests(decoded: DataFrame) -> DataFrame:
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(documents(spark, sf))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Score and evidence of every document."""
    docs = documents(spark, sf)
    index = toxicity.train(docs, table(spark, sf, "labels"))
    scored = toxicity.score(docs, index)
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.held_out("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "neighbours",
        "cosines",
    )


def sha256(numbers) -> str:
    return hashlib.sha256(decimals(numbers).encode()).hexdigest()


@query
def op11_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster of every vector, and how far the clusters spread."""
    found = centroids.clusters(table(spark, sf, "embeddings"))
    # One row per centroid at most, so both can be collected and broadcast.
    sums = {r.cluster: r.n for r in found.members.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    total = sum(sums.values())
    facts = spark.createDataFrame(
        [(k, n, total, sha256(found.centroids[k])) for k, n in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.members.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


@query
def op12_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Every text encoded with a public merge-type vocabulary and decoded again."""
    return digests(pieces.encode(documents(spark, sf), public_tokenizers.path(PIECES), decoded=True))


@query
def op13_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Short codes of all vectors, with their errors."""
    found = codes.compress(table(spark, sf, "embeddings"), carry=("label",))
    by_label = found.members.groupBy("label").agg(F.sum("error").alias("label_error"))
    by_label = by_label.withColumnRenamed("label", "_label")
    return found.members.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(sha256(found.codebooks)).alias("codebooks_sha256"),
    )
