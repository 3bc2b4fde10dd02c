"""The run store: save, list, load, find and delete crawl runs under a path.

Runs are rows of files partitioned by a hash bucket of the seed, so that looking
up seeds reads only their buckets, and listings read only their columns. Nothing
is rewritten: deleting adds tombstones. A store that nobody has written to has no
runs: nothing is found, listed or deleted in it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.session import written

_PAGE = (
    "STRUCT<url: STRING, depth: INT, status_code: INT, links_found: INT, "
    "crawled_at: {time}, error: STRING>"
)
_DOCUMENT = (
    "crawl_id BIGINT, seed_url STRING, status STRING, error STRING, total_pages INT, "
    "max_depth_reached INT, urls_visited ARRAY<STRING>, urls_failed ARRAY<STRING>, "
    "pages ARRAY<{page}>, started_at {time}, finished_at {time}, duration_seconds DOUBLE"
)
RUN_SCHEMA = _DOCUMENT.format(page=_PAGE.format(time="TIMESTAMP"), time="TIMESTAMP")
RUN_TYPES = {
    "urls_visited": "ARRAY<STRING>",
    "urls_failed": "ARRAY<STRING>",
    "pages": f"ARRAY<{_PAGE.format(time='TIMESTAMP')}>",
}
_STORED = ", run_id STRING, seed_bucket INT"
_JSON_SCHEMA = _DOCUMENT.format(page=_PAGE.format(time="STRING"), time="STRING") + _STORED
_COLUMNS = [
    "crawl_id", "seed_url", "status", "error", "total_pages", "max_depth_reached",
    "urls_visited", "urls_failed", "pages", "started_at", "finished_at", "duration_seconds",
]
SEED_BUCKETS = 64


def seed_bucket(seed_url: Column) -> Column:
    return F.pmod(F.xxhash64(seed_url), F.lit(SEED_BUCKETS)).cast("int")


def iso_time(time: Column) -> Column:
    """ISO 8601 with offset; the fraction only where there is one."""
    fraction = F.when(F.unix_micros(time) % 1_000_000 == 0, F.lit("")).otherwise(
        F.date_format(time, ".SSSSSS")
    )
    return F.concat(
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.date_format(time, "xxx")
    )


def run_filename(seed_url: Column, started_at: Column) -> Column:
    """File name of a run's document."""
    # Unsafe characters, length limit and time stamp format.
    name = F.regexp_replace(seed_url, r"^https?://", "")
    name = F.regexp_replace(name, r"(?U)[^\w\-.]", "_")
    name = F.substring(F.regexp_replace(name, "_+", "_"), 1, 180)
    return F.concat(name, F.lit("_"), F.date_format(started_at, "yyyyMMdd_HHmmss"), F.lit(".json"))


def _savable() -> Column:
    return F.col("seed_url").isNotNull() & F.col("status").isNotNull() & F.col("started_at").isNotNull()


def save_runs(runs: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Append runs to the store as ``parquet`` rows or ``json`` documents; one row
    with ``saved, failed, total``.

    Runs without seed, status or start are not savable and count as failed. Each
    saved run gets a ``run_id`` of its own, whatever its crawl id is. The rebalance
    hint lets the adaptive planner even out the files, however the runs are spread
    over seeds.
    """
    rows = (
        runs.filter(_savable())
        .select(*_COLUMNS, *[c for c in runs.columns if c == "run_id"])
        .withColumn("run_id", F.expr("uuid()") if "run_id" not in runs.columns else F.col("run_id"))
        .withColumn("seed_bucket", seed_bucket(F.col("seed_url")))
    )
    if fmt == "json":
        rows = rows.withColumns(
            {
                "started_at": iso_time(F.col("started_at")),
                "finished_at": iso_time(F.col("finished_at")),
                "pages": F.transform(
                    "pages", lambda p: p.withField("crawled_at", iso_time(p["crawled_at"]))
                ),
            }
        )
    writer = rows.hint("rebalance", "seed_bucket").write.mode("append").partitionBy("seed_bucket")
    if fmt == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.format(fmt).save(f"{path}/runs")
    return _counts(runs)


def save_many(runs: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Save a batch; one row with ``saved, failed, total``."""
    return save_runs(runs, path, fmt)


def _counts(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count_if(_savable()).alias("saved"),
        F.count_if(~_savable()).alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )


def read_or_empty(reader: DataFrameReader, schema: str, path: str, fmt: str = "parquet") -> DataFrame:
    """The files under ``path``, or no rows where nothing was ever written."""
    try:
        return reader.schema(schema).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # In a form that the optimizer sees to be empty.
        columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)]
        return SparkSession.active().range(1).select(*columns).filter(F.lit(False))


def _stored(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "json":
        lenient = spark.read.option("mode", "DROPMALFORMED")
        rows = read_or_empty(lenient, _JSON_SCHEMA, f"{path}/runs", "json")
        return rows.withColumns(
            {
                "started_at": F.col("started_at").cast("timestamp"),
                "finished_at": F.col("finished_at").cast("timestamp"),
                "pages": F.transform(
                    "pages",
                    lambda p: p.withField("crawled_at", p["crawled_at"].cast("timestamp")),
                ),
            }
        )
    return read_or_empty(spark.read, RUN_SCHEMA + _STORED, f"{path}/runs")


def _live(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    gone = read_or_empty(spark.read, "run_id STRING", f"{path}/tombstones")
    return _stored(spark, path, fmt).join(gone, "run_id", "left_anti")


def _of_seeds(rows: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """Rows of the given seeds; the bucket in the key prunes partitions."""
    if seeds is None:
        return rows
    wanted = seeds.select("seed_url", seed_bucket(F.col("seed_url")).alias("seed_bucket")).distinct()
    return rows.join(wanted, ["seed_bucket", "seed_url"], "left_semi")


def _newest(rows: DataFrame) -> DataFrame:
    """``run_id`` of the newest run per seed, from the narrow columns only. Of runs
    that started together the one of the largest crawl id counts."""
    return (
        rows.groupBy("seed_bucket", "seed_url")
        .agg(F.max(F.struct("started_at", F.coalesce("crawl_id", F.lit(-1)), "run_id")).alias("k"))
        .select("k.run_id")
    )


def read_runs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """All stored runs that were not deleted."""
    return _live(spark, path, fmt).select(*_COLUMNS)


def latest_ids(spark: SparkSession, path: str, seeds: DataFrame | None = None) -> DataFrame:
    """``(seed_url, run_id)`` of the newest run of each seed."""
    rows = _of_seeds(_live(spark, path, "parquet"), seeds)
    return rows.join(_newest(rows), "run_id").select("seed_url", "run_id")


def load_latest(
    spark: SparkSession, path: str, seeds: DataFrame | None = None, fmt: str = "parquet"
) -> DataFrame:
    """The newest run of each seed. Its key is found first, so the documents of
    older runs are not moved around."""
    rows = _of_seeds(_live(spark, path, fmt), seeds)
    return rows.join(_newest(rows), "run_id", "left_semi").select(*_COLUMNS)


def run_exists(spark: SparkSession, path: str, seeds: DataFrame, fmt: str = "parquet") -> DataFrame:
    """``(seed_url, found)`` for each given seed."""
    keyed = seeds.select("seed_url").distinct().withColumn("seed_bucket", seed_bucket(F.col("seed_url")))
    known = _live(spark, path, fmt).select("seed_bucket", "seed_url").distinct()
    return keyed.join(known.withColumn("hit", F.lit(True)), ["seed_bucket", "seed_url"], "left").select(
        "seed_url", F.coalesce("hit", F.lit(False)).alias("found")
    )


def delete_latest(
    spark: SparkSession, path: str, seeds: DataFrame, fmt: str = "parquet"
) -> DataFrame:
    """Remove the newest run of each seed; ``(seed_url, deleted)``."""
    found = run_exists(spark, path, seeds, fmt).select("seed_url", F.col("found").alias("deleted"))
    # The answer must be fixed before the tombstones change it.
    found = written(found, "deleted")
    newest = _newest(_of_seeds(_live(spark, path, fmt), seeds))
    newest.write.mode("append").parquet(f"{path}/tombstones")
    return found


def list_crawls(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Summary rows of all stored runs, sorted by file name."""
    return (
        _live(spark, path, fmt)
        .select(
            F.coalesce("seed_url", F.lit("")).alias("seed_url"),
            F.coalesce("status", F.lit("")).alias("status"),
            F.coalesce("total_pages", F.lit(0)).alias("total_pages"),
            F.coalesce(iso_time(F.col("started_at")), F.lit("")).alias("started_at"),
            run_filename(F.col("seed_url"), F.col("started_at")).alias("filename"),
        )
        .orderBy("filename")
    )
