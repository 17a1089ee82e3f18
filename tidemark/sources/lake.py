"""The JSON lake and its Parquet tier: scans that skip bad lines, daily sinks, compaction, views and cursors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import utc_time
from tidemark.operators.books import latest_rows

_LEVELS = ", ".join(f"{s}_{f}_{i} double" for s in ("bid", "ask") for f in ("px", "sz") for i in range(1, 6))
#: Identifiers are text: some have 77 digits. Receive nanoseconds are a clock of their own, never a timestamp.
BOOK = f"venue string, market_id string, capture_seq bigint, capture_ts_utc string, recv_monotonic_ns bigint, venue_book_ts string, best_bid double, best_ask double, mid double, spread double, staleness_seconds double, freshness_status string, freshness_threshold_seconds double, fetch_elapsed_ms double, connector_source string, reportable boolean, run_id string, ntp_offset_ms double, {_LEVELS}, book_json string, legacy_book_fix boolean"
EVENT = "kind string, run_id string, observed_at string, reason string, resumed_from_seq bigint, ntp_offset_ms double, cycle bigint, gap_ms double, venues_ok map<string,boolean>, added array<array<string>>, retired array<array<string>>"


EDGE = "pair_key string, direction string, a_market string, b_market string, capture_ts_utc string, recv_monotonic_ns bigint, source_capture_seq bigint, raw_edge double, fee_adj_edge double, depth_adj_edge double, depth_fillable_size double, max_profitable_size double, capture_skew_ms double, books_fresh boolean, liquidity_complete boolean, include_in_strategy_metrics boolean, public_probe boolean, benchmark_ms bigint, survived boolean, qualifies boolean, edge_id string"
LOG = "kind string, run_id string, observed_at string, cycle bigint, reason string"


def _lines(spark: SparkSession, path: str | list[str], strict: bool) -> DataFrame:
    """(value, _file, _at): lines with their file and a place that orders the lines of a file."""
    read = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", not strict).option("ignoreMissingFiles", not strict)
    # Inside a split of a file, rows come in order.
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), at.alias("_at"))


def _parsed(lines: DataFrame, schema: str, *more: str) -> DataFrame:
    bad = "_corrupt"
    whole = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField(bad, T.StringType())])
    # Lines are parsed by an expression: a JSON reader may not be asked for the corrupt-record column alone.
    rows = lines.filter(F.trim("value") != "").select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("_x"), *more)
    return rows.filter(F.col("_x").isNotNull() & F.col(f"_x.{bad}").isNull()).select("_x.*", *more).drop(bad)


def json_scan(spark: SparkSession, path: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """Rows of all JSON-lines files below a path; blank and broken lines are skipped; _file is where a row came from.

    Unreadable files are skipped too, unless `strict`: then they are an error.
    """
    return _parsed(_lines(spark, path, strict), schema, "_file")


def numbered_scan(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """json_scan with _line, the line's number in its file: blank and broken lines count, so a number stays what it is.

    Files roll daily, so numbering a file is one sort of a day.
    """
    n = F.row_number().over(Window.partitionBy("_file").orderBy("_at")).cast("long") - 1
    return _parsed(_lines(spark, path, False).withColumn("_line", n), schema, "_file", "_line")


def capped_scan(spark: SparkSession, path: str | list[str], schema: str, most: int) -> DataFrame:
    """The first `most` rows in the order of files and lines."""
    return numbered_scan(spark, path, schema).orderBy("_file", "_line").limit(most)


def row_page(spark: SparkSession, path: str | list[str], schema: str, cursor: str | None, limit: int) -> DataFrame:
    """Rows from a cursor "file:line" on, 1 to 500 of them; _next is the cursor behind each row."""
    rows = numbered_scan(spark, path, schema)
    if cursor:
        file, sep, line = cursor.rpartition(":")
        if not sep or not file or not line.isdigit():
            raise ValueError("cursor is invalid")
        rows = rows.filter((F.col("_file") > file) | ((F.col("_file") == file) & (F.col("_line") >= int(line))))
    page = rows.orderBy("_file", "_line").limit(min(max(1, limit), 500))
    return page.withColumn("_next", F.concat_ws(":", "_file", (F.col("_line") + 1).cast("string")))


def inferred(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON files whose columns are found by reading them, united by name."""
    frames = [spark.read.option("recursiveFileLookup", True).json(p) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def edges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return json_scan(spark, path, EDGE)


def closed_days(rows: DataFrame, watermark: str) -> DataFrame:
    """Rows of files named by a day (ten characters before the ending) before the watermark."""
    stem = F.regexp_extract("_file", r"([^/]+)\.[^./]+$", 1)
    return rows.filter((F.length(stem) == 10) & (stem < watermark))


def books(spark: SparkSession, path: str) -> DataFrame:
    return json_scan(spark, path, BOOK)


def events(spark: SparkSession, path: str) -> DataFrame:
    return json_scan(spark, path, EVENT)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Hive-partitioned table, filters on partition columns and footers pushed down."""
    return spark.read.parquet(path)


def write_daily(rows: DataFrame, path: str, stamp: str, *more: str, format: str = "json") -> None:
    """Appends rows by day (and further columns) of a timestamp or ISO text; the session's zone should be UTC.

    Rows whose text is no time go to the day __HIVE_DEFAULT_PARTITION__ instead of stopping the sink.
    """
    at = F.col(stamp)
    at = utc_time(at) if rows.schema[stamp].dataType == T.StringType() else at.cast("timestamp")
    rows.withColumn("date", F.date_format(at, "yyyy-MM-dd")).write.partitionBy(*more, "date").mode("append").format(format).save(path)


def compact(rows: DataFrame, path: str, watermark: str, by: list[str], seq: str, at: str) -> DataFrame:
    """Closed days (date before the watermark) as zstd Parquet, one row for each seq of a (by, date): the earliest.

    Partitions are replaced, so running it again changes nothing. Returns the days written and left open.
    """
    closed = latest_rows(rows.filter(F.col("date") < watermark), [*by, "date", seq], at)
    # A large day is several tasks and files: rows of a sequence stay together, which keeps footers selective.
    out = closed.select(*rows.columns).repartition(*by, "date", F.floor(F.col(seq) / 1_000_000)).sortWithinPartitions(*by, "date", seq)
    out.write.partitionBy(*by, "date").mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path)
    return rows.select("date", (F.col("date") < watermark).alias("closed")).distinct()


def views(spark: SparkSession, books: DataFrame, edges: DataFrame, log: DataFrame) -> None:
    """The warehouse's three views: books by hour, edges, and heartbeats."""
    books.withColumn("hour", F.hour("capture_ts")).createOrReplaceTempView("book_observations")
    edges.createOrReplaceTempView("edge_observations")
    log.filter("kind = 'heartbeat'").createOrReplaceTempView("latency")


def resume_point(rows: DataFrame, seq: str) -> int:
    """The largest sequence number so far, -1 without rows."""
    return rows.agg(F.coalesce(F.max(seq), F.lit(-1)).alias("m")).first()["m"]


def newer(rows: DataFrame, seq: str, mark: int) -> DataFrame:
    return rows.filter(F.col(seq) > mark)
