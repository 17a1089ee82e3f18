"""Streams: duplicate suppression, sessions, pairing of the latest quotes and incremental derivation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def unchanged_dropped(books: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row for each (leg, market, receive time) within the watermark."""
    return books.withWatermark("capture_ts", late).dropDuplicatesWithinWatermark(["leg", "market_id", "recv_ns"])


def session_counts(rows: DataFrame, by: list[str], at: str, gap: str, late: str) -> DataFrame:
    """Sessions closed by the watermark: a gap longer than `gap` ends one."""
    return rows.withWatermark(at, late).groupBy(*by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


class LatestPair(StatefulProcessor):
    """Pairs each quote with the other leg's latest, unless that is older than `bound` by the arriving quote's clock.

    A stale leg is reported once, until it is fresh again.
    """

    STATE = "seq long, ns long"

    def __init__(self, bound_ns: int):
        self.bound = bound_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.legs = {leg: handle.getValueState(f"leg_{leg}", self.STATE) for leg in ("A", "B")}
        self.told = handle.getValueState("told", "stale boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        quotes = pd.concat(list(rows)).sort_values(["recv_ns", "capture_seq"])
        for leg, seq, ns in zip(quotes["leg"], quotes["capture_seq"], quotes["recv_ns"]):
            self.legs[leg].update((int(seq), int(ns)))
            other = self.legs["B" if leg == "A" else "A"]
            if not other.exists():
                continue
            seq2, ns2 = other.get()
            stale = ns - ns2 > self.bound
            if not stale:
                a, b = ((seq, ns), (seq2, ns2)) if leg == "A" else ((seq2, ns2), (seq, ns))
                out.append((key[0], int(a[0]), int(b[0]), int(a[1] - b[1]), False))
            elif not (self.told.exists() and self.told.get()[0]):
                out.append((key[0], int(seq), int(seq2), int(ns - ns2), True))
            self.told.update((bool(stale),))
        if out:
            yield pd.DataFrame(out, columns=["market_id", "a_seq", "b_seq", "skew_ns", "gap"])

    def close(self) -> None:
        pass


def latest_pairs(books: DataFrame, bound_ns: int = 30_000_000_000) -> DataFrame:
    schema = StructType.fromDDL("market_id string, a_seq long, b_seq long, skew_ns long, gap boolean")
    return books.groupBy("market_id").transformWithStateInPandas(statefulProcessor=LatestPair(bound_ns), outputStructType=schema, outputMode="Append", timeMode="None")


def run_available(frame: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drains what is there into Parquet and stops; the checkpoint is the resume point."""
    q = frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


#: The longest wait between two tries, and rows after which an edge sink flushes.
LONGEST_WAIT_S, FLUSH_ROWS = 60.0, 200


def wait_s(failures: int, first: float = 1.0) -> float:
    """Seconds before the next try: none before the first, then doubled up to a minute."""
    return 0.0 if failures <= 0 else min(first * 2 ** (failures - 1), LONGEST_WAIT_S)


def due(last_s: float | None, now_s: float, every_s: float) -> bool:
    """Whether a periodic step (a refresh of the universe) is due."""
    return last_s is None or now_s - last_s >= every_s


def next_tick(began_s: float, now_s: float, cadence_s: float) -> tuple[int, float, int]:
    """(number of the running tick, seconds to the next one, ticks that were missed since the last): a late loop does not drift."""
    tick = int((now_s - began_s) // cadence_s)
    return tick, began_s + (tick + 1) * cadence_s - now_s, max(0, tick - 1)


def run_until(frame: DataFrame, path: str, checkpoint: str, seconds: float, mode: str = "append") -> bool:
    """Runs a stream into Parquet for so many seconds at most; says whether it ended by itself."""
    q = frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).start()
    try:
        return bool(q.awaitTermination(seconds))
    finally:
        q.stop()


def edge_sink(frame: DataFrame, path: str, checkpoint: str, qualifying_only: bool = False) -> None:
    """Drains edge rows into daily JSON, a file for each batch and day, only those that qualify if asked for."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.filter("qualifies") if qualifying_only else batch
        rows.withColumn("date", F.date_format("capture_ts", "yyyy-MM-dd")).write.partitionBy("date").mode("append").json(path)

    q = frame.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def recorded(spark, path: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    """A stream over recorded messages (JSON lines), a bounded number of files a batch: the offline twin of a live source."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)
