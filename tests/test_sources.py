"""Lake scans, recordings, documents and streams on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import books as B
from tidemark.operators import quality, registry, value
from tidemark.sources import documents, lake, soaks
from tidemark.streaming import live


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def edge(key, k, **more):
    return {"pair_key": key, "direction": "a_yes_b_no", "source_capture_seq": k, "raw_edge": k / 100, "capture_ts_utc": "2024-01-01T00:00:00Z"} | more


def test_numbered_capped_and_paged_scans(spark, tmp_path):
    lines(tmp_path / "e" / "b.jsonl", [edge("K", 3), "", "{no", edge("K", 4), "[1]", '"text"'])
    lines(tmp_path / "e" / "a.jsonl", [edge("K", 1), edge("K", 2)])
    path = str(tmp_path / "e")
    rows = lake.numbered_scan(spark, path, lake.EDGE).orderBy("_file", "_line").collect()
    assert [(r["source_capture_seq"], r["_line"]) for r in rows if r["source_capture_seq"]] == [(1, 0), (2, 1), (3, 0), (4, 3)]
    assert [r["source_capture_seq"] for r in lake.capped_scan(spark, path, lake.EDGE, 3).collect()] == [1, 2, 3]
    first = lake.row_page(spark, path, lake.EDGE, None, 2).collect()
    assert [r["source_capture_seq"] for r in first] == [1, 2]
    rest = lake.row_page(spark, path, lake.EDGE, first[1]["_next"], 900).filter("source_capture_seq IS NOT NULL").collect()
    assert [r["source_capture_seq"] for r in rest] == [3, 4]
    for bad in ("x", ":3", "a:b"):
        with pytest.raises(ValueError):
            lake.row_page(spark, path, lake.EDGE, bad, 2)
    assert lake.resume_point(lake.edges(spark, path), "source_capture_seq") == 4 and lake.newer(lake.edges(spark, path), "source_capture_seq", 3).count() == 1
    assert lake.resume_point(lake.edges(spark, path).limit(0), "source_capture_seq") == -1


def test_closed_days_inferred_schema_and_daily_sinks(spark, tmp_path):
    for name in ("2024-01-01", "2024-01-02", "2024-01-03", "notes", "2024-01-01x"):
        lines(tmp_path / "d" / f"{name}.jsonl", [edge(name, 1)])
    kept = lake.closed_days(lake.edges(spark, str(tmp_path / "d")), "2024-01-03")
    assert sorted(r["pair_key"] for r in kept.collect()) == ["2024-01-01", "2024-01-02"]
    lines(tmp_path / "x" / "1.json", [{"a": 1}])
    lines(tmp_path / "y" / "1.json", [{"b": "t"}])
    assert sorted(map(str, lake.inferred(spark, [str(tmp_path / "x"), str(tmp_path / "y")]).collect())) == ["Row(a=1, b=None)", "Row(a=None, b='t')"]
    rows = spark.createDataFrame([("a", "2024-01-01T23:59:59Z", 1), ("a", "2024-01-02 00:00:01", 2), ("b", "never", 3)], "venue string, at string, n int")
    lake.write_daily(rows, str(tmp_path / "out"), "at", "venue")
    back = spark.read.json(str(tmp_path / "out"))
    assert sorted((r["venue"], str(r["date"]), r["n"]) for r in back.collect()) == [("a", "2024-01-01", 1), ("a", "2024-01-02", 2), ("b", "None", 3)]


def test_views(spark):
    books = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), 1)], "capture_ts timestamp, n int")
    log = spark.createDataFrame([("heartbeat", 1), ("gap", 2)], "kind string, n int")
    lake.views(spark, books, books, log)
    assert spark.sql("SELECT hour FROM book_observations").first()[0] == 5 and spark.sql("SELECT count(*) FROM latency").first()[0] == 1
    assert spark.sql("SELECT count(*) FROM edge_observations").first()[0] == 1


def test_recordings_are_catalogued_and_prefer_their_best_source(spark, tmp_path):
    root, old = tmp_path / "soaks", tmp_path / "old"
    lines(root / "s1" / "raw" / "edge" / "2024-01-01.jsonl", [edge("K", 1), edge("L", 2)])
    lines(root / "s1" / "raw" / "book" / "2024-01-01.jsonl", [{"venue": "a"}])
    lines(root / "s2" / "raw" / "edge" / "x.jsonl", [edge("K", 1)])
    lines(root / "s2" / "scan" / "opportunities" / "x.jsonl", [edge("M", 5), edge("M", 6)])
    lines(root / "s3" / "EDGES_1.jsonl", [edge("N", 7)])
    lines(root / "s3" / "scan" / "opportunities" / "x.jsonl", [edge("M", 5)])
    (root / "s3" / "manifest.json").write_text(json.dumps({"soak_id": "third", "started_at": "2024-02-01", "pair_keys": ["N"]}))
    (root / "empty").mkdir()
    (root / ".cache").mkdir()
    lines(old / "data_1" / "raw" / "book" / "x.jsonl", [{"venue": "a"}])
    assert [soaks.edge_sources(spark, str(root / s))[1] for s in ("s1", "s2", "s3", "empty")] == ["raw_edge", "opportunity", "standardized", "none"]
    assert sorted(r["pair_key"] for r in soaks.edge_rows(spark, str(root / "s2")).collect()) == ["M", "M"] and soaks.edge_rows(spark, str(root / "empty")).count() == 0
    meta = {r["soak_id"]: r for r in soaks.catalog(spark, str(root), [str(old)]).collect()}
    assert set(meta) == {"s1", "s2", "third", "data_1"} and meta["third"]["edges_only"] and meta["data_1"]["legacy"] and not meta["s1"]["legacy"]
    assert (meta["s1"]["book"], meta["s1"]["edges"], meta["s1"]["pair_keys"]) == (1, 2, ["K", "L"]) and meta["third"]["pair_keys"] == ["N"]
    first = soaks.listing(soaks.catalog(spark, str(root)), None, 1).collect()
    assert [r["soak_id"] for r in first] == ["third"]
    assert [r["soak_id"] for r in soaks.listing(soaks.catalog(spark, str(root)), ("2024-02-01", "third"), 5).collect()] == ["s2", "s1"]
    assert soaks.evidence(spark, str(root / "s1"), lambda b: b).count() == 2
    assert soaks.evidence(spark, str(old / "data_1"), lambda b: b.select(F.lit(1).alias("derived"))).columns == ["derived"]


def test_documents_are_whole_and_bounded(spark, tmp_path):
    rows = spark.createDataFrame([("a|b", 1, 0.5), ("c", 2, None)], "r string, c int, v double")
    documents.save_queue(str(tmp_path / "q" / "queue.json"), rows)
    queue = json.loads((tmp_path / "q" / "queue.json").read_text())
    assert queue["queue_type"] == "candidate_only" and queue["auto_approval_enabled"] is False and len(queue["candidates"]) == 2
    documents.save_discovery(str(tmp_path / "d.json"), "A", rows, spark.createDataFrame([("wide", 3)], "reason string, n int"))
    assert json.loads((tmp_path / "d.json").read_text())["stats"] == {"accepted": 2, "rejected_by_reason": {"wide": 3}}
    text = documents.markdown("Report", {"Rows": rows, "None": rows.limit(0)})
    assert "| a\\|b | 1 | 0.5 |" in text and "(no rows)" in text
    with pytest.raises(ValueError):
        documents.records(rows, 1)
    assert documents.heat_text(rows, "r", "c", "v").count("\n") == 1 and "<td" in documents.heat_html("T<", rows, "r", "c", "v") and "T&lt;" in documents.heat_html("T<", rows, "r", "c", "v")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["d.json", "q"]


def test_books_and_small_operators(spark):
    d = spark.createDataFrame([(1, [(0.4, 5.0), (0.3, 1.0)], [(0.6, 2.0)]), (2, [], [(0.6, 2.0)]), (3, [], [])], f"id int, bids {B.LADDER}, asks {B.LADDER}")
    assert sorted(r["id"] for r in B.two_sided(d).collect()) == [1, 3]
    o = B.observation(d.filter("id = 1")).first()
    assert (o["best_bid"], o["best_ask"], o["mid"], o["bid_px_2"], o["ask_sz_1"], o["ask_px_2"]) == (0.4, 0.6, 0.5, 0.3, 2.0, None) and json.loads(o["book_json"])["asks"][0]["price"] == 0.6
    assert d.select(B.complement(F.col("bids")).alias("x")).first()["x"][0]["price"] == 0.6
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    f = spark.createDataFrame([(t(50), t(0), 0.4, 0.5), (t(50), None, 0.4, None), (t(50), t(0), None, None)], "c timestamp, v timestamp, b double, a double")
    age, status = B.freshness(F.col("c"), F.col("v"), F.col("b"), F.col("a"), 40.0)
    assert [(r["age"], r["status"]) for r in f.select(age.alias("age"), status.alias("status")).collect()] == [(50.0, "stale"), (None, "missing_venue_timestamp"), (50.0, "missing_book")]
    assert [r[0] for r in spark.range(2).select(quality.is_stale(F.col("id") * 100, 60.0)).collect()] == [False, True]
    log = spark.createDataFrame([("gap", "x"), ("gap", "x"), ("start", None)], "kind string, reason string")
    assert sorted((r["kind"], r["n"]) for r in quality.continuity(log).collect()) == [("gap", 2), ("start", 1)]
    assert [r["id"] for r in value.best_row(spark.createDataFrame([(1, 5), (2, 7)], "id int, x int").withColumn("k", F.lit(1)), ["k"], [F.desc("x")]).collect()] == [2]
    q = spark.range(1).select(registry.prescreen(F.lit("Before May, in a range"), F.lit(""), F.lit(t(0)), F.lit(t(0)) + F.expr("INTERVAL 2 HOURS"), F.lit(t(0)) - F.expr("INTERVAL 100 DAYS")).alias("x")).first()["x"]
    assert q == ["deadline", "range", "cutoff_mismatch", "long_dated"]


QUOTE = "leg string, market_id string, capture_seq long, recv_ns long, capture_ts timestamp"


def quotes(rows):
    return [(leg, m, k, ns, dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=ns // 1000)) for leg, m, k, ns in rows]


def test_latest_quotes_are_paired_and_a_stale_leg_is_told_once(spark, tmp_path):
    s = 1_000_000_000
    rows = [("A", "m", 1, 0), ("B", "m", 2, 5 * s), ("A", "m", 3, 40 * s), ("A", "m", 4, 41 * s), ("B", "m", 5, 42 * s), ("A", "m", 6, 80 * s), ("B", "n", 7, 80 * s)]
    spark.createDataFrame(quotes(rows), QUOTE).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(QUOTE).parquet(str(tmp_path / "in"))
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        live.run_available(live.latest_pairs(stream, 30 * s), str(tmp_path / "out"), str(tmp_path / "ck"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept) if kept else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r["a_seq"], r["b_seq"], r["skew_ns"] // s, r["gap"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 2, -5, False), (3, 2, 35, True), (4, 5, -1, False), (6, 5, 38, True)]


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k)
    rows = [("m", at(k)) for k in (0, 20, 40, 200, 210, 5000)]
    spark.createDataFrame(rows, "k string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    spark.createDataFrame([("m", at(9000))], "k string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    stream = spark.readStream.schema("k string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    live.run_available(live.session_counts(stream, ["k"], "at", "45 seconds", "10 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted((r["start_ts"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:2] == [(at(0), 3), (at(200), 2)]


def test_sinks_and_timing(spark, tmp_path):
    rows = spark.createDataFrame([(1, True, dt.datetime(2024, 1, 1)), (2, False, dt.datetime(2024, 1, 2))], "n int, qualifies boolean, capture_ts timestamp")
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    stream = live.recorded(spark, str(tmp_path / "in"), "n int, qualifies boolean, capture_ts timestamp")
    live.edge_sink(stream, str(tmp_path / "all"), str(tmp_path / "c1"))
    live.edge_sink(stream, str(tmp_path / "some"), str(tmp_path / "c2"), qualifying_only=True)
    live.edge_sink(stream, str(tmp_path / "all"), str(tmp_path / "c1"))  # resumes: nothing is written twice
    assert spark.read.json(str(tmp_path / "all")).count() == 2 and [r["n"] for r in spark.read.json(str(tmp_path / "some")).collect()] == [1]
    assert live.run_until(stream, str(tmp_path / "live"), str(tmp_path / "c3"), 4) is False and spark.read.parquet(str(tmp_path / "live")).count() == 2
    assert [live.wait_s(k) for k in range(9)] == [0, 1, 2, 4, 8, 16, 32, 60, 60]
    assert live.due(None, 5, 10) and live.due(0, 10, 10) and not live.due(1, 10, 10)
    assert live.next_tick(0.0, 7.5, 2.0) == (3, 0.5, 2)
