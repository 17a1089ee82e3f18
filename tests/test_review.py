"""Review, discovery and status operators where no query reaches: documents, errors, pages, sinks."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fees
from tidemark.operators import discovery as D
from tidemark.operators import review as V
from tidemark.operators import scanner as N


def test_a_registry_document_must_match_its_digest(spark, tmp_path):
    path = tmp_path / "pairs.json"
    pair = {"pair_key": "K", "a_market": "A", "b_identifiers": {"token": "T", "condition": "C"}, "include": True, "status": "approved_for_paper", "decisions": [{"at": "1", "decision": "approve"}]}
    path.write_text(json.dumps({"pairs": [pair, {"pair_key": "L", "status": "candidate"}]}))
    with pytest.raises(ValueError):
        V.load(spark, str(path))
    (tmp_path / "pairs.json.sha256").write_text(hashlib.sha256(path.read_bytes()).hexdigest() + "  pairs.json\n")
    pairs = V.load(spark, str(path))
    assert [(r["pair_key"], r["b_token"], r["decisions"][0]["decision"] if r["decisions"] else None) for r in pairs.orderBy("pair_key").collect()] == [("K", "T", "approve"), ("L", None, None)]
    assert V.scannable(pairs, ["K"]).count() == V.scannable(pairs).count() == 1
    with pytest.raises(ValueError, match="L, X"):
        V.scannable(pairs, ["K", "L", "X"])


def test_pages_end_or_fail():
    pages = {None: ([{"id": 1}], "a"), "a": ([{"id": 2}], "b"), "b": ([{"id": 3}], "")}
    assert [r["id"] for r in D.pages(pages.get, 10)] == [1, 2, 3] and len(D.pages(pages.get, 2)) == 2
    with pytest.raises(ValueError):
        D.pages(lambda c: ([{}], "same"), 10)
    rows = list(range(25))
    assert D.offset_pages(lambda at: rows[at : at + 10], 10, 9) == rows and D.offset_pages(lambda at: rows[at : at + 10], 10, 1) == rows[:10]


def test_listed_universe_and_exact_fetch(spark):
    assert D.listed(spark, [("A", "1"), ("A", "1"), ("B", "1")]).count() == 2
    rows = spark.createDataFrame([("m2", "s"), ("m1", "s"), ("m1", "s"), ("m3", "t")], "market_id string, series string")
    assert [r["market_id"] for r in D.exact(rows, spark.createDataFrame([("s",)], "series string"), "series", 5).collect()] == ["m1", "m2"]
    with pytest.raises(ValueError):
        D.Filters(max_spread=2)
    with pytest.raises(ValueError):
        D.Filters(min_depth=-1)


def test_fee_schedules(spark):
    document = {"general": {"taker_multiplier": "0.07", "maker_multiplier": 0, "rounding": "ceil_cent_per_order"}, "series_overrides": {"S": {"taker_multiplier": "0.035"}}, "source_urls": ["x"]}
    s = fees.Schedule.load(document)
    assert (s.taker_e4, s.maker_e4, s.overrides) == (700, 0, (("S", 350, 0),))
    for broken in ({"rounding": "up"}, {"taker_multiplier": 0}):
        with pytest.raises(ValueError):
            fees.Schedule.load(document | {"general": document["general"] | broken})
    with pytest.raises(ValueError):
        fees.Schedule.load(document | {"series_overrides": {"S": {"taker_multiplier": 0}}})
    with pytest.raises(ValueError):
        fees.Schedule.load(document | {"source_urls": []})
    plain = fees.multipliers(F.lit("S-1"), fees.Schedule())["taker_e4"]
    unit = fees.round_trip_per_unit(F.lit(700), F.lit(100), F.lit(0.5), F.lit(0.4), F.lit(10.0))
    r = spark.range(1).select(plain, unit, fees.multipliers(F.lit("S-1"), s)["taker_e4"]).first()
    assert r[0] == 700 and r[1] == pytest.approx((0.18 + 10 * 0.01 * 0.4) / 10) and r[2] == 350


def test_stored_rows_get_conservative_defaults(spark):
    d = spark.createDataFrame([("e1", "K", "", None, 0.5), ("e2", None, "N", True, None)], "edge_id string, pair_key string, display_name string, qualifies boolean, raw_edge double")
    got = {r["edge_id"]: r for r in N.passed_through(d).collect()}
    assert (got["e1"]["display_name"], got["e1"]["qualifies"], got["e1"]["raw_edge"], got["e1"]["contract_equivalent"]) == ("K", False, 0.5, "unreviewed")
    assert (got["e2"]["display_name"], got["e2"]["pair_key"], got["e2"]["raw_edge"], got["e2"]["include"]) == ("N", "", 0.0, False)
    assert N.specified(spark.createDataFrame([("K",)], "pair_key string"), d).count() == 1


def test_snapshot_sink_numbers_changed_legs(spark):
    d = spark.createDataFrame([("A", "m", 1), ("A", "m", 1), ("A", "m", 5), ("B", "m", 1)], "leg string, market_id string, recv_ns long")
    assert sorted((r["leg"], r["recv_ns"], r["seq"]) for r in N.snapshot_seq(d, ["recv_ns"]).collect()) == [("A", 1, 1), ("A", 5, 2), ("B", 1, 1)]


def test_scenarios_and_clocks(spark):
    from tidemark import params
    from tidemark.functions import clocks

    got = params.scenarios({"executable": {"depth_haircut": 0.4, "scenarios": {"clean": {"max_skew_ms": 20}, "rough": None}}})
    assert (got["clean"].max_skew_ms, got["clean"].depth_haircut, got["rough"].max_skew_ms, got["rough"].min_snapshots) == (20.0, 0.4, 50.0, 2)
    with pytest.raises(ValueError):
        params.scenarios({"executable": {}})
    x = spark.range(1).select(clocks.offset_ms(F.lit(10.0), F.lit(9.5), F.lit(9.6), F.lit(10.3)), clocks.offset_ms(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(1.0)), clocks.cadence_s(F.lit(5), F.lit(8.0)), clocks.cadence_s(F.lit(1), F.lit(8.0))).first()
    assert x[0] == pytest.approx(600.0) and x[1] is None and x[2] == 2.0 and x[3] is None


def test_profitable_depth_under_the_fees_of_each_overlap(spark):
    from tidemark.operators import edges as E

    ladder = {f"ap{i}": 0.40 + 0.02 * i for i in range(1, 6)} | {f"bp{i}": 0.40 + 0.02 * i for i in range(1, 6)} | {f"{n}h{i}": 10.0 * i for n in "ab" for i in range(1, 6)}
    row = spark.createDataFrame([(0,)], "x int").select(F.struct(*(F.lit(v).alias(k) for k, v in ladder.items())).alias("d"))
    flat = E.depth(row, 0.02, 1.0).first()["max_profitable_size"]
    unit = lambda c: fees.round_trip_per_unit(F.lit(fees.TAKER_E4), F.lit(0), c["pa"], c["pb"], c["hi"] - c["lo"])
    real = E.depth(row, unit, 1.0).first()["max_profitable_size"]
    import math

    want = sum(10.0 for i in range(1, 6) if 1 - 2 * (0.40 + 0.02 * i) - math.ceil(round(7 * 10 * round(0.40 + 0.02 * i, 2) * (1 - round(0.40 + 0.02 * i, 2)), 6)) / 100 / 10 > 1e-12)
    assert flat == 40.0 and real == want


def test_go_no_go_equals_its_sql_on_equal_and_missing_ranks(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from tidemark import catalog

    con = duckdb.connect()
    con.execute("SET threads = 1")  # with more, its arg_min takes any of equal ranks
    rows = ", ".join(f"({k % 9 if k % 3 else k % 5}, {k % 4}, 1, {k % 7}, {k}.0)" for k in range(3000))
    odd = "(50, NULL, 1, 8, 1.0), (51, NULL, 1, 8, 1.0), (51, 3, 1, 6, 2.0), (52, 1, 1, 8, NULL), (52, 2, 1, 6, 7.0), (53, 1, 1, 9, NULL), (NULL, 1, 1, 9, 1.0)"
    con.execute(f"COPY (SELECT * FROM (VALUES {rows}, {odd}) t(l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity)) TO '{tmp_path}/lineitem.parquet' (ROW_GROUP_SIZE 2048)")
    con.execute(f"COPY (SELECT i AS p_partkey, i % 3 AS p_size FROM range(60) t(i)) TO '{tmp_path}/part.parquet'")
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    want = sorted(con.execute(catalog.oracle_sql()["go_no_go"]).fetchall(), key=key)
    got = sorted((tuple(r) for r in catalog.queries()["go_no_go"](spark, str(tmp_path)).collect()), key=key)
    assert [(*r[:1], None if r[1] is None else float(r[1]), *r[2:]) for r in want] == [(*r[:1], None if r[1] is None else float(r[1]), *r[2:]) for r in got]
