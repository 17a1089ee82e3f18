"""Hand-computed cases and randomized comparisons with plain Python for the order-book operators."""

import json
import random
from decimal import ROUND_CEILING, Decimal

import pytest
from pyspark.sql import functions as F

from tidemark import params as P
from tidemark.functions import fees
from tidemark.functions import text as T
from tidemark.operators import align, books, edges, episodes, matching, quality, registry, reports, value
from tidemark.sources import lake
from tidemark.streaming import live


def test_nearest_alignment_against_a_nested_loop(spark):
    r = random.Random(1)
    left = [(r.choice("xy"), r.randrange(4000), k) for k in range(150)]
    right = [(r.choice("xy"), r.randrange(4000), k) for k in range(120)] + [("x", 7, 500), ("x", 7, 501)]
    tol = 30
    got = align.nearest(spark.createDataFrame(left, "m string, t long, s long"), spark.createDataFrame(right, "m string, t long, s long"), ["m"], "t", tol, "s").select("l.s", F.col("r.s").alias("o")).collect()
    last = {}
    for m, t, s in right:
        last[m, t] = max(s, last.get((m, t), -1))
    want = set()
    for m, t, s in left:
        near = [(abs(u - t), -u, o) for (n, u), o in last.items() if n == m and abs(u - t) <= tol]
        if near:
            want.add((s, min(near)[2]))
    assert {tuple(x) for x in got} == want


def _book(leg, seq, ns, bid, ask, sizes=(10.0,) * 5, status="fresh"):
    row = {"leg": leg, "market_id": "m", "capture_seq": seq, "capture_ts": "2024-01-01 00:00:00", "recv_ns": ns, "staleness_s": 1.0, "status": status, "best_bid": bid, "best_ask": ask}
    for i in range(1, 6):
        row |= {f"bid_px_{i}": bid - (i - 1) / 100 if bid else None, f"bid_sz_{i}": sizes[i - 1], f"ask_px_{i}": ask + (i - 1) / 100 if ask else None, f"ask_sz_{i}": sizes[i - 1]}
    return row


def _frame(spark, rows):
    doubles = ", ".join(f"{s}_{f}_{i} double" for i in range(1, 6) for s in ("bid", "ask") for f in ("px", "sz"))
    return spark.createDataFrame(rows, f"leg string, market_id string, capture_seq long, capture_ts string, recv_ns long, staleness_s double, status string, best_bid double, best_ask double, {doubles}").withColumn("capture_ts", F.col("capture_ts").cast("timestamp"))


def test_edges_of_two_quotes(spark):
    pair = spark.createDataFrame([("m|b-m", "m", "m", True)], "pair_key string, a_market string, b_market string, include boolean")
    rows = _frame(spark, [_book("A", 1, 1000, 0.40, 0.45), _book("B", 2, 2000, 0.60, 0.65)])
    got = {r["direction"]: r for r in edges.derive(edges.matches(rows, pair)).collect()}
    assert got["a_yes_b_no"]["raw_edge"] == pytest.approx(0.15) and got["a_no_b_yes"]["raw_edge"] == pytest.approx(-0.25)
    assert got["a_yes_b_no"]["skew_ms"] == pytest.approx(-0.001) and got["a_yes_b_no"]["books_fresh"]
    deep = {r["direction"]: r for r in edges.derive(edges.matches(rows, pair), target=5.0).collect()}["a_yes_b_no"]
    assert deep["vwap"] == pytest.approx(0.85) and deep["depth_adj_edge"] == pytest.approx(0.13) and deep["slippage"] == pytest.approx(0) and deep["depth_fillable_size"] == 5


def test_depth_against_a_walk(spark):
    r = random.Random(2)
    pair = spark.createDataFrame([("m|b-m", "m", "m", True)], "pair_key string, a_market string, b_market string, include boolean")
    sizes = [tuple(r.choice([0.0, None, 1.0, 2.5, 7.0]) for _ in range(5)) for _ in range(2)]
    a, b = _book("A", 1, 1000, 0.40, 0.45, sizes[0]), _book("B", 2, 1500, 0.60, 0.65, sizes[1])
    got = {x["direction"]: x for x in edges.derive(edges.matches(_frame(spark, [a, b]), pair), target=4.0).collect()}
    for d, sa, sb in (("a_yes_b_no", "ask", "bid"), ("a_no_b_yes", "bid", "ask")):
        walk = lambda row, s: [[row[f"{s}_px_{i}"] if s == "ask" else 1 - row[f"{s}_px_{i}"], row[f"{s}_sz_{i}"]] for i in range(1, 6) if row[f"{s}_sz_{i}"]]
        x, y, filled, good = walk(a, sa), walk(b, sb), 0.0, 0.0
        while x and y:
            q = min(x[0][1], y[0][1])
            filled += min(q, 4.0 - filled)
            good += q if 1 - x[0][0] - y[0][0] - 0.02 > 0 else 0
            for z in (x, y):
                z[0][1] -= q
                if z[0][1] <= 1e-12:
                    z.pop(0)
        assert got[d]["depth_fillable_size"] == pytest.approx(filled) and got[d]["max_profitable_size"] == pytest.approx(good)


def test_order_fees(spark):
    golden = [(700, 0.50, 100, 175), (700, 0.05, 100, 34), (700, 0.50, 1, 2), (700, 0.40, 1, 2), (175, 0.50, 100, 44), (350, 0.50, 100, 88), (700, 0.01, 1, 1), (700, 0.99, 1, 1)]
    r = random.Random(3)
    for _ in range(300):
        m, n, p = r.choice([700, 350]), r.randint(1, 5000), r.choice([r.randint(1, 99) / 100, 0.1 + 0.2, 1 - 0.9, r.random() * 0.98 + 0.01])
        q = Decimal(str(p))
        golden.append((m, p, n, int((Decimal(m) / 10000 * n * q * (1 - q)).quantize(Decimal("0.01"), rounding=ROUND_CEILING) * 100)))
    got = spark.createDataFrame(golden, "m long, p double, n long, w long").filter(fees.order_cents(F.col("m"), F.col("p"), F.col("n")) != F.col("w"))
    assert got.count() == 0
    one = spark.range(1).select(fees.rate_fee(F.lit(300), F.lit(0.5), F.lit(100.0)), fees.rate_fee(F.lit(700), F.lit(0.05), F.lit(100.0)), fees.rate_fee(F.lit(None).cast("int"), F.lit(0.5), F.lit(100.0))).first()
    assert [round(x, 9) for x in one] == [1.5, 0.35, 5.0]


def _edge(pair, ts, fee=0.02, depth=0.02, size=10.0, skew=1.0, fresh=True):
    return (pair, "a_yes_b_no", ts, skew, fresh, fee, depth, size)


EDGE = "pair_key string, direction string, ts string, skew_ms double, books_fresh boolean, fee_adj_edge double, depth_adj_edge double, max_profitable_size double"


def _edges(spark, rows):
    return spark.createDataFrame(rows, EDGE).withColumn("capture_ts", F.to_timestamp("ts"))


def test_gate_bounds(spark):
    rows = [_edge("p", "2024-01-01 00:00:00"), _edge("p", None, skew=250.0), _edge("p", None, fee=0.0099), _edge("p", None, fresh=None), _edge("p", None, size=0.5), _edge("p", None, depth=None), _edge("p", None, skew=249.9)]
    assert [r[0] for r in _edges(spark, rows).select(edges.qualifies()).collect()] == [True, False, False, False, False, False, True]


def test_sessions_persistence_and_ranking(spark):
    at = lambda h, s: f"2024-01-01 {h:02d}:00:{s:02d}"
    rows = [_edge("p|x", at(0, 0)), _edge("p|x", at(0, 45)), _edge("p|x", at(1, 0)), *(_edge("p|x", at(k, 30), fee=-1.0) for k in range(2, 20))]
    eps = {r["session"]: r for r in episodes.build(_edges(spark, rows)).collect()}
    assert [eps[k]["snapshots"] for k in (0, 1)] == [2, 1] and eps[0]["duration_s"] == 45 and eps[1]["duration_s"] == 0
    per = episodes.persistence(_edges(spark, [_edge("q|y", at(k, 0), fee=0.02 if k < 3 else -1.0) for k in range(4)])).first()
    assert (per["total_cycles"], per["in_edge_cycles"], per["is_basis"]) == (4, 3, True)
    ranked = {r["session"]: r for r in episodes.ranked(_edges(spark, rows), None).collect()}
    assert ranked[0]["bucket"] == P.TRANSIENT and ranked[1]["bucket"] == P.UNUSABLE and ranked[0]["recurrence"] == 2


def test_fee_sweep(spark):
    got = {r["fee"]: r for r in episodes.fee_sweep(_edges(spark, [*(_edge("p|x", f"2024-01-01 0{k}:00:00", fee=0.015, depth=0.015) for k in range(3)), *(_edge("p|x", f"2024-01-02 {k:02d}:00:00", fee=-1.0) for k in range(12))])).collect()}
    assert got[0.02]["candidate_rows"] == 3 and got[0.03]["candidate_rows"] == 0 and got[0.03]["dropped"] == ["p"]


def test_survival_prefix(spark):
    rows = [("p", "d", 1, ms, ok, k) for k, (ms, ok) in enumerate([(0, True), (250, False), (1000, True)])] + [("p", "d", 2, 0, False, 9), ("p", "d", 3, 0, True, 3), ("p", "d", 3, 500, True, 4), ("p", "d", 3, None, False, 5)]
    got = {r["ladder"]: (r["through_ms"], r["tier"]) for r in episodes.survived_through(spark.createDataFrame(rows, "pair_key string, direction string, ladder int, benchmark_ms int, survived boolean, seq int"), ["ladder"]).collect()}
    assert got == {1: (0, "expired_lt_250ms"), 2: (None, None), 3: (500, "survived_500ms")}


def test_value_of_no_episode_is_zero(spark):
    eps = episodes.ranked(_edges(spark, [_edge("p|x", "2024-01-01 00:00:00")]), None)
    grid = spark.createDataFrame([("p|x", 10.0)], "pair_key string, days_to_resolution double")
    got = value.pair_value(eps, grid, 2.0).collect()
    assert len(got) == 2 and all(r["ev"] == 0 and r["verdict"] == "not_viable" for r in got)
    with pytest.raises(ValueError):
        value.pair_value(eps, grid, 0)


def test_book_functions(spark):
    raw = spark.createDataFrame([([(0.4, 5.0), (41.0, 2.0), (0.0, 1.0), (0.3, 0.0)],)], books.LADDER.join(["l ", ""]))
    assert [tuple(x) for x in raw.select(books.ladder(F.col("l"))).first()[0]] == [(0.41, 2.0), (0.4, 5.0)]
    crossed = _frame(spark, [_book("A", 1, 1, 0.5, 0.4), _book("A", 2, 1, 0.4, 0.5)])
    once = books.unswapped(crossed)
    assert [(r["best_bid"], r["best_ask"]) for r in once.orderBy("capture_seq").collect()] == [(0.4, 0.5)] * 2
    assert books.unswapped(once).select("best_bid", "bid_px_1", "ask_px_3").collect() == once.select("best_bid", "bid_px_1", "ask_px_3").collect()


def test_clamped_deltas_against_a_fold(spark):
    r = random.Random(5)
    rows = [("m", p, k, float(r.randint(-5, 4))) for p in range(4) for k in range(60)]
    got = {x["price"]: x["size"] for x in books.summed(spark.createDataFrame(rows, "m string, price int, seq int, d double"), ["m"], "price", "d", "seq").collect()}
    for p in range(4):
        size = 0.0
        for _, q, _, d in rows:
            if q == p:
                size = max(0.0, size + d)
        assert got.get(p, 0.0) == size


def test_percentiles_and_ewma(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(1, 5)], "g string, v double")
    one = quality.ranked_values(df, ["g"], "v", {"f": quality.floor_place(50), "r": quality.rounded_place(0.5)}).first()
    assert (one["f"], one["r"]) == (3.0, 3.0) and round(quality.linear(df, [], "v", {"p": 0.99}).first()["p"], 9) == 3.97
    import random

    r = random.Random(1)
    for values in ([r.random() for _ in range(501)], [float(r.randrange(4)) for _ in range(200)], [1e300, -1e300, 0.0, 1e-9], [7.0]):
        d = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        places = {f"p{k}": quality.floor_place(k) for k in (0, 37, 50, 95, 100)} | {"q": quality.rounded_place(0.9)}
        got, n, want = quality.ranked_values(d, [], "v", places).first(), len(values), sorted(values)
        assert [got[f"p{k}"] for k in (0, 37, 50, 95, 100)] == [want[min(n - 1, n * k // 100)] for k in (0, 37, 50, 95, 100)] and got["q"] == want[round((n - 1) * 0.9)]
        assert quality.linear(d, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(d.agg(F.median("v")).first()[0])
    assert quality.ranked_value(df, ["g"], "v", F.lit(2), "x").first()["x"] == 3.0
    assert reports.ewma(df, ["g"], "v", "v").first()["ewma"] == pytest.approx(0.8 * (0.8 * (0.8 * 1 + 0.2 * 2) + 0.2 * 3) + 0.2 * 4)


def test_half_even_rounding(spark):
    xs = [0.125, 2.675, 1.005, 0.5, 1e-9, -0.125]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(T.half_even(F.col("x"), 2)).collect()]
    assert got == [round(x, 2) for x in xs]


def test_matching_against_a_nested_loop(spark):
    r = random.Random(6)
    vocabulary = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf"]
    made = [(k, sorted(set(r.choice(vocabulary) for _ in range(r.randint(1, 6))))) for k in range(60)]
    df = spark.createDataFrame(made, "id long, tokens array<string>")
    got = {(x["a_id"], x["b_id"]) for x in matching.overlapping(df.filter("id < 30"), df.filter("id >= 30"), 0.45).collect()}
    want = {(i, j) for i, a in made[:30] for j, b in made[30:] if len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.45}
    assert got == want


def test_registry(spark):
    rows = [("k1", "a", "t", None, None, True, "approved", [("1", "hold"), ("2", "approve")]), ("k2", "a", "", "c", None, True, "approved", [("1", "approve"), ("2", "hold")]), ("k3", None, "t", None, None, True, "approved", []), ("k4", "b", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, registry.PAIR)
    assert [r["include_gated"] for r in registry.gated(df).orderBy("pair_key").collect()] == [True, False, False, False]
    assert [(r["pair_key"], r["b_market"]) for r in registry.edge_pairs(df).orderBy("pair_key").collect()] == [("k1", "t"), ("k2", "c")]
    names = spark.createDataFrame([(f"p{k:02d}",) for k in range(21)], "n string")
    assert sorted(r["n"] for r in registry.rotation(names, "n", 20, 1).collect()) == sorted([f"p{k:02d}" for k in (20, *range(19))])


def test_lake_skips_bad_lines_and_compacts_once(spark, tmp_path):
    day = tmp_path / "raw" / "venue=a"
    day.mkdir(parents=True)
    row = {"venue": "a", "market_id": "1" * 77, "capture_seq": 1, "recv_monotonic_ns": 5}
    (day / "2024-01-01.jsonl").write_text("\n".join([json.dumps(row), "", "{broken", json.dumps(row | {"recv_monotonic_ns": 4}), json.dumps(row | {"capture_seq": 2})]))
    got = lake.books(spark, str(tmp_path / "raw"))
    assert got.count() == 3 and got.first()["market_id"] == "1" * 77
    dated = got.select("venue", "capture_seq", "recv_monotonic_ns").withColumn("date", F.lit("2024-01-01"))
    for _ in range(2):
        days = lake.compact(dated, str(tmp_path / "out"), "2024-01-02", ["venue"], "capture_seq", "recv_monotonic_ns")
        assert days.first()["closed"] and sorted(tuple(r) for r in lake.parquet(spark, str(tmp_path / "out")).select("capture_seq", "recv_monotonic_ns").collect()) == [(1, 4), (2, 5)]


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = _frame(spark, [_book("AB"[k % 2], k, 10 * k, 0.4, 0.5) for k in range(12)] + [_book("A", 0, 0, 0.4, 0.5)])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    live.run_available(live.unchanged_dropped(stream), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.dropDuplicates(["leg", "market_id", "recv_ns"]).count()


def test_queries_and_sql_have_the_same_names():
    from tidemark import catalog

    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"fuzzy_candidates"} and set(catalog.oracle_sql()) <= set(catalog.queries())


def test_tiles_equal_windows_over_whole_series(spark):
    import random

    from pyspark.sql import Window

    from tidemark.operators import tiles

    r = random.Random(4)
    d = spark.createDataFrame([(f"k{r.randrange(3)}", r.randrange(0, 4000), k, r.randrange(-5, 6)) for k in range(2000)], "k string, t long, n long, x long")
    w = Window.partitionBy("k").orderBy("t", "n")
    for width in (10, 500, 10_000):
        cut = tiles.tiled(d, ["k"], F.col("t"), width)
        got = tiles.previous(cut, ["k"], ["t", "n"], {"pt": F.col("t"), "px": F.col("x")})
        got = tiles.running(got, ["k"], ["t", "n"], {"s": F.col("x"), "c": F.lit(1)})
        got = tiles.running(got, ["k"], ["t"], {"m": F.col("x")}, how="max")
        want = d.select("n", F.lag("t").over(w).alias("pt"), F.lag("x").over(w).alias("px"), F.sum("x").over(w).alias("s"), F.count("*").over(w).alias("c"), F.max("x").over(Window.partitionBy("k").orderBy("t")).alias("m"))
        assert sorted(map(tuple, got.select("n", "pt", "px", "s", "c", "m").collect())) == sorted(map(tuple, want.collect())), width


def test_runs_in_edge_over_tiles(spark):
    from tidemark.operators import reports

    rows = [("a", t * 40_000_000_000, t % 7 != 3) for t in range(60)]
    d = spark.createDataFrame(rows, "k string, t long, hit boolean")
    got = [r["run"] for r in reports.in_edge_runs(d, F.col("hit"), ["k"], ["t"]).orderBy("t").collect()]
    want, n = [], 0
    for _, _, hit in rows:
        n = n + 1 if hit else 0
        want.append(n)
    assert got == want
