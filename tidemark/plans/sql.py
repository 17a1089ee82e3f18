"""SQL of the bridge and of the derived tables, for comparison with the Spark plans."""

from tidemark.sources.bridge import BOOKS_SQL, LEVELS, PAIRS_SQL, PROBES_SQL


def _side(leg: str, name: str, source: str) -> str:
    """Ladder rows (k, direction, lvl, px, lo, hi) of one leg in both directions."""
    parts = []
    for d, side in (("a_yes_b_no", "ask" if leg == "a" else "bid"), ("a_no_b_yes", "bid" if leg == "a" else "ask")):
        for i in range(1, LEVELS + 1):
            px = f"{source}.{side}_px_{i}" if side == "ask" else f"1.0 - {source}.{side}_px_{i}"
            parts.append(f"SELECT k, '{d}' AS direction, {i} AS lvl, {px} AS px, {source}.{side}_sz_{i} AS sz FROM matched")
    return f"{name} AS (SELECT k, direction, px, sum(sz) OVER w - sz AS lo, sum(sz) OVER w AS hi FROM ({' UNION ALL '.join(parts)}) WINDOW w AS (PARTITION BY k, direction ORDER BY lvl))"


MATCHED = f"""{BOOKS_SQL}, {PAIRS_SQL},
a AS (SELECT p.pair_key, p.include, b.* FROM books b JOIN pairs p ON b.leg = 'A' AND b.market_id = p.a_market),
b AS (SELECT p.pair_key, b.* FROM books b JOIN pairs p ON b.leg = 'B' AND b.market_id = p.b_market QUALIFY row_number() OVER (PARTITION BY pair_key, recv_ns ORDER BY capture_seq DESC) = 1),
back AS (SELECT a.capture_seq AS k, b.capture_seq AS s, b.recv_ns AS t FROM a ASOF JOIN b ON a.pair_key = b.pair_key AND a.recv_ns >= b.recv_ns),
ahead AS (SELECT a.capture_seq AS k, b.capture_seq AS s, b.recv_ns AS t FROM a ASOF JOIN b ON a.pair_key = b.pair_key AND a.recv_ns <= b.recv_ns),
pick AS (SELECT a.capture_seq AS k, CASE WHEN n.t IS NOT NULL AND (p.t IS NULL OR n.t - a.recv_ns <= a.recv_ns - p.t) THEN n.s ELSE p.s END AS s
         FROM a LEFT JOIN back p ON a.capture_seq = p.k LEFT JOIN ahead n ON a.capture_seq = n.k),
matched AS (SELECT a.capture_seq AS k, a AS l, b AS r FROM pick JOIN a ON a.capture_seq = pick.k JOIN b ON b.capture_seq = pick.s WHERE abs(a.recv_ns - b.recv_ns) <= 5000000000)"""

EDGES = f"""{MATCHED},
{_side('a', 'sa', 'l')}, {_side('b', 'sb', 'r')},
ch AS (SELECT sa.k, sa.direction, sa.px AS pa, sb.px AS pb, greatest(sa.lo, sb.lo) AS lo, least(sa.hi, sb.hi) AS hi
       FROM sa JOIN sb ON sa.k = sb.k AND sa.direction = sb.direction WHERE least(sa.hi, sb.hi) - greatest(sa.lo, sb.lo) > 1e-12),
dp AS (SELECT k, direction, sum(greatest(0.0, least(hi, 1.0) - lo)) AS filled, sum(greatest(0.0, least(hi, 1.0) - lo) * pa) AS ca, sum(greatest(0.0, least(hi, 1.0) - lo) * pb) AS cb,
       sum(CASE WHEN 1.0::DOUBLE - (pa + pb) - 0.02::DOUBLE > 0 THEN hi - lo ELSE 0.0 END) AS good FROM ch GROUP BY k, direction),
edges AS (
  SELECT l.pair_key AS pair_key, l.capture_ts AS capture_ts, l.recv_ns AS recv_ns, l.capture_seq AS a_seq, r.capture_seq AS b_seq, greatest(l.capture_seq, r.capture_seq)::DOUBLE AS source_seq,
         (l.recv_ns - r.recv_ns) / 1e6::DOUBLE AS skew_ms, l.status AS a_status, r.status AS b_status, greatest(l.staleness_s, r.staleness_s) AS max_staleness_s,
         CASE WHEN l.status = 'stale' OR r.status = 'stale' THEN false WHEN l.status = 'fresh' AND r.status = 'fresh' THEN true END AS books_fresh, l.include AS include,
         direction, raw_edge, raw_edge - 0.02::DOUBLE AS fee_adj_edge, filled AS depth_fillable_size, filled + 1e-12 >= 1.0 AS depth_complete,
         (ca + cb) / filled AS vwap, ca / filled AS a_vwap, cb / filled AS b_vwap, raw_edge - (1.0::DOUBLE - (ca + cb) / filled) AS slippage,
         1.0::DOUBLE - (ca + cb) / filled - 0.02::DOUBLE AS depth_adj_edge, good AS max_profitable_size
  FROM (SELECT m.*, dp.direction, dp.filled, dp.ca, dp.cb, dp.good, CASE WHEN dp.direction = 'a_yes_b_no' THEN r.best_bid - l.best_ask ELSE l.best_bid - r.best_ask END AS raw_edge
        FROM matched m JOIN dp ON m.k = dp.k))"""

GATE = "coalesce(books_fresh AND abs(skew_ms) < 250 AND round(fee_adj_edge, 9) >= 0.01 AND round(depth_adj_edge, 9) >= 0.01 AND max_profitable_size >= 1, false)"

MARKET = "split_part(pair_key, '|', 1)"

PERSISTENCE = f"""pers AS (
  SELECT *, in_edge_cycles / total_cycles::DOUBLE > 0.25 AS is_basis
  FROM (SELECT {MARKET} AS market, count(DISTINCT capture_ts) AS total_cycles, count(DISTINCT CASE WHEN {GATE} THEN capture_ts END) AS in_edge_cycles FROM edges GROUP BY 1))"""

TIER = "CASE WHEN through_ms IS NULL THEN NULL WHEN through_ms >= 1000 THEN 'survived_1000ms' WHEN through_ms >= 500 THEN 'survived_500ms' WHEN through_ms >= 250 THEN 'survived_250ms' WHEN through_ms >= 100 THEN 'survived_100ms' WHEN through_ms >= 25 THEN 'survived_25ms' ELSE 'expired_lt_250ms' END"

LADDERS = f"""{PROBES_SQL},
lad AS (SELECT *, {TIER} AS tier FROM (
  SELECT pair_key, direction, ladder, max(CASE WHEN ok THEN benchmark_ms END) AS through_ms, count(*) AS rungs
  FROM (SELECT *, bool_and(survived) OVER (PARTITION BY pair_key, direction, ladder ORDER BY benchmark_ms, seq ROWS UNBOUNDED PRECEDING) AS ok FROM probes) GROUP BY 1, 2, 3))"""


def episodes(gap: float) -> str:
    """EDGES, PERSISTENCE, LADDERS and the episodes with bucket and score."""
    return f"""{EDGES}, {PERSISTENCE}, {LADDERS},
best AS (SELECT pair_key, direction, through_ms, {TIER} AS tier FROM (SELECT pair_key, direction, max(through_ms) AS through_ms FROM lad GROUP BY 1, 2)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY pair_key, direction ORDER BY capture_ts) AS session FROM (
  SELECT *, CASE WHEN epoch_us(capture_ts) - epoch_us(lag(capture_ts) OVER (PARTITION BY pair_key, direction ORDER BY capture_ts)) > {int(gap * 1e6)} THEN 1 ELSE 0 END AS new FROM edges WHERE {GATE})),
ep0 AS (SELECT pair_key, direction, session, min(capture_ts) AS start_ts, max(capture_ts) AS end_ts, count(*) AS snapshots, max(fee_adj_edge) AS peak_edge, median(fee_adj_edge) AS median_edge,
        median(depth_adj_edge) AS median_depth_edge, max(max_profitable_size) AS max_fill_size, max(abs(skew_ms)) AS max_abs_skew_ms FROM runs GROUP BY 1, 2, 3),
ep1 AS (SELECT e.*, (epoch_us(end_ts) - epoch_us(start_ts)) / 1e6::DOUBLE AS duration_s, split_part(e.pair_key, '|', 1) AS market, coalesce(p.is_basis, false) AS is_basis, b.through_ms, b.tier,
        count(*) OVER (PARTITION BY e.pair_key, e.direction) AS recurrence
        FROM ep0 e LEFT JOIN pers p ON split_part(e.pair_key, '|', 1) = p.market LEFT JOIN best b ON e.pair_key = b.pair_key AND e.direction = b.direction),
eps AS (SELECT *, CASE WHEN is_basis THEN 'basis_suspect' WHEN snapshots < 2 OR coalesce(tier, '') = 'expired_lt_250ms' THEN 'unusable' ELSE 'transient_candidate' END AS bucket,
        greatest(median_depth_edge, 0.0) * 100.0 * CASE WHEN tier IS NULL THEN 0.5 WHEN tier = 'survived_1000ms' THEN 0.8 WHEN tier = 'survived_500ms' THEN 0.5 WHEN tier = 'survived_250ms' THEN 0.25 ELSE 0.0 END
          * (1.0 + ln(1.0 + recurrence - 1)) * log10(least(greatest(max_fill_size, 1.0), 1000.0) + 1.0)
          - CASE WHEN is_basis THEN 5.0 ELSE 0.0 END - max_abs_skew_ms / 250.0 * 0.5 - CASE WHEN snapshots >= 2 THEN 0.0 ELSE greatest(median_depth_edge, 0.0) * 50.0 END AS score FROM ep1)"""
