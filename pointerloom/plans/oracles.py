"""SQL for the registered queries, in brute-force form.

Windows are joined with their events and steps are taken inside each window, so
the SQL shares no reasoning with the Spark plans. It runs on DuckDB.
"""

from __future__ import annotations

from pointerloom.plans.standins import UNIT_MS
from pointerloom.schema import DATASET_DIRS, FEATURES, LABELS, SOURCES

POINTERS = "('mousemove','mouseover','mousedown','mouseup','click')"
NO_SCREEN = "SELECT NULL::BIGINT AS session_id, NULL::DOUBLE vw, NULL::DOUBLE vh, NULL::DOUBLE dw, NULL::DOUBLE dh WHERE false"

EVENTS = f"""
ev AS (
  SELECT user_id AS session_id,
         ((epoch_us(ts) // 1000 - 1704067200000) // {UNIT_MS})::DOUBLE AS t,
         event_id AS tie,
         CASE event_type WHEN 'view' THEN 'mousemove' WHEN 'click' THEN 'click'
              WHEN 'purchase' THEN 'mouseover' WHEN 'signup' THEN 'scroll'
              WHEN 'error' THEN 'blur' END AS event,
         value AS x,
         CAST(json_extract(props, '$.k') AS DOUBLE) AS y
  FROM events)"""

SIDECARS = """
screens AS (
  SELECT c_custkey AS session_id,
         CASE c_custkey % 5 WHEN 1 THEN 1366.0 WHEN 2 THEN 1366.0 WHEN 3 THEN 1366.0 ELSE 800.0 END::DOUBLE AS vw,
         CASE c_custkey % 5 WHEN 1 THEN 768.0 WHEN 2 THEN 768.0 WHEN 3 THEN 768.0 ELSE 600.0 END::DOUBLE AS vh,
         CASE c_custkey % 5 WHEN 1 THEN 1349.0 WHEN 2 THEN 1024.0 WHEN 3 THEN 1366.0 ELSE 1366.0 END::DOUBLE AS dw,
         CASE c_custkey % 5 WHEN 1 THEN 2400.0 WHEN 2 THEN 1500.0 WHEN 3 THEN 2000.0 ELSE 2000.0 END::DOUBLE AS dh
  FROM customer WHERE c_custkey % 5 <> 0)"""


def clip(expr: str) -> str:
    return f"least(greatest({expr}, 0.0), 1.0)"


def ck(size=500, stride=250, horizon=1500, least=2, scrolls=4, screens: str | None = None) -> str:
    """CTEs up to ``ck_raw`` (unscaled) and ``ck`` (scaled and labelled)."""
    screens = screens or f"screens AS ({NO_SCREEN})"
    bins = ", ".join(
        f"count(*) FILTER (ang >= {lo} AND ang {'<=' if i == 7 else '<'} {hi}) AS b{i}"
        for i, (lo, hi) in enumerate(
            (f"(-pi() + {i} * pi() / 4)", f"(-pi() + {i + 1} * pi() / 4)") for i in range(8)
        )
    )
    total = "greatest(" + " + ".join(f"coalesce(b{i}, 0)" for i in range(8)) + ", 1)"
    entropy = " + ".join(
        f"CASE WHEN b{i} > 0 THEN (b{i}::DOUBLE / {total}) * log2(b{i}::DOUBLE / {total}) ELSE 0 END"
        for i in range(8)
    )
    return f"""{EVENTS}, {screens},
bounds AS (SELECT session_id, min(t) AS t0, max(t) AS t1 FROM ev GROUP BY session_id),
screen AS (
  SELECT b.session_id, coalesce(vw, 1366.0::DOUBLE) AS vw, coalesce(vh, 768.0::DOUBLE) AS vh,
         coalesce(dw, 1366.0::DOUBLE) AS dw, coalesce(dh, 2000.0::DOUBLE) AS dh
  FROM bounds b LEFT JOIN screens s ON s.session_id = b.session_id),
win AS (
  SELECT session_id, k, t0 + k * {stride} AS ws, t0 + k * {stride} + {size} AS we
  FROM bounds, generate_series(0, CAST(floor((t1 - t0 - {size}) / {stride}) AS BIGINT)) AS g(k)
  WHERE t1 - t0 >= {size}),
inside AS (
  SELECT w.session_id, w.k, e.t, e.tie, e.event, e.x, e.y
  FROM win w JOIN ev e ON e.session_id = w.session_id AND e.t >= w.ws AND e.t < w.we),
counted AS (
  SELECT w.session_id, w.k, w.ws, w.we, count(i.t) AS n,
         count(*) FILTER (i.event = 'mouseover') AS hovers,
         count(*) FILTER (i.event = 'scroll') AS scrolls
  FROM win w LEFT JOIN inside i ON i.session_id = w.session_id AND i.k = w.k
  GROUP BY ALL),
ptr AS (
  SELECT i.session_id, k, t, tie,
         (x / greatest(vw, 1.0) - lag(x / greatest(vw, 1.0)) OVER o) * vw AS dx,
         (y / greatest(vh, 1.0) - lag(y / greatest(vh, 1.0)) OVER o) * vh AS dy,
         t - lag(t) OVER o AS step
  FROM inside i JOIN screen s ON s.session_id = i.session_id
  WHERE event IN {POINTERS}
  WINDOW o AS (PARTITION BY i.session_id, k ORDER BY t, tie)),
seg AS (
  SELECT session_id, k, t, tie, CASE WHEN step <= 0 THEN 1.0 ELSE step END AS dt,
         sqrt(dx * dx + dy * dy) AS dist,
         sqrt(dx * dx + dy * dy) / CASE WHEN step <= 0 THEN 1.0 ELSE step END AS v,
         atan2(dy, dx) AS ang
  FROM ptr WHERE step IS NOT NULL),
seg2 AS (
  SELECT *, abs(v - lag(v) OVER o) / dt AS acc, abs(ang - lag(ang) OVER o) AS dang
  FROM seg WINDOW o AS (PARTITION BY session_id, k ORDER BY t, tie)),
moves AS (
  SELECT session_id, k, avg(v) AS mean_v, max(v) AS max_v, avg(acc) AS mean_acc,
         sum(dist) AS length,
         count(*) FILTER ((CASE WHEN dang > pi() THEN 2 * pi() - dang ELSE dang END) > pi() / 4) AS turns,
         {bins}
  FROM seg2 GROUP BY session_id, k),
ahead AS (
  SELECT w.session_id, w.k,
         count(*) FILTER (event IN ('click', 'mousedown')) AS clicks,
         count(*) FILTER (event = 'scroll') AS scrolls,
         count(*) FILTER (event = 'mouseover') AS hovers,
         count(*) FILTER (event IN ('beforeunload', 'blur')) AS exits
  FROM win w JOIN ev e
    ON e.session_id = w.session_id AND e.t >= w.we AND e.t < w.we + {horizon}
  GROUP BY w.session_id, w.k),
ck_raw AS (
  SELECT c.session_id, c.k AS window_idx, c.ws AS window_start, c.we AS window_end, c.n AS n_events,
         coalesce(mean_v, 0.0) AS meanVelocity, coalesce(max_v, 0.0) AS maxVelocity,
         coalesce(mean_acc, 0.0) AS meanAcceleration,
         coalesce(turns, 0)::DOUBLE AS hesitationCount,
         coalesce(length, 0.0) AS totalTrajectoryLength,
         c.hovers * 50.0::DOUBLE AS dwellTimeMs,
         least(100.0, c.scrolls * 50.0 / greatest(dh - vh, 1.0) * 100.0)::DOUBLE AS scrollDepthPercentage,
         (c.scrolls * 100.0::DOUBLE / {size}) AS scrollVelocity,
         CASE WHEN m.k IS NULL THEN 0.0 ELSE -({entropy}) / 3.0 + 0.0 END AS trajectoryEntropy,
         CASE WHEN a.clicks > 0 THEN 1 WHEN a.scrolls > {scrolls} THEN 4 WHEN a.hovers > 0 THEN 5
              WHEN a.exits > 0 THEN 3 ELSE 0 END AS label
  FROM counted c
  JOIN screen s ON s.session_id = c.session_id
  LEFT JOIN moves m ON m.session_id = c.session_id AND m.k = c.k
  LEFT JOIN ahead a ON a.session_id = c.session_id AND a.k = c.k
  WHERE c.n >= {least}),
ck AS (
  SELECT 'CK' AS source, session_id, window_idx, window_start, window_end,
         {clip('meanVelocity / 5.0')} AS meanVelocity, {clip('maxVelocity / 10.0')} AS maxVelocity,
         {clip('meanAcceleration / 0.1')} AS meanAcceleration,
         {clip('hesitationCount / 10.0')} AS hesitationCount,
         {clip('totalTrajectoryLength / 2000.0')} AS totalTrajectoryLength,
         {clip(f'dwellTimeMs / {size}')} AS dwellTimeMs,
         {clip('scrollDepthPercentage / 100.0')} AS scrollDepthPercentage,
         {clip('scrollVelocity / 5.0')} AS scrollVelocity,
         {clip('trajectoryEntropy')} AS trajectoryEntropy,
         label, n_events
  FROM ck_raw)"""


def _record_features(**given: str) -> str:
    return ", ".join(f"{given.get(f, '0.0')}::DOUBLE AS {f}" for f in FEATURES)


NO_BOUNDS = "NULL::DOUBLE AS window_start, NULL::DOUBLE AS window_end"


def hvt(max_rows=10**15, max_windows: int | None = None, velocity: bool = True) -> str:
    """CTEs up to ``hvt``."""
    speeds = (
        {"meanVelocity": clip("mean_v / 5.0"), "maxVelocity": clip("max_v / 10.0")}
        if velocity
        else {}
    )
    cap = "" if max_windows is None else f"WHERE nth <= {max_windows}"
    return f"""
hvt_rows AS (
  SELECT * FROM (
    SELECT l_suppkey AS session_id, l_quantity / 10 AS velocity, l_extendedprice / 500 AS distance,
           (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
                               l_partkey, l_quantity, l_extendedprice) - 1) AS r
    FROM lineitem)
  WHERE r < {max_rows}),
hvt_win AS (
  SELECT session_id, k
  FROM (SELECT session_id, max(r) * 50 AS t1 FROM hvt_rows GROUP BY session_id),
       generate_series(0, CAST(floor((t1 - 500) / 250.0) AS BIGINT)) AS g(k)
  WHERE t1 >= 500),
hvt_agg AS (
  SELECT w.session_id, w.k, count(*) AS n, avg(velocity) AS mean_v, max(velocity) AS max_v,
         sum(distance) AS length
  FROM hvt_win w JOIN hvt_rows r
    ON r.session_id = w.session_id AND r.r * 50 >= w.k * 250 AND r.r * 50 < w.k * 250 + 500
  GROUP BY w.session_id, w.k HAVING count(*) >= 2),
hvt_nth AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY k) AS nth FROM hvt_agg),
hvt AS (
  SELECT 'HVT' AS source, session_id, k AS window_idx, {NO_BOUNDS},
         {_record_features(**speeds, totalTrajectoryLength=clip('length / 2000.0'))},
         0 AS label
  FROM hvt_nth {cap})"""


HMI = f"""
hmi AS (
  SELECT 'HMI' AS source, session_id, rn - 1 AS window_idx, {NO_BOUNDS},
         {_record_features(meanVelocity='1.0')}, 1 AS label
  FROM (SELECT session_id, rn, lead(rn) OVER (PARTITION BY session_id ORDER BY rn) AS next
        FROM (SELECT o_custkey AS session_id,
                     row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
              FROM orders)
        WHERE rn >= 1)
  WHERE next IS NOT NULL)"""

AP = f"""
ap_lines AS (
  SELECT conv_id, turn, generate_subscripts(lines, 1) AS i, unnest(lines) AS line
  FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS lines FROM conversations)),
ap_bad AS (
  SELECT conv_id, turn, min(i) FILTER (length(line) <= 12) AS bad, max(i) AS last
  FROM ap_lines GROUP BY conv_id, turn),
ap_read AS (
  SELECT l.conv_id, l.turn, l.i - 1 AS pos, length(line) / 1000.0::DOUBLE AS seconds,
         CASE WHEN l.turn % 4 = 1 THEN 3 ELSE 0 END AS label
  FROM ap_lines l JOIN ap_bad b ON b.conv_id = l.conv_id AND b.turn = l.turn
  WHERE b.bad IS NULL OR l.i < b.bad
  UNION ALL
  SELECT conv_id, turn, last AS pos, 9.0 AS seconds, 3 AS label
  FROM ap_bad WHERE turn % 4 = 3 AND bad IS NULL),
ap AS (
  SELECT 'AP' AS source, conv_id || '/' || turn AS session_id, pos::BIGINT AS window_idx, {NO_BOUNDS},
         {_record_features(dwellTimeMs=clip('seconds * 1000.0 / 500.0'))}, label
  FROM ap_read)"""


def _columns(*names: str, rounds: int = 9) -> str:
    return ", ".join(names + tuple(f"round({f}, {rounds}) + 0.0 AS {f}" for f in FEATURES))


SAMPLE = _columns("source", "session_id", "window_idx", "window_start", "window_end")
PLAIN = ", ".join(("window_idx", "window_start", "window_end", *FEATURES, "label"))

ALL = f"""{ck()}, {hvt()}, {HMI}, {AP},
samples AS (
  SELECT source, session_id::VARCHAR AS session_id, {PLAIN}, 0 AS source_rank FROM ck
  UNION ALL SELECT source, session_id::VARCHAR, {PLAIN}, 1 FROM hvt
  UNION ALL SELECT source, session_id::VARCHAR, {PLAIN}, 2 FROM hmi
  UNION ALL SELECT source, session_id, {PLAIN}, 3 FROM ap)"""

SESSION_RUNS = f"""{ck(horizon=125, scrolls=1)},
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY window_idx) AS rn,
         row_number() OVER (ORDER BY session_id, window_idx) - 1 AS idx
  FROM ck)"""

GLOBAL_RUNS = f"""{ALL},
ordered AS (
  SELECT *, row_number() OVER (ORDER BY source_rank, session_id, window_idx) - 1 AS idx FROM samples),
runs AS (
  SELECT o.idx - 7 AS seq_id, (s.idx - (o.idx - 7))::INTEGER AS pos,
         {", ".join(f"s.{f}" for f in FEATURES)}, o.label
  FROM ordered o JOIN generate_series(0, 7) g(p) ON true
  JOIN ordered s ON s.idx = o.idx - 7 + p
  WHERE o.idx >= 7)"""

TWO_DECIMAL_SCORE = {
    c: " + ".join(f"{f} * ({(((9 * c + j) * 7) % 11 - 5)} / 5.0::DOUBLE)" for j, f in enumerate(FEATURES))
    for c in range(6)
}


def _unpivoted(keys: str = "source") -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{f}' AS feature, {f} AS value FROM samples" for f in FEATURES
    )


def _corr_rows() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b,
            CASE WHEN min({a}) = max({a}) OR min({b}) = max({b}) THEN NULL
                 ELSE round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 6) + 0.0 END AS corr
            FROM samples"""
        for a in FEATURES
        for b in FEATURES
    )


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


_LABEL_NAMES = " ".join(f"WHEN {code} THEN '{name}'" for name, code in LABELS.items())

HOT_SESSION = "CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS session_id"


def _skewed(sql: str) -> str:
    """The same query with every third user in one session."""
    return sql.replace("user_id AS session_id", HOT_SESSION)


def _session_all() -> str:
    return _with(
        f"""{ALL},
ordered AS (
  SELECT *, row_number() OVER (ORDER BY source_rank, session_id, window_idx) - 1 AS idx,
         row_number() OVER (PARTITION BY source, session_id ORDER BY window_idx) AS rn
  FROM samples)""",
        f"""SELECT o.idx - 7 AS seq_id, (s.rn - (o.rn - 7))::INTEGER AS pos,
                   {", ".join(f"round(s.{f}, 9) + 0.0 AS {f}" for f in FEATURES)}, o.label
            FROM ordered o JOIN ordered s
              ON s.source = o.source AND s.session_id = o.session_id AND s.rn BETWEEN o.rn - 7 AND o.rn
            WHERE o.rn >= 8""",
    )


ORACLES: dict[str, str] = {
    "ck_events": _with(
        EVENTS,
        f"""
, marked AS (SELECT *, event IN {POINTERS} AS is_ptr FROM ev),
step AS (
  SELECT *, x - lag(x) OVER o AS dx, y - lag(y) OVER o AS dy,
         CASE WHEN t - lag(t) OVER o <= 0 THEN 1.0 ELSE t - lag(t) OVER o END AS dt
  FROM marked WHERE is_ptr WINDOW o AS (PARTITION BY session_id ORDER BY t, tie)),
moved AS (SELECT *, sqrt(dx * dx + dy * dy) AS dist, sqrt(dx * dx + dy * dy) / dt AS v,
                 atan2(dy, dx) AS ang FROM step),
twice AS (SELECT *, abs(v - lag(v) OVER o) / dt AS acc, abs(ang - lag(ang) OVER o) AS d
          FROM moved WINDOW o AS (PARTITION BY session_id ORDER BY t, tie))
SELECT m.session_id, m.tie AS event_id, m.t, m.event, m.is_ptr, dt, round(dist, 9) AS dist,
       round(v, 9) AS v, round(ang, 9) + 0.0 AS ang, round(acc, 9) AS acc,
       round(CASE WHEN d > pi() THEN 2 * pi() - d ELSE d END, 9) AS turn,
       CASE WHEN ang IS NOT NULL
            THEN least(7, CAST(floor((ang + pi()) / (pi() / 4)) AS INTEGER)) END AS bin
FROM marked m LEFT JOIN twice s ON s.tie = m.tie""",
    ),
    "ck_windows": _with(
        ck(), "SELECT session_id, window_idx, window_start, window_end, n_events FROM ck"
    ),
    "ck_all_windows": _with(
        ck(least=0), "SELECT session_id, window_idx, window_start, window_end, n_events FROM ck"
    ),
    "micro_tensor": _with(ck(), f"SELECT {SAMPLE}, label, n_events FROM ck"),
    "raw_micro_tensor": _with(
        ck(), f"SELECT {_columns('session_id', 'window_idx', rounds=6)} FROM ck_raw"
    ),
    "uneven_windows": _with(
        ck(stride=200, horizon=350), f"SELECT {SAMPLE}, label, n_events FROM ck"
    ),
    "viewport_join": _with(
        f"{EVENTS}, {SIDECARS}",
        """SELECT DISTINCT e.session_id, coalesce(vw, 1366.0::DOUBLE) AS vp_w,
                  coalesce(vh, 768.0::DOUBLE) AS vp_h, coalesce(dw, 1366.0::DOUBLE) AS doc_w,
                  coalesce(dh, 2000.0::DOUBLE) AS doc_h
           FROM ev e LEFT JOIN screens s ON s.session_id = e.session_id""",
    ),
    "micro_tensor_viewport": _with(
        ck(screens=SIDECARS), f"SELECT {SAMPLE}, label, n_events FROM ck"
    ),
    "ck_labels": _with(
        ck(horizon=125, scrolls=1),
        f"SELECT session_id, window_idx, label, CASE label {_LABEL_NAMES} END AS label_name FROM ck",
    ),
    "hvt_windows": _with(hvt(), f"SELECT {SAMPLE}, label FROM hvt"),
    "hvt_capped": _with(hvt(300, 40), f"SELECT {SAMPLE}, label FROM hvt"),
    "hvt_without_velocity": _with(hvt(velocity=False), f"SELECT {SAMPLE}, label FROM hvt"),
    "hmi_samples": _with(HMI, f"SELECT {SAMPLE}, label FROM hmi"),
    "ap_samples": _with(AP, f"SELECT {SAMPLE}, label FROM ap"),
    "all_samples": _with(ALL, f"SELECT {SAMPLE}, label, source_rank FROM samples"),
    "sequences_session": _with(
        SESSION_RUNS,
        f"""SELECT o.session_id, o.window_idx, (s.rn - (o.rn - 7))::INTEGER AS pos,
                   {", ".join(f"round(s.{f}, 9) + 0.0 AS {f}" for f in FEATURES)}, o.label
            FROM ordered o JOIN ordered s
              ON s.session_id = o.session_id AND s.rn BETWEEN o.rn - 7 AND o.rn
            WHERE o.rn >= 8""",
    ),
    "sequences_global": _with(GLOBAL_RUNS, f"SELECT {_columns('seq_id', 'pos')}, label FROM runs"),
    "sequences_first": _with(
        GLOBAL_RUNS, f"SELECT {_columns('seq_id', 'pos')}, label FROM runs WHERE seq_id < 1000"
    ),
    "source_counts": _with(
        ALL,
        f"""SELECT l.source, count(s.source) AS n_samples
            FROM (VALUES {", ".join(f"('{s}')" for s in SOURCES)}) AS l(source)
            LEFT JOIN samples s ON s.source = l.source GROUP BY l.source""",
    ),
    "feature_corr": _with(ALL, _corr_rows()),
    "feature_density": _with(
        ALL,
        """, vals AS (
             SELECT source, 'meanVelocity' AS feature, meanVelocity AS v FROM samples
             UNION ALL SELECT source, 'hesitationCount', hesitationCount FROM samples),
           shape AS (
             SELECT source, feature, count(*) AS n, min(v) AS lo, max(v) AS hi,
                    stddev_samp(v) * pow(count(*)::DOUBLE, -0.2) AS h
             FROM vals GROUP BY source, feature HAVING max(v) > min(v)),
           grid AS (
             SELECT source, feature, n, h, p::INTEGER AS point,
                    lo - 3 * h + p * ((hi + 3 * h) - (lo - 3 * h)) / 199 AS x
             FROM shape, generate_series(0, 199) g(p))
           SELECT g.source, g.feature, g.point, round(any_value(x), 6) + 0.0 AS x,
                  round(sum(exp(-0.5 * ((x - v) / h) ** 2)) / any_value(n * h * sqrt(2 * pi())), 6) + 0.0
                    AS density
           FROM grid g JOIN vals v ON v.source = g.source AND v.feature = g.feature
           GROUP BY g.source, g.feature, g.point""",
    ),
    "feature_range": _with(
        ALL,
        f"""SELECT source, feature, round(min(value), 6) + 0.0 AS lowest,
                   round(max(value), 6) + 0.0 AS highest,
                   round(count(*) FILTER (value = 0) / count(*)::DOUBLE, 6) AS share_at_0,
                   round(count(*) FILTER (value = 1) / count(*)::DOUBLE, 6) AS share_at_1,
                   count(*) FILTER (value IS NULL) AS n_missing
            FROM ({_unpivoted()}) GROUP BY source, feature""",
    ),
    "epoch_metrics": _with(
        SESSION_RUNS,
        f""", s AS (
             SELECT label, {", ".join(f"{e} AS s{c}" for c, e in TWO_DECIMAL_SCORE.items())}
             FROM ordered WHERE rn >= 8),
           m AS (SELECT *, greatest(s0, s1, s2, s3, s4, s5) AS top FROM s),
           e AS (
             SELECT label, top, s0, s1, s2, s3, s4, s5,
                    exp(s0 - top) + exp(s1 - top) + exp(s2 - top) + exp(s3 - top)
                      + exp(s4 - top) + exp(s5 - top) AS mass,
                    CASE label WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3
                               WHEN 4 THEN s4 ELSE s5 END AS own,
                    CASE WHEN s0 = top THEN 0 WHEN s1 = top THEN 1 WHEN s2 = top THEN 2
                         WHEN s3 = top THEN 3 WHEN s4 = top THEN 4 ELSE 5 END AS pred
             FROM m)
           SELECT count(*) AS n, round(avg(-ln(exp(own - top) / mass)), 6) AS loss,
                  round(100.0 * avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
           FROM e""",
    ),
    "metric_gate": """
        WITH m AS (
          SELECT avg(l_extendedprice / 1e6) AS mean,
                 quantile_cont(l_extendedprice / 1e6, 0.95)::DOUBLE AS p95 FROM lineitem)
        SELECT 'avg_latency_ms' AS metric, round(mean, 6) AS value, 50.0::DOUBLE AS "limit",
               mean < 50 AS passed FROM m
        UNION ALL
        SELECT 'p95_latency_ms', round(p95, 6), 0.05::DOUBLE, p95 < 0.05 FROM m""",
    "shuffled_batches": _with(
        SESSION_RUNS,
        """, drawn AS (
             SELECT idx - 7 AS seq_id, label,
                    row_number() OVER (ORDER BY md5('0:0:' || (idx - 7)), idx) - 1 AS nth
             FROM ordered WHERE rn >= 8)
           SELECT seq_id, label, nth // 64 AS batch_id, (nth % 64)::INTEGER AS batch_pos FROM drawn""",
    ),
    "read_ck_files": _with(EVENTS, 'SELECT t AS "timestamp", event, x AS xpos, y AS ypos FROM ev'),
    "read_hvt_files": "SELECT l_quantity / 10 AS velocity, l_extendedprice / 500 AS distance FROM lineitem",
    "read_hmi_files": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS epoch FROM orders",
    "resolve_sources": f"""
        SELECT l.source, coalesce(n > 0, false) AS present, coalesce(n > 0, false) AS has_bytes
        FROM (VALUES {", ".join(f"('{s}')" for s in DATASET_DIRS)}) AS l(source)
        LEFT JOIN (SELECT 'CK' AS source, count(*) AS n FROM events
                   UNION ALL SELECT 'HMI', count(*) FROM orders) c ON c.source = l.source""",
}

ORACLES |= {
    "micro_tensor_skewed": _skewed(ORACLES["micro_tensor"]),
    "ck_events_skewed": _skewed(ORACLES["ck_events"]),
    "hvt_large_key": ORACLES["hvt_windows"]
    .replace("l_suppkey AS session_id", "0 AS session_id")
    .replace("PARTITION BY l_suppkey", "PARTITION BY 0"),
    "hmi_large_key": ORACLES["hmi_samples"]
    .replace("o_custkey AS session_id", "0 AS session_id")
    .replace("PARTITION BY o_custkey", "PARTITION BY 0"),
    "sequences_small_buckets": ORACLES["sequences_global"],
    "sequences_session_all": _session_all(),
}


def _filled(rows: int, columns: int) -> str:
    """SQL of a matrix, as a list of rows, by the formula of the queries' fixed weights."""
    cell = f"((r * {columns} + c) * 7 % 23 - 11) / 50.0::DOUBLE"
    return f"list_transform(range({rows}), lambda r: list_transform(range({columns}), lambda c: {cell}))"


def _gates(layer: int, x: str, h: str) -> list[str]:
    """Columns with what the input and the state give to the three gates of a layer."""
    both = []
    for name, matrix, vector in (("gi", f"w_ih_{layer}", x), ("gh", f"w_hh_{layer}", h)):
        product = f"list_transform({matrix}, lambda w: list_dot_product(w, {vector}))"
        both.append(f"list_transform(list_zip({product}, bias), lambda p: p[1] + p[2]) AS {name}")
    return both


def _state(h: str) -> str:
    """The next state of a layer from ``gi``, ``gh`` and the state before."""
    sigmoid = lambda k: f"(1.0 / (1.0 + exp(-(gi[i + {k}] + gh[i + {k}]))))"
    candidate = f"tanh(gi[i + 64] + {sigmoid(0)} * gh[i + 64])"
    return (
        f"list_transform(range(1, 33), lambda i: {candidate} + {sigmoid(32)} * ({h}[i] - {candidate}))"
    )


_RUN_LISTS = f"""
runs AS (
  SELECT o.idx - 7 AS seq_id, any_value(o.label) AS label,
         list([{", ".join(f"s.{f}" for f in FEATURES)}] ORDER BY s.rn) AS steps
  FROM ordered o JOIN ordered s ON s.session_id = o.session_id AND s.rn BETWEEN o.rn - 7 AND o.rn
  WHERE o.rn >= 8 GROUP BY o.idx)"""

_GRU = f"""WITH RECURSIVE {SESSION_RUNS}, {_RUN_LISTS},
weights AS (
  SELECT {_filled(96, 9)} AS w_ih_0, {_filled(96, 32)} AS w_hh_0, {_filled(96, 32)} AS w_ih_1,
         {_filled(96, 32)} AS w_hh_1, {_filled(1, 96)}[1] AS bias,
         {_filled(6, 32)} AS w_out, {_filled(1, 6)}[1] AS b_out),
walk AS (
  SELECT seq_id, 0 AS step, list_transform(range(32), lambda i: 0.0::DOUBLE) AS h0,
         list_transform(range(32), lambda i: 0.0::DOUBLE) AS h1
  FROM runs
  UNION ALL
  SELECT seq_id, step + 1, h0, {_state("h1")}
  FROM (
    SELECT seq_id, step, h0, h1, {", ".join(_gates(1, "h0", "h1"))}
    FROM (
      SELECT * EXCLUDE (h0, gi, gh), {_state("h0")} AS h0
      FROM (
        SELECT k.seq_id, k.step, k.h0, k.h1, w_ih_1, w_hh_1, bias,
               {", ".join(_gates(0, "steps[step + 1]", "h0"))}
        FROM walk k JOIN runs r ON r.seq_id = k.seq_id, weights
        WHERE step < 8)))),
ends AS (
  SELECT k.seq_id, label, list_transform(range(1, 7), lambda c: list_dot_product(w_out[c], h1) + b_out[c]) AS s
  FROM walk k JOIN runs r ON r.seq_id = k.seq_id, weights WHERE step = 8)
SELECT seq_id, label, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS prediction,
       {", ".join(f"round(s[{c + 1}], 6) + 0.0 AS score_{c}" for c in range(6))}
FROM ends"""

ORACLES |= {
    "gru_scores": _GRU,
    "mlp_fit": f"""WITH {SESSION_RUNS}
SELECT CAST(e AS INTEGER) AS iteration, (SELECT count(*) FROM ordered WHERE rn >= 8) AS n_runs,
       e > 1 AS below_first, true AS beats_even_odds
FROM generate_series(1, 5) g(e)""",
}

_SCORED = f"""{SESSION_RUNS},
raw AS (SELECT label, {", ".join(f"({TWO_DECIMAL_SCORE[c]}) * 2000.0 AS s{c}" for c in range(6))}
        FROM ordered WHERE rn >= 8),
best AS (SELECT *, greatest({", ".join(f"s{c}" for c in range(6))}) AS top FROM raw),
judged AS (
  SELECT label, CASE {" ".join(f"WHEN s{c} = top THEN {c}" for c in range(6))} END AS prediction,
         -(CASE label {" ".join(f"WHEN {c} THEN s{c}" for c in range(6))} END - top
           - ln({" + ".join(f"exp(s{c} - top)" for c in range(6))})) AS loss
  FROM best)"""

ORACLES |= {
    "read_ck_order": f"""WITH {EVENTS}
SELECT session_id, t AS timestamp, row_number() OVER (PARTITION BY session_id ORDER BY tie) - 1 AS tie,
       event, x AS xpos, y AS ypos FROM ev""",
    "read_hvt_order": f"""WITH {hvt()}
SELECT session_id, r AS row_idx, velocity, distance FROM hvt_rows""",
    "hmi_delimiters": """
SELECT CAST(month(o_orderdate) AS BIGINT) AS month, strftime(o_orderdate, '%Y-%m-%d') AS epoch
FROM orders WHERE month(o_orderdate) % 6 <> 2""",
    "read_ap_files": f"""
SELECT 'AP' AS source, conv_id AS session_id,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS window_idx, {NO_BOUNDS},
       {_record_features(dwellTimeMs="round(" + clip("length(text) / 1000.0 * 1000.0 / 500.0") + ", 9)")},
       CASE WHEN turn > 0 THEN 3 ELSE 0 END AS label
FROM conversations""",
    "sink_round_trip": _with(
        ALL,
        f"""SELECT source, session_id, window_idx,
                   {", ".join(f"round({f}::FLOAT::DOUBLE, 9) + 0.0 AS {f}" for f in FEATURES)}, label
            FROM samples""",
    ),
    "chosen_files": """
WITH files AS (
  SELECT DISTINCT CAST(month(o_orderdate) AS BIGINT) AS month,
         CASE WHEN month(o_orderdate) % 2 = 0 THEN 'raw_interactions' ELSE 'other' END AS folder FROM orders)
SELECT 'named' AS choice, folder, month FROM files
UNION ALL
SELECT * FROM (SELECT 'capped', folder, month FROM files ORDER BY folder, month::VARCHAR LIMIT 5)""",
    "files_to_samples": _with(
        f"{ck()}, {hvt()}",
        f"""SELECT {SAMPLE}, label FROM (
              SELECT source, session_id, {PLAIN} FROM ck
              UNION ALL SELECT source, session_id, {PLAIN} FROM hvt)""",
    ),
    "size_gate": """
WITH m AS (SELECT unnest(['file_size_mb', 'large_size_mb']) AS metric,
                  unnest([count(*) / 1000.0::DOUBLE, count(*)::DOUBLE]) AS value FROM orders)
SELECT metric, round(value, 6) AS value, 20.0::DOUBLE AS "limit", value < 20 AS passed FROM m""",
    "epoch_metrics_far": _with(
        _SCORED,
        """SELECT prediction, count(*) AS n, round(avg(loss), 6) + 0.0 AS loss,
                  round(avg(CASE WHEN prediction = label THEN 100.0 ELSE 0 END), 6) AS accuracy
           FROM judged GROUP BY prediction""",
    ),
}
