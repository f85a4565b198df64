import math
import random

import pytest
from pyspark.sql import functions as F

from pointerloom.operators.kinematics import kinematic_steps, micro_tensor, window_totals
from pointerloom.schema import FEATURES

EVENTS = "session_id string, timestamp double, tie long, event string, xpos double, ypos double"
NAMES = ["mousemove"] * 6 + ["click", "mouseover", "mousedown", "mouseup", "scroll", "blur", "focus"]


def frame(spark, rows):
    """Rows ``(session, t, event, x, y)``, ties in the given order."""
    return spark.createDataFrame([(s, t, i, e, x, y) for i, (s, t, e, x, y) in enumerate(rows)], EVENTS)


def session(seed, n, span, missing=0.0):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = None if rng.random() < missing else float(rng.randrange(60))
        rows.append((float(rng.randrange(span)), rng.choice(NAMES), x, float(rng.randrange(60))))
    return sorted(rows, key=lambda r: r[0])


def collected(df):
    return {
        (r.session_id, r.window_idx): ([r[f] for f in FEATURES], r.label, r.window_start, r.n_events)
        for r in df.collect()
    }


def same(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, abs=1e-12)


def assert_same(got, want):
    assert set(got) == set(want)
    for key in want:
        assert got[key][1] == want[key][1], key
        assert all(same(x, y) for x, y in zip(got[key][0], want[key][0])), key


def flat(sessions):
    return [(s, *row) for s, rows in sessions.items() for row in rows]


def test_two_points(spark):
    rows = [("a", 0.0, "mousemove", 0.0, 0.0), ("a", 10.0, "mousemove", 3.0, 4.0),
            ("a", 600.0, "blur", 0.0, 0.0)]
    got = collected(micro_tensor(frame(spark, rows)))
    features, label, start, n = got["a", 0]
    assert list(got) == [("a", 0)] and start == 0.0 and n == 2 and label == 3
    assert features == pytest.approx([0.1, 0.05, 0, 0, 5 / 2000, 0, 0, 0, 0])


def test_equal_times_count_as_one_ms(spark):
    rows = [("a", 0.0, "mousemove", 0.0, 0.0), ("a", 0.0, "mousemove", 3.0, 4.0),
            ("a", 500.0, "scroll", 0.0, 0.0)]
    assert collected(micro_tensor(frame(spark, rows)))["a", 0][0][:2] == pytest.approx([1.0, 0.5])


def test_angle_wraps_and_turn_limit(spark):
    # Angles of 170 and -170 degrees are 20 degrees apart: no hesitation.
    points = [(0, 0), (math.cos(math.radians(170)), math.sin(math.radians(170)))]
    points.append((points[1][0] + math.cos(math.radians(-170)), points[1][1] + math.sin(math.radians(-170))))
    rows = [("a", 10.0 * i, "mousemove", *map(float, p)) for i, p in enumerate(points)]
    rows.append(("a", 500.0, "focus", 0.0, 0.0))
    assert collected(micro_tensor(frame(spark, rows)))["a", 0][0][3] == 0.0
    turned = rows[:2] + [("a", 20.0, "mousemove", 0.0, 0.0), rows[-1]]
    assert collected(micro_tensor(frame(spark, turned)))["a", 0][0][3] == pytest.approx(0.1)


def test_last_event_and_window_edge(spark):
    # The event at 500 closes the first window and lies in no window itself.
    rows = [("a", t, "scroll", 0.0, 0.0) for t in (0.0, 499.0, 500.0)]
    got = collected(micro_tensor(frame(spark, rows)))
    assert list(got) == [("a", 0)] and got["a", 0][3] == 2
    short = [("a", t, "scroll", 0.0, 0.0) for t in (0.0, 250.0, 499.0)]
    assert collected(micro_tensor(frame(spark, short))) == {}


def test_scrolls_alone(spark):
    rows = [("a", float(t), "scroll", None, None) for t in (0, 10, 20)] + [("a", 500.0, "blur", None, None)]
    features = collected(micro_tensor(frame(spark, rows)))["a", 0][0]
    assert features[:6] == [0.0] * 6 and features[8] == 0.0
    assert features[6] == pytest.approx(150 / 1232) and features[7] == pytest.approx(0.12)


@pytest.mark.parametrize("events,label", [
    (["scroll"] * 5 + ["click"], 1), (["mousedown"], 1), (["scroll"] * 5 + ["mouseover"], 4),
    (["scroll"] * 4 + ["mouseover"], 5), (["beforeunload"], 3), (["blur"], 3), (["scroll"] * 4, 0),
    (["mousemove"], 0),
])
def test_first_rule_wins(spark, events, label):
    rows = [("a", 0.0, "mousemove", 0.0, 0.0), ("a", 1.0, "mousemove", 1.0, 1.0)]
    rows += [("a", 500.0, e, 0.0, 0.0) for e in events]
    assert collected(micro_tensor(frame(spark, rows)))["a", 0][1] == label


def test_horizon_is_half_open(spark):
    rows = [("a", 0.0, "mousemove", 0.0, 0.0), ("a", 1.0, "mousemove", 1.0, 1.0),
            ("a", 2000.0, "click", 0.0, 0.0)]
    assert collected(micro_tensor(frame(spark, rows)))["a", 0][1] == 0


def test_missing_time_is_left_out(spark):
    rows = [("a", 0.0, "scroll", 0.0, 0.0), ("a", None, "click", 0.0, 0.0), ("a", 1.0, "scroll", 0.0, 0.0),
            ("a", float("nan"), "click", 0.0, 0.0), ("a", 500.0, "blur", 0.0, 0.0)]
    got = collected(micro_tensor(frame(spark, rows)))
    assert got["a", 0][3] == 2 and got["a", 0][1] == 3


def test_time_of_day_does_not_matter(spark):
    rows = session(3, 200, 4000)
    later = [(t + 4096.0, *rest) for t, *rest in rows]
    first, again = (collected(micro_tensor(frame(spark, flat({"s": r})))) for r in (rows, later))
    assert_same(again, first)
    assert all(again[k][2] == first[k][2] + 4096 for k in first)


def test_other_sessions_do_not_matter(spark):
    sessions = {f"s{i}": session(50 + i, 90, 3000) for i in range(3)}
    together = collected(micro_tensor(frame(spark, flat(sessions))))
    for name, rows in sessions.items():
        alone = collected(micro_tensor(frame(spark, flat({name: rows}))))
        assert_same({k: v for k, v in together.items() if k[0] == name}, alone)


@pytest.mark.parametrize("hot_rows", [1, 3, 40, 200])
def test_hot_sessions_change_nothing(spark, hot_rows):
    sessions = {"hot": session(7, 400, 5000, missing=0.02), "mild": session(8, 60, 3000),
                "instant": [(5.0, "mousemove", 1.0, 1.0)] * 50, "burst": session(9, 150, 40) + session(10, 30, 2000)}
    sessions["burst"].sort(key=lambda r: r[0])
    events = frame(spark, flat(sessions))
    uncut, blocks = (collected(micro_tensor(events, hot_rows=n)) for n in (10**6, hot_rows))
    assert_same(blocks, uncut)
    whole, cut = (
        {r.tie: [None if v is None else str(v) for v in r] for r in kinematic_steps(events, hot_rows=n).collect()}
        for n in (10**6, hot_rows)
    )
    assert whole == cut and len(whole) == events.count()


def test_row_order_and_partitions_do_not_matter(spark):
    sessions = {f"s{i}": session(20 + i, 80, 3000) for i in range(3)}
    events = frame(spark, flat(sessions))
    first = collected(micro_tensor(events))
    again = collected(micro_tensor(events.orderBy(F.rand(3)).repartition(5)))
    assert set(first) == set(again)
    assert all(first[k][1:] == again[k][1:] for k in first)
    assert all(same(a, b) for k in first for a, b in zip(first[k][0], again[k][0]))


def test_window_count_before_the_minimum(spark):
    sessions = {f"s{i}": session(30 + i, 40, 6000) for i in range(3)}
    totals = window_totals(frame(spark, flat(sessions)), min_events_per_window=0)
    counts = {r.session_id: r["count"] for r in totals.groupBy("session_id").count().collect()}
    for name, rows in sessions.items():
        assert counts[name] == (rows[-1][0] - rows[0][0] - 500) // 250 + 1


def test_screens(spark):
    sessions = {"a": session(40, 100, 2500), "b": session(41, 100, 2500), "c": session(42, 100, 2500)}
    events = frame(spark, flat(sessions))
    schema = "session_id string, vp_w double, vp_h double, doc_w double, doc_h double"
    usual = (1366.0, 768.0, 1366.0, 2000.0)
    plain = collected(micro_tensor(events))
    given = spark.createDataFrame([("a", *usual), ("b", *usual)], schema)
    assert_same(collected(micro_tensor(events, given)), plain)
    # A second sidecar of a session adds no windows; the least one counts.
    twice = spark.createDataFrame([("a", *usual), ("a", 9999.0, *usual[1:]), ("b", *usual)], schema)
    assert_same(collected(micro_tensor(events, twice)), plain)
    tall = spark.createDataFrame([("a", 1366.0, 768.0, 1366.0, 200000.0)], schema)
    other = collected(micro_tensor(events, tall))
    assert set(other) == set(plain)
    assert_same(*({k: v for k, v in x.items() if k[0] != "a"} for x in (other, plain)))


def test_features_in_range(spark):
    sessions = {f"s{i}": session(50 + i, 200, 3000, missing=0.1) for i in range(3)}
    for features, *_ in collected(micro_tensor(frame(spark, flat(sessions)))).values():
        assert all(math.isnan(f) or 0.0 <= f <= 1.0 for f in features)


def test_no_events(spark):
    assert micro_tensor(frame(spark, [])).count() == 0


def test_parameters_are_checked(spark):
    for bad in ({"window_size_ms": 0}, {"stride_ms": 0}, {"prediction_horizon_ms": -1}, {"stride_ms": 2.5}):
        with pytest.raises(ValueError):
            micro_tensor(frame(spark, []), **bad)
