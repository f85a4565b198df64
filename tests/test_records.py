import math

import pytest
from pyspark.sql import functions as F

from pointerloom.operators.records import ap_samples, hmi_samples, hvt_windows
from pointerloom.operators.skew import explode_range, number_rows, row_index, table_scope
from pointerloom.schema import FEATURES


def trajectory(spark, values, session="h", columns="velocity double, distance double"):
    rows = [(session, i, *v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"session_id string, row_idx long, {columns}")


def by_window(df):
    return {r.window_idx: [r[f] for f in FEATURES] for r in df.orderBy("window_idx").collect()}


@pytest.mark.parametrize("n,windows", [(1, 0), (10, 0), (11, 1), (15, 1), (16, 2), (100, 18)])
def test_hvt_window_count(spark, n, windows):
    assert hvt_windows(trajectory(spark, [(1.0, 2.0)] * n)).count() == windows


def test_hvt_values(spark):
    got = by_window(hvt_windows(trajectory(spark, [(float(i), 100.0 * i) for i in range(16)])))
    assert got[0] == pytest.approx([4.5 / 5, 0.9, 0, 0, 1.0, 0, 0, 0, 0])
    assert got[1][:2] == [1.0, 1.0]
    assert {r.label for r in hvt_windows(trajectory(spark, [(1.0, 1.0)] * 11)).collect()} == {0}


def test_hvt_missing_values_are_skipped(spark):
    values = [(None, 1.0), (float("nan"), None), (2.0, None)] + [(None, None)] * 8
    got = by_window(hvt_windows(trajectory(spark, values)))
    assert got[0][:2] == pytest.approx([0.4, 0.2]) and got[0][4] == pytest.approx(1 / 2000)
    none = by_window(hvt_windows(trajectory(spark, [(None, None)] * 11)))
    assert math.isnan(none[0][0]) and math.isnan(none[0][1]) and none[0][4] == 0.0


def test_hvt_missing_columns_are_zero(spark):
    got = by_window(hvt_windows(trajectory(spark, [(4.0,)] * 11, columns="distance double")))
    assert got[0] == pytest.approx([0, 0, 0, 0, 0.02, 0, 0, 0, 0])
    flags = trajectory(spark, [(4.0, 4.0)] * 11).selectExpr(
        "*", "false as has_velocity", "true as has_distance"
    )
    assert by_window(hvt_windows(flags)) == got


def test_hvt_caps(spark):
    frame = trajectory(spark, [(1.0, 1.0)] * 60)
    assert hvt_windows(frame, max_rows=16).count() == 2
    assert sorted(by_window(hvt_windows(frame, max_windows=3))) == [0, 1, 2]


@pytest.mark.parametrize("size,stride", [(75, 50), (500, 130), (60, 200), (1000, 25)])
def test_hvt_odd_sizes(spark, size, stride):
    n = 57
    got = by_window(hvt_windows(trajectory(spark, [(float(i % 9), 1.0) for i in range(n)]), size, stride))
    want, k = {}, 0
    while k * stride + size <= (n - 1) * 50:
        inside = [float(i % 9) for i in range(n) if k * stride <= i * 50 < k * stride + size]
        if len(inside) >= 2:
            want[k] = [min(sum(inside) / len(inside) / 5, 1), min(max(inside) / 10, 1)]
        k += 1
    assert {w: pytest.approx(v) for w, v in want.items()} == {w: f[:2] for w, f in got.items()}


@pytest.mark.parametrize("slices", [None, 100, 7])
def test_row_index_with_hot_sessions(spark, slices):
    rows = [("hot", float(i % 50), (i * 37) % 1000) for i in range(1000)]
    rows += [("mild", 1.0, i) for i in range(20)] + [("one", 3.0, 0)]
    df = spark.createDataFrame(rows, "k string, day double, o int").repartition(4)
    got = sorted((r.k, r.row_idx, r.day, r.o) for r in row_index(df, "k", "day", ["o"], slices).collect())
    want = []
    for key in ("hot", "mild", "one"):
        mine = sorted(r[1:] for r in rows if r[0] == key)
        want += [(key, i, *r) for i, r in enumerate(mine)]
    assert got == want


def test_number_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("a"), F.col("id").alias("b"))
    got = number_rows(df.repartition(6), ["a", "b"]).orderBy("a", "b").collect()
    assert [r.idx for r in got] == list(range(5000))


@pytest.mark.parametrize("spread", [False, True])
def test_explode_range(spark, spread):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 9000), ("d", -3)], "k string, n long")
    got = explode_range(df, "n", "i", spread).groupBy("k").agg(F.count("i"), F.min("i"), F.max("i"))
    assert sorted(map(tuple, got.collect())) == [("b", 1, 0, 0), ("c", 9000, 0, 8999)]


@pytest.mark.parametrize("cap,want", [(500, [0, 1, 4]), (3, [0, 1, 2]), (None, [0, 1, 4])])
def test_hmi_yields_all_but_the_last(spark, cap, want):
    rows = [("a",)] + [("b",)] * 2 + [("c",)] * 5
    got = hmi_samples(spark.createDataFrame(rows, "session_id string"), cap).collect()
    assert [sum(r.session_id == s for r in got) for s in "abc"] == want
    assert all([r[f] for f in FEATURES] == [1.0] + [0.0] * 8 and r.label == 1 for r in got)


def actions(spark, document):
    df = spark.createDataFrame([("d", document)], "session_id string, value string")
    return [(r.dwellTimeMs, r.label) for r in ap_samples(df).orderBy("window_idx").collect()]


def test_ap_list_document(spark):
    document = (
        '[{"clickstream":[{"stay_seconds":"0.2","previous_url":null},{"stay_seconds":3},7]},'
        '{"stay_seconds":0.1},5,{"clickstream":"no","actions":[{"stay_seconds":"bad"}]},{"stay_seconds":9}]'
    )
    assert actions(spark, document) == [(0.4, 3), (1.0, 0), (0.2, 0)]


def test_ap_object_document(spark):
    document = '{"u1":[{"stay_seconds":0.4}],"u2":{"stay_seconds":9,"previous_url":"x"},"u3":7}'
    assert actions(spark, document) == [(0.8, 0), (1.0, 3)]
    in_order = '{"z":{"stay_seconds":0.1},"a":{"stay_seconds":0.2},"m":[[1],{"stay_seconds":0.3}]}'
    assert [d for d, _ in actions(spark, in_order)] == pytest.approx([0.2, 0.4, 0.6])


@pytest.mark.parametrize("document", ["{broken", "", "5", '"text"', "null", "[]", "{}", "[1,[2]]", '[{"a":1}',
                                      '[{"stay_seconds":1},{broken'])
def test_ap_documents_without_actions(spark, document):
    assert actions(spark, document) == []


@pytest.mark.parametrize("value,want", [
    ("true", 1.0), ("false", 0.0), ('" 1_0e-2 "', 0.2), ('"inf"', 1.0), ('"-Infinity"', 0.0), ("-3", 0.0),
    ('"1d"', None), ("null", None), ("[1]", None), ("{}", None), ('""', None), ('"0x1"', None), ('".25"', 0.5),
])
def test_ap_numbers(spark, value, want):
    assert actions(spark, f'[{{"stay_seconds":{value}}}]') == ([] if want is None else [(want, 0)])


def test_ap_nan_stays(spark):
    (dwell, label), = actions(spark, '[{"stay_seconds":"nan"}]')
    assert math.isnan(dwell) and label == 0


def test_ap_keys_of_either_list(spark):
    assert actions(spark, '[{"clickstream":[],"actions":[{"stay_seconds":1}]}]') == []
    assert actions(spark, '[{"actions":{"stay_seconds":1},"stay_seconds":0.05}]') == [(0.1, 0)]


def test_row_index_of_null_keys_and_ties(spark):
    rows = [(None, 1.0, k % 3) for k in range(30)] + [("a", 1.0, 5)] * 4
    df = spark.createDataFrame(rows, "k string, day double, o int").repartition(5)
    got = sorted((str(r.k), r.row_idx) for r in row_index(df, "k", "day", ["o"]).collect())
    assert got == sorted([("None", k) for k in range(30)] + [("a", k) for k in range(4)])


def test_scope_clears_its_tables(spark):
    df = spark.createDataFrame([(k % 3, float(k), k) for k in range(40)], "k int, day double, o int")
    files = lambda folder: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    with table_scope(spark) as outer:
        assert row_index(df, "k", "day", ["o"]).count() == 40
        written = files(outer).count()
        assert written
        with pytest.raises(ZeroDivisionError), table_scope(spark) as inner:
            number_rows(df, ["o"]).count()
            assert files(inner).count()
            raise ZeroDivisionError
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            files(inner).count()
        assert files(outer).count() == written
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files(outer).count()


@pytest.mark.parametrize("size,stride,most", [(500, 250, 3), (75, 25, 7), (60, 70, 4), (100, 30, 1), (40, 250, 5), (500, 250, 0)])
def test_window_cap_by_index(spark, size, stride, most):
    df = trajectory(spark, [(float(i), 1.0) for i in range(90)])
    every = sorted(r.window_idx for r in hvt_windows(df, size, stride).collect())
    capped = sorted(r.window_idx for r in hvt_windows(df, size, stride, max_windows=most).collect())
    assert capped == every[:most]


def test_one_key_and_short_ranges_take_many_tasks(spark):
    """Neither the rows of one key nor all opened rows are those of one task."""
    most = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).selectExpr("0L as session_id", "id % 7 as day", "id as nth")
        numbered = row_index(rows, "session_id", "day", ["nth"], slices=8)
        assert numbered.agg(F.count_distinct("row_idx"), F.max("row_idx")).first() == (20_000, 19_999)
        assert most(numbered) < 15_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    counts = spark.range(100).selectExpr("id", "50L as n")
    opened = explode_range(counts, "n", "k", spread=True)
    assert opened.count() == 5_000 and most(opened) < 2_500
