"""Samples from logs without pointer coordinates: trajectories, HMI records, action paths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointerloom.functions.expr import clip01, python_float
from pointerloom.operators.kinematics import LENGTH_FULL, SPEED_MAX_FULL, SPEED_MEAN_FULL
from pointerloom.operators.skew import explode_range
from pointerloom.schema import (
    LABELS,
    RECORD_STEP_MS,
    SAMPLE_COLUMNS,
    STRIDE_MS,
    WINDOW_SIZE_MS,
    sample_columns,
)

DWELL_FULL_MS = 500.0
MIN_RECORDS_PER_WINDOW = 2

# Only pointer windows carry their bounds.
NO_BOUNDS = [f"cast(null as double) as {c}" for c in ("window_start", "window_end")]


def _number_or_null(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def last_emitted(windows: int, window_size_ms: int, stride_ms: int) -> int:
    """Index of the ``windows``-th window with enough records, -1 for none.

    Records are 50 ms apart from 0 on, so how many a window holds depends on its index
    alone and repeats with it; a cap on windows is a cap on the index.
    """
    period = RECORD_STEP_MS // math.gcd(stride_ms, RECORD_STEP_MS)
    first_at = lambda t: -(-t // RECORD_STEP_MS)
    full = [
        k
        for k in range(period)
        if first_at(k * stride_ms + window_size_ms) - first_at(k * stride_ms) >= MIN_RECORDS_PER_WINDOW
    ]
    if not full or windows < 1:
        return -1
    whole, part = divmod(windows - 1, len(full))
    return whole * period + full[part]


def hvt_windows(
    records: DataFrame,
    window_size_ms: int = WINDOW_SIZE_MS,
    stride_ms: int = STRIDE_MS,
    max_rows: int | None = None,
    max_windows: int | None = None,
) -> DataFrame:
    """Windows over a synthetic timeline that gives each record 50 ms.

    ``records``: ``session_id, row_idx`` (from 0, without gaps) and optionally
    ``velocity`` and ``distance``; a column that is missing leaves its features
    at 0, and so does a flag ``has_velocity`` or ``has_distance`` that is false
    for the session. Missing values inside a column are skipped.

    A record is copied into the windows that hold it and into those it closes,
    being the first record at or after their end. A window without a closing
    record runs past the session's last record and is not emitted, so session
    lengths need no join. Copies are combined map-side before the one shuffle. The
    cap on windows is known from parameters, so what is beyond it is never copied.
    """
    velocity = "velocity" in records.columns
    distance = "distance" in records.columns
    kept = records if max_rows is None else records.where(F.col("row_idx") < max_rows)
    missing = F.lit(None).cast("double")
    t = F.col("row_idx").cast("long") * RECORD_STEP_MS
    reach = window_size_ms + RECORD_STEP_MS
    low = F.floor((F.col("t") - reach) / F.lit(stride_ms)).cast("long") + 1
    copies = (
        kept.select(
            "session_id",
            t.alias("t"),
            (_number_or_null("velocity") if velocity else missing).alias("velocity"),
            (_number_or_null("distance") if distance else missing).alias("distance"),
            *[
                (F.col(f) if f in records.columns else F.lit(True)).alias(f)
                for f in ("has_velocity", "has_distance")
            ],
        )
        .withColumn("low", F.greatest(F.lit(0).cast("long"), low))
        .withColumn("high", F.floor(F.col("t") / F.lit(stride_ms)).cast("long"))
        .where("low <= high")
    )
    if max_windows is not None:
        last = last_emitted(max_windows, window_size_ms, stride_ms)
        copies = copies.withColumn("high", F.least("high", F.lit(last).cast("long"))).where("low <= high")
    copies = copies.withColumn("window_idx", F.explode(F.sequence("low", "high")))
    inside = F.col("t") < F.col("window_idx") * stride_ms + window_size_ms
    windows = (
        copies.groupBy("session_id", "window_idx")
        .agg(
            F.count(F.when(inside, True)).alias("n"),
            F.max(~inside).alias("closed"),
            F.avg(F.when(inside, F.col("velocity"))).alias("mean_v"),
            F.max(F.when(inside, F.col("velocity"))).alias("max_v"),
            F.sum(F.when(inside, F.col("distance"))).alias("length"),
            F.max("has_velocity").alias("has_velocity"),
            F.max("has_distance").alias("has_distance"),
        )
        .where(F.col("closed") & (F.col("n") >= MIN_RECORDS_PER_WINDOW))
    )
    measured = lambda flag, value, full: (
        f"if({flag}, {clip01(f'{value} / {full!r}D')}, 0D)"
    )
    nan = "double('nan')"
    present = {}
    if velocity:
        mean_v, max_v = f"coalesce(mean_v, {nan})", f"coalesce(max_v, {nan})"
        present["meanVelocity"] = measured("has_velocity", mean_v, SPEED_MEAN_FULL)
        present["maxVelocity"] = measured("has_velocity", max_v, SPEED_MAX_FULL)
    if distance:
        present["totalTrajectoryLength"] = measured(
            "has_distance", "coalesce(length, 0D)", LENGTH_FULL
        )
    return windows.selectExpr(
        "session_id", "window_idx", *NO_BOUNDS, *sample_columns("HVT", present, str(LABELS["IDLE"]))
    ).select(*SAMPLE_COLUMNS)


def hmi_samples(records: DataFrame, max_records: int | None = None) -> DataFrame:
    """One click sample per HMI record of a session but the last.

    Samples of a session are alike, so their number decides the result: records
    are counted (combined map-side) and the count is opened into rows, a large one by
    many tasks.
    """
    counts = records.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n") if max_records is None else F.least(F.col("n"), F.lit(max_records).cast("long"))
    counts = counts.select("session_id", (n - 1).alias("n"))
    return (
        explode_range(counts, "n", "window_idx", spread=True)
        .selectExpr(
            "session_id",
            "window_idx",
            *NO_BOUNDS,
            *sample_columns("HMI", {"meanVelocity": "1"}, str(LABELS["CLICK"])),
        )
        .select(*SAMPLE_COLUMNS)
    )


def _fields(item: Column) -> Column:
    """Fields of a JSON object by name; NULL for any other kind of value."""
    return F.try_variant_get(item, "$", "map<string,variant>")


def _list(item: Column, path: str = "$") -> Column:
    """Elements of a JSON list; NULL for any other kind of value."""
    return F.try_variant_get(item, path, "array<variant>")


def action_items(document: Column) -> Column:
    """Actions of a JSON document in document order, as an array of variants.

    In a list, an object stands for its ``clickstream`` list, else its
    ``actions`` list, else itself. In an object, a list value stands for its
    elements and an object value for itself. All else is dropped; a document
    that does not parse has no actions.
    """
    in_list = F.flatten(
        F.transform(
            F.filter(F.from_json(document, "array<variant>"), lambda e: _fields(e).isNotNull()),
            lambda e: F.coalesce(_list(e, "$.clickstream"), _list(e, "$.actions"), F.array(e)),
        )
    )
    in_object = F.flatten(
        F.transform(
            F.map_values(F.from_json(document, "map<string,variant>")),
            lambda v: F.coalesce(
                _list(v), F.when(_fields(v).isNotNull(), F.array(v)), F.array().cast("array<variant>")
            ),
        )
    )
    return F.coalesce(in_list, in_object)


def _seconds(value: Column) -> Column:
    """A JSON value as a number; NULL where ``float()`` would raise."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0))
        .when((kind != "VOID") & ~kind.rlike("^(OBJECT|ARRAY)"), python_float(text))
        .otherwise(F.lit(None).cast("double"))
    )


def ap_samples(documents: DataFrame) -> DataFrame:
    """Dwell samples from action-path JSON: ``session_id`` and ``value``, a document each.

    Work stays inside the row. Actions after the first whose ``stay_seconds`` is
    no number are dropped, as reading a document ends there. A sample is a
    backtrack if the action has the key ``previous_url``, even with a null.
    """
    objects = F.transform(action_items(F.col("value")), _fields)
    timed = F.filter(
        objects, lambda o: F.coalesce(F.map_contains_key(o, "stay_seconds"), F.lit(False))
    )
    parsed = F.transform(
        timed,
        lambda o: F.struct(
            _seconds(o["stay_seconds"]).alias("seconds"),
            F.map_contains_key(o, "previous_url").alias("back"),
        ),
    )
    # The outer form of explode, as the plain one would parse each document
    # once more to filter on the size of the result.
    samples = (
        documents.select("session_id", parsed.alias("actions"))
        .withColumn(
            "bad", F.array_position(F.transform("actions", lambda a: a["seconds"].isNull()), True)
        )
        .select("session_id", "bad", F.posexplode_outer("actions").alias("pos", "action"))
        .where("action is not null and (bad = 0 or pos < bad - 1)")
    )
    dwell = clip01(f"action.seconds * 1000D / {DWELL_FULL_MS!r}D")
    label = f"if(action.back, {LABELS['BACKTRACK']}, {LABELS['IDLE']})"
    return samples.selectExpr(
        "session_id",
        "cast(pos as long) as window_idx",
        *NO_BOUNDS,
        *sample_columns("AP", {"dwellTimeMs": dwell}, label),
    ).select(*SAMPLE_COLUMNS)
