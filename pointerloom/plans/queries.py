"""Registered queries: each runs an operator over whole tables of the driver."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointerloom.operators import explore, learn
from pointerloom.operators.kinematics import (
    kinematic_steps,
    micro_tensor,
    raw_features,
    window_totals,
    with_screen,
)
from pointerloom.operators.records import ap_samples, hmi_samples, hvt_windows
from pointerloom.operators.sequences import long_form, sequences, unite
from pointerloom.operators.skew import materialise, row_index, shared_folder, table_path
from pointerloom.plans import standins
from pointerloom.plans.pipeline import SAMPLE_ORDER, read_samples
from pointerloom.schema import DATASET_DIRS, FEATURES, label_name
from pointerloom.sources.catalogue import select_files, source_catalogue, source_presence
from pointerloom.sources.delimited import read_ck, read_hmi, read_hvt
from pointerloom.sources.documents import read_documents
from pointerloom.sources.sink import write_files, write_samples
from pointerloom.sources.viewport import parse_sidecars

# Sample values have up to 8 decimals by construction, so 9 never split a tie.
SAMPLE_DIGITS = 9
STATISTIC_DIGITS = 6

# A short horizon and a low scroll limit, under which all labels are common.
SHORT_HORIZON = {"prediction_horizon_ms": 125, "rapid_scroll_over": 1}


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded for comparison, without negative zeros."""
    return df.selectExpr(
        *[
            f"round(`{name}`, {digits}) + 0D as `{name}`" if kind == "double" else f"`{name}`"
            for name, kind in df.dtypes
        ]
    )


def _samples(df: DataFrame) -> DataFrame:
    return rounded(df, SAMPLE_DIGITS)


def ck_events(spark: SparkSession, folder: str) -> DataFrame:
    steps = kinematic_steps(standins.ck_events(spark, folder))
    return _samples(steps.withColumnRenamed("tie", "event_id"))


def ck_windows(spark: SparkSession, folder: str) -> DataFrame:
    totals = window_totals(standins.ck_events(spark, folder))
    return totals.select(
        "session_id", "window_idx", "window_start", "window_end", F.col("n").alias("n_events")
    )


def ck_all_windows(spark: SparkSession, folder: str) -> DataFrame:
    totals = window_totals(standins.ck_events(spark, folder), min_events_per_window=0)
    return totals.select(
        "session_id", "window_idx", "window_start", "window_end", F.col("n").alias("n_events")
    )


def raw_micro_tensor(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_features(window_totals(standins.ck_events(spark, folder)))
    return rounded(raw.select("session_id", "window_idx", *FEATURES), STATISTIC_DIGITS)


def _ck(spark: SparkSession, folder: str, **parameters) -> DataFrame:
    return micro_tensor(standins.ck_events(spark, folder), **parameters)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return _samples(_ck(spark, folder))


def micro_tensor_skewed(spark: SparkSession, folder: str) -> DataFrame:
    """A third of all events in one session, taken in blocks of 200 units."""
    return _samples(micro_tensor(standins.skewed_events(spark, folder), hot_rows=200))


def ck_events_skewed(spark: SparkSession, folder: str) -> DataFrame:
    steps = kinematic_steps(standins.skewed_events(spark, folder), hot_rows=200)
    return _samples(steps.withColumnRenamed("tie", "event_id"))


def uneven_windows(spark: SparkSession, folder: str) -> DataFrame:
    """A stride that divides neither size nor horizon."""
    return _samples(
        _ck(spark, folder, window_size_ms=500, stride_ms=200, prediction_horizon_ms=350)
    )


def viewport_join(spark: SparkSession, folder: str) -> DataFrame:
    screens = parse_sidecars(standins.sidecars(spark, folder))
    sessions = standins.ck_events(spark, folder).select("session_id").distinct()
    return with_screen(sessions, screens)


def micro_tensor_viewport(spark: SparkSession, folder: str) -> DataFrame:
    screens = parse_sidecars(standins.sidecars(spark, folder))
    return _samples(micro_tensor(standins.ck_events(spark, folder), screens))


def ck_labels(spark: SparkSession, folder: str) -> DataFrame:
    samples = _ck(spark, folder, **SHORT_HORIZON)
    return samples.select(
        "session_id", "window_idx", "label", label_name(F.col("label")).alias("label_name")
    )


def _hvt_records(spark: SparkSession, folder: str) -> DataFrame:
    log = standins.hvt_log(spark, folder)
    return row_index(log, "session_id", "day", standins.HVT_ORDER)


def hvt(spark: SparkSession, folder: str) -> DataFrame:
    return _samples(hvt_windows(_hvt_records(spark, folder)))


def hvt_capped(spark: SparkSession, folder: str) -> DataFrame:
    """Row and window caps per session, which are features of the operator."""
    return _samples(hvt_windows(_hvt_records(spark, folder), max_rows=300, max_windows=40))


def hvt_without_velocity(spark: SparkSession, folder: str) -> DataFrame:
    return _samples(hvt_windows(_hvt_records(spark, folder).drop("velocity")))


def hvt_large_key(spark: SparkSession, folder: str) -> DataFrame:
    """All records in one session."""
    log = standins.hvt_log(spark, folder).withColumn("session_id", F.lit(0))
    return _samples(hvt_windows(row_index(log, "session_id", "day", standins.HVT_ORDER)))


def hmi_large_key(spark: SparkSession, folder: str) -> DataFrame:
    """All records in one session."""
    records = standins.hmi_records(spark, folder).withColumn("session_id", F.lit(0))
    return _samples(hmi_samples(records))


def hmi(spark: SparkSession, folder: str) -> DataFrame:
    return _samples(hmi_samples(standins.hmi_records(spark, folder)))


def ap(spark: SparkSession, folder: str) -> DataFrame:
    return _samples(ap_samples(standins.action_documents(spark, folder)))


def _all(spark: SparkSession, folder: str) -> DataFrame:
    return unite(
        [
            _ck(spark, folder),
            hvt_windows(_hvt_records(spark, folder)),
            hmi_samples(standins.hmi_records(spark, folder)),
            ap_samples(standins.action_documents(spark, folder)),
        ]
    )


def all_samples(spark: SparkSession, folder: str) -> DataFrame:
    return _samples(_all(spark, folder))


def _session_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return sequences(
        _ck(spark, folder, **SHORT_HORIZON),
        ["session_id", "window_idx"],
        scope="session",
        element="double",
    )


def sequences_session(spark: SparkSession, folder: str) -> DataFrame:
    runs = long_form(_session_sequences(spark, folder), ["session_id", "window_idx"])
    return _samples(runs)


def sequences_small_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """The same runs over buckets of 50 rows, so that many runs begin in the one before."""
    runs = sequences(_all(spark, folder), SAMPLE_ORDER, bucket=50, element="double")
    return _samples(long_form(runs, ["seq_id"]))


def sequences_session_all(spark: SparkSession, folder: str) -> DataFrame:
    """Runs inside sessions of all four families."""
    runs = sequences(_all(spark, folder), SAMPLE_ORDER, scope="session", element="double")
    return _samples(long_form(runs, ["seq_id"]))


def sequences_global(spark: SparkSession, folder: str) -> DataFrame:
    runs = sequences(_all(spark, folder), SAMPLE_ORDER, element="double")
    return _samples(long_form(runs, ["seq_id"]))


def sequences_first(spark: SparkSession, folder: str) -> DataFrame:
    """The global cap on sequences, a feature of the operator."""
    runs = sequences(_all(spark, folder), SAMPLE_ORDER, max_sequences=1000, element="double")
    return _samples(long_form(runs, ["seq_id"]))


def source_counts(spark: SparkSession, folder: str) -> DataFrame:
    return explore.source_counts(_all(spark, folder))


def feature_corr(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(explore.feature_corr(_all(spark, folder)), STATISTIC_DIGITS)


def feature_density(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(explore.feature_density(_all(spark, folder)), STATISTIC_DIGITS)


def feature_range(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(explore.feature_range(_all(spark, folder)), STATISTIC_DIGITS)


def linear_scores(sample: Column) -> Column:
    """Scores of a fixed linear model on one sample's nine features."""
    weight = lambda c, j: (((9 * c + j) * 7) % 11 - 5) / 5
    return F.array(
        *[
            sum(
                (sample[j] * F.lit(weight(c, j)) for j in range(1, len(FEATURES))),
                sample[0] * F.lit(weight(c, 0)),
            )
            for c in range(learn.CLASSES)
        ]
    )


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    runs = _session_sequences(spark, folder)
    return runs.withColumn("scores", linear_scores(F.element_at("features", -1))).select(
        "seq_id",
        "label",
        "scores",
        learn.softmax(F.col("scores")).alias("probabilities"),
        learn.argmax(F.col("scores")).alias("prediction"),
    )


def epoch_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(learn.epoch_metrics(_scored(spark, folder)), STATISTIC_DIGITS)


def metric_gate(spark: SparkSession, folder: str) -> DataFrame:
    metrics = learn.latency_metrics(standins.timings(spark, folder))
    limits = {"avg_latency_ms": learn.MEAN_LATENCY_LIMIT_MS, "p95_latency_ms": 0.05}
    return rounded(learn.metric_gate(metrics, limits), STATISTIC_DIGITS)


def shuffled_batches(spark: SparkSession, folder: str) -> DataFrame:
    runs = _session_sequences(spark, folder).select("seq_id", "label")
    return learn.shuffled_batches(runs)


def formula_weights() -> dict[str, np.ndarray]:
    """Weights of the recurrent model by a formula, so that runs can be compared."""

    def fill(*shape: int) -> np.ndarray:
        cells = np.arange(int(np.prod(shape))).reshape(shape)
        return (cells * 7 % 23 - 11) / 50.0

    weights, width = {}, len(FEATURES)
    for layer in range(learn.LAYERS):
        weights[f"w_ih_{layer}"] = fill(3 * learn.HIDDEN, width)
        weights[f"w_hh_{layer}"] = fill(3 * learn.HIDDEN, learn.HIDDEN)
        weights[f"b_ih_{layer}"] = fill(3 * learn.HIDDEN)
        weights[f"b_hh_{layer}"] = fill(3 * learn.HIDDEN)
        width = learn.HIDDEN
    return {**weights, "w_out": fill(learn.CLASSES, width), "b_out": fill(learn.CLASSES)}


def gru_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = learn.score_sequences(_session_sequences(spark, folder), formula_weights())
    scores = [F.col("scores")[c].alias(f"score_{c}") for c in range(learn.CLASSES)]
    return rounded(scored.select("seq_id", "label", "prediction", *scores), STATISTIC_DIGITS)


def mlp_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Epochs of a training: losses below the first, and in the end below that of even odds."""
    runs = materialise(_session_sequences(spark, folder))
    model = learn.fit_classifier(runs, learning_rate=0.02)
    final = learn.epoch_metrics(learn.predict(model, runs)).first()
    first = model.history[0][1] if model.history else None
    return learn.loss_history(model, runs).select(
        "iteration",
        F.lit(final.n).alias("n_runs"),
        (F.col("loss") < F.lit(first)).alias("below_first"),
        F.lit(final.loss < math.log(learn.CLASSES)).alias("beats_even_odds"),
    )


def _written(df: DataFrame, name: str, delimiter: str) -> str:
    """A table as delimited files with headers in the shared folder."""
    root = f"{shared_folder(df.sparkSession)}/logs-{uuid.uuid4().hex}"
    df.write.option("header", True).option("sep", delimiter).csv(f"{root}/{name}")
    return f"{root}/{name}"


def read_ck_files(spark: SparkSession, folder: str) -> DataFrame:
    """The event log written as pointer files and read back."""
    events = standins.ck_events(spark, folder)
    log = events.select(F.col("tie").alias("cursor"), "timestamp", "xpos", "ypos", "event")
    return read_ck(spark, _written(log, "ck", " ")).select("timestamp", "event", "xpos", "ypos")


def read_hvt_files(spark: SparkSession, folder: str) -> DataFrame:
    log = standins.hvt_log(spark, folder).select("l_orderkey", "velocity", "distance")
    return read_hvt(spark, _written(log, "hvt", ";"), max_rows=None).select("velocity", "distance")


def read_hmi_files(spark: SparkSession, folder: str) -> DataFrame:
    log = standins.hmi_records(spark, folder).select(
        "session_id", F.date_format("epoch", "yyyy-MM-dd").alias("initepoch")
    )
    return read_hmi(spark, _written(log, "hmi", ","), max_records=None).select("epoch")


def _file_number(column: str) -> Column:
    """Number in ``part=N`` that a table written by part has in its paths."""
    return F.regexp_extract(column, r"part=(\d+)", 1).cast("long")


def _in_files(
    df: DataFrame, root: str, delimiter: str | None, order: list[str], suffix: str = ".csv"
) -> str:
    """A table as a file per ``part``, with a header and its rows in order; no delimiter: bare texts."""
    columns = [c for c in df.columns if c != "part"]
    line = F.col(columns[0]) if delimiter is None else F.to_csv(F.struct(*columns), {"sep": delimiter})
    spread = df.repartition("part").sortWithinPartitions("part", *order)
    header = None if delimiter is None else delimiter.join(columns)
    write_files(spread.select(F.col("part"), line.alias("line")), root, header, suffix)
    return root


def read_ck_order(spark: SparkSession, folder: str) -> DataFrame:
    """A pointer file per user: sessions and the order of lines come back from the files."""
    log = standins.ck_events(spark, folder).select(
        F.col("session_id").alias("part"), F.col("tie").alias("cursor"), "timestamp", "xpos", "ypos", "event"
    )
    events = read_ck(spark, _in_files(log, f"{table_path(spark, 'logs')}/ck", " ", ["cursor"]))
    return events.withColumn("session_id", _file_number("session_id"))


def read_hvt_order(spark: SparkSession, folder: str) -> DataFrame:
    log = standins.hvt_log(spark, folder).withColumnRenamed("session_id", "part")
    root = f"{table_path(spark, 'logs')}/hvt"
    records = read_hvt(spark, _in_files(log, root, ";", ["day", *standins.HVT_ORDER]))
    return records.select(
        _file_number("session_id").alias("session_id"), "row_idx", "velocity", "distance"
    )


def hmi_delimiters(spark: SparkSession, folder: str) -> DataFrame:
    """Files with every delimiter and time column: by month, and a file without a time."""
    records = standins.hmi_records(spark, folder).select(
        F.month("epoch").cast("long").alias("part"), F.date_format("epoch", "yyyy-MM-dd").alias("at"), "session_id"
    )
    root, parts = table_path(spark, "logs"), []
    forms = [("epoch", ";"), ("initepoch", ";"), ("timestamp", ";"), ("epoch", ","), ("initepoch", ","), ("timestamp", ",")]
    for k, (column, delimiter) in enumerate(forms):
        chosen = records.where(F.col("part") % len(forms) == k).withColumnRenamed("at", column)
        _ = chosen.repartition("part").write.option("header", True).option("sep", delimiter).partitionBy("part").csv(
            f"{root}/form{k}"
        )
        parts.append(f"{root}/form{k}")
    read = read_hmi(spark, parts)
    return read.select(_file_number("session_id").alias("month"), "epoch")


def read_ap_files(spark: SparkSession, folder: str) -> DataFrame:
    """Chat messages as JSON files of a conversation each, read back as whole documents."""
    documents = standins.conversation_documents(spark, folder)
    root = _in_files(
        documents.withColumnRenamed("session_id", "part"), table_path(spark, "logs"), None, [], ".json"
    )
    return _samples(ap_samples(read_documents(spark, root)).withColumn("session_id", _file_number("session_id")))


def sink_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All samples written by source with 32-bit features, and read back."""
    path = table_path(spark, "sink")
    write_samples(_all(spark, folder), path)
    back = spark.read.parquet(path)
    return _samples(back.select("source", "session_id", "window_idx", *[F.col(f).cast("double") for f in FEATURES], "label"))


def chosen_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a family by path, with a cap and by preferred names."""
    root = table_path(spark, "logs")
    log = standins.hmi_records(spark, folder).select(F.month("epoch").cast("long").alias("part"), "epoch")
    for k, name in enumerate(("raw_interactions", "other")):
        some = log.where(F.col("part") % 2 == k).repartition("part").sortWithinPartitions("part")
        some.write.option("header", True).partitionBy("part").csv(f"{root}/{DATASET_DIRS['HMI']}/{name}")
    catalogue = source_catalogue(spark, root)
    capped = select_files(catalogue, "HMI", 5).select(F.lit("capped").alias("choice"), "path")
    # No file name has a preferred part, as Spark names files; all are taken then.
    named = select_files(catalogue, "HMI", None, preferred=True).select(F.lit("named").alias("choice"), "path")
    both = capped.unionByName(named)
    kind = F.when(F.contains("path", F.lit("raw_interactions")), "raw_interactions").otherwise("other")
    return both.select("choice", kind.alias("folder"), _file_number("path").alias("month"))


def files_to_samples(spark: SparkSession, folder: str) -> DataFrame:
    """From files of two families, sidecars among them, to the samples of all."""
    root = table_path(spark, "store")
    log = standins.ck_events(spark, folder).select(
        F.col("session_id").alias("part"), F.col("tie").alias("cursor"), "timestamp", "xpos", "ypos", "event"
    )
    _in_files(log, f"{root}/raw/{DATASET_DIRS['CK']}", " ", ["cursor"])
    hvt_log = standins.hvt_log(spark, folder).withColumnRenamed("session_id", "part")
    hvt_order = ["day", *standins.HVT_ORDER]
    _in_files(hvt_log, f"{root}/raw/deep/{DATASET_DIRS['HVT']}", ";", hvt_order)
    samples = read_samples(spark, root)
    return _samples(samples.withColumn("session_id", _file_number("session_id")).drop("source_rank"))


def resolve_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Presence of log families under a root that holds two of the four."""
    root = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    ck = standins.ck_events(spark, folder).select("timestamp", "xpos", "ypos", "event")
    ck.write.option("header", True).option("sep", " ").csv(f"{root}/raw/{DATASET_DIRS['CK']}")
    hmi_log = standins.hmi_records(spark, folder).select("epoch")
    hmi_log.write.option("header", True).csv(f"{root}/raw/deep/{DATASET_DIRS['HMI']}")
    presence = source_presence(source_catalogue(spark, root))
    return presence.select("source", "present", (F.col("bytes") > 0).alias("has_bytes"))


def size_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of stored tables, in MB, against the limit of a deployed model and a failing one."""
    sizes = standins.table(spark, folder, "orders").agg(
        (F.count(F.lit(1)) / 1000.0).alias("file_size_mb"), (F.count(F.lit(1)) * 1.0).alias("large_size_mb")
    )
    metrics = sizes.select(F.expr("stack(2, 'file_size_mb', file_size_mb, 'large_size_mb', large_size_mb) as (metric, value)"))
    limits = {"file_size_mb": learn.SIZE_LIMIT_MB, "large_size_mb": learn.SIZE_LIMIT_MB}
    return rounded(learn.metric_gate(metrics, limits), STATISTIC_DIGITS)


def epoch_metrics_far(spark: SparkSession, folder: str) -> DataFrame:
    """Scores 2,000 times as far apart: losses of probabilities that vanish."""
    far = _scored(spark, folder).withColumn("scores", F.transform("scores", lambda s: s * 2000.0))
    return rounded(learn.epoch_metrics(far, ["prediction"]), STATISTIC_DIGITS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ck_events": ck_events,
    "ck_windows": ck_windows,
    "ck_all_windows": ck_all_windows,
    "micro_tensor": flagship,
    "raw_micro_tensor": raw_micro_tensor,
    "micro_tensor_skewed": micro_tensor_skewed,
    "ck_events_skewed": ck_events_skewed,
    "uneven_windows": uneven_windows,
    "viewport_join": viewport_join,
    "micro_tensor_viewport": micro_tensor_viewport,
    "ck_labels": ck_labels,
    "hvt_windows": hvt,
    "hvt_capped": hvt_capped,
    "hvt_without_velocity": hvt_without_velocity,
    "hvt_large_key": hvt_large_key,
    "hmi_samples": hmi,
    "hmi_large_key": hmi_large_key,
    "ap_samples": ap,
    "all_samples": all_samples,
    "sequences_session": sequences_session,
    "sequences_global": sequences_global,
    "sequences_first": sequences_first,
    "sequences_small_buckets": sequences_small_buckets,
    "sequences_session_all": sequences_session_all,
    "source_counts": source_counts,
    "feature_corr": feature_corr,
    "feature_density": feature_density,
    "feature_range": feature_range,
    "epoch_metrics": epoch_metrics,
    "metric_gate": metric_gate,
    "shuffled_batches": shuffled_batches,
    "gru_scores": gru_scores,
    "mlp_fit": mlp_fit,
    "read_ck_files": read_ck_files,
    "read_hvt_files": read_hvt_files,
    "read_hmi_files": read_hmi_files,
    "resolve_sources": resolve_sources,
    "read_ck_order": read_ck_order,
    "read_hvt_order": read_hvt_order,
    "hmi_delimiters": hmi_delimiters,
    "read_ap_files": read_ap_files,
    "sink_round_trip": sink_round_trip,
    "chosen_files": chosen_files,
    "files_to_samples": files_to_samples,
    "size_gate": size_gate,
    "epoch_metrics_far": epoch_metrics_far,
}
