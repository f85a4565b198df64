"""From a data root to samples, sequences and the exploration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointerloom.operators.explore import (
    feature_corr,
    feature_density,
    feature_range,
    source_counts,
)
from pointerloom.operators.kinematics import micro_tensor
from pointerloom.operators.records import ap_samples, hmi_samples, hvt_windows
from pointerloom.operators.sequences import sequences, unite
from pointerloom.operators.skew import materialise
from pointerloom.schema import (
    FEATURES,
    PREDICTION_HORIZON_MS,
    SEQ_LEN,
    SOURCES,
    STRIDE_MS,
    WINDOW_SIZE_MS,
)
from pointerloom.sources.catalogue import select_files, source_catalogue
from pointerloom.sources.delimited import read_ck, read_hmi, read_hvt
from pointerloom.sources.documents import read_documents
from pointerloom.sources.listing import opened_by_tasks
from pointerloom.sources.viewport import read_viewports

SAMPLE_ORDER = ["source_rank", "session_id", "window_idx"]


def read_samples(
    spark: SparkSession,
    data_root: str,
    window_size_ms: int = WINDOW_SIZE_MS,
    stride_ms: int = STRIDE_MS,
    prediction_horizon_ms: int = PREDICTION_HORIZON_MS,
    max_files: dict[str, int] | int | None = None,
    preferred: bool = False,
    hvt_max_rows: int | None = None,
    hvt_max_windows: int | None = None,
    hmi_max_records: int | None = None,
) -> DataFrame:
    """Samples of every log family found under ``data_root``; absent ones are left out.

    ``max_files`` caps the files per family, by path. Files that tasks open are read as the
    catalogue names them; of others only a capped list of paths passes through the driver, and a
    whole family is read by its folder.
    """
    catalogue = source_catalogue(spark, data_root)
    samples = []
    for source in SOURCES:
        cap = max_files.get(source) if isinstance(max_files, dict) else max_files
        chosen = select_files(catalogue, source, cap, preferred)
        folder = _folder(chosen)
        if folder is None:
            continue
        named = opened_by_tasks([folder])
        if named:
            paths = chosen
        else:
            paths = [row.path for row in chosen.select("path").collect()] if cap else folder
        if source == "CK":
            events = read_ck(spark, paths)
            screens = read_viewports(spark, folder, chosen.selectExpr("file_path session_id"))
            part = micro_tensor(events, screens, window_size_ms, stride_ms, prediction_horizon_ms)
        elif source == "HVT":
            records = read_hvt(spark, paths, hvt_max_rows)
            part = hvt_windows(records, window_size_ms, stride_ms, None, hvt_max_windows)
        elif source == "HMI":
            part = hmi_samples(read_hmi(spark, paths, hmi_max_records), hmi_max_records)
        else:
            part = ap_samples(read_documents(spark, paths))
        if preferred and not cap and not named:
            part = part.join(chosen.selectExpr("file_path session_id"), "session_id", "left_semi")
        samples.append(part)
    if not samples:
        raise FileNotFoundError(f"no log files under {data_root}")
    return unite(samples)


def _folder(files: DataFrame) -> str | None:
    """Longest folder common to the first and last path, hence to all; None without files."""
    ends = files.selectExpr("min(path) a", "max(path) b").first()
    if ends.a is None:
        return None
    parts = []
    for left, right in zip(ends.a.split("/")[:-1], ends.b.split("/")[:-1]):
        if left != right:
            break
        parts.append(left)
    return "/".join(parts)


def read_sequences(
    spark: SparkSession,
    data_root: str,
    seq_len: int = SEQ_LEN,
    max_sequences: int | None = None,
    max_files_per_dataset: int | None = None,
    scope: str = "global",
    **windowing: int,
) -> DataFrame:
    """Sequences over all families in their fixed order (``scope='session'``: inside sessions)."""
    samples = read_samples(spark, data_root, max_files=max_files_per_dataset, **windowing)
    return sequences(samples, SAMPLE_ORDER, seq_len, scope, max_sequences)


def explore(samples: DataFrame) -> dict[str, DataFrame]:
    """Counts, correlation, density and range tables of samples, which are written once."""
    samples = materialise(samples.select("source", *FEATURES))
    return {
        "counts": source_counts(samples),
        "correlation": feature_corr(samples),
        "density": feature_density(samples),
        "range": feature_range(samples),
    }


def explore_root(
    spark: SparkSession,
    data_root: str,
    max_files: dict[str, int] | int | None = None,
    preferred: bool = True,
    hvt_max_rows: int | None = None,
    hvt_max_windows: int | None = None,
) -> dict[str, DataFrame]:
    """The exploration tables of the logs; a first look may ask for few files or rows.

    ``preferred`` takes the files explored first, of families that have such names.
    """
    samples = read_samples(
        spark,
        data_root,
        max_files=max_files,
        preferred=preferred,
        hvt_max_rows=hvt_max_rows,
        hvt_max_windows=hvt_max_windows,
    )
    return explore(samples)
