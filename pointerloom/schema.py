"""Names, codes and defaults shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: these must equal the original pipeline's for equal results ---

FEATURES = (
    "meanVelocity",
    "maxVelocity",
    "meanAcceleration",
    "hesitationCount",
    "totalTrajectoryLength",
    "dwellTimeMs",
    "scrollDepthPercentage",
    "scrollVelocity",
    "trajectoryEntropy",
)

LABELS = {
    "IDLE": 0,
    "CLICK": 1,
    "FORM_SUBMIT": 2,
    "BACKTRACK": 3,
    "RAPID_SCROLL": 4,
    "HOVER_DWELL": 5,
}

POINTER_EVENTS = ("mousemove", "mouseover", "mousedown", "mouseup", "click")

WINDOW_SIZE_MS = 500
STRIDE_MS = 250
PREDICTION_HORIZON_MS = 1500
MIN_EVENTS_PER_WINDOW = 2
RAPID_SCROLL_OVER = 4
RECORD_STEP_MS = 50
SEQ_LEN = 8

DEFAULT_VIEWPORT = (1366.0, 768.0)
DEFAULT_DOCUMENT = (1366.0, 2000.0)

# Sources in the order in which their samples are concatenated.
SOURCES = ("CK", "HVT", "HMI", "AP")

DATASET_DIRS = {
    "CK": "continuous-kinematics-2020",
    "HVT": "high-volume-trajectories-20226",
    "HMI": "structural-hmi-sequences-2023",
    "AP": "client-side-action-paths-2021",
}

# --- End of fixed values ---

SAMPLE_COLUMNS = (
    "source",
    "session_id",
    "window_idx",
    "window_start",
    "window_end",
    *FEATURES,
    "label",
)


def label_name(code: Column) -> Column:
    """Name of a label code; NULL for an unknown code."""
    mapping = F.create_map(*[F.lit(v) for name, c in LABELS.items() for v in (c, name)])
    return mapping[code]


def source_rank(source: Column) -> Column:
    """Position of a source in the concatenation order, from 0."""
    return F.array_position(F.array(*[F.lit(s) for s in SOURCES]), source).cast("int") - 1


def sample_columns(source: str, present: dict[str, str], label: str) -> list[str]:
    """SQL of one source's features and label, features it cannot supply set to 0.

    This is the modality mask: unlike sources share one schema, and what a
    source does not measure is 0.0 rather than NULL.
    """
    unknown = set(present) - set(FEATURES)
    if unknown:
        raise ValueError(f"not features: {sorted(unknown)}")
    features = [f"cast({present.get(name, '0')} as double) as {name}" for name in FEATURES]
    return [f"'{source}' as source", *features, f"cast({label} as int) as label"]
