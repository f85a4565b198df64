"""Session-anchored sliding windows over pointer events: nine features and a label.

Windows start at the first event of a session and step by the stride. Pointer
events of a window are a run of the session's ordered pointer stream, so steps
between events are taken once per session and a window keeps those that lie
inside it. The plan has three stages:

1. steps: events are shuffled once, by session and block of time, and ``lag``
   gives each step's speed, angle and turn; what a block's first steps need from
   before it comes from a row per block;
2. panes: steps are summed per pane, the greatest common part of size, stride
   and horizon, in the same partitioning;
3. windows: panes, not events, are copied into the windows they touch and
   summed again (combined map-side before the second, small shuffle).
"""

from __future__ import annotations

import math
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointerloom.functions.expr import (
    N_BINS,
    angle_bin,
    clip01,
    exceeds,
    fold_angle,
    normalised_entropy,
)
from pointerloom.functions.labels import OUTCOME_EVENTS, horizon_label, is_outcome
from pointerloom.operators.skew import explode_range, session_bounds
from pointerloom.schema import (
    DEFAULT_DOCUMENT,
    DEFAULT_VIEWPORT,
    FEATURES,
    MIN_EVENTS_PER_WINDOW,
    POINTER_EVENTS,
    PREDICTION_HORIZON_MS,
    RAPID_SCROLL_OVER,
    SAMPLE_COLUMNS,
    STRIDE_MS,
    WINDOW_SIZE_MS,
    sample_columns,
)

# Divisors of the scaled features and factors of the derived ones (fixed values).
SPEED_MEAN_FULL = 5.0
SPEED_MAX_FULL = 10.0
ACCELERATION_FULL = 0.1
HESITATION_FULL = 10.0
LENGTH_FULL = 2000.0
SCROLL_DEPTH_FULL = 100.0
SCROLL_SPEED_FULL = 5.0
MS_PER_HOVER = 50.0
PX_PER_SCROLL_STEP = 50.0
PX_PER_SCROLL_SPEED = 100.0
HESITATION_TURN = math.pi / 4.0

# Features taken from coordinates, which a missing one turns into NaN; the others are counts.
MEASURED = (*FEATURES[:3], FEATURES[4])

# Milliseconds of a session that are taken together.
HOT_ROWS = 1_000_000

BINS = [f"bin{i}" for i in range(N_BINS)]
OUTCOMES = list(OUTCOME_EVENTS)
SCREEN = ("vp_w", "vp_h", "doc_w", "doc_h")


def with_screen(bounds: DataFrame, viewport: DataFrame | None) -> DataFrame:
    """Session rows with screen sizes, defaults where a session has no sidecar."""
    defaults = dict(zip(SCREEN, (*DEFAULT_VIEWPORT, *DEFAULT_DOCUMENT)))
    if viewport is None:
        return bounds.withColumns({c: F.lit(v) for c, v in defaults.items()})
    # A session has one screen: of several sidecars the least, by its sizes.
    one = viewport.groupBy("session_id").agg(F.min(F.struct(*SCREEN)).alias("_screen"))
    sizes = one.select("session_id", *[F.col("_screen")[c].alias(c) for c in SCREEN])
    joined = bounds.join(sizes, "session_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def _prepare(events: DataFrame) -> DataFrame:
    """Events with a usable time; a missing coordinate is NaN and spoils its steps."""
    names = ", ".join(f"'{e}'" for e in POINTER_EVENTS)
    return events.selectExpr(
        "session_id",
        "cast(timestamp as double) as t",
        "tie",
        "event",
        f"coalesce(event in ({names}), false) as is_ptr",
        "coalesce(cast(xpos as double), double('nan')) as x",
        "coalesce(cast(ypos as double), double('nan')) as y",
    ).where("t is not null and not isnan(t)")


def _with_previous(rows: DataFrame, *partition: str) -> DataFrame:
    """Rows with time and place of the two pointer events before."""
    over = f"over (partition by {', '.join(partition)} order by t, tie)"
    return rows.selectExpr(
        "*",
        *[f"lag({c}, 1) {over} as p{c}" for c in "txy"],
        *[f"lag({c}, 2) {over} as pp{c}" for c in "txy"],
        f"row_number() {over} as place",
    )


def _steps(rows: DataFrame) -> DataFrame:
    """Speed, angle, acceleration and turn of the step that ends at each row.

    Coordinates are scaled to the screen and back, which matters only for a
    screen narrower than a pixel.
    """
    across = lambda c, before, size: (
        f"({c} / greatest({size}, 1D) - {before} / greatest({size}, 1D)) * {size}"
    )
    return (
        rows.selectExpr(
            "*",
            f"{across('x', 'px', 'vp_w')} as dx",
            f"{across('y', 'py', 'vp_h')} as dy",
            f"{across('px', 'ppx', 'vp_w')} as pdx",
            f"{across('py', 'ppy', 'vp_h')} as pdy",
            "if(t - pt <= 0, 1D, t - pt) as dt",
            "if(pt - ppt <= 0, 1D, pt - ppt) as pdt",
        )
        .selectExpr(
            "*",
            "sqrt(dx * dx + dy * dy) as dist",
            "sqrt(pdx * pdx + pdy * pdy) / pdt as pv",
            "atan2(dy, dx) as ang",
            "atan2(pdy, pdx) as pang",
        )
        .selectExpr("*", "dist / dt as v", "ang - pang as bend")
        .selectExpr(
            *["session_id", "block", "tie", "t", "event", "is_ptr", "place"],
            *["t0", "t1", "vp_h", "doc_h", "pt", "ppt", "dt", "dist", "v", "ang"],
            f"{fold_angle('bend')} as turn",
            "abs(v - pv) / dt as acc",
        )
    )


def _block_table(blocked: DataFrame, viewport: DataFrame | None) -> DataFrame:
    """Per block its session's bounds and screen, and the two pointer events before it.

    ``blocked`` has the previous pointer events inside the block. The event is
    among the columns of the last one so that this and the steps read one shuffle.
    """
    last = "max(if(is_ptr, struct(t, tie, x, y, pt, px, py, event), null))"
    blocks = blocked.groupBy("session_id", "block").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.expr(last).alias("last")
    )
    session = "over (partition by session_id)"
    before = (
        "over (partition by session_id order by block rows between unbounded preceding and 1 preceding)"
    )
    ends = blocks.selectExpr(
        "session_id",
        "block",
        "last",
        f"min(first_t) {session} as t0",
        f"max(last_t) {session} as t1",
        f"last(last, true) {before} as one",
    ).selectExpr(
        "session_id",
        "block",
        "t0",
        "t1",
        "last",
        *[f"if(last.pt is null, one.{c}, last.p{c}) as two_{c}" for c in "txy"],
    ).selectExpr(
        "*", "if(last is null, null, struct(last, two_t, two_x, two_y)) as pair"
    )
    carried = ends.selectExpr("*", f"last(pair, true) {before} as before").selectExpr(
        "session_id",
        "block",
        "t0",
        "t1",
        *[f"before.last.{c} as c{c}" for c in "txy"],
        *[f"before.two_{c} as cc{c}" for c in "txy"],
    )
    return with_screen(carried, viewport)


def step_rows(
    events: DataFrame, viewport: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Events with their kinematic step, their session's bounds and screen, and ``block``.

    A block is ``hot_rows`` milliseconds of a session, so at an event a millisecond
    it holds that many rows, however long or busy the session is: blocks, not
    sessions, are dealt out and sorted. The first two pointer events of a block
    have their predecessors in earlier ones, which the block table names. That has
    a row per block, so all a session needs together is a row per ``hot_rows``
    milliseconds of its time.
    """
    # Both readers of the shuffle need these, and only equal shuffles are shared.
    blocks = (
        _prepare(events)
        .selectExpr("*", f"cast(floor(t / {float(hot_rows)}D) as long) as block")
        .where("session_id is not null and block is not null")
    )
    blocked = _with_previous(
        blocks.repartition("session_id", "block"), "session_id", "block", "is_ptr"
    )
    joined = blocked.join(_block_table(blocked, viewport), ["session_id", "block"])
    first = lambda c: f"if(place = 1, c{c}, p{c}) as p{c}"
    second = lambda c: f"case place when 1 then cc{c} when 2 then c{c} else pp{c} end as pp{c}"
    kept = [c for c in joined.columns if c not in {f"{p}{c}" for p in ("p", "pp") for c in "txy"}]
    return _steps(joined.selectExpr(*kept, *map(first, "txy"), *map(second, "txy")))


def kinematic_steps(
    events: DataFrame, viewport: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every event with its step: pointer events against the one before in the session.

    Non-pointer events and the first pointer event of a session carry no step.
    """
    steps = step_rows(events, viewport, hot_rows)
    return steps.selectExpr("*", f"{angle_bin('ang')} as bin").selectExpr(
        "session_id",
        "tie",
        "t",
        "event",
        "is_ptr",
        "if(is_ptr and pt is not null, dt, null) as dt",
        *[f"if(is_ptr, {c}, null) as {c}" for c in ("dist", "v", "ang", "acc", "turn", "bin")],
    )


class _Grid:
    """Window geometry in panes; all parameters are whole milliseconds."""

    def __init__(self, size: int, stride: int, horizon: int):
        for name, value, least in (("size", size, 1), ("stride", stride, 1), ("horizon", horizon, 0)):
            if value != int(value) or value < least:
                raise ValueError(f"{name} must be a whole number of at least {least} ms")
        self.size_ms, self.stride_ms = int(size), int(stride)
        self.pane_ms = math.gcd(int(size), int(stride), int(horizon))
        self.size = int(size) // self.pane_ms
        self.stride = int(stride) // self.pane_ms
        self.horizon = int(horizon) // self.pane_ms

    def pane(self, t: str) -> str:
        return f"cast(floor(({t} - t0) / {float(self.pane_ms)}D) as long)"

    @property
    def last_window(self) -> str:
        return f"cast(floor((t1 - t0 - {float(self.size_ms)}D) / {float(self.stride_ms)}D) as long)"

    def first_window_reaching(self, reach: int) -> str:
        """Lowest window whose first ``reach`` panes hold the pane."""
        return f"greatest(0L, cast(floor((pane - {reach - self.stride}) / {self.stride}) as long))"


def _pane_sums(steps: DataFrame, grid: _Grid) -> DataFrame:
    """Sums per pane, split by the panes in which a step and its predecessor begin.

    That split is what lets a window tell which steps lie inside it. A start too
    far back to share a window with the event counts as none.
    """
    start = lambda t: (
        f"if(is_ptr and {grid.pane(t)} > {grid.pane('t')} - {grid.size}, {grid.pane(t)}, null)"
    )
    step, turn = "from_pane is not null", "from2_pane is not null"
    sums = {
        "n": "count(1)",
        "n_step": f"count_if({step})",
        "sum_v": f"sum(v) filter (where {step})",
        "max_v": f"max(v) filter (where {step})",
        "sum_dist": f"sum(dist) filter (where {step})",
        "n_turn": f"count_if({turn})",
        "sum_acc": f"sum(acc) filter (where {turn})",
        "hesitations": f"count_if({turn} and hesitates)",
        **{name: f"count_if({step} and bin = {i})" for i, name in enumerate(BINS)},
        **{o: f"count_if({o})" for o in OUTCOMES},
    }
    return (
        steps.where(f"t1 - t0 >= {float(grid.size_ms)}D")
        .selectExpr(
            "*",
            f"{grid.pane('t')} as pane",
            f"{start('pt')} as from_pane",
            f"{start('ppt')} as from2_pane",
            f"{angle_bin('ang')} as bin",
            f"{exceeds('turn', HESITATION_TURN)} as hesitates",
            *[f"{is_outcome('event', o)} as {o}" for o in OUTCOMES],
        )
        .groupBy("session_id", "block", "is_ptr", "pane", "from_pane", "from2_pane")
        .agg(
            *[F.min(c).alias(c) for c in ("t0", "t1", "vp_h", "doc_h")],
            *[F.expr(e).alias(name) for name, e in sums.items()],
        )
    )


def _copies(panes: DataFrame, grid: _Grid) -> DataFrame:
    """Pane rows copied into the windows whose span, or horizon, holds them."""
    far = grid.first_window_reaching(grid.size + grid.horizon)
    near = grid.first_window_reaching(grid.size)
    return (
        panes.selectExpr(
            "*",
            f"if({' + '.join(OUTCOMES)} > 0, {far}, {near}) as low",
            f"least({grid.last_window}, cast(floor(pane / {grid.stride}) as long)) as high",
        )
        .where("low <= high")
        .selectExpr("*", "explode(sequence(low, high)) as window_idx")
        .drop("low", "high")
    )


def window_totals(
    events: DataFrame,
    viewport: DataFrame | None = None,
    window_size_ms: int = WINDOW_SIZE_MS,
    stride_ms: int = STRIDE_MS,
    prediction_horizon_ms: int = PREDICTION_HORIZON_MS,
    min_events_per_window: int = MIN_EVENTS_PER_WINDOW,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Unscaled sums per window, for windows with enough events of any kind."""
    grid = _Grid(window_size_ms, stride_ms, prediction_horizon_ms)
    copies = _copies(_pane_sums(step_rows(events, viewport, hot_rows), grid), grid)
    if min_events_per_window <= 0:
        copies = copies.unionByName(_empty_windows(events, viewport, grid), allowMissingColumns=True)

    begin = f"window_idx * {grid.stride}"
    inside = f"pane < {begin} + {grid.size}"
    step = f"{inside} and from_pane >= {begin}"
    turn = f"{inside} and from2_pane >= {begin}"
    total = lambda cond, c: f"coalesce(sum({c}) filter (where {cond}), 0L)"
    sums = {
        "n": total(inside, "n"),
        "n_step": total(step, "n_step"),
        "sum_v": f"sum(sum_v) filter (where {step})",
        "max_v": f"max(max_v) filter (where {step})",
        "sum_dist": f"sum(sum_dist) filter (where {step})",
        "n_turn": total(turn, "n_turn"),
        "sum_acc": f"sum(sum_acc) filter (where {turn})",
        "hesitations": total(turn, "hesitations"),
        **{name: total(step, name) for name in BINS},
        "in_hovers": total(inside, "hovers"),
        "in_scrolls": total(inside, "scrolls"),
        **{o: total(f"not ({inside})", o) for o in OUTCOMES},
    }
    totals = copies.groupBy("session_id", "window_idx").agg(
        *[F.min(c).alias(c) for c in ("t0", "vp_h", "doc_h")],
        *[F.expr(e).alias(name) for name, e in sums.items()],
    )
    start = f"t0 + window_idx * {float(stride_ms)}D"
    return totals.where(f"n >= {min_events_per_window}").selectExpr(
        "*", f"{start} as window_start", f"{start} + {float(window_size_ms)}D as window_end"
    )


def _empty_windows(events: DataFrame, viewport: DataFrame | None, grid: _Grid) -> DataFrame:
    """One row without events per window of the grid, for when empty windows count."""
    bounds = session_bounds(_prepare(events), "session_id", "t")
    sessions = with_screen(bounds, viewport).select(
        "session_id",
        F.col("first_pos").alias("t0"),
        F.col("last_pos").alias("t1"),
        "vp_h",
        "doc_h",
    )
    sized = sessions.selectExpr("*", f"{grid.last_window} + 1 as n_windows")
    return (
        explode_range(sized, "n_windows", "window_idx", spread=True)
        .drop("n_windows")
        .selectExpr("*", f"window_idx * {grid.stride} as pane", "0L as n")
    )


def raw_features(totals: DataFrame, window_size_ms: int = WINDOW_SIZE_MS) -> DataFrame:
    """The nine features of a window in their own units."""
    depth = f"in_scrolls * {PX_PER_SCROLL_STEP}D / greatest(doc_h - vp_h, 1D) * 100D"
    measured = (
        "if(n_step > 0, sum_v / n_step, 0D)",
        "if(n_step > 0, max_v, 0D)",
        "if(n_turn > 0, sum_acc / n_turn, 0D)",
        "cast(hesitations as double)",
        "if(n_step > 0, sum_dist, 0D)",
        f"in_hovers * {MS_PER_HOVER}D",
        f"least(100D, {depth})",
        f"in_scrolls * {PX_PER_SCROLL_SPEED}D / {float(window_size_ms)}D",
    )
    return totals.selectExpr("*", f"{' + '.join(BINS)} as n_angles").selectExpr(
        "*",
        *[f"{e} as {name}" for name, e in zip(FEATURES, measured)],
        f"{normalised_entropy(BINS, 'n_angles')} as {FEATURES[-1]}",
    )


def scale_features(window_size_ms: int = WINDOW_SIZE_MS) -> dict[str, str]:
    """SQL of the nine features of ``raw_features`` divided by their full value and clipped to [0, 1]."""
    full = (
        SPEED_MEAN_FULL,
        SPEED_MAX_FULL,
        ACCELERATION_FULL,
        HESITATION_FULL,
        LENGTH_FULL,
        float(window_size_ms),
        SCROLL_DEPTH_FULL,
        SCROLL_SPEED_FULL,
        1.0,
    )
    return {
        name: clip01(f"{name} / {f!r}D", can_be_nan=name in MEASURED)
        for name, f in zip(FEATURES, full)
    }


def micro_tensor(
    events: DataFrame,
    viewport: DataFrame | None = None,
    window_size_ms: int = WINDOW_SIZE_MS,
    stride_ms: int = STRIDE_MS,
    prediction_horizon_ms: int = PREDICTION_HORIZON_MS,
    min_events_per_window: int = MIN_EVENTS_PER_WINDOW,
    rapid_scroll_over: int = RAPID_SCROLL_OVER,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Scaled features and next-action label per window.

    ``events``: ``session_id, timestamp, tie, event, xpos, ypos``, where ``tie``
    orders events of the same time. ``viewport``: at most one row per session
    with ``vp_w, vp_h, doc_w, doc_h``.
    """
    totals = window_totals(
        events,
        viewport,
        window_size_ms,
        stride_ms,
        prediction_horizon_ms,
        min_events_per_window,
        hot_rows,
    )
    raw = raw_features(totals, window_size_ms)
    samples = sample_columns("CK", scale_features(window_size_ms), horizon_label(rapid_scroll_over))
    return raw.selectExpr(
        "session_id", "window_idx", "window_start", "window_end", *samples, "n as n_events"
    ).select(*SAMPLE_COLUMNS, "n_events")
