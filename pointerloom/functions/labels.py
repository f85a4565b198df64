"""Outcome rules: what a window's user does next."""

from __future__ import annotations

from pointerloom.schema import LABELS, RAPID_SCROLL_OVER

# Event names that decide an outcome (fixed values).
OUTCOME_EVENTS = {
    "clicks": ("click", "mousedown"),
    "scrolls": ("scroll",),
    "hovers": ("mouseover",),
    "exits": ("beforeunload", "blur"),
}


def is_outcome(event: str, outcome: str) -> str:
    """SQL that tells whether an event counts for an outcome."""
    names = ", ".join(f"'{n}'" for n in OUTCOME_EVENTS[outcome])
    return f"{event} in ({names})"


def horizon_label(rapid_scroll_over: int = RAPID_SCROLL_OVER) -> str:
    """SQL of the label from the outcome counts in the horizon; the first rule that holds wins."""
    rules = (
        ("clicks > 0", "CLICK"),
        (f"scrolls > {rapid_scroll_over}", "RAPID_SCROLL"),
        ("hovers > 0", "HOVER_DWELL"),
        ("exits > 0", "BACKTRACK"),
    )
    cases = " ".join(f"when {rule} then {LABELS[name]}" for rule, name in rules)
    return f"case {cases} else {LABELS['IDLE']} end"
