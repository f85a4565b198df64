"""Expressions, as columns or SQL text, with the NaN, NULL and ANSI behaviour the features need.

Spark orders NaN above every number, so ``least``/``greatest`` and ``>``
would turn a missing coordinate into 1.0 or into a hesitation. Every
comparison that can meet a NaN goes through a helper here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

N_BINS = 8
INNER_EDGES = tuple(-math.pi + i * (2 * math.pi / N_BINS) for i in range(1, N_BINS))

# What float() takes as a number, blanks around it aside.
NUMBER = r"^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
PLAIN = r"^[0-9eE.+-]+$"
NAN = r"(?i)^[+-]?nan$"
INFINITY = r"(?i)^([+-]?)(inf|infinity)$"


def clip01(value: str, can_be_nan: bool = True) -> str:
    """SQL that clips a value to [0, 1]; NaN stays NaN."""
    clipped = f"greatest(0D, least(1D, {value}))"
    return f"if(isnan({value}), {value}, {clipped})" if can_be_nan else clipped


def fold_angle(diff: str) -> str:
    """SQL of an absolute angle difference folded to at most half a turn."""
    return f"if(abs({diff}) > {math.pi!r}D, {2 * math.pi!r}D - abs({diff}), abs({diff}))"


def exceeds(value: str, limit: float) -> str:
    """SQL of ``value > limit``, false for NaN."""
    return f"({value} > {limit!r}D and not isnan({value}))"


def angle_bin(angle: str) -> str:
    """SQL of the bin 0..7 of an angle on [-pi, pi]; NULL for NaN and NULL."""
    passed = " + ".join(f"if({angle} >= {edge!r}D, 1, 0)" for edge in INNER_EDGES)
    return f"if({angle} is not null and not isnan({angle}), {passed}, null)"


def normalised_entropy(counts: list[str], total: str) -> str:
    """SQL of a histogram's Shannon entropy over log2 of its bin count; 0 if it is empty.

    ``counts`` names the columns of the bins and ``total`` that of their sum.
    Adding 0 turns a negative zero into a plain one.
    """
    bits = " + ".join(f"if({c} > 0, {c} * log2({c} / {total}), 0D)" for c in counts)
    scale = math.log2(len(counts))
    return f"if({total} > 0, -({bits}) / {total} / {scale!r}D + 0D, 0D)"


def _any_float(text: Column) -> Column:
    """``float()`` of any text that is more than plain number characters."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    digits = F.when(bare.rlike(NUMBER), F.regexp_replace(bare, "_", ""))
    infinity = F.when(bare.startswith("-"), float("-inf")).otherwise(float("inf"))
    return (
        F.when(bare.rlike(NAN), float("nan"))
        .when(bare.rlike(INFINITY), infinity)
        .otherwise(digits.try_cast("double"))
    )


def python_float(text: Column) -> Column:
    """Number held by a text, by the rules of ``float()``; NULL where it would raise.

    A cast alone is too lenient: it takes a type suffix such as ``1366d``. It is
    right for texts of plain number characters, which is nearly all of them. All
    others are read in a lambda, so that ``text`` is not written out once for each use:
    a generated method of that length would never be compiled by the JVM.
    """
    return F.when(text.rlike(PLAIN), text.try_cast("double")).when(
        text.isNotNull(), F.get(F.transform(F.array(text), _any_float), F.lit(0))
    )
