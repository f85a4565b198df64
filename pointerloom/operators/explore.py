"""Exploration of samples: counts, correlation, densities, value ranges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointerloom.schema import FEATURES, SOURCES

GRID_POINTS = 200
GRID_CUT = 3.0
# Bandwidths beyond which a kernel adds nothing: exp(-40.5) is below 3e-18.
KERNEL_CUT = 9.0


def source_counts(samples: DataFrame) -> DataFrame:
    """Samples per source, 0 for a source without any."""
    listed = samples.sparkSession.range(len(SOURCES)).select(
        F.array(*[F.lit(s) for s in SOURCES])[F.col("id").cast("int")].alias("source")
    )
    counts = samples.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return listed.join(counts, "source", "left").select(
        "source", F.coalesce("n", F.lit(0).cast("long")).alias("n_samples")
    )


def _unpivot(samples: DataFrame, *keys: str) -> DataFrame:
    values = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES]
    )
    return samples.select(*keys, F.explode(values).alias("c")).select(*keys, "c.feature", "c.value")


def feature_corr(samples: DataFrame) -> DataFrame:
    """Pearson correlation of each pair of features, NULL where one is constant.

    Rows with a missing value in either feature are left out of that pair. Samples are
    aggregated once, by which of their features are missing: means, extremes, central
    second moments and sums of products, combined map-side and few enough for one
    generated loop. Pairs put together the groups that have both features, as moments
    can be merged. Products are taken off their means, so a pair whose deviations are
    both below a thousandth of their means may lose its sixth digit.
    """
    names = list(FEATURES)
    missing = " + ".join(f"if({f} is null or isnan({f}), {1 << i}, 0)" for i, f in enumerate(names))
    moments = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(names):
        moments += [F.expr(f"{e}({a})").alias(f"{e}_{i}") for e in ("min", "max", "var_pop")]
        moments += [
            F.sum(F.col(a) * F.col(b) if i != j else F.col(a)).alias(f"sum_{i}_{j}")
            for j, b in enumerate(names)
            if j >= i
        ]
    groups = samples.selectExpr(*names, f"{missing} as lacks").groupBy("lacks").agg(*moments)
    mean = lambda i: F.col(f"sum_{i}_{i}") / F.col("n")
    product = lambda i, j: F.col(f"sum_{i}_{j}") / F.col("n") - mean(i) * mean(j)
    side = lambda i: F.struct(
        F.lit(names[i]).alias("feature"),
        mean(i).alias("mean"),
        *[F.col(f"{e}_{i}").alias(e) for e in ("min", "max", "var_pop")],
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit((1 << i) | (1 << j)).alias("needs"),
                side(i).alias("a"),
                side(j).alias("b"),
                (product(i, j) if i != j else F.col(f"var_pop_{i}")).alias("cov"),
            )
            for i in range(len(names))
            for j in range(i, len(names))
        ]
    )
    keys = ["feature_a", "feature_b"]
    parts = groups.select("n", "lacks", F.explode(pairs).alias("p")).where("lacks & p.needs = 0").select(
        "n",
        F.col("p.a.feature").alias("feature_a"),
        F.col("p.b.feature").alias("feature_b"),
        "p.a",
        "p.b",
        "p.cov",
    )
    # At most a group for each set of missing features meets here.
    held = parts.groupBy(*keys).agg(F.collect_list(F.struct("n", "a", "b", "cov")).alias("g"))
    weighed = lambda what: f"aggregate(g, 0D, (s, x) -> s + x.n * ({what}))"
    of_all = held.selectExpr(
        "*",
        *[f"{weighed(f'x.{c}.mean')} / {weighed('1')} as mean_{c}" for c in "ab"],
        *[f"array_max(transform(g, x -> x.{c}.max)) > array_min(transform(g, x -> x.{c}.min)) as varies_{c}" for c in "ab"],
    )
    # Moments inside the groups and of the groups' means against those of all.
    total = lambda inside, x, y: weighed(
        f"x.{inside} + (x.{x}.mean - mean_{x}) * (x.{y}.mean - mean_{y})"
    )
    spread = f"sqrt({total('a.var_pop', 'a', 'a')}) * sqrt({total('b.var_pop', 'b', 'b')})"
    corr = of_all.where("varies_a and varies_b").selectExpr(
        *keys, f"try_divide({total('cov', 'a', 'b')}, {spread}) as corr"
    )
    ordered = F.array(
        *[
            F.struct(*[F.lit(names[k]).alias(c) for k, c in zip((i, j), keys)])
            for i in range(len(names))
            for j in range(i, len(names))
        ]
    )
    both = F.array_distinct(
        F.array(
            F.struct(F.col("feature_a").alias("x"), F.col("feature_b").alias("y")),
            F.struct(F.col("feature_b").alias("x"), F.col("feature_a").alias("y")),
        )
    )
    return (
        samples.sparkSession.range(1)
        .select(F.inline(ordered))
        .join(corr, keys, "left")
        .select(F.explode(both).alias("p"), "corr")
        .select(F.col("p.x").alias("feature_a"), F.col("p.y").alias("feature_b"), "corr")
    )


def feature_density(
    samples: DataFrame,
    features: tuple[str, ...] = ("meanVelocity", "hesitationCount"),
    points: int = GRID_POINTS,
) -> DataFrame:
    """Gaussian density of features per source on an even grid.

    Each source is normalised on its own. Bandwidth is Scott's rule for one
    dimension, sample deviation times n^(-1/5) (Scott 1992); the grid runs three
    bandwidths past the extremes. Sources whose values are all alike have none.

    Moments come from one pass, combined map-side, and are a row per source and
    feature. In a second pass each value adds to the grid points within
    ``KERNEL_CUT`` bandwidths, beyond which a kernel is below the last digit of a
    double; as the bandwidth shrinks with n these become few. Sums per point are
    combined map-side, so nothing but they is shuffled and nothing is written.
    """
    keys = ["source", "feature"]
    usable = lambda f: F.when(~F.isnan(f), F.col(f))
    moments = samples.groupBy("source").agg(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.count(usable(f)).alias("n"),
                F.stddev_samp(usable(f)).alias("deviation"),
                F.min(usable(f)).alias("lowest"),
                F.max(usable(f)).alias("highest"),
            ).alias(f"_{i}")
            for i, f in enumerate(features)
        ]
    )
    shape = (
        moments.select("source", F.explode(F.array(*[f"_{i}" for i in range(len(features))])).alias("m"))
        .select("source", "m.*")
        .where("highest > lowest")
        .withColumn("h", F.expr("deviation * pow(double(n), -0.2D)"))
        .withColumn("start", F.col("lowest") - GRID_CUT * F.col("h"))
        .withColumn(
            "width", (F.col("highest") + GRID_CUT * F.col("h") - F.col("start")) / (points - 1)
        )
        .select(*keys, "n", "h", "start", "width")
    )
    values = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features]
    )
    place = lambda side, whole: whole(
        (F.col("value") + side * KERNEL_CUT * F.col("h") - F.col("start")) / F.col("width")
    ).cast("int")
    first = F.greatest(place(-1, F.ceil), F.lit(0))
    last = F.least(place(1, F.floor), F.lit(points - 1))
    at = F.col("start") + F.col("point") * F.col("width")
    z = (at - F.col("value")) / F.col("h")
    heights = (
        samples.select("source", F.explode(values).alias("c"))
        .select("source", "c.feature", "c.value")
        .where("value is not null and not isnan(value)")
        .join(F.broadcast(shape), keys)
        .withColumn("point", F.explode(F.sequence(first, last)))
        .groupBy(*keys, "point")
        .agg(F.sum(F.exp(-0.5 * z * z)).alias("height"))
    )
    grid = shape.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    mass = F.col("n") * F.col("h") * math.sqrt(2 * math.pi)
    return grid.join(heights, [*keys, "point"], "left").select(
        *keys, "point", at.alias("x"), (F.coalesce("height", F.lit(0.0)) / mass).alias("density")
    )


def feature_range(samples: DataFrame) -> DataFrame:
    """Per source and feature: extremes, shares at 0 and 1, and missing values."""
    value = F.col("value")
    usable = F.when(~F.isnan(value), value)
    part = lambda cond: F.count(F.when(cond, True)) / F.count(F.lit(1))
    return (
        _unpivot(samples, "source")
        .groupBy("source", "feature")
        .agg(
            F.min(usable).alias("lowest"),
            F.max(usable).alias("highest"),
            part(value == 0.0).alias("share_at_0"),
            part(value == 1.0).alias("share_at_1"),
            F.count(F.when(value.isNull() | F.isnan(value), True)).alias("n_missing"),
        )
    )
