"""One ordered table of samples from all sources, and fixed-length runs over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointerloom.operators.skew import number_rows
from pointerloom.schema import FEATURES, SAMPLE_COLUMNS, SEQ_LEN, source_rank

BUCKET = 65_536


def unite(samples: list[DataFrame]) -> DataFrame:
    """All samples in one schema; ``source_rank, session_id, window_idx`` orders them."""
    alike = [
        s.select(*[F.col(c).cast("string") if c == "session_id" else F.col(c) for c in SAMPLE_COLUMNS])
        for s in samples
    ]
    return reduce(DataFrame.unionByName, alike).withColumn(
        "source_rank", source_rank(F.col("source"))
    )


def sequences(
    samples: DataFrame,
    order: list[str],
    seq_len: int = SEQ_LEN,
    scope: str = "global",
    max_sequences: int | None = None,
    bucket: int = BUCKET,
    element: str = "float",
) -> DataFrame:
    """Runs of ``seq_len`` consecutive samples with the label of the last one.

    ``scope='global'`` slides over the whole ordered table, across sessions and
    sources; ``scope='session'`` keeps runs inside one session, and ``order``
    must then keep a session's rows together. Result: ``seq_id`` (position of
    the run's first sample in the table), the last sample's ``session_id`` and
    ``window_idx``, ``features`` (``seq_len`` arrays of nine) and ``label``.

    Rows are numbered, cut into buckets of equal size, and the last
    ``seq_len - 1`` rows of a bucket are copied to the next, so every run is
    whole in one bucket whatever the session sizes.
    """
    if scope not in ("global", "session"):
        raise ValueError("scope is 'global' or 'session'")
    if seq_len < 1 or bucket < seq_len:
        raise ValueError("need 1 <= seq_len <= bucket")
    tags = ["source"] if "source" in samples.columns else []
    columns = list(dict.fromkeys([*order, *tags, "session_id", "window_idx", *FEATURES, "label"]))
    numbered = number_rows(samples.select(*columns), order)
    if max_sequences is not None:
        numbered = numbered.where(F.col("idx") < max_sequences + seq_len - 1)
    home = F.floor(F.col("idx") / F.lit(bucket)).cast("long")
    spills = F.col("idx") % bucket >= bucket - (seq_len - 1)
    copied = numbered.select(
        "idx",
        *tags,
        "session_id",
        "window_idx",
        F.array(*[F.col(f).cast(element) for f in FEATURES]).alias("sample"),
        "label",
        F.explode(F.when(spills, F.array(home, home + 1)).otherwise(F.array(home))).alias("bucket"),
    )
    # Sources may use the same session ids.
    keys = ["bucket", *tags, "session_id"] if scope == "session" else ["bucket"]
    run = Window.partitionBy(*keys).orderBy("idx").rowsBetween(-(seq_len - 1), Window.currentRow)
    return (
        copied.withColumn("features", F.collect_list("sample").over(run))
        .withColumn("_from", F.min("idx").over(run))
        .where((F.size("features") == seq_len) & (home == F.col("bucket")))
        # Rows of other sessions may not lie between: then these are no run.
        .where(F.col("idx") - F.col("_from") == seq_len - 1)
        .select(
            (F.col("idx") - (seq_len - 1)).alias("seq_id"),
            "session_id",
            "window_idx",
            "features",
            "label",
        )
    )


def long_form(seqs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per sample of a run: ``keys, pos``, the nine features and the run's label."""
    return seqs.select(*keys, F.posexplode("features").alias("pos", "sample"), "label").select(
        *keys,
        "pos",
        *[F.col("sample")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)],
        "label",
    )
