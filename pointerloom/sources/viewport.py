"""Screen sizes from XML sidecars, joined to sessions by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointerloom.functions.expr import python_float
from pointerloom.schema import DEFAULT_DOCUMENT, DEFAULT_VIEWPORT
from pointerloom.sources.listing import full_names, walk
from pointerloom.sources.texts import whole_texts


def _size(text: Column) -> tuple[Column, Column, Column]:
    """Width and height of ``WxH``, and whether the text is meant as a size."""
    parts = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "x")
    return (
        python_float(F.get(parts, 0)),
        python_float(F.get(parts, 1)),
        F.coalesce(F.contains(text, F.lit("x")), F.lit(False)),
    )


def screen_sizes(window: Column, document: Column) -> list[Column]:
    """``vp_w, vp_h, doc_w, doc_h`` from the texts of a sidecar's two nodes.

    A text without an ``x`` keeps the default. A window text that fails to
    convert ends the reading, so the document keeps its default too; a document
    text that fails leaves the window as read.
    """
    vw, vh, has_window = _size(window)
    dw, dh, has_document = _size(document)
    window_ok = has_window & vw.isNotNull() & vh.isNotNull()
    stopped = has_window & ~(vw.isNotNull() & vh.isNotNull())
    document_ok = ~stopped & has_document & dw.isNotNull() & dh.isNotNull()
    pick = lambda ok, value, default, name: (
        F.when(ok, value).otherwise(F.lit(default)).alias(name)
    )
    return [
        pick(window_ok, vw, DEFAULT_VIEWPORT[0], "vp_w"),
        pick(window_ok, vh, DEFAULT_VIEWPORT[1], "vp_h"),
        pick(document_ok, dw, DEFAULT_DOCUMENT[0], "doc_w"),
        pick(document_ok, dh, DEFAULT_DOCUMENT[1], "doc_h"),
    ]


def parse_sidecars(sidecars: DataFrame) -> DataFrame:
    """Screen sizes of ``session_id, value`` rows, ``value`` being a sidecar's XML.

    Text that is no XML gives the defaults.
    """
    nodes = F.from_xml(
        F.col("value"),
        "window string, document string, _corrupt_record string",
        {"mode": "PERMISSIVE"},
    )
    return sidecars.select("session_id", nodes.alias("n")).select(
        "session_id", *screen_sizes(F.col("n.window"), F.col("n.document"))
    )


def sidecar_path(csv_path: Column) -> Column:
    """Path of a session's sidecar: each ``.csv`` in the path becomes ``.xml``."""
    return F.replace(csv_path, F.lit(".csv"), F.lit(".xml"))


def read_viewports(spark: SparkSession, folder: str, sessions: DataFrame) -> DataFrame:
    """Screen sizes of the ``sessions`` (CSV paths) that have a sidecar under ``folder``.

    Both sides have one row per file, too many for a broadcast where a session is a file. A
    session's sidecar that Spark leaves out stops the read; others are not needed.
    """
    places = full_names(spark, folder)
    files = walk(spark, places).where(F.endswith("path", F.lit(".xml")))
    ignored = files.where("ignored")
    if not ignored.isEmpty():
        plain = F.regexp_replace(sidecar_path(F.col("session_id")), "^file:/+", "file:/")
        missed = sessions.select(plain.alias("file_path")).distinct().join(ignored.hint("merge"), "file_path")
        names = sorted(r.path for r in missed.select("path").collect())
        if names:
            raise ValueError("Spark does not read these sidecars; rename: " + ", ".join(names))
    texts = whole_texts(spark, places, "*.xml", files.where("not ignored"))
    return parse_sidecars(
        sessions.select("session_id")
        .distinct()
        .withColumn("file_path", sidecar_path(F.col("session_id")))
        .join(texts.hint("merge"), "file_path")
    )
