"""Reader of action-path JSON files, a document per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointerloom.sources.listing import full_names, matching, walk
from pointerloom.sources.texts import whole_texts


def read_documents(spark: SparkSession, folder: str | list[str] | DataFrame) -> DataFrame:
    """Whole JSON files as ``session_id, value``. ``folder``: places, or files that tasks open."""
    places, files = [], folder
    if not isinstance(folder, DataFrame):
        places = full_names(spark, folder)
        files = matching(walk(spark, places), "*.json")
    return whole_texts(spark, places, "*.json", files).withColumnRenamed("file_path", "session_id")
