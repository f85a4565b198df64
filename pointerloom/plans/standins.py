"""The driver's tables as interaction logs (see FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# One time unit of the event log, so that a window of 500 units spans 96 hours.
UNIT_MS = 691_200
EPOCH_DAY = "2024-01-01"
LOG_EVENTS = {
    "view": "mousemove",
    "click": "click",
    "purchase": "mouseover",
    "signup": "scroll",
    "error": "blur",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _wall_ms(ts: Column) -> Column:
    """Milliseconds of a wall-clock time since ``EPOCH_DAY``, in any session time zone."""
    days = F.date_diff(ts.cast("date"), F.lit(EPOCH_DAY).cast("date")).cast("long")
    seconds = F.extract(F.lit("SECOND"), ts)
    minutes = (days * 24 + F.hour(ts)) * 60 + F.minute(ts)
    return minutes * 60_000 + F.floor(seconds * 1000).cast("long")


def ck_events(spark: SparkSession, folder: str) -> DataFrame:
    """Pointer events of a user: the event log with its values as coordinates."""
    names = F.create_map(*[F.lit(v) for pair in LOG_EVENTS.items() for v in pair])
    return table(spark, folder, "events").select(
        F.col("user_id").alias("session_id"),
        F.floor(_wall_ms(F.col("ts")) / UNIT_MS).alias("timestamp"),
        F.col("event_id").alias("tie"),
        names[F.col("event_type")].alias("event"),
        F.col("value").alias("xpos"),
        F.get_json_object("props", "$.k").cast("double").alias("ypos"),
    )


def skewed_events(spark: SparkSession, folder: str) -> DataFrame:
    """The pointer events with every third user in one session."""
    hot = F.when(F.col("session_id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("session_id"))
    return ck_events(spark, folder).withColumn("session_id", hot)


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Sidecar XML of customers: whole sizes, failing ones, and none for every fifth."""
    key = F.col("c_custkey") % 5
    node = lambda name, text: F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))
    window = (
        F.when(key == 1, F.lit("1366x768"))
        .when(key == 2, F.lit("full"))
        .when(key == 3, F.lit("axb"))
        .otherwise(F.lit("800x600"))
    )
    document = (
        F.when(key == 2, F.lit("1024x1500")).when(key == 4, F.lit("x9")).otherwise(F.lit("1349x2400"))
    )
    return (
        table(spark, folder, "customer")
        .where(key != 0)
        .select(
            F.col("c_custkey").alias("session_id"),
            node("data", F.concat(node("window", window), node("document", document))).alias("value"),
        )
    )


def hvt_log(spark: SparkSession, folder: str) -> DataFrame:
    """Trajectory records of a supplier, not yet numbered."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("session_id"),
        F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
        .cast("double")
        .alias("day"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_quantity",
        "l_extendedprice",
        (F.col("l_quantity") / 10).alias("velocity"),
        (F.col("l_extendedprice") / 500).alias("distance"),
    )


# Order of a supplier's records after the day. Both values are part of it, so
# records that still tie are alike.
HVT_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]


def hmi_records(spark: SparkSession, folder: str) -> DataFrame:
    """HMI records: orders of a customer."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("epoch")
    )


def action_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON document per chat message, an action per line of its text.

    The turn decides the shape: a clickstream list, an actions list with number
    texts and a null ``previous_url``, bare actions between other values, or an
    object with a list and a single action. A line of at most 12 characters has
    a ``stay_seconds`` that is no number, which ends the reading.
    """
    seconds = lambda line: F.when(
        F.length(line) > 12, F.concat(F.length(line).cast("string"), F.lit("e-3"))
    ).otherwise(F.lit('"short"'))
    as_text = lambda line: F.when(
        F.length(line) > 12, F.concat(F.lit('" '), F.length(line).cast("string"), F.lit('e-3 "'))
    ).otherwise(F.lit("[1]"))
    action = lambda value, rest="": F.concat(
        F.lit('{"stay_seconds":'), value, F.lit(rest + "}")
    )
    lines = F.split("text", "\n")
    joined = lambda make: F.array_join(F.transform(lines, make), ",")
    shape = F.col("turn") % 4
    document = (
        F.when(
            shape == 0,
            F.concat(F.lit('[{"clickstream":['), joined(lambda x: action(seconds(x))), F.lit("]}]")),
        )
        .when(
            shape == 1,
            F.concat(
                F.lit('[{"clickstream":"none","actions":['),
                joined(lambda x: action(as_text(x), ',"previous_url":null')),
                F.lit("]}]"),
            ),
        )
        .when(
            shape == 2,
            F.concat(F.lit('[7,{"other":1},'), joined(lambda x: action(seconds(x))), F.lit("]")),
        )
        .otherwise(
            F.concat(
                F.lit('{"z":['),
                joined(lambda x: action(seconds(x))),
                F.lit('],"a":'),
                action(F.lit("9"), ',"previous_url":"x"'),
                F.lit(',"n":5}'),
            )
        )
    )
    return table(spark, folder, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("session_id"), document.alias("value")
    )


def conversation_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON document per conversation: a list of its messages, a dwell time of each."""
    back = F.when(F.col("turn") > 0, F.lit(',"previous_url":null')).otherwise(F.lit(""))
    item = F.concat(
        F.lit('{"stay_seconds":"'), (F.length("text") / 1000).cast("string"), F.lit('"'), back, F.lit("}")
    )
    return (
        table(spark, folder, "conversations")
        .groupBy(F.col("conv_id").alias("session_id"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", item.alias("item")))).alias("items"))
        .select("session_id", F.concat(F.lit("["), F.array_join("items.item", ","), F.lit("]")).alias("value"))
    )


def timings(spark: SparkSession, folder: str) -> DataFrame:
    """Latencies of a model: prices in millions."""
    return table(spark, folder, "lineitem").select((F.col("l_extendedprice") / 1e6).alias("latency_ms"))
