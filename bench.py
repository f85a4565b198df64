"""Time the headline queries and print one line of JSON.

``BENCH_SF_DIR`` is the folder of the tables, ``BENCH_CPUS`` the local cores.
Each query runs once to warm up; the better of two more runs counts. Results go
to a sink that keeps nothing. ``BENCH_BRUTE=1`` also times the windows-by-events form in Spark SQL.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from pointerloom.plans.queries import QUERIES

HEADLINE = {
    "micro_tensor": "events",
    "ck_labels": "events",
    "hvt_windows": "lineitem",
    "hmi_samples": "orders",
    "ap_samples": "conversations",
    "sequences_session": "events",
    "feature_corr": None,
    "epoch_metrics": "events",
}


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pointerloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        # Tables of a few MB: keep shuffles spread over the cores all the same.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )


def timed(make) -> float:
    start = time.perf_counter()
    df: DataFrame = make()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def brute_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The pointer windows as SQL that joins each window with its events."""
    from pointerloom.plans.standins import ck_events

    ck_events(spark, folder).createOrReplaceTempView("pointer_log")
    return spark.sql("""
        WITH bounds AS (
          SELECT session_id, min(timestamp) t0, max(timestamp) t1 FROM pointer_log GROUP BY 1),
        win AS (
          SELECT session_id, k, t0 + k * 250 AS ws
          FROM bounds LATERAL VIEW explode(sequence(0L, (t1 - t0 - 500) div 250)) g AS k
          WHERE t1 - t0 >= 500),
        inside AS (
          SELECT w.session_id, w.k, e.* EXCEPT (session_id)
          FROM win w JOIN pointer_log e
            ON e.session_id = w.session_id AND e.timestamp >= w.ws AND e.timestamp < w.ws + 500),
        seg AS (
          SELECT *, xpos - lag(xpos) OVER o AS dx, ypos - lag(ypos) OVER o AS dy,
                 greatest(timestamp - lag(timestamp) OVER o, 1) AS dt
          FROM inside WHERE event IN ('mousemove', 'mouseover', 'click')
          WINDOW o AS (PARTITION BY session_id, k ORDER BY timestamp, tie)),
        seg2 AS (
          SELECT *, sqrt(dx * dx + dy * dy) / dt AS v, atan2(dy, dx) AS ang FROM seg),
        moves AS (
          SELECT session_id, k, avg(v) mean_v, max(v) max_v, count(v) n FROM seg2 GROUP BY 1, 2),
        ahead AS (
          SELECT w.session_id, w.k, count_if(event = 'click') clicks, count_if(event = 'scroll') scrolls
          FROM win w JOIN pointer_log e
            ON e.session_id = w.session_id AND e.timestamp >= w.ws + 500 AND e.timestamp < w.ws + 2000
          GROUP BY 1, 2)
        SELECT * FROM moves LEFT JOIN ahead USING (session_id, k)""")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    rows = {
        t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in HEADLINE.values() if t
    }
    seconds = {}
    for name in HEADLINE:
        timed(lambda: QUERIES[name](spark, folder))
        seconds[name] = min(timed(lambda: QUERIES[name](spark, folder)) for _ in range(2))
    result = {
        "metric": "headline queries, warm",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rows_per_sec": {
            n: round(rows[t] / seconds[n]) for n, t in HEADLINE.items() if t
        },
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if os.environ.get("BENCH_BRUTE"):
        timed(lambda: brute_windows(spark, folder))
        result["brute_windows"] = timed(lambda: brute_windows(spark, folder))
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
