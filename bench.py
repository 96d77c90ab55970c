"""Time every query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The headline value is the sum over all queries. ``rows_per_sec`` is the rate of
the serving job (decode, score, threshold, count, append, answer) on 220,320
readings of 52 sensors of one machine, made from the readings of the test tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.plans import registry, serving
from gaugewell.plans.registry import CHECKS
from gaugewell.session import build_session, scratch_path

READINGS, REQUEST = 220_320, 20


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the readings of one machine, written before the clock runs."""
    rows = registry.vectors(spark, sf_dir)
    copies = -(-READINGS // max(1, rows.count()))
    many = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1))).alias("copy"))
    number = F.col("id") * copies + F.col("copy")
    one = many.where(number < READINGS).select(
        number.alias("n"), (F.col("ts") + F.make_dt_interval(secs=F.col("copy"))).alias("ts"), F.lit(7).alias("machine_id"),
        *registry.SENSORS,
    )
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n", F.struct("machine_id", *registry.SENSORS).alias("r")))), lambda i: i["r"]))
    path = scratch_path(spark, "requests")
    bodies = one.groupBy(F.floor(F.col("n") / REQUEST).alias("batch_id")).agg(F.min("ts").alias("ts"), body.alias("value"))
    # as many files as a queue would have given; one file would be one task
    bodies.repartition(4 * spark.sparkContext.defaultParallelism).write.parquet(path)
    return spark.read.parquet(path)


def serve(spark: SparkSession, bodies: DataFrame, scorer: serving.Scorer, append_id: int, table: str) -> float:
    limits = spark.createDataFrame([(7, 1.5)], "machine_id int, threshold double")
    began = time.perf_counter()
    served = serving.serve_batch(bodies, scorer, limits, table, append_id)
    served.response.write.format("noop").mode("overwrite").save()
    served.rejects.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or list(CHECKS)

    # start the Python workers and the JIT before the clock runs
    for name in ("anomaly_counter", "score_rows"):
        CHECKS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in names:
        began = time.perf_counter()
        CHECKS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)

    out = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    bodies, scorer, table = requests(spark, sf_dir), registry.scorer(spark, sf_dir), scratch_path(spark, "table")
    # the second run counts: the first compiles
    job = min(serve(spark, bodies, scorer, n, table) for n in (1, 2))
    out["serving_job_seconds"] = round(job, 3)
    out["rows_per_sec"] = round(READINGS / job)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
