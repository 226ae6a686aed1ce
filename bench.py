"""Seconds per headline query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``, as one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringledger.functions.workspace import fresh_path
from ringledger.operators import counters
from ringledger.plans import catalog
from ringledger.sources import lines
from ringledger.sources.tables import event_records


def session(cpus: int) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def run(df: DataFrame) -> None:
    """Compute every row and column and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = os.environ.get("BENCH_ONLY", "")
    with contextlib.redirect_stdout(sys.stderr):
        spark = session(cpus)
        spark.sparkContext.setLogLevel("ERROR")
        run(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
        seconds: dict[str, float] = {}
        for name, build in catalog.queries().items():
            if only and name not in only.split(","):
                continue
            start = time.perf_counter()
            run(build(spark, sf_dir))
            seconds[name] = round(time.perf_counter() - start, 3)
            print(name, seconds[name], flush=True)

        text = fresh_path(spark, "bench-lines")
        lines.to_lines(event_records(spark, sf_dir)).write.text(text)
        raw = spark.read.option("lineSep", "\n").text(text)
        count = raw.count()
        folded = lines.records_of(lines.parse_lines(raw))
        run(counters.subscriber_usage(folded))
        start = time.perf_counter()
        run(counters.subscriber_usage(folded))
        rate = count / (time.perf_counter() - start)
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "all_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
                "parse_fold_rows_per_sec": round(rate),
            }
        )
    )


if __name__ == "__main__":
    main()
