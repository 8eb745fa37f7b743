"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Session start and one warm-up run of
each query are not counted; the reported time of a query is the better of two runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabsift.catalog import QUERIES  # noqa: E402
from tabsift.plans.flow import preview_path  # noqa: E402
from tabsift.session import configure, scratch_path  # noqa: E402
from tabsift.sources.writers import write_csv  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = {
    "column_filter": "column_keep",
    "row_filter": "row_gt",
    "regex_filter": "regex_documents",
    "expression_filter": "expression_filter",
    "preview": "preview_first_rows",
    "group_by": "group_by_all_aggs",
    "group_by_bracketed_median": "group_by_bracketed_median",
    "summary": "summary_moments",
    "summary_top": "summary_top",
    "cardinality": "cardinality_per_column",
    "schema_paths": "schema_paths",
    "chart_points": "chart_points",
    "quality": "quality_findings",
    "detect": "detect_corpus",
    "convert_to_jsonl": "convert_csv_to_jsonl",
    "convert_to_csv": "convert_jsonl_to_csv",
    "quota_rejects": "quota_rejects",
    "retention": "retention_counts",
    "job_fold": "job_fold",
}


def run(spark: SparkSession, name: str) -> float:
    start = time.perf_counter()
    # Every row is computed and nothing is kept.
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def previews(spark: SparkSession) -> dict[str, float]:
    """Preview of a CSV file with six columns, three kept; the file is written beforehand."""
    path = scratch_path(configure(spark), "preview")
    columns = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]
    write_csv(spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select(*columns), path)
    keep = {"kind": "column", "keep": columns[:3]}
    known = {"fmt": "csv", "multi_line": False,
             "schema": "l_orderkey bigint, l_partkey bigint, l_quantity double"}
    out = {}
    for label, options in (("preview_file_detected", {}), ("preview_file_known", known)):
        times = []
        for _ in range(3):
            start = time.perf_counter()
            preview_path(spark, path, keep, **options).collect()
            times.append(time.perf_counter() - start)
        out[label] = round(min(times[1:]), 3)
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for label, name in HEADLINE.items():
        run(spark, name)
        seconds[label] = round(min(run(spark, name), run(spark, name)), 3)
    seconds.update(previews(spark))
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
