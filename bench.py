"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to compile and start workers, then BENCH_RUNS times; the best run counts.
Results go to Spark's noop sink, so all rows and columns are made and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

HEADLINE = (
    "savings_by_lang", "token_stats", "strip_html_comments", "strip_url_protocol", "collapse_blank_lines", "minify_code", "level3",
    "fence_parity", "dedup_lines", "section_numbers", "word_scores", "filler_share", "extract_tables", "grammar_strip", "deduplicate",
    "dictionary_compress", "minify_l1", "minify_l2", "minify_l3", "minify_l4", "minify_documents", "config_grid_savings", "corpus_summary",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from quillpress.plans.queries import QUERIES, TIMED

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        best = float("inf")
        for i in range(1 + int(os.environ.get("BENCH_RUNS", "1"))):
            began = time.perf_counter()
            (QUERIES | TIMED)[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began) if i else best
        times[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
