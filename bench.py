"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "flagship_which_candidate_to_join", "a09_a10_dataset_features", "j03_many_candidate_join",
    "j08_containment", "c01_pearson", "c04_spearman", "j06_negative_pairs", "l04_l08_all_policies",
    "r01_rankings", "r02_classification_report", "r04_ndcg_by_rank", "k08_correlation",
    "k06_recursive_elimination", "m01_scores_before_and_after", "u11_prune_and_select_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("joinlift-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from joinlift.plans import catalogue
    catalogue.QUERIES["a03_mean"](spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
