"""Headline queries on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then up to ``BENCH_RUNS`` times (3) while it stays under ``BENCH_SECONDS`` in all (20);
the median counts, and the Spark jobs of the last run are listed beside it.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "va24_validate_record", "qa04_rule_results", "qa09_overall_score", "qa13_profile", "pl01_bronze_claims", "pl03_silver_claims",
    "ag01_provider_performance", "ag02_member_utilization", "ag03_hourly_quality", "ag04_table_metrics", "jn02_eligibility", "jn06_prior_auth",
    "jn08_duplicate", "jn09_duplicate_30d", "jn12_enrichment", "jn13_amount_spike", "jn14_percentile", "wn03_trailing_utilization",
    "an01_zscore", "an02_iqr", "an03_volume_change", "an04_seasonal", "an06_high_claims", "an08_provider_shopping", "an10_isolation_forest",
    "an11_density_noise", "an12_detection_summary", "mo01_window_profile", "mo03_js_drift", "pr01_text_identifiers", "al04_suppression",
    "al08_component_health", "rh04_retry_plan", "us01_tenant_usage", "bi02_invoices", "snk01_upsert", "src01_file_stream", "st07_tumbling",
)


def main():
    from dqflow.catalog import QUERIES
    from dqflow.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs, budget = int(os.environ.get("BENCH_RUNS", "3")), float(os.environ.get("BENCH_SECONDS", "20"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.sql.files.openCostInBytes": "1048576",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    tracker = spark.sparkContext.statusTracker()

    def once(name, group):
        spark.sparkContext.setJobGroup(group, name)
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - start

    QUERIES["ag07_claims_summary"](spark, sf_dir).collect()
    only = sys.argv[1:]
    times, jobs = {}, {}
    for name in [q for q in HEADLINE if q in QUERIES]:
        if only and name not in only:
            continue
        spent, measured = once(name, f"{name}-warm"), []
        while not measured or (len(measured) < runs and spent + measured[-1] < budget):
            measured.append(once(name, f"{name}-{len(measured)}"))
            spent += measured[-1]
        times[name] = round(statistics.median(measured), 3)
        jobs[name] = len(tracker.getJobIdsForGroup(f"{name}-{len(measured) - 1}"))
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "jobs": jobs,
    }))


if __name__ == "__main__":
    main()
