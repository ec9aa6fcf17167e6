"""Time the headline jobs once, after a warm-up. Prints one JSON line.

BENCH_SF_DIR: data folder, BENCH_CPUS: local cores, BENCH_ONLY: comma-separated name prefixes
instead of the headline jobs, `all` for every job.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from firn.catalog import JOBS
from firn.session import local_session


# One job or more of every family; the checks cover the rest.
HEADLINE = (
    "s1_snow_scan", "n3_calendar_fields", "n6_water_year", "c1_drop_duplicates", "c5_fill_median",
    "c6_fill_knn", "c7_fill_interpolate", "c9_cap_zscore", "c10_cap_iqr", "c11_isolation_forest", "c15_clean",
    "j1_snow_climate", "j3_index_month", "j3_index_as_of", "a1_month_anomaly", "a2_station_stats",
    "a6_phase_rollup", "a7_region_rollup", "a10_profile", "a13_error_metrics", "w1_lag", "w2_rolling_mean",
    "w3_rolling_std", "w4_rolling_sum", "w7_water_year_total", "w9_sequences", "t2_top_k", "r4_regional_hazards",
    "r8_forecast_summary", "x1_scenario_text", "x3_labelled_sections", "x7_contract", "q1_apply_scenario",
    "q6_change_log", "q7_compare_scenarios", "m1_scale", "m2_temporal_split", "m4_penalties", "m5_random_forest",
    "m6_boosting", "m7_seasonal_trend", "m10_future_steps", "m14_outlook_predict", "m16_outlook_summary",
    "m18_daily_features",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    only = tuple(p for p in os.environ.get("BENCH_ONLY", "").split(",") if p)
    names = [n for n in JOBS if (only == ("all",) or n.startswith(only) if only else n in HEADLINE)]
    spark = local_session(cpus, shuffle_partitions=cpus)
    run = lambda name: JOBS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("m18_daily_features")
    times, failed = {}, {}
    for name in names:
        start = time.time()
        try:
            run(name)
            times[name] = round(time.time() - start, 3)
        except Exception as e:
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    out = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
