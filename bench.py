"""Seconds per headline query. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallywing.plans.catalog import load  # noqa: E402
from tallywing.session import local_session  # noqa: E402

HEADLINE = [
    "bph_by_year", "totals_by_species", "survey_days", "days_per_year_stats", "total_effort", "bph_by_observer", "daily_bph",
    "detection_days", "species_all_years", "flight_composition", "collapse_dupes", "filter_by_frequency", "semi_species",
    "dirty_cast", "recode_chain", "sheet_panel", "join_effort", "join_extra", "wx_daily", "model_frame", "standardise", "gram_matrix",
    "weighted_mean_doy", "timing_slope_test", "avg_marginal_effect", "glm_poisson", "family_aicc", "model_selection",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    catalog = load()
    catalog["total_count"](spark, folder).collect()  # start the JVM and the scan code
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        catalog[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""),
    }))


if __name__ == "__main__":
    main()
