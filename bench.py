"""Time the headline queries: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (cores); one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from plazametrics.session import local_session

HEADLINE = [
    "agg8_venue_metrics",
    "venue_features",
    "fil5_fil6_preprocess",
    "joi8_joi9_name_candidates",
    "ded1_name_correction",
    "ded2_win1_win2_deduplicate",
    "joi10_set1_jaccard_pairs",
    "joi11_sta7_colocation_lift",
    "sta9_cosine_pairs",
    "agg31_agg32_sensitivity_grid",
    "sta5_nestedness",
    "com1_clr",
    "com10_factor_model",
    "com3_distance_statistics",
    "clu2_silhouette",
    "win7_top_relations",
    "stm6_parse_cards",
    "str3_brand_key",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    from plazametrics.plans.catalog import QUERIES

    # One small query starts the JVM's code generator and the Python workers.
    QUERIES["agg9_diversity"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")), "cpus": cores,
    }), flush=True)


if __name__ == "__main__":
    main()
