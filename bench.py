"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data (default scale factor 0.1), ``BENCH_CPUS`` the local cores.
Each query is built and fully computed; the result goes to Spark's no-op sink, so the time does
not include moving rows into Python.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardstat.operators import latent  # noqa: E402
from wardstat.plans import catalog  # noqa: E402
from wardstat.session import local_session  # noqa: E402
from wardstat.sources.star import star_tables  # noqa: E402

HEADLINE = [
    "first_event",
    "cohort_included",
    "morbidity_counts",
    "cohort_with_flags",
    "flags_with_age_group",
    "sepsis_flags",
    "table_one_overall",
    "table_one_gender",
    "table_one_disease_count",
    "table_one_admission",
    "table_one_age_bucket",
    "table_one_all",
    "los_hospital_by_age",
    "los_icu_by_age",
    "score_by_age",
    "multimorbidity_by_category",
    "severity_by_category",
    "mortality_by_category",
    "prevalence_by_group",
    "prevalence_by_age_group",
    "boxplot_summary",
    "cooccurrence",
    "network_edges",
    "network_nodes",
    "subgroup_table",
    "outcome_prevalence",
    "auc_score",
    "class_auc",
    "kmeans_rows",
    "kmeans_profiles",
]


def lca_steps(spark, sf_dir):
    """Thirty EM steps of five random starts of a seven-class model."""
    rows = catalog.model_rows(star_tables(spark, sf_dir))
    return latent.lca_fit(rows, catalog.N_CLASSES, max_iter=30).parameters(spark)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench", **{"spark.ui.showConsoleProgress": "false"})
    named = catalog.queries()
    jobs = {name: named[name] for name in HEADLINE} | {"lca_thirty_steps": lca_steps}
    # Start the executor threads and the Python workers before the first timing.
    spark.read.parquet(f"{sf_dir}/region.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, query in jobs.items():
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    report = {
        "metric": "total_wall_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
