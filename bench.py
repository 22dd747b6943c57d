"""Headline queries timed on whole tables; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from gradecut import build_session
from gradecut.plans.workloads import QUERIES

HEADLINE = (
    "verify_media",
    "fit_cutoff_model",
    "score_candidates",
    "answer_summary",
    "answer_topk",
    "calibrate_knots",
    "residual_rho",
    "group_effects",
    "predict_marks",
    "chained_score",
    "forecast_audit",
    "estimator_compare",
    "even_sample",
    "text_normalize",
    "extract_links",
    "descend",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        **{"spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    timings: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
