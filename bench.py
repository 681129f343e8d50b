"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from check import session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "document_results",
    "pii_scan",
    "injection_scan",
    "redact_text",
    "classify_documents",
    "extract_invoice",
    "line_items",
    "validate_documents",
    "route_documents",
    "eval_report",
    "reconcile_orders",
    "payload_fields",
    "quota_decisions",
    "job_latest",
    "infer_failover",
    "stream_quota",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds, documents = {}, 0
    for name in ("flagship", *names):
        run = QUERIES[name]
        start = time.time()
        df = run(spark, sf_dir)
        if name == "flagship":
            documents = sum(row["documents"] for row in df.collect())
        else:
            df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "documents_per_second": round(documents / seconds["flagship"]),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
