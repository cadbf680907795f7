"""Wall-clock of the headline queries, the median of three runs each: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from talentlake.plans import catalog
from talentlake.session import local_session

HEADLINE = [
    "role_skill_stats", "keyword_topk", "role_profiles", "catalog_support", "chunks", "section_stats", "text_normalize", "text_strict", "html_strip", "merge_by_url",
    "upsert_latest", "insert_ignore", "latest_per_key", "graph_recommend", "skill_gap", "career_path", "vector_topk", "blended_query", "hybrid_rank", "rerank",
    "ranking_metrics", "diversity_novelty", "qrels_template", "calibration", "stability", "latency_percentiles", "quality_row", "missing_ratio",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
