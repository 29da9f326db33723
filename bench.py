"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the median
counts. Results go to the noop sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from dossier import plans
from dossier.session import local_session

HEADLINE = (
    "best_documents",
    "tfidf_pairs",
    "resume_scores",
    "ranked_resumes",
    "nearest_by_distance",
    "nearest_by_cosine",
    "search_results",
    "answered_questions",
    "embedding_text",
    "searchable_chunks",
    "recursive_chunks",
    "window_chunks",
    "training_rows",
    "packed_blocks",
    "recent_messages",
    "conversation_texts",
    "usage_by_session",
    "usage_shares",
    "stored_records",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in names:
        samples = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            plans.QUERIES[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - started)
        took[name] = round(statistics.median(samples[1:] or samples), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of median seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
