"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` a comma-separated
choice (``all`` for every query). Every query is run to its last row without keeping the result.
"""

from __future__ import annotations

import json
import os
import time

from folioflow.plans.registry import all_queries
from folioflow.session import local_session

HEADLINE = (
    "score_papers",
    "adaptive_quota",
    "training_set",
    "fit_logistic",
    "recommend_fixed",
    "recommend",
    "knn_join",
    "cosine_topn",
    "rescore_topn",
    "difficulty_weights",
    "smote_synthesize",
    "balanced_positives",
    "vector_quality",
    "dedupe_labels",
    "reaction_to_label",
    "patch_labels",
    "enrich_metadata",
    "merge_tables",
    "correlate_responses",
    "write_predictions",
    "write_pages",
    "rank_smart",
    "paginate_tags",
    "prev_next",
    "unique_tags",
    "token_blocks",
    "assemble_document",
    "inverted_index",
    "keyword_search",
    "stream_upsert_labels",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    registered = all_queries()
    names = list(registered) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = local_session(cores, "folioflow-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the clock

    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registered[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
