"""Run the headline queries and print one JSON line with their seconds."""

from __future__ import annotations

import json
import os
import sys
import time

from logloom import catalog, catalog_jobs  # noqa: F401  (registers its queries)
from logloom.session import build_session

HEADLINES = [
    "event_matrix",
    "line_classification",
    "match_counters",
    "ingested_stats",
    "block_features",
    "training_set",
    "event_distribution",
    "analyze_summary",
    "recent_anomalies",
    "batch_list",
    "batch_anomalies",
    "offline_anomalies",
    "incremental_features",
    "leaderboard_latest",
    "anomaly_scores",
    "network_scores",
    "row_windows",
    "retrieve_fallback",
    "line_events_by_word",
    "topk_similar_blocks",
    "keyword_search_blocks",
    "drop_last_pct",
    "stratified_split",
    "block_traces",
    "masked_templates",
    "window_counts",
    "topk_similar",
    "doc_chunks",
    "keyword_search",
    "conversation_tags",
    "stream_block_counts",
    "model_report",
    "template_table_first",
    "incremental_features_stored",
    "stream_state_counts",
    "diverse_answers",
    "mined_templates",
    "early_stopped_model",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.sql.files.maxPartitionBytes": "16m",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first query would otherwise pay for starting the session.
    catalog.QUERIES["total_blocks"](spark, folder).collect()
    seconds = {}
    for name in HEADLINES:
        if only and name not in only:
            continue
        best = None
        for _ in range(2):
            begin = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - begin
            best = spent if best is None else min(best, spent)
        seconds[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
