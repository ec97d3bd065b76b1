"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parlance.catalog.queries import QUERIES  # noqa: E402
from parlance.session import build, clear_scratch  # noqa: E402

HEADLINE = (
    "parse_ios", "call_types", "reply_time", "contexts", "top_words", "top_emojis", "first_texter",
    "longest_message", "swearing", "media_stats", "tail_sample", "expand_abbreviations", "preprocess",
    "spell_correct", "calls_per_day", "busiest_call_days", "days_without_calls", "longest_call",
    "mood_trends", "emotion_trend", "mood_heatmap", "love_score", "toxicity_summary", "top_emotions",
    "score_all", "llm_prompts", "detect_language", "toxicity_model", "full_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(
        f"local[{cpus}]",
        "parlance-bench",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "4g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up work (class loading, compilation) is not part of any query.
    QUERIES["active_hours"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    clear_scratch(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
