"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default the sf0.1 tables), BENCH_CPUS (default all cores).
Each query is run once to warm up and once for the record, both to a no-op sink, so that
whole results are computed.
"""

from __future__ import annotations

import json
import os
import time

from daytrail.catalog import QUERIES
from daytrail.session import build_session

HEADLINE = (
    "top_artists",
    "artist_profiles",
    "track_profiles",
    "track_months",
    "listening_progress",
    "daily_profiles",
    "repertoire_size",
    "discovery_cohorts",
    "track_obsessions",
    "artist_race_frames",
    "top_items_by_dimension",
    "play_breakdown",
    "artist_album_track",
    "small_slices_folded",
    "conversation_columns",
    "message_macro_stats",
    "reply_times",
    "contact_balance",
    "message_breakdown_messages",
    "explorer_segment_points",
    "segment_breakdown_minutes",
    "speed_summary",
    "zone_rollup",
    "attributed_segments",
    "days",
    "day_tracks",
    "plays_from_raw",
    "segments_from_timeline",
    "messages_from_chat_text",
    "message_rows",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=cores,
        conf={"spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run(QUERIES[name](spark, sf_dir))
        begun = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - begun, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
