"""Time the headline queries: one JSON line with seconds per query."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.all_queries import QUERIES  # noqa: E402
from licensum.session import local_session  # noqa: E402

HEADLINE = [
    "c8_clean_licences",
    "d2_resolve_entities",
    "l1_process_licences",
    "l1_a17_council_analysis",
    "a10_weekly_stats",
    "a18_business_type_analysis",
    "a19_activity_analysis",
    "a20_geographic_analysis",
    "p1_parse_object_responses",
    "p2_parse_array_responses",
    "k4_dedupe_councils",
    "l4_discover_councils",
    "h1_visible_text",
    "h6_page_links_registers",
    "h7_candidate_links",
    "h12_table_rows",
    "h13_card_texts",
    "h16_page_analysis",
    "l6_extract_licences",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up of the session and of code generation is not part of any query.
    QUERIES["a23_discovery_metrics"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = Path(folder).name.removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
