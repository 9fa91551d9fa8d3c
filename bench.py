"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lettertrail.plans import registry
from lettertrail.session import build_session

HEADLINE = (
    "bodies_canonical", "boilerplate_stripped", "shingle_sets", "minhash_signatures", "block_keys", "candidate_pairs",
    "duplicate_scores", "near_duplicate_clusters", "passages_contained", "bodies_contained", "cluster_members",
    "quotes_extracted", "quoted_reconciled", "ranges_merged", "gaps_found", "segments_displayed", "text_blocks",
    "map_summary", "bodies_split", "reply_parents", "threads_assigned", "chain_conflicts", "relations_in_threads",
    "phrase_search", "indexed_search", "chronology_order", "emails_hydrated", "dates_parsed", "edits_applied",
    "audit_appended", "pages_cleaned", "chronology_exported",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) * 2 if cpus.isdigit() else 16)
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the clock
    times = {}
    for name in names:
        start = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
