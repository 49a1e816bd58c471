"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from twinloom.plans import catalog
from twinloom.session import build_session

HEADLINES = [
    "ks", "wasserstein", "jsd_binned", "jsd_categorical", "chi_square", "corr_similarity", "realism",
    "profile", "column_info", "standardize", "label_encode", "balance_classes", "table_fingerprint",
    "gen_numeric", "gen_categorical", "gen_bootstrap", "gen_conditional", "gen_correlated", "gen_text", "tfidf",
    "markov_score", "autocorr", "causal_corr", "causal_skeleton", "sequence_edges",
    "nearest_distance", "mia", "singling_out", "attribute_leak",
    "release_gate", "select_attempt", "route_with_history", "meta_select", "dedupe_runs", "budget_timeline",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", int(cpus) if cpus.isdigit() else 8, quiet=True)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["ks"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM's machinery once
    took = {}
    for name in HEADLINES:
        t0 = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
