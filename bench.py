"""Headline queries on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from rillstream.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = ("flow_sessions", "flow_meta_rates", "timing_iat_all", "timing_bursts", "size_stats", "tcp_flag_counts", "padding_scores", "dup_ack", "rtt_asof", "conn_basic", "conn_clustering", "label_join", "conversation_directions")


def main() -> None:
    spark = session("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    from rillstream.plans.extract import GROUPS, extract
    from rillstream.plans.queries import QUERIES as known
    from rillstream.plans.queries import TIMEOUT, packets
    from rillstream.config import Config

    todo = {q: known[q] for q in QUERIES}
    core = tuple(g for g in GROUPS if GROUPS[g].tier == "core")
    todo["extract_core"] = lambda s, d: extract(packets(s, d), Config(flow_timeout=TIMEOUT, groups=core))
    todo["extract_all_but_graph"] = lambda s, d: extract(packets(s, d), Config(flow_timeout=TIMEOUT, groups=tuple(GROUPS)))
    known["flow_sessions"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name, query in todo.items():
        start = time.time()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
