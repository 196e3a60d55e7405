"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tracewell.plans import catalog  # noqa: E402
from tracewell.plans import derived as D  # noqa: E402
from tracewell.plans.registry import fixtures  # noqa: E402
from tracewell.session import build_session  # noqa: E402

HEADLINE = [
    "flagship_wallet_profile", "in1_read_csv", "lg2_first_spy", "tx8_asof_spend", "tx11_peel_chains", "wa5_geo_velocity", "wa10_ctx_wallet", "cl6_cluster_ids", "mx1_mixer_links",
    "gr2_flow_edges", "gr4_personalised_pagerank", "gr5_haircut_taint", "gr6_bfs_hops_downstream", "gr8_sign_features", "gr9_trace_exits", "al5_action_rules", "al9_operator_leads",
    "ml1_anomaly_score", "ev1_ranking_metrics", "q11_impossible_travel", "q22_grounding_check",
]
if os.environ.get("BENCH_END_TO_END"):  # minutes of work; off by default
    HEADLINE.append("score_ledger_to_alerts")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    start = time.time()
    fx = fixtures(spark, folder)
    for table in (fx.tout_a, fx.tin_a, fx.tx_a, fx.obs, fx.spy, fx.addresses, D.x(fx)):
        table.schema  # the stages of the ledger and the transaction matrix are written here
    times["prepare_ledger_and_tx_features"] = round(time.time() - start, 2)
    for name in HEADLINE:
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 2)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 2)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": total, "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


main()
