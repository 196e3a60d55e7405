"""Small hand-made ledgers with known answers, and brute force where a query has no SQL counterpart."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from tracewell.config import Settings
from tracewell.functions import text as Tx
from tracewell.functions.columns import swap_memo
from tracewell.operators import alerts as A
from tracewell.operators import clusters as C
from tracewell.operators import enrich as E
from tracewell.operators import evaluate as Ev
from tracewell.operators import forecast as Fc
from tracewell.operators import graph as G
from tracewell.operators import investigator as I
from tracewell.operators import leads as Le
from tracewell.operators import mixer as M
from tracewell.operators import models as Mo
from tracewell.operators import temporal as Te
from tracewell.operators import tracing as Tr
from tracewell.operators import tx_features as T
from tracewell.operators.ledger import Ledger
from tracewell.session import recording, stage

T0 = dt.datetime(2024, 1, 1)
ROW = "txid string, ts timestamp, idx bigint, address string, amount double"


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


def ledger(spark, txs, known_software=True):
    """txs: (txid, minute, [(address, amount)], [(address, amount)][, memo])."""
    tin = [(t[0], minutes(t[1]), i, a, v) for t in txs for i, (a, v) in enumerate(t[2])]
    tout = [(t[0], minutes(t[1]), i, a, v) for t in txs for i, (a, v) in enumerate(t[3])]
    tx = [(t[0], minutes(t[1]), max(0.0, sum(v for _, v in t[2]) - sum(v for _, v in t[3])), "P2WPKH", 2, 0, True, t[4] if len(t) > 4 else None, None) for t in txs]
    return Ledger(spark.createDataFrame(tx, "txid string, ts timestamp, fee double, script_type string, tx_version int, locktime bigint, rbf boolean, op_return string, confirmed boolean"),
                  spark.createDataFrame(tin, ROW), spark.createDataFrame(tout, ROW), None)


def test_asof_matches_brute_force_across_buckets(spark):
    rnd = random.Random(3)
    left = [(i, "HOT" if rnd.random() < 0.5 else f"k{rnd.randrange(5)}", minutes(rnd.randrange(600))) for i in range(300)]
    marks = [("HOT" if rnd.random() < 0.5 else f"k{rnd.randrange(5)}", minutes(rnd.randrange(600)), f"p{rnd.randrange(50):02d}") for _ in range(200)]
    l = spark.createDataFrame(left, "id int, key string, ts timestamp")
    m = spark.createDataFrame(marks, "key string, ts timestamp, pay string")
    for direction in ("forward", "backward"):
        for strict in (True, False):
            got = {r["id"]: (r["m_ts"], r["m_pay"]) for r in Te.asof(l, m, "key", "ts", "ts", ["pay"], direction, strict).collect()}
            assert len(got) == len(left)
            for i, k, t in left:
                ok = [(mt, mp) for mk, mt, mp in marks if mk == k and ((mt > t or (not strict and mt == t)) if direction == "forward" else (mt < t or (not strict and mt == t)))]
                if not ok:
                    assert got[i] == (None, None)
                    continue
                best = min(x[0] for x in ok) if direction == "forward" else max(x[0] for x in ok)
                assert got[i] == (best, min(p for mt, p in ok if mt == best))


def test_previous_row_and_ranks(spark):
    rows = [("a", minutes(i * 37), i) for i in range(40)]
    d = spark.createDataFrame(rows, "key string, ts timestamp, n int")
    got = {r["n"]: (r["prev"]["n"] if r["prev"] else None) for r in Te.previous_row(d, "key", "ts", ["n"], []).collect()}
    assert got == {i: (i - 1 if i else None) for i in range(40)}
    v = spark.createDataFrame([(x,) for x in (5.0, 1.0, 1.0, 3.0)], "v double")
    assert sorted(r["r"] for r in Te.percent_rank_average(v, "v", "r").collect()) == [0.375, 0.375, 0.75, 1.0]
    assert Te.exact_quantiles(v, "v", [0.5, 0.25])[["q0", "q1"]].first() == (2.0, 1.0)


def test_components_match_union_find(spark):
    rnd = random.Random(5)
    edges = [(f"n{rnd.randrange(150):03d}", f"n{rnd.randrange(150):03d}") for _ in range(110)] + [("n000", f"n{i:03d}") for i in range(20, 40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    got = {r["node"]: r["root"] for r in G.connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


def test_self_split_joins_fresh_equal_parts(spark):
    parts = [(f"part{i}", 1.0 + 0.001 * i) for i in range(7)]
    l = ledger(spark, [("t1", 0, [("sender", 7.5)], parts + [("change", 0.3)]), ("t2", 5, [("hub", 9.0)], [(f"user{i}", 1.0 + i) for i in range(8)])])
    none = l.tx.where("false").select("txid")
    sender = C.senders(l.tin, none)
    outs = C.described_outputs(l, C.address_facts(l, none, l.tin.where("false").select("address")))
    degree = l.tin.select("address").union(l.tout.select("address")).groupBy("address").agg(F.count(F.lit(1)).alias("degree"))
    got = {(r["a"], r["b"]) for r in C.self_split_edges(l, sender, outs, degree).collect()}
    assert got == {("sender", a) for a, _ in parts} | {("sender", "change")}


def test_swept_output_is_not_change(spark):
    l = ledger(spark, [("t1", 0, [("payer", 1.5)], [("shop", 1.0), ("fresh", 0.49999123)])])
    shape = T.tx_shape(l)
    none = l.tx.where("false").select("txid")

    def edges(swept):
        facts = C.address_facts(l, none, spark.createDataFrame([(a,) for a in swept] or [("-",)], "address string"))
        return [(r["a"], r["b"]) for r in C.two_output_change(l, shape, C.senders(l.tin, none), C.described_outputs(l, facts)).collect()]
    assert edges([]) == [("payer", "fresh")]
    assert edges(["fresh"]) == []


def test_five_party_mix(spark):
    ins = [(f"in{i}", 0.1 + 0.01 * (i + 1) + 0.00001) for i in range(5)]
    outs = [(f"pool{i}", 0.1) for i in range(5)] + [(f"chg{i}", round(0.01 * (i + 1), 8)) for i in range(5)]
    l = ledger(spark, [("mix", 0, ins, outs)])
    links = M.mixer_links(l, l.tx.select("txid")).collect()
    change = {(r["src"], r["dst"]): r["prob"] for r in links if r["kind"] == "CHANGE"}
    assert change == {(f"in{i}", f"chg{i}"): 1.0 for i in range(5)}
    pool = [r["prob"] for r in links if r["kind"] == "POOL"]
    assert len(pool) == 25 and set(pool) == {0.2}


def test_hub_absorbs_taint_and_sign_means(spark):
    e = spark.createDataFrame([("seed", "a", 1.0), ("a", "hub", 1.0), ("hub", "customer", 1.0)] + [("hub", f"x{i}", 1.0) for i in range(8)], "src string, dst string, w double")
    t = {r["node"]: r["taint"] for r in G.haircut_taint(e, spark.createDataFrame([("seed",)], "address string"), hub_degree=6).collect()}
    assert t["a"] == 0.9 and round(t["hub"], 6) == 0.81 and "customer" not in t
    e2 = spark.createDataFrame([("u", "v", 1.0), ("u", "w", 1.0), ("v", "z", 1.0)], "src string, dst string, w double")
    x = spark.createDataFrame([("u", 0.0), ("v", 1.0), ("w", 3.0), ("z", 4.0)], "address string, c double")
    f = {r["address"]: r for r in G.sign_features(e2, x, "address", ["c"], 60).collect()}
    z = lambda v: (v - 2.0) / (10 / 4) ** 0.5
    assert abs(f["u"]["gnn_out1_c"] - (z(1) + z(3)) / 2) < 1e-9
    assert abs(f["u"]["gnn_out2_c"] - z(4) / 2) < 1e-9 and f["z"]["gnn_out1_c"] == 0.0


KNOWN = "address string, entity_name string, entity_type string, country string, in_jurisdiction boolean"


def test_trace_and_rules(spark):
    l = ledger(spark, [("t0", 0, [("miner", 5.0)], [("w", 2.0)]), ("t1", 18, [("w", 2.0)], [("mid", 1.9), ("w2", 0.1)]), ("t2", 20, [("mid", 1.9)], [("ex", 1.8)]),
                       ("t3", 40, [("w2", 0.1)], [("vault", 0.05), ("w2", 0.04)], "=:e:0xabc:5")])
    known = spark.createDataFrame([("ex", "BitMart", "VASP", "IN", True), ("miner", "Pool", "MINING_POOL", "XX", False)], KNOWN)
    hits = {r["vasp"]: r for r in Tr.trace_exits(l, spark.createDataFrame([("w",)], "address string"), known).collect()}
    assert hits["BitMart"]["hop"] == 2 and hits["BitMart"]["path"] == ["t1", "t2"] and hits["BitMart"]["minutes_after_receipt"] == 20.0
    assert hits["ETH swap (memo)"]["deposit_address"] == "vault"
    alerts = spark.createDataFrame([("w", 90.0), ("lonely", 50.0)], "address string, risk_score double")
    facts = spark.createDataFrame([("w", 2.0, 2.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 20, 20, 0)],
                                  "address string, sent_btc double, recv_btc double, cluster_sent_btc double, share_risky_asn double, max_p_peel double, max_p_coinjoin double, max_p_fan_out double, max_peel_chain_len double, taint double, hops_from_seed int, hops_to_seed int, last_seen_us bigint")
    exits = Tr.trace_exits(l, alerts, known)
    got = {r["address"]: (r["action"], r["also_matched"]) for r in A.decide_actions(alerts, facts, exits, known, G.sibling_funders(l), F.lit(10**15)).collect()}
    assert got["w"] == ("IMMEDIATE_FREEZE_DRAFT", ["DRAFT_SECTION_94_BNSS", "CROSS_CHAIN_EXIT", "REVIEW_LIKELY_BENIGN"])
    assert got["lonely"][0] == "ANALYST_REVIEW"


def test_follow_the_money_stops(spark):
    l = ledger(spark, [("t1", 0, [("w", 10.0)], [("c1", 9.0), ("p1", 1.0)]), ("t2", 5, [("c1", 9.0)], [("c2", 8.0), ("p2", 1.0)]), ("t3", 9, [("c2", 8.0)], [(f"s{i}", 1.6) for i in range(5)])])
    known = spark.createDataFrame([("nobody", "X", "VASP", "XX", False)], KNOWN)
    rows, ends = Tr.follow_money(l, spark.createDataFrame([("w",), ("idle",)], "address string"), known, 10)
    e = {r["start"]: r for r in ends.collect()}
    assert e["w"]["stop"] == "split into 5 outputs" and e["w"]["hops"] == 3 and e["idle"]["stop"] == "wallet never spends"
    assert [r["txid"] for r in rows.orderBy("hop").collect()] == ["t1", "t2", "t3"]


def test_swap_memo_grammar(spark):
    d = spark.createDataFrame([("=:e:0xabc:1",), ("SWAP:BTC.BTC:bc1q",), ("s:XMR:4addr",), ("hello:there",), ("=:ETH.ETH:with space",), ("=:ETH.ETH:",)], "m string")
    got = [r["x"] for r in d.select(swap_memo(F.col("m")).alias("x")).collect()]
    assert got[0].asset == "ETH.ETH" and got[0].destination_chain == "ETH" and got[0].limit_text == "1"
    assert got[1].asset == "BTC.BTC" and got[1].limit_text is None and got[2].destination_chain is None
    assert got[3] is None and got[4] is None and got[5] is None


def test_forecast_leaves_own_cluster_out(spark):
    alerts = spark.createDataFrame([(f"a{i}", f"w{i}", f"C{i}", "MIXING", 1.0, 0) for i in range(7)], "alert_id string, address string, cluster string, typology string, balance double, last_recv_us bigint")
    pool = spark.createDataFrame([(f"a{i}", f"C{i}", "MIXING", "X" if i < 4 else "Y", float(10 * (i + 1))) for i in range(6)], "alert_id string, cluster string, typology string, vasp string, delay double")
    names = spark.createDataFrame([("e1", "X", "VASP"), ("e2", "Z", "VASP")], "address string, entity_name string, entity_type string")
    f = {r["alert_id"]: r for r in Fc.forecasts(alerts, pool, names, F.lit(25 * 60_000_000)).collect()}
    assert f["a6"]["samples"] == 6 and f["a6"]["p50"] == 35.0 and f["a6"]["status"] == "PENDING" and f["a6"]["window_state"] == "IN_WINDOW"
    assert f["a0"]["samples"] == 5 and f["a0"]["status"] == "CASHED_OUT" and f["a0"]["p50"] == 40.0 and f["a6"]["top_vasp"] == "X"


def test_forecasts_equal_a_list_per_alert(spark):
    """Random alerts, ties, a cluster with half of all cash-outs, a rare typology, nulls: sample, quantiles and destinations by hand."""
    rnd = random.Random(5)
    kinds = ["MIXING", "PEEL", "RARE", None]
    alerts = [(f"a{i:03d}", f"w{i}", rnd.choice(["hot", "hot", "hot", *[f"C{k}" for k in range(12)], None]), rnd.choices(kinds, [6, 5, 1, 1])[0], rnd.choice([0.0, 1.0]), 0) for i in range(150)]
    cash = [(a[0], a[2], a[3], rnd.choice("XYZW"), float(rnd.randrange(12) * 10)) for a in alerts if rnd.random() < 0.6]
    odd = [(None, "C1", "PEEL", "X", 1.0), ("a001", "C1", "PEEL", None, 1.0), ("a002", "C1", "PEEL", "X", None)]
    names = ["X", "Q"]
    ad = spark.createDataFrame(alerts, "alert_id string, address string, cluster string, typology string, balance double, last_recv_us bigint")
    cd = spark.createDataFrame(cash + odd, "alert_id string, cluster string, typology string, vasp string, delay double")
    nd = spark.createDataFrame([(n, n, "VASP") for n in names] + [("n", None, "VASP"), ("m", "MM", "MERCHANT")], "address string, entity_name string, entity_type string")
    got = {r["alert_id"]: r for r in Fc.forecasts(ad, cd, nd, F.lit(0)).collect()}
    assert len(got) == len(alerts)
    pool = [c for c in cash if c[1] is not None]
    for aid, _, cluster, kind, balance, _ in alerts:
        other = [c for c in pool if c[1] != cluster]
        same = [c for c in other if kind is not None and c[2] == kind]
        sample = same if len(same) >= 5 else other
        own = [c for c in pool if cluster is not None and c[1] == cluster and c[0] != aid]
        done = [c for c in pool if c[0] == aid]
        g = got[aid]
        assert g["samples"] == len(sample) and g["basis"] == ("typology" if all(c[2] == kind for c in sample) else "all_actors")
        assert g["status"] == ("CASHED_OUT" if done else "PENDING" if balance else "NO_BALANCE")
        d = sorted(c[4] for c in sample)
        for name, q in Fc.QUANTILES.items():
            at = q * (len(d) - 1)
            lo = d[int(at)]
            want = lo + (d[min(int(at) + (at > int(at)), len(d) - 1)] - lo) * (at - int(at))
            assert abs(g[name] - want) <= 0.0501
        every = {*names, *[c[3] for c in sample], *[c[3] for c in own]}
        score = {v: 0.5 + sum(c[3] == v for c in sample) + 3 * sum(c[3] == v for c in own) for v in every}
        best = sorted(every, key=lambda v: (-score[v], v))[:3]
        assert [x["vasp"] for x in g["destinations"]] == best and abs(-g["destinations"][0]["neg"] - score[best[0]] / sum(score.values())) < 1e-12
    assert Fc.forecasts(ad, cd.limit(0), nd, F.lit(0)).where("status = 'INSUFFICIENT_HISTORY'").count() == len(alerts)
    assert Fc.forecasts(ad.limit(0), cd, nd, F.lit(0)).count() == 0


def test_operator_eval_keeps_pairs_in_their_tasks(spark):
    """Ranks equal those of all pairs, also for clusters of two owners; what is shuffled is rows of queries, not of pairs and signals."""
    rnd = random.Random(5)
    rows = [(f"C{c:02d}", f"{c}-{k}", 3, rnd.randrange(24), rnd.choice(["v1", "v2"]) if c % 7 else None, rnd.choice(["A", "B"]), rnd.choice([0.5, 1.0, None]), f"10.0.0.{rnd.randrange(9)}")
            for c in range(40) for k in range(3)]
    habits = spark.createDataFrame(rows, "cluster string, txid string, n_tx long, hour int, software string, script string, fee double, ip string")
    prints = stage(Le.operator_fingerprints(habits), "prints")
    owned = [(f"C{c:02d}", c % 9 if c != 11 else None) for c in range(40)] + [("C04", 2), ("C20", 2)]
    queries = spark.createDataFrame([(f"C{c:02d}",) for c in range(0, 40, 4)] + [("none",)], "cluster string")
    got = Le.operator_eval(prints, queries, spark.createDataFrame(owned, "cluster string, owner long"))
    owners = {}
    for c, o in owned:
        owners.setdefault(c, set()).update([] if o is None else [o])
    pairs = {}
    for r in Le.pair_scores(prints, queries).collect():
        pairs.setdefault(r["query"], []).append(r)
    for r in got.collect():
        column = {"all": "score", "without_network": "behaviour"}.get(r["signal"], r["signal"])
        ranks = []
        for q, some in pairs.items():
            order = sorted(some, key=lambda p: (-p[column], p["cluster"]))
            ranks += [k + 1 for k, p in enumerate(order) if owners[p["cluster"]] & owners[q]][:1]
        assert r["queries"] == len(ranks) and abs(r["mrr"] - sum(1 / k for k in ranks) / len(ranks)) < 1e-9
        assert abs(r["hit_at_5"] - sum(k <= 5 for k in ranks) / len(ranks)) < 1e-9
    assert got.count() == 7
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "signal" not in "".join(x for x in plan.splitlines() if "Join" in x)


@pytest.mark.parametrize("posting", [0, 4, 1000])
def test_best_leads_equal_all_pairs(spark, posting):
    """Random habits with ties, missing signals and a relay that a third uses, whether relays have lists or are bounded by cells."""
    rnd = random.Random(3)
    rows = []
    for c in range(140):
        software, script, hour, fee = rnd.choice(["v1", "v2", "v2", None]), rnd.choice(["A", "B"]), rnd.randrange(24), rnd.choice([0.5, 1.0, 2.0, None])
        for k in range(rnd.randrange(3, 7)):
            ip = rnd.choice(["hot", f"10.0.0.{rnd.randrange(25)}", None])
            rows.append((f"C{c:03d}", f"{c}-{k}", 3 + c % 4, (hour + rnd.randrange(3)) % 24 if c % 9 else None, software, script if rnd.random() < 0.8 else "C", None if fee is None else fee + rnd.random() / 10, ip))
    habits = spark.createDataFrame(rows, "cluster string, txid string, n_tx long, hour int, software string, script string, fee double, ip string")
    prints = stage(Le.operator_fingerprints(habits), "prints")
    fees = {}
    for r in rows:
        fees.setdefault(r[0], []).append(r[6])
    for r in prints.collect():
        some = sorted(x for x in fees[r["cluster"]] if x is not None)
        want = None if not some else (some[(len(some) - 1) // 2] + some[len(some) // 2]) / 2
        assert r["fee"] == want or abs(r["fee"] - want) < 1e-12
    queries = spark.createDataFrame([(f"C{c:03d}",) for c in range(0, 140, 5)] + [("none",)], "cluster string")
    want = {}
    for r in Le.pair_scores(prints, queries).collect():
        want.setdefault(r["query"], []).append((-r["score"], r["cluster"], r["behaviour"], r["ip"]))
    got = {}
    for r in Le.best_pairs(prints, queries, 5, posting=posting).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (-r["score"], r["cluster"], r["behaviour"], r["ip"])
    assert len(got) == 28 and all([got[k][i] for i in range(1, 6)] == sorted(v)[:5] for k, v in want.items())
    assert Le.best_pairs(prints.limit(0), queries, 5).count() == 0


def test_grounding_check_keeps_only_supported_sentences(spark):
    facts = ["The wallet sent 3.5 BTC to exchange BitMart.", "Its funds pass through a peel chain of 5 transactions."]
    text = ("Funds of 3.5 BTC reached exchange BitMart [F1]. The owner probably sent funds to BitMart [F1]. A peel chain of 9 transactions passed funds [F2]. "
            "Money was moved. Funds passed through a peel chain of 5 transactions [F2]. See [F7].")
    d = spark.createDataFrame([(1, text, facts)], "id int, text string, facts array<string>")
    kept = [r["kept"] for r in Tx.grounding_check(d, "text", "facts", ["id"]).orderBy("pos").collect()]
    assert kept == [True, False, False, False, True, False]


def test_ranking_metrics_by_hand(spark):
    d = spark.createDataFrame([("a", 0.9, 1), ("b", 0.8, 0), ("c", 0.8, 1), ("d", 0.1, 0)], "address string, p double, y int")
    m = Ev.ranking_metrics(d).first()
    assert abs(m["pr_auc"] - (0.5 * 1 + 0.5 * 2 / 3)) < 1e-12 and abs(m["roc_auc"] - (1 + 1 + 0.5 + 1) / 4) < 1e-12
    assert m["precision_at_50"] == 0.5 and m["recall_at_p50"] == 1.0


def test_models_keep_their_promises(spark):
    rnd = random.Random(1)
    rows = [(f"w{i:04d}", rnd.gauss(0, 1), rnd.gauss(0, 1), i % 40) for i in range(600)] + [("odd", 30.0, -30.0, 99)]
    x = spark.createDataFrame(rows, "address string, a double, b double, g int")
    an = {r["address"]: r["anomaly"] for r in Mo.anomaly_score(x, "address", ["a", "b"], trees=40).collect()}
    assert len(an) == len(rows) and an["odd"] == 1.0 and all(0 < v <= 1 for v in an.values())
    lab = x.select("address", (F.col("a") > 0).cast("int").alias("y"), F.col("g").cast("string").alias("group"), F.lit(1.0).alias("weight"))
    p, members = Mo.fuse_train(x, lab, ["a", "b"], folds=2, repeats=1, iterations=4, depth=3)
    got = p.collect()
    assert len(got) == len(rows) and all(0 <= r["p"] <= 1 for r in got) and len(members) == 2
    assert Ev.ranking_metrics(p).first()["roc_auc"] > 0.9
    folds = lab.withColumn("f", Mo.group_fold(F.col("group"), 2)).groupBy("group").agg(F.count_distinct("f").alias("n"))
    assert folds.where("n <> 1").count() == 0


def test_alert_candidates_one_per_cluster_and_cap(spark):
    d = spark.createDataFrame([("a", 0.9, "c1"), ("b", 0.8, "c1"), ("c", 0.7, "c2"), ("d", 0.3, "c3"), ("e", 0.6, "c4")], "address string, p double, cluster_root string")
    got = [r["address"] for r in A.alert_candidates(d, Settings(max_alerts=2)).collect()]
    assert got == ["a", "c"]


def test_no_limit_unless_asked(spark):
    """Relays, alerts and wallets past the old pages are there; an explicit limit still makes a page."""
    obs = spark.range(450).selectExpr("'t' as txid", "timestamp_seconds(id) as ts", "concat('10.0.0.', id % 250) as src_ip")
    tx = spark.sql("select 't' as txid, timestamp_seconds(0) as ts, 0.1d as fee")
    assert I.tx_360(obs, tx).count() == 450 and I.tx_360(obs, tx, relays=20).count() == 20
    scores = spark.range(700).selectExpr("concat('w', id) as address", "0.5 + id / 2000 as p", "id as cluster_root")
    assert A.alert_candidates(scores).count() == 700


def test_unfinished_iterations_raise(spark):
    chain = spark.range(200).selectExpr("cast(id as string) a", "cast(id + 1 as string) b")
    with pytest.raises(RuntimeError):
        G.connected_components(chain, "a", "b", max_rounds=1)
    edges = chain.selectExpr("a as src", "b as dst", "1.0d as w")
    with pytest.raises(RuntimeError):
        G.pagerank(edges, None, max_rounds=2, tol=1e-12)
    assert G.pagerank(edges, None, max_rounds=2, tol=0.0).count() == 201


def test_known_transactions_take_no_room(spark):
    """The second hop brings as many new transactions as there is room for."""
    rows = [(f"t{i}", f"a{i}", f"a{i + 1}") for i in range(6)]
    ts = "timestamp_seconds(cast(substring(txid, 2) as int)) as ts"
    d = spark.createDataFrame(rows, "txid string, src string, dst string")
    tin, tout = (d.selectExpr("txid", ts, "0 as idx", f"{c} as address", "1.0d as amount") for c in ("src", "dst"))
    ledger = Ledger(tx=d.selectExpr("txid", ts, "0.0d as fee"), tin=tin, tout=tout, spy=None)
    txs, _ = Tr.neighbourhood(ledger, spark.createDataFrame([("a1",)], "address string"), 3, 4)
    assert txs.count() == 4


def test_addresses_without_a_range_keep_their_rows(spark):
    ranges = spark.createDataFrame([("1.2.3.0", "1.2.3.255", "AA", "AS1"), ("2000::", "3fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "BB", "AS2"), ("2001:db8::", "2001:db8::ff", "CC", "AS3")], "start_ip string, end_ip string, country string, asn string")
    ips = spark.createDataFrame([(None,), ("::ffff:1.2.3.4",), ("1.2.3.9",), ("2abc::1",), ("2001:db8::1",), ("12345::1",), ("x",), ("1.2.3.9",)], "src_ip string")
    got = sorted((r["src_ip"] or "", r["country"]) for r in E.ip_range_join(ips, ranges).collect())
    assert got == [("", "XX"), ("1.2.3.9", "AA"), ("1.2.3.9", "AA"), ("12345::1", "XX"), ("2001:db8::1", "CC"), ("2abc::1", "BB"), ("::ffff:1.2.3.4", "AA"), ("x", "XX")]


def test_factored_flow_equals_pairs_and_power_iteration(spark):
    """Loops, an address that only pays itself, amounts of 0, repeated addresses and a payment to many, against pairs and numpy."""
    import numpy as np

    rnd = random.Random(5)
    txs = [(f"t{i}", i, [(f"a{rnd.randrange(30)}", rnd.choice([0.5, 1.0, 2.5])) for _ in range(rnd.randrange(1, 5))], [(f"a{rnd.randrange(30)}", rnd.choice([0.1, 0.7, 3.0])) for _ in range(rnd.randrange(1, 5))]) for i in range(60)]
    txs += [("self", 70, [("s0", 1.0)], [("s0", 0.9)]), ("many", 71, [("a1", 9.0), ("s0", 1.0)], [(f"m{i}", 0.1) for i in range(40)] + [("s0", 5.0)]), ("zero", 72, [("z", 0.0)], [("a2", 1.0)])]
    ld = ledger(spark, txs)
    edges, factors = G.flow_edges(ld), G.flow_factors(ld)
    seeds = spark.createDataFrame([("a1",), ("a7",), ("nowhere",)], "address string")
    positive = edges.where("src <> 'z'")
    totals = {r["node"]: r["total"] for r in factors.totals().collect()}
    want = {r["src"]: r["t"] for r in edges.groupBy("src").agg(F.sum("w").alias("t")).collect()}
    assert totals == pytest.approx(want)
    pairs = {(r["src"], r["dst"]): r["w"] for r in positive.collect()}
    for turned in (False, True):
        f = factors.reversed() if turned else factors
        got = {r["node"]: r["rank"] for r in G.pagerank_factored(f, seeds, 6, 0.0).collect()}
        names = sorted(got)
        assert set(names) == {x for r in edges.collect() for x in (r["src"], r["dst"])}
        m, at = np.zeros((len(names), len(names))), {x: i for i, x in enumerate(names)}
        for (a, b), w in pairs.items():
            a, b = (b, a) if turned else (a, b)
            m[at[a], at[b]] = w
        giving = m.sum(1)
        giver = {r["node"] for r in f.totals().collect()}
        m = np.divide(m, giving[:, None], out=np.zeros_like(m), where=giving[:, None] > 0)
        s = np.array([x in ("a1", "a7") for x in names]) / 2
        dangling = np.array([x not in giver for x in names])
        v = np.full(len(names), 1 / len(names))
        for _ in range(6):
            v = 0.85 * (v @ m) + (0.85 * v[dangling].sum() + 0.15) * s
        assert [got[x] for x in names] == pytest.approx(v.tolist(), abs=1e-9)
    hubs = G.node_degree(edges, 12).where("is_hub")
    one = {r["node"]: r["taint"] for r in G.haircut_taint(edges, seeds, 12, rounds=3).collect()}
    two = {r["node"]: r["taint"] for r in G.haircut_taint_factored(factors, seeds, hubs, rounds=3).collect()}
    assert two == pytest.approx(one) and hubs.count()


def shuffles(df):
    """Exchanges in the plan of a query, small tables not broadcast."""
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_mixer_links_compute_their_parts_once(spark):
    l = ledger(spark, [(1, 0, [("a", 1.2), ("b", 1.3), ("c", 1.4)], [("x", 1.0), ("y", 1.0), ("z", 1.0), ("u", 0.2), ("v", 0.3)])])
    with recording() as written:
        links = M.mixer_links(l, l.tx.select("txid"))
    assert {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in written} == {"mix-pools", "mix-fits", "mix-open"}
    assert links.where("kind = 'POOL'").count() == 9


def test_candidates_of_a_mix_are_counted_in_one_move(spark):
    """They were moved once to be counted and twice to meet their count again."""
    l = ledger(spark, [(1, 0, [("a", 1.2), ("b", 1.3), ("c", 1.4), ("d", 1.2)], [("x", 1.0), ("y", 1.0), ("z", 1.0), ("u", 0.2), ("v", 0.3), ("w", 0.77), ("t", 0.83)])])
    links = M.mixer_links(l, l.tx.select("txid"))
    assert shuffles(links.where("kind <> 'POOL'")) <= 2
    share = {(r["kind"], r["dst"], r["src"]): r["prob"] for r in links.where("kind <> 'POOL'").collect()}
    assert share == {("CHANGE", "u", "a"): 0.5, ("CHANGE", "u", "d"): 0.5, ("CHANGE", "v", "b"): 1.0, **{("UNEXPLAINED", o, s): 0.25 for o in "wt" for s in "abcd"}}


def test_exposure_moves_links_twice_a_role_and_ranks_counterparties(spark):
    links = spark.createDataFrame([(1, s, "d", 0.25, "POOL", 1.0, 5) for s in "abcfe"] + [(1, "a", "g", 1.0, "CHANGE", 0.5, 5)], "txid bigint, src string, dst string, prob double, kind string, amount double, k bigint")
    taint = spark.createDataFrame([("e", 0.8), ("b", 0.4)], "address string, taint double")
    wallets = spark.createDataFrame([("d",), ("a",)], "address string")
    out = M.exposure(links, taint, wallets)
    # links and taint meet by the other end, the result and the wallets by the wallet: four exchanges for each of two roles
    assert shuffles(out) <= 8
    got = {(r["wallet"], r["role"]): r for r in out.collect()}
    assert set(got) == {("d", "RECEIVED"), ("a", "SENT")}
    assert [c["address"] for c in got["d", "RECEIVED"]["candidates"]][:2] == ["e", "b"]
    assert got["d", "RECEIVED"]["inherited_taint"] == pytest.approx(0.3) and got["a", "SENT"]["inherited_taint"] is None
    assert (got["a", "SENT"]["link_kind"], got["a", "SENT"]["anonymity_set"]) == ("POOL", 5)


def test_rows_staged_by_a_key_are_not_moved_again(spark):
    rows = spark.createDataFrame([(i % 7 if i % 5 else None, float(i)) for i in range(100)], "k long, v double")
    kept = stage(rows, "by-key", "k")
    sums = kept.groupBy("k").agg(F.sum("v").alias("s"))
    assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, sums.collect()), key=str) == sorted(map(tuple, rows.groupBy("k").agg(F.sum("v")).collect()), key=str)


def test_hops_read_arcs_in_place_and_hubs_pass_as_seeds_only(spark):
    hub = [("h", f"t{i}", 1.0) for i in range(5)]
    edges = spark.createDataFrame([*hub, ("s", "h", 1.0), ("s", "m", 1.0), ("m", "n", 3.0), (None, "x", 1.0)], "src string, dst string, w double")
    degree = stage(G.node_degree(edges, 4), "d")
    arcs = G.passing_arcs(edges, degree)
    assert sorted(map(tuple, arcs.select("src", "dst").collect())) == [("m", "n"), ("s", "h"), ("s", "m")]
    at = arcs.groupBy("src").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in at
    hops = lambda seed, **more: dict(map(tuple, G.bfs_hops(edges, spark.createDataFrame([(seed,)], "address string"), 3, 4, **more).collect()))
    assert hops("s") == hops("s", degree=degree, arcs=[arcs]) == {"s": 0, "h": 1, "m": 1, "n": 2}
    assert hops("h") == hops("h", degree=degree, arcs=[arcs]) == {"h": 0, **{f"t{i}": 1 for i in range(5)}}
    back = G.passing_arcs(G.reverse(edges), degree)
    assert hops("n", undirected=True) == hops("n", undirected=True, degree=degree, arcs=[arcs, back]) == {"n": 0, "m": 1, "s": 2, "h": 3}
    seeds = spark.createDataFrame([("s",)], "address string")
    taint = dict(map(tuple, G.haircut_taint(edges, seeds, 4, 2, 0.9).collect()))
    assert taint == pytest.approx({"s": 1.0, "h": 0.9, "m": 0.9, "n": 0.81}) == dict(map(tuple, G.haircut_taint(edges, seeds, 4, 2, 0.9, degree=degree, arcs=arcs).collect()))


def test_pagerank_of_sources_with_many_and_few_edges(spark):
    """Sources above and below the bound of edges are kept apart; the ranks are those of numpy."""
    import numpy as np
    pairs = [(0, i, 1.0 + i) for i in range(1, 71)] + [(i, (i * 3) % 71, 2.0) for i in range(1, 71) if (i * 3) % 71 != i]
    edges = spark.createDataFrame(pairs, "src long, dst long, w double")
    got = dict(map(tuple, G.pagerank(edges, spark.createDataFrame([(0,), (5,)], "address long"), 4, 0.0).collect()))
    m = np.zeros((71, 71))
    for a, b, w in pairs:
        m[a, b] += w
    m /= m.sum(axis=1, keepdims=True)
    s, x = np.zeros(71), np.full(71, 1 / 71)
    s[[0, 5]] = 0.5
    for _ in range(4):
        x = 0.85 * (x @ m) + 0.15 * s
    assert [got[i] for i in range(71)] == pytest.approx(list(x))
