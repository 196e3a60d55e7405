"""Alerts: candidates, risk, evidence, rule-based next step, and what was carried over from the last run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.config import ACTION_PRIORITY, CROSS_CHAIN_TYPES, SETTINGS
from tracewell.functions.columns import micros, severity, short_hash, spy_confidence
from tracewell.operators.ledger import Ledger, memberships
from tracewell.operators.tracing import minutes_1


def alert_candidates(scores: DataFrame, s=SETTINGS) -> DataFrame:
    """The riskiest wallet of every cluster with p above the threshold; only the highest ``max_alerts`` if that is set.

    Needs address, p, cluster_root. A wallet alone in its cluster stands for itself, so one reduction serves both."""
    order = W.partitionBy("cluster_root").orderBy(F.desc("p"), "address")
    best = scores.where(F.col("p") >= s.alert_min_probability).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
    return best if s.max_alerts is None else best.orderBy(F.desc("p"), "address").limit(s.max_alerts)


def alert_id(address: Column) -> Column:
    return F.concat(F.lit("A-W-"), short_hash(address, 10))


def risk_fields(w: DataFrame) -> DataFrame:
    """Risk, severity and confidence. Needs p, anomaly, max_p_any, taint, hops_from_seed, share_risky_asn, n_spend, n_recv,
    has_spy, cluster_size."""
    p = F.col("p")
    sure = p >= 0.5
    flags = [F.col("anomaly") > 0.9, F.col("max_p_any") > 0.5, (F.col("taint") > 0.05) | (F.col("hops_from_seed") <= 3), F.col("share_risky_asn") > 0]
    agree = sum((f == sure).cast("double") for f in flags) / len(flags)
    facts = [(F.col("n_spend") > 0) | (F.col("n_recv") > 0), F.col("has_spy"), F.col("cluster_size") > 1]
    complete = sum(f.cast("double") for f in facts) / len(facts)
    conf = 0.5 * F.abs(2 * p - 1) + 0.3 * agree + 0.2 * complete
    risk = F.round(100 * p, 1)
    return w.withColumns({"risk_score": risk, "severity": severity(risk),
                          "confidence": F.round(F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0)), 3)})


def alert_evidence(candidates: DataFrame, ledger: Ledger, p_normal: DataFrame, chains: DataFrame | None = None, top: int = 8) -> DataFrame:
    """Per candidate wallet the key transaction (least normal, then earliest), the next ones, and its first relay.

    The ranking is limited before the shuffle, so a wallet with very many transactions costs no more than the rest."""
    mine = memberships(ledger).join(candidates.select("address"), "address", "left_semi").join(p_normal.select("txid", "p_normal"), "txid")
    order = W.partitionBy("address").orderBy("p_normal", "ts", "txid")
    best = mine.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)
    e = best.groupBy("address").agg(F.sort_array(F.collect_list(F.struct("k", "txid"))).alias("x")).select(
        "address", F.col("x.txid").alias("top_txids"), F.col("x")[0].txid.alias("txid"))
    out = e.join(ledger.spy.select("txid", F.col("spy_ip").alias("first_spy_ip"), F.col("spy_asn_type").alias("first_spy_asn_type"),
                                   F.round(spy_confidence(F.col("spy_delta")), 3).alias("first_spy_confidence")), "txid", "left")
    if chains is not None:
        # chains of key transactions only; a chain is one list ordered by time
        keys = e.select("txid").join(chains.select("txid", "root"), "txid").select("root").distinct()
        lists = (chains.join(keys, "root", "left_semi").join(ledger.tx.select("txid", "ts"), "txid").groupBy("root")
                 .agg(F.sort_array(F.collect_list(F.struct("ts", "txid"))).alias("c")).select("root", F.col("c.txid").alias("peel_chain")))
        out = out.join(chains.select("txid", "root").join(lists, "root").drop("root"), "txid", "left")
    return out


def decide_actions(alerts: DataFrame, wallets: DataFrame, exits: DataFrame, known: DataFrame, funders: DataFrame, now_us: Column, s=SETTINGS) -> DataFrame:
    """One rule-based next step per alert, with everything else that matched.

    alerts: address, risk_score.  wallets: address, sent_btc, recv_btc, cluster_sent_btc, share_risky_asn, max_p_peel,
    max_p_coinjoin, max_p_fan_out, max_peel_chain_len, taint, hops_from_seed, hops_to_seed, last_seen_us.
    exits: the rows of :func:`tracing.trace_exits`.  funders: (address, funder).
    """
    base = alerts.join(wallets, "address", "left").join(known.select("address", F.col("entity_name").alias("own_name")), "address", "left")
    base = base.withColumn("now_us", now_us)
    foreign = exits.join(base.where("own_name is null").select(F.col("address").alias("start"), "now_us"), "start")
    age_us = F.col("now_us") - F.col("deposit_us")
    is_vasp = F.col("entity_type") == "VASP"
    quick = F.coalesce(F.col("minutes_after_receipt") <= s.freeze_window_min, F.lit(False))
    fresh = is_vasp & (quick | ((age_us >= 0) & (age_us <= s.freeze_window_min * 60e6)))
    # quick beats fresh, then the smaller number of minutes
    urgency = F.struct(F.when(quick, 0).otherwise(1).alias("kind"),
                       F.when(quick, F.col("minutes_after_receipt")).otherwise(age_us / 60e6).alias("minutes"), F.col("hop"), F.col("txid").cast("string").alias("txid"),
                       F.col("deposit_address"), F.col("vasp"), F.col("in_jurisdiction"))
    local = is_vasp & F.col("in_jurisdiction")
    nearest = F.struct("hop", "deposit_us", F.col("txid").cast("string").alias("txid"), "deposit_address", "vasp")
    out = F.col("entity_type").isin(*CROSS_CHAIN_TYPES)
    seen = foreign.groupBy(F.col("start").alias("address")).agg(
        F.min(F.when(fresh, urgency)).alias("fresh"), F.min(F.when(local, nearest)).alias("local"), F.sum(local.cast("long")).alias("local_deposits"),
        F.min(F.when(out, nearest)).alias("exit"), F.sum(out.cast("long")).alias("exit_count"), F.sum(F.when(out, F.col("amount_btc"))).alias("exit_btc"),
        F.sum(is_vasp.cast("long")).alias("deposits"))
    pools = (funders.join(base.select("address"), "address", "left_semi")
             .join(known.where("entity_type = 'MINING_POOL'").select(F.col("address").alias("funder")), "funder", "left_semi")
             .groupBy("address").agg(F.count(F.lit(1)).alias("pool_funders")))
    j = base.join(seen, "address", "left").join(pools, "address", "left").fillna(
        0, subset=["sent_btc", "recv_btc", "cluster_sent_btc", "share_risky_asn", "max_p_peel", "max_p_coinjoin", "max_p_fan_out", "max_peel_chain_len", "taint",
                   "pool_funders", "deposits", "exit_count", "local_deposits"]).fillna(s.hops_missing, subset=["hops_from_seed", "hops_to_seed"])
    moved = F.greatest("sent_btc", "recv_btc", "cluster_sent_btc")
    layering = (F.greatest("max_p_peel", "max_p_coinjoin", "max_p_fan_out") > 0.5) | (F.col("max_peel_chain_len") >= s.min_peel_chain)
    hops = F.least("hops_from_seed", "hops_to_seed")
    balance = F.col("recv_btc") - F.col("sent_btc")
    dormant_h = (F.col("now_us") - F.col("last_seen_us")) / 3600e6
    own = F.col("own_name").isNotNull()
    rules = {
        "IMMEDIATE_FREEZE_DRAFT": F.col("fresh").isNotNull() & (F.col("risk_score") >= s.freeze_min_risk),
        "DRAFT_SECTION_94_BNSS": F.col("local").isNotNull(),
        "CROSS_CHAIN_EXIT": F.col("exit").isNotNull(),
        "FIU_REFERRAL_PACK": (moved >= s.layering_min_btc) & (F.col("share_risky_asn") > 0) & layering,
        "PASSIVE_TAINT_MONITOR": (balance > s.min_balance_btc) & (dormant_h >= s.dormant_h) & ((F.col("taint") > 0) | (hops <= s.seed_link_hops)),
        "REVIEW_LIKELY_BENIGN": own | ((F.col("pool_funders") > 0) & (F.col("taint") == 0) & (hops >= s.no_seed_path) & (F.col("share_risky_asn") == 0)),
    }
    matched = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    # the rules are listed in priority order
    assert list(rules) + ["ANALYST_REVIEW"] == sorted(ACTION_PRIORITY, key=ACTION_PRIORITY.get)
    j = j.withColumn("matched", F.when(F.size(matched) > 0, matched).otherwise(F.array(F.lit("ANALYST_REVIEW"))))
    return j.select(
        "address", "risk_score", F.col("matched")[0].alias("action"), F.slice("matched", 2, len(ACTION_PRIORITY)).alias("also_matched"),
        F.col("fresh.vasp").alias("freeze_vasp"), F.col("fresh.txid").alias("freeze_txid"), F.col("fresh.minutes").alias("freeze_minutes"),
        F.col("local.vasp").alias("local_vasp"), "local_deposits", F.col("exit.vasp").alias("exit_service"), "exit_count", F.round(F.coalesce("exit_btc", F.lit(0.0)), 8).alias("btc_to_services"),
        moved.alias("btc_moved"), balance.alias("unspent_btc"), dormant_h.alias("dormant_h"), "pool_funders", "deposits")


def last_seen(ledger: Ledger) -> DataFrame:
    both = ledger.tin.select("address", "ts").unionByName(ledger.tout.select("address", "ts"))
    return both.groupBy("address").agg(F.max(micros("ts")).alias("last_seen_us"))


def first_deposits(exits: DataFrame) -> DataFrame:
    """The first exchange deposit with a known delay per start wallet."""
    d = F.min(F.struct("deposit_us", "hop", F.col("txid").cast("string").alias("txid"), "vasp", "minutes_after_receipt", "in_jurisdiction"))
    return (exits.where("entity_type = 'VASP' and minutes_after_receipt is not null").groupBy(F.col("start").alias("address")).agg(d.alias("d"))
            .select("address", F.col("d.vasp").alias("vasp"), F.col("d.minutes_after_receipt").alias("delay"), F.col("d.in_jurisdiction").alias("in_jurisdiction"), F.col("d.deposit_us").alias("deposit_us")))


def carry_status(new_alerts: DataFrame, old_alerts: DataFrame) -> DataFrame:
    """Analyst status and assignee of the last run, put on the rebuilt alerts; only values that are not the default survive."""
    kept = (old_alerts.where("status <> 'OPEN' or assigned_to <> 'Unassigned'").groupBy("entity_id")
            .agg(F.max_by(F.struct("status", "assigned_to"), "alert_id").alias("o")))
    return new_alerts.join(kept, "entity_id", "left").select(
        *new_alerts.columns, F.coalesce("o.status", F.lit("OPEN")).alias("status"), F.coalesce("o.assigned_to", F.lit("Unassigned")).alias("assigned_to"))


# The sentence for each feature that raised the risk. The first word says how the value is printed:
# pct = percent, int = whole number, thousands = whole number with separators, one / two = decimals, text = not at all.
FEATURE_TEXT = {
    "max_peel_chain_len": ("int", "Part of a %s-hop peeling chain (small amounts shaved off at each hop)"),
    "cluster_max_p_peel": ("pct", "Its cluster contains peel-chain transactions (model probability %s)"),
    "max_p_peel": ("pct", "Takes part in a peel-shaped transaction (model probability %s)"),
    "max_p_coinjoin": ("pct", "Takes part in a CoinJoin-like mixing transaction (probability %s)"),
    "max_equal_output_share": ("pct", "%s of a transaction's outputs have identical value (mixing signature)"),
    "max_p_fan_out": ("pct", "Takes part in a rapid fan-out split (probability %s)"),
    "max_p_fan_in": ("pct", "Takes part in a consolidation (many inputs → one output, probability %s)"),
    "max_p_round_trip": ("pct", "Funds move in a circle back to the sender (probability %s)"),
    "max_returns_to_input": ("text", "Funds return to an address they came from within 3 hops (round trip)"),
    "taint": ("pct", "%s of incoming value traces back to a known illicit seed wallet"),
    "ppr": ("two", "High proximity to seed wallets in the money-flow graph (PPR %s)"),
    "ppr_reverse": ("two", "Sends money towards known illicit seed wallets (reverse PPR %s)"),
    "hops_from_seed": ("int", "Receives funds %s hop(s) downstream of a known illicit seed wallet"),
    "hops_to_seed": ("int", "Funds reach a known illicit seed wallet within %s hop(s)"),
    "anomaly": ("pct", "Behaviour is more unusual than %s of wallets (Isolation Forest)"),
    "share_risky_asn": ("pct", "%s of its transactions were first relayed from Tor / VPN / bulletproof hosting"),
    "share_datacenter": ("pct", "%s of its transactions were first relayed from datacenter IPs"),
    "n_spend_countries": ("int", "Its spends were broadcast from %s different countries"),
    "max_geo_velocity_kmh": ("thousands", "Consecutive broadcasts imply %s km/h travel (impossible for one person)"),
    "n_spend_ips": ("int", "Its spends were broadcast from %s different IP addresses"),
    "hold_h": ("one", "Funds held only %s h before being moved on"),
    "min_respend_min": ("int", "Received funds were spent again within %s minutes"),
    "spend_max_n_out": ("int", "Spent in a transaction with %s outputs"),
    "fund_max_n_in": ("int", "Funded by a transaction with %s inputs"),
    "log_cluster_size": ("size", "Belongs to a multi-address entity cluster (~%s addresses)"),
    "cluster_share_risky": ("pct", "%s of its cluster's spends come from Tor / VPN / bulletproof relays"),
    "max_dust_outputs": ("int", "Involved in a transaction with %s dust outputs (dusting)"),
    "lifetime_h": ("one", "Active for only %s h"),
}
NEVER_MOVED = "Funds never moved on"
# ------------------------------------------------------------------------------------------------


def _printed(value: Column, kind: Column) -> Column:
    whole = lambda c: F.rint(c).cast("long").cast("string")
    plain = lambda c, d: F.replace(F.format_number(c, d), F.lit(","), F.lit(""))
    return (F.when(kind == "pct", F.concat(whole(value * 100), F.lit("%"))).when(kind == "int", whole(value))
            .when(kind == "thousands", F.format_number(value, 0)).when(kind == "one", plain(value, 1)).when(kind == "two", plain(value, 2))
            .when(kind == "size", F.greatest(F.lit(1), F.rint(F.pow(F.lit(2.718), value) - 1).cast("long")).cast("string")).otherwise(""))


def reasons(alerts: DataFrame, contributions: DataFrame, top: int = 4) -> DataFrame:
    """Plain sentences per alert: the typology, then the strongest features that raised the risk.

    alerts: address, typology, p.  contributions: address, feature, value, impact (at most six per address)."""
    table = {k: F.create_map(*[F.lit(x) for f, row in FEATURE_TEXT.items() for x in (f, row[k])]) for k in (0, 1)}
    kind, text = (F.try_element_at(table[k], F.col("feature")) for k in (0, 1))
    sentence = F.when((F.col("feature") == "hold_h") & (F.col("value") < 0), NEVER_MOVED).otherwise(
        F.replace(text, F.lit("%s"), _printed(F.col("value"), kind)))
    order = W.partitionBy("address").orderBy(F.desc(F.abs("impact")), "feature")
    pos = (contributions.where("impact > 0").withColumn("s", sentence).where("s is not null").withColumn("k", F.row_number().over(order))
           .where(F.col("k") <= top + 1).groupBy("address").agg(F.sort_array(F.collect_list(F.struct("k", "s"))).alias("r")).select("address", F.col("r.s").alias("r")))
    pct = F.concat(F.rint(F.col("p") * 100).cast("long").cast("string"), F.lit("%"))
    known = F.col("typology").isNotNull() & ~F.col("typology").isin("", "UNKNOWN", "NORMAL")
    head = F.when(known, F.array(F.concat(F.lit("Behaviour most similar to "), F.lower(F.replace("typology", F.lit("_"), F.lit(" "))),
                                          F.lit(" wallets (fused probability of illicit activity "), pct, F.lit(")")))).otherwise(F.array().cast("array<string>"))
    rows = F.slice(F.concat(head, F.coalesce("r", F.array().cast("array<string>"))), 1, top + 1)
    fallback = F.array(F.concat(F.lit("Fused probability of illicit activity "), pct))
    return alerts.select("address", "typology", "p").join(pos, "address", "left").select(
        "address", F.when(F.size(rows) > 0, rows).otherwise(fallback).alias("reasons"))
