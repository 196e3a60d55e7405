"""Wallet features: totals, timing, shapes of the transactions taken part in, network, movement and money context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.config import SETTINGS
from tracewell.functions.columns import haversine_km, hours_between, is_risky, micros, spy_confidence, equals_flag
from tracewell.operators.ledger import Ledger, memberships
from tracewell.operators.temporal import previous_row
from tracewell.operators.tx_features import NO_RESPEND_MIN

SHAPE_SIGNALS = ["peel_chain_len", "equal_output_share", "returns_to_input", "dust_outputs", "peel_shape"]


def wallet_totals(ledger: Ledger) -> DataFrame:
    """Distinct transactions, value and first / last times of both sides: one union and one aggregation instead of an outer join.

    Each side is reduced to one row per (address, transaction) first, so a busy address is spread over its transactions.
    """
    def side(df, flag):
        return (df.groupBy("address", "txid").agg(F.sum("amount").alias("amount"), F.min("ts").alias("ts"))
                .select("address", F.lit(flag).alias("spend"), "amount", "ts"))
    rows = side(ledger.tout, False).unionByName(side(ledger.tin, True))
    spend, recv = F.col("spend"), ~F.col("spend")
    part = lambda cond, c: F.when(cond, F.col(c))
    return rows.groupBy("address").agg(
        F.count(part(recv, "amount")).alias("n_recv"), F.coalesce(F.sum(part(recv, "amount")), F.lit(0.0)).alias("recv_btc"),
        F.min(part(recv, "ts")).alias("first_recv"), F.max(part(recv, "ts")).alias("last_recv"),
        F.count(part(spend, "amount")).alias("n_spend"), F.coalesce(F.sum(part(spend, "amount")), F.lit(0.0)).alias("sent_btc"),
        F.min(part(spend, "ts")).alias("first_spend"), F.max(part(spend, "ts")).alias("last_spend"))


def with_times(totals: DataFrame) -> DataFrame:
    first, last = F.least("first_recv", "first_spend"), F.greatest("last_recv", "last_spend")
    return totals.withColumns({
        "lifetime_h": hours_between(last, first),
        "hold_h": F.coalesce(hours_between(F.col("first_spend"), F.col("first_recv")), F.lit(-1.0)),
        "log_recv_btc": F.log1p("recv_btc"), "log_sent_btc": F.log1p("sent_btc"),
        "reused": (F.col("n_recv") > 1).cast("double")})


def wallet_tx_shape(ledger: Ledger, x: DataFrame) -> DataFrame:
    """Shape of the transactions a wallet spends in and is funded by. One join of the transaction matrix for both roles."""
    pair = lambda df, spend: df.select("txid", "address").distinct().withColumn("spend", F.lit(spend))
    rows = pair(ledger.tin, True).unionByName(pair(ledger.tout, False))
    j = rows.join(x.select("txid", "n_in", "n_out", "min_respend_min", *SHAPE_SIGNALS), "txid")
    when = lambda cond, c: F.when(cond, F.col(c))
    spend = F.col("spend")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.groupBy("address").agg(
        zero(F.max(when(spend, "n_out"))).alias("spend_max_n_out"), zero(F.max(when(~spend, "n_in"))).alias("fund_max_n_in"),
        zero(F.max(when(~spend, "n_out"))).alias("fund_n_out"),
        F.coalesce(F.min(when(~spend, "min_respend_min")), F.lit(NO_RESPEND_MIN)).alias("min_respend_min"),
        *[F.max(c).cast("double").alias(f"max_{c}") for c in SHAPE_SIGNALS])


def spends_with_relay(ledger: Ledger) -> DataFrame:
    """One row per (spend, wallet) with what is known about the first relay."""
    pairs = ledger.tin.groupBy("txid", "address").agg(F.min("ts").alias("ts"))
    return pairs.join(ledger.spy, "txid", "left")


def wallet_network(net: DataFrame) -> DataFrame:
    gap = F.coalesce(F.avg("spy_delta"), F.lit(SETTINGS.first_spy_default_gap_sec))
    return net.groupBy("address").agg(
        F.count_distinct("spy_ip").alias("n_spend_ips"), F.count_distinct("spy_country").alias("n_spend_countries"),
        F.avg(is_risky(F.col("spy_asn_type"))).alias("share_risky_asn"),
        F.avg(equals_flag(F.col("spy_asn_type"), "DATACENTER")).alias("share_datacenter"),
        spy_confidence(gap).alias("mean_spy_confidence"))


def speed_kmh(prev: str, lat: str = "lat", lon: str = "lon", ts: str = "ts", floor_s: int = 60) -> tuple[Column, Column]:
    """Distance in km and speed in km/h from the previous located row; at least a minute is assumed to pass."""
    km = haversine_km(F.col(f"{prev}.lat"), F.col(f"{prev}.lon"), F.col(lat), F.col(lon))
    hours = F.greatest(micros(ts) - F.col(f"{prev}.t"), F.lit(floor_s * 1_000_000)) / 3600e6
    return km, km / hours


def geo_velocity(net: DataFrame, places: DataFrame) -> DataFrame:
    """Fastest implied travel between consecutive located spends of a wallet. ``places`` is a country table (about 250 rows)."""
    located = net.select("address", "txid", "ts", F.col("spy_country").alias("country")).join(F.broadcast(places), "country")
    moved = previous_row(located, "address", "ts", ["txid"], ["lat", "lon"]).where("prev is not null")
    _, speed = speed_kmh("prev")
    return moved.groupBy("address").agg(F.least(F.max(speed), F.lit(SETTINGS.velocity_cap_kmh)).alias("max_geo_velocity_kmh"))


def address_degree(ledger: Ledger) -> DataFrame:
    return memberships(ledger).groupBy("address").agg(F.count(F.lit(1)).alias("degree"))


def swept_addresses(tin: DataFrame, x: DataFrame) -> DataFrame:
    """Addresses spent in a transaction of many inputs, the way services sweep deposits."""
    sweeps = x.where(F.col("n_in") >= SETTINGS.sweep_min_inputs).select("txid")
    return tin.join(sweeps, "txid", "left_semi").select("address").distinct()


def ctx_tx(ledger: Ledger, x: DataFrame, degree: DataFrame, swept: DataFrame) -> DataFrame:
    """Money context of every transaction. ``x`` needs txid, n_in, n_out, below_round_share."""
    spread = ledger.tout.groupBy("txid").agg(F.stddev_pop("amount").alias("sd"), F.avg("amount").alias("mean"))
    to_swept = (ledger.tout.select("txid", "address")
                .join(swept.withColumn("hit", F.lit(1.0)), "address", "left")
                .groupBy("txid").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("out_consolidated_share")))
    funders = (ledger.tin.groupBy("txid", "address").agg(F.lit(1).alias("one")).join(degree, "address")
               .groupBy("txid").agg(F.max(F.log1p("degree")).alias("in_hub"), F.count(F.lit(1)).alias("n_funders")))
    j = (x.select("txid", "n_in", "n_out", "below_round_share").join(spread, "txid", "left")
         .join(to_swept, "txid", "left").join(funders, "txid", "left"))
    cv = F.when(F.col("n_out") > 1, F.coalesce(F.col("sd") / F.nullif("mean", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    return (j.withColumn("out_cv", cv).drop("sd", "mean")
            .fillna({"below_round_share": 0.0, "out_consolidated_share": 0.0, "in_hub": 0.0, "n_funders": 0}))


def ctx_parent(ledger: Ledger, ctx: DataFrame) -> DataFrame:
    """Largest input count and hub degree among the transactions that created a transaction's inputs.

    The creator of an address is the row with the smallest (transaction, index)."""
    parent = ledger.tout.groupBy("address").agg(F.min(F.struct("txid", "idx")).alias("p")).select("address", F.col("p.txid").alias("parent"))
    links = ledger.tin.select("txid", "address").distinct().join(parent, "address").where("parent <> txid").select("txid", "parent").distinct()
    facts = ctx.select(F.col("txid").alias("parent"), "n_in", "in_hub")
    return links.join(facts, "parent").groupBy("txid").agg(F.max("n_in").alias("parent_max_n_in"), F.max("in_hub").alias("parent_in_hub"))


def ctx_wallet(ledger: Ledger, ctx: DataFrame, parents: DataFrame, swept: DataFrame) -> DataFrame:
    full = ctx.join(parents, "txid", "left").fillna({"parent_max_n_in": 0, "parent_in_hub": 0.0})
    pair = lambda df, spend: df.select("txid", "address").distinct().withColumn("spend", F.lit(spend))
    rows = pair(ledger.tin, True).unionByName(pair(ledger.tout, False)).join(full, "txid")
    fund = lambda c: F.when(~F.col("spend"), F.col(c))
    w = rows.groupBy("address").agg(
        F.avg(fund("out_cv")).alias("fund_out_cv"), F.max(fund("below_round_share")).alias("fund_below_round"),
        F.max(fund("in_hub")).alias("fund_in_hub"), F.log1p(F.max(fund("parent_max_n_in"))).alias("fund_parent_max_n_in"),
        F.max(fund("parent_in_hub")).alias("fund_parent_in_hub"), F.log1p(F.max(fund("n_funders"))).alias("fund_log_n_funders"),
        F.avg(F.when(F.col("spend"), F.col("out_consolidated_share"))).alias("spend_to_consolidated"))
    return (w.join(swept.withColumn("is_consolidated", F.lit(1.0)), "address", "left")
            .fillna(0.0, subset=[*CONTEXT_COLUMNS]))


CONTEXT_COLUMNS = ["fund_out_cv", "fund_below_round", "fund_in_hub", "fund_parent_max_n_in", "fund_parent_in_hub",
                   "fund_log_n_funders", "spend_to_consolidated", "is_consolidated"]


def class_maxima(ledger: Ledger, probs: DataFrame, classes: list[str]) -> DataFrame:
    """Highest probability of every transaction class over a wallet's transactions."""
    return (memberships(ledger).join(probs.select("txid", *classes), "txid").groupBy("address")
            .agg(*[F.max(c).alias(f"max_{c}") for c in classes]))


def cluster_aggregates(w: DataFrame, cluster: str = "cluster_root") -> DataFrame:
    """Aggregates over the owner's cluster, given back to each of its wallets by a join (no window over a huge cluster)."""
    fund = ["fund_parent_max_n_in", "fund_parent_in_hub", "fund_log_n_funders", "fund_in_hub", "fund_below_round"]
    g = w.groupBy(cluster).agg(
        F.log1p(F.count(F.lit(1))).alias("log_cluster_size"), F.max("max_p_peel").alias("cluster_max_p_peel"),
        F.max("max_p_coinjoin").alias("cluster_max_p_coinjoin"), F.avg("share_risky_asn").alias("cluster_share_risky"),
        F.least(F.sum("n_spend_countries"), F.lit(50)).alias("cluster_n_countries"),
        *[F.max(c).alias(f"cluster_max_{c}") for c in fund], F.log1p(F.sum("sent_btc")).alias("cluster_log_size_spend"))
    return w.join(g, cluster)


def wallet_features(ledger: Ledger, x: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """The wallet matrix before clusters and model outputs."""
    w = with_times(wallet_totals(ledger)).join(wallet_tx_shape(ledger, x), "address", "left")
    zero = []
    if ledger.spy is not None:
        net = spends_with_relay(ledger)
        w = w.join(wallet_network(net), "address", "left")
        zero += ["n_spend_ips", "n_spend_countries", "share_risky_asn", "share_datacenter"]
        w = w.fillna({"mean_spy_confidence": DEFAULT_CONFIDENCE})
        if places is not None:
            w = w.join(geo_velocity(net, places), "address", "left")
            zero.append("max_geo_velocity_kmh")
    swept = swept_addresses(ledger.tin, x)
    ctx = ctx_tx(ledger, x, address_degree(ledger), swept)
    w = w.join(ctx_wallet(ledger, ctx, ctx_parent(ledger, ctx), swept), "address", "left")
    return w.fillna(0, subset=zero).drop("first_recv", "last_recv", "first_spend", "last_spend")


DEFAULT_CONFIDENCE = 0.18126924692201818  # 1 - exp(-0.3 / 1.5)
WALLET_NETWORK_COLUMNS = ["n_spend_ips", "n_spend_countries", "share_risky_asn", "share_datacenter", "max_geo_velocity_kmh", "mean_spy_confidence"]
