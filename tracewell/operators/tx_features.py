"""Transaction features: shape, amounts, spend timing, peel chains, round trips and network signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.config import SETTINGS
from tracewell.functions.columns import equals_flag, hours_between, is_risky, just_below_power_of_ten, minutes_between, spy_confidence
from tracewell.operators.graph import connected_components
from tracewell.operators.ledger import Ledger
from tracewell.operators.temporal import asof

NO_RESPEND_MIN = 1e5


def output_shape(tout: DataFrame) -> DataFrame:
    """One pass over the outputs: first by (transaction, amount), then by transaction.

    The first level already holds every partial sum, so the multiplicity of equal amounts and all other statistics
    share the same two aggregations.
    """
    a = F.col("amount")
    sats = F.round(a * 1e8).cast("long")
    ticks = a * 1e4
    round_amount = (F.abs(ticks - F.rint(ticks)) < 1e-6).cast("long")
    by_amount = tout.groupBy("txid", sats.alias("sats")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(a).alias("s"), F.min(a).alias("lo"), F.max(a).alias("hi"),
        F.sum(F.when(a > 0, a)).alias("s_pos"), F.sum(F.when(a > 0, a * F.log2(a))).alias("s_log"),
        F.sum((a < 1e-5).cast("long")).alias("dust"), F.sum(round_amount).alias("rounds"),
        F.sum(just_below_power_of_ten(a)).alias("below"))
    agg = by_amount.groupBy("txid").agg(
        F.sum("n").alias("n_out"), F.sum("s").alias("total_out"), F.min("lo").alias("min_out"), F.max("hi").alias("max_out"),
        F.max("n").alias("max_equal_outputs"), F.sum("s_pos").alias("s_pos"), F.sum("s_log").alias("s_log"),
        F.sum("dust").alias("dust_outputs"), F.sum("rounds").alias("rounds"), F.sum("below").alias("below"))
    n = F.col("n_out")
    entropy = F.when((n > 1) & (F.col("s_pos") > 0),
                     (F.log2("s_pos") - F.col("s_log") / F.col("s_pos")) / F.log2(n)).otherwise(0.0)
    return agg.select(
        "txid", "n_out", "total_out", "min_out", "max_out", "max_equal_outputs",
        F.when(n > 1, F.col("max_equal_outputs") / n).otherwise(0.0).alias("equal_output_share"),
        F.coalesce(entropy, F.lit(0.0)).alias("output_entropy"),
        F.coalesce(F.col("min_out") / F.nullif("total_out", F.lit(0.0)), F.lit(1.0)).alias("min_out_share"),
        F.log10(F.col("max_out") / F.greatest(F.col("min_out"), F.lit(1e-8))).alias("log_max_min_ratio"),
        "dust_outputs", (F.col("rounds") / n).alias("round_output_share"), (F.col("below") / n).alias("below_round_share"))


def tx_shape(ledger: Ledger) -> DataFrame:
    """Counts, totals, fee rate, amount shape, hour, script flags and the peel shape of every transaction."""
    ins = ledger.tin.groupBy("txid").agg(F.count(F.lit(1)).alias("n_in"))
    zero = {c: 0 for c in ("n_in", "n_out", "max_equal_outputs", "dust_outputs")}
    zero |= {c: 0.0 for c in ("total_out", "equal_output_share", "output_entropy", "log_max_min_ratio",
                              "round_output_share", "below_round_share")}
    base = (ledger.tx.join(ins, "txid", "left").join(output_shape(ledger.tout), "txid", "left")
            .fillna(zero).fillna({"min_out_share": 1.0}))
    vbytes = 11 + 68 * F.greatest("n_in", F.lit(1)) + 31 * F.col("n_out")
    script = ({f"script_{s}": equals_flag(F.col("script_type"), s) for s in ("P2WSH", "P2TR", "P2PKH", "P2SH")}
              if "script_type" in ledger.tx.columns else {})
    return base.withColumns({
        "log_total_out": F.log1p("total_out"), "is_coinbase": (F.col("n_in") == 0).cast("double"),
        "fee_rate": F.coalesce("fee", F.lit(0.0)) * 1e8 / vbytes, "hour_utc": F.hour("ts").cast("long"), **script,
        "peel_shape": ((F.col("n_in") <= 2) & (F.col("n_out") == 2) & (F.col("min_out_share") < 0.1)).cast("double")})


def spent_outputs(ledger: Ledger) -> DataFrame:
    """Every output with the first strictly later spend of its address."""
    hit = asof(ledger.tout, ledger.tin, "address", "ts", "ts", ["txid"], "forward", strict=True)
    return hit.withColumn("respend_min", minutes_between(F.col("m_ts"), F.col("ts"))).withColumnsRenamed(
        {"m_ts": "spend_ts", "m_txid": "spend_txid"})


def created_inputs(ledger: Ledger) -> DataFrame:
    """Every input with the last strictly earlier receipt of its address."""
    marks = ledger.tout.select("address", "ts", F.lit(1).alias("one"))
    hit = asof(ledger.tin, marks, "address", "ts", "ts", ["one"], "backward", strict=True)
    return hit.withColumn("age_h", hours_between(F.col("ts"), F.col("m_ts"))).drop("m_ts", "m_one")


def spend_timing(spent: DataFrame) -> DataFrame:
    quick = F.coalesce(F.col("respend_min") < 60, F.lit(False)).cast("double")
    return spent.groupBy("txid").agg(
        F.least(F.coalesce(F.min("respend_min"), F.lit(NO_RESPEND_MIN)), F.lit(NO_RESPEND_MIN)).alias("min_respend_min"),
        F.avg(quick).alias("share_spent_1h"))


def input_age(created: DataFrame) -> DataFrame:
    return created.groupBy("txid").agg(F.coalesce(F.avg("age_h"), F.lit(-1.0)).alias("mean_input_age_h"))


def largest_output(spent: DataFrame) -> DataFrame:
    """Per transaction the largest output (smallest index on a tie) with its next spend."""
    best = F.max(F.struct("amount", (-F.col("idx")).alias("neg_idx"), "address", "spend_txid"))
    return (spent.groupBy("txid").agg(best.alias("b"))
            .select("txid", F.col("b.address").alias("address"), F.col("b.amount").alias("amount"), F.col("b.spend_txid").alias("spend_txid")))


def peel_chains(shape: DataFrame, spent: DataFrame) -> DataFrame:
    """Chain length and id for every peel-shaped transaction: components of peel -> peel spends of the largest output."""
    peel = shape.where("peel_shape = 1").select("txid")
    big = largest_output(spent.join(peel, "txid", "left_semi")).where("spend_txid is not null")
    links = (big.select(F.col("txid").alias("a"), F.col("spend_txid").alias("b"))
             .join(peel.select(F.col("txid").alias("b")), "b", "left_semi"))
    comp = connected_components(links, "a", "b")
    nodes = peel.join(comp.withColumnRenamed("node", "txid"), "txid", "left").withColumn("root", F.coalesce("root", "txid"))
    size = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("peel_chain_len"))
    return nodes.join(size, "root").select("txid", F.col("peel_chain_len").cast("double").alias("peel_chain_len"),
                                           F.substring(F.col("root").cast("string"), 1, 12).alias("peel_chain_id"), "root")


def returns_to_input(ledger: Ledger, shape: DataFrame, spenders: int = 5, frontier: int = 50) -> DataFrame:
    """Small transactions (1-2 inputs, <= 2 outputs) whose value comes back to an input address within two follow-on spends.

    The search looks at the first ``spenders`` spends of an address and the first ``frontier`` transactions of a step;
    both limits belong to the definition of the feature.
    """
    origin = shape.where("n_in between 1 and 2 and n_out <= 2").select(F.col("txid").alias("origin"))
    by_addr = W.partitionBy("address").orderBy("txid", "idx")
    firsts = (ledger.tin.select("address", "txid", "idx").withColumn("rank", F.row_number().over(by_addr))
              .where(F.col("rank") <= spenders).select("address", F.col("txid").alias("next"), F.col("rank").cast("long").alias("rank")))
    outs = ledger.tout.select("txid", "idx", "address")
    targets = ledger.tin.select(F.col("txid").alias("origin"), "address").distinct()
    step = lambda df, keys: (df.join(outs, df.at == outs.txid)
                             .select("origin", *keys, "idx", "address"))
    one = (step(origin.withColumn("at", F.col("origin")), []).join(firsts, "address")
           .select("origin", F.array("idx", "rank").alias("pos"), F.col("next").alias("at")))
    order = W.partitionBy("origin").orderBy("pos")
    one = one.withColumn("k", F.row_number().over(order)).where(F.col("k") <= frontier).drop("k")
    seen_one = step(one, ["pos", "at"]).where("at <> origin")
    two = (step(one, ["pos"]).join(firsts, "address")
           .select("origin", F.concat("pos", F.array("idx", "rank")).alias("pos"), F.col("next").alias("at")))
    two = two.withColumn("k", F.row_number().over(order)).where(F.col("k") <= frontier).drop("k")
    seen_two = step(two, ["at"]).where("at <> origin")
    hits = (seen_one.select("origin", "address").unionByName(seen_two.select("origin", "address"))
            .join(targets, ["origin", "address"], "left_semi").select("origin").distinct())
    return origin.join(hits.withColumn("hit", F.lit(1.0)), "origin", "left").select(
        F.col("origin").alias("txid"), F.coalesce("hit", F.lit(0.0)).alias("returns_to_input"))


def tx_network(tx: DataFrame, spy: DataFrame) -> DataFrame:
    """Network signals of the first relay; without a relay the port counts as non-standard."""
    j = tx.select("txid").join(spy, "txid", "left")
    kind = F.col("spy_asn_type")
    gap = F.coalesce("spy_delta", F.lit(SETTINGS.first_spy_default_gap_sec))
    return j.select("txid", is_risky(kind).alias("spy_risky_asn"), equals_flag(kind, "TOR_EXIT").alias("spy_tor"),
                    equals_flag(kind, "DATACENTER").alias("spy_datacenter"), equals_flag(kind, "RESIDENTIAL").alias("spy_residential"),
                    spy_confidence(gap).alias("spy_confidence"), F.coalesce("n_obs", F.lit(0)).cast("long").alias("n_obs"),
                    (1 - equals_flag(F.col("spy_port"), SETTINGS.standard_port)).alias("spy_nonstd_port"))


def tx_features(ledger: Ledger, shape: DataFrame | None = None, spent: DataFrame | None = None) -> DataFrame:
    """The full transaction matrix."""
    shape = tx_shape(ledger) if shape is None else shape
    spent = spent_outputs(ledger) if spent is None else spent
    x = (shape.join(spend_timing(spent), "txid", "left").join(input_age(created_inputs(ledger)), "txid", "left")
         .join(peel_chains(shape, spent).drop("root"), "txid", "left")
         .join(returns_to_input(ledger, shape), "txid", "left"))
    if ledger.spy is not None:
        x = x.join(tx_network(ledger.tx, ledger.spy), "txid", "left")
    return x.fillna({"min_respend_min": NO_RESPEND_MIN, "share_spent_1h": 0.0, "mean_input_age_h": -1.0,
                     "peel_chain_len": 0.0, "returns_to_input": 0.0})


# Columns of the matrix that a model may see
TX_COLUMNS = ["n_in", "n_out", "total_out", "log_total_out", "is_coinbase", "fee_rate", "max_equal_outputs", "equal_output_share",
              "output_entropy", "min_out_share", "log_max_min_ratio", "dust_outputs", "round_output_share", "hour_utc",
              "script_P2WSH", "script_P2TR", "script_P2PKH", "script_P2SH", "min_respend_min", "share_spent_1h",
              "mean_input_age_h", "peel_shape", "peel_chain_len", "returns_to_input", "spy_risky_asn", "spy_tor",
              "spy_datacenter", "spy_residential", "spy_confidence", "n_obs", "spy_nonstd_port"]
TX_NETWORK_COLUMNS = ["spy_risky_asn", "spy_tor", "spy_datacenter", "spy_residential", "spy_confidence", "n_obs", "spy_nonstd_port"]
