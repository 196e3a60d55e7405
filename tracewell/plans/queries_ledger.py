"""Queries over the ledger: projections, first relays and transaction features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.columns import software_fingerprint, spy_confidence, micros
from tracewell.operators import ledger as L
from tracewell.operators import tx_features as T
from tracewell.operators.wallet_features import wallet_totals
from tracewell.plans.oracle import cte, r, with_ctes
from tracewell.plans.registry import query


def r6(c, n=6):
    return F.round(c, n)


# The ledger as one row per transaction with parallel arrays (the stored form)
cte("txarr", ("tx", "tin", "tout"), """
  SELECT tx.txid, tx.ts AS "timestamp", tx.fee, i.ia AS input_addresses, i.am AS input_amounts, o.oa AS output_addresses, o.om AS output_amounts,
         o.total_output
  FROM tx LEFT JOIN (SELECT txid, list(address ORDER BY idx) AS ia, list(amount ORDER BY idx) AS am FROM tin GROUP BY 1) i USING (txid)
  LEFT JOIN (SELECT txid, list(address ORDER BY idx, address) AS oa, list(amount ORDER BY idx, address) AS om, sum(amount) AS total_output FROM tout GROUP BY 1) o USING (txid)""")


def transactions(fx):
    """One row per transaction with parallel arrays."""
    def build():
        def side(df, name):
            s = F.array_sort(F.collect_list(F.struct("idx", "address", "amount")))
            return (df.groupBy("txid").agg(s.alias("s"), F.sum("amount").alias("t"))
                    .select("txid", F.col("s.address").alias(f"{name}_addresses"), F.col("s.amount").alias(f"{name}_amounts"),
                            F.col("t").alias(f"total_{name}")))
        return (fx.tx_a.withColumnRenamed("ts", "timestamp").join(side(fx.tin_a, "input"), "txid", "left")
                .join(side(fx.tout_a, "output"), "txid", "left"))
    return fx._stage("a-transactions", build)


@query("lg1_explode_ledger", with_ctes(["tin", "tout"], f"""
    SELECT 'input' AS side, txid, address, count(*) AS n, {r('sum(amount)', 8)} AS amount FROM tin GROUP BY 1, 2, 3
    UNION ALL SELECT 'output', txid, address, count(*), {r('sum(amount)', 8)} FROM tout GROUP BY 1, 2, 3"""))
def lg1(fx):
    """Parallel arrays exploded to input and output rows."""
    t = transactions(fx)
    both = (L.explode_ledger(t, "input").withColumn("side", F.lit("input"))
            .unionByName(L.explode_ledger(t, "output").withColumn("side", F.lit("output"))))
    return both.groupBy("side", "txid", "address").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("amount"), 8).alias("amount"))


@query("lg2_first_spy", with_ctes(["spy"], f"""
    SELECT txid, spy_ip, CAST(spy_port AS INT) AS spy_port, spy_country, spy_asn, spy_asn_type, n_obs, {r('spy_delta')} AS spy_delta FROM spy"""))
def lg2(fx):
    return L.first_spy(fx.obs).withColumn("spy_delta", r6("spy_delta"))


@query("lg3_spy_confidence", with_ctes(["spy"], f"""
    SELECT txid, {r('1 - exp(-coalesce(spy_delta, 0.3) / 1.5)')} AS feature, {r('1 - exp(-spy_delta / 1.5)')} AS evidence FROM spy"""))
def lg3(fx):
    gap = F.col("spy_delta")
    return fx.spy.select("txid", r6(spy_confidence(F.coalesce(gap, F.lit(0.3)))).alias("feature"),
                         r6(spy_confidence(gap)).alias("evidence"))


@query("lg4_wallet_ip", with_ctes(["tin", "spy"], """
    SELECT address, spy_ip, count(*) AS tx_count, min(spy_country) AS country, min(spy_asn) AS asn, min(spy_asn_type) AS asn_type
    FROM (SELECT DISTINCT txid, address FROM tin) JOIN spy USING (txid) GROUP BY 1, 2"""))
def lg4(fx):
    return L.wallet_ips(fx.tin_a, fx.spy)


# -- transaction features --------------------------------------------------------------------------
cte("shape", ("tx", "tin", "tout"), """
  SELECT tx.txid, tx.ts, tx.fee, tx.script_type, coalesce(i.n_in, 0) AS n_in, coalesce(o.n_out, 0) AS n_out,
         coalesce(total_out, 0) AS total_out, mn, mx, coalesce(dust, 0) AS dust_outputs, coalesce(rshare, 0) AS round_output_share,
         coalesce(eq, 0) AS max_equal_outputs, ent,
         coalesce(mn / nullif(total_out, 0), 1) AS min_out_share,
         CASE WHEN coalesce(i.n_in, 0) <= 2 AND o.n_out = 2 AND coalesce(mn / nullif(total_out, 0), 1) < 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS peel_shape
  FROM tx LEFT JOIN (SELECT txid, count(*) AS n_in FROM tin GROUP BY 1) i USING (txid)
  LEFT JOIN (SELECT txid, count(*) AS n_out, sum(amount) AS total_out, min(amount) AS mn, max(amount) AS mx,
                    count(*) FILTER (amount < 1e-5) AS dust,
                    avg(CASE WHEN abs(amount * 1e4 - round(amount * 1e4)) < 1e-6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rshare FROM tout GROUP BY 1) o USING (txid)
  LEFT JOIN (SELECT txid, max(c) AS eq FROM (SELECT txid, CAST(round(amount * 1e8) AS BIGINT) AS k, count(*) AS c FROM tout GROUP BY 1, 2) GROUP BY 1) e USING (txid)
  LEFT JOIN (SELECT txid, sum(-p * log2(p)) AS ent FROM (SELECT txid, amount / sum(amount) OVER (PARTITION BY txid) AS p FROM tout WHERE amount > 0) GROUP BY 1) h USING (txid)""")


@query("tx1_counts", with_ctes(["shape"], f"""
    SELECT txid, n_in, n_out, {r('total_out', 8)} AS total_out, {r('ln(1 + total_out)')} AS log_total_out,
           CASE WHEN n_in = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_coinbase FROM shape"""))
def tx1(fx):
    return T.tx_shape(fx.a).select("txid", "n_in", "n_out", r6("total_out", 8).alias("total_out"),
                                   r6("log_total_out").alias("log_total_out"), "is_coinbase")


@query("tx2_fee_rate", with_ctes(["shape"], f"""
    SELECT txid, {r('coalesce(fee, 0) * 1e8 / (11 + 68 * greatest(n_in, 1) + 31 * n_out)')} AS fee_rate FROM shape"""))
def tx2(fx):
    return T.tx_shape(fx.a).select("txid", r6("fee_rate").alias("fee_rate"))


@query("tx3_equal_outputs", with_ctes(["mtx", "mtin", "mtout"], f"""
    SELECT txid, max(c) AS max_equal_outputs, {r('CASE WHEN sum(c) > 1 THEN max(c) / sum(c) ELSE 0 END')} AS equal_output_share
    FROM (SELECT txid, CAST(round(amount * 1e8) AS BIGINT) AS k, count(*) AS c FROM mtout GROUP BY 1, 2) GROUP BY 1"""))
def tx3(fx):
    return T.output_shape(fx.m.tout).select("txid", "max_equal_outputs", r6("equal_output_share").alias("equal_output_share"))


@query("tx4_output_entropy", with_ctes(["shape"], f"""
    SELECT txid, {r('CASE WHEN n_out > 1 THEN coalesce(ent / log2(n_out), 0) ELSE 0 END')} AS output_entropy FROM shape"""))
def tx4(fx):
    return T.tx_shape(fx.a).select("txid", r6("output_entropy").alias("output_entropy"))


@query("tx5_out_shape", with_ctes(["shape"], f"""
    SELECT txid, {r('min_out_share')} AS min_out_share, {r('coalesce(log10(mx / greatest(mn, 1e-8)), 0)')} AS log_max_min_ratio FROM shape"""))
def tx5(fx):
    return T.tx_shape(fx.a).select("txid", r6("min_out_share").alias("min_out_share"), r6("log_max_min_ratio").alias("log_max_min_ratio"))


@query("tx6_dust_round", with_ctes(["shape"], f"""
    SELECT txid, dust_outputs, {r('round_output_share')} AS round_output_share FROM shape"""))
def tx6(fx):
    return T.tx_shape(fx.a).select("txid", "dust_outputs", r6("round_output_share").alias("round_output_share"))


@query("tx7_hour_script", with_ctes(["shape"], """
    SELECT txid, hour(ts) AS hour_utc, CAST(script_type = 'P2WSH' AS DOUBLE) AS "script_P2WSH", CAST(script_type = 'P2TR' AS DOUBLE) AS "script_P2TR",
           CAST(script_type = 'P2PKH' AS DOUBLE) AS "script_P2PKH", CAST(script_type = 'P2SH' AS DOUBLE) AS "script_P2SH" FROM shape"""))
def tx7(fx):
    return T.tx_shape(fx.a).select("txid", "hour_utc", "script_P2WSH", "script_P2TR", "script_P2PKH", "script_P2SH")


# DuckDB's own as-of join, over receipts and spends reduced to one row per address and instant
cte("spent", ("tin", "tout"), """
  SELECT o.*, s.ts AS spend_ts, s.txid AS spend_txid, (epoch_us(s.ts) - epoch_us(o.ts)) / 60e6 AS respend_min
  FROM tout o ASOF LEFT JOIN (SELECT address, ts, min(txid) AS txid FROM tin GROUP BY 1, 2) s ON s.address = o.address AND o.ts < s.ts""")
cte("timing", ("spent",), """
  SELECT txid, least(coalesce(min(respend_min), 1e5), 1e5) AS min_respend_min,
         avg(CASE WHEN respend_min < 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share_spent_1h FROM spent GROUP BY 1""")
cte("aged", ("tin", "tout"), """
  SELECT i.*, (epoch_us(i.ts) - epoch_us(c.ts)) / 3600e6 AS age_h
  FROM tin i ASOF LEFT JOIN (SELECT DISTINCT address, ts FROM tout) c ON c.address = i.address AND i.ts > c.ts""")
cte("bspent", ("btin", "btout"), """
  SELECT o.*, s.txid AS spend_txid, (epoch_us(s.ts) - epoch_us(o.ts)) / 60e6 AS respend_min
  FROM btout o ASOF LEFT JOIN (SELECT address, ts, min(txid) AS txid FROM btin GROUP BY 1, 2) s ON s.address = o.address AND o.ts < s.ts""")


@query("tx8_asof_spend", with_ctes(["timing"], f"""
    SELECT txid, {r('min_respend_min')} AS min_respend_min, {r('share_spent_1h')} AS share_spent_1h FROM timing"""))
def tx8(fx):
    return T.spend_timing(T.spent_outputs(fx.a)).select("txid", r6("min_respend_min").alias("min_respend_min"),
                                                        r6("share_spent_1h").alias("share_spent_1h"))


@query("tx8_asof_spend_chains", with_ctes(["bspent"], f"""
    SELECT txid, {r('least(coalesce(min(respend_min), 1e5), 1e5)', 8)} AS min_respend_min,
           {r('avg(CASE WHEN respend_min < 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS share_spent_1h FROM bspent GROUP BY 1"""))
def tx8b(fx):
    return T.spend_timing(T.spent_outputs(fx.b)).select("txid", r6("min_respend_min", 8).alias("min_respend_min"),
                                                        r6("share_spent_1h").alias("share_spent_1h"))


@query("tx9_asof_created", with_ctes(["aged"], f"""
    SELECT txid, {r('coalesce(avg(age_h), -1)')} AS mean_input_age_h FROM aged GROUP BY 1"""))
def tx9(fx):
    return T.input_age(T.created_inputs(fx.a)).select("txid", r6("mean_input_age_h").alias("mean_input_age_h"))


@query("tx10_peel_shape", with_ctes(["shape"], "SELECT txid, peel_shape FROM shape"))
def tx10(fx):
    return T.tx_shape(fx.a).select("txid", "peel_shape")


cte("bshape", ("btin", "btout"), """
  SELECT o.txid, i.n_in, o.n_out, CASE WHEN n_in <= 2 AND n_out = 2 AND mn / s < 0.1 THEN 1 ELSE 0 END AS peel
  FROM (SELECT txid, count(*) AS n_out, min(amount) AS mn, sum(amount) AS s FROM btout GROUP BY 1) o
  JOIN (SELECT txid, count(*) AS n_in FROM btin GROUP BY 1) i USING (txid)""")
cte("blink", ("bshape", "bspent"), """
  SELECT b.txid AS a, b.spend_txid AS b FROM (
     SELECT txid, spend_txid, row_number() OVER (PARTITION BY txid ORDER BY amount DESC, idx) AS k FROM bspent) b
  JOIN bshape p ON p.txid = b.txid AND p.peel = 1 JOIN bshape q ON q.txid = b.spend_txid AND q.peel = 1 WHERE b.k = 1""")


@query("tx11_peel_chains", with_ctes(["blink"], """
    SELECT c.txid, CAST(z.n AS DOUBLE) AS peel_chain_len, substr(CAST(c.root AS VARCHAR), 1, 12) AS peel_chain_id
    FROM comp c JOIN (SELECT root, count(*) AS n FROM comp GROUP BY 1) z USING (root)""", recursive=True, extra="""
    sym AS MATERIALIZED (SELECT a, b FROM blink UNION SELECT b, a FROM blink),
    reach(txid, seen) AS (SELECT txid, txid FROM bshape WHERE peel = 1 UNION SELECT r.txid, s.b FROM reach r JOIN sym s ON s.a = r.seen),
    comp AS MATERIALIZED (SELECT txid, min(seen) AS root FROM reach GROUP BY 1)"""))
def tx11(fx):
    shape = T.tx_shape(fx.b)
    return T.peel_chains(shape, T.spent_outputs(fx.b)).drop("root")


RETURNS_SQL = """
  sp AS MATERIALIZED (SELECT * FROM (SELECT address, txid AS nxt, row_number() OVER (PARTITION BY address ORDER BY txid, idx) AS k FROM {tin}) WHERE k <= 5),
  origin AS MATERIALIZED (SELECT txid AS origin FROM (SELECT txid, count(*) n FROM {tin} GROUP BY 1) JOIN (SELECT txid, count(*) m FROM {tout} GROUP BY 1) USING (txid)
             WHERE n BETWEEN 1 AND 2 AND m <= 2),
  one AS MATERIALIZED (SELECT * FROM (SELECT origin, nxt AS at_tx, o.idx AS i1, k AS k1, row_number() OVER (PARTITION BY origin ORDER BY o.idx, k) AS rn
          FROM origin JOIN {tout} o ON o.txid = origin JOIN sp ON sp.address = o.address) WHERE rn <= 50),
  two AS MATERIALIZED (SELECT * FROM (SELECT origin, nxt AS at_tx, row_number() OVER (PARTITION BY origin ORDER BY i1, k1, o.idx, k) AS rn
          FROM one JOIN {tout} o ON o.txid = at_tx JOIN sp ON sp.address = o.address) WHERE rn <= 50),
  hit AS MATERIALIZED (SELECT DISTINCT f.origin FROM (SELECT origin, at_tx FROM one UNION ALL SELECT origin, at_tx FROM two) f
          JOIN {tout} o ON o.txid = f.at_tx JOIN {tin} i ON i.txid = f.origin AND i.address = o.address WHERE f.at_tx <> f.origin)"""


@query("tx12_returns_to_input", with_ctes(["tin", "tout"], """
    SELECT origin AS txid, CASE WHEN hit.origin IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS returns_to_input
    FROM origin LEFT JOIN hit USING (origin)""", extra=RETURNS_SQL.format(tin="tin", tout="tout")))
def tx12(fx):
    return T.returns_to_input(fx.a, T.tx_shape(fx.a))


@query("tx13_network", with_ctes(["tx", "spy"], f"""
    SELECT tx.txid, CAST(coalesce(spy_asn_type IN ('TOR_EXIT','VPN','BULLETPROOF'), false) AS DOUBLE) AS spy_risky_asn,
           CAST(coalesce(spy_asn_type = 'TOR_EXIT', false) AS DOUBLE) AS spy_tor, CAST(coalesce(spy_asn_type = 'DATACENTER', false) AS DOUBLE) AS spy_datacenter,
           CAST(coalesce(spy_asn_type = 'RESIDENTIAL', false) AS DOUBLE) AS spy_residential,
           {r('1 - exp(-coalesce(spy_delta, 0.3) / 1.5)')} AS spy_confidence, coalesce(n_obs, 0) AS n_obs,
           CAST(coalesce(spy_port <> 8333, true) AS DOUBLE) AS spy_nonstd_port FROM tx LEFT JOIN spy USING (txid)"""))
def tx13(fx):
    return T.tx_network(fx.tx_a, fx.spy).withColumn("spy_confidence", r6("spy_confidence"))


@query("en5_tx_fingerprint", with_ctes(["fp"], "SELECT txid, software FROM fp"))
def en5(fx):
    return fx.tx_a.select("txid", software_fingerprint(F.col("tx_version"), F.col("locktime"), F.col("rbf")).alias("software"))


@query("flagship_wallet_profile", with_ctes(["timing"], f"""
    SELECT address, n_recv, n_spend, {r('recv_btc', 8)} AS recv_btc, {r('sent_btc', 8)} AS sent_btc, {r('recv_btc - sent_btc', 8)} AS balance,
           {r('best')} AS min_respend_min FROM (
      SELECT address, sum(rn) AS n_recv, sum(sn) AS n_spend, sum(rb) AS recv_btc, sum(sb) AS sent_btc, coalesce(min(best), 1e5) AS best FROM (
        SELECT address, CAST(count(DISTINCT txid) AS BIGINT) AS rn, CAST(0 AS BIGINT) AS sn, sum(amount) AS rb, 0.0::DOUBLE AS sb, min(min_respend_min) AS best
        FROM tout JOIN timing USING (txid) GROUP BY 1
        UNION ALL SELECT address, 0, count(DISTINCT txid), 0, sum(amount), NULL FROM tin GROUP BY 1) GROUP BY 1)
    ORDER BY recv_btc DESC, address LIMIT 20""").replace("sum(rn)", "CAST(sum(rn) AS BIGINT)").replace("sum(sn)", "CAST(sum(sn) AS BIGINT)"))
def flagship(fx):
    """Profile of the twenty wallets that received most: totals, balance and the fastest onward spend of a funding transaction."""
    totals = wallet_totals(fx.a)
    best = (fx.tout_a.select("txid", "address").distinct().join(T.spend_timing(T.spent_outputs(fx.a)), "txid")
            .groupBy("address").agg(F.min("min_respend_min").alias("min_respend_min")))
    return (totals.join(best, "address", "left").orderBy(F.desc("recv_btc"), "address").limit(20)
            .select("address", "n_recv", "n_spend", r6("recv_btc", 8).alias("recv_btc"), r6("sent_btc", 8).alias("sent_btc"),
                    r6(F.col("recv_btc") - F.col("sent_btc"), 8).alias("balance"),
                    r6(F.coalesce("min_respend_min", F.lit(1e5))).alias("min_respend_min")))
