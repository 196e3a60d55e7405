"""Queries for the wallet features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import wallet_features as Wf
from tracewell.plans import derived as D
from tracewell.plans.oracle import cte, r, with_ctes
from tracewell.plans.queries_ledger import RETURNS_SQL, r6
from tracewell.plans.registry import query

cte("wtot", ("tin", "tout"), """
  SELECT coalesce(a.address, b.address) AS address, coalesce(n_recv, 0) AS n_recv, coalesce(recv_btc, 0) AS recv_btc, first_recv, last_recv,
         coalesce(n_spend, 0) AS n_spend, coalesce(sent_btc, 0) AS sent_btc, first_spend, last_spend
  FROM (SELECT address, count(DISTINCT txid) AS n_recv, sum(amount) AS recv_btc, min(ts) AS first_recv, max(ts) AS last_recv FROM tout GROUP BY 1) a
  FULL JOIN (SELECT address, count(DISTINCT txid) AS n_spend, sum(amount) AS sent_btc, min(ts) AS first_spend, max(ts) AS last_spend FROM tin GROUP BY 1) b
  ON a.address = b.address""")
cte("din", ("tin",), "SELECT txid, address, min(ts) AS ts FROM tin GROUP BY 1, 2")
cte("dout", ("tout",), "SELECT DISTINCT txid, address FROM tout")


@query("wa1_wallet_totals", with_ctes(["wtot"], f"""
    SELECT address, n_recv, {r('recv_btc', 8)} AS recv_btc, n_spend, {r('sent_btc', 8)} AS sent_btc,
           coalesce(epoch_us(first_recv), -1) AS first_recv_us, coalesce(epoch_us(last_recv), -1) AS last_recv_us, coalesce(epoch_us(first_spend), -1) AS first_spend_us, coalesce(epoch_us(last_spend), -1) AS last_spend_us FROM wtot"""))
def wa1(fx):
    w = Wf.wallet_totals(fx.a)
    return w.select("address", "n_recv", r6("recv_btc", 8).alias("recv_btc"), "n_spend", r6("sent_btc", 8).alias("sent_btc"),
                    *[F.coalesce(F.unix_micros(c), F.lit(-1)).alias(f"{c}_us") for c in ("first_recv", "last_recv", "first_spend", "last_spend")])


@query("wa2_wallet_times", with_ctes(["wtot"], f"""
    SELECT address, {r('(epoch_us(greatest(coalesce(last_recv, last_spend), coalesce(last_spend, last_recv))) - epoch_us(least(coalesce(first_recv, first_spend), coalesce(first_spend, first_recv)))) / 3600e6', 8)} AS lifetime_h,
           {r('coalesce((epoch_us(first_spend) - epoch_us(first_recv)) / 3600e6, -1)', 8)} AS hold_h,
           {r('ln(1 + recv_btc)')} AS log_recv_btc, {r('ln(1 + sent_btc)')} AS log_sent_btc, CAST(n_recv > 1 AS DOUBLE) AS reused FROM wtot"""))
def wa2(fx):
    w = Wf.with_times(Wf.wallet_totals(fx.a))
    return w.select("address", r6("lifetime_h", 8).alias("lifetime_h"), r6("hold_h", 8).alias("hold_h"),
                    r6("log_recv_btc").alias("log_recv_btc"), r6("log_sent_btc").alias("log_sent_btc"), "reused")


@query("wa3_wallet_tx_shape", with_ctes(["shape", "timing", "din", "dout"], f"""
    SELECT address, coalesce(max(n_out) FILTER (spend), 0) AS spend_max_n_out, coalesce(max(n_in) FILTER (NOT spend), 0) AS fund_max_n_in,
           coalesce(max(n_out) FILTER (NOT spend), 0) AS fund_n_out, {r('coalesce(min(min_respend_min) FILTER (NOT spend), 1e5)')} AS min_respend_min,
           {r('max(CASE WHEN n_out > 1 THEN max_equal_outputs / n_out ELSE 0 END)')} AS max_equal_output_share,
           CAST(max(dust_outputs) AS DOUBLE) AS max_dust_outputs, max(peel_shape) AS max_peel_shape, max(coalesce(ret, 0.0::DOUBLE)) AS max_returns_to_input
    FROM (SELECT txid, address, true AS spend FROM din UNION ALL SELECT txid, address, false FROM dout)
    JOIN shape USING (txid) LEFT JOIN timing USING (txid) LEFT JOIN (SELECT origin AS txid, 1.0::DOUBLE AS ret FROM hit) USING (txid) GROUP BY 1""",
    extra=RETURNS_SQL.format(tin="tin", tout="tout")))
def wa3(fx):
    w = Wf.wallet_tx_shape(fx.a, D.x(fx))
    return w.select("address", "spend_max_n_out", "fund_max_n_in", "fund_n_out", r6("min_respend_min").alias("min_respend_min"),
                    r6("max_equal_output_share").alias("max_equal_output_share"), "max_dust_outputs", "max_peel_shape", "max_returns_to_input")


@query("wa4_wallet_network", with_ctes(["din", "spy"], f"""
    SELECT address, count(DISTINCT spy_ip) AS n_spend_ips, count(DISTINCT spy_country) AS n_spend_countries,
           {r("avg(CASE WHEN spy_asn_type IN ('TOR_EXIT','VPN','BULLETPROOF') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS share_risky_asn,
           {r("avg(CASE WHEN spy_asn_type = 'DATACENTER' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS share_datacenter,
           {r('1 - exp(-coalesce(avg(spy_delta), 0.3) / 1.5)')} AS mean_spy_confidence
    FROM din LEFT JOIN spy USING (txid) GROUP BY 1"""))
def wa4(fx):
    w = Wf.wallet_network(Wf.spends_with_relay(fx.a))
    return w.select("address", "n_spend_ips", "n_spend_countries", *[r6(c).alias(c) for c in ("share_risky_asn", "share_datacenter", "mean_spy_confidence")])


cte("moves", ("din", "spy", "place"), """
  SELECT *, 12742 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))) AS km,
         greatest(epoch_us(ts) - epoch_us(pts), 60000000) / 3600e6 AS hours
  FROM (SELECT d.address, d.txid, d.ts, spy_ip, country, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(d.ts) OVER w AS pts, lag(country) OVER w AS pcountry, lag(spy_ip) OVER w AS pip
        FROM din d JOIN spy USING (txid) JOIN place ON place.country = spy.spy_country WINDOW w AS (PARTITION BY d.address ORDER BY d.ts, d.txid))
  WHERE plat IS NOT NULL""")


@query("wa5_geo_velocity", with_ctes(["moves"], f"""
    SELECT address, {r('least(max(km / hours), 20000)', 3)} AS max_geo_velocity_kmh FROM moves GROUP BY 1"""))
def wa5(fx):
    return Wf.geo_velocity(Wf.spends_with_relay(fx.a), fx.centroids).withColumn("max_geo_velocity_kmh", r6("max_geo_velocity_kmh", 3))


cte("deg", ("tin", "tout"), "SELECT address, count(DISTINCT txid) AS degree FROM (SELECT txid, address FROM tin UNION ALL SELECT txid, address FROM tout) GROUP BY 1")


@query("wa6_address_degree", with_ctes(["deg"], "SELECT address, degree FROM deg"))
def wa6(fx):
    return Wf.address_degree(fx.a)


# adapter A never has more than two inputs, so the sweep threshold is 2 here and a parameter in the library
cte("swept", ("tin", "shape"), "SELECT DISTINCT address FROM tin JOIN shape USING (txid) WHERE n_in >= 2")
cte("ctxtx", ("shape", "tin", "tout", "deg", "swept"), """
  SELECT s.txid, s.n_in, s.n_out, CASE WHEN s.n_out > 1 THEN coalesce(sd / nullif(mean, 0), 0) ELSE 0 END AS out_cv, coalesce(below, 0) AS below_round_share,
         coalesce(in_hub, 0) AS in_hub, coalesce(oc, 0) AS out_consolidated_share, coalesce(n_funders, 0) AS n_funders
  FROM shape s
  LEFT JOIN (SELECT txid, stddev_pop(amount) AS sd, avg(amount) AS mean, avg(CASE WHEN amount > 0 AND amount / pow(10.0::DOUBLE, ceil(log10(amount))) >= 0.9
               AND amount / pow(10.0::DOUBLE, ceil(log10(amount))) < 1.0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS below FROM tout GROUP BY 1) o USING (txid)
  LEFT JOIN (SELECT txid, avg(CASE WHEN w.address IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS oc FROM tout LEFT JOIN swept w USING (address) GROUP BY 1) c USING (txid)
  LEFT JOIN (SELECT txid, max(ln(1 + degree)) AS in_hub, count(DISTINCT address) AS n_funders FROM tin JOIN deg USING (address) GROUP BY 1) f USING (txid)""")
cte("parents", ("tout", "tin", "ctxtx"), """
  SELECT l.txid, max(c.n_in) AS parent_max_n_in, max(c.in_hub) AS parent_in_hub
  FROM (SELECT DISTINCT i.txid, p.parent FROM tin i JOIN (SELECT address, arg_min(txid, (txid, idx)) AS parent FROM tout GROUP BY 1) p USING (address) WHERE parent <> i.txid) l
  JOIN ctxtx c ON c.txid = l.parent GROUP BY 1""")


@query("wa7_ctx_tx", with_ctes(["ctxtx"], f"""
    SELECT txid, {r('out_cv')} AS out_cv, {r('below_round_share')} AS below_round_share, {r('in_hub')} AS in_hub,
           {r('out_consolidated_share')} AS out_consolidated_share, n_funders FROM ctxtx"""))
def wa7(fx):
    return D.ctx(fx).select("txid", *[r6(c).alias(c) for c in ("out_cv", "below_round_share", "in_hub", "out_consolidated_share")], "n_funders")


@query("wa8_swept_set", with_ctes(["swept"], "SELECT address FROM swept"))
def wa8(fx):
    return D.swept(fx)


@query("wa9_ctx_parent", with_ctes(["parents"], f"SELECT txid, parent_max_n_in, {r('parent_in_hub')} AS parent_in_hub FROM parents"))
def wa9(fx):
    return Wf.ctx_parent(fx.a, D.ctx(fx)).withColumn("parent_in_hub", r6("parent_in_hub"))


@query("wa10_ctx_wallet", with_ctes(["ctxtx", "parents", "swept", "din", "dout"], f"""
    SELECT address, {r('coalesce(avg(out_cv) FILTER (NOT spend), 0)')} AS fund_out_cv, {r('coalesce(max(below_round_share) FILTER (NOT spend), 0)')} AS fund_below_round,
           {r('coalesce(max(in_hub) FILTER (NOT spend), 0)')} AS fund_in_hub, {r('coalesce(ln(1 + max(coalesce(parent_max_n_in, 0)) FILTER (NOT spend)), 0)')} AS fund_parent_max_n_in,
           {r('coalesce(max(coalesce(parent_in_hub, 0)) FILTER (NOT spend), 0)')} AS fund_parent_in_hub, {r('coalesce(ln(1 + max(n_funders) FILTER (NOT spend)), 0)')} AS fund_log_n_funders,
           {r('coalesce(avg(out_consolidated_share) FILTER (spend), 0)')} AS spend_to_consolidated,
           max(CASE WHEN address IN (SELECT address FROM swept) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS is_consolidated
    FROM (SELECT txid, address, true AS spend FROM din UNION ALL SELECT txid, address, false FROM dout) JOIN ctxtx USING (txid) LEFT JOIN parents USING (txid) GROUP BY 1"""))
def wa10(fx):
    w = Wf.ctx_wallet(fx.a, D.ctx(fx), Wf.ctx_parent(fx.a, D.ctx(fx)), D.swept(fx))
    return w.select("address", *[r6(c).alias(c) for c in Wf.CONTEXT_COLUMNS])


cte("probs", ("shape",), """
  SELECT txid, ((txid * 7919) % 1000) / 1000.0 AS p_peel, ((txid * 104729) % 1000) / 1000.0 * 0.9 AS p_coinjoin, ((txid * 15485863) % 1000) / 1000.0 AS p_fan_out,
         ((txid * 32452843) % 1000) / 1000.0 AS p_fan_in, ((txid * 49979687) % 1000) / 1000.0 AS p_round_trip, ((txid * 86028121) % 1000) / 1000.0 AS p_normal FROM shape""")
cte("wmax", ("probs", "din", "dout"), """
  SELECT address, max(p_peel) AS max_p_peel, max(p_coinjoin) AS max_p_coinjoin, max(p_fan_out) AS max_p_fan_out, max(p_fan_in) AS max_p_fan_in,
         max(p_round_trip) AS max_p_round_trip FROM (SELECT txid, address FROM din UNION SELECT txid, address FROM dout) JOIN probs USING (txid) GROUP BY 1""")


@query("wa11_class_maxima", with_ctes(["wmax"], f"""
    SELECT address, {', '.join(f"{r('max_' + c)} AS max_{c}" for c in D.P_COLUMNS)} FROM wmax"""))
def wa11(fx):
    w = Wf.class_maxima(fx.a, D.probs(fx), D.P_COLUMNS)
    return w.select("address", *[r6(f"max_{c}").alias(f"max_{c}") for c in D.P_COLUMNS])


@query("wa12_cluster_aggregates", with_ctes(["wtot", "wmax", "din", "spy"], f"""
    SELECT address, {r('ln(1 + n)')} AS log_cluster_size, {r('mp')} AS cluster_max_p_peel, {r('mc')} AS cluster_max_p_coinjoin, {r('sr')} AS cluster_share_risky,
           CAST(nc AS BIGINT) AS cluster_n_countries, {r('ln(1 + sb)')} AS cluster_log_size_spend
    FROM (SELECT address, count(*) OVER c AS n, max(max_p_peel) OVER c AS mp, max(max_p_coinjoin) OVER c AS mc, avg(share) OVER c AS sr, least(sum(countries) OVER c, 50) AS nc, sum(sent_btc) OVER c AS sb
          FROM (SELECT t.address, m.max_p_peel, m.max_p_coinjoin, sent_btc, coalesce(share, 0) AS share, coalesce(countries, 0) AS countries, CAST(substr(t.address, 2) AS BIGINT) // 8 AS root
                FROM wtot t JOIN wmax m USING (address) LEFT JOIN (SELECT address, avg(CASE WHEN spy_asn_type IN ('TOR_EXIT','VPN','BULLETPROOF') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share,
                     count(DISTINCT spy_country) AS countries FROM din LEFT JOIN spy USING (txid) GROUP BY 1) USING (address))
          WINDOW c AS (PARTITION BY root))"""))
def wa12(fx):
    root = F.floor(F.substring("address", 2, 20).cast("long") / 8)
    w = (Wf.wallet_totals(fx.a).join(Wf.class_maxima(fx.a, D.probs(fx), D.P_COLUMNS), "address")
         .join(Wf.wallet_network(Wf.spends_with_relay(fx.a)), "address", "left").fillna(0, subset=["share_risky_asn", "n_spend_countries"])
         .withColumn("cluster_root", root)
         .withColumns({c: F.lit(0.0) for c in ("fund_parent_max_n_in", "fund_parent_in_hub", "fund_log_n_funders", "fund_in_hub", "fund_below_round")}))
    a = Wf.cluster_aggregates(w)
    return a.select("address", *[r6(c).alias(c) for c in ("log_cluster_size", "cluster_max_p_peel", "cluster_max_p_coinjoin", "cluster_share_risky")],
                    F.col("cluster_n_countries").cast("long").alias("cluster_n_countries"), r6("cluster_log_size_spend").alias("cluster_log_size_spend"))
