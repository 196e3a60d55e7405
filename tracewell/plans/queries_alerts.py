"""Queries for tracing, alerts, rules, forecasts, leads and the watchlist."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.config import Settings
from tracewell.functions.columns import is_risky
from tracewell.operators import alerts as A
from tracewell.operators import forecast as Fc
from tracewell.operators import graph as G
from tracewell.operators import leads as Le
from tracewell.operators import tracing as Tr
from tracewell.operators import wallet_features as Wf
from tracewell.operators import watch as Wa
from tracewell.plans import derived as D
from tracewell.plans import queries_graph as Qg
from tracewell.plans.oracle import cte, r, with_ctes
from tracewell.plans.queries_graph import DOWN, HUB, UP, _bfs_sql, _taint_sql
from tracewell.plans.queries_ledger import r6
from tracewell.plans.registry import query

# -- alert candidates ------------------------------------------------------------------------------
cte("alerts_all", ("scores",), """
  SELECT address, n, p, anomaly, typology, cluster_id, 'A-W-' || substr(sha1(address), 1, 10) AS alert_id, round(100 * p, 1) AS risk_score FROM (
    SELECT *, 'C-' || CAST(n // 8 AS VARCHAR) AS cluster_id, row_number() OVER (PARTITION BY n // 8 ORDER BY p DESC, address) AS k FROM scores WHERE p >= 0.4)
  WHERE k = 1""")
# the list that the case queries below work on: an explicit page of the whole list
cte("alerts", ("alerts_all",), "SELECT * FROM alerts_all ORDER BY p DESC, address LIMIT 300")
LISTED = Settings(max_alerts=300)


def scores(fx):
    e = F.floor(F.col("n") / 8).cast("string")
    return fx.scores.withColumn("cluster_root", e).withColumn("cluster_id", F.concat(F.lit("C-"), e))


def alerts(fx):
    def build():
        c = A.alert_candidates(scores(fx), LISTED)
        return c.select("address", "n", "p", "anomaly", "typology", "cluster_id", "cluster_root", A.alert_id(F.col("address")).alias("alert_id"), F.round(100 * F.col("p"), 1).alias("risk_score"))
    return fx._stage("al-alerts", build)


@query("al1_alert_candidates", with_ctes(["alerts_all"], "SELECT address, p, cluster_id, alert_id, risk_score FROM alerts_all"))
def al1(fx):
    c = A.alert_candidates(scores(fx))
    return c.select("address", "p", "cluster_id", A.alert_id(F.col("address")).alias("alert_id"), F.round(100 * F.col("p"), 1).alias("risk_score"))


cte("wrisk", ("din", "spy"), """
  SELECT address, avg(CASE WHEN spy_asn_type IN ('TOR_EXIT','VPN','BULLETPROOF') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share_risky_asn FROM din LEFT JOIN spy USING (txid) GROUP BY 1""")
PROP_SQL = _taint_sql(8, HUB) + "," + _bfs_sql(8, DOWN, HUB).replace("arcs AS", "arcs AS").replace("bfs AS", "down AS") + "," + (
    _bfs_sql(8, UP, HUB).replace("arcs", "uarcs").replace("bfs AS", "up AS").replace(" b0", " u0")
    .replace("FROM b", "FROM u").replace("\n  b", "\n  u"))
PROP_SQL += """,
  wallet AS MATERIALIZED (SELECT a.address, sent_btc, recv_btc, n_spend, n_recv, coalesce(share_risky_asn, 0) AS share_risky_asn, max_p_peel, max_p_coinjoin, max_p_fan_out,
      greatest(max_p_peel, max_p_coinjoin, max_p_fan_out, max_p_fan_in, max_p_round_trip) AS max_p_any, coalesce(v, 0) AS taint,
      least(coalesce(down.hops, 99), 20) AS hops_from_seed, least(coalesce(up.hops, 99), 20) AS hops_to_seed,
      epoch_us(greatest(coalesce(last_recv, last_spend), coalesce(last_spend, last_recv))) AS last_seen_us, epoch_us(last_recv) AS last_recv_us
    FROM wtot a JOIN wmax m USING (address) LEFT JOIN wrisk USING (address) LEFT JOIN t8 ON t8.node = a.address LEFT JOIN down ON down.node = a.address LEFT JOIN up ON up.node = a.address)"""
PROP_NEEDS = ["wtot", "wmax", "wrisk", "flow", "degree", "seeds"]


def wallet_table(fx):
    """What the risk fields and the rules need to know about every wallet."""
    def build():
        totals = Wf.wallet_totals(fx.sides)
        net = Wf.spends_with_relay(fx.a).groupBy("address").agg(F.avg(is_risky(F.col("spy_asn_type"))).alias("share_risky_asn"))
        mx = Wf.class_maxima(fx.sides, D.probs(fx), D.P_COLUMNS)
        node = F.col("node").alias("address")
        flow, degree = Qg.flow(fx), Qg.flow_degree(fx)
        out, into = Qg.flow_arcs(fx), G.passing_arcs(G.reverse(flow.select("src", "dst")), degree)
        hops = G.hop_features(G.bfs_hops(flow, fx.seeds, 8, HUB, degree=degree, arcs=[out]), G.bfs_hops(G.reverse(flow), fx.seeds, 8, HUB, degree=degree, arcs=[into]),
                              G.bfs_hops(flow, fx.seeds, 4, HUB, undirected=True, degree=degree, arcs=[out, into]), fx.addresses.select(F.col("address").alias("node")))
        w = (totals.join(net, "address", "left").join(mx, "address").join(Qg.taint(fx).select(node, "taint"), "address", "left")
             .join(hops.withColumnRenamed("node", "address"), "address", "left").fillna(0.0, subset=["share_risky_asn", "taint"]))
        return w.select("address", "sent_btc", "recv_btc", "n_spend", "n_recv", "share_risky_asn", *[f"max_{c}" for c in D.P_COLUMNS], F.greatest(*[f"max_{c}" for c in D.P_COLUMNS]).alias("max_p_any"),
                        "taint", "hops_from_seed", "hops_to_seed", "hops_any_seed", F.unix_micros(F.greatest("last_recv", "last_spend")).alias("last_seen_us"), F.unix_micros("last_recv").alias("last_recv_us"))
    return fx._stage("al-wallets", build)


@query("al2_severity_confidence", with_ctes([*PROP_NEEDS, "alerts", "spy", "din"], f"""
    SELECT address, risk_score, CASE WHEN risk_score >= 85 THEN 'CRITICAL' WHEN risk_score >= 65 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
           {r('least(greatest(0.5 * abs(2 * p - 1) + 0.3 * agree / 4 + 0.2 * complete / 3, 0), 1)', 3)} AS confidence FROM (
      SELECT a.address, p, risk_score, CAST((anomaly > 0.9) = (p >= 0.5) AS INT) + CAST((max_p_any > 0.5) = (p >= 0.5) AS INT) + CAST((taint > 0.05 OR hops_from_seed <= 3) = (p >= 0.5) AS INT)
               + CAST((share_risky_asn > 0) = (p >= 0.5) AS INT) AS agree,
             CAST(n_spend > 0 OR n_recv > 0 AS INT) + CAST(n_spend > 0 AS INT) + CAST(size > 1 AS INT) AS complete
      FROM alerts a JOIN wallet USING (address) JOIN (SELECT 'C-' || CAST(n // 8 AS VARCHAR) AS cluster_id, count(*) AS size FROM scores GROUP BY 1) USING (cluster_id))""", extra=PROP_SQL))
def al2(fx):
    size = scores(fx).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    w = alerts(fx).join(wallet_table(fx), "address").join(size, "cluster_id").withColumn("has_spy", F.col("n_spend") > 0).drop("risk_score")
    return A.risk_fields(w).select("address", "risk_score", "severity", "confidence")


@query("al3_alert_evidence", with_ctes(["alerts", "din", "dout", "probs", "spy", "tx"], f"""
    SELECT e.address, e.key AS txid, top_txids, s.spy_ip AS first_spy_ip, s.spy_asn_type AS first_spy_asn_type, {r('1 - exp(-s.spy_delta / 1.5)', 3)} AS first_spy_confidence FROM (
      SELECT address, min(txid) FILTER (k = 1) AS key, string_agg(CAST(txid AS VARCHAR), ',' ORDER BY k) AS top_txids FROM (
        SELECT m.address, m.txid, row_number() OVER (PARTITION BY m.address ORDER BY p_normal, ts, m.txid) AS k
        FROM (SELECT txid, address FROM din UNION SELECT txid, address FROM dout) m JOIN alerts USING (address) JOIN probs USING (txid) JOIN tx USING (txid)) WHERE k <= 8 GROUP BY 1) e
    LEFT JOIN spy s ON s.txid = e.key"""))
def al3(fx):
    e = A.alert_evidence(alerts(fx), fx.a, D.probs(fx))
    return e.withColumn("top_txids", F.array_join(F.transform("top_txids", lambda x: x.cast("string")), ","))


def contributions(fx):
    """Stand-in contributions of six features per alert, derived from the address number."""
    n = F.col("n")
    rows = [("anomaly", F.col("anomaly"), F.col("anomaly") - 0.3), ("taint", ((n * 31) % 100) / 100.0, ((n * 31) % 100) / 100.0 - 0.5),
            ("hops_from_seed", (n % 7).cast("double"), F.lit(0.1)), ("hold_h", (n % 5) - 1 + F.lit(0.25), (n % 4) * 0.05), ("not_described", F.lit(1.0), F.lit(0.9)),
            ("max_geo_velocity_kmh", (n * 13 % 20000).cast("double"), F.lit(0.07))]
    return alerts(fx).select("address", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), v.cast("double").alias("value"), i.cast("double").alias("impact")) for f, v, i in rows])).alias("c")).select("address", "c.*")


@query("al4_reasons", with_ctes(["alerts"], """
    SELECT address, CASE WHEN typology = '' THEN '' ELSE 'Behaviour most similar to ' || lower(replace(typology, '_', ' ')) || ' wallets (fused probability of illicit activity ' || CAST(CAST(round_even(p * 100, 0) AS BIGINT) AS VARCHAR) || '%)' END
           || coalesce('|' || r, '') AS reasons
    FROM alerts LEFT JOIN (SELECT address, string_agg(s, '|' ORDER BY k) AS r FROM (SELECT address, s, row_number() OVER (PARTITION BY address ORDER BY abs(impact) DESC, feature) AS k FROM (
      SELECT address, 'anomaly' AS feature, anomaly - 0.3 AS impact, 'Behaviour is more unusual than ' || CAST(CAST(round_even(anomaly * 100, 0) AS BIGINT) AS VARCHAR) || '% of wallets (Isolation Forest)' AS s FROM alerts
      UNION ALL SELECT address, 'taint', ((n * 31) % 100) / 100.0 - 0.5, CAST(CAST(round_even(((n * 31) % 100) / 100.0 * 100, 0) AS BIGINT) AS VARCHAR) || '% of incoming value traces back to a known illicit seed wallet' FROM alerts
      UNION ALL SELECT address, 'hops_from_seed', 0.1, 'Receives funds ' || CAST(n % 7 AS VARCHAR) || ' hop(s) downstream of a known illicit seed wallet' FROM alerts
      UNION ALL SELECT address, 'hold_h', (n % 4) * 0.05, CASE WHEN n % 5 = 0 THEN 'Funds never moved on' ELSE 'Funds held only ' || CAST(n % 5 - 1 AS VARCHAR) || '.2 h before being moved on' END FROM alerts
      UNION ALL SELECT address, 'max_geo_velocity_kmh', 0.07, 'Consecutive broadcasts imply ' || format('{:,}', n * 13 % 20000) || ' km/h travel (impossible for one person)' FROM alerts) WHERE impact > 0) WHERE k <= 4 GROUP BY 1) USING (address)"""))
def al4(fx):
    return A.reasons(alerts(fx), contributions(fx)).withColumn("reasons", F.array_join("reasons", "|"))


# -- tracing ---------------------------------------------------------------------------------------
def _trace_sql() -> str:
    parts = ["""
  sp AS MATERIALIZED (SELECT address, txid, epoch_us(ts) AS t, row_number() OVER (PARTITION BY address ORDER BY ts, txid, idx) AS k FROM tin),
  outk AS MATERIALIZED (SELECT o.txid, o.idx, o.address AS dest, o.amount, k.entity_name, k.entity_type, k.country, k.in_jurisdiction FROM tout o LEFT JOIN known k USING (address)),
  rec AS MATERIALIZED (SELECT DISTINCT address, epoch_us(ts) AS t FROM tout),
  c1 AS MATERIALIZED (SELECT s.address AS start, s.txid, s.t, r.t AS recv, 0 AS pa, 0 AS pb, s.k AS pc FROM (SELECT * FROM sp WHERE k <= 25 AND address IN (SELECT address FROM alerts)) s
     ASOF LEFT JOIN rec r ON r.address = s.address AND s.t >= r.t)"""]
    prior, used = "SELECT start AS s, txid AS x FROM c1 WHERE false", "SELECT start AS s, 0 AS n FROM c1 WHERE false"
    for h in range(1, 5):
        parts.append(f"""
  v{h} AS MATERIALIZED (SELECT * FROM (SELECT f.start, f.txid, f.t, f.recv, {h} AS hop, row_number() OVER (PARTITION BY f.start ORDER BY f.pa, f.pb, f.pc) AS rank
     FROM (SELECT *, row_number() OVER (PARTITION BY start, txid ORDER BY pa, pb, pc) AS d FROM c{h}) f WHERE d = 1 AND (f.start, f.txid) NOT IN ({prior})) q
     WHERE rank <= 600 - coalesce((SELECT sum(n) FROM ({used}) u WHERE u.s = q.start), 0))""")
        prior = (prior + " UNION ALL " if h > 1 else "") + f"SELECT start, txid FROM v{h}" if h > 1 else f"SELECT start, txid FROM v{h}"
        used = (used + " UNION ALL " if h > 1 else "") + f"SELECT start AS s, count(*) AS n FROM v{h} GROUP BY 1" if h > 1 else f"SELECT start AS s, count(*) AS n FROM v{h} GROUP BY 1"
        if h < 4:
            parts.append(f"""
  c{h+1} AS MATERIALIZED (SELECT v.start, s.txid, s.t, v.recv, v.rank AS pa, o.idx AS pb, s.k AS pc FROM v{h} v JOIN outk o ON o.txid = v.txid AND o.entity_type IS NULL
     JOIN sp s ON s.address = o.dest AND s.k <= 3 AND s.t >= v.t)""")
    parts.append("""
  visits AS MATERIALIZED (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3 UNION ALL SELECT * FROM v4),
  vault AS MATERIALIZED (SELECT o.txid, arg_max(o.address, (o.amount, -o.idx)) AS vault, max(o.amount) AS amount FROM tout o JOIN tx USING (txid) WHERE tx.op_return LIKE '=:%'
     AND (o.txid, o.address) NOT IN (SELECT txid, address FROM tin) GROUP BY 1),
  exits AS MATERIALIZED (
    SELECT v.start, v.txid, v.hop, entity_name AS vasp, entity_type, in_jurisdiction, dest AS deposit_address, round(amount, 8) AS amount_btc, v.t AS deposit_us,
           ((v.t - v.recv + 3000000) // 6000000) / 10.0 AS minutes_after_receipt FROM visits v JOIN outk o ON o.txid = v.txid WHERE entity_type IN ('VASP', 'SWAP', 'BRIDGE')
    UNION ALL
    SELECT v.start, v.txid, v.hop, 'ETH swap (memo)', 'SWAP', false, vault, round(coalesce(vault.amount, 0), 8), v.t, ((v.t - v.recv + 3000000) // 6000000) / 10.0
    FROM visits v JOIN tx USING (txid) LEFT JOIN vault USING (txid) WHERE op_return LIKE '=:%')""")
    return ",".join(parts)


TRACE_SQL = _trace_sql()
TRACE_NEEDS = ["tin", "tout", "tx", "known", "alerts"]


def exits(fx):
    return fx._stage("al-exits", lambda: Tr.trace_exits(fx.sides, alerts(fx), fx.known))


@query("gr9_trace_exits", with_ctes(TRACE_NEEDS, f"""
    SELECT start, txid, hop, vasp, entity_type, CAST(in_jurisdiction AS INT) AS in_jurisdiction, coalesce(deposit_address, '-') AS deposit_address, amount_btc, deposit_us,
           coalesce(minutes_after_receipt, -1) AS minutes_after_receipt FROM exits""", extra=TRACE_SQL))
def gr9(fx):
    e = exits(fx)
    return e.select("start", "txid", "hop", "vasp", "entity_type", F.col("in_jurisdiction").cast("int").alias("in_jurisdiction"), F.coalesce("deposit_address", F.lit("-")).alias("deposit_address"),
                    "amount_btc", "deposit_us", F.coalesce("minutes_after_receipt", F.lit(-1.0)).alias("minutes_after_receipt"))


FOLLOW_HOPS = 60


def _follow_sql() -> str:
    parts = ["""
  big AS MATERIALIZED (SELECT txid, any_value(ts) AS ts, arg_max(address, (amount, -idx)) AS address, max(amount) AS change_amount, count(*) AS n_out, sum(amount) - max(amount) AS peeled FROM tout GROUP BY 1),
  nxt AS MATERIALIZED (SELECT b.*, s.txid AS next_txid, k.entity_name AS change_exchange FROM big b ASOF LEFT JOIN (SELECT address, ts, min(txid) AS txid FROM tin GROUP BY 1, 2) s
      ON s.address = b.address AND b.ts <= s.ts LEFT JOIN known k ON k.address = b.address),
  h0 AS MATERIALIZED (SELECT a.address AS start, 0 AS hop, arg_min(i.txid, (i.ts, i.txid, i.idx)) AS at_tx, 0.0::DOUBLE AS peeled_total, []::BIGINT[] AS seen FROM alerts a LEFT JOIN tin i USING (address) GROUP BY 1)"""]
    for i in range(1, FOLLOW_HOPS + 1):
        live = "at_tx IS NOT NULL" if i == 1 else "n_out < 5 AND change_exchange IS NULL AND at_tx IS NOT NULL"
        parts.append(f"""
  h{i} AS MATERIALIZED (SELECT p.start, {i} AS hop, n.txid, n.n_out, n.address AS change_address, n.change_amount, p.peeled_total + n.peeled AS peeled_total, n.change_exchange, n.next_txid AS at_tx,
      list_append(p.seen, n.txid) AS seen FROM (SELECT * FROM h{i-1} WHERE {live}) p JOIN nxt n ON n.txid = p.at_tx WHERE NOT list_contains(p.seen, p.at_tx))""")
    cols = "start, hop, txid, n_out, change_address, change_amount, peeled_total, change_exchange, at_tx, seen"
    parts.append(f"""
  hops AS MATERIALIZED ({' UNION ALL '.join(f'SELECT {cols} FROM h{i}' for i in range(1, FOLLOW_HOPS + 1))}),
  ends AS MATERIALIZED (SELECT a.address AS start, coalesce(CASE WHEN h.start IS NULL THEN 'wallet never spends' WHEN h.n_out >= 5 THEN 'split into ' || CAST(h.n_out AS VARCHAR) || ' outputs' WHEN h.change_exchange IS NOT NULL THEN 'cashed out to ' || h.change_exchange
        WHEN h.hop = {FOLLOW_HOPS} THEN 'max hops reached' WHEN h.at_tx IS NULL THEN 'funds left unspent' WHEN list_contains(h.seen, h.at_tx) THEN 'loop' END, 'wallet never spends') AS stop,
        coalesce(h.hop, 0) AS hops, coalesce(h.peeled_total, 0) AS peeled_total FROM alerts a LEFT JOIN (SELECT * FROM hops QUALIFY row_number() OVER (PARTITION BY start ORDER BY hop DESC) = 1) h ON h.start = a.address)""")
    return ",".join(parts)


FOLLOW_SQL = _follow_sql()


def followed(fx):
    rows, ends = Tr.follow_money(fx.sides, alerts(fx), fx.known, FOLLOW_HOPS)
    return rows, ends


@query("gr10_follow_the_money", with_ctes(TRACE_NEEDS, f"""
    SELECT start, hop, txid, n_out, change_address, change_amount, {r('peeled_total', 8)} AS peeled_total, coalesce(change_exchange, '-') AS change_exchange FROM hops""", extra=FOLLOW_SQL))
def gr10(fx):
    rows, _ = followed(fx)
    return rows.select("start", "hop", "txid", "n_out", "change_address", "change_amount", r6("peeled_total", 8).alias("peeled_total"), F.coalesce("change_exchange", F.lit("-")).alias("change_exchange"))


@query("gr10_follow_summary", with_ctes(TRACE_NEEDS, f"SELECT start, stop, hops, {r('peeled_total', 8)} AS peeled_total FROM ends", extra=FOLLOW_SQL))
def gr10s(fx):
    _, ends = followed(fx)
    return ends.select("start", "stop", F.coalesce("hops", F.lit(0)).alias("hops"), r6(F.coalesce("peeled_total", F.lit(0.0)), 8).alias("peeled_total"))


NEAR_SQL = """
  touch AS MATERIALIZED (SELECT txid, address, ts FROM tin UNION ALL SELECT txid, address, ts FROM tout),
  centre AS MATERIALIZED (SELECT address FROM alerts ORDER BY risk_score DESC, address LIMIT 12),
  s1 AS MATERIALIZED (SELECT txid, min(ts) AS ts FROM touch WHERE address IN (SELECT address FROM centre) GROUP BY 1 ORDER BY 2, 1 LIMIT 120),
  w1 AS MATERIALIZED (SELECT DISTINCT address FROM touch WHERE txid IN (SELECT txid FROM s1)),
  s2 AS MATERIALIZED (SELECT txid, min(ts) AS ts FROM touch WHERE address IN (SELECT address FROM w1) AND txid NOT IN (SELECT txid FROM s1) GROUP BY 1 ORDER BY 2, 1 LIMIT (SELECT 120 - count(*) FROM s1)),
  near AS MATERIALIZED (SELECT txid FROM s1 UNION SELECT txid FROM s2)"""


@query("gr11_neighbourhood", with_ctes([*TRACE_NEEDS, "spy"], """
    SELECT source, target, type, round(amount, 8) AS amount FROM (
      SELECT 'ip_' || spy_ip AS source, 'tx_' || CAST(txid AS VARCHAR) AS target, 'RELAYED' AS type, 0 AS amount FROM spy JOIN near USING (txid)
      UNION ALL SELECT 'w_' || address, 'tx_' || CAST(txid AS VARCHAR), 'INPUT', amount FROM tin JOIN near USING (txid)
      UNION ALL SELECT 'tx_' || CAST(txid AS VARCHAR), 'w_' || address, 'OUTPUT', amount FROM tout JOIN near USING (txid))""", extra=NEAR_SQL))
def gr11(fx):
    centre = alerts(fx).orderBy(F.desc("risk_score"), "address").limit(12)
    txs, wallets = Tr.neighbourhood(fx.a, centre, 2, 120)
    meta = wallets.join(alerts(fx).select("address", "risk_score"), "address", "left").select("address", F.coalesce("risk_score", F.lit(0.0)).alias("risk"), F.lit(True).alias("keep"))
    _, edges = Tr.link_graph(fx.a, txs, fx.spy, meta)
    return edges.select("source", "target", "type", F.round(F.coalesce("amount", F.lit(0.0)), 8).alias("amount"))


# -- rules -----------------------------------------------------------------------------------------
RULE_SQL = PROP_SQL + "," + TRACE_SQL + """,
  now_ AS MATERIALIZED (SELECT max(epoch_us(ts)) AS now_us FROM tx),
  clsent AS MATERIALIZED (SELECT 'C-' || CAST(CAST(substr(address, 2) AS BIGINT) // 8 AS VARCHAR) AS cluster_id, sum(sent_btc) AS cluster_sent FROM wallet GROUP BY 1),
  ex AS MATERIALIZED (SELECT start,
      bool_or(entity_type = 'VASP' AND (coalesce(minutes_after_receipt <= 30, false) OR (now_us - deposit_us BETWEEN 0 AND 1800000000))) AS fresh,
      bool_or(entity_type = 'VASP' AND in_jurisdiction) AS local, bool_or(entity_type IN ('SWAP', 'BRIDGE')) AS exit,
      count(*) FILTER (entity_type = 'VASP') AS deposits, count(*) FILTER (entity_type IN ('SWAP', 'BRIDGE')) AS exit_count,
      count(*) FILTER (entity_type = 'VASP' AND in_jurisdiction) AS local_deposits, sum(amount_btc) FILTER (entity_type IN ('SWAP', 'BRIDGE')) AS exit_btc
      FROM exits, now_ WHERE start NOT IN (SELECT address FROM known) GROUP BY 1),
  pool AS MATERIALIZED (SELECT DISTINCT o.address FROM tout o JOIN tin i USING (txid) JOIN known k ON k.address = i.address AND k.entity_type = 'MINING_POOL'),
  ruled AS MATERIALIZED (SELECT a.address, a.alert_id, a.risk_score, a.typology, a.cluster_id, list_filter([
      CASE WHEN coalesce(fresh, false) AND a.risk_score >= 65 THEN 'IMMEDIATE_FREEZE_DRAFT' END, CASE WHEN coalesce(local, false) THEN 'DRAFT_SECTION_94_BNSS' END,
      CASE WHEN coalesce(exit, false) THEN 'CROSS_CHAIN_EXIT' END,
      CASE WHEN greatest(sent_btc, recv_btc, cluster_sent) >= 1 AND share_risky_asn > 0 AND greatest(max_p_peel, max_p_coinjoin, max_p_fan_out) > 0.5 THEN 'FIU_REFERRAL_PACK' END,
      CASE WHEN recv_btc - sent_btc > 1e-4 AND (now_us - last_seen_us) / 3600e6 >= 6 AND (taint > 0 OR least(hops_from_seed, hops_to_seed) <= 4) THEN 'PASSIVE_TAINT_MONITOR' END,
      CASE WHEN k.address IS NOT NULL OR (pool.address IS NOT NULL AND taint = 0 AND least(hops_from_seed, hops_to_seed) >= 20 AND share_risky_asn = 0) THEN 'REVIEW_LIKELY_BENIGN' END],
      lambda x: x IS NOT NULL) AS m, coalesce(deposits, 0) AS deposits, coalesce(exit_count, 0) AS exit_count, coalesce(local_deposits, 0) AS local_deposits, coalesce(exit_btc, 0) AS exit_btc,
      greatest(sent_btc, recv_btc, cluster_sent) AS moved, recv_btc - sent_btc AS balance, last_recv_us
    FROM alerts a JOIN wallet w USING (address) JOIN clsent USING (cluster_id) LEFT JOIN ex ON ex.start = a.address LEFT JOIN pool ON pool.address = a.address LEFT JOIN known k ON k.address = a.address, now_)"""
RULE_NEEDS = [*PROP_NEEDS, *TRACE_NEEDS]


def now_us(fx):
    """The latest data time in microseconds, as one number."""
    if not hasattr(fx, "_now_us"):
        fx._now_us = fx.tx_a.agg(F.max(F.unix_micros("ts"))).first()[0]
    return F.lit(fx._now_us)


def rule_wallets(fx):
    w = wallet_table(fx).join(scores(fx).select("address", "cluster_id"), "address")
    sent = w.groupBy("cluster_id").agg(F.sum("sent_btc").alias("cluster_sent_btc"))
    return w.join(sent, "cluster_id").withColumn("max_peel_chain_len", F.lit(0.0)).drop("cluster_id")


def ruled(fx):
    def build():
        mine = alerts(fx).select("address", "risk_score")
        funders = (fx.tout_a.join(mine.select("address"), "address", "left_semi").select("txid", "address").distinct()
                   .join(fx.tin_a.select("txid", F.col("address").alias("funder")), "txid").select("address", "funder").distinct())
        return A.decide_actions(mine, rule_wallets(fx), exits(fx), fx.known, funders, now_us(fx))
    return fx._stage("al-ruled", build)


@query("al5_action_rules", with_ctes(RULE_NEEDS, f"""
    SELECT address, coalesce(m[1], 'ANALYST_REVIEW') AS action, array_to_string(m[2:], ',') AS also_matched, deposits, exit_count, local_deposits, {r('exit_btc', 8)} AS btc_to_services,
           {r('moved', 8)} AS btc_moved FROM ruled""", extra=RULE_SQL))
def al5(fx):
    return ruled(fx).select("address", "action", F.array_join("also_matched", ",").alias("also_matched"), "deposits", "exit_count", "local_deposits",
                            "btc_to_services", r6("btc_moved", 8).alias("btc_moved"))


# -- forecast --------------------------------------------------------------------------------------
def _q(q: float) -> str:
    at = f"({q} * (len(dl) - 1))"
    return f"floor((dl[CAST(floor({at}) AS INT) + 1] + (dl[CAST(ceil({at}) AS INT) + 1] - dl[CAST(floor({at}) AS INT) + 1]) * ({at} - floor({at}))) * 10 + 0.5) / 10"


FORECAST_SQL = RULE_SQL + f""",
  fdep AS MATERIALIZED (SELECT start AS address, arg_min({{'v': vasp, 'd': minutes_after_receipt}}, (deposit_us, hop, CAST(txid AS VARCHAR), vasp, minutes_after_receipt)) AS d FROM exits WHERE entity_type = 'VASP' AND minutes_after_receipt IS NOT NULL GROUP BY 1),
  cash AS MATERIALIZED (SELECT alert_id, cluster_id AS cluster, typology, d.v AS vasp, d.d AS delay FROM ruled JOIN fdep USING (address)),
  samp AS MATERIALIZED (SELECT a.alert_id, list_sort(list(c.delay)) AS dl_all, list_sort(list(c.delay) FILTER (c.typology = a.typology)) AS dl_typ, list(c.vasp) AS v_all, list(c.vasp) FILTER (c.typology = a.typology) AS v_typ,
      bool_and(c.typology = a.typology) AS all_same FROM ruled a LEFT JOIN cash c ON c.cluster <> a.cluster_id GROUP BY 1),
  samp2 AS MATERIALIZED (SELECT alert_id, CASE WHEN coalesce(len(dl_typ), 0) >= 5 THEN dl_typ ELSE list_filter(dl_all, lambda x: x IS NOT NULL) END AS dl, CASE WHEN coalesce(len(dl_typ), 0) >= 5 THEN v_typ ELSE list_filter(v_all, lambda x: x IS NOT NULL) END AS vs,
      coalesce(len(dl_typ), 0) >= 5 OR all_same AS is_typ FROM samp),
  dest AS MATERIALIZED (SELECT a.alert_id, n.v AS vasp, (0.5 + coalesce(len(list_filter(s.vs, lambda x: x = n.v)), 0) + 3.0 * coalesce(o.k, 0)) AS sc
      FROM ruled a JOIN samp2 s USING (alert_id) JOIN (SELECT DISTINCT entity_name AS v FROM known WHERE entity_type = 'VASP' UNION SELECT vasp FROM cash) n ON true
      LEFT JOIN (SELECT x.alert_id, c.vasp, count(*) AS k FROM ruled x JOIN cash c ON c.cluster = x.cluster_id AND c.alert_id <> x.alert_id GROUP BY 1, 2) o ON o.alert_id = a.alert_id AND o.vasp = n.v),
  best AS MATERIALIZED (SELECT alert_id, arg_min(vasp, (-pr, vasp)) AS top_vasp, max(pr) AS top_p FROM (SELECT *, sc / sum(sc) OVER (PARTITION BY alert_id) AS pr FROM dest) GROUP BY 1),
  fq AS MATERIALIZED (SELECT alert_id, dl, is_typ, {', '.join(f"CASE WHEN len(dl) >= 3 THEN {_q(v)} END AS {k}" for k, v in Fc.QUANTILES.items())} FROM samp2),
  fc AS MATERIALIZED (SELECT a.alert_id, a.address, a.risk_score, CASE WHEN len(dl) < 3 THEN 'INSUFFICIENT_HISTORY' WHEN c.alert_id IS NOT NULL THEN 'CASHED_OUT' WHEN balance > 1e-4 THEN 'PENDING' ELSE 'NO_BALANCE' END AS status,
      CASE WHEN is_typ THEN 'typology' ELSE 'all_actors' END AS basis, len(dl) AS samples, p10, p25, p50, p75, p90, top_vasp, top_p, a.last_recv_us, now_us, c.vasp AS observed_vasp, c.delay AS observed_delay
      FROM ruled a JOIN fq USING (alert_id) JOIN best USING (alert_id) LEFT JOIN cash c USING (alert_id), now_)"""


def alert_rows(fx):
    w = wallet_table(fx).select("address", (F.col("recv_btc") - F.col("sent_btc")).alias("balance"), "last_recv_us")
    return alerts(fx).select("alert_id", "address", F.col("cluster_id").alias("cluster"), "typology", "risk_score").join(w, "address")


def cashouts(fx):
    return alert_rows(fx).select("alert_id", "address", "cluster", "typology").join(A.first_deposits(exits(fx)).select("address", "vasp", "delay"), "address")


def forecast_table(fx):
    return fx._stage("al-forecast", lambda: Fc.forecasts(alert_rows(fx), cashouts(fx), fx.known, now_us(fx)))


@query("al6_cashout_forecast", with_ctes(RULE_NEEDS, f"""
    SELECT alert_id, status, basis, CAST(samples AS INT) AS samples, p10, p25, p50, p75, p90, top_vasp, {r('top_p', 4)} AS top_probability,
           coalesce(CASE WHEN status = 'PENDING' AND last_recv_us IS NOT NULL THEN CASE WHEN now_us < last_recv_us + p25 * 60e6 THEN 'EXPECTED_LATER' WHEN now_us <= last_recv_us + p75 * 60e6 THEN 'IN_WINDOW' ELSE 'OVERDUE' END END, '-') AS window_state
    FROM fc""", extra=FORECAST_SQL))
def al6(fx):
    f = forecast_table(fx)
    return f.select("alert_id", "status", "basis", "samples", *Fc.QUANTILES, "top_vasp", "top_probability", F.coalesce("window_state", F.lit("-")).alias("window_state"))


@query("al7_interdiction_queue", with_ctes(RULE_NEEDS, """
    SELECT alert_id, risk_score, window_state FROM (SELECT alert_id, risk_score, CASE WHEN now_us < last_recv_us + p25 * 60e6 THEN 'EXPECTED_LATER' WHEN now_us <= last_recv_us + p75 * 60e6 THEN 'IN_WINDOW' ELSE 'OVERDUE' END AS window_state
    FROM fc WHERE status = 'PENDING' AND last_recv_us IS NOT NULL)""", extra=FORECAST_SQL))
def al7(fx):
    a = alerts(fx).withColumn("severity", A.severity(F.col("risk_score")))
    return Fc.interdiction_queue(forecast_table(fx), a).select("alert_id", "risk_score", "window_state")


@query("ev8_forecast_backtest", with_ctes(RULE_NEEDS, f"""
    SELECT count(*) AS cashed_out_alerts, {r('avg(CAST(observed_delay BETWEEN p25 AND p75 AS DOUBLE))')} AS delay_coverage_p25_p75, {r('avg(CAST(observed_delay BETWEEN p10 AND p90 AS DOUBLE))')} AS delay_coverage_p10_p90,
           {r('avg(abs(observed_delay - p50)) / 60')} AS delay_mae_hours, {r("avg(abs(observed_delay - (SELECT quantile_cont(observed_delay, 0.5) FROM fc WHERE status = 'CASHED_OUT'))) / 60")} AS delay_mae_hours_naive_global_median,
           {r('avg(CAST(top_vasp = observed_vasp AS DOUBLE))')} AS destination_top1 FROM fc WHERE status = 'CASHED_OUT'""", extra=FORECAST_SQL))
def ev8(fx):
    b = Fc.backtest(forecast_table(fx))
    return b.select("cashed_out_alerts", *[r6(c).alias(c) for c in ("delay_coverage_p25_p75", "delay_coverage_p10_p90", "delay_mae_hours", "delay_mae_hours_naive_global_median", "destination_top1")])


# -- same-operator leads ---------------------------------------------------------------------------
cte("opc", ("tin", "known"), """
  SELECT DISTINCT 'C-' || CAST(CAST(substr(address, 2) AS BIGINT) // 8 AS VARCHAR) AS cluster, txid FROM tin
  WHERE 'C-' || CAST(CAST(substr(address, 2) AS BIGINT) // 8 AS VARCHAR) NOT IN (SELECT 'C-' || CAST(CAST(substr(i.address, 2) AS BIGINT) // 8 AS VARCHAR) FROM tin i JOIN known USING (address))""")
cte("opd", ("opc", "tx", "fp", "spy", "shape"), """
  SELECT c.cluster, c.txid, n.n_tx, hour(tx.ts) AS hr, fp.software, tx.script_type AS script, ln(1 + coalesce(tx.fee, 0) * 1e8 / (11 + 68 * greatest(n_in, 1) + 31 * n_out)) AS fee, spy_ip AS ip
  FROM opc c JOIN (SELECT cluster, count(*) AS n_tx FROM opc GROUP BY 1 HAVING count(*) >= 3) n USING (cluster) JOIN tx USING (txid) JOIN fp USING (txid) JOIN shape USING (txid) LEFT JOIN spy USING (txid)""")
cte("opk", ("opd",), """
  SELECT cluster, signal, cat, sqrt(k / sum(k) OVER (PARTITION BY cluster, signal)) * sqrt(ln((nn + 1) / (count(*) OVER (PARTITION BY signal, cat) + 1)) + 1e-9) / sqrt(ln(nn + 1)) AS v
  FROM (SELECT cluster, signal, cat, count(*) AS k FROM (SELECT cluster, 'software' AS signal, software AS cat FROM opd UNION ALL SELECT cluster, 'script', script FROM opd UNION ALL SELECT cluster, 'ip', ip FROM opd) WHERE cat IS NOT NULL GROUP BY 1, 2, 3),
       (SELECT count(DISTINCT cluster) AS nn FROM opd)""")
cte("oph", ("opd",), """
  SELECT cluster, list(sqrt(s / greatest(t, 1e-12)) ORDER BY h) AS hours, bool_or(nh >= 3) AS has_diurnal FROM (
    SELECT c.cluster, b.h, 0.25 * coalesce(x.k, 0) + 0.5 * coalesce(y.k, 0) + 0.25 * coalesce(z.k, 0) AS s, nh, sum(0.25 * coalesce(x.k, 0) + 0.5 * coalesce(y.k, 0) + 0.25 * coalesce(z.k, 0)) OVER (PARTITION BY c.cluster) AS t
    FROM (SELECT cluster, count(*) AS nh FROM opd GROUP BY 1) c CROSS JOIN (SELECT unnest(range(24)) AS h) b
    LEFT JOIN (SELECT cluster, hr, count(*) AS k FROM opd GROUP BY 1, 2) x ON x.cluster = c.cluster AND x.hr = (b.h + 23) % 24
    LEFT JOIN (SELECT cluster, hr, count(*) AS k FROM opd GROUP BY 1, 2) y ON y.cluster = c.cluster AND y.hr = b.h
    LEFT JOIN (SELECT cluster, hr, count(*) AS k FROM opd GROUP BY 1, 2) z ON z.cluster = c.cluster AND z.hr = (b.h + 1) % 24) GROUP BY 1""")
cte("opf", ("opd", "opk", "oph"), """
  SELECT d.cluster, max(d.n_tx) AS n_tx, quantile_cont(d.fee, 0.5) AS fee, any_value(hours) AS hours, any_value(has_diurnal) AS has_diurnal,
         any_value(d.cluster IN (SELECT cluster FROM opk WHERE signal = 'software')) AS has_software, any_value(d.cluster IN (SELECT cluster FROM opk WHERE signal = 'ip')) AS has_ip
  FROM opd d JOIN oph USING (cluster) GROUP BY 1""")
cte("opp", ("opf", "opk", "alerts"), """
  SELECT query, cluster, n_tx, ip, software, script, diurnal, fee, behaviour, 1 - (1 - 0.6 * behaviour) * (1 - 0.9 * ip) AS score FROM (
    SELECT *, (1.0 * software * CAST(bs AS INT) + 0.5 * script + 1.0 * diurnal * CAST(bd AS INT) + 0.3 * fee) / (1.0 * CAST(bs AS INT) + 0.5 + 1.0 * CAST(bd AS INT) + 0.3) AS behaviour FROM (
      SELECT a.cluster AS query, b.cluster, b.n_tx, least(coalesce(s_ip, 0), 1) AS ip, least(coalesce(s_sw, 0), 1) AS software, least(coalesce(s_sc, 0), 1) AS script,
             least(list_dot_product(a.hours, b.hours), 1) AS diurnal, exp(-abs(a.fee - b.fee) / 0.35) AS fee, a.has_software AND b.has_software AS bs, a.has_diurnal AND b.has_diurnal AS bd
      FROM opf a JOIN (SELECT DISTINCT cluster_id AS c FROM alerts) q ON q.c = a.cluster JOIN opf b ON b.cluster <> a.cluster
      LEFT JOIN (SELECT x.cluster AS qa, y.cluster AS qb, sum(x.v * y.v) FILTER (x.signal = 'ip') AS s_ip, sum(x.v * y.v) FILTER (x.signal = 'software') AS s_sw, sum(x.v * y.v) FILTER (x.signal = 'script') AS s_sc
                 FROM opk x JOIN opk y ON x.signal = y.signal AND x.cat = y.cat GROUP BY 1, 2) s ON qa = a.cluster AND qb = b.cluster))""")


def fingerprints(fx):
    def build():
        rows = Le.operator_rows(fx.tin_a, fx.tx_a, fx.spy, scores(fx).select("address", "cluster_id"), D.shape(fx), fx.known)
        return Le.operator_fingerprints(rows)
    return fx._stage("op-fingerprints", build)


def lead_queries(fx):
    return alerts(fx).select(F.col("cluster_id").alias("cluster"))


@query("al8_operator_fingerprints", with_ctes(["opf", "opk"], f"""
    SELECT f.cluster, n_tx, {r('fee')} AS fee, CAST(has_diurnal AS INT) AS has_diurnal, {', '.join(f"{r(f'hours[{h + 1}]')} AS h{h}" for h in (0, 6, 12, 18))}, {r('coalesce(s, 0)')} AS weight_sum, coalesce(k, 0) AS categories
    FROM opf f LEFT JOIN (SELECT cluster, sum(v) AS s, count(*) AS k FROM opk GROUP BY 1) USING (cluster)"""))
def al8(fx):
    f = fingerprints(fx)
    return f.select("cluster", "n_tx", r6("fee").alias("fee"), F.col("has_diurnal").cast("int").alias("has_diurnal"), *[r6(F.get("hours", F.lit(h))).alias(f"h{h}") for h in (0, 6, 12, 18)],
                    r6(F.aggregate(F.map_values("cats"), F.lit(0.0), lambda a, x: a + x)).alias("weight_sum"), F.size(F.map_keys("cats")).cast("long").alias("categories"))


@query("al9_operator_leads", with_ctes(["opp", "scores"], f"""
    SELECT query, cluster, rank, n_tx, {r('round(score, 9)')} AS score, {r('round(behaviour, 9)')} AS behaviour, {', '.join(f"{r(f'round({c}, 9)')} AS {c}" for c in ('ip', 'software', 'script', 'diurnal', 'fee'))}, top_wallet, risk FROM (
      SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, cluster) AS rank FROM opp)
    LEFT JOIN (SELECT 'C-' || CAST(n // 8 AS VARCHAR) AS cluster, arg_max(address, (p, address)) AS top_wallet, round(100 * max(p), 1) AS risk FROM scores GROUP BY 1) USING (cluster) WHERE rank <= 5"""))
def al9(fx):
    le = Le.operator_leads(fingerprints(fx), lead_queries(fx), Le.top_wallet_per_cluster(scores(fx)))
    return le.select("query", "cluster", "rank", "n_tx", r6("score").alias("score"), r6("behaviour").alias("behaviour"), *[r6(c).alias(c) for c in ("ip", "software", "script", "diurnal", "fee")], "top_wallet", "risk")


@query("ev7_operator_eval", with_ctes(["opp"], f"""
    SELECT signal, count(*) AS queries, {r('avg(1.0 / rank)')} AS mrr, {r('avg(CAST(rank <= 1 AS DOUBLE))')} AS hit_at_1, {r('avg(CAST(rank <= 5 AS DOUBLE))')} AS hit_at_5, {r('avg(CAST(rank <= 10 AS DOUBLE))')} AS hit_at_10 FROM (
      SELECT signal, query, min(rank) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY signal, query ORDER BY v DESC, cluster) AS rank FROM (
          SELECT query, cluster, unnest(['all','without_network','ip','software','script','diurnal','fee']) AS signal, round(unnest([score, behaviour, ip, software, script, diurnal, fee]), 9) AS v FROM opp))
      WHERE CAST(substr(query, 3) AS BIGINT) % 40 = CAST(substr(cluster, 3) AS BIGINT) % 40 GROUP BY 1, 2) GROUP BY 1"""))
def ev7(fx):
    owner = scores(fx).select(F.col("cluster_id").alias("cluster"), (F.floor(F.col("n") / 8) % 40).alias("owner")).distinct()
    e = Le.operator_eval(fingerprints(fx), lead_queries(fx), owner)
    return e.select("signal", "queries", *[r6(c).alias(c) for c in ("mrr", "hit_at_1", "hit_at_5", "hit_at_10")])


# -- watchlist -------------------------------------------------------------------------------------
cte("targets", ("watchlist", "seeds"), """
  SELECT address, watched_from, 'WATCHLIST' AS src, reason, alert_id FROM watchlist WHERE active
  UNION ALL SELECT address, NULL, 'SEED', 'SEED', NULL FROM seeds WHERE address NOT IN (SELECT address FROM watchlist WHERE active)""")
cte("matches", ("targets", "tin"), """
  SELECT address, txid, min(ts) AS ts, sum(amount) AS moved, any_value(src) AS src, any_value(reason) AS reason, any_value(alert_id) AS alert_id
  FROM tin JOIN targets USING (address) WHERE (watched_from IS NULL OR ts > watched_from) AND txid % 10 <> 3 GROUP BY 1, 2""")


def recorded(fx):
    """Events already in the table: one transaction in ten."""
    return fx.tin_a.where("txid % 10 = 3").select("address", "txid").distinct()


def matches(fx):
    return fx._stage("wa-matches", lambda: Wa.watch_matches(fx.tin_a, Wa.watch_targets(fx.watchlist, fx.seeds), recorded(fx)))


@query("al10_watch_matches", with_ctes(["matches"], f"SELECT address, txid, epoch_us(ts) AS ts_us, {r('moved', 8)} AS moved, src, reason, coalesce(alert_id, '-') AS alert_id FROM matches"))
def al10(fx):
    m = Wa.watch_matches(fx.tin_a, Wa.watch_targets(fx.watchlist, fx.seeds), recorded(fx))
    return m.select("address", "txid", F.unix_micros("ts").alias("ts_us"), r6("moved", 8).alias("moved"), "src", "reason", F.coalesce("alert_id", F.lit("-")).alias("alert_id"))


def watch_exits(fx):
    return fx._stage("wa-exits", lambda: Tr.trace_exits(fx.sides, matches(fx).select("address").distinct(), fx.known))


WATCH_TRACE = TRACE_SQL.replace("SELECT address FROM alerts", "SELECT address FROM matches")


def events(fx, via="SCORING"):
    ex = watch_exits(fx) if via == "SCORING" else None
    return fx._stage(f"wa-events-{via}", lambda: Wa.watch_events(matches(fx), fx.a, ex, now_us(fx), via))


EVENT_SQL = WATCH_TRACE + """,
  fx AS MATERIALIZED (SELECT m.address, m.txid, arg_min({'v': vasp, 'a': coalesce(deposit_address, ''), 'u': deposit_us}, (deposit_us, vasp, deposit_address, CAST(e.txid AS VARCHAR), in_jurisdiction)) AS d
     FROM matches m JOIN exits e ON e.start = m.address AND e.deposit_us >= epoch_us(m.ts) GROUP BY 1, 2),
  wev AS MATERIALIZED (SELECT 'W-' || substr(sha1(m.address || '|' || CAST(m.txid AS VARCHAR)), 1, 10) AS event_id, m.address, m.txid, m.ts, m.moved, coalesce(d.v, '-') AS vasp, coalesce(d.u, -1) AS vasp_deposit_us,
     (((SELECT max(epoch_us(ts)) FROM tx) - epoch_us(m.ts) + 3000000) // 6000000) / 10.0 AS minutes_since_move, CASE WHEN m.src = 'SEED' THEN 'SEED' ELSE m.reason END AS watch_reason, m.alert_id,
     CASE WHEN coalesce(confirmed, true) = false THEN 'UNCONFIRMED_MOVEMENT' WHEN d.u IS NOT NULL THEN 'IMMEDIATE_FREEZE_DRAFT' ELSE 'TRACE_AND_REVIEW' END AS recommended, coalesce(confirmed, true) AS confirmed
     FROM matches m LEFT JOIN fx USING (address, txid) LEFT JOIN tx ON tx.txid = m.txid)"""
EVENT_NEEDS = ["tin", "tout", "tx", "known", "matches"]


@query("al11_watch_events", with_ctes(EVENT_NEEDS, f"""
    SELECT event_id, address, txid, {r('moved', 8)} AS amount_btc, vasp, vasp_deposit_us, minutes_since_move, watch_reason, recommended, CAST(confirmed AS INT) AS confirmed, least(n, 20) AS destinations
    FROM wev JOIN (SELECT txid, count(*) AS n FROM tout GROUP BY 1) USING (txid)""", extra=EVENT_SQL))
def al11(fx):
    e = events(fx)
    return e.select("event_id", "address", "txid", "amount_btc", F.coalesce("vasp", F.lit("-")).alias("vasp"), F.coalesce("vasp_deposit_us", F.lit(-1)).alias("vasp_deposit_us"), "minutes_since_move", "watch_reason",
                    "recommended", F.col("confirmed").cast("int").alias("confirmed"), F.size("destinations").cast("long").alias("destinations"))


@query("al13_watch_enrich", with_ctes(EVENT_NEEDS, """
    SELECT event_id, vasp, vasp_deposit_us, recommended FROM wev""", extra=EVENT_SQL))
def al13(fx):
    """Events of the fast path after a scoring run: the trace is added, so they equal events recorded with it."""
    e = Wa.enrich_events(events(fx, "QUICK"), watch_exits(fx))
    return e.select("event_id", F.coalesce("vasp", F.lit("-")).alias("vasp"), F.coalesce("vasp_deposit_us", F.lit(-1)).alias("vasp_deposit_us"), "recommended")


@query("al14_auto_watch", with_ctes([*RULE_NEEDS, "watchlist"], """
    SELECT coalesce(w.address, n.address) AS address, CASE WHEN take THEN now_us ELSE epoch_us(w.watched_from) END AS watched_from_us, CAST(take OR coalesce(w.active, false) AS INT) AS active,
           CASE WHEN take THEN 'AUTO_TAINT_WATCH' ELSE w.reason END AS reason, CASE WHEN take THEN n.alert_id ELSE w.alert_id END AS alert_id
    FROM (SELECT address, alert_id FROM ruled WHERE m[1] = 'PASSIVE_TAINT_MONITOR') n FULL JOIN watchlist w ON w.address = n.address
    JOIN LATERAL (SELECT n.address IS NOT NULL AND NOT coalesce(w.active, false) AS take) t ON true, now_""", extra=RULE_SQL))
def al14(fx):
    a = ruled(fx).join(alerts(fx).select("address", "alert_id"), "address")
    w = Wa.auto_watch(fx.watchlist, a, F.timestamp_micros(now_us(fx)))
    return w.select("address", F.unix_micros("watched_from").alias("watched_from_us"), F.col("active").cast("int").alias("active"), "reason", "alert_id")


@query("al15_watchlist_summary", with_ctes(["matches", "watchlist"], """
    SELECT w.address, (SELECT count(*) FROM matches e WHERE e.address = w.address) AS movements, coalesce((SELECT max(epoch_us(ts)) FROM matches e WHERE e.address = w.address), -1) AS last_movement_us
    FROM watchlist w WHERE active"""))
def al15(fx):
    s = Wa.watchlist_summary(fx.watchlist, matches(fx))
    return s.select("address", "movements", F.coalesce(F.unix_micros("last_movement"), F.lit(-1)).alias("last_movement_us"))
