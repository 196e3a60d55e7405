"""Queries of the investigator's read surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.config import ACTION_TEXT
from tracewell.functions import text as Tx
from tracewell.functions.columns import severity
from tracewell.operators import alerts as A
from tracewell.operators import investigator as I
from tracewell.operators import tx_features as T
from tracewell.operators.ledger import wallet_ips
from tracewell.plans import derived as D
from tracewell.plans import queries_alerts as Qa
from tracewell.plans.oracle import cte, r, with_ctes
from tracewell.plans.queries_alerts import TRACE_NEEDS, TRACE_SQL
from tracewell.plans.queries_ledger import r6, transactions
from tracewell.plans.registry import query

STATUS = ("OPEN", "INVESTIGATING", "RESOLVED", "FALSE_POSITIVE", "OPEN")
ACTIONS = list(ACTION_TEXT)
sql_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

cte("atab", ("alerts",), f"""
  SELECT alert_id, address AS entity_id, 'WALLET' AS entity_type, typology, typology || '_PATTERN' AS alert_type, p, risk_score, ((n * 7) % 1000) / 1000.0 AS calibrated_confidence,
         CASE WHEN risk_score >= 85 THEN 'CRITICAL' WHEN risk_score >= 65 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
         {sql_list(STATUS)}[n % 5 + 1] AS status, CASE WHEN n % 4 = 0 THEN 'analyst' || CAST(n % 3 AS VARCHAR) ELSE 'Unassigned' END AS assigned_to,
         {sql_list(ACTIONS)}[n % 7 + 1] AS action, cluster_id, n, '{{"txid":"' || CAST(n AS VARCHAR) || '"}}' AS evidence FROM alerts""")


def alert_table(fx):
    """The alert list with status, confidence and the JSON columns of the stored form."""
    n = F.col("n")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    a = Qa.alerts(fx)
    action = pick(ACTIONS, n % 7)
    return a.select("alert_id", F.col("address").alias("entity_id"), F.lit("WALLET").alias("entity_type"), "typology", F.concat("typology", F.lit("_PATTERN")).alias("alert_type"), "p", "risk_score",
                    (((n * 7) % 1000) / 1000.0).alias("calibrated_confidence"), severity(F.col("risk_score")).alias("severity"), pick(STATUS, n % 5).alias("status"),
                    F.when(n % 4 == 0, F.concat(F.lit("analyst"), (n % 3).cast("string"))).otherwise("Unassigned").alias("assigned_to"), action.alias("action"), "cluster_id", "n",
                    F.to_json(F.struct(action.alias("action"))).alias("recommended_action"), F.to_json(F.struct(n.cast("string").alias("txid"))).alias("evidence"))


cte("cases", ("addr",), """
  SELECT n // 2000 AS case_id, 'Case ' || CAST(n // 2000 AS VARCHAR) AS case_name, CASE WHEN (n // 2000) % 3 = 2 THEN 'CLOSED' ELSE 'OPEN' END AS status, list(address ORDER BY address) AS suspect_entities
  FROM addr WHERE n % 23 = 0 GROUP BY 1""")


def cases(fx):
    c = F.floor(F.col("n") / 2000)
    g = fx.addresses.where("n % 23 = 0").groupBy(c.alias("case_id")).agg(F.sort_array(F.collect_list("address")).alias("suspect_entities"))
    return g.select("case_id", F.concat(F.lit("Case "), F.col("case_id").cast("string")).alias("case_name"), F.when(F.col("case_id") % 3 == 2, "CLOSED").otherwise("OPEN").alias("status"), "suspect_entities")


cte("profiles", ("scores",), "SELECT address, p, CASE WHEN n % 3 = 0 THEN 'SOLO-' ELSE 'C-' END || CAST(n // 8 AS VARCHAR) AS cluster_id FROM scores")


def profiles(fx):
    n = F.col("n")
    return fx.scores.select("address", "p", F.concat(F.when(n % 3 == 0, "SOLO-").otherwise("C-"), F.floor(n / 8).cast("string")).alias("cluster_id"))


@query("q1_list_alerts", with_ctes(["atab"], """
    SELECT alert_id, risk_score, calibrated_confidence, status, (SELECT count(*) FROM atab WHERE severity = 'CRITICAL' AND status = 'OPEN' AND entity_id ILIKE '%1%') AS total_count
    FROM atab WHERE severity = 'CRITICAL' AND status = 'OPEN' AND entity_id ILIKE '%1%' ORDER BY risk_score DESC, calibrated_confidence DESC, alert_id LIMIT 20 OFFSET 5"""))
def q1(fx):
    page = I.list_alerts(alert_table(fx).withColumn("evidence", F.lit("")), 20, 5, severity="CRITICAL", status="OPEN", q="1")
    return page.select("alert_id", "risk_score", "calibrated_confidence", "status", "total_count")


@query("q2_case_links", with_ctes(["atab", "cases", "profiles"], """
    SELECT DISTINCT a.alert_id, sc.case_id, sc.case_name, CASE WHEN bool_or(a.entity_id = sc.addr) OVER (PARTITION BY a.alert_id, sc.case_id) THEN 'suspect' ELSE 'same entity cluster' END AS link
    FROM atab a JOIN profiles wa ON wa.address = a.entity_id
    JOIN (SELECT s.*, w.cluster_id FROM (SELECT case_id, case_name, unnest(suspect_entities) AS addr FROM cases WHERE status <> 'CLOSED') s LEFT JOIN profiles w ON w.address = s.addr) sc
      ON a.entity_id = sc.addr OR (sc.cluster_id = wa.cluster_id AND sc.cluster_id NOT LIKE 'SOLO%')"""))
def q2(fx):
    return I.case_links(alert_table(fx), cases(fx), profiles(fx))


@query("q3_review_queue", with_ctes(["atab", "feedback"], f"""
    SELECT alert_id, status, {r('0.6 * (1 - abs(2 * p - 1)) + 0.4 * (1 - calibrated_confidence)', 4)} AS uncertainty FROM atab
    WHERE status IN ('OPEN', 'INVESTIGATING') AND entity_id NOT IN (SELECT entity_id FROM feedback) ORDER BY round(0.6 * (1 - abs(2 * p - 1)) + 0.4 * (1 - calibrated_confidence), 4) DESC, alert_id LIMIT 25"""))
def q3(fx):
    return I.review_queue(alert_table(fx), fx.feedback).select("alert_id", "status", "uncertainty")


@query("q3_near_misses", with_ctes(["atab", "scores", "feedback"], """
    SELECT address, p FROM scores WHERE p >= 0.2 AND p < 0.4 AND address NOT IN (SELECT entity_id FROM atab) AND address NOT IN (SELECT entity_id FROM feedback) ORDER BY p DESC, address LIMIT 25"""))
def q3n(fx):
    return I.near_misses(fx.scores, alert_table(fx), fx.feedback).select("address", "p")


@query("q4_search", with_ctes(["atab", "profiles", "tx", "obs", "cases"], f"""
    SELECT * FROM (
      (SELECT 'wallet' AS kind, address AS id, cluster_id AS detail, {r('100 * p')} AS weight FROM profiles WHERE address ILIKE 'a1%' ORDER BY p DESC, address LIMIT 6)
      UNION ALL (SELECT 'cluster', cluster_id, arg_max(address, (p, address)), {r('100 * max(p)')} FROM profiles WHERE cluster_id ILIKE 'a1%' GROUP BY 2 ORDER BY max(p) DESC, 2 LIMIT 6)
      UNION ALL (SELECT 'transaction', CAST(txid AS VARCHAR), '', 0 FROM tx WHERE CAST(txid AS VARCHAR) ILIKE 'a1%' ORDER BY ts DESC, txid LIMIT 6)
      UNION ALL (SELECT 'ip', src_ip, min(country), count(*) FROM obs WHERE src_ip LIKE 'a1%' GROUP BY 2 ORDER BY count(*) DESC, 2 LIMIT 6)
      UNION ALL (SELECT 'alert', alert_id, alert_type, risk_score FROM atab WHERE alert_id ILIKE 'a1%' OR alert_type ILIKE '%a1%' ORDER BY risk_score DESC, alert_id LIMIT 6)
      UNION ALL (SELECT 'case', CAST(case_id AS VARCHAR), case_name, 0 FROM cases WHERE case_name ILIKE '%a1%' OR CAST(case_id AS VARCHAR) = 'a1' OR list_contains(suspect_entities, 'a1') ORDER BY case_id LIMIT 6))"""))
def q4(fx):
    return _searched(fx, "a1")


def _searched(fx, q):
    s = I.search(q, profiles(fx), fx.tx_a, fx.obs, alert_table(fx), cases(fx))
    return s.withColumn("weight", r6("weight"))


@query("q4_search_number", with_ctes(["profiles", "tx", "obs", "cases", "atab"], """
    SELECT * FROM (
      (SELECT 'transaction' AS kind, CAST(txid AS VARCHAR) AS id, '' AS detail, 0.0::DOUBLE AS weight FROM tx WHERE CAST(txid AS VARCHAR) ILIKE '10%' ORDER BY ts DESC, txid LIMIT 6)
      UNION ALL (SELECT 'ip', src_ip, min(country), count(*) FROM obs WHERE src_ip LIKE '10%' GROUP BY 2 ORDER BY count(*) DESC, 2 LIMIT 6)
      UNION ALL (SELECT 'case', CAST(case_id AS VARCHAR), case_name, 0 FROM cases WHERE case_name ILIKE '%10%' OR CAST(case_id AS VARCHAR) = '10' OR list_contains(suspect_entities, '10') ORDER BY case_id LIMIT 6))"""))
def q4n(fx):
    return _searched(fx, "10")


@query("q5_overview_kpis", with_ctes(["atab", "tx", "obs", "tout", "profiles"], """
    SELECT name, CAST(value AS DOUBLE) AS value FROM (
      SELECT 'total_transactions' AS name, (SELECT count(*) FROM tx)::DOUBLE AS value UNION ALL SELECT 'total_observations', (SELECT count(*) FROM obs) UNION ALL SELECT 'total_volume_btc', (SELECT round(sum(amount), 4) FROM tout)
      UNION ALL SELECT 'total_wallets', (SELECT count(*) FROM profiles) UNION ALL SELECT 'total_ips', (SELECT count(DISTINCT src_ip) FROM obs) UNION ALL SELECT 'total_clusters', (SELECT count(DISTINCT cluster_id) FROM profiles)
      UNION ALL SELECT 'total_alerts', (SELECT count(*) FROM atab) UNION ALL SELECT 'open_alerts', (SELECT count(*) FROM atab WHERE status = 'OPEN') UNION ALL SELECT 'critical_alerts', (SELECT count(*) FROM atab WHERE severity = 'CRITICAL')
      UNION ALL SELECT 'high_alerts', (SELECT count(*) FROM atab WHERE severity = 'HIGH') UNION ALL SELECT 'medium_alerts', (SELECT count(*) FROM atab WHERE severity = 'MEDIUM') UNION ALL SELECT 'low_alerts', (SELECT count(*) FROM atab WHERE severity = 'LOW'))"""))
def q5(fx):
    return I.kpis(fx.a, fx.obs, profiles(fx), alert_table(fx))


@query("q5_overview_distributions", with_ctes(["atab", "obs"], """
    (SELECT 'typology' AS kind, typology AS name, count(*) AS n FROM atab GROUP BY 2)
    UNION ALL (SELECT 'country', country, count(*) FROM obs GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 8) UNION ALL (SELECT 'asn_type', asn_type, count(*) FROM obs GROUP BY 2)"""))
def q5d(fx):
    return (I.distribution(alert_table(fx), "typology", "typology").unionByName(I.distribution(fx.obs, "country", "country", 8))
            .unionByName(I.distribution(fx.obs, "asn_type", "asn_type")))


@query("q5_overview_activity", with_ctes(["tx", "tout"], f"""
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, count(*) AS transactions, {r('sum(v)', 8)} AS volume_btc FROM tx JOIN (SELECT txid, sum(amount) AS v FROM tout GROUP BY 1) USING (txid) GROUP BY 1"""))
def q5a(fx):
    return I.activity_by_hour(fx.tx_a, fx.tout_a).select(F.date_format("hour", "yyyy-MM-dd HH:00").alias("hour"), "transactions", r6("volume_btc", 8).alias("volume_btc"))


cte("hist", ("tin", "tout"), """
  SELECT address, txid, min(ts) AS ts, sum(got) AS got, sum(spent) AS spent FROM (SELECT address, txid, ts, amount AS got, 0.0::DOUBLE AS spent FROM tout UNION ALL SELECT address, txid, ts, 0, amount FROM tin) GROUP BY 1, 2""")


@query("q6_wallet_history", with_ctes(["hist"], f"""
    SELECT address, txid, CASE WHEN spent <> 0 THEN 'SENDER' ELSE 'RECIPIENT' END AS role, {r('CASE WHEN spent <> 0 THEN spent ELSE got END', 8)} AS amount FROM hist"""))
def q6h(fx):
    return I.wallet_history(fx.a).select("address", "txid", "role", "amount")


@query("q6_wallet_360", with_ctes(["hist", "profiles", "seeds", "din", "spy", "tx"], f"""
    SELECT h.address, epoch_us(min(ts)) AS first_seen_us, epoch_us(max(ts)) AS last_seen_us, count(*) AS transaction_count, {r('sum(got)', 8)} AS total_received, {r('sum(spent)', 8)} AS total_sent,
           any_value(p.cluster_id) AS cluster_id, coalesce(any_value(i.n), 0) AS n_ips, CAST(any_value(h.address IN (SELECT address FROM seeds)) AS INT) AS is_seed, coalesce(any_value(f.main), '-') AS main_fingerprint,
           any_value(least((SELECT count(*) FROM profiles q WHERE q.cluster_id = p.cluster_id) - 1, 50)) AS members
    FROM hist h JOIN profiles p USING (address) LEFT JOIN (SELECT address, count(DISTINCT spy_ip) AS n FROM din JOIN spy USING (txid) GROUP BY 1) i USING (address)
    LEFT JOIN (SELECT address, arg_max(k, (c, k)) AS main FROM (SELECT address, 'version ' || CAST(tx_version AS VARCHAR) || ' · ' || CASE WHEN locktime = 0 THEN 'no locktime' WHEN locktime < 500000000 THEN 'anti-fee-sniping locktime' ELSE 'time locktime' END
        || ' · ' || CASE WHEN rbf THEN 'RBF on' ELSE 'RBF off' END AS k, count(*) AS c FROM din JOIN tx USING (txid) WHERE tx_version IS NOT NULL GROUP BY 1, 2) GROUP BY 1) f USING (address) GROUP BY 1"""))
def q6(fx):
    cl = profiles(fx).withColumn("size", F.lit(0))
    w = I.wallet_360(fx.a, cl, fx.seeds)
    return w.select("address", F.unix_micros("first_seen").alias("first_seen_us"), F.unix_micros("last_seen").alias("last_seen_us"), "transaction_count", "total_received", "total_sent", "cluster_id", "n_ips",
                    F.col("is_seed").cast("int").alias("is_seed"), F.coalesce("main_fingerprint", F.lit("-")).alias("main_fingerprint"), F.size("cluster_members").cast("long").alias("members"))


@query("q7_ip_360", with_ctes(["obs", "spy", "tx", "tin", "atab"], """
    SELECT o.src_ip, country, asn_type, observations, tx_count, first_us, last_us, coalesce(linked_wallets, 0) AS linked_wallets, coalesce(flagged_wallets, 0) AS flagged_wallets FROM (
      SELECT src_ip, min(country) AS country, min(asn_type) AS asn_type, count(*) AS observations, count(DISTINCT txid) AS tx_count, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM obs GROUP BY 1) o
    LEFT JOIN (SELECT spy_ip AS src_ip, count(*) AS linked_wallets, count(risk_score) AS flagged_wallets FROM (SELECT DISTINCT spy_ip, address FROM (
        SELECT spy_ip, txid FROM spy JOIN tx USING (txid)) JOIN tin USING (txid)) LEFT JOIN atab ON entity_id = address GROUP BY 1) USING (src_ip)"""))
def q7(fx):
    i = I.ip_360(fx.obs, fx.a, alert_table(fx))
    return i.select("src_ip", "country", "asn_type", "observations", "tx_count", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "linked_wallets", "flagged_wallets")


@query("q8_tx_360", with_ctes(["obs", "tx"], """
    SELECT txid, row_number() OVER (PARTITION BY txid ORDER BY o.ts, src_ip) AS step, src_ip, CAST(o.src_port AS INT) AS src_port, epoch_us(o.ts) AS ts_us, fee FROM obs o JOIN tx USING (txid)"""))
def q8(fx):
    return I.tx_360(fx.obs, fx.tx_a).select("txid", "step", "src_ip", "src_port", F.unix_micros("ts").alias("ts_us"), "fee")


@query("q9_timeline", with_ctes(["hist", "shape", "atab"], f"""
    SELECT address, step, txid, inputs_count, outputs_count, {r('amount_btc', 8)} AS amount_btc, direction, CAST(is_peel AS INT) AS is_peel, CAST(is_split AS INT) AS is_split FROM (
      SELECT h.address, h.txid, row_number() OVER (PARTITION BY h.address ORDER BY h.ts, h.txid) AS step, n_in AS inputs_count, n_out AS outputs_count, total_out AS amount_btc, CASE WHEN spent <> 0 THEN 'OUT' ELSE 'IN' END AS direction,
             n_in = 1 AND n_out = 2 AND mn < 0.25 * mx AS is_peel, n_out >= 5 AS is_split FROM hist h JOIN shape USING (txid) WHERE h.address IN (SELECT entity_id FROM atab)) WHERE step <= 50"""))
def q9(fx):
    t = I.timeline(fx.a, D.shape(fx), alert_table(fx).select(F.col("entity_id").alias("address")))
    return t.select("address", "step", "txid", "inputs_count", "outputs_count", r6("amount_btc", 8).alias("amount_btc"), "direction", F.col("is_peel").cast("int").alias("is_peel"), F.col("is_split").cast("int").alias("is_split"))


@query("q10_geo_points", with_ctes(["obs", "place"], """
    SELECT src_ip, g.country, CASE WHEN g.lat <> 0 OR g.lon <> 0 THEN g.lat ELSE p.lat END AS lat, CASE WHEN g.lat <> 0 OR g.lon <> 0 THEN g.lon ELSE p.lon END AS lon, CAST(NOT (g.lat <> 0 OR g.lon <> 0) AS INT) AS approximate, tx_count FROM (
      SELECT src_ip, min(country) AS country, CASE WHEN src_ip LIKE '%3' THEN 0 ELSE min(lat) END AS lat, CASE WHEN src_ip LIKE '%3' THEN 0 ELSE min(lon) END AS lon, count(*) AS tx_count FROM obs GROUP BY 1 ORDER BY tx_count DESC, src_ip LIMIT 2000) g
    JOIN place p ON p.country = upper(g.country)"""))
def q10(fx):
    blank = F.col("src_ip").like("%3")
    o = fx.obs.withColumns({"lat": F.when(blank, 0.0).otherwise(F.col("lat")), "lon": F.when(blank, 0.0).otherwise(F.col("lon"))})
    return I.geo_points(o, fx.centroids).select("src_ip", "country", "lat", "lon", F.col("approximate").cast("int").alias("approximate"), "tx_count")


@query("q11_impossible_travel", with_ctes(["moves"], f"""
    SELECT pcountry AS from_country, country AS to_country, max(s) AS speed_kmh, arg_max(address, (s, address, txid)) AS address FROM (SELECT *, round(km / hours, 3) AS s FROM moves WHERE (plat <> lat OR plon <> lon) AND km / hours >= 900)
    GROUP BY 1, 2 ORDER BY speed_kmh DESC, 1, 2 LIMIT 25"""))
def q11(fx):
    from tracewell.operators.wallet_features import spends_with_relay
    s = spends_with_relay(fx.a).withColumn("country", F.col("spy_country")).join(F.broadcast(fx.centroids), "country").withColumn("src_ip", F.col("spy_ip"))
    return I.impossible_travel(s).select("from_country", "to_country", "speed_kmh", "address")


@query("q12_live_rate", """
    SELECT epoch_us(date_trunc('minute', ts)) AS minute_us, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1440 MINUTE GROUP BY 1""")
def q12(fx):
    e = fx.t.events.select("event_id", "ts")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return I.live_rate(e, "ts", 1440, now).select(F.unix_micros("minute").alias("minute_us"), "n")


@query("q13_actions_summary", with_ctes(["atab"], "SELECT action, count(*) AS n FROM atab GROUP BY 1"))
def q13(fx):
    return I.actions_summary(alert_table(fx))


@query("q14_known_entities_summary", with_ctes(["known"], "SELECT entity_name, entity_type, country, CAST(in_jurisdiction AS INT) AS in_jurisdiction, count(*) AS addresses FROM known GROUP BY ALL"))
def q14(fx):
    return I.known_entities_summary(fx.known).withColumn("in_jurisdiction", F.col("in_jurisdiction").cast("int"))


@query("q15_case_summary", with_ctes(["cases", "atab"], """
    SELECT case_id, case_name, status, count(*) AS suspects, count(a.alert_id) AS alert_count, coalesce(max(risk_score), 0) AS max_risk FROM (SELECT case_id, case_name, c.status, unnest(suspect_entities) AS s FROM cases c) LEFT JOIN (SELECT alert_id, entity_id, risk_score FROM atab) a ON a.entity_id = s GROUP BY 1, 2, 3"""))
def q15(fx):
    return I.case_summary(cases(fx), alert_table(fx)).fillna({"max_risk": 0.0})


@query("q16_feedback_counts", with_ctes(["feedback"], "SELECT count(DISTINCT entity_id) AS verdicts FROM feedback"))
def q16(fx):
    return I.feedback_counts(fx.feedback)


# The audit trail: four events in a row form one chain; every chain but the first starts without its predecessor, and some rows were edited
_AUDIT_SQL = """
  e0 AS MATERIALIZED (SELECT event_id AS id, event_id // 4 AS g, event_id % 4 AS k, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, event_type AS action, 'user' || CAST(user_id AS VARCHAR) AS investigator, props AS details FROM events),
  b0 AS MATERIALIZED (SELECT *, id AS i, '"' || created_at || '","' || action || '","' || investigator || '","EVENT","' || CAST(id AS VARCHAR) || '",' || to_json(details) AS tail FROM e0),
  c0 AS MATERIALIZED (SELECT g, sha256('["genesis",' || i || ',' || tail || ']') AS h, 'genesis' AS ph, i, k FROM b0 WHERE k = 0),
  c1 AS MATERIALIZED (SELECT b.g, sha256('["' || h || '",' || b.i || ',' || tail || ']') AS h, h AS ph, b.i, b.k FROM b0 b JOIN c0 USING (g) WHERE b.k = 1),
  c2 AS MATERIALIZED (SELECT b.g, sha256('["' || h || '",' || b.i || ',' || tail || ']') AS h, h AS ph, b.i, b.k FROM b0 b JOIN c1 USING (g) WHERE b.k = 2),
  c3 AS MATERIALIZED (SELECT b.g, sha256('["' || h || '",' || b.i || ',' || tail || ']') AS h, h AS ph, b.i, b.k FROM b0 b JOIN c2 USING (g) WHERE b.k = 3),
  trail AS MATERIALIZED (SELECT i AS id, ph AS prev_hash, h AS row_hash, i % 97 = 5 AS edited FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3) WHERE i % 101 <> 7)"""


def audit_trail(fx):
    def build():
        e = fx.t.events.select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.col("event_type").alias("action"),
                               F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("investigator"), F.lit("EVENT").alias("entity_type"), F.col("event_id").cast("string").alias("entity_id"), F.col("props").alias("details"))
        e = e.withColumn("g", F.floor(F.col("id") / 4))
        cur = e.where("id % 4 = 0").withColumn("prev_hash", F.lit("genesis")).withColumn("row_hash", I.audit_row_hash())
        out = cur
        for k in (1, 2, 3):
            cur = e.where(f"id % 4 = {k}").join(cur.select("g", F.col("row_hash").alias("prev_hash")), "g").withColumn("row_hash", I.audit_row_hash())
            out = out.unionByName(cur)
        return (out.where("id % 101 <> 7").withColumn("details", F.when(F.col("id") % 97 == 5, F.concat("details", F.lit(" "))).otherwise(F.col("details"))).drop("g"))
    return fx._stage("q-audit", build)


@query("q17_audit_chain_verify", with_ctes([], """
    SELECT id, CASE WHEN edited THEN 'row edited' ELSE 'row missing before this one' END AS reason FROM (SELECT *, lag(row_hash) OVER (ORDER BY id) AS p FROM trail) WHERE edited OR (p IS NOT NULL AND p <> prev_hash)""", extra=_AUDIT_SQL))
def q17(fx):
    return I.verify_audit_chain(audit_trail(fx), 1000)


@query("q17_audit_report", with_ctes([], """
    SELECT 0 AS intact, (SELECT count(*) FROM trail) AS rows, CAST(0 AS BIGINT) AS legacy_unchained, min(id) AS first_bad_id FROM (SELECT *, lag(row_hash) OVER (ORDER BY id) AS p FROM trail) WHERE edited OR (p IS NOT NULL AND p <> prev_hash)""", extra=_AUDIT_SQL))
def q17r(fx):
    return I.audit_report(audit_trail(fx)).select(F.col("intact").cast("int").alias("intact"), "rows", "legacy_unchained", "first_bad_id")


cte("rhash", ("tx", "tin", "tout", "spy"), """
  SELECT t.txid, sha256('{"fee": ' || CAST(CAST(fee AS DECIMAL(24,8)) AS VARCHAR) || ', "input_addresses": ["' || ia || '"], "input_amounts": [' || im || '], "output_addresses": ["' || oa || '"], "output_amounts": [' || om
      || '], "src_ip": "' || coalesce(spy_ip, '') || '", "timestamp": "' || strftime(t.ts, '%Y-%m-%d %H:%M:%S') || '", "txid": "' || CAST(t.txid AS VARCHAR) || '"}') AS record_sha256
  FROM tx t JOIN (SELECT txid, string_agg(address, '", "' ORDER BY idx) AS ia, string_agg(CAST(CAST(amount AS DECIMAL(24,8)) AS VARCHAR), ', ' ORDER BY idx) AS im FROM tin GROUP BY 1) i USING (txid)
  JOIN (SELECT txid, string_agg(address, '", "' ORDER BY idx, address, amount) AS oa, string_agg(CAST(CAST(amount AS DECIMAL(24,8)) AS VARCHAR), ', ' ORDER BY idx, address, amount) AS om FROM tout GROUP BY 1) o USING (txid) LEFT JOIN spy USING (txid)""")


def records(fx):
    t = transactions(fx).join(fx.spy.select("txid", F.col("spy_ip").alias("src_ip")), "txid", "left")
    return t


@query("q18_record_hashes", with_ctes(["rhash"], "SELECT txid, record_sha256 FROM rhash"))
def q18(fx):
    return I.record_hashes(records(fx))


@query("q18_records_root", with_ctes(["rhash", "hist", "atab"], """
    SELECT address, sha256('["' || string_agg(record_sha256, '", "' ORDER BY record_sha256) || '"]') AS records_root_sha256, count(*) AS records FROM (
      SELECT address, txid, row_number() OVER (PARTITION BY address ORDER BY ts, txid) AS k FROM hist WHERE address IN (SELECT entity_id FROM atab)) JOIN rhash USING (txid) WHERE k <= 200 GROUP BY 1"""))
def q18r(fx):
    """Certificate root of every alert: its first 200 records."""
    t = I.timeline(fx.a, D.shape(fx), alert_table(fx).select(F.col("entity_id").alias("address")), 200)
    return I.records_root(t.select("address", "txid").join(I.record_hashes(records(fx)), "txid"), "address")


@query("q19_deposit_annex", with_ctes(TRACE_NEEDS, f"""
    SELECT e.start, e.vasp, count(*) AS deposits, {r('sum(amount_btc)', 8)} AS amount_btc, min(deposit_us) AS period_from_us, max(deposit_us) AS period_to_us, CAST(bool_or(in_jurisdiction) AS INT) AS in_jurisdiction
    FROM exits e JOIN (SELECT start, arg_min(vasp, (CASE WHEN in_jurisdiction THEN 0 ELSE 1 END, hop, deposit_us, vasp)) AS vasp FROM exits WHERE entity_type = 'VASP' GROUP BY 1) c ON c.start = e.start AND c.vasp = e.vasp
    WHERE entity_type = 'VASP' GROUP BY 1, 2""", extra=TRACE_SQL))
def q19(fx):
    return I.deposit_annex(Qa.exits(fx)).withColumn("in_jurisdiction", F.col("in_jurisdiction").cast("int"))


def evidence(fx):
    return fx._stage("q-evidence", lambda: A.alert_evidence(Qa.alerts(fx), fx.a, D.probs(fx)))


@query("q20_referral_dossier", with_ctes([*TRACE_NEEDS, "atab", "hist", "din", "spy"], f"""
    SELECT a.alert_id, a.entity_id, {r('h.got', 8)} AS total_received, {r('h.spent', 8)} AS total_sent, h.n AS transaction_count, a.action AS directive, least(coalesce(x.n, 0), 25) AS exposure, coalesce(x.first, '-') AS first_vasp,
           least(coalesce(i.n, 0), 20) AS relaying_ips
    FROM atab a JOIN (SELECT address, sum(got) AS got, sum(spent) AS spent, count(*) AS n FROM hist GROUP BY 1) h ON h.address = a.entity_id
    LEFT JOIN (SELECT start, count(*) AS n, arg_min(vasp, (hop, deposit_us, txid, deposit_address)) AS first FROM exits WHERE entity_type = 'VASP' GROUP BY 1) x ON x.start = a.entity_id
    LEFT JOIN (SELECT address, count(DISTINCT spy_ip) AS n FROM din JOIN spy USING (txid) GROUP BY 1) i ON i.address = a.entity_id""", extra=TRACE_SQL))
def q20(fx):
    h = I.wallet_history(fx.a).groupBy("address").agg(F.sum("got").alias("total_received"), F.sum("spent").alias("total_sent"), F.sum(F.col("got") - F.col("spent")).alias("balance"), F.count(F.lit(1)).alias("transaction_count"))
    d = I.referral_dossier(alert_table(fx), h, evidence(fx), Qa.exits(fx), wallet_ips(fx.tin_a, fx.spy))
    return d.select("alert_id", "subject.entity_id", r6("subject.total_received", 8).alias("total_received"), r6("subject.total_sent", 8).alias("total_sent"), "subject.transaction_count", "directive",
                    F.coalesce(F.size("exposure"), F.lit(0)).cast("long").alias("exposure"), F.coalesce(F.get("exposure", F.lit(0)).vasp, F.lit("-")).alias("first_vasp"),
                    F.coalesce(F.size("network_evidence.relaying_ips"), F.lit(0)).cast("long").alias("relaying_ips"))


_SHEET_SQL = """
  dep AS MATERIALIZED (SELECT start, string_agg(s, '|' ORDER BY k) AS s FROM (SELECT start, row_number() OVER (PARTITION BY start ORDER BY hop, deposit_us, txid, deposit_address) AS k,
      format('{:g}', amount_btc) || ' BTC reached exchange ' || vasp || ' (' || coalesce(country, 'None') || ') in ' || CAST(hop AS VARCHAR) || ' hop(s)' || CASE WHEN minutes_after_receipt IS NULL THEN '' ELSE ', ' || format('{:g}', minutes_after_receipt) || ' minutes after receipt' END || '.' AS s
      FROM (SELECT e.*, CASE WHEN in_jurisdiction THEN 'IN' ELSE 'XX' END AS country FROM exits e) WHERE entity_type = 'VASP') WHERE k <= 2 GROUP BY 1),
  lft AS MATERIALIZED (SELECT start, s FROM (SELECT start, row_number() OVER (PARTITION BY start ORDER BY hop, deposit_us, txid, deposit_address) AS k,
      format('{:g}', amount_btc) || ' BTC went to swap service ' || vasp || ' in ' || CAST(hop AS VARCHAR) || ' hop(s), where the funds leave Bitcoin.' AS s FROM exits WHERE entity_type <> 'VASP') WHERE k = 1)"""


@query("q21_fact_sheet", with_ctes([*TRACE_NEEDS, "atab", "spy", "din", "dout", "probs"], f"""
    SELECT alert_id, 'Wallet ' || entity_id || ' has risk ' || format('{{:g}}', risk_score) || ' of 100 (' || severity || '), with its behaviour closest to the ' || lower(replace(typology, '_', ' ')) || ' typology.'
      || '|Model reason: ' || typology || '.' || CASE WHEN n % 6 > 1 THEN '|The wallet belongs to an entity cluster of ' || CAST(n % 6 AS VARCHAR) || ' addresses controlled by one owner.' ELSE '' END
      || CASE WHEN n % 9 >= 3 THEN '|The funds pass through a peel chain of ' || CAST(n % 9 AS VARCHAR) || ' transactions.' ELSE '' END
      || CASE WHEN n % 5 >= 2 THEN '|The wallet is ' || CAST(n % 5 - 1 AS VARCHAR) || ' hops from a known illicit seed wallet.' ELSE '' END
      || CASE WHEN (n % 100) / 100.0 >= 0.01 THEN '|' || CAST(CAST(round_even((n % 100) / 100.0 * 100, 0) AS BIGINT) AS VARCHAR) || ' % of its funds trace back to seed wallets (taint).' ELSE '' END
      || coalesce('|Its key transaction was first relayed by IP ' || s.spy_ip || ' (' || s.spy_asn_type || ' network' || coalesce(', attribution confidence ' || format('{{:g}}', round(1 - exp(-s.spy_delta / 1.5), 3)), '') || '); a first relay can be a VPN or Tor exit, not the owner.', '')
      || CASE WHEN n % 2 = 1 THEN '|50 % of its spends were broadcast through Tor, VPN or bulletproof hosting.' ELSE '' END
      || coalesce('|' || dep.s, '') || coalesce('|' || lft.s, '') || '|Recommended action: ' || {sql_list([v[0] for v in ACTION_TEXT.values()])}[n % 7 + 1] || '. Rule: ' || {sql_list([v[1] for v in ACTION_TEXT.values()])}[n % 7 + 1] || '.' AS facts
    FROM atab a LEFT JOIN (SELECT m.address, arg_min(m.txid, (p_normal, ts, m.txid)) AS key FROM (SELECT txid, address FROM din UNION SELECT txid, address FROM dout) m JOIN probs USING (txid) JOIN tx USING (txid) GROUP BY 1) e ON e.address = entity_id
    LEFT JOIN spy s ON s.txid = e.key LEFT JOIN dep ON dep.start = entity_id LEFT JOIN lft ON lft.start = entity_id""", extra=TRACE_SQL + "," + _SHEET_SQL))
def q21(fx):
    from pyspark.sql import Window as W
    n = F.col("n")
    w = W.partitionBy("start", "kind").orderBy("hop", "deposit_us", "txid", "deposit_address")
    near = Qa.exits(fx).withColumn("kind", F.when(F.col("entity_type") == "VASP", "d").otherwise("x")).withColumn("k", F.row_number().over(w)).where("k <= 2")
    item = F.struct("k", "amount_btc", "vasp", F.when(F.col("in_jurisdiction"), "IN").otherwise("XX").alias("country"), F.col("hop").alias("hops"), F.col("minutes_after_receipt").alias("minutes"))
    lists = near.groupBy(F.col("start").alias("entity_id")).agg(F.sort_array(F.collect_list(F.when(F.col("kind") == "d", item))).alias("deposits"), F.sort_array(F.collect_list(F.when(F.col("kind") == "x", item))).alias("exits"))
    text = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in ACTION_TEXT.items() for x in (k, v[i])]), F.col("action"))
    a = (alert_table(fx).join(evidence(fx).withColumnRenamed("address", "entity_id").select("entity_id", "first_spy_ip", "first_spy_asn_type", "first_spy_confidence"), "entity_id", "left").join(lists, "entity_id", "left"))
    a = a.select("alert_id", F.col("entity_id").alias("address"), "risk_score", "severity", "typology", F.array("typology").alias("reasons"), (n % 6).alias("cluster_size"), (n % 9).alias("peel_chain_len"), (n % 5).alias("path_len"),
                 ((n % 100) / 100.0).alias("taint"), "first_spy_ip", "first_spy_asn_type", "first_spy_confidence", F.when(n % 2 == 1, 0.5).otherwise(0.0).alias("risky_share"), "deposits", "exits", text(0).alias("title"), text(1).alias("rule"))
    return Tx.fact_sheet(a).select("alert_id", F.array_join("facts", "|").alias("facts"))


# Texts to check: every turn's sentences cite themselves as facts; every third citation points at the next fact, and plain turns cite none
def _sql_in(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _stem_sql(x):
    w = f"replace({x}, 'behavior', 'behaviour')"
    arms = f"WHEN {w} IN ({_sql_in(Tx.MOVE_WORDS)}) THEN 'move' "
    for suf in Tx.SUFFIXES:
        cut = f"substr({w}, 1, length({w}) - {len(suf)})"
        arms += f"WHEN suffix({w}, '{suf}') AND length({w}) - {len(suf)} >= 3 THEN CASE WHEN {cut} IN ({_sql_in(Tx.MOVE_WORDS)}) THEN 'move' ELSE {cut} END "
    return f"CASE {arms} ELSE {w} END"


def _words_sql(t):
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({t}), '{Tx.WORD}'), lambda v: v NOT IN ({_sql_in(Tx.STOP_WORDS)})), lambda v: {_stem_sql('v')}))"


def _nums_sql(t):
    return f"list_distinct(list_transform(regexp_extract_all({t}, '{Tx.NUMBER}'), lambda v: rtrim(replace(v, ',', ''), '.')))"


_SPEC_SQL = Tx.SPECULATION.replace("'", "''")
_SPLIT = r"list_filter(list_transform(string_split(regexp_replace(trim({t}), '([.!?\]])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
GROUND_SQL = f"""
  conv AS MATERIALIZED (SELECT conv_id, turn, {_SPLIT.format(t='text')} AS facts FROM conversations),
  txts AS MATERIALIZED (SELECT conv_id, turn, facts, array_to_string([f || CASE WHEN turn % 4 = 3 THEN '' WHEN i % 3 = 0 THEN ' [F' || CAST(i + 1 AS VARCHAR) || ']' ELSE ' [F' || CAST(i AS VARCHAR) || ']' END || CASE WHEN i % 5 = 0 THEN ' 77' ELSE '' END
      || CASE WHEN i % 7 = 0 THEN ' may' ELSE '' END for f, i in facts], ' ') AS text FROM conv),
  sent AS MATERIALIZED (SELECT conv_id, turn, facts, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT conv_id, turn, facts, {_SPLIT.format(t='text')} AS s FROM txts)),
  parsed AS MATERIALIZED (SELECT conv_id, turn, pos, len(facts) AS nf, list_transform(regexp_extract_all(s, '{Tx.CITATION}', 1), lambda v: CAST(v AS INT)) AS ids, trim(regexp_replace(s, '{Tx.CITATION}', '', 'g')) AS body, facts FROM sent),
  cited AS MATERIALIZED (SELECT *, coalesce(array_to_string(list_filter(list_transform(ids, lambda i: facts[i]), lambda v: v IS NOT NULL), ' '), '') AS cited FROM parsed),
  judged AS MATERIALIZED (SELECT *, {_words_sql('body')} AS w, {_words_sql('cited')} AS cw, {_nums_sql('body')} AS nb, {_nums_sql('cited')} AS nc FROM cited),
  verdict AS MATERIALIZED (SELECT conv_id, turn, pos, body, ids, len(ids) > 0 AND len(list_filter(ids, lambda i: i < 1 OR i > nf)) = 0 AND NOT regexp_matches(body, '{_SPEC_SQL}') AND len(list_filter(nb, lambda v: NOT list_contains(nc, v))) = 0
      AND (len(w) = 0 OR len(list_intersect(w, cw)) / len(w) >= 0.6) AS kept FROM judged)"""


def cited_texts(fx):
    facts = Tx.split_sentences(F.col("text"))
    c = fx.t.conversations.select("conv_id", "turn", facts.alias("facts"))
    cite = lambda f, i: F.concat(f, F.when(F.col("turn") % 4 == 3, "").when((i + 1) % 3 == 0, F.concat(F.lit(" [F"), (i + 2).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit(" [F"), (i + 1).cast("string"), F.lit("]"))),
                                 F.when((i + 1) % 5 == 0, " 77").otherwise(""), F.when((i + 1) % 7 == 0, " may").otherwise(""))
    return c.withColumn("text", F.array_join(F.transform("facts", cite), " "))


@query("q22_grounding_check", with_ctes([], r"""
    SELECT conv_id, turn, pos, CASE WHEN kept THEN CASE WHEN regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END ELSE body END AS body, array_to_string(list_sort(list_distinct(ids)), ',') AS facts, CAST(kept AS INT) AS kept
    FROM (SELECT *, rtrim(regexp_replace(body, '\s+([.,;:])', '\1', 'g'), ' ,') AS t FROM verdict)""", extra=GROUND_SQL))
def q22(fx):
    g = Tx.grounding_check(cited_texts(fx), "text", "facts", ["conv_id", "turn"])
    return g.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "body", F.array_join(F.transform("facts", lambda x: x.cast("string")), ",").alias("facts"), F.col("kept").cast("int").alias("kept"))


@query("q23_evidence_txids", with_ctes([*TRACE_NEEDS, "din", "dout", "probs"], """
    SELECT address, count(DISTINCT t) AS n, min(t) AS first_by_text FROM (
      SELECT address, CAST(txid AS VARCHAR) AS t FROM (SELECT m.address, m.txid, row_number() OVER (PARTITION BY m.address ORDER BY p_normal, ts, m.txid) AS k FROM (SELECT txid, address FROM din UNION SELECT txid, address FROM dout) m JOIN alerts USING (address) JOIN probs USING (txid) JOIN tx USING (txid)) WHERE k <= 8
      UNION ALL SELECT start, CAST(txid AS VARCHAR) FROM (SELECT *, row_number() OVER (PARTITION BY start, entity_type = 'VASP' ORDER BY hop, deposit_us, txid, deposit_address) AS k FROM exits) WHERE k <= 3 AND hop = 1) GROUP BY 1""", extra=TRACE_SQL))
def q23(fx):
    """Deposits beyond the first hop carry their paths; the check looks at the first hop."""
    near = Qa.exits(fx)
    one = I.evidence_txids(evidence(fx), near.withColumn("path", F.slice("path", 1, 0)).withColumn("txid", F.when(F.col("hop") == 1, F.col("txid"))))
    ids = F.filter("txids", lambda x: x.isNotNull())
    return one.select("address", F.size(ids).cast("long").alias("n"), F.array_min(ids).alias("first_by_text"))


@query("q24_data_origin_health", with_ctes(["tx", "atab", "truth"], """
    SELECT (SELECT count(*) FROM tx) AS transactions, (SELECT count(*) FROM atab) AS alerts, 'synthetic' AS data_origin"""))
def q24(fx):
    return I.data_health(fx.tx_a, alert_table(fx), fx.labels)


@query("out5_write_scores", with_ctes(["atab"], """
    SELECT alert_id, CASE WHEN status <> 'OPEN' OR assigned_to <> 'Unassigned' THEN status ELSE 'OPEN' END AS status, CASE WHEN status <> 'OPEN' OR assigned_to <> 'Unassigned' THEN assigned_to ELSE 'Unassigned' END AS assigned_to FROM atab"""))
def out5(fx):
    """Alerts rebuilt from scores keep what analysts set on the last list."""
    old = alert_table(fx)
    return A.carry_status(old.drop("status", "assigned_to"), old).select("alert_id", "status", "assigned_to")
