"""Sinks: graph import files, threat-intel indicators, SIEM payloads and what is still to be delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.config import SEVERITIES
from tracewell.operators.ledger import Ledger

# Fixed value: the namespace that indicator ids are derived from --------------------------------------
INDICATOR_NAMESPACE = "6f1c3a3e-2b9d-4d0e-9a7c-3f5e2b1d8c4a"
# ----------------------------------------------------------------------------------------------------
SOURCE = "tracewell"
PAYLOAD_FORMATS = ("json", "splunk_hec", "elastic", "stix")


def graph_tables(ledger: Ledger, profiles: DataFrame, observations: DataFrame) -> dict[str, DataFrame]:
    """Node and edge tables for a bulk graph import, with the column headers such imports expect."""
    label = lambda t: F.lit(t).alias(":LABEL")
    kind = lambda t: F.lit(t).alias(":TYPE")
    total = ledger.tout.groupBy("txid").agg(F.sum("amount").alias("total"))
    first = ledger.spy.select("txid", F.col("spy_ip").alias("first_ip"))
    relayed = observations.select("src_ip", "txid").distinct().join(first, "txid")
    return {
        "wallets": profiles.select(F.col("address").alias("address:ID(Wallet)"), F.coalesce("risk_score", F.lit(0.0)).alias("risk:float"), F.coalesce("typology", F.lit("")).alias("typology"),
                                   F.coalesce("cluster_id", F.lit("")).alias("cluster_id"), label("Wallet")),
        "transactions": ledger.tx.join(total, "txid", "left").select(F.col("txid").alias("txid:ID(Transaction)"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                                                                    F.col("total").alias("total_out:float"), F.col("fee").alias("fee:float"), label("Transaction")),
        "ips": observations.groupBy(F.col("src_ip").alias("ip:ID(IP)")).agg(F.min("country").alias("country"), F.min("asn").alias("asn"), F.min("asn_type").alias("asn_type")).withColumn(":LABEL", F.lit("IP")),
        "spends": ledger.tin.select(F.col("address").alias(":START_ID(Wallet)"), F.col("txid").alias(":END_ID(Transaction)"), F.col("amount").alias("amount:float"), kind("SPENDS")),
        "pays": ledger.tout.select(F.col("txid").alias(":START_ID(Transaction)"), F.col("address").alias(":END_ID(Wallet)"), F.col("amount").alias("amount:float"), kind("PAYS")),
        "relayed": relayed.select(F.col("src_ip").alias(":START_ID(IP)"), F.col("txid").alias(":END_ID(Transaction)"), (F.col("src_ip") == F.col("first_ip")).alias("first_seen:boolean"), kind("RELAYED")),
    }


def write_graph(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def name_uuid(name: Column, namespace: str = INDICATOR_NAMESPACE) -> Column:
    """Version-5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def indicators(alerts: DataFrame, min_risk: float = 65.0) -> DataFrame:
    """One indicator per alerted wallet at or above ``min_risk`` and one per distinct first-relay IP among them.

    alerts: alert_id, entity_id, alert_type, severity, risk_score, calibrated_confidence, reasons, action, first_spy_ip,
    first_spy_asn_type, first_spy_confidence."""
    a = alerts.where(F.col("risk_score") >= min_risk)
    wallet = a.select(
        F.concat(F.lit("indicator--"), name_uuid(F.col("entity_id"))).alias("id"), F.concat(F.replace("alert_type", F.lit("_PATTERN"), F.lit("")), F.lit(" wallet "), F.substring("entity_id", 1, 16), F.lit("…")).alias("name"),
        F.array_join("reasons", " · ").alias("description"), F.lit("malicious-activity").alias("indicator_type"), F.concat(F.lit("[x-cryptocurrency-wallet:address = '"), F.col("entity_id"), F.lit("']")).alias("pattern"),
        F.rint(F.col("calibrated_confidence") * 100).cast("int").alias("confidence"), F.array(F.lower("severity"), F.lower("alert_type")).alias("labels"), "risk_score", "alert_id", F.col("action").alias("recommended_action"))
    # of the alerts that share an IP, the riskiest one describes it
    best = F.max_by(F.struct("first_spy_asn_type", "first_spy_confidence"), F.struct("risk_score", "alert_id"))
    ips = a.where("first_spy_ip is not null and first_spy_ip <> ''").groupBy("first_spy_ip").agg(best.alias("b"))
    ip = F.col("first_spy_ip")
    ip_rows = ips.select(
        F.concat(F.lit("indicator--"), name_uuid(ip)).alias("id"), F.concat(F.lit("First relay of flagged transaction ("), F.coalesce("b.first_spy_asn_type", F.lit("unknown")), F.lit(")")).alias("name"),
        F.lit(None).cast("string").alias("description"), F.lit("anomalous-activity").alias("indicator_type"),
        F.concat(F.lit("["), F.when(F.instr(ip, ":") > 0, "ipv6-addr").otherwise("ipv4-addr"), F.lit(":value = '"), ip, F.lit("']")).alias("pattern"),
        F.rint(100 * F.when(F.coalesce("b.first_spy_confidence", F.lit(0.0)) == 0, 0.3).otherwise(F.col("b.first_spy_confidence"))).cast("int").alias("confidence"),
        F.lit(None).cast("array<string>").alias("labels"), F.lit(None).cast("double").alias("risk_score"), F.lit(None).cast("string").alias("alert_id"), F.lit(None).cast("string").alias("recommended_action"))
    return wallet.unionByName(ip_rows)


def stix_objects(ind: DataFrame, now: Column) -> DataFrame:
    """Every indicator as one JSON object; a bundle is the list of these lines."""
    at = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return ind.select(F.to_json(F.struct(
        F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), "id", at.alias("created"), at.alias("modified"), "name", "description", F.array("indicator_type").alias("indicator_types"), "pattern",
        F.lit("stix").alias("pattern_type"), at.alias("valid_from"), "confidence", "labels", F.col("risk_score").alias("x_risk"), F.col("alert_id").alias("x_alert_id"), F.col("recommended_action").alias("x_recommended_action"))).alias("value"))


SUMMARY = ["alert_id", "wallet", "typology", "severity", "risk_score", "confidence", "reasons", "recommended_action", "action_rule", "first_relay_ip", "first_relay_asn_type", "key_txid", "cluster_id", "created_at"]


def summaries(alerts: DataFrame) -> DataFrame:
    """The compact form of an alert that every SIEM format carries."""
    have = {"wallet": F.col("entity_id"), "typology": F.replace("alert_type", F.lit("_PATTERN"), F.lit("")), "confidence": F.col("calibrated_confidence"), "recommended_action": F.col("action")}
    cols = [have[c].alias(c) if c in have else F.col(c) if c in alerts.columns else F.lit(None).cast("string").alias(c) for c in SUMMARY]
    return alerts.select(*cols)


def siem_payloads(alerts: DataFrame, fmt: str, now: Column) -> DataFrame:
    """One line of text per alert (two for bulk NDJSON) in the format of the receiving system."""
    s = summaries(alerts)
    body = F.struct(*SUMMARY)
    if fmt == "json":
        return s.select("alert_id", F.to_json(body).alias("value"))
    if fmt == "splunk_hec":
        return s.select("alert_id", F.to_json(F.struct(F.unix_timestamp(now).cast("double").alias("time"), F.lit(SOURCE).alias("source"), F.lit(f"{SOURCE}:alert").alias("sourcetype"), body.alias("event"))).alias("value"))
    if fmt == "elastic":
        head = F.to_json(F.struct(F.struct(F.col("alert_id").alias("_id")).alias("index")))
        doc = F.to_json(F.struct(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("@timestamp"), F.struct(F.lit("alert").alias("kind"), F.lit(SOURCE).alias("module")).alias("event"), *SUMMARY))
        return s.select("alert_id", F.concat_ws("\n", head, doc).alias("value"))
    if fmt == "stix":
        return stix_objects(indicators(alerts, 0.0), now).select(F.get_json_object("value", "$.id").alias("alert_id"), "value")
    raise ValueError(f"format must be one of {PAYLOAD_FORMATS}")


def pending_deliveries(hooks: DataFrame, alerts: DataFrame, events: DataFrame, log: DataFrame, per_hook: int | None = None) -> DataFrame:
    """(hook_id, item_id, kind, risk_score) still to be sent: alerts at or above the hook's severity without a SENT entry (only the
    riskiest ``per_hook``, if a caller asks for a page), and every unsent movement event (always CRITICAL)."""
    ranks = {s: i for i, s in enumerate(SEVERITIES)}
    least = F.coalesce(*[F.when(F.upper("min_severity") == s, i) for s, i in ranks.items()], F.lit(ranks["CRITICAL"]))
    wanted = hooks.where("enabled").select(F.col("id").alias("hook_id"), F.explode(F.slice(F.array(*[F.lit(s) for s in SEVERITIES]), least + 1, F.lit(len(SEVERITIES)))).alias("severity"))
    sent = log.where("status = 'SENT'").select(F.col("webhook_id").alias("hook_id"), F.col("alert_id").alias("item_id")).distinct()
    items = lambda df, kind: df.join(wanted, "severity").select("hook_id", "item_id", F.lit(kind).alias("kind"), "risk_score").join(sent, ["hook_id", "item_id"], "left_anti")
    order = W.partitionBy("hook_id").orderBy(F.desc("risk_score"), "item_id")
    a = items(alerts.select(F.col("alert_id").alias("item_id"), "severity", "risk_score"), "ALERT")
    if per_hook is not None:
        a = a.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_hook).drop("k")
    e = items(events.select(F.col("event_id").alias("item_id"), F.lit("CRITICAL").alias("severity"), F.lit(100.0).alias("risk_score")), "MOVEMENT")
    return a.unionByName(e)
