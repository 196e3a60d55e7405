"""The read surface: what an investigator asks of the scored tables. Every function takes tables and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.config import SETTINGS
from tracewell.functions.columns import micros
from tracewell.operators.ledger import Ledger
from tracewell.operators.temporal import previous_row
from tracewell.operators.wallet_features import speed_kmh


def _like(column: str, text: str) -> Column:
    return F.col(column).ilike(text)


def filter_alerts(alerts: DataFrame, severity: str | None = None, status: str | None = None, alert_type: str | None = None,
                  action: str | None = None, q: str | None = None) -> DataFrame:
    out = alerts
    for column, value in (("severity", severity), ("status", status), ("alert_type", alert_type)):
        if value and value != "ALL":
            out = out.where(F.col(column) == value)
    if action and action != "ALL":
        out = out.where(F.get_json_object("recommended_action", "$.action") == action)
    if q:
        out = out.where(_like("entity_id", f"%{q}%") | _like("alert_type", f"%{q}%") | _like("evidence", f"%{q}%"))
    return out


def list_alerts(alerts: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    """A page of alerts, highest risk first, with the number of matches."""
    match = filter_alerts(alerts, **filters)
    total = match.agg(F.count(F.lit(1)).alias("total_count"), F.lit(1).alias("one"))
    page = match.orderBy(F.desc("risk_score"), F.desc("calibrated_confidence"), "alert_id").offset(offset).limit(limit)
    return page.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").drop("one")


def case_links(alerts: DataFrame, cases: DataFrame, profiles: DataFrame) -> DataFrame:
    """Open cases whose suspects are the alert's wallet or share its cluster: the OR as a union of two equi-joins."""
    s = cases.where("status <> 'CLOSED'").select("case_id", "case_name", F.explode("suspect_entities").alias("addr"))
    mine = alerts.select("alert_id", "entity_id").join(profiles.select(F.col("address").alias("entity_id"), "cluster_id"), "entity_id")
    direct = mine.join(s, mine.entity_id == s.addr).select("alert_id", "case_id", "case_name", F.lit(True).alias("direct"))
    groups = (s.join(profiles.select(F.col("address").alias("addr"), "cluster_id"), "addr").where("cluster_id not like 'SOLO%'")
              .select("case_id", "case_name", "cluster_id").distinct())
    shared = mine.join(groups, "cluster_id").select("alert_id", "case_id", "case_name", F.lit(False).alias("direct"))
    both = direct.unionByName(shared).groupBy("alert_id", "case_id", "case_name").agg(F.bool_or("direct").alias("direct"))
    return both.select("alert_id", "case_id", "case_name", F.when(F.col("direct"), "suspect").otherwise("same entity cluster").alias("link"))


def review_queue(alerts: DataFrame, feedback: DataFrame, limit: int = 25) -> DataFrame:
    """Open, unjudged alerts where a verdict teaches the most: undecided probability and low confidence."""
    judged = feedback.where("entity_id is not null").select("entity_id").distinct()
    p, c = F.col("p"), F.coalesce("calibrated_confidence", F.lit(0.0))
    u = F.round(0.6 * (1 - F.abs(2 * p - 1)) + 0.4 * (1 - c), 4)
    return (alerts.where(F.col("status").isin("OPEN", "INVESTIGATING")).join(judged, "entity_id", "left_anti")
            .withColumn("uncertainty", u).orderBy(F.desc("uncertainty"), "alert_id").limit(limit))


def near_misses(scores: DataFrame, alerts: DataFrame, feedback: DataFrame, limit: int = 25, s=SETTINGS) -> DataFrame:
    """Wallets just under the alert threshold that are neither alerted nor judged."""
    done = alerts.select(F.col("entity_id").alias("address")).union(feedback.where("entity_id is not null").select("entity_id")).distinct()
    return (scores.where((F.col("p") >= s.near_miss_min) & (F.col("p") < s.alert_min_probability)).join(done, "address", "left_anti")
            .orderBy(F.desc("p"), "address").limit(limit))


def search(text: str, scores: DataFrame, transactions: DataFrame, observations: DataFrame, alerts: DataFrame, cases: DataFrame, limit: int = 6) -> DataFrame:
    """What a piece of text may mean, of every kind of object: (kind, id, detail, weight), up to ``limit`` rows a kind."""
    pre, sub = f"{text}%", f"%{text}%"
    row = lambda df, kind, i, detail, weight: df.select(F.lit(kind).alias("kind"), i.cast("string").alias("id"), detail.cast("string").alias("detail"), weight.cast("double").alias("weight"))
    top = lambda df, *order: df.orderBy(*order).limit(limit)
    wallets = top(scores.where(_like("address", pre)), F.desc("p"), "address")
    clusters = top(scores.where(_like("cluster_id", pre)).groupBy("cluster_id").agg(F.max("p").alias("p"), F.max(F.struct("p", "address")).alias("b")), F.desc("p"), "cluster_id")
    txs = top(transactions.where(F.col("txid").cast("string").ilike(pre)), F.desc("ts"), "txid")
    ips = top(observations.where(F.col("src_ip").like(pre)).groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"), F.min("country").alias("country")), F.desc("n"), "src_ip")
    found = top(alerts.where(_like("alert_id", pre) | _like("alert_type", sub)), F.desc("risk_score"), "alert_id")
    files = top(cases.where(_like("case_name", sub) | (F.col("case_id").cast("string") == text) | F.array_contains("suspect_entities", text)), "case_id")
    return (row(wallets, "wallet", F.col("address"), F.col("cluster_id"), 100 * F.col("p"))
            .unionByName(row(clusters, "cluster", F.col("cluster_id"), F.col("b.address"), 100 * F.col("p")))
            .unionByName(row(txs, "transaction", F.col("txid"), F.lit(""), F.lit(0.0)))
            .unionByName(row(ips, "ip", F.col("src_ip"), F.col("country"), F.col("n")))
            .unionByName(row(found, "alert", F.col("alert_id"), F.col("alert_type"), F.col("risk_score")))
            .unionByName(row(files, "case", F.col("case_id"), F.col("case_name"), F.lit(0.0))))


def activity_by_hour(tx: DataFrame, amounts: DataFrame) -> DataFrame:
    total = amounts.groupBy("txid").agg(F.sum("amount").alias("v"))
    return (tx.join(total, "txid", "left").groupBy(F.date_trunc("hour", "ts").alias("hour"))
            .agg(F.count(F.lit(1)).alias("transactions"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("volume_btc")))


def distribution(df: DataFrame, column: str, kind: str, top: int | None = None) -> DataFrame:
    d = df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    if top:
        d = d.orderBy(F.desc("n"), "name").limit(top)
    return d.select(F.lit(kind).alias("kind"), "name", "n")


def kpis(ledger: Ledger, observations: DataFrame, profiles: DataFrame, alerts: DataFrame) -> DataFrame:
    """Counts of the overview as (name, value) rows."""
    num = lambda df, name, e: df.agg(e.cast("double").alias("value")).select(F.lit(name).alias("name"), "value")
    one = F.count(F.lit(1))
    rows = [num(ledger.tx, "total_transactions", one), num(observations, "total_observations", one),
            num(ledger.tout, "total_volume_btc", F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 4)), num(profiles, "total_wallets", one),
            num(observations, "total_ips", F.count_distinct("src_ip")), num(profiles, "total_clusters", F.count_distinct("cluster_id")),
            num(alerts, "total_alerts", one), num(alerts, "open_alerts", F.sum((F.col("status") == "OPEN").cast("long"))),
            *[num(alerts, f"{s.lower()}_alerts", F.sum((F.col("severity") == s).cast("long"))) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def wallet_history(ledger: Ledger) -> DataFrame:
    """One row per (wallet, transaction): what it received and spent there, its role and the amount shown."""
    side = lambda df, name: df.groupBy("address", "txid").agg(F.sum("amount").alias(name), F.min("ts").alias("ts"))
    a, b = side(ledger.tout, "got"), side(ledger.tin, "spent")
    both = (a.select("address", "txid", "ts", "got", F.lit(0.0).alias("spent")).unionByName(b.select("address", "txid", "ts", F.lit(0.0).alias("got"), "spent"))
            .groupBy("address", "txid").agg(F.min("ts").alias("ts"), F.sum("got").alias("got"), F.sum("spent").alias("spent")))
    return both.withColumns({"role": F.when(F.col("spent") != 0, "SENDER").otherwise("RECIPIENT"),
                             "amount": F.round(F.when(F.col("spent") != 0, F.col("spent")).otherwise(F.col("got")), 8)})


def wallet_360(ledger: Ledger, clusters: DataFrame, seeds: DataFrame, members: int = 50) -> DataFrame:
    """Profile of every wallet: span, totals, balance, first relays, software fingerprints, and some fellow cluster members."""
    h = wallet_history(ledger).groupBy("address").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("transaction_count"),
        F.round(F.sum("got"), 8).alias("total_received"), F.round(F.sum("spent"), 8).alias("total_sent"), F.round(F.sum(F.col("got") - F.col("spent")), 8).alias("balance"))
    spends = ledger.tin.select("address", "txid").distinct()
    ips = spends.join(ledger.spy.select("txid", "spy_ip"), "txid").groupBy("address").agg(F.count_distinct("spy_ip").alias("n_ips"))
    soft = (spends.join(ledger.tx.where("tx_version is not null and rbf is not null").select("txid", "tx_version", F.coalesce("locktime", F.lit(0)).alias("locktime"), "rbf"), "txid")
            .groupBy("address", software_text(F.col("tx_version"), F.col("locktime"), F.col("rbf")).alias("fingerprint")).agg(F.count(F.lit(1)).alias("spends")))
    order = W.partitionBy("cluster_id").orderBy("address")
    some = (clusters.withColumn("k", F.row_number().over(order)).where(F.col("k") <= members + 1)
            .groupBy("cluster_id").agg(F.sort_array(F.collect_list("address")).alias("sample")))  # at most members + 1 each
    habit = soft.groupBy("address").agg(F.max(F.struct("spends", "fingerprint")).alias("s"), F.count(F.lit(1)).alias("n_fingerprints"))
    j = (h.join(clusters.select("address", "cluster_id", "size"), "address", "left").join(ips, "address", "left").join(habit, "address", "left")
         .join(some, "cluster_id", "left").join(seeds.select("address", F.lit(True).alias("is_seed")), "address", "left"))
    return j.select("address", "first_seen", "last_seen", "transaction_count", "total_received", "total_sent", "balance", "cluster_id", F.col("size").alias("cluster_size"),
                    F.coalesce("n_ips", F.lit(0)).alias("n_ips"), F.coalesce("is_seed", F.lit(False)).alias("is_seed"), F.col("s.fingerprint").alias("main_fingerprint"),
                    F.coalesce("n_fingerprints", F.lit(0)).alias("n_fingerprints"), F.slice(F.array_except("sample", F.array("address")), 1, members).alias("cluster_members"))


def software_text(version: Column, locktime: Column, rbf: Column) -> Column:
    lock = F.when(locktime == 0, "no locktime").when(locktime < 500_000_000, "anti-fee-sniping locktime").otherwise("time locktime")
    return F.concat(F.lit("version "), version.cast("string"), F.lit(" · "), lock, F.lit(" · "), F.when(rbf, "RBF on").otherwise("RBF off"))


def ip_360(observations: DataFrame, ledger: Ledger, alerts: DataFrame, tx_limit: int | None = None) -> DataFrame:
    """Every IP: observation statistics, wallets of the transactions it relayed first (of the ``tx_limit`` earliest, if given), and alerts among them."""
    stats = observations.groupBy("src_ip").agg(
        F.min("country").alias("country"), F.min("asn").alias("asn"), F.min("asn_type").alias("asn_type"), F.count(F.lit(1)).alias("observations"),
        F.count_distinct("txid").alias("tx_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    order = W.partitionBy("src_ip").orderBy("ts", "txid")
    first = ledger.spy.select("txid", F.col("spy_ip").alias("src_ip")).join(ledger.tx.select("txid", "ts"), "txid")
    if tx_limit is not None:
        first = first.withColumn("k", F.row_number().over(order)).where(F.col("k") <= tx_limit)
    wallets = first.select("src_ip", "txid").join(ledger.tin.select("txid", "address"), "txid").select("src_ip", "address").distinct()
    linked = (wallets.join(alerts.select(F.col("entity_id").alias("address"), "risk_score"), "address", "left").groupBy("src_ip")
              .agg(F.count(F.lit(1)).alias("linked_wallets"), F.count("risk_score").alias("flagged_wallets"), F.max("risk_score").alias("max_risk")))
    return stats.join(linked, "src_ip", "left").fillna(0, subset=["linked_wallets", "flagged_wallets"])


def tx_360(observations: DataFrame, tx: DataFrame, relays: int | None = None) -> DataFrame:
    """Every transaction with its relays (the earliest ``relays``, if given) in order of arrival: txid, step, ts, src_ip, ..."""
    order = W.partitionBy("txid").orderBy("ts", "src_ip")
    o = observations.withColumn("step", F.row_number().over(order).cast("long"))
    if relays is not None:
        o = o.where(F.col("step") <= relays)
    return tx.select("txid", F.col("ts").alias("tx_ts"), "fee").join(o, "txid")


def timeline(ledger: Ledger, shapes: DataFrame, wallets: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` transactions of every chosen wallet as ordered events.

    Peel: one input, two outputs, the small one under a quarter of the large one. Split: five outputs or more."""
    rows = wallet_history(ledger).join(wallets.select("address"), "address", "left_semi")
    order = W.partitionBy("address").orderBy("ts", "txid")
    e = rows.withColumn("step", F.row_number().over(order).cast("long")).where(F.col("step") <= limit)
    j = e.join(shapes.select("txid", "n_in", "n_out", "min_out", "max_out", "total_out", F.col("fee").alias("fee_btc")), "txid")
    return j.select("address", "step", "txid", "ts", F.col("n_in").alias("inputs_count"), F.col("n_out").alias("outputs_count"), F.col("total_out").alias("amount_btc"), "fee_btc",
                    F.when(F.col("spent") != 0, "OUT").otherwise("IN").alias("direction"),
                    ((F.col("n_in") == 1) & (F.col("n_out") == 2) & (F.col("min_out") < 0.25 * F.col("max_out"))).alias("is_peel"), (F.col("n_out") >= 5).alias("is_split"))


def locate(df: DataFrame, places: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Real coordinates if present, else the country's centroid (a table of about 120 rows), else the row is dropped."""
    p = places.select(F.col("country").alias("__c"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    has = (F.coalesce(lat, F.lit(0.0)) != 0) | (F.coalesce(lon, F.lit(0.0)) != 0)
    j = df.join(F.broadcast(p), F.upper("country") == F.col("__c"), "left").withColumn("__has", has)
    j = j.withColumns({"approximate": ~F.col("__has"), lat: F.when(F.col("__has"), F.col(lat)).otherwise(F.col("__lat")), lon: F.when(F.col("__has"), F.col(lon)).otherwise(F.col("__lon"))})
    return j.where(F.col(lat).isNotNull()).drop("__c", "__lat", "__lon", "__has")


def geo_points(observations: DataFrame, places: DataFrame, limit: int = 2000) -> DataFrame:
    g = (observations.groupBy("src_ip").agg(F.min("country").alias("country"), F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.min("asn_type").alias("asn_type"), F.count(F.lit(1)).alias("tx_count"))
         .orderBy(F.desc("tx_count"), "src_ip").limit(limit))
    return locate(g, places)


def impossible_travel(spends: DataFrame, top: int = 25, s=SETTINGS) -> DataFrame:
    """Fastest impossible move per pair of countries. spends: address, txid, ts, country, lat, lon, src_ip (located)."""
    moved = previous_row(spends, "address", "ts", ["txid"], ["lat", "lon", "country", "src_ip"]).where("prev is not null")
    km, speed = speed_kmh("prev")
    fast = (moved.where((F.col("prev.lat") != F.col("lat")) | (F.col("prev.lon") != F.col("lon")))
            .select(F.col("prev.country").alias("from_country"), F.col("country").alias("to_country"), "address", "txid", F.col("prev.src_ip").alias("from_ip"), F.col("src_ip").alias("to_ip"),
                    km.alias("distance_km"), speed.alias("speed_kmh")).where(F.col("speed_kmh") >= s.impossible_travel_kmh))
    best = fast.groupBy("from_country", "to_country").agg(F.max(F.struct(F.round("speed_kmh", 3).alias("speed_kmh"), "address", "txid", "from_ip", "to_ip", "distance_km")).alias("b"))
    return best.select("from_country", "to_country", "b.*").orderBy(F.desc("speed_kmh"), "from_country", "to_country").limit(top)


def live_rate(tx: DataFrame, time: str, minutes: int, now: Column) -> DataFrame:
    """Stored transactions per minute in the last ``minutes``."""
    recent = tx.where((F.col(time) >= now - F.expr(f"interval {minutes} minutes")) & (F.col(time) <= now))
    return recent.groupBy(F.window(time, "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("minute"), "n")


def actions_summary(alerts: DataFrame) -> DataFrame:
    return (alerts.where("recommended_action is not null").groupBy(F.get_json_object("recommended_action", "$.action").alias("action")).agg(F.count(F.lit(1)).alias("n")))


def known_entities_summary(known: DataFrame) -> DataFrame:
    return known.groupBy("entity_name", "entity_type", "country", "in_jurisdiction").agg(F.count(F.lit(1)).alias("addresses"))


def case_summary(cases: DataFrame, alerts: DataFrame) -> DataFrame:
    s = cases.select("case_id", "case_name", "status", F.explode_outer("suspect_entities").alias("entity_id"))
    return (s.join(alerts.select("entity_id", "alert_id", "risk_score"), "entity_id", "left").groupBy("case_id", "case_name", "status")
            .agg(F.count("entity_id").alias("suspects"), F.count("alert_id").alias("alert_count"), F.max("risk_score").alias("max_risk")))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    return feedback.where("entity_id is not null").agg(F.count_distinct("entity_id").alias("verdicts"))


AUDIT_FIELDS = ["prev_hash", "id", "created_at", "action", "investigator", "entity_type", "entity_id", "details"]


def audit_row_hash() -> Column:
    """SHA-256 over the compact JSON list of the previous hash and the row's fields."""
    inner = lambda c: F.expr(f"substring(to_json(array(cast({c} as string))), 2, length(to_json(array(cast({c} as string)))) - 2)")
    parts = [F.col("id").cast("string") if c == "id" else inner(c) for c in AUDIT_FIELDS]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def verify_audit_chain(audit: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """Rows of the audit trail that break the chain: (id, reason). Rows without a hash are from before the chain and are skipped.

    The previous row's hash comes from the same chunk of ids or, at a chunk border, from one summary row per chunk."""
    h = audit.where("row_hash is not null and row_hash <> ''").withColumn("__k", F.lit(1))
    h = previous_row(h.withColumn("__t", F.timestamp_micros("id")), "__k", "__t", ["id"], ["row_hash"], bucket_us=chunk)
    edited = audit_row_hash() != F.col("row_hash")
    broken = F.col("prev").isNotNull() & (F.col("prev.row_hash") != F.col("prev_hash"))
    return h.where(edited | broken).select("id", F.when(edited, "row edited").otherwise("row missing before this one").alias("reason"))


def audit_report(audit: DataFrame) -> DataFrame:
    """One row: whether the chain is intact, rows, rows without a hash, and the first bad row."""
    bad = verify_audit_chain(audit).agg(F.min(F.struct("id", "reason")).alias("b"), F.lit(1).alias("one"))
    n = audit.agg(F.count(F.lit(1)).alias("rows"), F.sum((F.coalesce("row_hash", F.lit("")) == "").cast("long")).alias("legacy_unchained"), F.lit(1).alias("one"))
    return n.join(bad, "one").select(F.col("b").isNull().alias("intact"), "rows", "legacy_unchained", F.col("b.id").alias("first_bad_id"), F.col("b.reason").alias("reason"))


def canonical_record() -> Column:
    """Canonical JSON text of a transaction record: keys in alphabetical order, amounts with eight decimals."""
    eight = lambda c: c.cast("decimal(24,8)").cast("string")
    names = lambda c: F.concat(F.lit('["'), F.array_join(c, '", "'), F.lit('"]'))
    values = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, eight), ", "), F.lit("]"))
    return F.concat(
        F.lit('{"fee": '), eight(F.col("fee")), F.lit(', "input_addresses": '), names("input_addresses"), F.lit(', "input_amounts": '), values("input_amounts"),
        F.lit(', "output_addresses": '), names("output_addresses"), F.lit(', "output_amounts": '), values("output_amounts"),
        F.lit(', "src_ip": "'), F.coalesce("src_ip", F.lit("")), F.lit('", "timestamp": "'), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"),
        F.lit('", "txid": "'), F.col("txid").cast("string"), F.lit('"}'))


def record_hashes(records: DataFrame) -> DataFrame:
    return records.select("txid", F.sha2(canonical_record(), 256).alias("record_sha256"))


def records_root(hashes: DataFrame, certificate: str) -> DataFrame:
    """One digest per certificate over its sorted record hashes. A certificate lists at most 200 records."""
    joined = F.concat(F.lit('["'), F.array_join(F.array_sort(F.collect_list("record_sha256")), '", "'), F.lit('"]'))
    return hashes.groupBy(certificate).agg(F.sha2(joined, 256).alias("records_root_sha256"), F.count(F.lit(1)).alias("records"))


def changed_records(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Records whose hash no longer equals the stored one."""
    return record_hashes(records).join(stored.select("txid", F.col("record_sha256").alias("stored")), "txid").where("record_sha256 <> stored").select("txid")


def deposit_annex(exits: DataFrame) -> DataFrame:
    """Per alert the deposits at one exchange (one in jurisdiction if there is any, else the nearest), with their period."""
    v = exits.where("entity_type = 'VASP'")
    choice = F.struct(F.when(F.col("in_jurisdiction"), 0).otherwise(1).alias("rank"), "hop", "deposit_us", "vasp")
    pick = v.groupBy("start").agg(F.min(choice).alias("c")).select("start", F.col("c.vasp").alias("vasp"))
    return (v.join(pick, ["start", "vasp"]).groupBy("start", "vasp").agg(
        F.count(F.lit(1)).alias("deposits"), F.round(F.sum("amount_btc"), 8).alias("amount_btc"), F.min("deposit_us").alias("period_from_us"), F.max("deposit_us").alias("period_to_us"),
        F.bool_or("in_jurisdiction").alias("in_jurisdiction")))


def referral_dossier(alerts: DataFrame, profiles: DataFrame, evidence: DataFrame, exits: DataFrame, ips: DataFrame, top_ips: int = 20, top_exposure: int = 25) -> DataFrame:
    """One nested row per alert: subject, assessment, directive, trail, exposure and the relaying IPs."""
    w = W.partitionBy("start").orderBy("hop", "deposit_us", "txid", "deposit_address")
    seen = (exits.where("entity_type = 'VASP'").withColumn("k", F.row_number().over(w)).where(F.col("k") <= top_exposure).groupBy(F.col("start").alias("entity_id"))
            .agg(F.sort_array(F.collect_list(F.struct("k", "vasp", "txid", "hop", "amount_btc"))).alias("exposure")))
    wi = W.partitionBy("address").orderBy(F.desc("tx_count"), "spy_ip")
    relays = (ips.withColumn("k", F.row_number().over(wi)).where(F.col("k") <= top_ips).groupBy(F.col("address").alias("entity_id"))
              .agg(F.sort_array(F.collect_list(F.struct("k", "spy_ip", "tx_count"))).alias("relaying_ips")))
    j = (alerts.join(profiles.withColumnRenamed("address", "entity_id"), "entity_id", "left").join(evidence.withColumnRenamed("address", "entity_id"), "entity_id", "left")
         .join(seen, "entity_id", "left").join(relays, "entity_id", "left"))
    return j.select("alert_id", F.struct("entity_id", "cluster_id", "total_received", "total_sent", "balance", "transaction_count").alias("subject"),
                    F.struct("typology", "risk_score", "severity", "calibrated_confidence").alias("assessment"), F.col("action").alias("directive"),
                    F.struct(F.col("txid").alias("key_transaction"), "top_txids").alias("money_trail"), "exposure", F.struct("first_spy_ip", "first_spy_asn_type", "relaying_ips").alias("network_evidence"))


def evidence_txids(evidence: DataFrame, exits: DataFrame, cap: int = 200) -> DataFrame:
    """Distinct transactions behind each alert in order of importance: key, top ones, then the nearest deposits and their paths."""
    near = (exits.withColumn("kind", F.when(F.col("entity_type") == "VASP", 0).otherwise(1)).withColumn("k", F.row_number().over(W.partitionBy("start", "kind").orderBy("hop", "deposit_us", "txid", "deposit_address")))
            .where("k <= 3").groupBy(F.col("start").alias("address"))
            .agg(F.sort_array(F.collect_list(F.struct("kind", "k", F.concat(F.array(F.col("txid").cast("string")), "path").alias("ids")))).alias("d"))
            .select("address", F.flatten("d.ids").alias("more")))
    ids = F.concat(F.array(F.col("txid").cast("string")), F.transform("top_txids", lambda x: x.cast("string")), F.coalesce("more", F.array().cast("array<string>")))
    return evidence.join(near, "address", "left").select("address", F.slice(F.array_distinct(ids), 1, cap).alias("txids"))


def data_health(tx: DataFrame, alerts: DataFrame, labels: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name), F.lit(1).alias("one"))
    j = n(tx, "transactions").join(n(alerts, "alerts"), "one").join(n(labels, "labels"), "one")
    origin = F.when(F.col("transactions") == 0, "empty").when(F.col("labels") > 0, "synthetic").otherwise("operational")
    return j.select("transactions", "alerts", origin.alias("data_origin"))
