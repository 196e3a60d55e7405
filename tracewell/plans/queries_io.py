"""Queries for ingestion, enrichment and exports. Input files are written from the given tables, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewell.functions.columns import swap_memo
from tracewell.operators import enrich as En
from tracewell.operators import investigator as I
from tracewell.plans import queries_alerts as Qa
from tracewell.plans import queries_read as Qr
from tracewell.plans.oracle import cte, r, with_ctes
from tracewell.plans.queries_ledger import r6, transactions
from tracewell.plans.registry import query
from tracewell.session import shared_dir
from tracewell.sources import exports as Ex
from tracewell.sources import ingest as In

# -- files to ingest: relays of adapter N with the transaction's lists, in awkward shapes ------------
cte("recs", ("obs", "txarr", "tx"), """
  SELECT o.txid AS t, lower(lpad(to_hex(o.txid), 12, '0')) AS txid, o.ts, o.src_ip, o.src_port, a.input_addresses AS ia, a.input_amounts AS im, a.output_addresses AS oa, a.output_amounts AS om, a.fee,
         tx.script_type, tx.tx_version, tx.locktime, tx.rbf, tx.op_return, CASE WHEN o.txid % 50 = 7 THEN 'txid' WHEN o.txid % 50 = 8 THEN 'src_port' WHEN o.txid % 50 = 9 THEN 'timestamp' WHEN o.txid % 50 = 10 THEN 'missing' WHEN o.txid % 50 = 11 THEN 'rbf' END AS fault
  FROM obs o JOIN txarr a USING (txid) JOIN tx USING (txid)""")


def raw_records(fx):
    """One row per relay with everything as text. Files are written from it as they come out of the join: no copy, no second shuffle."""
    t = transactions(fx).select("txid", "input_addresses", "input_amounts", "output_addresses", "output_amounts", "fee", "script_type", "tx_version", "locktime", "rbf", "op_return")
    o = fx.obs.select("txid", "ts", "src_ip", "src_port").join(t, "txid")
    x = F.col("txid")
    eight = lambda c: F.transform(c, lambda v: v.cast("decimal(24,8)").cast("string"))
    when = (F.when(x % 50 == 9, "yesterday").when(x % 3 == 0, F.unix_millis("ts").cast("string")).when(x % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
            .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return o.select(
        when.alias("observed_at"), F.when(x % 50 == 7, "not-hex!").otherwise(F.upper(F.lpad(F.hex("txid"), 12, "0"))).alias("Tx_Hash"), F.when(x % 50 != 10, F.col("src_ip")).alias("peer_ip"),
        F.when(x % 50 == 8, "70000").otherwise(F.col("src_port").cast("string")).alias("sport"), F.array_join("input_addresses", ";").alias("senders"), F.array_join(eight("input_amounts"), ";").alias("in_amounts"),
        F.array_join("output_addresses", ",").alias("receivers"), F.array_join(eight("output_amounts"), ",").alias("out_amounts"), F.when(x % 2 == 0, F.col("fee").cast("decimal(24,8)").cast("string")).alias("tx_fee"),
        F.lower("script_type").alias("script"), F.col("tx_version").cast("string").alias("version"), F.col("locktime").cast("string").alias("nlocktime"),
        F.when(x % 50 == 11, "perhaps").otherwise(F.when(F.col("rbf"), "yes").otherwise("0")).alias("opt_in_rbf"), F.col("op_return").alias("memo"),
        "input_addresses", "input_amounts", "output_addresses", "output_amounts", x.alias("__x"))


TEXT_COLUMNS = ["observed_at", "Tx_Hash", "peer_ip", "sport", "senders", "in_amounts", "receivers", "out_amounts", "tx_fee", "script", "version", "nlocktime", "opt_in_rbf", "memo"]


def folder(fx, label):
    key = f"_dir_{label}"
    if not hasattr(fx, key):
        setattr(fx, key, f"{shared_dir(fx.spark)}/files-{label}-{uuid.uuid4().hex[:8]}")
        return getattr(fx, key), True
    return getattr(fx, key), False


def csv_files(fx):
    path, new = folder(fx, "csv")
    if new:
        raw_records(fx).select(*TEXT_COLUMNS).write.option("header", True).csv(path)
    return path


def json_files(fx):
    path, new = folder(fx, "json")
    if new:
        side = lambda a, v: F.transform(F.arrays_zip(a, v), lambda p: F.struct(p[a].alias("address"), p[v].alias("value")))
        raw_records(fx).withColumns({"senders": side("input_addresses", "input_amounts"), "receivers": side("output_addresses", "output_amounts")}).select(
            *[c for c in TEXT_COLUMNS if c not in ("in_amounts", "out_amounts")]).write.json(path)
    return path


def xml_files(fx):
    path, new = folder(fx, "xml")
    if new:
        part = lambda a, v: F.transform(F.arrays_zip(a, v), lambda p: F.struct(p[a].alias("_address"), p[v].cast("decimal(24,8)").cast("string").alias("_amount")))
        rows = raw_records(fx).where("__x % 50 not in (10)").select(
            F.col("Tx_Hash").alias("_txid"), F.col("observed_at").alias("_timestamp"), F.col("tx_fee").alias("fee"), F.col("script").alias("script_type"), F.struct(F.col("peer_ip").alias("_src_ip"), F.col("sport").alias("_src_port")).alias("net"),
            F.struct(part("input_addresses", "input_amounts").alias("in")).alias("inputs"), F.struct(part("output_addresses", "output_amounts").alias("out")).alias("outputs"),
            F.col("version").alias("tx_version"), F.col("nlocktime").alias("locktime"), F.col("opt_in_rbf").alias("rbf"))
        rows.write.format("xml").option("rootTag", "txs").option("rowTag", "tx").save(path)
    return path


def record_view(c, bad=False):
    """What the checks compare: identity, time, sizes, sums and the optional fields."""
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x), 8)
    return c.select("txid", F.unix_millis("timestamp").alias("ts_ms"), "src_ip", F.col("src_port").cast("long").alias("src_port"), F.size("input_addresses").cast("long").alias("n_in"), total("input_amounts").alias("sum_in"),
                    F.size("output_addresses").cast("long").alias("n_out"), total("output_amounts").alias("sum_out"), F.round("fee", 8).alias("fee"), "script_type",
                    F.coalesce("tx_version", F.lit(-1)).cast("long").alias("tx_version"), "locktime", F.coalesce(F.col("rbf").cast("int"), F.lit(-1)).alias("rbf"))


def _view_sql(fee, where="fault IS NULL"):
    return f"""
    SELECT txid, epoch_ms(ts) AS ts_ms, src_ip, CAST(src_port AS BIGINT) AS src_port, len(ia) AS n_in, {r('list_sum(im)', 8)} AS sum_in, len(oa) AS n_out, {r('list_sum(om)', 8)} AS sum_out, {fee} AS fee, script_type,
           CAST(coalesce(tx_version, -1) AS BIGINT) AS tx_version, locktime, CAST(rbf AS INT) AS rbf FROM recs WHERE {where}"""


SUM_FEE = f"CASE WHEN t % 2 = 0 THEN fee ELSE {r('greatest(0, round(list_sum(im) - list_sum(om), 8))', 8)} END"


def ingested(fx, kind):
    path = {"csv": csv_files, "json": json_files, "xml": xml_files}[kind](fx)
    return In.ingest({"csv": In.read_csv, "json": In.read_json, "xml": In.read_xml}[kind](fx.spark, path))


def accepted(fx, kind):
    return In.validate_split(ingested(fx, kind))[0]


@query("in1_read_csv", with_ctes(["recs"], _view_sql(SUM_FEE)))
def in1(fx):
    return record_view(accepted(fx, "csv"))


@query("in2_read_json", with_ctes(["recs"], _view_sql(SUM_FEE)))
def in2(fx):
    return record_view(accepted(fx, "json"))


@query("in3_read_xml", with_ctes(["recs"], _view_sql("CASE WHEN t % 2 = 0 THEN fee ELSE 0 END")))
def in3(fx):
    return record_view(accepted(fx, "xml"))


@query("in4_map_columns", with_ctes(["recs"], """
    SELECT fault IS DISTINCT FROM 'missing' AS has_ip, count(*) AS n, count(DISTINCT CASE WHEN fault = 'txid' THEN 'not-hex!' ELSE txid END) AS txs FROM recs GROUP BY 1""").replace("AS has_ip", "AS b").replace("SELECT fault IS DISTINCT FROM 'missing' AS b", "SELECT CAST(fault IS DISTINCT FROM 'missing' AS INT) AS has_ip"))
def in4(fx):
    m = In.map_columns(In.read_csv(fx.spark, csv_files(fx)))
    return m.groupBy(F.col("src_ip").isNotNull().cast("int").alias("has_ip")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("txid").alias("txs"))


@query("in5_coerce", with_ctes(["recs"], f"""
    SELECT date_trunc('month', ts)::DATE::VARCHAR AS month, count(*) AS n, {r('sum(fee)', 8)} AS fees, {r('sum(list_sum(om)) / 1e8', 8)} AS btc_from_satoshi FROM (SELECT ts, CASE WHEN t % 2 = 0 THEN fee / 1e8 ELSE {r('greatest(0, round(list_sum(im) / 1e8 - list_sum(om) / 1e8, 8))', 8)} END AS fee, om FROM recs WHERE fault IS NULL) GROUP BY 1"""))
def in5(fx):
    """The same file read with amounts given in satoshis."""
    c = In.coerce(In.map_columns(In.read_csv(fx.spark, csv_files(fx))), "sat").where(F.size("problems") == 0)
    total = F.aggregate("output_amounts", F.lit(0.0), lambda a, x: a + x)
    return c.groupBy(F.date_format("timestamp", "yyyy-MM-01").alias("month")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("fee"), 8).alias("fees"), r6(F.sum(total), 8).alias("btc_from_satoshi"))


@query("in6_validate_split", with_ctes(["recs"], """
    SELECT CASE fault WHEN 'txid' THEN 'txid: invalid hex format' WHEN 'src_port' THEN 'src_port: not in 1-65535' WHEN 'timestamp' THEN 'timestamp: not a date' WHEN 'missing' THEN 'missing required field(s): src_ip'
           ELSE 'rbf: cannot be read as true/false' END AS reason, count(*) AS n FROM recs WHERE fault IS NOT NULL GROUP BY 1"""))
def in6(fx):
    _, bad = In.validate_split(ingested(fx, "csv"))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("in7_ingest_counts", with_ctes(["recs"], "SELECT count(*) AS rows_read, count(*) FILTER (fault IS NULL) AS records, count(*) FILTER (fault IS NOT NULL) AS quarantined, CAST(1 AS INT) AS hashed FROM recs"))
def in7(fx):
    """Counts per file added up, and whether every file that was read has a SHA-256."""
    n = In.ingest_counts(ingested(fx, "csv"))
    j = n.join(In.file_hashes(fx.spark, csv_files(fx)), "source_file", "left")
    return j.agg(F.sum("rows_read").alias("rows_read"), F.sum("records").alias("records"), F.sum("quarantined").alias("quarantined"), F.bool_and(F.length("sha256") == 64).cast("int").alias("hashed"))


@query("in9_first_observation", with_ctes(["recs"], """
    SELECT txid, arg_min(src_ip, (epoch_ms(ts), src_ip)) AS src_ip, min(epoch_ms(ts)) AS ts_ms FROM recs WHERE fault IS NULL AND t % 3 = 0 GROUP BY 1
    UNION ALL SELECT txid, arg_min(src_ip, (ts, src_ip)), min(epoch_ms(ts)) FROM recs WHERE fault IS NULL AND t % 3 <> 0 GROUP BY 1"""))
def in9(fx):
    """Two batches in reverse order, merged: the earliest record of each transaction stays."""
    rec = fx._stage("io-accepted-csv", lambda: accepted(fx, "csv"))  # read by both batches
    late, early = rec.where(F.col("src_port") == 18333), rec.where(F.col("src_port") != 18333)
    return In.merge_first(In.first_observation(late), early).select("txid", "src_ip", F.unix_millis("timestamp").alias("ts_ms"))


@query("in10_dedup_observations", with_ctes(["obs"], "SELECT DISTINCT txid, src_ip, epoch_ms(ts) AS ts_ms FROM obs"))
def in10(fx):
    twice = fx.obs.unionByName(fx.obs.where("txid % 5 = 0"))
    return In.dedup_observations(twice).select("txid", "src_ip", "ts_ms")


def _write_csv(fx, label, df):
    path, new = folder(fx, label)
    if new:
        df.write.option("header", True).csv(path)
    return path


@query("in11_load_seeds", with_ctes(["seeds"], """
    SELECT address, 'RANSOMWARE' AS threat_type, 'seed list' AS incident_name, 0.9::DOUBLE AS confidence, 'SEED_FILE' AS source FROM seeds"""))
def in11(fx):
    path = _write_csv(fx, "seeds", fx.seeds.select(F.col("address").alias("Address"), F.lit("RANSOMWARE").alias("Label")))
    return In.load_seeds(fx.spark, path)


@query("in12_load_known_entities", with_ctes(["known"], "SELECT address, entity_name, entity_type, 'XX' AS country, CAST(in_jurisdiction AS INT) AS in_jurisdiction, 'INTEL_FILE' AS source FROM known"))
def in12(fx):
    k = fx.known.select(F.concat(F.lit(" "), F.col("address")).alias("address"), "entity_name", F.lower("entity_type").alias("entity_type"), F.when(F.col("in_jurisdiction"), "true").otherwise("maybe").alias("in_jurisdiction"))
    path = _write_csv(fx, "known", k)
    return In.upsert(In.load_known_entities(fx.spark, path).limit(0), In.load_known_entities(fx.spark, path)).withColumn("in_jurisdiction", F.col("in_jurisdiction").cast("int"))


@query("in13_load_labels", with_ctes(["truth"], "SELECT address, typology, CAST(entity_id AS VARCHAR) AS entity_id, CAST(is_illicit AS VARCHAR) AS is_illicit FROM truth"))
def in13(fx):
    return In.load_labels(fx.spark, _write_csv(fx, "labels", fx.labels.select("address", "typology", "entity_id", "is_illicit")))


SDN_SQL = """
  sdn AS MATERIALIZED (SELECT s_suppkey AS uid, s_name AS last_name, 'A' || CAST(s_suppkey * 3 AS VARCHAR) AS a1, 'A' || CAST((s_suppkey // 2) * 6 AS VARCHAR) AS a2, s_nationkey FROM supplier)"""


def sdn_files(fx):
    path, new = folder(fx, "sdn")
    if new:
        k = F.col("s_suppkey")
        one = lambda kind, num: F.struct(F.lit("1").alias("uid"), F.lit(kind).alias("idType"), num.alias("idNumber"))
        ids = F.array(one(In.XBT_ID, F.concat(F.lit("A"), (k * 3).cast("string"))), one(In.XBT_ID, F.concat(F.lit("A"), (F.floor(k / 2) * 6).cast("string"))), one("Passport", F.concat(F.lit("P"), k.cast("string"))))
        fx.t.supplier.select(k.alias("uid"), F.lit("Test").alias("firstName"), F.col("s_name").alias("lastName"), F.lit("Entity").alias("sdnType"),
                             F.struct(F.array(F.lit("CYBER2"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).alias("program")).alias("programList"), F.struct(ids.alias("id")).alias("idList")
                             ).write.format("xml").option("rootTag", "sdnList").option("rowTag", "sdnEntry").save(path)
    return path


@query("in14_sanctions_seeds", with_ctes(["addr"], """
    SELECT address, 'SANCTIONED' AS threat_type, 'OFAC SDN #' || CAST(u AS VARCHAR) || ': Test ' || n || ' [CYBER2, N' || CAST(k AS VARCHAR) || ']' AS incident_name, 1.0::DOUBLE AS confidence FROM (
      SELECT a AS address, min(uid) AS u, arg_min(last_name, uid) AS n, arg_min(s_nationkey, uid) AS k FROM (SELECT a1 AS a, uid, last_name, s_nationkey FROM sdn UNION ALL SELECT a2, uid, last_name, s_nationkey FROM sdn) GROUP BY 1)
    WHERE address IN (SELECT address FROM addr)""", extra=SDN_SQL))
def in14(fx):
    return In.seen_in_ledger(In.sanctions_seeds(fx.spark, sdn_files(fx)), fx.addresses).drop("source")


# -- enrichment ------------------------------------------------------------------------------------
cte("iprange", (), """
  SELECT '10.0.' || CAST(x AS VARCHAR) || '.0' AS start_ip, '10.0.' || CAST(x AS VARCHAR) || '.255' AS end_ip, CAST(x * 256 AS BIGINT) AS s, CAST(x * 256 + 255 AS BIGINT) AS e, 'W' || CAST(x % 7 AS VARCHAR) AS country, 'AS' || CAST(100 + x % 9 AS VARCHAR) AS asn
  FROM (SELECT DISTINCT s_suppkey // 256 AS x FROM supplier)
  UNION ALL
  SELECT '', '', CAST(k AS BIGINT), CAST(k + 15 AS BIGINT), 'N' || CAST(k % 5 AS VARCHAR), 'AS' || CAST(200 + k % 11 AS VARCHAR) FROM (SELECT DISTINCT (s_suppkey // 16) * 16 AS k FROM supplier) WHERE (k // 16) % 3 = 0""")


def ip_ranges(fx):
    s = fx.t.supplier
    ip = lambda n: F.concat(F.lit("10.0."), F.floor(n / 256).cast("string"), F.lit("."), (n % 256).cast("string"))
    x = F.floor(F.col("s_suppkey") / 256) * 256
    wide = s.select(x.alias("k")).distinct().select(ip(F.col("k")).alias("start_ip"), ip(F.col("k") + 255).alias("end_ip"), F.concat(F.lit("W"), (F.col("k") / 256).cast("long") % 7).alias("country"), F.concat(F.lit("AS"), (100 + (F.col("k") / 256).cast("long") % 9).cast("string")).alias("asn"))
    y = F.floor(F.col("s_suppkey") / 16) * 16
    narrow = s.select(y.alias("k")).distinct().where("(k div 16) % 3 = 0").select(ip(F.col("k")).alias("start_ip"), ip(F.col("k") + 15).alias("end_ip"), F.concat(F.lit("N"), (F.col("k") % 5).cast("string")).alias("country"), F.concat(F.lit("AS"), (200 + F.col("k") % 11).cast("string")).alias("asn"))
    return wide.unionByName(narrow)


RANGE_SQL = """
  hit AS MATERIALIZED (SELECT k.src_ip, arg_min(country, e - s) AS country, arg_min(asn, e - s) AS asn FROM (SELECT DISTINCT src_ip, CAST(split_part(src_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(src_ip, '.', 4) AS BIGINT) AS n FROM obs) k JOIN iprange ON n BETWEEN s AND e GROUP BY 1)"""


def located_obs(fx):
    return En.ip_range_join(fx.obs.select("txid", "ts", "src_ip").unionByName(fx.obs.where("txid % 40 = 0").select("txid", "ts", F.lit("no address").alias("src_ip"))), ip_ranges(fx))


@query("en1_ip_range_join", with_ctes(["obs", "iprange"], """
    SELECT o.src_ip, coalesce(country, 'XX') AS country, coalesce(asn, 'AS_UNKNOWN') AS asn, count(*) AS n FROM (SELECT src_ip FROM obs UNION ALL SELECT 'no address' FROM obs WHERE txid % 40 = 0) o LEFT JOIN hit USING (src_ip) GROUP BY 1, 2, 3""", extra=RANGE_SQL))
def en1(fx):
    return located_obs(fx).groupBy("src_ip", "country", "asn").agg(F.count(F.lit(1)).alias("n"))


@query("en2_asn_type", with_ctes(["obs", "iprange"], """
    SELECT o.src_ip, CASE WHEN o.src_ip LIKE '%7' THEN 'TOR_EXIT' WHEN asn IS NULL THEN 'UNKNOWN' ELSE ['RESIDENTIAL','DATACENTER','VPN','BULLETPROOF'][CAST(substr(asn, 3) AS BIGINT) % 4 + 1] END AS asn_type, count(*) AS n
    FROM (SELECT src_ip FROM obs UNION ALL SELECT 'no address' FROM obs WHERE txid % 40 = 0) o LEFT JOIN hit USING (src_ip) GROUP BY 1, 2""", extra=RANGE_SQL))
def en2(fx):
    kinds = F.array(*[F.lit(x) for x in ("RESIDENTIAL", "DATACENTER", "VPN", "BULLETPROOF")])
    types = ip_ranges(fx).select(F.substring("asn", 3, 9).cast("long").alias("asn")).distinct().withColumn("type", F.element_at(kinds, (F.col("asn") % 4 + 1).cast("int")))
    exits = fx.obs.where("src_ip like '%7'").select(F.col("src_ip").alias("ip")).distinct()
    return En.asn_type(located_obs(fx), types, exits).groupBy("src_ip", "asn_type").agg(F.count(F.lit(1)).alias("n"))


@query("en3_locate", with_ctes(["obs", "place"], """
    SELECT o.country, CASE WHEN txid % 3 = 0 THEN 0 ELSE 1 END AS given, round(avg(CASE WHEN txid % 3 = 0 THEN p.lat ELSE o.lat + 1 END), 6) AS lat, count(*) AS n FROM obs o JOIN place p USING (country) GROUP BY 1, 2"""))
def en3(fx):
    o = fx.obs.withColumns({"lat": F.when(F.col("txid") % 3 != 0, F.col("lat") + 1), "lon": F.when(F.col("txid") % 3 != 0, F.col("lon"))})
    return I.locate(o, fx.centroids).groupBy("country", (~F.col("approximate")).cast("int").alias("given")).agg(r6(F.avg("lat")).alias("lat"), F.count(F.lit(1)).alias("n"))


@query("en4_swap_memo", with_ctes(["tx"], """
    SELECT txid, 'ETH.ETH' AS asset, 'ETH' AS destination_chain, '0x' || CAST(txid AS VARCHAR) AS destination_address, '1000' AS limit_text FROM tx WHERE op_return LIKE '=:%'"""))
def en4(fx):
    return fx.tx_a.select("txid", swap_memo(F.col("op_return")).alias("m")).where("m is not null").select("txid", "m.*")


# -- exports -----------------------------------------------------------------------------------------
def export_profiles(fx):
    return Qr.profiles(fx).select("address", F.round(100 * F.col("p"), 1).alias("risk_score"), F.lit("MIXING").alias("typology"), "cluster_id")


@query("out1_export_graph_csv", with_ctes(["tin", "tout", "tx", "obs", "spy", "profiles"], f"""
    SELECT 'wallets' AS file, count(*) AS n, {r('sum(round(100 * p, 1))', 4)} AS total FROM profiles UNION ALL SELECT 'transactions', count(*), {r('sum(fee)', 4)} FROM tx UNION ALL SELECT 'ips', count(DISTINCT src_ip), 0 FROM obs
    UNION ALL SELECT 'spends', count(*), {r('sum(amount)', 4)} FROM tin UNION ALL SELECT 'pays', count(*), {r('sum(amount)', 4)} FROM tout
    UNION ALL SELECT 'relayed', count(*), count(*) FILTER (src_ip = spy_ip) FROM (SELECT DISTINCT src_ip, txid FROM obs) JOIN spy USING (txid)"""))
def out1(fx):
    """All six files are written and read back."""
    path, new = folder(fx, "graph")
    if new:
        Ex.write_graph(Ex.graph_tables(fx.a, export_profiles(fx), fx.obs), path)
    num = {"wallets": F.col("`risk:float`").cast("double"), "transactions": F.col("`fee:float`").cast("double"), "ips": F.lit(0.0), "spends": F.col("`amount:float`").cast("double"),
           "pays": F.col("`amount:float`").cast("double"), "relayed": F.col("`first_seen:boolean`").cast("boolean").cast("int").cast("double")}
    out = None
    for name, value in num.items():
        row = fx.spark.read.option("header", True).csv(f"{path}/{name}").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(value), 4).alias("total")).select(F.lit(name).alias("file"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


def export_alerts(fx):
    e = Qr.evidence(fx).select(F.col("address").alias("entity_id"), F.col("txid").cast("string").alias("key_txid"), "first_spy_ip", "first_spy_asn_type", "first_spy_confidence")
    a = Qr.alert_table(fx).join(e, "entity_id", "left").withColumn("reasons", F.array("typology"))
    return a.withColumns({"first_relay_ip": F.col("first_spy_ip"), "first_relay_asn_type": F.col("first_spy_asn_type"), "created_at": F.lit("2024-01-01 00:00:00")})


UUID_SQL = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query("out2_export_stix", with_ctes(["atab", "din", "dout", "probs", "tx", "spy"], f"""
    SELECT 'indicator--' || {UUID_SQL} AS id, pattern, confidence FROM (
      SELECT sha1(unhex('{Ex.INDICATOR_NAMESPACE.replace('-', '')}') || CAST(x AS BLOB)) AS h, pattern, confidence FROM (
        SELECT entity_id AS x, '[x-cryptocurrency-wallet:address = ''' || entity_id || ''']' AS pattern, CAST(round_even(calibrated_confidence * 100, 0) AS INT) AS confidence FROM atab WHERE risk_score >= 65
        UNION ALL SELECT spy_ip, '[ipv4-addr:value = ''' || spy_ip || ''']', CAST(round_even(100 * CASE WHEN coalesce(c, 0) = 0 THEN 0.3 ELSE c END, 0) AS INT) FROM (
          SELECT spy_ip, arg_max(struct_pack(c := round(1 - exp(-spy_delta / 1.5), 3)), (risk_score, alert_id)).c AS c FROM atab JOIN (
            SELECT m.address, arg_min(m.txid, (p_normal, ts, m.txid)) AS txid FROM (SELECT txid, address FROM din UNION SELECT txid, address FROM dout) m JOIN probs USING (txid) JOIN tx USING (txid) GROUP BY 1) e ON e.address = entity_id
          JOIN spy USING (txid) WHERE risk_score >= 65 GROUP BY 1)))"""))
def out2(fx):
    return Ex.indicators(export_alerts(fx)).select("id", "pattern", "confidence")


@query("out3_siem_payloads", with_ctes(["atab"], """
    SELECT alert_id, fmt, CASE fmt WHEN 'elastic' THEN 2 ELSE 1 END AS lines, entity_id AS wallet, action AS recommended_action FROM atab, (SELECT unnest(['json', 'splunk_hec', 'elastic']) AS fmt)"""))
def out3(fx):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    out = None
    for fmt, base in (("json", "$"), ("splunk_hec", "$.event"), ("elastic", "$")):
        p = Ex.siem_payloads(export_alerts(fx), fmt, now).withColumn("last", F.substring_index("value", "\n", -1))
        row = p.select("alert_id", F.lit(fmt).alias("fmt"), F.size(F.split("value", "\n")).alias("lines"), F.get_json_object("last", f"{base}.wallet").alias("wallet"), F.get_json_object("last", f"{base}.recommended_action").alias("recommended_action"))
        out = row if out is None else out.unionByName(row)
    return out


@query("out4_pending_deliveries", with_ctes(["atab", "matches"], """
    SELECT * FROM (SELECT h AS hook_id, alert_id AS item_id, 'ALERT' AS kind, risk_score FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY risk_score DESC, alert_id) AS k FROM hooks JOIN atab ON list_contains(sev, severity) AND NOT (h = 1 AND n % 5 = 0)) WHERE k <= 40)
    UNION ALL SELECT h, 'W-' || substr(sha1(address || '|' || CAST(txid AS VARCHAR)), 1, 10), 'MOVEMENT', 100.0 FROM hooks, matches""", extra="""
    hooks AS MATERIALIZED (SELECT CAST(unnest([1, 2]) AS BIGINT) AS h, unnest([['HIGH', 'CRITICAL'], ['CRITICAL']]) AS sev)"""))
def out4(fx):
    a = Qr.alert_table(fx)
    two = a.orderBy("alert_id").limit(1).select(F.explode(F.array(F.struct(F.lit(1).cast("long").alias("id"), F.lit("high").alias("min_severity")), F.struct(F.lit(2).cast("long").alias("id"), F.lit(None).cast("string").alias("min_severity")))).alias("h"))
    hooks = two.select("h.id", "h.min_severity", F.lit(True).alias("enabled"))
    log = a.where("n % 5 = 0").select(F.lit(1).cast("long").alias("webhook_id"), "alert_id", F.lit("SENT").alias("status"))
    return Ex.pending_deliveries(hooks, a, Qa.events(fx, "QUICK"), log, 40)
