"""Queries that run a stream to the end of the available files and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewell.operators import watch as Wa
from tracewell.plans.oracle import r, with_ctes
from tracewell.plans.queries_ledger import r6 as r8
from tracewell.plans.queries_io import TEXT_COLUMNS, csv_files, folder, raw_records
from tracewell.plans.registry import query
from tracewell.session import shared_dir
from tracewell.sources import ingest as In
from tracewell.streaming import jobs as J
from tracewell.streaming.inbox import Inbox
from tracewell.streaming.store import FirstSeenStore, first_seen


def _place(fx):
    base = f"{shared_dir(fx.spark)}/stream-{uuid.uuid4().hex[:10]}"
    return f"{base}/out", f"{base}/checkpoint"


def _files(fx, label, df, parts=4):
    """A table as several files, split by time, that a stream reads one after the other."""
    path, new = folder(fx, label)
    if new:
        df.repartitionByRange(parts, "ts").write.parquet(path)
    return path


@query("in15_file_stream_ingest", with_ctes(["recs"], "SELECT count(*) AS rows_read, count(*) FILTER (fault IS NULL) AS records, count(*) FILTER (fault IS NOT NULL) AS quarantined FROM recs"))
def in15(fx):
    out, checkpoint = _place(fx)
    J.file_stream_ingest(fx.spark, csv_files(fx), TEXT_COLUMNS, out, checkpoint).awaitTermination()
    log = fx.spark.read.parquet(f"{out}/ingest_log").agg(F.sum("rows_read").alias("rows_read"), F.lit(1).alias("one"))
    n = lambda name, alias: fx.spark.read.parquet(f"{out}/{name}").agg(F.count(F.lit(1)).alias(alias), F.lit(1).alias("one"))
    return log.join(n("records", "records"), "one").join(n("quarantine", "quarantined"), "one").drop("one")


@query("in15_inbox", with_ctes(["recs"], """
    SELECT txid, 2 * count(*) AS n, min(epoch_us(ts)) AS first_us, count(DISTINCT src_ip) AS ips, string_agg(DISTINCT src_ip, ',' ORDER BY src_ip) AS heard_from FROM recs WHERE fault IS NULL GROUP BY 1"""))
def in15_inbox(fx):
    """Every record once as CSV and once as JSON lines, with a file of unknown format among them, taken six files a step until the inbox is empty."""
    base = f"{shared_dir(fx.spark)}/inbox-{uuid.uuid4().hex[:10]}"
    rows = fx._stage("io-records", lambda: raw_records(fx))  # three kinds of files are written from it
    rows.select(*TEXT_COLUMNS).write.option("header", True).csv(f"{base}/in")
    side = lambda a, v: F.transform(F.arrays_zip(a, v), lambda p: F.struct(p[a].alias("address"), p[v].alias("value")))
    lines = rows.withColumns({"senders": side("input_addresses", "input_amounts"), "receivers": side("output_addresses", "output_amounts")})
    lines.select(*[c for c in TEXT_COLUMNS if c not in ("in_amounts", "out_amounts")]).write.mode("append").json(f"{base}/in")
    rows.select("Tx_Hash").limit(1).write.mode("append").text(f"{base}/in")
    box = Inbox(fx.spark, f"{base}/in", f"{base}/out", settle=0, files_per_step=6)
    while box.step():
        pass
    ips = F.array_join(F.array_sort(F.collect_set("src_ip")), ",")  # peers that relayed one transaction
    return box.records().groupBy("txid").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("timestamp")).alias("first_us"), F.count_distinct("src_ip").alias("ips"), ips.alias("heard_from"))


@query("al12_watch_stream", with_ctes(["targets", "tin", "tx"], """
    SELECT 'W-' || substr(sha1(address || '|' || CAST(txid AS VARCHAR)), 1, 10) AS event_id, address, txid, src AS watch_source, CASE WHEN coalesce(confirmed, true) THEN 'TRACE_AND_REVIEW' ELSE 'UNCONFIRMED_MOVEMENT' END AS recommended
    FROM (SELECT DISTINCT address, txid, src FROM tin JOIN targets USING (address) WHERE watched_from IS NULL OR ts > watched_from) JOIN tx USING (txid)"""))
def al12(fx):
    spends = fx.tin_a.join(fx.tx_a.select("txid", "confirmed"), "txid")
    path = _files(fx, "spends", spends)
    stream = fx.spark.readStream.schema(fx.spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    out, checkpoint = _place(fx)
    J.run_to_table(J.watch_stream(stream, Wa.watch_targets(fx.watchlist, fx.seeds), "20000 days"), out, checkpoint).awaitTermination()
    return fx.spark.read.parquet(out).select("event_id", "address", "txid", "watch_source", "recommended")


@query("q12_live_rate_stream", """
    SELECT epoch_us(date_trunc('minute', ts)) AS minute_us, count(*) AS n FROM events WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1""")
def q12s(fx):
    """Minutes that the watermark (ten minutes behind the newest event) has closed."""
    path = _files(fx, "events", fx.t.events.select("event_id", "ts"))
    stream = fx.spark.readStream.schema("event_id bigint, ts timestamp").parquet(path)
    out, checkpoint = _place(fx)
    J.run_to_table(J.live_rate_stream(stream), out, checkpoint).awaitTermination()
    return fx.spark.read.parquet(out).select(F.unix_micros("minute").alias("minute_us"), "n")


@query("in9_first_observation_stream", with_ctes(["obs"], "SELECT txid, min(epoch_us(ts)) AS ts_us, arg_min(src_ip, (ts, src_ip)) AS src_ip, count(*) AS n_obs FROM obs WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM obs) - INTERVAL 1 DAY GROUP BY txid, date_trunc('day', ts)"))
def in9s(fx):
    path = _files(fx, "obs", fx.obs)
    stream = fx.spark.readStream.schema(fx.spark.read.parquet(path).schema).parquet(path)
    out, checkpoint = _place(fx)
    J.run_to_table(J.first_observation_stream(stream), out, checkpoint).awaitTermination()
    return fx.spark.read.parquet(out).select("txid", F.unix_micros("ts").alias("ts_us"), "src_ip", "n_obs")


@query("in10_dedup_stream", with_ctes(["obs"], "SELECT DISTINCT txid, src_ip, epoch_ms(ts) AS ts_ms FROM obs"))
def in10s(fx):
    twice = fx.obs.unionByName(fx.obs.where("txid % 5 = 0"))
    path = _files(fx, "obs2", twice)
    stream = fx.spark.readStream.schema(fx.spark.read.parquet(path).schema).parquet(path)
    out, checkpoint = _place(fx)
    J.run_to_table(J.dedup_stream(stream), out, checkpoint).awaitTermination()
    return fx.spark.read.parquet(out).select("txid", "src_ip", "ts_ms")


@query("in9_first_observation_store", with_ctes(["obs"], "SELECT txid, min(epoch_us(ts)) AS ts_us, arg_min(src_ip, (ts, src_ip)) AS src_ip, count(*) AS n_obs FROM obs GROUP BY txid"))
def in9_store(fx):
    """All observations, newest file first, merged batch by batch; then the last batch once more and a restart, which change nothing."""
    path, new = folder(fx, "obs-late")
    if new:
        fx.obs.repartitionByRange(4, F.desc("ts")).write.parquet(path)
    schema = fx.spark.read.parquet(path).schema
    stream = lambda: fx.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out, checkpoint = _place(fx)
    store = FirstSeenStore(fx.spark, out, schema, buckets=8)
    first_seen(stream(), store, checkpoint).awaitTermination()
    store.merge(fx.obs, max(store._published()))
    first_seen(stream(), store, checkpoint).awaitTermination()
    return store.read().select("txid", F.unix_micros("ts").alias("ts_us"), "src_ip", "n_obs")


@query("al12_watch_events_stream", with_ctes(["targets", "tin", "tout", "tx"], f"""
    SELECT 'W-' || substr(sha1(address || '|' || CAST(txid AS VARCHAR)), 1, 10) AS event_id, address, txid, {r('moved', 8)} AS amount_btc, coalesce(n, 0) AS destinations, {r('coalesce(paid, 0)', 6)} AS paid,
           CASE WHEN coalesce(confirmed, true) THEN 'TRACE_AND_REVIEW' ELSE 'UNCONFIRMED_MOVEMENT' END AS recommended
    FROM (SELECT address, txid, sum(amount) AS moved FROM tin JOIN targets USING (address) WHERE watched_from IS NULL OR ts > watched_from GROUP BY ALL) JOIN tx USING (txid)
    LEFT JOIN (SELECT txid, count(*) AS n, sum(amount) AS paid FROM tout GROUP BY 1) USING (txid)"""))
def al12_events(fx):
    """Whole transactions as a stream, newest first, some of them twice in a later batch; a restart records nothing twice."""
    path, new = folder(fx, "transactions")
    if new:
        side = lambda df, c: df.groupBy("txid").agg(F.sort_array(F.collect_list(F.struct("idx", "address", "amount"))).alias(c)).select("txid", F.transform(c, lambda x: F.struct(x.address.alias("address"), x.amount.alias("amount"))).alias(c))
        t = fx.tx_a.select("txid", "ts", "confirmed", "rbf").join(side(fx.tin_a, "inputs"), "txid").join(side(fx.tout_a, "outputs"), "txid", "left")
        t.repartitionByRange(4, F.desc("ts")).write.parquet(path)
        t.where("txid % 7 = 0").coalesce(1).write.mode("append").parquet(path)
    stream = lambda: fx.spark.readStream.schema(fx.spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    out, checkpoint = _place(fx)
    for _ in range(2):
        J.watch_transactions(stream(), Wa.watch_targets(fx.watchlist, fx.seeds), out, checkpoint).awaitTermination()
    e = J.recorded_events(fx.spark, out)
    paid = F.aggregate(F.coalesce("destinations", F.array().cast("array<struct<address:string,amount:double>>")), F.lit(0.0), lambda a, x: a + F.coalesce(x.amount, F.lit(0.0)))
    return e.select("event_id", "address", "txid", r8("amount_btc", 8).alias("amount_btc"), F.coalesce(F.size("destinations"), F.lit(0)).cast("long").alias("destinations"), r8(paid, 6).alias("paid"), "recommended")
