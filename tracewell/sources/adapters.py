"""Ledgers over the driver's star-schema tables, so that every operator can run on them.

Adapter A: orders and line items as a general ledger.  B: a user's events as a peel chain.  M: mixing transactions.
N: relay observations.  K: reference lists, truth and scores derived from the addresses of A.
Each table is written once per application to the shared folder and reused by later stages.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.ledger import Ledger
from tracewell.session import memo_stage, prepare


def address(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("long").cast("string"))


class Tables:
    """The source tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


class Fixtures:
    """The adapters A, B, M, N and K over one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.t = Tables(spark, folder)
        self.spark, self.folder = self.t.spark, folder

    def _stage(self, label: str, build, by: str | None = None) -> DataFrame:
        return memo_stage(self.spark, (self.folder, label), label, build, by)

    # -- A ---------------------------------------------------------------------------------------
    @cached_property
    def lines(self) -> DataFrame:
        o = self.t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
        l = self.t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                   "l_extendedprice", "l_discount")
        ts = F.timestamp_micros(F.unix_micros("o_orderdate") + (F.col("o_orderkey") % 86400) * 1_000_000)
        # merged at any size: what follows works on the lines of an order where they are
        return l.join(o.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("ts", ts)

    def _tout_a(self) -> DataFrame:
        return self.lines.select(
            F.col("l_orderkey").alias("txid"), "ts",
            (F.col("l_linenumber").cast("long") * 100_000_000_000 + F.col("l_partkey")).alias("idx"),
            address("A", F.col("l_partkey") * 6 + F.col("l_orderkey") % 6).alias("address"),
            F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 10000, 8).alias("amount"))

    @cached_property
    def tout_a(self) -> DataFrame:
        return self._stage("a-tout", self._tout_a, "txid")

    @cached_property
    def tin_a(self) -> DataFrame:
        def build():
            tot = self.tout_a.groupBy("txid").agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n"),
                                                  F.sum("amount").alias("s"))
            o = self.t.orders.select(F.col("o_orderkey").alias("txid"), "o_custkey")
            spender = F.col("o_custkey") * 8
            side = F.array(
                F.struct(F.lit(0).cast("long").alias("idx"), address("A", spender + F.col("txid") % 8).alias("address"),
                         F.round(F.col("s") + 0.0001 * F.col("n"), 8).alias("amount")),
                F.when(F.col("txid") % 5 == 0,
                       F.struct(F.lit(1).cast("long").alias("idx"),
                                address("A", spender + (F.col("txid") + 1) % 8).alias("address"),
                                F.lit(0.5).alias("amount"))))
            return (o.join(tot, "txid").select("txid", "ts", F.explode(F.array_compact(side)).alias("i"))
                    .select("txid", "ts", "i.idx", "i.address", "i.amount"))
        return self._stage("a-tin", build, "txid")

    @cached_property
    def tx_a(self) -> DataFrame:
        def build():
            tot = self.tout_a.groupBy("txid").agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
            o = self.t.orders.select(F.col("o_orderkey").alias("txid"), F.col("o_custkey").alias("c"))
            c, t = F.col("c"), F.col("txid")
            script = F.element_at(F.array(*[F.lit(s) for s in SCRIPT_CYCLE]), (c % 5 + 1).cast("int"))
            known = c % 7 != 0
            memo = (F.when(t % 37 == 0, F.concat(F.lit("=:ETH.ETH:0x"), t.cast("string"), F.lit(":1000")))
                    .when(t % 37 == 1, F.lit("hello world")))
            return o.join(tot, "txid").select(
                "txid", "ts", F.round(0.0001 * F.col("n"), 8).alias("fee"), script.alias("script_type"),
                F.when(known, (1 + c % 2).cast("int")).alias("tx_version"),
                F.when(c % 3 == 0, 862000).otherwise(0).cast("long").alias("locktime"),
                (c % 2 == 1).alias("rbf"), memo.alias("op_return"),
                F.when(t % 3 == 1, False).when(t % 3 == 2, True).alias("confirmed"))
        return self._stage("a-tx", build, "txid")

    @cached_property
    def sides(self) -> Ledger:
        """A without its relays, for work that reads none: they are not built for it."""
        return Ledger(self.tx_a, self.tin_a, self.tout_a, None)

    @cached_property
    def a(self) -> Ledger:
        return Ledger(self.tx_a, self.tin_a, self.tout_a, self.spy)

    # -- B ---------------------------------------------------------------------------------------
    @cached_property
    def b(self) -> Ledger:
        # seq numbers one user's events; users are split by day first so that a busy user is never one task
        def numbered():
            from pyspark.sql import Window as W
            e = self.t.events.select("event_id", "ts", "user_id", "event_type", "value").withColumn("day", F.to_date("ts"))
            counts = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
            before = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
            counts = counts.select("user_id", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
            inside = F.row_number().over(W.partitionBy("user_id", "day").orderBy("ts", "event_id"))
            return (e.withColumn("rn", inside).join(counts, ["user_id", "day"])
                    .select("event_id", "ts", "user_id", "event_type", "value", (F.col("rn") + F.col("before")).alias("seq")))
        e = self._stage("b-events", numbered)
        u = F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("_"))
        tx = e.select(F.col("event_id").alias("txid"), "ts", F.lit(0.0001).alias("fee"), F.lit("P2WPKH").alias("script_type"),
                      F.lit(2).alias("tx_version"), F.lit(0).cast("long").alias("locktime"), F.lit(True).alias("rbf"),
                      F.lit(None).cast("string").alias("op_return"), F.lit(None).cast("boolean").alias("confirmed"))
        tin = e.select(F.col("event_id").alias("txid"), "ts", F.lit(0).cast("long").alias("idx"),
                       F.concat(u, F.col("seq").cast("string")).alias("address"),
                       (F.lit(10.0) + F.col("value") / 1000 + 0.0001).alias("amount"))

        def out(idx, addr, amount):
            return F.struct(F.lit(idx).cast("long").alias("idx"), addr.alias("address"), amount.alias("amount"))
        fixed = [out(0, F.concat(u, (F.col("seq") + 1).cast("string")), F.lit(10.0)),
                 out(1, F.concat(F.lit("P"), (F.col("event_id") % 50).cast("string")), F.round(F.col("value") / 1000, 8))]
        split = [out(2 + k, F.concat(F.lit("F"), (F.col("event_id") % 97).cast("string"), F.lit(f"_{k}")), F.lit(0.5))
                 for k in range(3)]
        sides = F.when(F.col("event_type") == "error", F.array(*fixed, *split)).otherwise(F.array(*fixed))
        tout = (e.select(F.col("event_id").alias("txid"), "ts", F.explode(sides).alias("o"))
                .select("txid", "ts", "o.idx", "o.address", "o.amount"))
        return Ledger(tx, tin, tout, None)

    # -- M ---------------------------------------------------------------------------------------
    @cached_property
    def m(self) -> Ledger:
        def build():
            li = self.lines
            k = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k")).where("k >= 3")
            return (li.join(k, "l_orderkey")
                    .select(F.col("l_orderkey").alias("txid"), "ts", "k", "l_partkey", "l_quantity",
                            (F.col("l_linenumber").cast("long") * 100_000_000_000 + F.col("l_partkey")).alias("rn"),
                            F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                                        F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                                        F.col("l_quantity").cast("long").cast("string")).alias("tag")))
        m = self._stage("m-lines", build, "txid")
        tin = m.select("txid", "ts", F.col("rn").alias("idx"),
                       address("A", F.col("l_partkey") * 6 + F.col("txid") % 6).alias("address"),
                       F.round(0.1 + 0.001 * F.col("l_quantity") + 0.00002, 8).alias("amount"))
        # an output that no input explains, so that branch is exercised as well
        stray = F.when((F.col("txid") % 200 == 0) & (F.col("l_quantity") > 25), F.struct(
            (F.col("rn") * 4 + 2).alias("idx"), F.concat(F.lit("S"), F.col("tag")).alias("address"), F.lit(0.12034567).alias("amount")))
        outs = F.array_compact(F.array(
            F.struct((F.col("rn") * 4).alias("idx"), F.concat(F.lit("M"), F.col("tag")).alias("address"), F.lit(0.1).alias("amount")),
            F.struct((F.col("rn") * 4 + 1).alias("idx"), F.concat(F.lit("C"), F.col("tag")).alias("address"),
                     F.round(0.001 * F.col("l_quantity"), 8).alias("amount")), stray))
        tout = (m.select("txid", "ts", F.explode(outs).alias("o")).select("txid", "ts", "o.idx", "o.address", "o.amount"))
        tx = m.groupBy("txid").agg(F.min("ts").alias("ts"), F.round(F.lit(0.00002) * F.max("k"), 8).alias("fee"))
        return Ledger(tx, tin, tout, None)

    # -- S: orders of seven lines and more as self-splits of a balance --------------------------------
    @cached_property
    def s(self) -> Ledger:
        def build():
            k = self.lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k")).where("k >= 7")
            li = self.lines.join(k, "l_orderkey")
            t, p = F.col("l_orderkey"), F.col("l_partkey") % 50
            amount = (F.when((F.col("l_linenumber") == 1) & (t % 2 == 0), 5.0)
                      .otherwise(F.round(1 + F.when(t % 5 == 0, 0.05).otherwise(0.0005) * p, 8)))
            return li.select(t.alias("txid"), "ts", (F.col("l_linenumber").cast("long") * 100_000_000_000 + F.col("l_partkey")).alias("idx"),
                             F.concat_ws("_", F.lit("S"), t.cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
                                         F.col("l_suppkey").cast("string")).alias("address"), amount.alias("amount"))
        tout = self._stage("s-tout", build)
        keep = tout.select("txid").distinct()
        return Ledger(self.tx_a.join(keep, "txid", "left_semi"), self.tin_a.join(keep, "txid", "left_semi"), tout, None)

    # -- N ---------------------------------------------------------------------------------------
    @cached_property
    def obs(self) -> DataFrame:
        def build():
            li = self.lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "ts")
            s = self.t.supplier.join(self.t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
                "s_suppkey", F.col("n_name").alias("country"), F.col("n_nationkey").cast("long").alias("nation"))
            k = F.col("l_suppkey")
            when = F.timestamp_micros(F.unix_micros("ts") + ((F.col("l_partkey") * 7919 + F.col("l_linenumber").cast("long") * 104729) % 5000) * 1000)
            kind = F.element_at(F.array(*[F.lit(x) for x in ASN_CYCLE]), (k % 6 + 1).cast("int"))
            n = F.col("nation")
            return (li.join(s, k == F.col("s_suppkey")).select(
                F.col("l_orderkey").alias("txid"), when.alias("ts"),
                F.concat(F.lit("10.0."), F.floor(k / 256).cast("string"), F.lit("."), (k % 256).cast("string")).alias("src_ip"),
                F.when(k % 9 == 0, 18333).otherwise(8333).alias("src_port"), "country",
                (F.lit(-60.0) + (n * 37) % 121).alias("lat"), (F.lit(-180.0) + (n * 53) % 361).alias("lon"),
                F.concat(F.lit("AS"), (64500 + k % 40).cast("string")).alias("asn"), kind.alias("asn_type"))
                .dropDuplicates(["txid", "ts", "src_ip"]))
        return self._stage("n-obs", build, "txid")

    @cached_property
    def spy(self) -> DataFrame:
        from tracewell.operators.ledger import first_spy
        return self._stage("n-spy", lambda: first_spy(self.obs), "txid")

    @cached_property
    def centroids(self) -> DataFrame:
        """The 25-row place table of adapter N."""
        n = F.col("n_nationkey").cast("long")
        return self.t.nation.select(F.col("n_name").alias("country"), (F.lit(-60.0) + (n * 37) % 121).alias("lat"),
                                    (F.lit(-180.0) + (n * 53) % 361).alias("lon"))

    # -- K ---------------------------------------------------------------------------------------
    @cached_property
    def addresses(self) -> DataFrame:
        def build():
            both = self.tin_a.select("address").unionByName(self.tout_a.select("address")).distinct()
            return both.withColumn("n", F.substring("address", 2, 20).cast("long"))
        return self._stage("k-addresses", build)

    @cached_property
    def known(self) -> DataFrame:
        n, half = F.col("n"), F.floor(F.col("n") / 50)
        kind = F.element_at(F.array(*[F.lit(x) for x in ENTITY_CYCLE]), (half % 4 + 1).cast("int"))
        return (self.addresses.where(n % 50 == 0).select(
            "address", F.concat(kind, F.lit("_"), (half % 7).cast("string")).alias("entity_name"), kind.alias("entity_type"),
            F.when(n % 100 == 0, "IN").otherwise("XX").alias("country"), (n % 100 == 0).alias("in_jurisdiction")))

    @cached_property
    def seeds(self) -> DataFrame:
        return self.addresses.where(F.col("n") % 97 == 0).select("address")

    @cached_property
    def watchlist(self) -> DataFrame:
        n = F.col("n")
        return self.addresses.where(n % 61 == 0).select(
            "address", F.lit("1998-01-01").cast("timestamp").alias("watched_from"), (n % 2 == 0).alias("active"),
            F.lit("ANALYST").alias("reason"), F.concat(F.lit("A-W-"), F.substring(F.sha1("address"), 1, 10)).alias("alert_id"))

    @cached_property
    def labels(self) -> DataFrame:
        n = F.col("n")
        e = F.floor(n / 8)
        kind = F.element_at(F.array(*[F.lit(x) for x in TYPOLOGY_CYCLE]), (e % 5 + 1).cast("int"))
        return self.addresses.select("address", e.alias("entity_id"), (e % 15 == 0).cast("int").alias("is_illicit"),
                                     kind.alias("typology"))

    @cached_property
    def scores(self) -> DataFrame:
        n = F.col("n")
        kind = F.element_at(F.array(*[F.lit(x) for x in TYPOLOGY_CYCLE]), (n % 5 + 1).cast("int"))
        return self.addresses.select("address", "n", (((n * 2654435761) % 1000) / 1000.0).alias("p"),
                                     (((n * 40503) % 1000) / 1000.0).alias("anomaly"), kind.alias("typology"))

    @cached_property
    def feedback(self) -> DataFrame:
        n = F.col("n")
        base = self.addresses.where(n % 211 == 0)
        return base.select(F.col("address").alias("entity_id"), F.explode(F.array(
            F.struct(F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("FALSE_POSITIVE").alias("user_label")),
            F.struct(F.lit("2024-02-01").cast("timestamp").alias("created_at"),
                     F.when(n % 2 == 0, "TRUE_POSITIVE").otherwise("FALSE_POSITIVE").alias("user_label")))).alias("f")
        ).select("entity_id", "f.created_at", "f.user_label")


# Fixed values of the adapters -------------------------------------------------------------------
SCRIPT_CYCLE = ("P2WPKH", "P2WSH", "P2TR", "P2PKH", "P2SH")
ASN_CYCLE = ("TOR_EXIT", "VPN", "DATACENTER", "BULLETPROOF", "RESIDENTIAL", "UNKNOWN")
ENTITY_CYCLE = ("VASP", "MINING_POOL", "SWAP", "MERCHANT")
TYPOLOGY_CYCLE = ("RANSOMWARE", "PEEL_CHAIN", "MIXING", "STRUCTURING", "ROUND_TRIP")
# ------------------------------------------------------------------------------------------------
