"""Following money forward: deposits at known services, peel-chain replay and the neighbourhood of a wallet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.config import EXIT_TYPES, SETTINGS
from tracewell.functions.columns import micros, swap_memo
from tracewell.operators.ledger import Ledger
from tracewell.operators.temporal import asof
from tracewell.session import stage


def minutes_1(later_us: Column, earlier_us: Column) -> Column:
    """Minutes to one decimal, rounded half up in whole microseconds so that every engine agrees."""
    return F.floor((later_us - earlier_us + 3_000_000) / 6_000_000) / 10


def first_spends(tin: DataFrame, n: int) -> DataFrame:
    """The first ``n`` spends of every address: (address, rank, txid, t)."""
    order = W.partitionBy("address").orderBy("t", "txid", "idx")
    return (tin.select("address", "txid", "idx", micros("ts").alias("t")).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= n).select("address", F.col("rank").cast("long").alias("rank"), "txid", "t"))


def trace_exits(ledger: Ledger, starts: DataFrame, known: DataFrame, s=SETTINGS) -> DataFrame:
    """Every deposit at a known exchange, swap service or bridge reachable from the ``starts`` (column address).

    The search goes forward in time from the wallet's first spends, level by level for all wallets at once, through the
    first few spends of every unknown output, and looks at a bounded number of transactions per wallet; these limits
    define the search. Transactions whose memo names a swap count as exits too. One row per deposit:
    start, txid, hop, path, vasp, entity_type, in_jurisdiction, country, deposit_address, amount_btc, deposit_us,
    minutes_after_receipt, memo_asset, memo_destination.
    """
    begin = starts.select("address").distinct()
    spend = first_spends(ledger.tin.join(begin, "address", "left_semi"), s.trace_start_spends)
    receipts = asof(spend.withColumn("ts", F.timestamp_micros("t")),
                    ledger.tout.join(begin, "address", "left_semi").select("address", "ts", F.lit(1).alias("one")),
                    "address", "ts", "ts", ["one"], "backward", strict=False)
    labelled = known.select(F.col("address").alias("to"), "entity_name", "entity_type", "in_jurisdiction", F.col("country").alias("entity_country"))
    outs = ledger.tout.select(F.col("txid").alias("otx"), "idx", F.col("address").alias("to"), "amount").join(labelled, "to", "left")
    level = stage(receipts.select(
        F.col("address").alias("start"), "txid", "t", micros("m_ts").alias("recv_us"), F.array(F.col("txid").cast("string")).alias("path"),
        F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("rank").alias("c")).alias("pos")), "trace-0")
    levels: list[DataFrame] = []
    for hop in range(1, s.trace_max_hops + 1):
        # the first way into a transaction counts; later ones are dropped
        first = level.groupBy("start", "txid").agg(F.min(F.struct("pos", "t", "recv_us", "path")).alias("f")).select("start", "txid", "f.*")
        for old in levels:
            first = first.join(old.select("start", "txid"), ["start", "txid"], "left_anti")
        used = None
        for old in levels:
            n = old.groupBy("start").agg(F.count(F.lit(1)).alias("used"))
            used = n if used is None else used.unionByName(n)
        ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("start").orderBy("pos")).cast("long"))
        if used is None:
            ranked = ranked.where(F.col("rank") <= s.trace_max_transactions)
        else:
            used = used.groupBy("start").agg(F.sum("used").alias("used"))
            ranked = ranked.join(used, "start").where(F.col("rank") <= s.trace_max_transactions - F.col("used")).drop("used")
        visit = stage(ranked.withColumn("hop", F.lit(hop)).select("start", "txid", "hop", "rank", "t", "recv_us", "path"), f"trace-v{hop}")
        levels.append(visit)
        if hop == s.trace_max_hops:
            break
        going = stage(visit.join(outs.where("entity_type is null"), visit.txid == outs.otx).select("start", "rank", "t", "recv_us", "path", "idx", F.col("to").alias("address")), f"trace-o{hop}")
        # only spends of addresses the search has reached are ranked
        few = first_spends(ledger.tin.join(going.select("address").distinct(), "address", "left_semi"), s.trace_spends_per_output)
        onward = (going.join(few.select("address", F.col("rank").alias("spend_rank"), F.col("txid").alias("next"), F.col("t").alias("t2")), "address")
                  .where("t2 >= t"))
        level = stage(onward.select(
            "start", F.col("next").alias("txid"), F.col("t2").alias("t"), "recv_us", F.concat("path", F.array(F.col("next").cast("string"))).alias("path"),
            F.struct(F.col("rank").alias("a"), F.col("idx").alias("b"), F.col("spend_rank").alias("c")).alias("pos")), f"trace-{hop}")
    visits = levels[0]
    for v in levels[1:]:
        visits = visits.unionByName(v)
    delay = F.when(F.col("recv_us").isNotNull(), minutes_1(F.col("t"), F.col("recv_us")))
    hit = visits.join(outs.where(F.col("entity_type").isin(*EXIT_TYPES)), visits.txid == outs.otx)
    deposits = hit.select("start", "txid", "hop", "path", F.col("entity_name").alias("vasp"), "entity_type", "in_jurisdiction",
                          F.col("entity_country").alias("country"), F.col("to").alias("deposit_address"), F.round("amount", 8).alias("amount_btc"),
                          F.col("t").alias("deposit_us"), delay.alias("minutes_after_receipt"),
                          F.lit(None).cast("string").alias("memo_asset"), F.lit(None).cast("string").alias("memo_destination"))
    if "op_return" not in ledger.tx.columns:
        return deposits
    swaps = ledger.tx.select("txid", swap_memo(F.col("op_return")).alias("m")).where("m is not null")
    own = ledger.tin.select("txid", F.col("address").alias("to")).distinct()
    vault = (ledger.tout.join(swaps.select("txid"), "txid", "left_semi").select("txid", "idx", F.col("address").alias("to"), "amount")
             .join(own, ["txid", "to"], "left_anti").groupBy("txid")
             .agg(F.max(F.struct("amount", (-F.col("idx")).alias("neg"), "to")).alias("v")).select("txid", F.col("v.to").alias("vault"), F.col("v.amount").alias("vault_amount")))
    memo = visits.join(swaps, "txid").join(vault, "txid", "left").select(
        "start", "txid", "hop", "path", F.concat(F.coalesce("m.destination_chain", F.lit("unknown chain")), F.lit(" swap (memo)")).alias("vasp"),
        F.lit("SWAP").alias("entity_type"), F.lit(False).alias("in_jurisdiction"), F.lit(None).cast("string").alias("country"),
        F.col("vault").alias("deposit_address"), F.round(F.coalesce("vault_amount", F.lit(0.0)), 8).alias("amount_btc"), F.col("t").alias("deposit_us"),
        delay.alias("minutes_after_receipt"), F.col("m.asset").alias("memo_asset"), F.col("m.destination_address").alias("memo_destination"))
    return deposits.unionByName(memo)


def change_steps(ledger: Ledger, known: DataFrame) -> DataFrame:
    """Per transaction its largest output, what was peeled off, and the next transaction that spends the largest output.

    The next spend is the earliest one not before the transaction itself."""
    a = F.col("amount")
    big = ledger.tout.groupBy("txid").agg(F.max(F.struct(a, (-F.col("idx")).alias("neg"), "address", "ts")).alias("b"), F.count(F.lit(1)).alias("n_out"),
                                          F.sum(a).alias("total"))
    big = big.select("txid", F.col("b.ts").alias("ts"), F.col("b.address").alias("address"), F.col("b.amount").alias("change_amount"), "n_out",
                     (F.col("total") - F.col("b.amount")).alias("peeled"))
    nxt = asof(big, ledger.tin, "address", "ts", "ts", ["txid"], "forward", strict=False)
    names = known.select("address", F.col("entity_name").alias("change_exchange"))
    return nxt.join(names, "address", "left").select("txid", "ts", F.col("address").alias("change_address"), "change_amount", "n_out", "peeled",
                                                    "change_exchange", F.col("m_txid").alias("next_txid"))


def follow_money(ledger: Ledger, starts: DataFrame, known: DataFrame, max_hops: int = 60, stage_every: int = 5) -> tuple[DataFrame, DataFrame]:
    """Peel-chain replay from every start wallet at once: (hops, summary).

    Each hop follows the largest output of a spend. The walk stops when the money is split (five outputs or more), reaches
    a known service in one piece, stays unspent, loops, or after ``max_hops``.
    """
    steps = stage(change_steps(ledger, known), "follow-steps")
    first = first_spends(ledger.tin, 1).select(F.col("address").alias("start"), F.col("txid").alias("at"))
    cur = starts.select(F.col("address").alias("start")).distinct().join(first, "start", "left").select(
        "start", F.col("start").alias("current"), "at", F.lit(0.0).alias("peeled_total"), F.array().cast("array<string>").alias("seen"))
    cur = stage(cur, "follow-0")
    done = cur.where("at is null").select("start", F.lit("wallet never spends").alias("stop"))
    hops: list[DataFrame] = []
    for i in range(1, max_hops + 1):
        key = F.col("at").cast("string")
        live = cur.where("at is not null")
        done = done.unionByName(live.where(F.array_contains("seen", key)).select("start", F.lit("loop").alias("stop")))
        hop = (live.where(~F.array_contains("seen", key)).join(steps, live["at"] == steps.txid)
               .select("start", F.lit(i).alias("hop"), "txid", "ts", F.col("current").alias("sender"), "n_out", "change_address", "change_amount",
                       (F.col("peeled_total") + F.col("peeled")).alias("peeled_total"), "change_exchange", "next_txid",
                       F.concat("seen", F.array(key)).alias("seen")))
        # every round is written: the next one starts from its rows, and the hop table is made of them
        hop = stage(hop, f"follow-{i}")
        if hop.isEmpty():
            break
        hops.append(hop)
        stop = (F.when(F.col("n_out") >= 5, F.concat(F.lit("split into "), F.col("n_out").cast("string"), F.lit(" outputs")))
                .when(F.col("change_exchange").isNotNull(), F.concat(F.lit("cashed out to "), F.col("change_exchange")))
                .when(F.lit(i == max_hops), "max hops reached").when(F.col("next_txid").isNull(), "funds left unspent"))
        done = done.unionByName(hop.select("start", stop.alias("stop")).where("stop is not null"))
        cur = hop.where(stop.isNull()).select("start", F.col("change_address").alias("current"), F.col("next_txid").alias("at"), "peeled_total", "seen")
    if not hops:
        return steps.limit(0).select(F.lit("").alias("start"), F.lit(0).alias("hop"), "txid"), done
    rows = hops[0]
    for h in hops[1:]:
        rows = rows.unionByName(h)
    spent = ledger.tin.groupBy(F.col("txid"), F.col("address").alias("sender")).agg(F.sum("amount").alias("amount_in"))
    rows = rows.drop("seen", "next_txid").join(spent, ["txid", "sender"], "left")
    ends = rows.groupBy("start").agg(
        F.max("hop").alias("hops"), F.max_by("change_amount", "hop").alias("end_amount"), F.max_by("peeled_total", "hop").alias("peeled_total"),
        F.min_by("amount_in", "hop").alias("start_amount"), (F.max(micros("ts")) - F.min(micros("ts"))).alias("duration_us"))
    return rows, done.join(ends, "start", "left")


def peels(ledger: Ledger, steps: DataFrame, known: DataFrame, top: int = 10) -> DataFrame:
    """What was peeled off at every followed transaction: its other outputs, largest first, with known services named."""
    order = W.partitionBy("txid").orderBy(F.desc("amount"), "idx")
    o = ledger.tout.join(steps.select("txid").distinct(), "txid", "left_semi").withColumn("rank", F.row_number().over(order))
    return (o.where((F.col("rank") > 1) & (F.col("rank") <= top + 1)).join(known.select("address", "entity_name", "in_jurisdiction"), "address", "left")
            .select("txid", "rank", "address", "amount", F.col("entity_name").alias("exchange"), "in_jurisdiction"))


def transactions_touching(ledger: Ledger, wallets: DataFrame) -> DataFrame:
    both = ledger.tin.select("txid", "ts", "address").unionByName(ledger.tout.select("txid", "ts", "address"))
    return both.join(wallets.select("address"), "address", "left_semi").groupBy("txid").agg(F.min("ts").alias("ts"))


def neighbourhood(ledger: Ledger, centres: DataFrame, hops: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(transactions, wallets) within ``hops`` wallet hops of the centres, the earliest ``limit`` transactions first."""
    def members(txs):
        both = ledger.tin.select("txid", "address").unionByName(ledger.tout.select("txid", "address"))
        return both.join(txs.select("txid"), "txid", "left_semi").select("address").distinct()

    txs = stage(transactions_touching(ledger, centres).orderBy("ts", "txid").limit(limit).withColumn("step", F.lit(1)), "near-1")
    seen = frontier = stage(members(txs), "near-w1")
    for i in range(2, hops + 1):
        room = limit - txs.count()  # at most ``limit`` rows
        if room <= 0:
            break
        # what is known already takes no room
        more = transactions_touching(ledger, frontier).join(txs.select("txid"), "txid", "left_anti").orderBy("ts", "txid").limit(room)
        txs = stage(txs.unionByName(more.withColumn("step", F.lit(i))), f"near-{i}")
        frontier = stage(members(txs).join(seen, "address", "left_anti"), f"near-w{i}")
        seen = seen.unionByName(frontier)
    return txs, seen


def link_graph(ledger: Ledger, txs: DataFrame, relays: DataFrame, wallets: DataFrame, links: DataFrame | None = None,
               min_risk: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the transactions: IP -> transaction -> wallet, plus mixer links between shown wallets.

    ``wallets`` gives address, risk, and keep (centre or seed, always shown)."""
    meta = wallets.where((F.col("risk") >= min_risk) | F.col("keep"))
    tin, tout = (df.join(txs.select("txid"), "txid", "left_semi") for df in (ledger.tin, ledger.tout))
    show = lambda df: df.join(meta.select("address", "risk"), "address")
    t, w = F.concat(F.lit("tx_"), F.col("txid").cast("string")), F.concat(F.lit("w_"), F.col("address"))
    ip = F.concat(F.lit("ip_"), F.col("spy_ip"))
    heard = relays.join(txs.select("txid"), "txid", "left_semi").where("spy_ip is not null")
    edge = lambda df, a, b, kind, amount: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"), amount.alias("amount"))
    none = F.lit(None).cast("double")
    edges = (edge(heard, ip, t, "RELAYED", none).unionByName(edge(show(tin), w, t, "INPUT", F.col("amount")))
             .unionByName(edge(show(tout), t, w, "OUTPUT", F.col("amount"))))
    node = lambda df, i, kind, risk: df.select(i.alias("id"), F.lit(kind).alias("type"), risk.alias("risk")).distinct()
    wallet_rows = show(tin).select("address", "risk").unionByName(show(tout).select("address", "risk"))
    nodes = (node(txs, t, "TRANSACTION", F.lit(0.0)).unionByName(node(heard, ip, "IP", F.lit(0.0)))
             .unionByName(node(wallet_rows, w, "WALLET", F.col("risk"))))
    if links is not None:
        shown = wallet_rows.select("address").distinct()
        m = (links.join(txs.select("txid"), "txid", "left_semi").join(shown.withColumnRenamed("address", "src"), "src", "left_semi")
             .join(shown.withColumnRenamed("address", "dst"), "dst", "left_semi"))
        edges = edges.unionByName(m.select(F.concat(F.lit("w_"), F.col("src")).alias("source"), F.concat(F.lit("w_"), F.col("dst")).alias("target"),
                                           F.lit("MIXER_LINK").alias("type"), F.col("prob").alias("amount")))
    return nodes, edges
