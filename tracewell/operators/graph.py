"""Flow-graph operators. Iterations write every round to the shared folder and drop the round before the last."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.config import SETTINGS
from tracewell.operators.ledger import Ledger
from tracewell.session import drop_stage, stage


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of the edge list; the root is the smallest node of the component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step points neighbours at a smaller node
    with one aggregation and one join, so no node's neighbour list is ever held in one place, and the number of rounds
    grows with the logarithm of the component size. Raises if ``max_rounds`` do not suffice.
    """
    e = stage(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
              .where("hi is not null and lo is not null").distinct(), "cc-edges")
    nodes = e.select(F.col("hi").alias("node")).union(e.select("lo")).distinct()
    first, mark = e, _checksum(e)
    for _ in range(max_rounds):
        # large star: every larger neighbour of u goes to the smallest node next to u (or u itself)
        sym = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (sym.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
                 .where("hi <> lo").distinct())
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(low, "hi").select(F.explode(F.array(
            F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("x"))
            .select("x.hi", "x.lo").where("hi <> lo").distinct())
        new = stage(small, "cc-round")
        now = _checksum(new)
        if e is not first:
            drop_stage(e)
        e = new
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return nodes.join(e.select(F.col("hi").alias("node"), F.col("lo").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))


def _checksum(e: DataFrame) -> tuple:
    row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def flow_edges(ledger: Ledger, links: DataFrame | None = None) -> DataFrame:
    """Value-weighted flow between addresses: (src, dst, w), w = input share x output amount summed over transactions.

    Repeated addresses of a side are added up before the sides meet, which leaves the sum of products unchanged. Mixing
    transactions that were traversed contribute probability x amount of their links instead.
    """
    tin, tout = ledger.tin, ledger.tout
    if links is not None:
        mixed = links.select("txid").distinct()
        tin, tout = tin.join(mixed, "txid", "left_anti"), tout.join(mixed, "txid", "left_anti")
    total = tin.groupBy("txid").agg(F.greatest(F.sum("amount"), F.lit(1e-12)).alias("total"))
    ins = tin.groupBy("txid", F.col("address").alias("src")).agg(F.sum("amount").alias("a"))
    outs = tout.groupBy("txid", F.col("address").alias("dst")).agg(F.sum("amount").alias("b"))
    e = (ins.join(total, "txid").select("txid", "src", (F.col("a") / F.col("total")).alias("share")).join(outs, "txid")
         .where("src <> dst").select("src", "dst", (F.col("share") * F.col("b")).alias("w")))
    if links is not None:
        e = e.unionByName(links.select("src", "dst", (F.col("prob") * F.col("amount")).alias("w")))
    return e.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def node_degree(edges: DataFrame, hub_degree: int = SETTINGS.hub_degree) -> DataFrame:
    """(node, degree, is_hub): number of edges at either end."""
    return (edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
            .withColumn("is_hub", F.col("degree") > hub_degree))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


@dataclass(frozen=True)
class FlowFactors:
    """The edges of flow_edges() without their pairs: w(src, dst) is the sum over transactions of source weight x target weight.

    sources and targets hold one row (txid, node, w) per transaction and address of a side, so their size is that of the ledger
    where edges grow with inputs x outputs. An address on both sides of a transaction has no edge to itself: what it would give
    itself is left out again wherever the sides meet.
    """
    sources: DataFrame
    targets: DataFrame

    def reversed(self) -> FlowFactors:
        return FlowFactors(self.targets, self.sources)

    def totals(self) -> DataFrame:
        """(node, total): weight of all edges that leave a node; nodes without any are not there."""
        sides = self.targets.groupBy("txid").agg(F.sum("w").alias("all_w"), F.count("*").alias("all_n"))
        met = self.sources.join(sides, "txid").join(self.targets.select("txid", "node", F.col("w").alias("own")), ["txid", "node"], "left")
        others = F.col("all_n") - F.col("own").isNotNull().cast("int")
        return (met.where(others > 0).groupBy("node").agg(F.sum(F.col("w") * (F.col("all_w") - F.coalesce("own", F.lit(0.0)))).alias("total")))


def flow_factors(ledger: Ledger) -> FlowFactors:
    """The factored flow of a ledger whose mixing transactions, if they were traversed, have been taken out."""
    total = ledger.tin.groupBy("txid").agg(F.greatest(F.sum("amount"), F.lit(1e-12)).alias("total"))
    side = lambda rows: rows.groupBy("txid", F.col("address").alias("node")).agg(F.sum("amount").alias("w"))
    shares = side(ledger.tin).join(total, "txid").select("txid", "node", (F.col("w") / F.col("total")).alias("w"))
    return FlowFactors(stage(shares, "flow-sources"), stage(side(ledger.tout), "flow-targets"))


def _through(sources: DataFrame, targets: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """One step of values (node, x) through transactions: (node, f) with f = sum of x(src) w(src) w(dst), loops left out.

    Values are added up per transaction before they meet its targets. A loop is subtracted inside its transaction, where the
    sum of a single giver is that giver's own term, so what only comes from a node itself is exactly zero.
    """
    own = sources.select("txid", "node", F.col("w").alias("own"))
    loops = stage(targets.join(own, ["txid", "node"]), "flow-loops")
    plain = stage(targets.join(own.select("txid", "node"), ["txid", "node"], "left_anti"), "flow-plain")

    def step(values: DataFrame) -> DataFrame:
        given = sources.join(values, "node").groupBy("txid").agg(F.sum(F.col("x") * F.col("w")).alias("y"))
        others = F.greatest(F.col("y") - F.coalesce(F.col("x") * F.col("own"), F.lit(0.0)), F.lit(0.0))
        met = plain.join(given, "txid").select("node", (F.col("w") * F.col("y")).alias("f")).unionByName(
            loops.join(given, "txid").join(values, "node", "left").select("node", (F.col("w") * others).alias("f")))
        return met.groupBy("node").agg(F.sum("f").alias("f"))

    return step


def pagerank(edges: DataFrame, seeds: DataFrame | None, max_rounds: int = SETTINGS.pagerank_max_rounds, tol: float = SETTINGS.pagerank_tol,
             alpha: float = SETTINGS.pagerank_alpha, weight: str | None = "w", nodes: DataFrame | None = None) -> DataFrame:
    """(node, rank): weighted PageRank with restart on ``seeds`` (everywhere when None); dangling mass goes to the restart set.

    Starts uniform and stops when the L1 change is below N x tol; raises if that takes more than ``max_rounds``. With a
    tolerance of 0 it makes exactly ``max_rounds`` rounds. Only two numbers per round reach the driver.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    out = stage(edges.groupBy("src").agg(F.sum(w).alias("t"), (F.count(F.lit(1)) > SETTINGS.hub_degree).alias("busy")), "pr-out", "src")
    trans = lambda rows, some: rows.join(out.where(some).drop("busy"), "src").select("src", "dst", (w / F.col("t")).alias("p"))
    # every round reads these edges by source; sources of many edges stay apart, where a join may split them
    few = stage(trans(edges.repartition("src"), "not busy"), "pr-trans", "src")
    busy = stage(out.where("busy").select(F.col("src").alias("node")), "pr-busy")
    many = stage(trans(edges.join(busy.withColumnRenamed("node", "src"), "src", "left_semi"), "busy"), "pr-trans-busy")
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    if nodes is not None:
        ends = ends.union(nodes.select("node"))

    def step(values: DataFrame) -> DataFrame:
        given = lambda v, t: v.join(t, F.col("node") == F.col("src")).select("dst", (F.col("x") * F.col("p")).alias("g"))
        met = given(values, few).unionByName(given(values.join(busy, "node", "left_semi"), many))
        return met.groupBy(F.col("dst").alias("node")).agg(F.sum("g").alias("f"))

    return _ranks(ends, out.select(F.col("src").alias("node")), seeds, step, max_rounds, tol, alpha)


def pagerank_factored(factors: FlowFactors, seeds: DataFrame | None, max_rounds: int = SETTINGS.pagerank_max_rounds, tol: float = SETTINGS.pagerank_tol,
                      alpha: float = SETTINGS.pagerank_alpha) -> DataFrame:
    """pagerank() over the flow of a ledger, from its factors: a round costs as much as the ledger has rows, not as many pairs.

    An edge of weight 0 from a node without any other gives nothing on."""
    out = stage(factors.totals(), "pr-out")
    into = factors.reversed().totals()
    sources = stage(factors.sources.join(out.where("total > 0"), "node").select("txid", "node", (F.col("w") / F.col("total")).alias("w")), "pr-sources")
    return _ranks(out.select("node").union(into.select("node")), out.select("node"), seeds, _through(sources, factors.targets), max_rounds, tol, alpha)


def _ranks(ends: DataFrame, giving: DataFrame, seeds: DataFrame | None, step: Callable[[DataFrame], DataFrame], max_rounds: int, tol: float, alpha: float) -> DataFrame:
    """The iteration of pagerank(): ``step`` moves values (node, x) along the edges and gives (node, f)."""
    base = ends.distinct().join(giving.select("node", F.lit(False).alias("dangling")), "node", "left")
    base = base.withColumn("dangling", F.coalesce("dangling", F.lit(True)))
    if seeds is None:
        base = base.withColumn("s", F.lit(1.0))
    else:
        base = base.join(seeds.select(F.col("address").alias("node"), F.lit(1.0).alias("s")), "node", "left").fillna({"s": 0.0})
    base = stage(base, "pr-nodes")
    n, total_s, n_dangling = base.agg(F.count(F.lit(1)), F.sum("s"), F.sum(F.col("dangling").cast("double"))).first()
    if not n or not total_s:
        return base.select("node", F.lit(0.0).alias("rank"))
    cur = base.select("node", "dangling", "s", F.lit(1.0 / n).alias("rank"))
    dangling, old = n_dangling / n, None
    for _ in range(max_rounds):
        nxt = cur.join(step(cur.select("node", F.col("rank").alias("x"))), "node", "left").select(
            "node", "dangling", "s",
            (alpha * F.coalesce("f", F.lit(0.0)) + (alpha * dangling + 1 - alpha) * F.col("s") / F.lit(float(total_s))).alias("rank"),
            F.col("rank").alias("prev"))
        nxt = stage(nxt, "pr-round")
        delta, dangling = nxt.agg(F.sum(F.abs(F.col("rank") - F.col("prev"))), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))).first()
        if old is not None:
            drop_stage(old)
        cur = old = nxt
        if delta < n * tol:
            break
    else:
        if tol > 0:
            raise RuntimeError(f"ranks have not converged after {max_rounds} rounds")
    return cur.select("node", "rank")


def scaled_to_max(ranks: DataFrame, out: str) -> DataFrame:
    top = ranks.agg(F.max("rank")).first()[0] or 1.0
    return ranks.select("node", (F.col("rank") / F.lit(float(top or 1.0))).alias(out))


def passing_arcs(edges: DataFrame, degree: DataFrame) -> DataFrame:
    """The edges that do not leave a hub, written in the order of their source: rounds and hops read them without moving them.

    ``degree`` is node_degree() of the edges; a source here has no more edges than its bound. Null ends lead nowhere.
    """
    hubs = degree.where("is_hub").select(F.col("node").alias("src"))
    return stage(edges.where("src is not null").repartition("src").join(hubs, "src", "left_anti"), "passing-arcs", "src")


def haircut_taint(edges: DataFrame, seeds: DataFrame, hub_degree: int = SETTINGS.hub_degree, rounds: int = SETTINGS.taint_rounds,
                  decay: float = SETTINGS.taint_decay, stage_every: int = 4, degree: DataFrame | None = None, arcs: DataFrame | None = None) -> DataFrame:
    """(node, taint) of every node with taint > 0: the decayed share of incoming value that traces back to seeds.

    Hubs take taint in and pass none on. Only tainted nodes are carried from round to round. ``degree`` (node_degree() of the
    edges) and ``arcs`` (their passing_arcs()) are taken from a caller that has them.
    """
    degree = stage(node_degree(edges, hub_degree), "taint-degree") if degree is None else degree
    arcs = passing_arcs(edges, degree) if arcs is None else arcs
    into = stage(edges.groupBy("dst").agg(F.sum("w").alias("t")).select("dst", F.when(F.col("t") == 0, 1.0).otherwise(F.col("t")).alias("t")), "taint-into", "dst")
    start = stage(seeds.select(F.col("address").alias("node")).join(degree.select("node"), "node", "left_semi").withColumn("taint", F.lit(1.0)), "taint-seeds")
    targets = stage(into.join(start.select(F.col("node").alias("dst")), "dst", "left_anti"), "taint-targets", "dst")
    cur = start
    for i in range(rounds):
        flow = (cur.join(arcs, cur.node == arcs.src).groupBy("dst").agg(F.sum(F.col("taint") * F.col("w")).alias("f")).join(targets, "dst")
                .select(F.col("dst").alias("node"), F.least(F.lit(1.0), F.lit(decay) * F.col("f") / F.col("t")).alias("taint")))
        cur = start.unionByName(flow.where("taint > 0"))
        if (i + 1) % stage_every == 0:
            cur = stage(cur, "taint-round")
    return cur


def haircut_taint_factored(factors: FlowFactors, seeds: DataFrame, hubs: DataFrame, rounds: int = SETTINGS.taint_rounds, decay: float = SETTINGS.taint_decay, stage_every: int = 4) -> DataFrame:
    """haircut_taint() from the factors of a ledger's flow; ``hubs`` (node) pass no taint on."""
    into = stage(factors.reversed().totals(), "taint-in")
    step = _through(stage(factors.sources.join(hubs.select("node"), "node", "left_anti"), "taint-sources"), factors.targets)
    nodes = into.select("node").union(factors.totals().select("node"))
    start = stage(seeds.select(F.col("address").alias("node")).distinct().join(nodes, "node", "left_semi").withColumn("taint", F.lit(1.0)), "taint-seeds")
    targets = stage(into.join(start, "node", "left_anti").where("total > 0"), "taint-targets")
    cur = start
    for i in range(rounds):
        flow = step(cur.select("node", F.col("taint").alias("x"))).join(targets, "node").select("node", F.least(F.lit(1.0), F.lit(decay) * F.col("f") / F.col("total")).alias("taint"))
        cur = start.unionByName(flow.where("taint > 0"))
        if (i + 1) % stage_every == 0:
            cur = stage(cur, "taint-round")
    return cur


def bfs_hops(edges: DataFrame, seeds: DataFrame, max_hops: int = SETTINGS.max_hops, hub_degree: int = SETTINGS.hub_degree,
             undirected: bool = False, with_path: bool = False, degree: DataFrame | None = None, arcs: list[DataFrame] | None = None) -> DataFrame:
    """(node, hops[, path]) for nodes within reach of the seeds; hubs are entered but not passed, unless they are seeds.

    Of several parents in one step the smallest is kept, so paths are reproducible. Use :func:`reverse` for upstream hops.
    ``degree`` (node_degree() of the edges, in either direction) and ``arcs`` (passing_arcs() of the edges, for undirected hops
    also those of the reversed ones) are taken from a caller that has them.
    """
    deg = stage(node_degree(edges, hub_degree), "bfs-degree") if degree is None else degree
    ways = [edges.select("src", "dst")] + ([reverse(edges.select("src", "dst"))] if undirected else [])
    start = seeds.select(F.col("address").alias("node")).join(deg.select("node"), "node", "left_semi")
    seen = stage(start.select("node", F.lit(0).alias("hops"), F.array("node").alias("path")), "bfs-0")
    # hubs pass on from seeds only, which is the first hop
    hub_seeds = stage(seen.select(F.col("node").alias("src")).join(deg.where("is_hub").select(F.col("node").alias("src")), "src", "left_semi"), "bfs-hub-seeds")
    arcs = [passing_arcs(w, deg) for w in ways] if arcs is None else arcs
    frontier, levels = seen, [seen]
    for hop in range(1, max_hops + 1):
        on = arcs + ([w.join(hub_seeds, "src", "left_semi") for w in ways] if hop == 1 else [])
        steps = [frontier.join(a, F.col("node") == F.col("src")).select(F.col("dst"), "path", F.col("node").alias("parent")) for a in on]
        step = steps[0]
        for more in steps[1:]:
            step = step.unionByName(more)
        if with_path:
            best = step.groupBy("dst").agg(F.min(F.struct("parent", "path")).alias("b")).select(
                F.col("dst").alias("node"), F.lit(hop).alias("hops"), F.concat("b.path", F.array("dst")).alias("path"))
        else:
            best = step.select(F.col("dst").alias("node"), F.lit(hop).alias("hops"), F.array().cast("array<string>").alias("path")).distinct()
        known = levels[0].select("node")
        for level in levels[1:]:
            known = known.union(level.select("node"))
        frontier = stage(best.join(known, "node", "left_anti"), f"bfs-{hop}")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out if with_path else out.drop("path")


def hop_features(down: DataFrame, up: DataFrame, anyway: DataFrame, nodes: DataFrame, s=SETTINGS) -> DataFrame:
    """The three hop counts per node: missing means 99, and everything is capped at 20."""
    name = lambda df, c: df.select("node", F.col("hops").alias(c))
    j = nodes.select("node")
    for df, c in ((down, "hops_from_seed"), (up, "hops_to_seed"), (anyway, "hops_any_seed")):
        j = j.join(name(df, c), "node", "left")
    cap = lambda c: F.least(F.coalesce(c, F.lit(s.hops_missing)), F.lit(s.hops_cap)).alias(c)
    return j.select("node", cap("hops_from_seed"), cap("hops_to_seed"), cap("hops_any_seed"))


def sign_features(edges: DataFrame, wallets: DataFrame, key: str, columns: list[str], hub_degree: int = SETTINGS.hub_degree,
                  hops: int = 2) -> DataFrame:
    """Mean of the standardised ``columns`` over 1- and 2-hop neighbours, along and against the flow, hubs cut out."""
    filled = wallets.select(F.col(key).alias("node"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    stats = filled.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.avg, F.stddev_pop)]).first()  # one row
    z = lambda c: (F.col(c) - F.lit(stats[f"avg_{c}"])) / F.lit(stats[f"stddev_pop_{c}"] or 1.0)
    base = stage(filled.select("node", *[z(c).alias(c) for c in columns]), "sign-base")
    hubs = node_degree(edges, hub_degree).where("is_hub").select("node")
    live = base.select("node")
    arcs = edges.select("src", "dst")
    for end in ("src", "dst"):
        arcs = (arcs.join(hubs.withColumnRenamed("node", end), end, "left_anti")
                .join(live.withColumnRenamed("node", end), end, "left_semi"))
    arcs = stage(arcs.select("src", "dst"), "sign-arcs")
    result = live
    for name, near, far in (("out", "src", "dst"), ("in", "dst", "src")):
        h = base
        for k in range(1, hops + 1):
            # a neighbour without a row of its own counts as zero
            h = (arcs.select(F.col(near).alias("at"), F.col(far).alias("node")).join(h, "node", "left").groupBy(F.col("at").alias("node"))
                 .agg(*[F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in columns]))
            h = stage(h, f"sign-{name}{k}")
            result = result.join(h.select("node", *[F.col(c).alias(f"gnn_{name}{k}_{c}") for c in columns]), "node", "left")
    return result.fillna(0.0).withColumnRenamed("node", key)


def structure_features(edges: DataFrame, nodes: DataFrame, rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """In- and out-degree, log PageRank, and the largest and mean degree of the (undirected) neighbours."""
    arcs = edges.select("src", "dst").where("src <> dst").distinct()
    out = arcs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = arcs.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    both = arcs.union(arcs.select("dst", "src")).distinct().toDF("node", "other")
    deg = both.groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
    near = (both.join(deg.withColumnRenamed("node", "other"), "other").groupBy("node")
            .agg(F.max("deg").alias("nbr_max_degree"), F.avg("deg").alias("nbr_mean_degree")))
    ranks = pagerank(arcs, None, rounds, tol, weight=None, nodes=nodes)
    return (nodes.select("node").join(out, "node", "left").join(into, "node", "left").join(ranks, "node").join(near, "node", "left")
            .fillna(0, subset=["out_degree", "in_degree", "nbr_max_degree"]).fillna(0.0, subset=["nbr_mean_degree"])
            .select("node", "in_degree", "out_degree", F.log("rank").alias("log_pagerank"), "nbr_max_degree", "nbr_mean_degree"))


def sibling_funders(ledger: Ledger) -> DataFrame:
    """(address, funder): the input addresses of the transactions that paid an address."""
    paid = ledger.tout.select("txid", "address").distinct()
    return paid.join(ledger.tin.select("txid", F.col("address").alias("funder")).distinct(), "txid").select("address", "funder").distinct()
