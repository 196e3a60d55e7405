"""Queries for clusters, mixers and the flow graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.config import SETTINGS
from tracewell.operators import clusters as C
from tracewell.operators import graph as G
from tracewell.operators import mixer as M
from tracewell.operators import tx_features as T
from tracewell.operators import wallet_features as Wf
from tracewell.plans import derived as D
from tracewell.plans import queries_wallet  # noqa: F401  (its table expressions are used below)
from tracewell.plans.oracle import cte, r, with_ctes
from tracewell.plans.queries_ledger import r6
from tracewell.plans.registry import query

HUB = 20  # adapter A has no address above the default of 60

# -- clusters --------------------------------------------------------------------------------------
cte("coinjoin", ("tx",), "SELECT txid FROM tx WHERE txid % 11 = 0")
cte("sender", ("tin", "coinjoin"), "SELECT txid, min(address) AS sender, count(*) AS n FROM tin WHERE txid NOT IN (SELECT txid FROM coinjoin) GROUP BY 1")
cte("cl1", ("tin", "sender"), "SELECT DISTINCT sender AS a, address AS b FROM tin JOIN sender USING (txid) WHERE n >= 2 AND address <> sender")
cte("facts", ("tin", "tout", "fp", "swept", "coinjoin"), """
  SELECT a.address, a.first_seen, w.address IS NOT NULL AS swept, f.software AS spend_software
  FROM (SELECT address, min(ts) AS first_seen FROM tout GROUP BY 1) a LEFT JOIN swept w USING (address)
  LEFT JOIN (SELECT address, arg_min(txid, (ts, txid)) AS txid FROM tin WHERE txid NOT IN (SELECT txid FROM coinjoin) GROUP BY 1) s USING (address)
  LEFT JOIN fp f ON f.txid = s.txid""")
cte("two", ("tout", "facts", "shape", "sender", "fp"), """
  SELECT o.txid, any_value(sender) AS sender, any_value(fp.software) AS software, any_value(peel_shape) AS peel,
         list({'address': o.address, 'amount': o.amount, 'fresh': f.first_seen = o.ts, 'precise': CAST(round(o.amount * 1e8) AS BIGINT) % 100 <> 0,
               'swept': f.swept, 'sw': f.spend_software} ORDER BY o.idx) AS o
  FROM tout o JOIN facts f USING (address) JOIN shape s ON s.txid = o.txid AND s.n_out = 2 AND s.n_in >= 1 JOIN sender d ON d.txid = o.txid LEFT JOIN fp ON fp.txid = o.txid
  GROUP BY o.txid""")
cte("cl23", ("two",), """
  SELECT txid, sender AS a, CASE WHEN by_amount THEN ch[1].address ELSE same[1].address END AS b, CASE WHEN by_amount THEN 'CHANGE' ELSE 'FINGERPRINT' END AS rule FROM (
    SELECT *, len(ch) = 1 AND n_precise = 1 AND NOT (ch[1].swept OR (peel = 1 AND ch[1].address = smaller) OR coalesce(software <> ch[1].sw, false)) AS by_amount,
           len(ch) = 0 AND len(same) = 1 AND len(other) = 1 AS by_software FROM (
      SELECT *, list_filter(o, lambda x: x.precise AND x.fresh) AS ch, len(list_filter(o, lambda x: x.precise)) AS n_precise,
             CASE WHEN o[1].amount <= o[2].amount THEN o[1].address ELSE o[2].address END AS smaller,
             list_filter(o, lambda x: x.fresh AND NOT x.swept AND x.sw = software) AS same,
             list_filter(o, lambda x: x.sw IS NOT NULL AND x.sw IS DISTINCT FROM software) AS other FROM two))
  WHERE by_amount OR by_software""")


def coinjoins(fx):
    return fx.tx_a.where("txid % 11 = 0").select("txid")


def parts(fx):
    sender = fx._stage("cl-sender", lambda: C.senders(fx.tin_a, coinjoins(fx)))
    facts = fx._stage("cl-facts", lambda: C.address_facts(fx.sides, coinjoins(fx), D.swept(fx)))
    outs = fx._stage("cl-outs", lambda: C.described_outputs(fx.sides, facts))
    return sender, facts, outs


@query("cl1_common_input_edges", with_ctes(["cl1"], "SELECT a, b FROM cl1"))
def cl1(fx):
    return C.common_input_edges(fx.tin_a, parts(fx)[0])


@query("cl2_change_edges", with_ctes(["cl23"], "SELECT txid, a, b FROM cl23 WHERE rule = 'CHANGE'"))
def cl2(fx):
    sender, _, outs = parts(fx)
    return C.two_output_change(fx.sides, D.shape(fx), sender, outs).where("rule = 'CHANGE'").drop("rule")


@query("cl3_fingerprint_change_edges", with_ctes(["cl23"], "SELECT txid, a, b FROM cl23 WHERE rule = 'FINGERPRINT'"))
def cl3(fx):
    sender, _, outs = parts(fx)
    return C.two_output_change(fx.sides, D.shape(fx), sender, outs).where("rule = 'FINGERPRINT'").drop("rule")


CHAIN_SQL = """
  sym AS MATERIALIZED (SELECT a, b FROM blink UNION SELECT b, a FROM blink),
  reach(txid, seen) AS (SELECT txid, txid FROM bshape WHERE peel = 1 UNION SELECT r.txid, s.b FROM reach r JOIN sym s ON s.a = r.seen),
  comp AS MATERIALIZED (SELECT txid, min(seen) AS root FROM reach GROUP BY 1),
  clen AS MATERIALIZED (SELECT txid, n FROM comp JOIN (SELECT root, count(*) AS n FROM comp GROUP BY 1) USING (root))"""


@query("cl4_peel_change_edges", with_ctes(["blink", "bspent", "btin", "bshape"], """
    SELECT b.txid, i.address AS a, b.address AS b FROM (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY amount DESC, idx) AS k FROM bspent) b
    JOIN clen ON clen.txid = b.txid AND n >= 3 JOIN btin i ON i.txid = b.txid WHERE b.k = 1""", recursive=True, extra=CHAIN_SQL))
def cl4(fx):
    b = fx.b
    spent = T.spent_outputs(b)
    none = b.tx.where("false").select("txid")
    facts = C.address_facts(b, none, b.tin.where("false").select("address"))
    return C.peel_change_edges(T.peel_chains(T.tx_shape(b), spent), T.largest_output(spent), b, C.senders(b.tin, none), facts)


cte("stout", ("li",), """
  SELECT l_orderkey AS txid, ts, CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey AS idx,
         concat_ws('_', 'S', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS address,
         CASE WHEN l_linenumber = 1 AND l_orderkey % 2 = 0 THEN 5.0::DOUBLE ELSE round(1 + CASE WHEN l_orderkey % 5 = 0 THEN 0.05::DOUBLE ELSE 0.0005::DOUBLE END * (l_partkey % 50), 8) END AS amount
  FROM li JOIN (SELECT l_orderkey AS k FROM li GROUP BY 1 HAVING count(*) >= 7) ON k = l_orderkey""")


@query("cl5_self_split_edges", with_ctes(["stout", "tin", "coinjoin", "sender"], """
    SELECT o.txid, sender AS a, o.address AS b FROM stout o JOIN sender USING (txid) WHERE o.txid IN (SELECT txid FROM ok)""", extra="""
    dev AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY txid) AS n, row_number() OVER (PARTITION BY txid ORDER BY abs(amount - med) DESC, idx) AS far FROM (
        SELECT s.*, quantile_cont(amount, 0.5) OVER (PARTITION BY txid) AS med FROM stout s WHERE txid NOT IN (SELECT txid FROM coinjoin))),
    cv AS MATERIALIZED (SELECT txid FROM dev WHERE n = 7 OR far > 1 GROUP BY 1 HAVING stddev_pop(amount) / avg(amount) <= 0.05),
    sdeg AS MATERIALIZED (SELECT address, count(DISTINCT txid) AS d FROM (SELECT txid, address FROM tin WHERE txid IN (SELECT txid FROM stout) UNION SELECT txid, address FROM stout) GROUP BY 1),
    ok AS MATERIALIZED (SELECT txid FROM tin JOIN sdeg USING (address) WHERE txid IN (SELECT txid FROM cv) GROUP BY 1 HAVING max(d) <= 6)"""))
def cl5(fx):
    s = fx.s
    cj = coinjoins(fx)
    facts = C.address_facts(s, cj, s.tin.where("false").select("address"))
    return C.self_split_edges(s, C.senders(s.tin, cj), C.described_outputs(s, facts), Wf.address_degree(s))


def clusters(fx):
    """Cluster of every address of adapter A."""
    def build():
        sender, _, outs = parts(fx)
        edges = (C.common_input_edges(fx.tin_a, sender).select("a", "b")
                 .unionByName(C.two_output_change(fx.sides, D.shape(fx), sender, outs).select("a", "b")))
        return C.cluster_ids(fx.addresses, edges)
    return fx._stage("cl-clusters", build)


# min-label rounds until nothing changes
CLUSTER_SQL = """
  cedge AS MATERIALIZED (SELECT a, b FROM cl1 UNION SELECT b, a FROM cl1 UNION SELECT a, b FROM cl23 UNION SELECT b, a FROM cl23),
  creach(address, seen) AS (SELECT DISTINCT a, a FROM cedge UNION SELECT q.address, e.b FROM creach q JOIN cedge e ON e.a = q.seen),
  croot AS MATERIALIZED (SELECT address, coalesce(root, address) AS root FROM addr LEFT JOIN (SELECT address, min(seen) AS root FROM creach GROUP BY 1) USING (address)),
  clusters AS MATERIALIZED (SELECT address, root AS cluster_root, CASE WHEN n > 1 THEN 'C-' ELSE 'SOLO-' END || upper(substr(sha1(root), 1, 8)) AS cluster_id, n AS size
     FROM croot JOIN (SELECT root, count(*) AS n FROM croot GROUP BY 1) USING (root))"""


@query("cl6_cluster_ids", with_ctes(["cl1", "cl23", "addr"], "SELECT address, cluster_root, cluster_id, size FROM clusters", recursive=True, extra=CLUSTER_SQL))
def cl6(fx):
    return clusters(fx)


@query("cl6_merge_report", with_ctes(["cl1", "cl23", "addr"], """
    SELECT (SELECT count(*) FROM sender WHERE n >= 2) AS cioh_merges, (SELECT count(*) FROM cl23 WHERE rule = 'CHANGE') AS change_merges,
           (SELECT count(*) FROM cl23 WHERE rule = 'FINGERPRINT') AS fingerprint_change_merges, (SELECT count(DISTINCT cluster_root) FROM clusters) AS clusters,
           (SELECT count(DISTINCT cluster_root) FROM clusters WHERE size > 1) AS multi_address_clusters""", recursive=True, extra=CLUSTER_SQL))
def cl6_report(fx):
    """How many merges each heuristic made and how many clusters came out."""
    sender, _, outs = parts(fx)
    two = C.two_output_change(fx.sides, D.shape(fx), sender, outs).select("rule")
    counts = two.unionByName(sender.where("n_in >= 2").select(F.lit("INPUTS").alias("rule")))
    cl = clusters(fx).groupBy("cluster_root").agg(F.max("size").alias("size"))
    named = counts.unionByName(cl.select(F.lit("CLUSTER").alias("rule"))).unionByName(cl.where("size > 1").select(F.lit("MULTI").alias("rule")))
    n = lambda k: F.sum((F.col("rule") == k).cast("long"))
    return named.agg(n("INPUTS").alias("cioh_merges"), n("CHANGE").alias("change_merges"), n("FINGERPRINT").alias("fingerprint_change_merges"),
                     n("CLUSTER").alias("clusters"), n("MULTI").alias("multi_address_clusters"))


@query("cl7_behaviour_groups")
def cl7(fx):
    cl = clusters(fx)
    w = Wf.with_times(Wf.wallet_totals(fx.sides)).select("address", "n_recv", "n_spend", "log_recv_btc", "hold_h").join(cl.select("address", "cluster_root"), "address")
    return C.behaviour_groups(w, C.cluster_flow(fx.tin_a, fx.tout_a, cl))


# -- mixers ----------------------------------------------------------------------------------------
cte("mpool", ("mtin", "mtout", "mtx"), """
  SELECT d.txid, denom_sats, denom_sats / 1e8 AS denom, k, n_eligible, greatest(coalesce(fee, 0), 0) / k AS slack, greatest(0.5 * greatest(coalesce(fee, 0), 0) / k, 2e-6) AS tol
  FROM (SELECT txid, arg_max(sats, (c, sats)) AS denom_sats, max(c) AS k FROM (SELECT txid, CAST(round(amount * 1e8) AS BIGINT) AS sats, count(*) AS c FROM mtout GROUP BY 1, 2) GROUP BY 1) d
  JOIN (SELECT txid AS t, list(CAST(round(amount * 1e8) AS BIGINT)) AS a FROM mtin GROUP BY 1) i ON t = d.txid
  JOIN LATERAL (SELECT len(list_filter(a, lambda v: v >= denom_sats)) AS n_eligible) e ON true
  LEFT JOIN mtx x ON x.txid = d.txid WHERE k >= 3 AND len(a) >= k AND n_eligible >= k""")
cte("mlinks", ("mpool",), """
  SELECT txid, src, dst, prob, kind, amount, k FROM (
    SELECT o.txid, i.address AS src, o.address AS dst, 1.0::DOUBLE / n_eligible AS prob, 'POOL' AS kind, o.amount, k
    FROM mtout o JOIN mpool p ON p.txid = o.txid AND CAST(round(o.amount * 1e8) AS BIGINT) = denom_sats JOIN mtin i ON i.txid = o.txid AND CAST(round(i.amount * 1e8) AS BIGINT) >= denom_sats
    UNION ALL
    SELECT txid, src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY txid, idx, dst) AS prob, kind, amount, k FROM (
      SELECT o.txid, o.idx, i.address AS src, o.address AS dst, o.amount, p.k,
             CASE WHEN CAST(round(i.amount * 1e8) AS BIGINT) >= denom_sats AND abs((i.amount - denom - o.amount) - slack) <= tol THEN 'CHANGE' ELSE 'UNEXPLAINED' END AS kind,
             max(CASE WHEN CAST(round(i.amount * 1e8) AS BIGINT) >= denom_sats AND abs((i.amount - denom - o.amount) - slack) <= tol THEN 1 ELSE 0 END) OVER (PARTITION BY o.txid, o.idx, o.address) AS any_fit,
             i.amount >= o.amount AS big
      FROM mtout o JOIN mpool p ON p.txid = o.txid AND CAST(round(o.amount * 1e8) AS BIGINT) <> denom_sats JOIN mtin i ON i.txid = o.txid)
    WHERE (any_fit = 1 AND kind = 'CHANGE') OR (any_fit = 0 AND big))
  WHERE src <> dst""")


def mixer_ids(fx):
    return fx.m.tx.select("txid")


def links(fx):
    return fx._stage("m-links", lambda: M.mixer_links(fx.m, mixer_ids(fx)), "txid")


@query("mx1_mixer_links", with_ctes(["mlinks"], f"SELECT txid, src, dst, {r('prob')} AS prob, kind, amount, k FROM mlinks"))
def mx1(fx):
    return links(fx).withColumn("prob", r6("prob"))


@query("mx2_mixer_report", with_ctes(["mlinks", "mpool", "mtx"], """
    SELECT (SELECT count(*) FROM mtx) AS mixing_transactions, (SELECT count(*) FROM mpool) AS traversed, (SELECT quantile_cont(k, 0.5) FROM mpool) AS median_anonymity_set,
           count(*) FILTER (kind = 'CHANGE') AS change_links, count(*) FILTER (kind = 'POOL') AS pool_links, count(*) FILTER (kind = 'UNEXPLAINED') AS unexplained_links FROM mlinks"""))
def mx2(fx):
    return M.mixer_report(mixer_ids(fx), M.pools(fx.m, mixer_ids(fx)), links(fx))


cte("mtaint", ("mlinks",), "SELECT address, ((ascii(substr(address, length(address), 1)) * 37) % 100) / 100.0 AS taint FROM (SELECT src AS address FROM mlinks UNION SELECT dst FROM mlinks)")


def link_ends(fx):
    """The addresses at either end of a link."""
    return fx._stage("m-ends", lambda: links(fx).select(F.explode(F.array("src", "dst")).alias("address")).distinct())


def mix_taint(fx):
    return link_ends(fx).withColumn("taint", ((F.ascii(F.substring("address", -1, 1)) * 37) % 100) / 100.0)


@query("mx3_mixer_exposure", with_ctes(["mlinks", "mtaint"], f"""
    SELECT wallet, txid, role, anonymity_set, link_kind, top, {r('inherited')} AS inherited_taint FROM (
      SELECT wallet, txid, role, max(k) AS anonymity_set, CASE WHEN bool_or(kind = 'POOL') THEN 'POOL' ELSE min(kind) END AS link_kind,
             string_agg(other, ',' ORDER BY rn) FILTER (rn <= 4) AS top, CASE WHEN role = 'RECEIVED' THEN sum(p4 * t4) ELSE 0 END AS inherited FROM (
        SELECT *, row_number() OVER (PARTITION BY wallet, txid, role ORDER BY -p4 * t4, -p4, other) AS rn FROM (
          SELECT dst AS wallet, txid, 'RECEIVED' AS role, src AS other, round(prob, 4) AS p4, kind, k, round(coalesce(taint, 0), 4) AS t4 FROM mlinks LEFT JOIN mtaint ON address = src
          UNION ALL SELECT src, txid, 'SENT', dst, round(prob, 4), kind, k, round(coalesce(taint, 0), 4) FROM mlinks LEFT JOIN mtaint ON address = dst)) GROUP BY 1, 2, 3)"""))
def mx3(fx):
    wallets = mix_taint(fx).select("address")
    e = M.exposure(links(fx), mix_taint(fx), wallets)
    return e.select("wallet", "txid", "role", "anonymity_set", "link_kind", F.array_join(F.col("candidates.address"), ",").alias("top"),
                    r6(F.coalesce("inherited_taint", F.lit(0.0))).alias("inherited_taint"))


# owner truth for the mixes: the amount of a change output names its input, so outputs C.. and inputs share a part number
cte("mowner", ("mlinks",), """
  SELECT address, CASE WHEN address LIKE 'A%' THEN CAST(substr(address, 2) AS BIGINT) // 6 ELSE CAST(split_part(address, '_', 3) AS BIGINT) END AS entity_id
  FROM (SELECT src AS address FROM mlinks UNION SELECT dst FROM mlinks)""")


@query("mx4_mixer_eval", with_ctes(["mlinks", "mowner"], f"""
    SELECT {r("avg(CASE WHEN same THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (kind = 'CHANGE' AND prob >= 0.99)")} AS change_link_precision_p1,
           count(*) FILTER (kind = 'CHANGE' AND prob >= 0.99) AS change_links_certain,
           count(DISTINCT dst) FILTER (kind <> 'POOL' AND same) AS change_true_pairs_found, {r("avg(prob) FILTER (kind = 'POOL' AND same)")} AS pool_mean_true_link_prob
    FROM (SELECT l.*, a.entity_id = b.entity_id AS same FROM mlinks l JOIN mowner a ON a.address = src JOIN mowner b ON b.address = dst)"""))
def mx4(fx):
    a = link_ends(fx)
    owner = F.when(F.col("address").startswith("A"), F.floor(F.substring("address", 2, 20).cast("long") / 6)).otherwise(
        F.split("address", "_")[2].cast("long"))
    e = M.evaluate_links(links(fx), a.where("address like 'A%'").unionByName(a.where("address not like 'A%'")).withColumn("entity_id", owner))
    return e.withColumns({c: r6(c) for c in ("change_link_precision_p1", "pool_mean_true_link_prob")})


@query("mx5_mixer_ranking", with_ctes(["mlinks", "mtaint", "mtx"], """
    SELECT m.txid, count(DISTINCT src) FILTER (kind = 'POOL') AS anonymity_set, count(*) FILTER (kind = 'CHANGE' AND prob >= 0.99) AS certain_change,
           count(*) FILTER (kind = 'CHANGE') AS change_links, count(DISTINCT src) AS participants, epoch_us(any_value(t.ts)) AS ts_us,
           count(DISTINCT src) FILTER (taint > 0.01) AS tainted_inputs
    FROM mlinks m LEFT JOIN mtx t ON t.txid = m.txid LEFT JOIN mtaint ON address = src GROUP BY 1
    ORDER BY certain_change DESC, anonymity_set, ts_us DESC, m.txid LIMIT 50"""))
def mx5(fx):
    t = M.mixing_ranking(links(fx), fx.m.tx.select("txid", "ts"), mix_taint(fx))
    return t.withColumn("ts_us", F.unix_micros("ts")).drop("ts")


@query("mx6_mixer_matrix", with_ctes(["mlinks", "mtaint"], f"""
    SELECT txid, src, dst, {r('prob')} AS prob, kind, amount, a.taint AS src_taint, b.taint AS dst_taint
    FROM mlinks JOIN mtaint a ON a.address = src JOIN mtaint b ON b.address = dst"""))
def mx6(fx):
    return M.mixing_matrix(links(fx), mix_taint(fx)).withColumn("prob", r6("prob")).drop("k")


# -- flow graph ------------------------------------------------------------------------------------
cte("flow", ("tin", "tout"), """
  SELECT src, dst, sum(w) AS w FROM (
    SELECT i.address AS src, o.address AS dst, i.amount / greatest(t.total, 1e-12) * o.amount AS w
    FROM tin i JOIN tout o USING (txid) JOIN (SELECT txid, sum(amount) AS total FROM tin GROUP BY 1) t USING (txid) WHERE i.address <> o.address) GROUP BY 1, 2""")
cte("degree", ("flow",), "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM flow UNION ALL SELECT dst FROM flow) GROUP BY 1")


def flow(fx):
    return fx._stage("g-flow", lambda: G.flow_edges(fx.sides))


def flow_degree(fx):
    return fx._stage("g-degree", lambda: G.node_degree(flow(fx), HUB))


def flow_arcs(fx):
    """The arcs of the flow that do not leave a hub, written once for the taint and the hops."""
    if not hasattr(fx, "_flow_arcs"):
        fx._flow_arcs = G.passing_arcs(flow(fx), flow_degree(fx))
    return fx._flow_arcs


@query("gr1_connected_components", with_ctes(["cl1", "addr"], """
    SELECT DISTINCT address AS node, root FROM croot WHERE address IN (SELECT a FROM cedge)""", recursive=True, extra="""
  cedge AS MATERIALIZED (SELECT a, b FROM cl1 UNION SELECT b, a FROM cl1),
  creach(address, seen) AS (SELECT DISTINCT a, a FROM cedge UNION SELECT q.address, e.b FROM creach q JOIN cedge e ON e.a = q.seen),
  croot AS MATERIALIZED (SELECT address, min(seen) AS root FROM creach GROUP BY 1)"""))
def gr1(fx):
    return G.connected_components(C.common_input_edges(fx.tin_a, parts(fx)[0]), "a", "b")


@query("gr2_flow_edges", with_ctes(["flow"], f"SELECT src, dst, {r('w', 8)} AS w FROM flow"))
def gr2(fx):
    return G.flow_edges(fx.sides).withColumn("w", r6("w", 8))


@query("gr2_flow_edges_with_mixers", with_ctes(["mlinks"], f"""
    SELECT src, dst, {r('sum(prob * amount)')} AS w FROM mlinks GROUP BY 1, 2"""))
def gr2m(fx):
    """Every transaction of adapter M is traversed, so its flow comes from the links alone."""
    return G.flow_edges(fx.m, links(fx)).withColumn("w", r6("w"))


@query("gr3_node_degree_hubs", with_ctes(["degree"], f"SELECT node, degree, degree > {HUB} AS is_hub FROM degree"))
def gr3(fx):
    return G.node_degree(flow(fx), HUB)


def _pagerank_sql(rounds: int, edges: str, reverse: bool) -> str:
    s, d = ("dst", "src") if reverse else ("src", "dst")
    steps = [f"""
  tr AS MATERIALIZED (SELECT e.{s} AS src, e.{d} AS dst, e.w / t AS p FROM {edges} e JOIN (SELECT {s} AS k, sum(w) AS t FROM {edges} GROUP BY 1) ON k = e.{s}),
  nd AS MATERIALIZED (SELECT node, node NOT IN (SELECT src FROM tr) AS dangling, CASE WHEN node IN (SELECT address FROM seeds) THEN 1.0::DOUBLE / (SELECT count(*) FROM seeds WHERE address IN (SELECT node FROM degree)) ELSE 0 END AS s
     FROM degree),
  x0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS v FROM nd)"""]
    for i in range(1, rounds + 1):
        steps.append(f"""
  x{i} AS MATERIALIZED (SELECT nd.node, 0.85 * coalesce(f, 0) + (0.85 * (SELECT coalesce(sum(v), 0) FROM x{i-1} JOIN nd USING (node) WHERE dangling) + 0.15) * nd.s AS v
     FROM nd LEFT JOIN (SELECT dst AS node, sum(v * p) AS f FROM tr JOIN x{i-1} ON node = src GROUP BY 1) USING (node))""")
    return ",".join(steps)


PR_ROUNDS = 6


def _converged_sql() -> str:
    """Rounds until the L1 change of one is below nodes x tolerance, as the operator stops; the last round's values are the ranks."""
    return _pagerank_sql(0, "flow", False) + f""",
  xs AS (
    SELECT node, v, 0 AS k, CAST('inf' AS DOUBLE) AS moved FROM x0
    UNION ALL
    SELECT node, v, k, sum(abs(v - old)) OVER () AS moved FROM (
      SELECT nd.node, 0.85 * coalesce(f, 0) + (0.85 * (SELECT coalesce(sum(v), 0) FROM xs JOIN nd USING (node) WHERE dangling) + 0.15) * nd.s AS v, was.v AS old, was.k + 1 AS k
      FROM xs was JOIN nd USING (node) LEFT JOIN (SELECT dst AS node, sum(v * p) AS f FROM tr JOIN xs ON node = src GROUP BY 1) g ON g.node = nd.node
      WHERE was.k < {SETTINGS.pagerank_max_rounds} AND was.moved >= {SETTINGS.pagerank_tol} * (SELECT count(*) FROM nd)))"""


@query("gr4_personalised_pagerank", with_ctes(["flow", "degree", "seeds"], f"""
    SELECT node, {r('v / max(v) OVER ()', 5)} AS ppr FROM xs WHERE k = (SELECT max(k) FROM xs)""", recursive=True, extra=_converged_sql()))
def gr4(fx):
    """At the operator's own rounds and tolerance."""
    return G.scaled_to_max(G.pagerank(flow(fx), fx.seeds), "ppr").withColumn("ppr", r6("ppr", 5))


@query("gr4_personalised_pagerank_reverse", with_ctes(["flow", "degree", "seeds"], f"""
    SELECT node, {r(f'v / (SELECT max(v) FROM x{PR_ROUNDS})', 5)} AS ppr_reverse FROM x{PR_ROUNDS}""", extra=_pagerank_sql(PR_ROUNDS, "flow", True)))
def gr4r(fx):
    return G.scaled_to_max(G.pagerank(G.reverse(flow(fx)), fx.seeds, PR_ROUNDS, 0.0), "ppr_reverse").withColumn("ppr_reverse", r6("ppr_reverse", 5))


@query("gr4_personalised_pagerank_factored", with_ctes(["flow", "degree", "seeds"], f"""
    SELECT node, {r(f'v / (SELECT max(v) FROM x{PR_ROUNDS})', 5)} AS ppr FROM x{PR_ROUNDS}""", extra=_pagerank_sql(PR_ROUNDS, "flow", False)))
def gr4_factored(fx):
    return G.scaled_to_max(G.pagerank_factored(G.flow_factors(fx.sides), fx.seeds, PR_ROUNDS, 0.0), "ppr").withColumn("ppr", r6("ppr", 5))


@query("gr4_personalised_pagerank_converged")
def gr4_converged(fx):
    """At the operator's own rounds and tolerance, in both directions."""
    factors = G.flow_factors(fx.sides)
    down = G.scaled_to_max(G.pagerank_factored(factors, fx.seeds), "ppr")
    return down.join(G.scaled_to_max(G.pagerank_factored(factors.reversed(), fx.seeds), "ppr_reverse"), "node", "full")


def _taint_sql(rounds: int, hub: int) -> str:
    steps = [f"""
  share AS MATERIALIZED (SELECT src, e.dst, w / t AS p FROM flow e JOIN (SELECT dst AS k, sum(w) AS t FROM flow GROUP BY 1) ON k = e.dst
     WHERE src IN (SELECT node FROM degree WHERE degree <= {hub})),
  t0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE AS v FROM degree WHERE node IN (SELECT address FROM seeds))"""]
    for i in range(1, rounds + 1):
        steps.append(f"""
  t{i} AS MATERIALIZED (SELECT node, v FROM t0 UNION ALL SELECT dst, least(1.0, 0.9 * sum(v * p)) FROM share JOIN t{i-1} ON node = src
     WHERE dst NOT IN (SELECT node FROM t0) GROUP BY 1)""")
    return ",".join(steps)


def taint(fx):
    return fx._stage("g-taint", lambda: G.haircut_taint(flow(fx), fx.seeds, HUB, degree=flow_degree(fx), arcs=flow_arcs(fx)))


@query("gr5_haircut_taint", with_ctes(["flow", "degree", "seeds"], f"SELECT node, {r('v')} AS taint FROM t8", extra=_taint_sql(8, HUB)))
def gr5(fx):
    return taint(fx).withColumn("taint", r6("taint"))


@query("gr5_haircut_taint_factored", with_ctes(["flow", "degree", "seeds"], f"SELECT node, {r('v')} AS taint FROM t8", extra=_taint_sql(8, HUB)))
def gr5_factored(fx):
    return G.haircut_taint_factored(G.flow_factors(fx.sides), fx.seeds, G.node_degree(flow(fx), HUB).where("is_hub")).withColumn("taint", r6("taint"))


def _bfs_sql(hops: int, arcs: str, hub: int) -> str:
    steps = [f"""
  arcs AS MATERIALIZED ({arcs}),
  b0 AS MATERIALIZED (SELECT node, 0 AS hops, node AS path FROM degree WHERE node IN (SELECT address FROM seeds))"""]
    seen = "SELECT node FROM b0"
    for i in range(1, hops + 1):
        gate = "" if i == 1 else f"JOIN degree g ON g.node = f.node AND g.degree <= {hub}"
        steps.append(f"""
  b{i} AS MATERIALIZED (SELECT dst AS node, {i} AS hops, arg_min(f.path, (f.node, f.path)) || '>' || dst AS path FROM b{i-1} f {gate} JOIN arcs ON src = f.node
     WHERE dst NOT IN ({seen}) GROUP BY dst)""")
        seen += f" UNION ALL SELECT node FROM b{i}"
    return ",".join(steps) + f""",
  bfs AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM b{i}' for i in range(hops + 1))})"""


DOWN, UP = "SELECT src, dst FROM flow", "SELECT dst AS src, src AS dst FROM flow"


@query("gr6_bfs_hops_downstream", with_ctes(["flow", "degree", "seeds"], "SELECT node, hops FROM bfs", extra=_bfs_sql(8, DOWN, HUB)))
def gr6(fx):
    return G.bfs_hops(flow(fx), fx.seeds, 8, HUB)


@query("gr6_bfs_hops_upstream", with_ctes(["flow", "degree", "seeds"], "SELECT node, hops FROM bfs", extra=_bfs_sql(8, UP, HUB)))
def gr6u(fx):
    return G.bfs_hops(G.reverse(flow(fx)), fx.seeds, 8, HUB)


@query("gr6_bfs_hops_any_direction", with_ctes(["flow", "degree", "seeds"], "SELECT node, hops FROM bfs", extra=_bfs_sql(4, f"{DOWN} UNION {UP}", HUB)))
def gr6a(fx):
    return G.bfs_hops(flow(fx), fx.seeds, 4, HUB, undirected=True)


@query("gr7_path_to_seed", with_ctes(["flow", "degree", "seeds"], "SELECT node, hops, path FROM bfs", extra=_bfs_sql(8, DOWN, HUB)))
def gr7(fx):
    return G.bfs_hops(flow(fx), fx.seeds, 8, HUB, with_path=True).withColumn("path", F.array_join("path", ">"))


SIGN_COLUMNS = ["log_recv_btc", "log_sent_btc", "n_recv"]


def _sign_sql() -> str:
    z = ", ".join(f"(c_{c} - avg(c_{c}) OVER ()) / coalesce(nullif(stddev_pop(c_{c}) OVER (), 0), 1) AS {c}" for c in SIGN_COLUMNS)
    mean = lambda t: ", ".join(f"avg(coalesce(h.{c}, 0)) AS {c}" for c in SIGN_COLUMNS)
    return f"""
  zb AS MATERIALIZED (SELECT address AS node, {z} FROM (SELECT address, ln(1 + recv_btc) AS c_log_recv_btc, ln(1 + sent_btc) AS c_log_sent_btc, CAST(n_recv AS DOUBLE) AS c_n_recv FROM wtot)),
  sarc AS MATERIALIZED (SELECT src, dst FROM flow WHERE src NOT IN (SELECT node FROM degree WHERE degree > {HUB}) AND dst NOT IN (SELECT node FROM degree WHERE degree > {HUB})),
  o1 AS MATERIALIZED (SELECT src AS node, {mean('')} FROM sarc LEFT JOIN zb h ON h.node = dst GROUP BY 1),
  o2 AS MATERIALIZED (SELECT src AS node, {mean('')} FROM sarc LEFT JOIN o1 h ON h.node = dst GROUP BY 1),
  i1 AS MATERIALIZED (SELECT dst AS node, {mean('')} FROM sarc LEFT JOIN zb h ON h.node = src GROUP BY 1),
  i2 AS MATERIALIZED (SELECT dst AS node, {mean('')} FROM sarc LEFT JOIN i1 h ON h.node = src GROUP BY 1)"""


@query("gr8_sign_features", with_ctes(["flow", "degree", "wtot"], f"""
    SELECT zb.node AS address, {', '.join(f"{r(f'coalesce({t}.{c}, 0)')} AS gnn_{n}_{c}" for t, n in (('o1', 'out1'), ('o2', 'out2'), ('i1', 'in1'), ('i2', 'in2')) for c in SIGN_COLUMNS)}
    FROM zb LEFT JOIN o1 USING (node) LEFT JOIN o2 USING (node) LEFT JOIN i1 USING (node) LEFT JOIN i2 USING (node)""", extra=_sign_sql()))
def gr8(fx):
    w = Wf.with_times(Wf.wallet_totals(fx.sides))
    f = G.sign_features(flow(fx), w, "address", SIGN_COLUMNS, HUB)
    return f.select("address", *[r6(c).alias(c) for c in f.columns if c != "address"])


# the Elliptic-style graph: parts are nodes, consecutive lines of an order are edges
cte("pedge", ("li",), """
  SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS dst FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst""")


def part_edges(fx):
    """Consecutive lines of an order; an order's lines are one short list."""
    def build():
        lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
        seq = fx.t.lineitem.groupBy("l_orderkey").agg(lines.alias("x")).select(F.col("x.l_partkey").alias("p")).where("size(p) > 1")
        pairs = F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("src"), F.slice("p", F.lit(2), F.size("p") - 1).alias("dst"))
        return seq.select(F.explode(pairs).alias("e")).select("e.src", "e.dst").where("src <> dst").distinct()
    return fx._stage("p-edges", build)


def _structure_sql(rounds: int) -> str:
    steps = ["""
  ptr AS MATERIALIZED (SELECT e.src, e.dst, 1.0::DOUBLE / t AS p FROM pedge e JOIN (SELECT src AS k, count(*) AS t FROM pedge GROUP BY 1) ON k = e.src),
  pn AS MATERIALIZED (SELECT p_partkey AS node, p_partkey NOT IN (SELECT src FROM pedge) AS dangling FROM part),
  x0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM pn) AS v FROM pn)"""]
    for i in range(1, rounds + 1):
        steps.append(f"""
  x{i} AS MATERIALIZED (SELECT pn.node, 0.85 * coalesce(f, 0) + (0.85 * (SELECT coalesce(sum(v), 0) FROM x{i-1} JOIN pn USING (node) WHERE dangling) + 0.15) / (SELECT count(*) FROM pn) AS v
     FROM pn LEFT JOIN (SELECT dst AS node, sum(v * p) AS f FROM ptr JOIN x{i-1} ON node = src GROUP BY 1) USING (node))""")
    steps.append("""
  pboth AS MATERIALIZED (SELECT src AS node, dst AS other FROM pedge UNION SELECT dst, src FROM pedge),
  pdeg AS MATERIALIZED (SELECT node, count(*) AS d FROM pboth GROUP BY 1)""")
    return ",".join(steps)


@query("gr12_structure_features", with_ctes(["pedge"], f"""
    SELECT pn.node, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, {r('ln(v)')} AS log_pagerank, coalesce(mx, 0) AS nbr_max_degree, {r('coalesce(av, 0)')} AS nbr_mean_degree
    FROM pn JOIN x5 USING (node) LEFT JOIN (SELECT dst AS node, count(*) AS n FROM pedge GROUP BY 1) i USING (node) LEFT JOIN (SELECT src AS node, count(*) AS n FROM pedge GROUP BY 1) o USING (node)
    LEFT JOIN (SELECT b.node, max(d) AS mx, avg(d) AS av FROM pboth b JOIN pdeg ON pdeg.node = other GROUP BY 1) n USING (node)""", extra=_structure_sql(5)))
def gr12(fx):
    f = G.structure_features(part_edges(fx), fx.t.part.select(F.col("p_partkey").alias("node")), 5, 0.0)
    return f.withColumns({"log_pagerank": r6("log_pagerank"), "nbr_mean_degree": r6("nbr_mean_degree")})


@query("gr13_sibling_funders", with_ctes(["tin", "tout"], """
    SELECT DISTINCT o.address, i.address AS funder FROM tout o JOIN tin i USING (txid)"""))
def gr13(fx):
    return G.sibling_funders(fx.sides)
