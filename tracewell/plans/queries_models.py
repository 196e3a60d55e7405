"""Queries for models, explanations and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewell.config import SETTINGS, TX_CLASSES
from tracewell.operators import evaluate as Ev
from tracewell.operators import graph as G
from tracewell.operators import models as Mo
from tracewell.operators import stored as St
from tracewell.operators import wallet_features as Wf
from tracewell.operators.temporal import running_totals
from tracewell.operators.tx_features import TX_COLUMNS
from tracewell.plans import derived as D
from tracewell.plans import queries_alerts as Qa
from tracewell.plans import queries_graph as Qg
from tracewell.plans.oracle import cte, r, with_ctes
from tracewell.plans.queries_ledger import r6
from tracewell.plans.registry import query
from tracewell.session import shared_dir

WALLET_COLUMNS = ["n_recv", "recv_btc", "n_spend", "sent_btc", "lifetime_h", "hold_h", "reused", "spend_max_n_out", "fund_n_out", "min_respend_min", "max_peel_shape", "share_risky_asn", "share_datacenter",
                  "n_spend_countries", "fund_out_cv", "fund_in_hub", "max_p_peel", "max_p_coinjoin", "taint", "hops_from_seed"]
BEHAVIOUR = [c for c in WALLET_COLUMNS if not c.startswith("max_p_") and c not in ("taint", "hops_from_seed")]


def wallet_matrix(fx):
    """The wallet matrix of adapter A with class maxima and propagation."""
    def build():
        w = Wf.wallet_features(fx.a, D.x(fx), fx.centroids)
        more = Qa.wallet_table(fx).select("address", *[f"max_{c}" for c in D.P_COLUMNS], "taint", "hops_from_seed", "hops_to_seed", "hops_any_seed")
        return w.join(more, "address")
    return fx._stage("ml-wallets", build)


@query("ml1_anomaly_score")
def ml1(fx):
    return Mo.anomaly_score(wallet_matrix(fx), "address", BEHAVIOUR)


def tx_labels(fx):
    """Classes that follow from the shape, so there is something to learn."""
    x = D.x(fx)
    kind = (F.when(F.col("peel_shape") == 1, "peel").when(F.col("txid") % 11 == 0, "coinjoin").when(F.col("n_out") >= 7, "fan_out").when(F.col("n_in") >= 2, "fan_in").when(F.col("returns_to_input") == 1, "round_trip").otherwise("normal"))
    return x.select("txid", kind.alias("tx_class"), (F.col("txid") % 97).alias("entity_id"), "ts")


def class_run(fx):
    if not hasattr(fx, "_class_run"):
        probs, model = Mo.tx_classes(D.x(fx), TX_COLUMNS, tx_labels(fx), folds=2, trees=8, depth=5)
        fx._class_run = (fx._stage("ml-classes", lambda: probs), model)
    return fx._class_run


@query("ml2_tx_class")
def ml2(fx):
    return class_run(fx)[0]


@query("ml2_tx_class_untrained", with_ctes(["tx"], """
    SELECT txid, 1.0::DOUBLE AS p_normal, 0.0::DOUBLE AS p_peel, 0.0::DOUBLE AS p_coinjoin, 0.0::DOUBLE AS p_fan_out, 0.0::DOUBLE AS p_fan_in, 0.0::DOUBLE AS p_round_trip, 'normal' AS tx_class_pred FROM tx"""))
def ml2u(fx):
    """Neither labels nor a model: everything is normal."""
    return Mo.tx_classes(fx.tx_a, [], None)[0]


@query("ml3_group_folds", with_ctes(["truth"], """
    SELECT fold, count(*) AS wallets, count(DISTINCT entity_id) AS entities, CAST(sum(is_illicit) AS BIGINT) AS illicit FROM (SELECT *, CAST(('0x' || substr(md5(CAST(entity_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS fold FROM truth) GROUP BY 1"""))
def ml3(fx):
    f = fx.labels.withColumn("fold", Mo.group_fold(F.col("entity_id")))
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("wallets"), F.count_distinct("entity_id").alias("entities"), F.sum("is_illicit").alias("illicit"))


def training_labels(fx):
    """Truth that depends on the wallet, so that the model has a signal, and one that explanations have a factor for: busy
    receivers near a seed."""
    l = fx.labels.join(Qa.wallet_table(fx).select("address", "n_recv", "hops_from_seed"), "address")
    return l.select("address", ((F.col("n_recv") >= 4) & (F.col("hops_from_seed") <= 2)).cast("int").alias("y"), F.col("entity_id").cast("string").alias("group"), "typology", F.lit(1.0).alias("weight"))


def fusion(fx):
    if not hasattr(fx, "_fusion"):
        fx._fusion = Mo.fuse_train(wallet_matrix(fx), training_labels(fx), WALLET_COLUMNS)
    return fx._fusion


@query("ml4_fuse_train")
def ml4(fx):
    return fusion(fx)[0]


@query("ml5_fuse_predict")
def ml5(fx):
    return Mo.fuse_predict(wallet_matrix(fx), WALLET_COLUMNS, fusion(fx)[1])


@query("ml5_fuse_predict_untrained", with_ctes(["addr"], "SELECT address, 0.0::DOUBLE AS p FROM addr"))
def ml5u(fx):
    return Mo.fuse_predict(fx.addresses, [], [])


@query("ml6_typology_train")
def ml6t(fx):
    lab = training_labels(fx).withColumn("y", F.lit(1))
    m = Mo.typology_train(wallet_matrix(fx), lab, WALLET_COLUMNS, trees=8, depth=5)
    return Mo.pool_typology(Mo.typology_probabilities(m, wallet_matrix(fx), WALLET_COLUMNS), Qg.clusters(fx), fx.scores)


@query("ml6_typology_pool", with_ctes(["scores"], """
    SELECT address, CASE WHEN sa >= sb AND sa >= sc THEN 'A' WHEN sb >= sc THEN 'B' ELSE 'C' END AS typology FROM (
      SELECT address, round(sum(a * w) OVER g, 9) AS sa, round(sum(b * w) OVER g, 9) AS sb, round(sum(c * w) OVER g, 9) AS sc FROM (
        SELECT address, CASE WHEN (n // 8) % 4 = 0 THEN 'w:' || address ELSE 'C' || CAST(n // 8 AS VARCHAR) END AS pool, greatest(p, 1e-3) AS w, ((n * 7) % 101) / 101.0 AS a, ((n * 13) % 103) / 103.0 AS b, ((n * 17) % 107) / 107.0 AS c FROM scores) WINDOW g AS (PARTITION BY pool))"""))
def ml6(fx):
    n = F.col("n")
    s = fx.scores
    proba = s.select("address", (((n * 7) % 101) / 101.0).alias("t_A"), (((n * 13) % 103) / 103.0).alias("t_B"), (((n * 17) % 107) / 107.0).alias("t_C"))
    cl = s.select("address", F.concat(F.when(F.floor(n / 8) % 4 == 0, "SOLO-").otherwise("C"), F.floor(n / 8).cast("string")).alias("cluster_id"))
    return Mo.pool_typology(proba, cl, s)


@query("ml7_feedback_labels", with_ctes(["truth", "feedback"], """
    SELECT coalesce(t.address, f.address) AS address, coalesce(f.y, is_illicit) AS y, coalesce(CAST(t.entity_id AS VARCHAR), 'fb:' || f.address) AS "group", coalesce(typology, CASE WHEN f.y = 1 THEN 'ANALYST_CONFIRMED' ELSE 'NORMAL' END) AS typology,
           CASE WHEN f.y IS NOT NULL THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
    FROM truth t FULL JOIN (SELECT entity_id AS address, CAST(arg_max(user_label, created_at) = 'TRUE_POSITIVE' AS INT) AS y FROM (SELECT * FROM feedback UNION ALL SELECT 'X' || entity_id, created_at, user_label FROM feedback) GROUP BY 1) f ON t.address = f.address"""))
def ml7(fx):
    """Every verdict once on a wallet whose truth is known and once on one that only analysts know, which adds a row."""
    unknown = fx.feedback.withColumn("entity_id", F.concat(F.lit("X"), "entity_id"))
    return Mo.feedback_labels(fx.labels, fx.feedback.unionByName(unknown))


def candidates(fx):
    return wallet_matrix(fx).join(Qa.alerts(fx).select("address"), "address", "left_semi")


def typical(fx):
    if not hasattr(fx, "_typical"):
        fx._typical = Mo.medians(wallet_matrix(fx), WALLET_COLUMNS)
    return fx._typical


def explained(fx):
    return fx._stage("ml-contributions", lambda: Mo.contributions(candidates(fx), WALLET_COLUMNS, fusion(fx)[1], typical(fx)))


@query("ml8_contributions")
def ml8(fx):
    return explained(fx)


@query("ml9_counterfactuals")
def ml9(fx):
    return Mo.counterfactuals(candidates(fx), WALLET_COLUMNS, fusion(fx)[1], typical(fx), explained(fx))


@query("ml9_population_medians", with_ctes(["wtot"], f"""
    SELECT {r('quantile_cont(recv_btc, 0.5)', 8)} AS recv_btc, quantile_cont(CAST(n_recv AS DOUBLE), 0.25) AS n_recv_p25 FROM wtot"""))
def ml9m(fx):
    """Exact quantiles of a column of any size."""
    from tracewell.operators.temporal import exact_quantiles
    w = Wf.wallet_totals(fx.a)
    a = exact_quantiles(w, "recv_btc", [0.5]).select(r6("q0", 8).alias("recv_btc"), F.lit(1).alias("one"))
    b = exact_quantiles(w.withColumn("n_recv", F.col("n_recv").cast("double")), "n_recv", [0.25]).select(F.col("q0").alias("n_recv_p25"), F.lit(1).alias("one"))
    return a.join(b, "one").drop("one")


# -- what SQL can know of learned results: whose rows there are, and that every value is what it claims to be ----------
def in_unit(*columns):
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).between(0.0, 1.0)
    return ok


@query("ml1_anomaly_score_checked", with_ctes(["addr"], "SELECT address, 1 AS ok, count(*) OVER () AS wallets FROM addr"))
def ml1_checked(fx):
    """A rank in (0, 1] for every wallet; the mean of the ranks of n wallets is (n + 1) / 2n, whatever the ties."""
    a = ml1(fx)
    n, mean = a.agg(F.count(F.lit(1)), F.avg("anomaly")).first()
    fair = abs(mean - (n + 1) / (2 * n)) < 1e-6
    return a.select("address", (in_unit("anomaly") & (F.col("anomaly") > 0) & F.lit(fair)).cast("int").alias("ok"), F.lit(n).alias("wallets"))


@query("ml2_tx_class_checked", with_ctes(["tx"], "SELECT txid, 1 AS ok FROM tx"))
def ml2_checked(fx):
    """One row per transaction; its class probabilities add up to 1 and the predicted class is a most likely one."""
    c = class_run(fx)[0]
    ps = [x for x in c.columns if x.startswith("p_")]
    total, best = sum((F.col(x) for x in ps[1:]), F.col(ps[0])), F.greatest(*ps)
    named = F.element_at(F.create_map(*[y for x in ps for y in (F.lit(x[2:]), F.col(x))]), F.col("tx_class_pred"))
    return c.select("txid", (in_unit(*ps) & (F.abs(total - 1) < 1e-6) & (F.abs(named - best) < 1e-9)).cast("int").alias("ok"))


@query("ml4_fuse_train_checked", with_ctes(["truth"], "SELECT address, 1 AS ok FROM truth"))
def ml4_checked(fx):
    """One out-of-fold probability per labelled wallet, and over all of them a ROC AUC above 0.9 for a truth that can be learned."""
    oof = fusion(fx)[0]
    auc = Ev.ranking_metrics(oof).first()["roc_auc"]
    return oof.select("address", (in_unit("p") & F.lit(auc > 0.9)).cast("int").alias("ok"))


@query("ml5_fuse_predict_checked", with_ctes(["addr"], "SELECT address, 1 AS ok FROM addr"))
def ml5_checked(fx):
    """One probability per wallet, the mean over the members of what each gives alone."""
    rows, members = wallet_matrix(fx), fusion(fx)[1]
    alone = None
    for i, m in enumerate(members):
        p = Mo.fuse_predict(rows, WALLET_COLUMNS, [m]).withColumnRenamed("p", f"p{i}")
        alone = p if alone is None else alone.join(p, "address")
    mean = sum((F.col(f"p{i}") for i in range(1, len(members))), F.col("p0")) / len(members)
    return ml5(fx).join(alone, "address").select("address", (in_unit("p") & (F.abs(F.col("p") - mean) < 1e-9)).cast("int").alias("ok"))


@query("ml8_contributions_checked", with_ctes(["alerts"], "SELECT address, 6 AS features, 1 AS ok FROM alerts"))
def ml8_checked(fx):
    """Six features per alert, the most weighty first, and what an impact says is the difference of two scorings."""
    e, typ = explained(fx), typical(fx)
    first = e.groupBy("address").agg(F.max_by("feature", F.abs("impact")).alias("feature"), F.max_by("impact", F.abs("impact")).alias("impact"), F.count(F.lit(1)).alias("features"))
    rows = Mo.clean(candidates(fx).select("address", *WALLET_COLUMNS), WALLET_COLUMNS).join(first, "address")
    changed = rows.withColumns({c: F.when(F.col("feature") == c, F.lit(float(typ[c]))).otherwise(F.col(c)) for c in WALLET_COLUMNS})
    odds = lambda d: Mo.fuse_predict(d, WALLET_COLUMNS, fusion(fx)[1]).select("address", Mo._log_odds(F.col("p")).alias("o"))
    j = first.join(odds(rows).withColumnRenamed("o", "before"), "address").join(odds(changed).withColumnRenamed("o", "after"), "address")
    return j.select("address", F.col("features").cast("int").alias("features"), (F.abs(F.col("before") - F.col("after") - F.col("impact")) < 1e-3).cast("int").alias("ok"))


@query("ml9_counterfactuals_checked", "SELECT 1 AS some, 1 AS below_high, 1 AS risk_falls")
def ml9_checked(fx):
    """There are explanations, each smallest set ends below HIGH, and it ends below where it began."""
    c = ml9(fx)
    below = F.coalesce(F.col("minimal_risk") < 65, F.lit(True))
    return c.agg((F.count(F.lit(1)) > 0).cast("int").alias("some"), F.min(below.cast("int")).alias("below_high"), F.min(F.coalesce(F.col("minimal_risk") <= F.col("risk_before"), F.lit(True)).cast("int")).alias("risk_falls"))


# -- models that were written and read again ---------------------------------------------------------------
def typology_model(fx):
    if not hasattr(fx, "_typology_model"):
        fx._typology_model = Mo.typology_train(wallet_matrix(fx), training_labels(fx).withColumn("y", F.lit(1)), WALLET_COLUMNS)
    return fx._typology_model


def reloaded(fx):
    """All three models through the disk, loaded by another session object."""
    if not hasattr(fx, "_reloaded"):
        place = f"{shared_dir(fx.spark)}/models-{uuid.uuid4().hex[:10]}"
        St.save(fx.spark, St.Models(class_run(fx)[1], list(TX_COLUMNS), fusion(fx)[1], WALLET_COLUMNS, typology_model(fx), WALLET_COLUMNS), place)
        fx._reloaded = St.load(fx.spark.newSession(), place)
    return fx._reloaded


def alike(a, b, key):
    """(key, same): 1 where all columns of both tables agree, in every row of either."""
    columns = [c for c in a.columns if c != key]
    j = a.join(b.select(key, *[F.col(c).alias(f"{c}__b") for c in columns]), key, "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__b"))
    return j.select(key, same.cast("int").alias("same"))


@query("ml2_tx_class_reloaded", with_ctes(["tx"], "SELECT txid, 1 AS same FROM tx"))
def ml2_reloaded(fx):
    """Classes of unlabelled transactions by the model in memory and by the one read back, row for row."""
    return alike(Mo.tx_classes(D.x(fx), TX_COLUMNS, None, class_run(fx)[1])[0], St.tx_classes(D.x(fx), reloaded(fx)), "txid")


@query("ml5_fuse_predict_reloaded", with_ctes(["addr"], "SELECT address, 1 AS same FROM addr"))
def ml5_reloaded(fx):
    return alike(ml5(fx), St.risk(wallet_matrix(fx), reloaded(fx)), "address")


@query("ml6_typology_reloaded", with_ctes(["addr"], "SELECT address, 1 AS same FROM addr"))
def ml6_reloaded(fx):
    return alike(Mo.typology_probabilities(typology_model(fx), wallet_matrix(fx), WALLET_COLUMNS), St.typologies(wallet_matrix(fx), reloaded(fx)), "address")


# -- evaluation ------------------------------------------------------------------------------------------
cte("scored", ("scores", "truth"), "SELECT s.address, s.p, t.is_illicit AS y, s.typology, t.typology AS truth, t.entity_id FROM scores s JOIN truth t USING (address)")


def scored(fx):
    return fx.scores.select("address", "p", "typology", "anomaly").join(fx.labels.select("address", F.col("is_illicit").alias("y"), F.col("typology").alias("truth"), "entity_id"), "address")


@query("ev1_ranking_metrics", with_ctes(["scored"], f"""
    SELECT {r('(SELECT sum(pos / tp * cp / cn) FROM curve)')} AS pr_auc, {r('(SELECT sum(pos * ((tn - (cn - cp)) + (n - pos) / 2) / (tp * tn)) FROM curve)')} AS roc_auc,
           {r('(SELECT avg(y) FROM (SELECT y FROM scored ORDER BY p DESC, address LIMIT 50))')} AS precision_at_50, {r('(SELECT avg(y) FROM (SELECT y FROM scored ORDER BY p DESC, address LIMIT 100))')} AS precision_at_100,
           {r('(SELECT count(*) FILTER (p >= 0.5 AND y = 1) / sum(y) FROM scored)')} AS recall_at_p50, {r('(SELECT count(*) FILTER (p >= 0.5 AND y = 1) / count(*) FILTER (p >= 0.5) FROM scored)')} AS precision_at_p50, {r('(SELECT avg(y) FROM scored)')} AS base_rate""",
    extra="""curve AS MATERIALIZED (SELECT pos, n, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(n) OVER (ORDER BY p DESC) AS cn, sum(pos) OVER () AS tp, sum(n - pos) OVER () AS tn FROM (SELECT p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM scored GROUP BY 1))"""))
def ev1(fx):
    m = Ev.ranking_metrics(scored(fx))
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query("ev2_calibration_table", with_ctes(["scored"], f"""
    SELECT CAST(least(len(list_filter([{', '.join(repr(e) for e in Ev.BIN_EDGES)}]::DOUBLE[], lambda e: e <= p)) - 1, 9) AS INT) AS bin, count(*) AS n, {r('avg(p)')} AS mean_predicted, {r('avg(y)')} AS observed_rate FROM scored GROUP BY 1"""))
def ev2(fx):
    return Ev.calibration_table(scored(fx)).withColumns({"mean_predicted": r6("mean_predicted"), "observed_rate": r6("observed_rate")})


@query("ev2_calibration_error", with_ctes(["scored"], f"""
    SELECT {r('sum(n * abs(a - b)) / sum(n)')} AS ece FROM (SELECT least(len(list_filter([{', '.join(repr(e) for e in Ev.BIN_EDGES)}]::DOUBLE[], lambda e: e <= p)) - 1, 9) AS bin, count(*) AS n, avg(p) AS a, avg(y) AS b FROM scored GROUP BY 1)"""))
def ev2e(fx):
    return Ev.expected_calibration_error(Ev.calibration_table(scored(fx))).withColumn("ece", r6("ece"))


TYPES = ("RANSOMWARE", "PEEL_CHAIN", "MIXING", "STRUCTURING", "ROUND_TRIP")


@query("ev3_confusion", with_ctes(["scored"], f"""
    SELECT truth AS label, {', '.join(f"count(*) FILTER (typology = '{t}') AS \"{t}\"" for t in TYPES)} FROM scored GROUP BY 1"""))
def ev3(fx):
    return Ev.confusion(scored(fx), "truth", "typology", TYPES)


@query("ev3_class_f1", with_ctes(["scored"], f"""
    SELECT c AS label, {r('2.0 * count(*) FILTER (truth = c AND typology = c) / (count(*) FILTER (truth = c) + count(*) FILTER (typology = c))')} AS f1 FROM scored, (SELECT DISTINCT truth AS c FROM scored) GROUP BY 1"""))
def ev3f(fx):
    return Ev.class_f1(scored(fx), "truth", "typology").withColumn("f1", r6("f1"))


@query("ev4_cluster_quality", with_ctes(["cl1", "cl23", "addr"], f"""
    SELECT {r('1 - (SELECT sum(-n * ln(n / nc)) FROM cell2) / (SELECT -sum(n * ln(n / (SELECT sum(n) FROM cell))) FROM (SELECT t, sum(n)::DOUBLE AS n FROM cell GROUP BY 1))')} AS homogeneity,
           {r('1 - (SELECT sum(-n * ln(n / nt)) FROM cell2) / (SELECT -sum(n * ln(n / (SELECT sum(n) FROM cell))) FROM (SELECT c, sum(n)::DOUBLE AS n FROM cell GROUP BY 1))')} AS completeness""", recursive=True, extra=Qg.CLUSTER_SQL + """,
    cell AS MATERIALIZED (SELECT CAST(substr(address, 2) AS BIGINT) // 8 AS t, cluster_root AS c, count(*)::DOUBLE AS n FROM clusters GROUP BY 1, 2),
    cell2 AS MATERIALIZED (SELECT n, sum(n) OVER (PARTITION BY t) AS nt, sum(n) OVER (PARTITION BY c) AS nc FROM cell)"""))
def ev4(fx):
    d = Qg.clusters(fx).select("cluster_root", F.floor(F.substring("address", 2, 20).cast("long") / 8).alias("owner"))
    return Ev.cluster_quality(d, "owner", "cluster_root").select(r6("homogeneity").alias("homogeneity"), r6("completeness").alias("completeness"))


@query("ev5_propagation_quality", with_ctes([*Qa.PROP_NEEDS, "truth", "scores"], f"""
    SELECT count(*) FILTER (hidden) AS hidden_illicit_wallets, {r('avg(reach) FILTER (hidden)')} AS hidden_reached, {r('avg(reach) FILTER (hidden AND entity_id IN (SELECT entity_id FROM truth WHERE address IN (SELECT address FROM seeds)))')} AS hidden_reached_in_seeded_entities,
           {r('avg(reach) FILTER (is_illicit = 0)')} AS legit_reached, {r('avg(CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (hidden)')} AS hidden_flagged_p50 FROM (
      SELECT t.*, s.p, is_illicit = 1 AND t.address NOT IN (SELECT address FROM seeds) AS hidden, CASE WHEN taint > 0.01 OR hops_from_seed <= 4 OR hops_to_seed <= 4
        OR t.entity_id IN (SELECT entity_id FROM truth WHERE address IN (SELECT address FROM seeds)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reach FROM wallet JOIN truth t USING (address) JOIN scores s USING (address))""", extra=Qa.PROP_SQL))
def ev5(fx):
    """Undirected hops are left out here: two hops in any direction are checked by gr6."""
    w = Qa.wallet_table(fx).join(Qa.scores(fx).select("address", "cluster_root", "p"), "address").withColumn("hops_any_seed", F.lit(99))
    e = Ev.propagation_quality(w, fx.labels, fx.seeds)
    return e.select("hidden_illicit_wallets", *[r6(c).alias(c) for c in e.columns[1:]])


@query("ev6_alert_quality", with_ctes(["alerts", "truth"], f"""
    SELECT count(*) AS alerts, {r('avg(is_illicit)')} AS alert_precision, {r('avg(CAST(a.typology = t.typology AS DOUBLE)) FILTER (is_illicit = 1)')} AS typology_accuracy, count(DISTINCT entity_id) FILTER (is_illicit = 1) AS illicit_entities_alerted,
           (SELECT count(DISTINCT entity_id) FROM truth WHERE is_illicit = 1) AS illicit_entities_total, {r('(SELECT avg(is_illicit) FROM (SELECT is_illicit FROM alerts JOIN truth USING (address) ORDER BY p DESC, address LIMIT 10))')} AS precision_top10,
           {r('count(DISTINCT entity_id) FILTER (is_illicit = 1) / (SELECT count(DISTINCT entity_id) FROM truth WHERE is_illicit = 1)')} AS entity_recall FROM alerts a JOIN truth t USING (address)"""))
def ev6(fx):
    e = Ev.alert_quality(Qa.alerts(fx), fx.labels)
    return e.withColumns({c: r6(c) for c in ("alert_precision", "typology_accuracy", "precision_top10", "entity_recall")})


# The Elliptic-style task: parts with their embedding, a time step, and a class that depends on the embedding
VECTOR = [f"f{i}" for i in range(64)]


def steps_table(fx):
    def build():
        e = fx.t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(len(VECTOR))])
        y = ((F.col("f0") + F.col("f1") > 0.15) | (F.col("vec_id") % 17 == 0)).cast("int")
        return e.select(F.col("vec_id").alias("address"), (F.col("vec_id") % 49 + 1).alias("time_step"), y.alias("y"), *VECTOR)
    return fx._stage("el-steps", build)


def temporal_run(fx):
    """(address, time_step, y, p) of the test steps: fitted before step 31, calibrated on steps 31-34."""
    def build():
        d = Mo.assembled(steps_table(fx), VECTOR).withColumn("w", F.lit(1.0)).withColumn("y", F.col("y").cast("double")).select("address", "time_step", "y", "w", "features")
        m = Mo._fit_member(d.where("time_step < 31"), d.where("time_step between 31 and 34"), 5, 3)
        return Mo.member_probability(m, d.where("time_step > 34"), ["address", "time_step", "y"])
    return fx._stage("el-test", build)


@query("ev9_temporal_validation")
def ev9(fx):
    t = temporal_run(fx)
    hit = (F.col("p") >= 0.5).cast("int")
    per = t.groupBy("time_step").agg(F.sum("y").alias("illicit"), F.sum(hit).alias("flagged"), F.sum(hit * F.col("y")).alias("found"))
    return per.select("time_step", "illicit", "flagged", (2 * F.col("found") / F.greatest(F.col("illicit") + F.col("flagged"), F.lit(1.0))).alias("f1"))


@query("ev9_temporal_ranking")
def ev9r(fx):
    return Ev.ranking_metrics(temporal_run(fx))


@query("ev10_seed_reveal_eval")
def ev10(fx):
    """In every test step a hash sample of three in ten illicit nodes is revealed; the rest are ranked by PageRank from them."""
    t = temporal_run(fx)
    draw = F.pmod(F.conv(F.substring(F.md5(F.col("address").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(10))
    seeds = t.where((F.col("y") == 1) & (draw < 3)).select(F.col("address"))
    node = t.select(F.col("address").alias("src"), F.col("time_step").alias("s1"))
    n_nodes = fx.t.embeddings.count()
    pairs = Qg.part_edges(fx).select((F.col("src") % n_nodes).alias("src"), (F.col("dst") % n_nodes).alias("dst"))
    e = (pairs.join(node, "src").join(node.toDF("dst", "s2"), "dst").where("s1 = s2 and src <> dst").select("src", "dst"))
    e = e.union(e.select("dst", "src")).distinct()
    ppr = G.pagerank(e, seeds, SETTINGS.pagerank_max_rounds, SETTINGS.pagerank_tol, weight=None, nodes=t.select(F.col("address").alias("node")))
    near = G.bfs_hops(e, seeds, 2, 1_000_000)
    hidden = (t.join(seeds, "address", "left_anti").join(ppr.select(F.col("node").alias("address"), F.round("rank", 12).alias("ppr")), "address", "left").fillna({"ppr": 0.0})
              .join(near.select(F.col("node").alias("address"), "hops"), "address", "left").withColumn("near", F.col("hops").isNotNull().cast("double")))
    key = F.struct("time_step", "ppr")
    counts = hidden.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    run = running_totals(counts, "k", ["n"])
    first = run.groupBy(F.col("k.time_step").alias("time_step")).agg(F.min(F.col("run_n") - F.col("n")).alias("before"), F.sum("n").alias("step_n"))
    pct = run.select(F.col("k.time_step").alias("time_step"), F.col("k.ppr").alias("ppr"), "n", "run_n").join(first, "time_step").select(
        "time_step", "ppr", ((F.col("run_n") - F.col("before") - (F.col("n") - 1) / 2) / F.col("step_n")).alias("ppr_pct"))
    d = hidden.join(pct, ["time_step", "ppr"]).withColumn("combined", 1 - (1 - F.col("p")) * (1 - 0.5 * F.col("ppr_pct") * F.col("near")))
    return d.select("address", "time_step", "y", "p", "ppr_pct", "near", "combined")


@query("ev11_network_ablation")
def ev11(fx):
    """The same recipe with and without network columns."""
    keep = [c for c in WALLET_COLUMNS if c not in Wf.WALLET_NETWORK_COLUMNS]
    a = Ev.ranking_metrics(fusion(fx)[0]).select(F.lit("with_network").alias("run"), "pr_auc")
    p, _ = Mo.fuse_train(wallet_matrix(fx), training_labels(fx), keep)
    return a.unionByName(Ev.ranking_metrics(p).select(F.lit("without_network").alias("run"), "pr_auc"))


@query("ev12_evaluation_summary", with_ctes(["scored", "alerts", "truth"], f"""
    SELECT 'Fusion' AS engine, 'Base rate' AS metric, {r('avg(y)')} AS score, '-' AS target FROM scored
    UNION ALL SELECT 'Fusion', 'Recall of illicit wallets at p >= 0.5', {r('count(*) FILTER (p >= 0.5 AND y = 1) / sum(y)')}, '>= 0.60' FROM scored
    UNION ALL SELECT 'Alert list', 'Precision', {r('(SELECT avg(is_illicit) FROM alerts JOIN truth USING (address))')}, '>= 0.70'"""))
def ev12(fx):
    blocks = [("Fusion", Ev.ranking_metrics(scored(fx)), [("base_rate", "Base rate", "-"), ("recall_at_p50", "Recall of illicit wallets at p >= 0.5", ">= 0.60")]),
              ("Alert list", Ev.alert_quality(Qa.alerts(fx), fx.labels), [("alert_precision", "Precision", ">= 0.70")])]
    return Ev.evaluation_summary(blocks).withColumn("score", r6("score"))


@query("ev13_multi_run_summary", with_ctes(["scored"], f"""
    SELECT metric, {r('avg(score)')} AS mean, {r('stddev_pop(score)')} AS std, count(*) AS runs FROM (
      SELECT 'base_rate' AS metric, avg(y) AS score FROM scored GROUP BY entity_id % 4 UNION ALL SELECT 'mean_p', avg(p) FROM scored GROUP BY entity_id % 4) GROUP BY 1"""))
def ev13(fx):
    """Four quarters of the owners as four runs."""
    g = scored(fx).groupBy((F.col("entity_id") % 4).alias("run")).agg(F.avg("y").alias("base_rate"), F.avg("p").alias("mean_p"))
    runs = g.select(F.explode(F.array(F.struct(F.lit("base_rate").alias("metric"), F.col("base_rate").alias("score")), F.struct(F.lit("mean_p").alias("metric"), F.col("mean_p").alias("score")))).alias("m")).select("m.*")
    return Ev.multi_run_summary(runs).withColumns({"mean": r6("mean"), "std": r6("std")})


@query("ev14_typology_corpus", with_ctes(["truth", "scores"], """
    SELECT 'set1:' || CAST(entity_id AS VARCHAR) AS "group", t.typology, p, 0.0::DOUBLE AS anomaly FROM truth t JOIN scores s USING (address) WHERE is_illicit = 1 AND n % 2 = 0
    UNION ALL SELECT 'set2:' || CAST(entity_id AS VARCHAR), t.typology, p, anomaly FROM truth t JOIN scores s USING (address) WHERE is_illicit = 1 AND n % 2 = 1"""))
def ev14(fx):
    d = fx.labels.select("address", "entity_id", "typology", "is_illicit").join(fx.scores.select("address", "n", "p", "anomaly"), "address")
    part = d.select(F.col("entity_id").alias("group"), "typology", "p", "anomaly", F.col("is_illicit").alias("y"), F.lit(1.0).alias("weight"), "n")
    return Ev.typology_corpus({"set1": part.where("n % 2 = 0").drop("anomaly", "n"), "set2": part.where("n % 2 = 1").drop("n")})


@query("score_ledger_to_alerts")
def score_all(fx):
    """The whole way from the ledger of adapter A to alerts with their next step."""
    from tracewell.plans.scoring import References, score
    refs = References(fx.known, fx.seeds, fx.centroids, training_labels(fx), tx_labels(fx), fx.watchlist)
    return score(fx.a, refs)["alerts"].select("alert_id", "address", "cluster_id", "typology", "risk_score", "severity", "confidence", "action")
