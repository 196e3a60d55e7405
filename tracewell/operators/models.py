"""Learned parts: anomaly score, transaction classes, calibrated risk, typology, and explanations of a score."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.config import SETTINGS, TX_CLASSES
from tracewell.operators.temporal import percent_rank_average, running_totals
from tracewell.session import stage


# -- folds and labels ---------------------------------------------------------------------------------
def group_fold(group: Column, k: int = 5) -> Column:
    """Fold of a group, so that one owner is never on both sides of a split."""
    return F.pmod(F.conv(F.substring(F.md5(group.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(k))


def feedback_labels(labels: DataFrame, feedback: DataFrame, weight: float = SETTINGS.verdict_weight) -> DataFrame:
    """Training labels after the analysts' latest verdicts, which win over the truth table and weigh more."""
    last = (feedback.where("entity_id is not null").groupBy(F.col("entity_id").alias("address"))
            .agg(F.max_by("user_label", "created_at").alias("verdict")).withColumn("verdict_y", (F.col("verdict") == "TRUE_POSITIVE").cast("int")))
    j = labels.join(last, "address", "full")
    fb = F.concat(F.lit("fb:"), F.col("address"))
    return j.select("address", F.coalesce("verdict_y", "is_illicit").alias("y"), F.coalesce(F.col("entity_id").cast("string"), fb).alias("group"),
                    F.coalesce("typology", F.when(F.col("verdict_y") == 1, "ANALYST_CONFIRMED").otherwise("NORMAL")).alias("typology"),
                    F.when(F.col("verdict_y").isNotNull(), weight).otherwise(1.0).alias("weight")).where("y is not null")


def clean(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing and infinite feature values become 0."""
    finite = lambda c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), 0.0).otherwise(F.col(c).cast("double"))
    return df.withColumns({c: finite(c) for c in features})


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(clean(df, features))


# -- anomaly: isolation forest --------------------------------------------------------------------------
def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _grow(x, depth: int, limit: int, rng, nodes: list) -> int:
    """Add the subtree for the rows ``x`` to ``nodes`` and return its index. A leaf has feature -1 and holds its path length."""
    at = len(nodes)
    nodes.append((-1, 0.0, -1, -1, depth + _average_path(len(x))))
    lo, hi = (x.min(axis=0), x.max(axis=0)) if len(x) else (None, None)
    wide = [] if lo is None else [j for j in range(x.shape[1]) if hi[j] > lo[j]]
    if depth >= limit or len(x) <= 1 or not wide:
        return at
    j = wide[int(rng.integers(len(wide)))]
    cut = float(rng.uniform(lo[j], hi[j]))
    left = _grow(x[x[:, j] < cut], depth + 1, limit, rng, nodes)
    right = _grow(x[x[:, j] >= cut], depth + 1, limit, rng, nodes)
    nodes[at] = (j, cut, left, right, 0.0)
    return at


def anomaly_score(wallets: DataFrame, key: str, features: list[str], trees: int = 200, sample: int = 256, seed: int = 42) -> DataFrame:
    """(key, anomaly): isolation-forest score as its rank in (0, 1].

    Each tree sees a hash sample of at most ``sample`` rows, whatever the size of the table, and is grown in one task per
    tree. The forest (a few hundred nodes per tree) is sent to the tasks that score the rows in Arrow batches.
    """
    import numpy as np
    import pandas as pd

    x = stage(clean(wallets.select(key, *features), features).select(key, F.array(*features).alias("x")), "if-rows")
    n = x.count()
    draw = lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = min(1.0, 1.5 * sample / max(n, 1))
    picked = x.select(key, "x", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < share)).alias("tree"))
    from pyspark.sql import Window as W
    few = (picked.withColumn("k", F.row_number().over(W.partitionBy("tree").orderBy(draw(F.col("tree")), key)))
           .where(F.col("k") <= sample).select("tree", "x"))
    limit = max(1, math.ceil(math.log2(max(min(sample, n), 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        nodes: list = []
        _grow(np.array(pdf["x"].tolist(), dtype=float), 0, limit, np.random.default_rng(seed * 1000 + tree), nodes)
        f, c, left, right, path = (list(v) for v in zip(*nodes))
        return pd.DataFrame({"tree": [tree], "f": [f], "c": [c], "l": [left], "r": [right], "path": [path]})

    forest = few.groupBy("tree").applyInPandas(grow, "tree int, f array<int>, c array<double>, l array<int>, r array<int>, path array<double>").collect()
    packed = [(np.array(t["f"]), np.array(t["c"]), np.array(t["l"]), np.array(t["r"]), np.array(t["path"])) for t in sorted(forest, key=lambda t: t["tree"])]
    norm = _average_path(min(sample, n)) or 1.0

    def score(batches):
        for pdf in batches:
            m = np.array(pdf["x"].tolist(), dtype=float)
            total = np.zeros(len(m))
            rows = np.arange(len(m))
            for f, c, left, right, path in packed:
                at = np.zeros(len(m), dtype=int)
                for _ in range(limit):
                    inner = f[at] >= 0
                    go_left = m[rows, np.maximum(f[at], 0)] < c[at]
                    at = np.where(inner, np.where(go_left, left[at], right[at]), at)
                total += path[at]
            yield pd.DataFrame({key: pdf[key], "raw": np.exp2(-(total / len(packed)) / norm)})

    kind = x.schema[key].dataType.simpleString()
    raw = stage(x.mapInPandas(score, f"{key} {kind}, raw double"), "if-scores")
    return percent_rank_average(raw, "raw", "anomaly").select(key, "anomaly")


def together(spark: SparkSession, tasks: list[Callable], at_once: int = 4) -> list:
    """Results of ``tasks`` in their order. A few run at the same time, as in Spark's own tuning: the small jobs of one model leave cores idle."""
    with ThreadPool(max(1, min(at_once, len(tasks)))) as pool:
        return pool.map(lambda f: f(), [inheritable_thread_target(spark)(f) for f in tasks], chunksize=1)


# -- transaction classes ----------------------------------------------------------------------------------
def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight n / (classes x class size)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = n.agg(F.sum("__n"), F.count(F.lit(1))).first()  # two numbers
    return df.join(n, label).withColumn("weight", F.lit(float(total[0] or 0)) / (F.lit(float(total[1] or 1)) * F.col("__n"))).drop("__n")


def _forest(labels: list[str], trees: int, depth: int) -> Pipeline:
    """A forest of ``trees`` trees. Rows keep the node they are in, so that jobs are not sent the trees grown so far."""
    index = StringIndexer(inputCol="label_text", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep")
    return Pipeline(stages=[index, RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=42, cacheNodeIds=True)])


def _class_probabilities(model: PipelineModel, df: DataFrame, key: list[str], classes: list[str], prefix: str = "p_") -> DataFrame:
    names = list(model.stages[0].labels)
    scored = model.stages[1].transform(df)
    v = vector_to_array("probability")
    return scored.select(*key, *[(v[names.index(c)] if c in names else F.lit(0.0)).alias(f"{prefix}{c}") for c in classes])


def tx_classes(x: DataFrame, features: list[str], labels: DataFrame | None, model: PipelineModel | None = None, folds: int = 5, trees: int = 60, depth: int = 10) -> tuple[DataFrame, PipelineModel | None]:
    """Class probabilities of every transaction and the fitted model.

    labels: txid, tx_class, entity_id, ts. Labelled transactions get out-of-fold probabilities, grouped by owner and day.
    Without labels a given model is applied; without either everything is normal.
    """
    classes = list(TX_CLASSES)
    if labels is None and model is None:
        return x.select("txid", *[F.lit(1.0 if c == "normal" else 0.0).alias(f"p_{c}") for c in classes], F.lit("normal").alias("tx_class_pred")), None
    vec = assembled(x.select("txid", *features), features).select("txid", "features")
    if labels is None:
        out = _class_probabilities(model, vec, ["txid"], classes)
    else:
        lab = labels.where("tx_class is not null").select("txid", F.col("tx_class").alias("label_text"), group_fold(F.concat_ws("|", F.col("entity_id").cast("string"), F.date_format("ts", "MMdd")), folds).alias("fold"))
        train = stage(balanced_weights(vec.join(lab, "txid"), "label_text"), "class-train")
        fits = [partial(_forest(classes, trees, depth).fit, rows) for rows in [*(train.where(F.col("fold") != k) for k in range(folds)), train]]
        *out_of_fold, model = together(x.sparkSession, fits, 3)
        parts = None
        for k, m in enumerate(out_of_fold):
            p = _class_probabilities(m, train.where(F.col("fold") == k), ["txid"], classes)
            parts = p if parts is None else parts.unionByName(p)
        rest = _class_probabilities(model, vec.join(train.select("txid"), "txid", "left_anti"), ["txid"], classes)
        out = parts.unionByName(rest)
    return out.withColumn("tx_class_pred", argmax([(c, F.col(f"p_{c}")) for c in classes])), model


def argmax(named: list[tuple[str, Column]]) -> Column:
    """Name of the largest value; the first one on a tie."""
    best = F.greatest(*[v for _, v in named])
    pick = F.when(named[0][1] == best, named[0][0])
    for name, v in named[1:]:
        pick = pick.when(v == best, name)
    return pick


# -- calibrated risk -----------------------------------------------------------------------------------------
def _fit_member(fit: DataFrame, calibrate: DataFrame, iterations: int, depth: int):
    gbt = GBTClassifier(labelCol="y", featuresCol="features", weightCol="w", maxIter=iterations, maxDepth=depth, stepSize=0.1, subsamplingRate=0.9, seed=42).fit(fit)
    raw = raw_probability(gbt, calibrate)
    iso = IsotonicRegression(labelCol="y", featuresCol="raw").fit(raw) if raw.select("y").distinct().count() > 1 else None
    return gbt, iso


def raw_probability(gbt, df: DataFrame) -> DataFrame:
    return gbt.transform(df).withColumn("raw", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def member_probability(member, df: DataFrame, keep: list[str]) -> DataFrame:
    gbt, iso = member
    raw = raw_probability(gbt, df)
    if iso is None:
        return raw.select(*keep, F.col("raw").alias("p"))
    return iso.transform(raw).select(*keep, F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0)).alias("p"))


def fuse_train(x: DataFrame, labels: DataFrame, features: list[str], folds: int = 5, repeats: int = 3, iterations: int = 60, depth: int = 5) -> tuple[DataFrame, list]:
    """(address, y, p out of fold) and the ensemble members.

    In each fold the remaining owners are split ``repeats`` times into three quarters to fit boosted trees and one quarter to
    calibrate them; the calibrated members are averaged. labels: address, y, group, weight.
    """
    vec = assembled(x.select("address", *features), features).select("address", "features")
    d = vec.join(labels.select("address", "y", "group", "weight"), "address").withColumn("fold", group_fold(F.col("group"), folds))
    d = stage(d, "fuse-train")
    pos, neg = d.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    boost = max(1.0, (neg or 0) / max(pos or 0, 1))
    d = d.withColumn("w", F.col("weight") * F.when(F.col("y") == 1, boost).otherwise(1.0)).withColumn("y", F.col("y").cast("double"))
    fits = []
    for k in range(folds):
        train = d.where(F.col("fold") != k)
        for rep in range(repeats):
            side = group_fold(F.concat(F.lit(f"{k}-{rep}-"), F.col("group")), 4)
            fits.append(partial(_fit_member, train.where(side != 0), train.where(side == 0), iterations, depth))
    members, oof = together(d.sparkSession, fits), None
    for k in range(folds):
        p = mean_probability(d.where(F.col("fold") == k), members[k * repeats:(k + 1) * repeats], ["address", "y"])
        oof = p if oof is None else oof.unionByName(p)
    return stage(oof.groupBy("address", "y").agg(F.avg("p").alias("p")), "fuse-oof"), members


def fuse_predict(x: DataFrame, features: list[str], members: list) -> DataFrame:
    """Mean probability of the members; missing columns count as 0, and without members every risk is 0."""
    if not members:
        return x.select("address", F.lit(0.0).alias("p"))
    have = x.withColumns({c: F.lit(0.0) for c in features if c not in x.columns})
    return mean_probability(assembled(have.select("address", *features), features).select("address", "features"), members, ["address"])


def mean_probability(vec: DataFrame, members: list, keep: list[str]) -> DataFrame:
    """Rows with the mean of the members' probabilities: one column per member in the same row, so nothing is shuffled."""
    cur, own = vec, []
    for i, m in enumerate(members):
        cur = member_probability(m, cur, [*keep, *own, "features"]).withColumnRenamed("p", f"__p{i}")
        own.append(f"__p{i}")
    return cur.select(*keep, (sum((F.col(c) for c in own[1:]), F.col(own[0])) / len(own)).alias("p"))


# -- typology ----------------------------------------------------------------------------------------------------
def entity_balance(df: DataFrame, group: str = "group") -> DataFrame:
    """Weight so that every owner teaches the typology model equally, however many wallets it has."""
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    total = n.agg(F.sum("__n"), F.count(F.lit(1))).first()  # two numbers
    return df.join(n, group).withColumn("weight", F.lit(float(total[0] or 0)) / (F.col("__n") * F.lit(float(total[1] or 1)))).drop("__n")


def typology_train(x: DataFrame, labels: DataFrame, features: list[str], trees: int = 60, depth: int = 10) -> PipelineModel:
    train = entity_balance(labels.where("y = 1")).select("address", F.col("typology").alias("label_text"), "weight")
    return _forest([], trees, depth).fit(assembled(x.select("address", *features), features).select("address", "features").join(train, "address"))


def typology_probabilities(model: PipelineModel, x: DataFrame, features: list[str]) -> DataFrame:
    vec = assembled(x.select("address", *features), features).select("address", "features")
    return _class_probabilities(model, vec, ["address"], sorted(model.stages[0].labels), "t_")


def pool_typology(proba: DataFrame, clusters: DataFrame, risk: DataFrame) -> DataFrame:
    """(address, typology): class probabilities summed over the owner's cluster, weighted by risk; lone wallets keep their own.

    Clusters are told apart by cluster_root where the table has it; the short display id alone would merge strangers."""
    key = "cluster_root" if "cluster_root" in clusters.columns else "cluster_id"
    classes = sorted(c[2:] for c in proba.columns if c.startswith("t_"))
    j = (proba.join(clusters.select("address", "cluster_id", F.col(key).alias("__key")), "address", "left").join(risk.select("address", "p"), "address", "left")
         .withColumn("w", F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(1e-3))))
    solo = F.col("cluster_id").isNull() | F.col("cluster_id").startswith("SOLO")
    j = j.withColumn("pool", F.when(solo, F.concat(F.lit("w:"), F.col("address"))).otherwise(F.concat(F.lit("c:"), F.col("__key"))))
    g = j.groupBy("pool").agg(*[F.sum(F.col(f"t_{c}") * F.col("w")).alias(f"s_{c}") for c in classes])
    g = g.select("pool", argmax([(c, F.col(f"s_{c}")) for c in classes]).alias("typology"))
    return j.select("address", "pool").join(g, "pool").select("address", "typology")


# -- explanations --------------------------------------------------------------------------------------------------
def medians(x: DataFrame, features: list[str]) -> dict[str, float]:
    """Exact median of every feature over all wallets, from one pass over (feature, value) pairs in range partitions."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)])).alias("key")
    counts = clean(x.select(*features), features).select(pairs).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    spans = running_totals(counts, "key", ["n"])
    # every feature has a value for every wallet, so those of feature i follow i times that many
    each = F.col("total_n") / F.lit(len(features))
    last = F.col("run_n") - F.col("key.f") * each
    first = last - F.col("n")
    low, high = F.floor((each - 1) / 2), F.ceil((each - 1) / 2)
    at = lambda place: F.max(F.when((first <= place) & (place < last), F.col("key.v")))
    found = spans.groupBy(F.col("key.f").alias("f")).agg(((at(low) + at(high)) / 2).alias("m")).collect()  # one row per feature
    middle = {r["f"]: r["m"] for r in found}
    return {c: float(middle.get(i) or 0.0) for i, c in enumerate(features)}


def _log_odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _scored_variants(rows: DataFrame, features: list[str], members: list, keep: list[str]) -> DataFrame:
    return stage(mean_probability(assembled(rows, features).select(*keep, "features"), members, keep), "variants")


def contributions(candidates: DataFrame, features: list[str], members: list, typical: dict[str, float], top: int = 6) -> DataFrame:
    """(address, feature, value, impact): how much the log-odds fall when one feature is set to its median, largest first.

    One batch scores all (candidate x feature) variants; the candidates are the capped alert list."""
    variants = F.array(F.lit(""), *[F.lit(c) for c in features])
    rows = clean(candidates.select("address", *features), features).withColumn("changed", F.explode(variants))
    rows = rows.withColumns({f"v_{c}": F.col(c) for c in features}).withColumns({c: F.when(F.col("changed") == c, F.lit(float(typical[c]))).otherwise(F.col(c)) for c in features})
    values = F.create_map(*[x for c in features for x in (F.lit(c), F.col(f"v_{c}"))])
    scored = _scored_variants(rows.select("address", "changed", *features), features, members, ["address", "changed"])
    base = scored.where("changed = ''").select("address", _log_odds(F.col("p")).alias("base"))
    from pyspark.sql import Window as W
    order = W.partitionBy("address").orderBy(F.desc(F.abs("impact")), "feature")
    imp = scored.where("changed <> ''").join(base, "address").select("address", F.col("changed").alias("feature"), F.round(F.col("base") - _log_odds(F.col("p")), 4).alias("impact"))
    own = rows.where("changed = ''").select("address", values.alias("values"))
    return (imp.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top).join(own, "address")
            .select("address", "feature", F.round(F.element_at("values", F.col("feature")), 4).alias("value"), "impact"))


# Groups of related features that an explanation changes together, and what their names contain -----
FACTORS = [
    ("Tor / VPN / bulletproof relaying", ("risky", "spy_tor", "share_datacenter")),
    ("proximity to known illicit seed wallets", ("taint", "ppr", "hops_", "seed")),
    ("peel-chain behaviour", ("peel",)),
    ("CoinJoin / mixing", ("coinjoin", "equal_output")),
    ("fan-out splitting", ("fan_out", "spend_max_n_out", "below_round")),
    ("round-trip flows", ("round_trip", "returns_to_input")),
    ("unusual behaviour (anomaly score)", ("anomaly",)),
    ("multi-country / fast-moving broadcasts", ("countries", "velocity", "n_spend_ips")),
    ("large entity cluster", ("cluster_size", "log_size")),
    ("fast re-spending of received funds", ("respend", "hold_h", "spent_1h")),
]
# ------------------------------------------------------------------------------------------------------------------


def factor_of(feature: str) -> str | None:
    return next((name for name, keys in FACTORS if any(k in feature for k in keys)), None)


def counterfactuals(candidates: DataFrame, features: list[str], members: list, typical: dict[str, float], contrib: DataFrame, max_factors: int = 4, s=SETTINGS) -> DataFrame:
    """Per alert: the risk after setting each raising factor to typical, and the smallest greedy set that brings it below HIGH.

    Result: address, risk_before, singles (factor, risk_after), minimal_factors, minimal_risk."""
    names = {c: factor_of(c) for c in features}
    table = F.create_map(*[F.lit(x) for c, f in names.items() if f for x in (c, f)])
    from pyspark.sql import Window as W
    ranked = (contrib.where("impact > 0").withColumn("factor", F.try_element_at(table, F.col("feature"))).where("factor is not null").groupBy("address", "factor").agg(F.sum("impact").alias("weight"))
              .withColumn("k", F.row_number().over(W.partitionBy("address").orderBy(F.desc("weight"), "factor"))).where(F.col("k") <= max_factors))
    lists = ranked.groupBy("address").agg(F.sort_array(F.collect_list(F.struct("k", "factor"))).alias("x")).select("address", F.col("x.factor").alias("factors"))
    n = F.size("factors")
    variants = F.array_distinct(F.concat(F.array(F.array().cast("array<string>")), F.transform("factors", lambda f: F.array(f)), F.transform(F.sequence(F.lit(1), n), lambda k: F.slice("factors", F.lit(1), k))))
    rows = clean(candidates.select("address", *features), features).join(lists, "address").withColumn("changed", F.explode(variants))
    rows = rows.withColumns({c: F.when(F.array_contains("changed", names[c]), F.lit(float(typical[c]))).otherwise(F.col(c)) for c in features if names[c]})
    p = _scored_variants(rows.select("address", F.array_join("changed", "|").alias("changed"), *features), features, members, ["address", "changed"])
    p = p.join(lists, "address").withColumn("set", F.filter(F.split("changed", r"\|"), lambda x: x != "")).withColumn("size", F.size("set"))
    prefix = F.col("set") == F.expr("slice(factors, 1, size)")
    risk = F.round(100 * F.col("p"), 1)
    below = prefix & (F.col("size") > 0) & (F.col("p") < s.risk_high_min / 100)
    g = p.groupBy("address").agg(F.max(F.when(F.col("size") == 0, risk)).alias("risk_before"), F.sort_array(F.collect_list(F.when(F.col("size") == 1, F.struct(F.col("set")[0].alias("factor"), risk.alias("risk_after"))))).alias("singles"),
                                 F.min(F.when(below, F.struct("size", "set", risk.alias("risk")))).alias("m"))
    return g.select("address", "risk_before", "singles", F.col("m.set").alias("minimal_factors"), F.col("m.risk").alias("minimal_risk"))
