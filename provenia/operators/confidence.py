"""Confidence of resolved attributes: features, a readable prior, fitting, thresholds, curves."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenia.operators.arbitrate import authority_tier, tier_weight
from provenia.sources.reference import FEATURES, GENERAL_FLOOR, LEAST_SAFETY, MATCH_SCORES, PRIOR_BIAS, PRIOR_WEIGHTS, REJECT_BELOW, SAFETY_FLOOR, TARGET_PRECISION, TARGET_PRECISION_SAFETY


class Model(NamedTuple):
    """Weights of FEATURES, bias, decision floors, whether fitted, and what is known about the fit."""

    weights: tuple[float, ...] = PRIOR_WEIGHTS
    bias: float = PRIOR_BIAS
    general: float = GENERAL_FLOOR
    safety: float = SAFETY_FLOOR
    reject_below: float = REJECT_BELOW
    trained: bool = False
    metrics: dict = {}


def featurize(df: DataFrame) -> DataFrame:
    """df, as apply_rules() gives it, with the columns of FEATURES; without a winner its features are 0."""
    won = F.col("verified").isNotNull()
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    share = lambda c, n: F.least(c, F.lit(n)) / F.lit(float(n))
    scores = F.create_map(*[F.lit(x) for pair in MATCH_SCORES.items() for x in pair])
    return df.withColumns(
        {
            "extractor_precision": F.coalesce(F.col("precision"), F.lit(0.0)) / 3.0,
            "match_quality": F.coalesce(F.try_element_at(scores, F.col("match_mode")), F.lit(0.0)),
            "agreeing_sources_share": share(F.col("agreeing_sources"), 4),
            "is_conflicting": flag(F.col("conflicting")),
            "n_competing": share(F.size("conflict_values"), 4),
            "rule_violations_share": share(F.size("rule_violations"), 3),
            "authority_weight": F.when(won, tier_weight(authority_tier(F.col("authority")))).otherwise(0.0),
            "column_resolved": flag(F.col("column_index") >= 0),
            "n_quarantined_share": share(F.col("n_quarantined"), 4),
            "has_focus": flag(F.col("focus_start") >= 0),
            "consistency": F.coalesce(F.col("self_consistency"), F.lit(1.0)),
        }
    )


#: The columns that featurize() makes, in the order of FEATURES.
FEATURE_COLUMNS = ("extractor_precision", "match_quality", "agreeing_sources_share", "is_conflicting", "n_competing", "rule_violations_share", "authority_weight", "column_resolved", "n_quarantined_share", "has_focus", "consistency")


def probability(columns: list[Column] | tuple[str, ...], model: Model = Model()) -> Column:
    z = F.lit(float(model.bias))
    for c, w in zip(columns, model.weights, strict=True):
        z = z + F.lit(float(w)) * (F.col(c) if isinstance(c, str) else c)
    return 1.0 / (1.0 + F.exp(-z))


def decide(p: Column, safety: Column, conflicting: Column, error: Column, model: Model = Model()) -> Column:
    """An error rule sends to review before any floor; then the floors, and no conflict is ever published."""
    floor = F.when(safety, model.safety).otherwise(model.general)
    return F.when(error, "REVIEW").when(p < model.reject_below, "REJECT").when((p >= floor) & ~conflicting, "AUTO_PUBLISH").otherwise("REVIEW")


def score_and_decide(df: DataFrame, model: Model = Model()) -> DataFrame:
    """featurize()d rows with confidence, decision and a last reason. df needs `safety`."""
    error = F.exists("rule_violations", lambda v: F.startswith(v, F.lit("[error]")))
    p = probability(FEATURE_COLUMNS, model)
    scored = featurize(df).withColumn("p", p).withColumn("decision", decide(F.col("p"), F.col("safety"), F.col("conflicting"), error, model))
    shown = F.format_string("%.3f", "p")
    floor = F.concat(F.when(F.col("safety"), "safety floor ").otherwise("floor "), F.format_string("%.3f", F.when(F.col("safety"), model.safety).otherwise(model.general)))
    why = F.when(F.col("decision") == "AUTO_PUBLISH", F.concat(F.lit("auto-published: confidence "), shown, F.lit(" >= "), floor)).when(F.col("decision") == "REVIEW", F.concat(F.lit("routed to review: confidence "), shown)).otherwise(F.concat(F.lit("rejected: confidence "), shown, F.lit(" below floor")))
    return scored.withColumn("confidence", F.round("p", 4)).withColumn("reasons", F.array_append("reasons", why))


def review_queue(df: DataFrame) -> DataFrame:
    """Rows to review by risk: uncertainty, times 3 if safety critical, times 2 if conflicting."""
    risk = (1.0 - F.col("confidence")) * F.when(F.col("safety"), 3.0).otherwise(1.0) * F.when(F.col("conflicting"), 2.0).otherwise(1.0)
    return df.where("decision = 'REVIEW'").withColumn("risk", F.round(risk, 4)).orderBy(F.desc("risk"), "sku", "attr_pos")


def pick_threshold(scored: DataFrame, target: float) -> float:
    """The lowest of the scores, rounded to 4 places, and 0 and 1 from which precision meets the target; 1.01 if none, 0.9 of nothing.

    scored: p, y. Precision above a threshold counts raw scores, so each threshold takes
    the rows of p >= t: scores are summed by their last reached threshold, and thresholds
    are accumulated from above over distinct scores.
    """
    return threshold_sweep(scored).agg(F.coalesce(F.min(F.when(F.col("precision") >= target, F.col("t"))), F.when(F.max("n_rows") > 0, 1.01).otherwise(0.9)).alias("t")).first().t


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """(t, n, precision, n_rows) for each threshold that some score reaches.

    Scores fall in one of the 10,000 rounding steps; a step's own rows below its rounded
    value don't reach it, so those are counted apart. The sums are at most 10,001 rows,
    over which the window runs, whatever the number of scores.
    """
    t = F.round("p", 4)
    steps = scored.groupBy(t.alias("t")).agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.count_if(F.col("p") < t).alias("below"), F.sum(F.when(F.col("p") < t, F.col("y")).otherwise(0)).alias("s_below"))
    edges = scored.sparkSession.createDataFrame([(0.0, 0, 0, 0, 0), (1.0, 0, 0, 0, 0)], "t double, n long, s long, below long, s_below long")
    every = steps.select("t", "n", F.col("s").cast("long").alias("s"), "below", F.col("s_below").cast("long").alias("s_below")).unionByName(edges).groupBy("t").agg(*[F.sum(c).alias(c) for c in ("n", "s", "below", "s_below")])
    down = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    reached = every.withColumns({"k": F.sum("n").over(down) - F.col("below"), "hits": F.sum("s").over(down) - F.col("s_below"), "n_rows": F.sum("n").over(Window.partitionBy())})
    return reached.select("t", F.col("k").alias("n"), F.when(F.col("k") > 0, F.col("hits") / F.col("k")).alias("precision"), "n_rows")


def risk_coverage(scored: DataFrame, points: int = 60) -> DataFrame:
    """(t, coverage, precision) at evenly spaced thresholds; precision is 1 where nothing is covered.

    Rows are counted by the number of thresholds they reach, then accumulated over those.
    """
    reach = F.least(F.floor(F.col("p") * (points - 1) + 1e-9), F.lit(points - 1)).cast("int")
    exact = F.when(F.col("p") >= reach / F.lit(float(points - 1)), reach).otherwise(reach - 1)
    counted = scored.groupBy(exact.alias("k")).agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    every = scored.sparkSession.range(points).select(F.col("id").cast("int").alias("k"))
    down = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    filled = every.join(counted, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s", F.lit(0)).alias("s"))
    sums = filled.select("k", F.sum("n").over(down).alias("n"), F.sum("s").over(down).alias("s"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return sums.select((F.col("k") / F.lit(float(points - 1))).alias("t"), (F.col("n") / F.col("all")).alias("coverage"), F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(1.0).alias("precision"))


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(ece): the mean gap between stated confidence and accuracy over equal bins, the last closed."""
    per = scored.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("acc"), F.avg("p").alias("conf"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def auc(scored: DataFrame) -> DataFrame:
    """(auc): the chance that a positive outranks a negative, ties counting half; null if a class is missing.

    Counts are summed by score, so equal scores meet before the window.
    """
    per = scored.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    # Scores are dealt into ranges, each with its own running sum, so no task sees them all.
    bucketed = per.withColumn("b", F.floor(F.col("p") * 4096))
    below = bucketed.groupBy("b").agg(F.sum("neg").alias("n")).select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("under"))
    inner = F.coalesce(F.sum("neg").over(Window.partitionBy("b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = bucketed.withColumn("within", inner).join(F.broadcast(below), "b")
    wins = F.sum(F.col("pos") * (F.col("under") + F.col("within") + F.col("neg") / 2))
    return ranked.agg((wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


#: Rows of the smaller class beyond which a hash alone deals folds evenly enough.
DEALT = 10_000


def _logistic(rows: DataFrame, columns: tuple[str, ...], c: float = 1.0):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows.select(*columns, F.col("y").cast("double").alias("label")))
    return LogisticRegression(regParam=1.0 / (max(1, data.count()) * c), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-9).fit(data)


def out_of_fold(rows: DataFrame, columns: tuple[str, ...], folds: int, id_col: str = "row_id") -> DataFrame:
    """rows with p, scored by a model fitted on the other folds.

    Folds are dealt by a hash; of classes of few rows, evenly in its order, so that no fold
    is without one.
    """
    key = F.xxhash64(F.lit(17), F.col(id_col))
    least = rows.groupBy("y").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    turn = F.pmod(key, F.lit(folds)) if least > DEALT else F.row_number().over(Window.partitionBy("y").orderBy(key, id_col))
    dealt = rows.withColumn("fold", (turn % folds).cast("int"))
    out = None
    for k in range(folds):
        fitted = _logistic(dealt.where(F.col("fold") != k), columns)
        part = dealt.where(F.col("fold") == k).withColumn("p", probability(columns, Model(tuple(fitted.coefficients.toArray().tolist()), float(fitted.intercept))))
        out = part if out is None else out.unionByName(part)
    return out.drop("fold")


def fit(rows: DataFrame, columns: tuple[str, ...] = FEATURE_COLUMNS, target: float = TARGET_PRECISION, target_safety: float = TARGET_PRECISION_SAFETY) -> tuple[Model, DataFrame]:
    """A model of graded rows (row_id, columns, y, safety) and their out-of-fold scores.

    Floors meet the target precisions on scores of models that had not seen the row. A
    safety-critical attribute never has a lower floor than another, nor one under 0.60.
    With a single class the prior stays.
    """
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model(metrics={"note": "labels have a single class; keeping the prior"}), rows.withColumn("p", probability(columns))
    scored = out_of_fold(rows, columns, int(min(5, max(2, min(n.values()))))).cache()
    fitted = _logistic(rows, columns)
    general = pick_threshold(scored.where(~F.col("safety")), target)
    critical = scored.where("safety")
    safety = pick_threshold(critical, target_safety) if critical.limit(1).count() else SAFETY_FLOOR
    safety = max(safety, general, LEAST_SAFETY)
    metrics = {"n": sum(n.values()), "positives": n.get(1, 0), "oof_auc": auc(scored).first().auc, "oof_ece": calibration_error(scored).first().ece, "coverage_at_threshold": scored.agg(F.avg((F.col("p") >= general).cast("int"))).first()[0]}
    return Model(tuple(fitted.coefficients.toArray().tolist()), float(fitted.intercept), general, safety, REJECT_BELOW, True, metrics), scored


def redecide(scored: DataFrame, model: Model) -> DataFrame:
    """Out-of-fold decisions: published or reviewed, never rejected. scored: p, safety, conflicting, error."""
    floor = F.when(F.col("safety"), model.safety).otherwise(model.general)
    return scored.withColumn("decision", F.when((F.col("p") >= floor) & ~F.col("conflicting") & ~F.col("error"), "AUTO_PUBLISH").otherwise("REVIEW"))


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    blob = model._asdict() | {"features": list(FEATURES)}
    spark.createDataFrame([(json.dumps(blob),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> Model:
    """The saved model; the prior, with a note, where there is none or its features are not ours."""
    from pyspark.errors import AnalysisException

    try:
        blob = json.loads("".join(r.value for r in spark.read.text(path).collect()))
    except AnalysisException:
        return Model()
    if blob.get("features") and blob["features"] != list(FEATURES):
        return Model(metrics={"note": "saved model is stale (features changed); using the prior", "saved_features": len(blob["features"]), "current_features": len(FEATURES)})
    if blob.get("trained") and len(blob["weights"]) != len(FEATURES):
        return Model(metrics={"note": "number of weights does not match the features; using the prior"})
    return Model(**{k: tuple(blob[k]) if k == "weights" else blob[k] for k in Model._fields})
