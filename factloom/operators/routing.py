"""Validation of classifiers on a stream: folds, confidence bands, routes, flips and ranking metrics.

Positions and running totals go by buckets: totals of the buckets are summed first, then
each bucket is numbered on its own, so no task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(rows: DataFrame, bucket: Column, order: list[str]) -> DataFrame:
    """Adds ``pos`` (from 0) and ``n_rows``: the place of each row by bucket and then ``order``.

    ``bucket`` must not fall along ``order``; buckets, such as days, are few, their rows many.
    """
    rows = rows.withColumn("_b", bucket)
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_b", F.coalesce(before, F.lit(0)).alias("_at"), F.sum("_n").over(Window.partitionBy()).alias("n_rows"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return rows.withColumn("_k", place).join(starts, "_b").withColumn("pos", F.col("_at") + F.col("_k")).drop("_b", "_k", "_at")


def expanding_folds(rows: DataFrame, bucket: Column, order: list[str], folds: int) -> DataFrame:
    """Adds ``fold`` (0 to folds - 1): equal spans of positions, bounds rounded down."""
    placed = positions(rows, bucket, order)
    fold = F.lit(0)
    for k in range(1, folds):
        fold = fold + (F.col("pos") >= F.floor(F.lit(k) * F.col("n_rows") / folds)).cast("int")
    return placed.withColumn("fold", fold.cast("long")).drop("pos", "n_rows")


def band_curve(rows: DataFrame, threshold: float, lows: list[float], highs: list[float]) -> DataFrame:
    """(lo, hi, routed, routed_share, errors_captured, error_capture) of every band, from one pass over (score, label).

    An error is a row that the threshold puts on the wrong side; a band holds its bounds.
    """
    wrong = ((F.col("score") >= threshold).cast("int") != F.col("label")).cast("long")
    below = lambda c, inclusive: (F.col("score") <= c) if inclusive else (F.col("score") < c)
    count = lambda c, inclusive: F.struct(F.lit(float(c)).alias("cut"), F.sum(below(c, inclusive).cast("long")).alias("n"), F.sum(F.when(below(c, inclusive), wrong).otherwise(0)).alias("e"))
    sums = rows.agg(F.count("*").alias("n"), F.sum(wrong).alias("errors"), F.array(*(count(c, False) for c in lows)).alias("los"), F.array(*(count(c, True) for c in highs)).alias("his"))
    bands = sums.where("n > 0").select("n", "errors", F.explode("los").alias("l"), "his").select("n", "errors", "l", F.explode("his").alias("h"))
    routed, captured = F.col("h.n") - F.col("l.n"), F.col("h.e") - F.col("l.e")
    return bands.select(
        F.col("l.cut").alias("lo"),
        F.col("h.cut").alias("hi"),
        routed.alias("routed"),
        F.round(routed / F.col("n"), 6).alias("routed_share"),
        captured.alias("errors_captured"),
        F.round(F.coalesce(captured / F.nullif("errors", F.lit(0)), F.lit(0.0)), 6).alias("error_capture"),
    )


def select_band(curve: DataFrame, budget: float) -> DataFrame:
    """The band within the budget that holds most errors, then routes least, then is narrowest; no row if none fits."""
    fits = curve.where(F.col("routed_share") <= budget)
    return fits.orderBy(F.desc("errors_captured"), "routed", F.round(F.col("hi") - F.col("lo"), 9), "lo").limit(1)


def route(rows: DataFrame, low: float, high: float, primary: str = "primary", secondary: str = "secondary") -> DataFrame:
    """Adds ``routed`` (0 or 1) and ``final``: the second score where the first lies in the band."""
    inside = F.coalesce(F.col(primary).between(low, high), F.lit(False))
    return rows.withColumns({"routed": inside.cast("long"), "final": F.when(inside, F.col(secondary)).otherwise(F.col(primary))})


def flips(rows: DataFrame, threshold: float, label: str = "label") -> DataFrame:
    """One row: what routing changed, of ``route``'s rows."""
    truth = F.col(label) == 1
    before, after, routed = (F.col("primary") >= threshold) == truth, (F.col("final") >= threshold) == truth, F.col("routed") == 1
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = rows.agg(
        count(routed).alias("routed"),
        count(routed & truth).alias("routed_positives"),
        count(routed & ~before).alias("errors_inside"),
        count(~routed & ~before).alias("errors_outside"),
        count(routed & ~before & after).alias("fixed"),
        count(routed & before & ~after).alias("broken"),
    )
    return out.withColumn("net", F.col("fixed") - F.col("broken"))


def ranking_metrics(rows: DataFrame, buckets: int = 1024) -> DataFrame:
    """One row: n, positives, roc_auc and average_precision of (score in 0 to 1, label); ties count as one threshold.

    Null without both kinds of labels (average_precision: without positives).
    """
    bucket = F.least(F.floor(F.col("score") * buckets), F.lit(buckets)).alias("_b")
    steps = rows.where("score IS NOT NULL AND label IS NOT NULL").groupBy(bucket, "score").agg(F.sum("label").cast("long").alias("p"), F.count("*").alias("n"))
    totals = steps.groupBy("_b").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    starts = totals.select("_b", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}0") for c in ("_p", "_n")), F.sum("_p").over(every).alias("_all_p"), F.sum("_n").over(every).alias("_all_n"))
    within = Window.partitionBy("_b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = steps.withColumns({"cp": F.sum("p").over(within), "cn": F.sum("n").over(within)}).join(starts, "_b")
    run = run.withColumns({"cp": F.col("cp") + F.col("_p0"), "cn": F.col("cn") + F.col("_n0")})
    pairs = (F.col("n") - F.col("p")) * (F.col("cp") - F.col("p") / 2)
    out = run.agg(F.coalesce(F.max("_all_n"), F.lit(0)).alias("n"), F.coalesce(F.max("_all_p"), F.lit(0)).alias("positives"), F.sum(pairs).alias("_a"), F.sum(F.col("p") * F.col("cp") / F.col("cn")).alias("_ap"))
    negatives = F.col("n") - F.col("positives")
    return out.select(
        "n",
        "positives",
        F.round(F.col("_a") / F.nullif(F.col("positives") * negatives, F.lit(0)), 6).alias("roc_auc"),
        F.round(F.col("_ap") / F.nullif("positives", F.lit(0)), 6).alias("average_precision"),
    )


def logistic_scores(train: DataFrame, test: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """``test`` with ``score``: a logistic regression with balanced class weights, fitted by Spark on ``train``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    sizes = train.agg(F.count("*").alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("p")).first()
    if not 0 < sizes.p < sizes.n:
        return test.withColumn("score", F.lit(float(sizes.p > 0) if sizes.n else 0.5))
    weight = F.when(F.col(label) == 1, sizes.n / (2 * sizes.p)).otherwise(sizes.n / (2 * (sizes.n - sizes.p)))
    assembler = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep")
    model = LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_weight", maxIter=50, regParam=1e-4)
    fitted = model.fit(assembler.transform(train.fillna(0, features).withColumn("_weight", weight)))
    scored = fitted.setProbabilityCol("_probability").transform(assembler.transform(test.fillna(0, features)))
    return scored.select(*test.columns, vector_to_array("_probability")[1].alias("score"))
