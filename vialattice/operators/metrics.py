"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(rows: DataFrame, predicted: Column, actual: Column, eps: float | None = None) -> DataFrame:
    """Counts, precision, recall and F1 in one row (A14); ``eps`` is added to denominators, or undefined ones give 0."""
    tp, fp, fn, tn = (F.sum(c.cast("int")) for c in (predicted & actual, predicted & ~actual, ~predicted & actual, ~predicted & ~actual))
    out = rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))

    def ratio(a: Column, b: Column) -> Column:
        return a / (b + eps) if eps is not None else F.when(b > 0, a / b).otherwise(0.0)

    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def roc(rows: DataFrame, score: str = "score", truth: str = "truth", bins: int = 64) -> DataFrame:
    """Points of the ROC curve: threshold, tpr, fpr, j, and area of the step from the threshold above.

    Equal scores are aggregated first. Running sums go within ranges of about as many distinct scores
    each, and each range begins with the totals of those above it; only the ranges' totals, ``bins``
    rows, meet in one task.
    """
    by = rows.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.sum((~F.col(truth)).cast("long")).alias("n"))
    bounds = by.agg(F.percentile_approx("threshold", [k / bins for k in range(1, bins)], 1000).alias("bounds"))  # one row
    binned = by.crossJoin(F.broadcast(bounds)).withColumn("bin", F.size(F.filter("bounds", lambda b: b > F.col("threshold")))).drop("bounds")
    above = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = binned.groupBy("bin").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    totals = totals.select("bin", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"above_{c}") for c in ("bp", "bn")), F.sum("bp").over(every).alias("all_p"), F.sum("bn").over(every).alias("all_n"))
    inside = Window.partitionBy("bin").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    run = binned.withColumn("tp", F.sum("p").over(inside)).withColumn("fp", F.sum("n").over(inside)).join(F.broadcast(totals), "bin")
    tp, fp = F.col("tp") + F.col("above_bp"), F.col("fp") + F.col("above_bn")
    area = (2 * tp - F.col("p")) / 2 / F.col("all_p") * (F.col("n") / F.col("all_n"))
    out = run.select("threshold", (tp / F.col("all_p")).alias("tpr"), (fp / F.col("all_n")).alias("fpr"), area.alias("area"))
    return out.withColumn("j", F.col("tpr") - F.col("fpr"))


def auc(curve: DataFrame) -> DataFrame:
    """Area under the curve, best J and its threshold, in one row."""
    best = F.min(F.struct((-F.round("j", 9)).alias("s"), (-F.col("threshold")).alias("t")))
    return curve.agg(F.sum("area").alias("auc"), F.max("j").alias("best_j"), (-best["t"]).alias("youden"))


def rank_mae(matches: DataFrame) -> DataFrame:
    """Mean absolute rank error of matches."""
    return matches.agg(F.avg(F.abs(F.col("q_rank") - F.col("m_rank"))).alias("mae"), F.count("*").alias("n"))


def history_summary(history: DataFrame, threshold: float = 0.8) -> DataFrame:
    """First epoch at the threshold, best epoch and last value of each variant and metric.

    ``history``: variant, metric, epoch, value.
    """
    at = F.when(F.col("value") >= threshold, F.col("epoch"))
    best = F.min(F.struct((-F.round("value", 9)).alias("s"), "epoch"))
    return history.groupBy("variant", "metric").agg(F.min(at).alias("epochs_to_threshold"), best["epoch"].alias("best_epoch"), F.max("value").alias("best_value"), F.max_by("value", "epoch").alias("final_value"))


def epoch_means(batches: DataFrame) -> DataFrame:
    """Means of each metric over an epoch's batches."""
    return batches.groupBy("variant", "metric", "epoch").agg(F.avg("value").alias("value"))


def best_window(sweep: DataFrame) -> DataFrame:
    """The window size of the best F1 and the gap between injected and clean scores (A30): size, f1, clean, injected."""
    best = F.min(F.struct((-F.round("f1", 9)).alias("s"), "size", "f1", (F.col("injected") - F.col("clean")).alias("gap"))).alias("b")
    return sweep.agg(best).select(F.col("b.size").alias("size"), F.col("b.f1").alias("f1"), F.col("b.gap").alias("gap"))
