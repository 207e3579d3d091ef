"""Verdicts on single candidates, and comparison of two lists of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legilens.functions import scalars as f
from legilens.functions.dialect import Spark
from legilens.operators import detectors


def verdicts(candidates: DataFrame) -> DataFrame:
    """(candidate, label, confidence) of each candidate: its best provider pattern, or - and null."""
    folded = candidates.select(F.col("candidate").alias("id"), F.lit(0).alias("seq"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.expr(f.normalize_unicode("candidate", Spark)).alias("token"))
    sound = folded.filter("length(token) >= 12").filter(detectors.rejected_reason().isNull())
    best = detectors.best_pattern(detectors.matched(sound)).select(F.col("id").alias("candidate"), "m.label", "m.confidence")
    return candidates.select("candidate").join(best, "candidate", "left").select("candidate", F.coalesce("label", F.lit("-")).alias("label"), "confidence")


def disagreements(ours: DataFrame, theirs: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Candidates of two lists (candidate, label, confidence) that only one has, or that differ in label or by more than tolerance."""
    a = ours.select("candidate", F.col("label").alias("label_a"), F.col("confidence").alias("confidence_a"), F.lit(1).alias("in_a"))
    b = theirs.select("candidate", F.col("label").alias("label_b"), F.col("confidence").alias("confidence_b"), F.lit(1).alias("in_b"))
    far = F.abs(F.col("confidence_a") - F.col("confidence_b")) > tolerance
    differs = F.col("in_a").isNull() | F.col("in_b").isNull() | ~F.col("label_a").eqNullSafe(F.col("label_b")) | F.coalesce(far, F.lit(False))
    return a.join(b, "candidate", "full").filter(differs).drop("in_a", "in_b")
