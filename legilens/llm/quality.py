"""Quality classifier by co-training of a text view and a metadata view.

Every document is reduced once to two short lists of small whole numbers: what its text is like (letters, digits, signs,
repetition) and what is known about it (language, source, sizes, layout). Each view has a naive Bayes model over its list, a table of fixed
size that one aggregation over all rows fits, and a calibration: scores are binned, and a bin's share of good labelled
rows, smoothed and made monotone, is its probability.

In each round every view labels the rows without a label that it is sure of, and the other view is refitted with them.
The calibrated views are then combined as independent evidence. Labels of rows whose crc32(doc_id) mod 5 is 0 are never used.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legilens.llm.shared import saved

VIEWS = ("text", "meta")
#: Values that an item of a list may take, from 0.
LEVELS = 64
#: Rounds of exchange, what counts as sure, and the weight of a pseudo-label beside a label's 1.
ROUNDS, SURE, PSEUDO = 3, 0.95, 0.25
#: Calibration bins over the model's log odds, from -SPAN to SPAN.
BINS, SPAN = 40, 10.0


def _share(part: float, whole: float, scale: float = 1.0) -> int:
    return min(15, int(16 * scale * part / whole)) if whole else 0


def _log(x: float) -> int:
    return min(31, int(2 * math.log2(1 + x)))


def describe(text: str | None, lang: str | None, source: str | None) -> tuple[list[int], list[int]]:
    """The two lists of a document."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits, high = int(c[65:91].sum()), int(c[97:123].sum()), int(c[48:58].sum()), int(c[128:].sum())
    space = int(c[32] + c[9:14].sum())
    words, lines = raw.split(), raw.split(b"\n")
    p = c[c > 0] / max(n, 1)
    text_view = [
        _share(upper, upper + lower),
        _share(digits, n, 4),
        _share(n - upper - lower - digits - high - space, n, 3),
        _share(int(c[124]), len(words)),
        _share(int(c[33]), len(words)),
        _share(len(set(words)), len(words)),
        _share(len(lines) - len(set(lines)), len(lines)),
        min(31, int(2 * (n - space) / max(1, len(words)))),
        min(31, int(-4 * float((p * np.log2(p)).sum()))) if n else 0,
    ]
    meta_view = [
        zlib.crc32((lang or "").encode()) % LEVELS,
        zlib.crc32((source or "").encode()) % LEVELS,
        _log(n),
        _log(len(lines)),
        _log(n / len(lines)),
        int(raw[-1]) % LEVELS if n else 0,
        _share(high, n),
    ]
    return text_view, meta_view


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, text array<int>, meta array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [describe(*x) for x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in both], kind), pa.array([x for _, x in both], kind)], ["doc_id", "text", "meta"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "lang", "source").mapInArrow(run, f"doc_id {kind}, text array<int>, meta array<int>")


def fit(rows: DataFrame, view: str, good: Column, bad: Column) -> list[list[float]]:
    """Log odds of each level of each item of a view's list, from weights of good and bad; one table of fixed size."""
    items = rows.select(good.alias("good"), bad.alias("bad"), F.posexplode(view).alias("item", "level")).filter("good > 0 or bad > 0")
    sums = items.groupBy("item", "level").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
    n = 1 + max((r["item"] for r in sums), default=0)
    good_of, bad_of = np.full((n, LEVELS), 0.5), np.full((n, LEVELS), 0.5)
    for r in sums:
        good_of[r["item"], r["level"]] += r["good"]
        bad_of[r["item"], r["level"]] += r["bad"]
    odds = np.log(good_of / good_of.sum(axis=1, keepdims=True)) - np.log(bad_of / bad_of.sum(axis=1, keepdims=True))
    # Items of one view are not independent of each other: the square root of their number tempers the sum.
    return (odds / math.sqrt(n)).round(6).tolist()


def raw_score(view: str, table: list[list[float]]) -> Column:
    """Sum of the table's entries for a row's list."""
    literal = F.array(*[F.array(*[F.lit(x) for x in row]) for row in table])
    picked = F.zip_with(F.col(view), literal, lambda level, row: F.element_at(row, level + 1))
    return F.aggregate(picked, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def bin_of(score: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((score + SPAN) * (BINS / (2 * SPAN))))).cast("int")


def calibration(rows: DataFrame, score: Column) -> list[float]:
    """Log odds of good in each bin of the score over the labelled rows: smoothed, then made monotone by pooling neighbours."""
    got = rows.filter("label is not null").groupBy(bin_of(score).alias("bin")).agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    good, n = np.zeros(BINS), np.zeros(BINS)
    for r in got:
        good[r["bin"]], n[r["bin"]] = r["good"], r["n"]
    base = (good.sum() + 1) / (n.sum() + 2)
    pools: list[list[float]] = []
    for g, m in zip(good + 2 * base, n + 2, strict=True):
        pools.append([g, m, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] > pools[-1][0] * pools[-2][1]:
            g2, m2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + g2, pools[-1][1] + m2, pools[-1][2] + k2]
    shares = [g / m for g, m, k in pools for _ in range(int(k))]
    return [round(math.log(p / (1 - p)), 6) for p in (min(1 - 1e-4, max(1e-4, s)) for s in shares)]


def calibrated(score: Column, odds: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in odds]), bin_of(score) + 1)


def quality(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (probability of good quality), text_score, meta_score, predicted.

    docs has doc_id, text, lang and source; nulls count as empty. labels has doc_id and quality (0 or 1); rows with a null are
    ignored, and of several labels of a document the lowest counts. Without labelled rows every score is near one half. Other columns
    are ignored.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    rows = described(docs).join(known, "doc_id", "left").withColumn("held_out", held)
    rows = saved(rows.withColumn("label", F.when(~F.col("held_out"), F.col("label"))), "described")

    label = F.col("label")
    good, bad = F.coalesce((label == 1).cast("double"), F.lit(0.0)), F.coalesce((label == 0).cast("double"), F.lit(0.0))
    scores: dict[str, Column] = {}
    for turn in range(rounds + 1):
        before, scores = scores, {}
        for view, other in zip(VIEWS, reversed(VIEWS), strict=True):
            plus, minus = good, bad
            if turn:
                told = before[other]  # what the other view is sure of
                sure = math.log(SURE / (1 - SURE))
                plus = plus + F.when(label.isNull() & (told >= sure), PSEUDO).otherwise(0.0)
                minus = minus + F.when(label.isNull() & (told <= -sure), PSEUDO).otherwise(0.0)
            raw = raw_score(view, fit(rows, view, plus, minus))
            scores[view] = calibrated(raw, calibration(rows, raw))
    base = rows.agg(F.coalesce(F.avg("label"), F.lit(0.5)).alias("p")).first()["p"]
    prior = math.log(min(1 - 1e-4, max(1e-4, base)) / (1 - min(1 - 1e-4, max(1e-4, base))))
    chance = lambda odds: F.round(1 / (1 + F.exp(-odds)), 6)
    out = rows.withColumns({"_t": scores["text"], "_m": scores["meta"]})
    both = chance(F.col("_t") + F.col("_m") - F.lit(prior))
    return out.select(
        "doc_id", "held_out", both.alias("score"), chance(F.col("_t")).alias("text_score"), chance(F.col("_m")).alias("meta_score"), (both >= 0.5).cast("int").alias("predicted")
    )


def op1_quality_co_training(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
