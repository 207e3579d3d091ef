"""Exact deduplication through a log-structured index of digests, in DataFrame operations only.

Documents are hashed once into a log of (document, memtable, digest). Each memtable is flushed as a run: one entry per
digest with the smallest document and the number of documents, sorted by digest, beside a bit filter of its digests.
Compaction sends an entry through the merge only if it may be repeated, that is if its run holds it more than once or
another run's filter has it; the rest are single for certain. The merge keeps the smallest identifier. Hits, digests
of more than one document, are then verified byte by byte on the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legilens.llm.shared import bit_filter, bit_test, free, in_filter, saved, settled, slot_of

#: Runs that one compaction merges.
FAN_IN = 8
#: Bits of a run's filter and of the filter over the hits: 512 KB and 2 MB, whatever the input's size.
RUN_BITS, HIT_BITS = 1 << 22, 1 << 24

NORMAL_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), NORMAL_SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def flush(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runs (run, digest, keep_id, n), sorted by digest, and their filters (run, bucket, bitmap)."""
    entries = log.groupBy("run", "digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    runs = saved(entries.sortWithinPartitions("run", "digest"), "runs")
    return runs, bit_filter(runs, "digest", RUN_BITS, "run")


def compact(runs: DataFrame, filters: DataFrame) -> DataFrame:
    """The hits (digest, keep_id, n) of all runs: the digests that more than one document has.

    An entry is merged if its own run repeats it or the filter of another run has it. Filters are FAN_IN in number and of a
    fixed size each, so probing them is a broadcast join.
    """
    gathered = filters.groupBy("bucket").agg(F.collect_list(F.struct("run", "bitmap")).alias("others"))
    probed = runs.withColumn("_slot", slot_of(F.col("digest"), RUN_BITS)).withColumns(
        {"bucket": F.expr("bitmap_bucket_number(_slot)"), "_at": F.expr("bitmap_bit_position(_slot)")}
    )
    test = F.expr(f"n > 1 or exists(others, m -> m.run <> run and {bit_test('m.bitmap')})")
    merged = probed.join(F.broadcast(gathered), "bucket").filter(test)
    return merged.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")).filter("n > 1")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and all empty texts are equal. Of equal texts the smallest identifier stays. Rows that
    share both identifier and text are kept or dropped together; a null identifier never stays unless the whole group has none
    (then keep_id is null and all its rows stay). Empty input gives no rows; other columns of docs are ignored.
    digest maps the normalised text to the index key; texts that share a key but not their bytes are told apart by the
    verification and regrouped by the bytes themselves.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    log = saved(
        texts.select(
            "doc_id",
            digest(F.col("norm")).alias("digest"),
            sha256(F.col("norm")).alias("text_sha256"),
            F.pmod(F.xxhash64("doc_id"), F.lit(FAN_IN)).cast("int").alias("run"),
        ),
        "log",
    )
    runs, filters = flush(log)
    hits = saved(compact(runs, filters), "hits")

    # Byte verification: all texts of a digest are equal when their least and their greatest are. Copies meet within
    # each map task first, so a group of any size sends one text for each task.
    suspects = in_filter(texts.withColumn("digest", digest(F.col("norm"))), "digest", bit_filter(hits, "digest", HIT_BITS), HIT_BITS)
    spread = suspects.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    clashing = saved(spread.filter("low <> high").select("digest"), "clashes")

    found = log.join(hits, "digest", "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
        "digest",
    )
    if not clashing.isEmpty():
        again = texts.withColumn("digest", digest(F.col("norm"))).join(clashing, "digest")
        by_text = again.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        apart = again.select("doc_id", "norm", "digest").join(by_text, "norm").withColumn("text_sha256", sha256(F.col("norm")))
        found = found.join(clashing, "digest", "left_anti").unionByName(apart.select(*found.columns))
    return found.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each different normalised text, with all their columns: the one with the smallest doc_id.

    Where several rows share that doc_id and the text, one of them stays; where a doc_id is that of different texts, each text is judged on its own. A
    row with a null doc_id stays only if all rows of its text have none, and then one of them does. Null texts count as empty. An
    empty table stays empty.
    """
    digest = free("digest", docs)
    tagged = saved(docs.withColumn(digest, sha256(normalised(F.col("text")))), "tagged")
    told = exact_dedup(docs).filter("group_size > 1").groupBy("doc_id", F.col("text_sha256").alias(digest)).agg(F.bool_or("kept").alias("stays"))
    return settled(tagged, ["doc_id", digest], saved(told, "settled")).drop(digest)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
), g as (select norm, min(doc_id) as keep_id, count(*) as group_size from n group by norm)
select n.doc_id, g.keep_id, g.group_size, n.doc_id is not distinct from g.keep_id as kept, sha256(n.norm) as text_sha256
from n join g using (norm)
"""
