"""Pieces that several operators use: shared scratch tables, bit filters of fixed size and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits in one row of bitmap_construct_agg's result.
BUCKET_BITS = 32768


#: Folder of each application that names none.
OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine, where it is unset, a new one."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in OWN:
        OWN[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return OWN[context.applicationId]


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: its lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slot_of(key: Column, bits: int) -> Column:
    """The bit of a filter of the given size that stands for a key."""
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def bit_filter(keys: DataFrame, key: str, bits: int, *by: str, hashed: bool = False) -> DataFrame:
    """A set filter over the keys, at most bits / 8 bytes whatever their number: rows (bucket, bitmap) of 4 KB each.
    With further columns, one such filter for each of their values. Keys that are hashes already are taken as they are.

    A key of the set always tests true; another may test true by chance, the oftener the fuller the filter.
    """
    slots = keys.select(*by, (F.pmod(key, F.lit(bits)) + 1 if hashed else slot_of(F.col(key), bits)).alias("slot"))
    return slots.groupBy(*by, F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bitmap")
    )


def bit_test(bitmap: str) -> str:
    """SQL: whether the bitmap has the bit at position _at."""
    byte = f"conv(hex(substring({bitmap}, cast(_at div 8 as int) + 1, 1)), 16, 10)"
    return f"(shiftright(cast({byte} as int), cast(_at % 8 as int)) & 1) = 1"


def free(name: str, *tables: DataFrame) -> str:
    """name, with as many _ after it as make it no column of the tables."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def flagged(rows: DataFrame, key: str, filter_rows: DataFrame, bits: int, flag: str) -> DataFrame:
    """rows with a boolean column flag: whether the key tests true. The filter has a fixed size (see bit_filter), so it is broadcast."""
    whole = free("whole_row", rows)
    probed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(whole), slot_of(F.col(f"`{key}`"), bits).alias("_slot"))
    probed = probed.withColumns({"_bucket": F.expr("bitmap_bucket_number(_slot)"), "_at": F.expr("bitmap_bit_position(_slot)")})
    named = filter_rows.select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap"))
    test = F.coalesce(F.expr(bit_test("_bitmap")), F.lit(False))
    return probed.join(F.broadcast(named), "_bucket", "left").select(f"{whole}.*", test.alias(flag))


#: Bits of the filter of the keys that settled() looks at: 2 MB.
SETTLE_BITS = 1 << 24


def settled(rows: DataFrame, keys: list[str], attention: DataFrame) -> DataFrame:
    """rows without those whose keys are in attention (keys, stays) with stays false; of rows that share keys with stays true, one.

    rows must be a written table, as it is read twice. Keys compare null-safe. Rows whose keys are not in attention are told apart by a filter and
    not shuffled; only what may be in it is joined.
    """
    digest, maybe = free("digest", rows), free("maybe", rows)
    hashed = lambda t: F.xxhash64(*[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0")) for k in keys])
    slots = bit_filter(attention.select(hashed(attention).alias("digest")), "digest", SETTLE_BITS)
    told = flagged(rows.withColumn(digest, hashed(rows)), digest, slots, SETTLE_BITS, maybe)
    clear = told.filter(~F.col(maybe)).select(*[F.col(f"`{c}`") for c in rows.columns])
    unsure, other = told.filter(maybe).alias("x"), attention.select(*[F.col(f"`{k}`").alias(f"other {i}") for i, k in enumerate(keys)], F.col("stays").alias("other stays")).alias("y")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"x.`{k}`").eqNullSafe(F.col(f"y.`other {i}`"))
    # Keys that are not in attention after all are those of one row.
    left = unsure.join(other, same, "left").filter(F.coalesce(F.col("`other stays`"), F.lit(True))).select(*[F.col(f"x.`{c}`") for c in rows.columns])
    return clear.unionByName(left.dropDuplicates(keys))


def in_filter(rows: DataFrame, key: str, filter_rows: DataFrame, bits: int) -> DataFrame:
    """The rows whose key tests true."""
    return flagged(rows, key, filter_rows, bits, "_hit").filter("_hit").drop("_hit")


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text: the first half of its SHA-256, in which no two texts are known to agree."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


#: Bits of the filter of repeated texts: 2 MB.
COPY_BITS = 1 << 24


def repeated_texts(keyed: DataFrame) -> DataFrame:
    """(key, copies) of the texts that more than one row has; keyed has key."""
    return keyed.groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1")


def each_text_once(keyed: DataFrame, repeated: DataFrame) -> DataFrame:
    """(key, text) with a row for each different text. Only rows whose text may be repeated are shuffled, combined by map task first."""
    told = flagged(keyed.select("key", "text"), "key", bit_filter(repeated, "key", COPY_BITS), COPY_BITS, "maybe")
    some = told.filter("maybe").groupBy("key").agg(F.min("text").alias("text"))
    return told.filter("not maybe").select("key", "text").unionByName(some)


def filter_bytes(filter_rows: DataFrame, bits: int) -> bytes:
    """The filter as one string of bits / 8 bytes, for broadcasting to Python tasks; its size is fixed by bits."""
    whole = bytearray(bits // 8 + 2 * BUCKET_BITS // 8)
    for row in filter_rows.collect():
        at = (row["bucket"] - 1) * BUCKET_BITS // 8
        whole[at : at + len(row["bitmap"])] = row["bitmap"]
    return bytes(whole)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges: the smallest node that it can reach.

    Each round maps every node to the smallest of itself and its neighbours and the edges to the mapped ends; edges
    within one mapped node vanish. The smallest node of a component maps to itself, so it is the label that remains.
    A component takes as many rounds as the longest chain of ever smaller neighbours in it: one for a star, few for components of
    near-duplicates, but up to n for a chain of n in ascending order. Large and small stars in turn were tried instead, which take
    logarithmically many; their two joins and four aggregations a round cost more here. Every round is cut off by a written table. Hubs are pre-aggregated
    (minimum by map task), and the joins are plain equi-joins that adaptive execution splits when skewed.
    """
    named = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    now = saved(named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    assigned = None
    while not now.isEmpty():
        ends = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = ends.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up"))
        parent = saved(up, "parents")
        if assigned is None:
            assigned = parent.select("node", F.col("up").alias("component"))
        else:
            hop = parent.select(F.col("node").alias("component"), "up")
            assigned = saved(
                assigned.join(hop, "component", "left").select("node", F.coalesce("up", "component").alias("component")),
                "assigned",
            )
        left = now.join(parent.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
        both = left.join(parent.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b").filter("ua <> ub")
        now = saved(both.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
    if assigned is None:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return assigned
