"""SimHash near-duplicates: fingerprints, a grid join on segment popcounts, exact verification and components.

A fingerprint is cut into 32 segments of two bits. The counts of set bits per segment embed it in a space where the
Manhattan distance never exceeds the Hamming distance. A count of 0, 1 or 2 is stored in unary (00, 01, 11), so the
whole embedding is one long and the Manhattan distance of two of them is bit_count(x ^ y).

The segments form BLOCKS blocks. Within distance 4 at most four blocks differ, so two fingerprints that link agree on
all counts of at least BLOCKS - 4 blocks: the cells of the grid are those choices of blocks with their counts, and linked
fingerprints meet in one cell at least. Everything in a cell is tested by the Manhattan bound, then by the Hamming distance.

Dense cells, as of a text with thousands of near copies, would give links by the square of their size. So each member
is first linked to its cell's least and greatest member, components of these links are found, and the full join of the
cell then only returns links between different components. No link is lost and none is returned twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legilens.llm.shared import components, free, saved, settled

LIMIT = 4
#: Segments of each block; two of six blocks agree within distance 4.
BLOCKS = (6, 5, 5, 5, 5, 6)
AGREE = len(BLOCKS) - LIMIT
SEED = 42
#: Shingles hashed at once; bounds the memory of very long texts.
CHUNK = 1 << 16
EVEN = 0x5555555555555555


def fingerprint(text: str | None, width: int) -> int:
    """Majority vote of the shingles' XXH64 over 64 bits, as a signed integer; zero without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    w = min(width, len(words))
    first, last = starts[: len(words) - w + 1].tolist(), ends[w - 1 :].tolist()
    n, ones = len(first), np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        hashes = [digest(line[s:e], SEED) for s, e in zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = 4, fp_col: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of every row (all of docs, if not given) with fp_col; a null text counts as empty."""
    keep = docs.columns if keep is None else keep
    columns = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x, width) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], [*keep, fp_col])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(free("text", docs)))
    return rows.mapInArrow(run, T.StructType([*columns, T.StructField(fp_col, T.LongType())]))


def embedding(fp: Column) -> Column:
    """The counts of set bits per two-bit segment, in unary."""
    high = F.shiftrightunsigned(fp, 1)
    both, some = fp.bitwiseAND(high).bitwiseAND(F.lit(EVEN)), fp.bitwiseOR(high).bitwiseAND(F.lit(EVEN))
    return F.shiftleft(both, 1).bitwiseOR(some)


def masks() -> list[int]:
    """For each choice of AGREE blocks, the bits of the embedding that those blocks cover (as signed integers)."""
    cuts = np.cumsum((0, *BLOCKS))
    block = [sum(3 << (2 * s) for s in range(cuts[k], cuts[k + 1])) for k in range(len(BLOCKS))]
    out = [sum(block[k] for k in c) for c in combinations(range(len(BLOCKS)), AGREE)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def cells(nodes: DataFrame) -> DataFrame:
    """Each row of nodes (with fp) once for each choice of blocks: cell is that choice with its counts."""
    emb = nodes.withColumn("emb", embedding(F.col("fp")))
    keyed = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("emb").bitwiseAND(F.lit(m)).alias("counts")) for k, m in enumerate(masks())])
    return emb.withColumn("cell", F.explode(keyed)).select("*", "cell.choice", "cell.counts").drop("cell")


def near(x: str, y: str) -> Column:
    """Manhattan bound first, then the Hamming distance."""
    bound = F.expr(f"bit_count({x}.emb ^ {y}.emb) <= {LIMIT}")
    return bound & F.expr(f"bit_count({x}.fp ^ {y}.fp) <= {LIMIT}")


def link(fps: DataFrame) -> DataFrame:
    """(fp, component): the smallest fingerprint reachable over links, for every distinct fingerprint that has a link."""
    grid = saved(cells(fps.select("fp")), "cells")
    ends = grid.groupBy("choice", "counts").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high")
    stars = grid.join(ends, ["choice", "counts"]).select("fp", F.explode(F.array("low", "high")).alias("hub"))
    stars = stars.filter(F.expr(f"fp <> hub and bit_count(fp ^ hub) <= {LIMIT}"))
    first = components(stars, "fp", "hub")

    labelled = fps.select("fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("label"))
    grid = saved(cells(labelled), "cells")
    # A cell whose members already share one label has nothing left to find.
    mixed = grid.groupBy("choice", "counts").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l <> h").select("choice", "counts")
    left = saved(grid.join(mixed, ["choice", "counts"]), "mixed")
    x, y = left.alias("x"), left.alias("y")
    same = F.expr("x.choice = y.choice and x.counts = y.counts and x.label < y.label")
    rest = x.join(y, same & near("x", "y")).select(F.col("x.label").alias("a"), F.col("y.label").alias("b"))
    second = components(rest)
    merged = labelled.join(second.withColumnRenamed("node", "label"), "label", "left")
    return merged.select("fp", F.coalesce("component", "label").alias("component"))


def classes(prints: DataFrame) -> DataFrame:
    """(fp, component, n, least, component_id) of every distinct fingerprint of prints (doc_id, fp): its rows, their smallest doc_id, and that of its component."""
    fps = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fps")
    linked = saved(fps.join(link(fps), "fp"), "linked")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    return linked.join(least, "component")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest identifier reachable).

    Null and empty texts have the fingerprint zero and link like any other. Equal fingerprints are one node, so repeated rows
    and large groups of copies cost one node each. Null identifiers are ignored when a component's smallest is taken; where
    a component has no other, component_id is null. Empty input gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = saved(fingerprints(rows, width=width, keep=["doc_id"]), "prints")
    named = classes(prints).select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component one row, with all its columns: the one with the smallest doc_id.

    Where rows of a component share that doc_id, one of those with the smallest fingerprint stays; where a doc_id is that of texts in different
    components, each is judged on its own. A row with a null doc_id stays only if its whole component has none. Null texts
    count as empty. An empty table stays empty.
    """
    fp = free("fp", docs)
    tagged = saved(fingerprints(docs, fp_col=fp), "tagged")
    found = saved(classes(tagged.select("doc_id", F.col(fp).alias("fp"))), "classes")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("first"))
    told = found.filter("n > 1 or members > 1").join(first, "component").select("fp", F.col("first.fp").alias("first"), F.col("first.least").alias("least"))
    # The pairs of identifier and fingerprint that need a decision; only rows of such fingerprints are looked at.
    several = tagged.select("doc_id", F.col(fp).alias("fp")).join(told, "fp").groupBy("doc_id", F.col("fp").alias(fp)).agg(
        F.bool_or(F.expr("fp = first and doc_id <=> least")).alias("stays")
    )
    return settled(tagged, ["doc_id", fp], saved(several, "settled")).drop(fp)


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
