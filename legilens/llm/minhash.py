"""MinHash near-duplicates by min-max hashing: signatures in bands, hubs in each cell, exact verification and components.

Every permutation of the shingles gives two values of a signature, its least and its greatest hash, so a signature takes half as many hash evaluations as values; each
agrees between two sets with the probability of their similarity, and as the two of one permutation are negatively correlated, bands of both vary less. A band
is two permutations, four values. Two sets meet in a cell when a whole band agrees: at the least similarity that links, 48 permutations in 24 bands miss a
pair in 20 million.

A cell is never joined with itself. Its hub, the member that shares the most cells with others, is paired with the members of other
components; pairs that can't link by their sizes, by what they share with an earlier hub, or by their sketches, are left out, the rest are verified on the full sets of words, and components are merged. A sketch
has a bit for each of SKETCH values of a shingle's hash: whether an odd number of shingles have it. Two sketches differ in no more bits than the sets have shingles that are not common, so no link is lost, and
most pairs just under the threshold end there. Where the members left are still of
several components, they are dealt into finer cells, by shingles that two of them must share to link: such that the hub lacks, where a set has too few in common with it (finer).
Before that, each cell has HUBS hubs in place of one, which is all of most cells' members.
Finer cells take more hubs, many times more at each level, until all members are of one component or have been hubs: every pair of members has then been compared, or is of one component, or can't link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legilens.llm.shared import bit_filter, components, in_filter, saved, text_key

#: Words of a shingle, and the least similarity that links, in percent.
WORDS, SIMILAR = 3, 85
#: Permutations, and how many make a band; each gives two values.
PERMUTATIONS, IN_BAND = 48, 2
SEED = 42
#: Shingles that all permutations are evaluated for at once; bounds the memory of long texts.
CHUNK = 1024
#: Words that are numbered before numbering starts anew (three numbers then fit in 63 bits), and numbers that do.
NUMBERED, FITS = 1 << 20, 1 << 21
#: Bits of the filter of the texts that are verified: 2 MB.
TEXT_BITS = 1 << 24
#: Hubs of a cell when its first hub's component is known, and how many times more at each level of finer cells. Most of them cost no more than a look at sketches.
HUBS, MORE_HUBS = 128, 16
#: Bits of a sketch, as a power of two.
SKETCH = 10

_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, PERMUTATIONS + 8), np.uint64) * np.uint64(2) + np.uint64(1)
FIRST, SECOND = _ODD[0, :PERMUTATIONS, None], _ODD[1, :PERMUTATIONS, None]
MIX = _ODD[0, PERMUTATIONS:]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text between ASCII white space, letters A-Z as a-z."""
    return (text or "").encode("utf-8", "replace").lower().split()


class Numbers(dict):
    """Numbers of words from 1 in order of appearance, and a hash of each; 0 stands for no word."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros(1 << 12, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        if n == len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.zeros(n, np.uint64)))  # twice as many
        self.hashes[n] = xxhash.xxh64_intdigest(word, SEED)
        return n


def shingles(words: list[bytes], numbers: Numbers) -> np.ndarray:
    """The distinct shingles of a text as rows of three numbers of words. A text of fewer words is one shingle, filled up with zeros; one without words has none."""
    if not words:
        return np.zeros((0, WORDS), np.int64)
    n = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    if len(n) < WORDS:
        return np.concatenate((n, np.zeros(WORDS - len(n), np.int64)))[None, :]
    a, b, c = n[:-2], n[1:-1], n[2:]
    if len(numbers) < FITS:
        packed = np.unique(a << 42 | b << 21 | c)
        return np.stack((packed >> 42, packed >> 21 & FITS - 1, packed & FITS - 1), axis=1)
    return np.unique(np.stack((a, b, c), axis=1), axis=0)


def hashed(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A hash of each shingle."""
    x = np.zeros(len(found), np.uint64)
    for k in range(WORDS):
        x = (x ^ hashes[found[:, k]]) * MIX[k]
        x ^= x >> np.uint64(29)
    return x


def signature(x: np.ndarray) -> np.ndarray:
    """The least and the greatest value of the hashes x under each permutation, as (permutation, 2)."""
    out = np.empty((PERMUTATIONS, 2), np.uint64)
    out[:, 0], out[:, 1] = np.iinfo(np.uint64).max, 0
    for at in range(0, len(x), CHUNK):
        y = x[None, at : at + CHUNK] * FIRST
        y ^= y >> np.uint64(32)
        y *= SECOND
        np.minimum(out[:, 0], y.min(axis=1), out=out[:, 0])
        np.maximum(out[:, 1], y.max(axis=1), out=out[:, 1])
    return out


def cells(of: np.ndarray) -> np.ndarray:
    """A hash of each band of a signature and its place."""
    bands = of.reshape(-1, 2 * IN_BAND)
    x = np.arange(1, len(bands) + 1, dtype=np.uint64) * MIX[4]
    for k in range(bands.shape[1]):
        x = (x ^ bands[:, k]) * MIX[5]
        x ^= x >> np.uint64(31)
    return x.view(np.int64)


def sketch(x: np.ndarray) -> np.ndarray:
    """For each value of the upper SKETCH bits whether an odd number of the hashes x have it, as bits of 64-bit numbers."""
    odd = np.bincount((x >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prints(keyed: DataFrame) -> DataFrame:
    """(doc_id, key, n, cells, sketch) of rows (doc_id, key, text): the number of distinct shingles, and the cells and the sketch of the set (no cells of an empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for b in batches:
            sizes, found, sketches = [], [], []
            for text in b.column(2).to_pylist():
                if len(numbers) > NUMBERED:
                    numbers = Numbers()
                some = shingles(words_of(text), numbers)
                sizes.append(len(some))
                x = hashed(some, numbers.hashes)
                found.append(cells(signature(x)) if len(x) else [])
                sketches.append(sketch(x))
            lists = [pa.array(v, pa.list_(pa.int64())) for v in (found, sketches)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), *lists], ["doc_id", "key", "n", "cells", "sketch"])

    return keyed.select("doc_id", "key", "text").mapInArrow(run, f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, key binary, n bigint, cells array<bigint>, sketch array<bigint>")


Shingles = set[tuple[bytes, ...]]


def full(text: str) -> Shingles:
    """The set of a text with words, word by word."""
    words = words_of(text)
    return set(zip(words, words[1:], words[2:])) if len(words) >= WORDS else {tuple(words)}


def side_by_side(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, la, lb) of nodes with both texts; texts has node, text.

    The text of b goes to where a's is: a hub's text is sent once, and not once for each of its partners; what many partners share is split by adaptive execution.
    """
    other = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    own = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(other, "b").join(own, "a").select("a", "b", "la", "lb", "text_a", "text_b")


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[Shingles, Shingles]]]]:
    """Each batch of side_by_side with the sets of its pairs; a's is made once for pairs that follow each other."""
    last: tuple = (None, set())

    def sets(b: pa.RecordBatch) -> Iterator[tuple[Shingles, Shingles]]:
        nonlocal last
        for node, x, y in zip(b.column(0).to_pylist(), b.column(4), b.column(5), strict=True):
            if node != last[0]:
                last = node, full(x.as_py())
            yield last[1], full(y.as_py())

    for b in batches:
        yield b, sets(b)


def verified(pairs: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b, la, lb) whose full sets are similar in so many percent, as (la, lb)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in sets_of(batches):
            linked = [100 * (common := len(x & y)) >= similar * (len(x) + len(y) - common) for x, y in sets]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3)], ["la", "lb"]).filter(pa.array(linked, pa.bool_()))

    return side_by_side(pairs, texts).mapInArrow(run, "la bigint, lb bigint")


def finer(pairs: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    """(cell, node, c): the finer cells of the nodes b by their hubs a, where lb is the size of the smallest set with this hub.

    Of a set's n shingles, c are the hub's. A set that links with it has at least so many of them as makes the two similar when it is as small as may be (common). If that is more than
    c, they share shingles that the hub lacks; so two such sets meet in a cell of one of these, and of its n - c the first n - common + 1 are enough. Sets with c of at least
    common have all that the hub lacks in such cells, and meet each other in cells of a second kind: of their first n - common + 1 shingles, what the hub lacks before what it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in sets_of(batches):
            found, shared = [], []
            for hub, least, (x, y) in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), sets, strict=True):
                n, lacking = len(y), y - x
                smallest = max(least, -(-similar * n // 100))
                common = -(-similar * (n + smallest) // (100 + similar))
                first, key = n - common + 1, hub.to_bytes(8, "little")
                number = lambda some, key=key: sorted(xxhash.xxh64_intdigest(b" ".join(z) + key, SEED) for z in some)
                order = number(lacking)
                shared.append(n - len(lacking))
                if shared[-1] < common:
                    found.append(order[:first])
                else:
                    second = (order if len(order) >= first else order + number(y & x))[:first]
                    found.append(order + [z ^ 1 << 63 for z in second])
            cells = pa.array([np.array(f, np.uint64).view(np.int64) for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(shared, pa.int64()), cells], ["node", "c", "cells"])

    dealt = side_by_side(pairs, texts).mapInArrow(run, "node bigint, c bigint, cells array<bigint>")
    return dealt.select(F.explode("cells").alias("cell"), "node", "c")


def mixed(members: DataFrame) -> DataFrame:
    """The members (cell, node, label, ...) of cells with several labels, with the size of their cell."""
    some = members.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).filter("low < high").select("cell", "size")
    return members.join(some, "cell")


def link(nodes: DataFrame, texts: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(node, label) of the nodes (node, key, n, cells, sketch) that share a cell with another; nodes of one component have one label. texts has key, text."""
    every = nodes.select("node", "n", F.explode("cells").alias("cell"))
    shared = every.groupBy("cell").agg(F.count("*").alias("size")).filter("size > 1")
    grid = saved(every.join(shared, "cell"), "grid")
    known = saved(grid.groupBy("node").agg(F.max("n").alias("n"), F.sum("size").alias("met")).join(nodes.select("node", "sketch"), "node").withColumn("label", F.col("node")), "known")
    wanted = nodes.join(known.select("node"), "node").select("key", "node")
    wanted = saved(in_filter(texts, "key", bit_filter(wanted, "key", TEXT_BITS), TEXT_BITS).join(wanted, "key").dropDuplicates(["node"]).select("node", "text"), "texts")
    differ = " + ".join(f"bit_count(sketch[{k}] ^ hub.sketch[{k}])" for k in range((1 << SKETCH) // 64))
    members, compared, hubs_of_cell = grid.select("cell", "node", F.col("n").alias("c")), None, 1
    while True:
        live = saved(mixed(members.join(known, "node")), "live")
        if live.isEmpty():
            break
        slot = F.when(F.col("size") <= hubs_of_cell, F.col("node")).otherwise(F.pmod("node", F.lit(hubs_of_cell)))
        hubs = live.groupBy("cell", slot.alias("k")).agg(F.max(F.struct("met", "node", "n", "label", "c", "sketch")).alias("hub"))
        hubs = saved(hubs.select("cell", "hub"), "hubs")
        # Two sets share at most the lesser of what they have of the hub that made their cell, and the lesser of the rest.
        possible = f"label <> hub.label and {100 + similar} * (least(c, hub.c) + least(n - c, hub.n - hub.c)) >= {similar} * (n + hub.n)"
        possible = F.expr(f"{possible} and {100 + similar} * ({differ}) <= {100 - similar} * (n + hub.n)")
        ends = [F.struct("met", "node", "label"), F.struct("hub.met", "hub.node", "hub.label")]
        pairs = live.join(hubs, "cell").filter(possible).select(F.greatest(*ends).alias("x"), F.least(*ends).alias("y"))
        pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb")).distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")
        now = pairs.select("a", "b")
        compared = now if compared is None else compared.unionByName(now)
        merged = components(verified(pairs, wanted, similar), "la", "lb").select(F.col("node").alias("label"), "component")
        known = saved(known.join(merged, "label", "left").select("node", "n", "met", "sketch", F.coalesce("component", "label").alias("label")), "known")
        left = live.select("cell", "node").join(hubs.select("cell", F.col("hub.node").alias("node")), ["cell", "node"], "left_anti")
        first = hubs.groupBy("cell").agg(F.max("hub").alias("hub"))
        several = mixed(left.join(known.select("node", "n", "label"), "node")).join(first, "cell")
        if hubs_of_cell > 1:  # few cells are left when the first hubs' components are known, so these have further hubs before finer ones are made
            by_hub = saved(several.select(F.col("hub.node").alias("a"), F.col("node").alias("b"), "n").distinct(), "by_hub")
            if by_hub.isEmpty():
                break
            least = by_hub.groupBy("a").agg(F.min("n").alias("lb"))
            members = saved(finer(by_hub.join(least, "a").select("a", "b", F.col("n").alias("la"), "lb"), wanted, similar), "members")
        hubs_of_cell = hubs_of_cell * MORE_HUBS if hubs_of_cell > 1 else HUBS
    return known.select("node", "label")


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest identifier reachable over links), kept (whether that is the row's own).

    Texts without words, null ones too, have no shingles and are linked with nothing, not even with each other. Rows with one text are one node of the search, so repeated rows and groups of copies cost one
    node each. Null identifiers are ignored when a component's smallest is taken; where a component has no other, or a text has no words, component_id is null and kept true. Texts of
    any length are taken whole. An empty table gives no rows; other columns are ignored.
    """
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    told = saved(prints(keyed), "prints")
    once = told.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("cells").alias("cells"), F.first("sketch").alias("sketch"))
    nodes = saved(once.withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = link(nodes.select("node", "key", "n", "cells", "sketch"), keyed.select("key", "text"), similar)
    named = nodes.select("node", "key", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = saved(named, "named")
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_key = named.join(smallest, "label").select("key", "component_id")
    out = told.join(by_key, "key", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def op11_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return minhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs of different sets that share a shingle are counted here, without signatures.
SQL = rf"""
with recursive w as materialized (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as materialized (
  select doc_id, case when len(w) = 0 then [] when len(w) < {WORDS} then [array_to_string(w, ' ')]
    else list_sort(list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')))) end as s from w
), k as materialized (
  select doc_id, len(s) as n, case when len(s) > 0 then sha256(array_to_string(s, chr(10))) end as key, s from s
), d as materialized (
  select key, min(doc_id) as least, any_value(n) as n, any_value(s) as s from k where n > 0 group by key
), t as materialized (
  select least as id, n, unnest(s) as x from d
), e as materialized (
  select a.id as a, b.id as b from t a join t b on a.x = b.x and a.id <> b.id and 100 * least(a.n, b.n) >= {SIMILAR} * greatest(a.n, b.n)
  group by a.id, b.id having 100 * count(*) >= {SIMILAR} * (any_value(a.n) + any_value(b.n) - count(*))
), r as (
  select id as a, id as b from (select least as id from d) union select r.a, e.b from r join e on r.b = e.a
), c as (
  select a, min(b) as component_id from r group by a
)
select doc_id, k.n::bigint as n_shingles, case when k.n > 0 then component_id else doc_id end as component_id, (case when k.n > 0 then component_id else doc_id end) is not distinct from doc_id as kept
from k left join d using (key) left join c on c.a = d.least
"""
