"""Vector code compression: product codes learned by a tree aggregation over columnar blocks of vectors.

Vectors become whole numbers and are cut into parts of equal width, and each part has a codebook of a few entries. Tasks pack their vectors into blocks with a
row for each dimension; these are written once. A round is one treeAggregate over the blocks: distances to all entries accumulate dimension by dimension, np.add.at
adds the parts to sums and counts of their nearest entries, and these tensors, of a size that only entries and dimensions set, merge through a tree
of tasks. The driver sees one tensor a round. A last pass over the rows themselves gives each its code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legilens.llm.shared import saved

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: Vectors of a block, about.
BLOCK = 4096
#: Components count as no more than this, up or down (65,536 before scaling): squares of differences then fit in 64 bits.
MOST = 1 << 28

#: Sums (part, entry, place in the part) and counts (part, entry) of what was assigned.
Tensors = tuple[np.ndarray, np.ndarray] | None


def whole_numbers(vector: Column) -> Column:
    """floor(SCALE x) of each component; null for vectors that are null or hold null or non-finite components."""
    sound = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x.cast("double") * float(SCALE)))).cast("long")
    return F.when(sound, F.transform(vector, scaled))


def columnar(vectors: pa.Array, dims: int) -> np.ndarray:
    """The vectors of an Arrow list column as the columns of a matrix, shorter ones ended in zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((dims, len(lengths)), np.int64)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), np.repeat(np.arange(len(lengths)), lengths)] = flat
    return out


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column of part (place, vector) the nearest row of book (entry, place), the lower one of ties, and the squared distance."""
    distance = np.zeros((len(book), part.shape[1]), np.int64)
    for place in range(len(part)):
        step = part[place][None, :] - book[:, place][:, None]
        step *= step
        distance += step
    code = distance.argmin(axis=0)
    return code, distance[code, np.arange(part.shape[1])]


def added(so_far: Tensors, block: np.ndarray, books: np.ndarray) -> Tensors:
    """The sums and counts with those of one more block; books is (part, entry, place)."""
    sums, counts = so_far or (np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64))
    for p, part in enumerate(block.reshape(len(books), -1, block.shape[1])):
        code, _ = nearest(part, books[p])
        np.add.at(sums[p], code, part.T)
        np.add.at(counts[p], code, 1)
    return sums, counts


def merged(x: Tensors, y: Tensors) -> Tensors:
    if x is None or y is None:
        return y if x is None else x
    return x[0] + y[0], x[1] + y[1]


def fitted(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after so many rounds. blocks has block, the bytes of a columnar matrix; an entry that nothing is assigned to stays."""
    dims = books.shape[0] * books.shape[2]
    columns = blocks.rdd.map(lambda row: np.frombuffer(row.block, np.int64).reshape(dims, -1))
    for _ in range(rounds):
        tensors = columns.treeAggregate(None, lambda so_far, block, now=books: added(so_far, block, now), merged)
        if tensors is None:
            break
        sums, counts = tensors
        books = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
    return books


def compressed(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each sound vector, and the codebooks (part, entry, place).

    Each part's codebook starts as that part of the vectors with the smallest identifiers (fewer entries where there are fewer vectors; of equal identifiers the smaller vector first, null
    identifiers last). Rows whose vector is null or holds null or non-finite components are dropped. Vectors of different lengths, or of one that the parts don't
    divide, are taken as if they ended in zeros up to the next length that they do; an empty vector is all zeros. Repeated rows count each, equal distances go to the lower entry, and an empty
    table gives no rows. Components beyond 65,536 count as that much; long vectors are taken whole.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), whole_numbers(F.col(f"`{vector_col}`")).alias("v")).filter("v is not null")
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    dims = parts * width
    first = [r.v + [0] * (dims - len(r.v)) for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]  # as many rows as a codebook has entries
    books = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                block = columnar(b.column(0).slice(at, BLOCK), dims)
                yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], ["block"])

    if dims and first:
        books = fitted(saved(rows.select("v").mapInArrow(pack, "block binary"), "blocks"), books, rounds)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = columnar(b.column(2), dims).reshape(parts, width, b.num_rows)
            found = [nearest(block[p], books[p]) for p in range(parts)]
            codes = np.array([code for code, _ in found], np.uint8).T if b.num_rows else np.zeros((0, parts), np.uint8)
            error = np.sum([distance for _, distance in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([row.tobytes().hex() for row in codes], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the error of all rows of the same label; rows without a label are together."""
    sums = coded.groupBy(F.col("label").alias("other")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["other"])).drop("other")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return with_label_error(saved(coded, "coded")).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    near = "arg_min(b.e, (list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e))"
    steps = []
    for k in range(ROUNDS):
        steps.append(f"""a{k} as materialized (select a.vec_id, a.p, any_value(a.x) as x, {near} as e from parts a join b{k} b using (p) group by a.vec_id, a.p),
m{k} as (select p, e, list(v order by i) as x from (select p, e, i, floor(sum(x[i]) / count(*))::bigint as v from (select p, e, x, unnest(range(1, len(x) + 1)) as i from a{k}) group by p, e, i) group by p, e),
b{k + 1} as materialized (select b.p, b.e, coalesce(m.x, b.x) as x from b{k} b left join m{k} m using (p, e))""")
    return f"""with v as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
parts as materialized (select vec_id, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] as x from (select vec_id, v, unnest(range({PARTS})) as p from v)),
b0 as materialized (select p, e, x from parts join (select vec_id, row_number() over (order by vec_id) - 1 as e from v qualify e < {ENTRIES}) using (vec_id)),
{", ".join(steps)},
d as (select a.vec_id, a.p, min((list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e)) as best from parts a join b{ROUNDS} b using (p) group by a.vec_id, a.p),
c as (select vec_id, string_agg(lower(printf('%02x', best[2]::bigint)), '' order by p) as code, sum(best[1])::bigint as error from d group by vec_id),
s as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from b{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from c join v using (vec_id), s"""


SQL = _sql()
