"""Exact top-k search by inner product: columnar branch and bound over blocks of queries and candidates.

Vectors are quantised to whole numbers and packed, in vertical layout (one array per dimension), into blocks of bounded
size. Each pair of a query block and a candidate block is one group: partial scores grow dimension block by dimension
block; what the remaining dimensions can still add is at most the product of the remaining norms (Cauchy-Schwarz); a query's
candidates that can't reach its k-th best score so far are compacted away. Scores that survive are exact. The k best of
every block meet in one window over k rows for each block and query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a candidate block and of a query block, about.
CANDIDATES, QUERIES = 8192, 1024
#: Dimensions scored between two compactions.
STRIDE = 16
#: Candidates scored in full first, for a k-th best score to prune with.
SEEDS = 256


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component as a double; null for vectors that are null or hold null or non-finite components."""
    sound = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * 256.0).cast("double")))


def best_of_block(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best in the block. q and c hold a row for each dimension."""
    dims, n = c.shape
    order = np.argsort(-(c * c).sum(axis=0), kind="stable")
    c, cid = np.ascontiguousarray(c[:, order]), cid[order]
    cuts = list(range(0, dims, STRIDE)) + [dims]
    # Norms of what is left after each cut.
    left_c = [np.sqrt((c[s:] ** 2).sum(axis=0)) for s in cuts]
    left_q = [np.sqrt((q[s:] ** 2).sum(axis=0)) for s in cuts]
    first = q.T @ c[:, :SEEDS]
    own = qid[:, None] == cid[None, :SEEDS]
    first[own] = -np.inf
    kth = np.partition(first, -k, axis=1)[:, -k] if first.shape[1] >= k else np.full(len(qid), -np.inf)
    partial = q[cuts[0] : cuts[1]].T @ c[cuts[0] : cuts[1]]
    out = []
    for i in range(len(qid)):
        score, alive = partial[i], None
        for step in range(1, len(cuts) - 1):
            rest = left_c[step] if alive is None else left_c[step][alive]
            # A little slack for rounding of the norms; scores themselves are whole numbers.
            stay = np.flatnonzero(score + rest * left_q[step][i] * (1 + 1e-9) + 1e-6 >= kth[i])
            alive = stay if alive is None else alive[stay]
            low, high = cuts[step], cuts[step + 1]
            score = score[stay] + q[low:high, i] @ c[low:high, alive]
        ids = cid if alive is None else cid[alive]
        other = ids != qid[i]
        ids, score = ids[other], score[other]
        if len(score) > k:
            least = np.partition(score, -k)[-k]
            stay = score >= least
            ids, score = ids[stay], score[stay]
        top = np.lexsort((ids, -score))[:k]
        out.extend((int(qid[i]), int(ids[t]), int(score[t])) for t in top)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query holds for, the k rows with the highest scores.

    The score is the inner product of the vectors quantised to floor(256 x). Ties go to the smaller vec_id; a query's
    own vec_id is no candidate; where there are fewer candidates all are returned. Rows with a null identifier, and vectors
    that are null or hold null or non-finite components, take no part; an empty vector scores 0 with every other; vectors of different lengths are compared as if the
    shorter ended in zeros. Repeated rows are candidates each; queries that share a vec_id but not their vector are answered together, by their best scores. Scores are
    exact below 2 ** 52 (components beyond 2 ** 17 with 64 dimensions).
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("v"), is_query.alias("is_query")).filter("v is not null and vec_id is not null")
    counts = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    n_blocks, q_blocks = max(1, -(-counts["n"] // CANDIDATES)), max(1, -(-counts["q"] // QUERIES))
    hashed = F.xxhash64("vec_id", "v")
    # A stated query set against all rows in blocks: each block of one side meets each block of the other.
    cand = rows.select("vec_id", "v", F.pmod(hashed, F.lit(n_blocks)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    asked = rows.filter("is_query").dropDuplicates(["vec_id", "v"])
    asked = asked.select("vec_id", "v", F.pmod(hashed, F.lit(q_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("cb"))

    def packed(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = t.column("v").combine_chunks()
        lengths = v.value_lengths().to_numpy(zero_copy_only=False)
        flat, dims = v.flatten().to_numpy(zero_copy_only=False), int(lengths.max(initial=0))
        out = np.zeros((dims, len(lengths)))
        rows_at = np.repeat(np.arange(len(lengths)), lengths)
        out[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), rows_at] = flat
        return out, t.column("vec_id").to_numpy()

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            (q, qid), (c, cid) = packed(left), packed(right)
            dims = max(1, len(q), len(c))  # a block may hold empty vectors only
            q, c = (np.vstack((m, np.zeros((dims - len(m), m.shape[1])))) for m in (q, c))
            found = best_of_block(q, qid, c, cid, k)
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])

    blocks = asked.groupBy("qb", "cb").cogroup(cand.groupBy("qb", "cb"))
    best = blocks.applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, F.col("vec_id") % 50 == 0)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""
