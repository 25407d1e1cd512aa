"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Up to here every partial sum of a product is an exact float64, or an exact long.
EXACT, LONGEST = float(2**53), float(2**62)
#: Bytes of a tile's vectors, and scores that a task holds at once.
TILE_BYTES, SCORES = 32 << 20, 4 << 20


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as an int64 matrix; shorter rows are padded with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def tile_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of two integer matrices, exact: BLAS while float64 is, int64 beyond."""
    width = max(q.shape[1], v.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))
    bound = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * width
    if bound < EXACT:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if bound >= LONGEST:
        raise OverflowError("inner products of these vectors may not fit into a long")
    return q @ v.T


def best_of_tile(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> list[tuple[int, list[dict]]]:
    """Per query the k best of one tile (own row left out), ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    block, out = max(1, SCORES // max(1, len(ids))), []
    for at in range(0, len(q_ids), block):
        scores = tile_scores(q[at : at + block], v)
        for own, row in zip(q_ids[at : at + block], scores, strict=True):
            mine = np.flatnonzero(ids != own)
            if len(mine) > k:
                s = row[mine]
                least = np.partition(s, len(s) - k)[len(s) - k]
                mine = np.concatenate([mine[s > least], mine[s == least][:k]])
            mine = mine[np.lexsort((ids[mine], -row[mine]))][:k]
            if len(mine):
                out.append((int(own), [{"neg": -int(row[j]), "vec_id": int(ids[j])} for j in mine]))
    merged: dict[int, list[dict]] = {}
    for own, best in out:  # rows that repeat a query's id share one list
        merged[own] = sorted([*merged[own], *best], key=lambda t: (t["neg"], t["vec_id"]))[:k] if own in merged else best
    return list(merged.items())


def top_k(vectors: DataFrame, k: int = 5, query_mod: int = 50, scale: float = 256.0, tile: int | None = None, query_tile: int | None = None, fan_in: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query row (id divisible by ``query_mod``) over all other rows.

    Components x count as floor(scale * x). Rows with a null id, a null vector or null or non-finite
    components take no part. Shorter vectors are padded with 0. Rows that repeat an id are candidates each; as
    queries of one id they share one list; rows of the query's own id are no candidates of it. A query without
    candidates has no rows; an empty table gives none. Ties go to the smaller id, rows equal in id and score can't
    be told apart. Raises OverflowError where a score may not fit into a long. Returns query_id, rank (from 1), vec_id, score.

    Both sides are dealt into tiles by a hash of the whole row, so that no tile depends on how values or ids are
    spread; each task multiplies one query tile with one shard and keeps k rows a query; lists merge ``fan_in``
    at a time. Tiles hold TILE_BYTES of vectors, fewer where there would be less tasks than cores.
    """
    x = F.col("v")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, finite))
        .select("vec_id", F.transform(x, lambda e: F.floor(e * F.lit(scale))).alias("v"))
    )
    rows = materialise(rows.withColumn("m", F.monotonically_increasing_id()), "vectors")
    n, nq, width = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % query_mod == 0), F.max(F.size("v"))).first()
    fit = max(1, TILE_BYTES // (8 * max(1, width or 1)))
    groups = max(1, math.ceil(nq / (query_tile or fit)))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(n / tile) if tile else max(math.ceil(n / fit), min(math.ceil(cores / groups), math.ceil(n / 1024))))
    shard, group = F.pmod(F.xxhash64("vec_id", "m"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("vec_id", "m", F.lit(1)), F.lit(groups)).cast("int")
    left = rows.where(F.col("vec_id") % query_mod == 0).select(group.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), shard.alias("s"), F.col("vec_id").alias("cand_id"), F.col("v").alias("c"))

    def product(key, q: pa.Table, v: pa.Table) -> pa.Table:
        found = []
        if q.num_rows and v.num_rows:
            found = best_of_tile(q["query_id"].to_numpy(), matrix(q["q"]), v["cand_id"].to_numpy(), matrix(v["c"]), k)
        top = pa.list_(pa.struct([("neg", pa.int64()), ("vec_id", pa.int64())]))
        return pa.table({"query_id": pa.array([a for a, _ in found], pa.int64()), "s": pa.array([key[1].as_py()] * len(found), pa.int32()), "top": pa.array([b for _, b in found], top)})

    tops = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(product, "query_id long, s int, top array<struct<neg:long,vec_id:long>>")
    while True:
        shards = math.ceil(shards / fan_in)
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
        tops = tops.groupBy("query_id", F.floor(F.col("s") / fan_in).cast("int").alias("s")).agg(merged)
        if shards <= 1:
            break
    return tops.select("query_id", F.posexplode("top").alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.neg")).alias("score"))
