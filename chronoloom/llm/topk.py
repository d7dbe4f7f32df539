"""Exact top-k inner products by columnar branch-and-bound."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytekernel as bk
from .storage import written

SCALE = 256
DIM_BLOCK = 8
#: Bytes of the query vectors of one pass over the candidates (kept on the driver and broadcast).
QUERY_BYTES = 32 << 20
#: Queries and candidates that are multiplied at once.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 2048
_RESULT = "query int, vec_id long, score long"
_EXACT = float(1 << 52)

Best = list[tuple[int, int]]  # (minus score, id), best first


def quantised(column: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) per component as doubles (whole numbers); null unless every component is finite."""
    doubles = F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(column.isNotNull() & (F.size(column) > 0) & sound, doubles)


def block_top_k(queries: np.ndarray, cands: np.ndarray, cand_ids: np.ndarray, k: int, best: list[Best], dim_block: int = DIM_BLOCK) -> None:
    """Merge the k best (score descending, id ascending) of one candidate block into each query's ``best``.

    ``cands`` is vertical: one row per dimension. Scores grow by ``dim_block`` dimensions at a time.
    After each block, the rest of a score lies within plus or minus the product of the norms of the
    remaining parts (Cauchy-Schwarz); candidates whose upper bound is below the k-th largest lower
    bound, or below the k-th best of the blocks before, are dropped and the surviving columns are
    compacted.
    """
    dims, n = cands.shape
    cuts = list(range(0, dims, dim_block))
    # norms of what remains from each cut on
    rest_c = [np.sqrt((cands[c:] ** 2).sum(axis=0)) for c in [*cuts[1:], dims]]
    rest_q = [np.sqrt((queries[:, c:] ** 2).sum(axis=1)) for c in [*cuts[1:], dims]]
    first = queries[:, :dim_block] @ cands[:dim_block]
    for i, mine in enumerate(best):
        alive, score = np.arange(n), first[i]
        known = -mine[-1][0] if len(mine) == k else -math.inf
        for step, cut in enumerate(cuts):
            if step:
                score = score + queries[i, cut : cut + dim_block] @ cands[cut : cut + dim_block][:, alive]
            slack = rest_c[step][alive] * rest_q[step][i]
            slack += 1e-9 * slack + 1e-6
            floor = known
            if len(alive) > k:
                floor = max(floor, np.partition(score - slack, len(alive) - k)[len(alive) - k])
            keep = score + slack >= floor
            alive, score = alive[keep], score[keep]
            if not len(alive):
                break
        order = np.lexsort((cand_ids[alive], -score))[:k]
        mine += [(-int(score[b]), int(cand_ids[alive[b]])) for b in order]
        mine.sort()
        del mine[k:]


def _clamped(x: int) -> int:
    return max(min(x, (1 << 63) - 1), -(1 << 63))


def _plain_top_k(queries: np.ndarray, cands: np.ndarray, cand_ids: np.ndarray, k: int, best: list[Best]) -> None:
    """As block_top_k, in whole numbers of any size, for components too large for doubles."""
    whole = [[int(x) for x in v] for v in cands.T]
    for q, mine in zip(queries, best, strict=True):
        q = [int(x) for x in q]
        mine += [(-_clamped(sum(a * b for a, b in zip(q, v, strict=True))), int(c)) for v, c in zip(whole, cand_ids, strict=True)]
        mine.sort()
        del mine[k:]


def _search(vectors: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """The k best per query and partition of ``vectors(id, v)``; queries: their numbers and vectors by
    number of dimensions."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[Best]] = {d: [[] for _ in number] for d, (number, _) in shared.value.items()}
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, ids = lists.flatten().to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for dims in np.unique(sizes).tolist():
                if dims not in best:
                    continue
                rows, asked = np.flatnonzero(sizes == dims), shared.value[dims][1]
                for a in range(0, len(rows), CANDIDATE_BLOCK):
                    part = rows[a : a + CANDIDATE_BLOCK]
                    cands = np.ascontiguousarray(flat[(ends[part] - dims)[:, None] + np.arange(dims)].T)
                    for x in range(0, len(asked), QUERY_BLOCK):
                        q = asked[x : x + QUERY_BLOCK]
                        big = np.abs(q).max(initial=0) * np.abs(cands).max(initial=0) * max(dims, 1) >= _EXACT
                        (_plain_top_k if big else block_top_k)(q, cands, ids[part], k, best[dims][x : x + QUERY_BLOCK])
        for dims, found in best.items():
            rows_out = [(int(n), c, -s) for n, mine in zip(shared.value[dims][0], found, strict=True) for s, c in mine]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows_out], pa.int32())] + [pa.array([r[j] for r in rows_out], pa.int64()) for j in (1, 2)], names=["query", "vec_id", "score"])
        bk.release_memory()

    return vectors.mapInArrow(run, _RESULT)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row with ``is_query`` the k other rows of largest
    integer inner product of the quantised vectors; ties go to the smaller id.

    Rows take no part if the id is null, or the vector is null, empty, or has a null, NaN or infinite
    component. Only vectors of the same number of dimensions are compared; scores beyond 64 bits are
    cut to them. Rows that repeat an id, or all of a row, are rows of their own: each is a candidate
    for the others and asks for itself, so a query_id that repeats has its ranks as often. Fewer
    than k other rows give fewer ranks. Other columns may have any names.

    The queries, a set that the caller states, are taken in passes of ``query_bytes`` of vectors. A
    pass goes over all rows once; its tasks keep k + 1 rows per query, the query's own among them, and
    drop candidates by the best that they have seen. A pass among several writes its results, so
    neither the plan nor the driver's memory grows with the number of passes.
    """
    spark = vectors.sparkSession
    sound = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("q")).where("id is not null and v is not null")
    asked = sound.where("q").groupBy("id", "v").agg(F.count("*").alias("m"))
    size = asked.agg(F.sum(F.size("v").cast("long") * 8 + 32)).first()[0] or 0
    passes = max(1, math.ceil(size / query_bytes))
    ranked = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("vec_id")))), 1, k + 1)
    own = F.array_position("best", F.struct((-F.col("self")).alias("s"), F.col("query_id").alias("vec_id"))).cast("int")
    others = F.when(own > 0, F.concat(F.slice("best", 1, own - 1), F.slice("best", own + 1, k + 1))).otherwise(F.col("best"))
    out = None
    for p in range(passes):
        rows = sorted(asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(passes)) == p).collect(), key=lambda r: (r["id"], r["v"]))
        block: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in {len(r["v"]) for r in rows}:
            mine = [i for i, r in enumerate(rows) if len(r["v"]) == d]
            block[d] = np.array(mine, dtype=np.int32), np.array([rows[i]["v"] for i in mine])
        facts = [(i, r["id"], r["m"], _clamped(sum(int(x) * int(x) for x in r["v"]))) for i, r in enumerate(rows)]
        asking = spark.createDataFrame(facts, "query int, query_id long, m long, self long")
        best = _search(sound.select("id", "v"), block, k + 1).groupBy("query").agg(ranked.alias("best")).join(F.broadcast(asking), "query")
        part = best.select("query_id", "m", F.slice(others, 1, k).alias("best"))
        part = written(part, "top-k") if passes > 1 else part
        out = part if out is None else out.unionByName(part)
    # a query that occurs m times has its ranks m times
    out = out.select("query_id", F.explode(F.array_repeat("best", F.col("m").cast("int"))).alias("best")).select("query_id", F.posexplode("best").alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast(T.IntegerType()).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
