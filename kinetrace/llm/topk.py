"""Exact top-k search by a three-phase uniform threshold.

Vectors are cut into blocks of dimensions; the score of a row is the sum of its partial inner products over the blocks.
Each block at each site (a packed batch of rows) is a local score list.

1. Each site names the k best entries of each list for each query, and only rows so named are summed. The k-th largest of
   these sums over all sites is a safe cutoff: the k-th best score is no smaller.
2. The cutoff goes to all sites with the queries. A row that reaches it has, in some list, at least cutoff / blocks. List
   by list a row drops out once what it has plus the most that the lists left can add (the product of both norms there)
   is below the cutoff; later lists are computed for rows that are still in, densely only where these are many.
3. The rows that are left after the last list have their whole score, and the k best of each site are merged.

Queries and sites meet in blocks: query blocks of bounded size are dealt to every group of sites; a site is smaller, and
groups are more, where rows are few, so that all cores have work. Nothing is collected;
no side is broadcast by Spark. Arithmetic is in doubles on integers, exact below 2**53. Ties go to the smaller id.
Null vectors, vectors with null or non-finite components and rows without an id take no part; vectors of different
lengths do not meet. Extra columns of any name are not read. A query row is left out of its own result (by id); repeated rows are rows of their own, and a query
id that comes repeatedly shares one result. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import batch, stored

#: Most rows of a site, queries of a block, and sites of a group; least rows of a site.
SITE, ASKED, GROUP, LEAST = 8192, 512, 8, 512
#: Share of rows still in below which a list is computed for them alone, and pairs gathered at once.
SPARSE, GATHER = 0.1, 1 << 16


def whole(vectors: DataFrame, scale: int = 256, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, x): each component turned into floor(scale * x), with x as double; rows that can't take part are left out."""
    x = vectors[column]
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    usable = x.isNotNull() & (F.size(x) > 0) & fine & vectors[id_column].isNotNull()
    return vectors.where(usable).select(vectors[id_column].cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("x"))


def packed(rows: DataFrame, size: int, groups: int) -> DataFrame:
    """(part, dims, ids, data): sites or query blocks of up to size rows of one length, as bytes."""
    out = pa.schema([("part", pa.int64()), ("dims", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])

    def run(batches):
        for rb in batches:
            ids, x = rb.column(0).to_numpy(), rb.column(1)
            lengths = np.diff(x.offsets.to_numpy())
            flat, starts = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()[:-1]
            for dims in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dims)
                for i in range(0, len(own), size):
                    part = own[i : i + size]
                    data = flat[starts[part][:, None] + np.arange(dims)]
                    yield batch(out, [int(ids[part].sum() % groups)], [dims], [ids[part].astype("<i8").tobytes()], [data.astype("<f8").tobytes()])

    return rows.mapInArrow(run, "part long, dims int, ids binary, data binary")


def _open(ids: bytes, data: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype="<i8"), np.frombuffer(data, dtype="<f8").reshape(-1, dims)


def _cuts(dims: int, blocks: int) -> list[slice]:
    edges = [dims * b // blocks for b in range(blocks + 1)]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of k largest scores in each row."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]


def _sums(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (q[i], x[j])."""
    out = np.empty(len(i))
    for a in range(0, len(i), GATHER):
        out[a : a + GATHER] = np.einsum("nd,nd->n", q[i[a : a + GATHER]], x[j[a : a + GATHER]])
    return out


def survivors(q: np.ndarray, x: np.ndarray, cutoff: np.ndarray, own: np.ndarray, cuts: list[slice]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs (i, j) that may reach the cutoff of q[i], their scores, and how many list entries were computed."""
    norms = [(np.linalg.norm(q[:, c], axis=1), np.linalg.norm(x[:, c], axis=1)) for c in cuts]
    floor = cutoff - 1e-6 * np.maximum(1, np.abs(cutoff))
    free, share = ~np.isfinite(cutoff), floor / len(cuts)
    i, j = np.nonzero(~own)
    score, high, computed = np.zeros(len(i)), np.zeros(len(i), dtype=bool), 0
    for at, c in enumerate(cuts):
        if len(i) > SPARSE * own.size:
            s, computed = (q[:, c] @ x[:, c].T)[i, j], computed + own.size
        else:
            s, computed = _sums(q[:, c], x[:, c], i, j), computed + len(i)
        score, high = score + s, high | (s >= share[i])
        bound = score.copy()
        for n, m in norms[at + 1 :]:
            # A row with no list at its share so far needs one among those left, or it is out.
            bound += n[i] * m[j] * (1 + 1e-9)
        reach = high.copy()
        for n, m in norms[at + 1 :]:
            reach |= n[i] * m[j] * (1 + 1e-9) >= share[i]
        keep = free[i] | ((bound >= floor[i]) & reach)
        i, j, score, high = i[keep], j[keep], score[keep], high[keep]
    return i, j, score, computed


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """found (query_id, id, score) with rank, the k best of each query; a partial limit runs before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, blocks: int = 4) -> DataFrame:
    """(query_id, rank, id, score) of the k rows (id, x) with the largest inner product for each query (id, x)."""
    cores, n = rows.sparkSession.sparkContext.defaultParallelism, rows.count()
    size = min(SITE, max(LEAST, -(-n // (2 * cores))))
    tasks = groups = max(1, min(-(-n // size), max(2 * cores, -(-n // (SITE * GROUP)))))
    sites = stored(packed(rows, size, groups), "sites").withColumnRenamed("part", "g")
    queries = queries.groupBy("id").agg(F.first("x").alias("x"))
    found = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    columns = "ids, data, dims, q_ids, q_data".split(", ")

    def meet(asked: DataFrame) -> DataFrame:
        """Every site with every query block."""
        dealt = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), "dims", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
        # A number of partitions that is asked for is not coalesced: the tables are small, the work on them is not.
        both = (side.repartition(tasks, "g", "dims") for side in (sites, dealt))
        return next(both).join(next(both).hint("merge"), ["g", "dims"]).select(*columns)

    def pairs(batches, extra):
        for rb in batches:
            for r in rb.to_pylist():
                ids, x = _open(r["ids"], r["data"], r["dims"])
                q_ids, q = _open(r["q_ids"], r["q_data"], r["dims"] + extra)
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                yield q_ids, q, ids, x, q_ids[:, None] == ids[None, :], _cuts(r["dims"], blocks)

    def name(batches):
        for q_ids, q, ids, x, own, cuts in pairs(batches, 0):
            named = []
            for cut in cuts:
                s = q[:, cut] @ x[:, cut].T
                s[own] = -np.inf
                named.append(_best(s, k))
            named = np.sort(np.concatenate(named, axis=1), axis=1)
            total = _sums(q, x, np.repeat(np.arange(len(q)), named.shape[1]), named.ravel()).reshape(named.shape)
            again = np.c_[np.zeros(len(q), dtype=bool), named[:, 1:] == named[:, :-1]]
            total[again | np.take_along_axis(own, named, axis=1)] = -np.inf
            best = _best(total, k)
            score = np.take_along_axis(total, best, axis=1)
            keep = np.isfinite(score)
            yield batch(found, pa.array(np.repeat(q_ids, keep.sum(axis=1))), pa.array(ids[np.take_along_axis(named, best, axis=1)][keep]), pa.array(score[keep]))

    def resolve(batches):
        for q_ids, q, ids, x, own, cuts in pairs(batches, 1):
            i, j, score, _ = survivors(q[:, :-1], x, q[:, -1], own, cuts)
            order = np.lexsort((j, -score, i))  # rows of a site are in the order of their ids
            i, j, score = i[order], j[order], score[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
            keep = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
            yield batch(found, pa.array(q_ids[i[keep]]), pa.array(ids[j[keep]]), pa.array(score[keep]))

    kind = "query_id long, id long, score double"
    named = _ranked(meet(stored(packed(queries, ASKED, 1), "asked")).mapInArrow(name, kind), k)
    cutoffs = named.where(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff"))
    # With fewer than k rows named in all there is no cutoff: every row is resolved.
    bounded = queries.join(cutoffs, F.col("id") == F.col("query_id"), "left").select("id", F.concat("x", F.array(F.coalesce("cutoff", F.lit(float("-inf"))))).alias("x"))
    asked = stored(packed(bounded, ASKED, 1).withColumn("dims", F.col("dims") - 1), "cutoffs")
    best = _ranked(meet(asked).mapInArrow(resolve, kind), k)
    return best.select("query_id", F.col("rank").cast("int"), "id", F.col("score").cast("long"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.where("id % 50 = 0")).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND vec_id IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
