"""Exact top-k inner products over vectors in order of length.

Vectors are dealt into shards by descending length.  Every block of queries first
meets the shard of the longest vectors, which gives each query a k-th best score.
A query then goes on to the shards whose longest vector times its own length
reaches that score, which are the first so many; queries that reach alike share a
block, and a shard is sent only to blocks that reach it.  Within a shard candidates
are taken in order of length.  Products are summed over the axes of an SVD rotation,
leading ones first and a few at a time; what the remaining axes could add at most
(Cauchy-Schwarz) decides after each step which pairs are still open, and only these
get the inner product of whole numbers that is their score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import by_group, cut

#: Vectors in a shard and queries in a block; a task holds one of each.
SHARD, ASKED = 8192, 2048
#: Candidates that a block meets at once: the first ones, to have scores to compare with, and then at most.
FEW, MANY = 64, 1024
#: Steps in which the axes are summed, and share of open pairs below which these are finished one by one.
STEPS, OPEN = 8, 0.1
#: Above this a product of floats may not be whole; such vectors are multiplied as integers.
SAFE = 1 << 52
#: A score below any.
LEAST = -(1 << 62)


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, dim, v, norm): floor(scale * x) as longs; unusable vectors are left out."""
    x = F.col("x")
    usable = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("x")).where(usable & F.col("vec_id").isNotNull())
    v = F.transform("x", lambda c: F.floor(c * scale).cast("long"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    return rows.select("vec_id", F.size("x").alias("dim"), v.alias("v")).withColumn("norm", norm)


def rotation(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the axes of its vectors by descending singular value: dim * dim numbers."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                m = np.array(batch.column("v").filter(pa.array(dims == d)).to_pylist(), float)
                total[d] = total.get(d, 0) + m.T @ m
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d, dtype=np.int32)), pa.array(m.ravel())], ["dim", "cell", "x"])

    cells = vectors.select("dim", "v").mapInArrow(gram, "dim int, cell int, x double").groupBy("dim", "cell").agg(F.sum("x").alias("x"))
    sums: dict[int, np.ndarray] = {}
    for r in cells.toLocalIterator():
        sums.setdefault(r["dim"], np.zeros(r["dim"] ** 2))[r["cell"]] = r["x"]
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1] for d, m in sums.items()}


class Work:
    """What a search did: pairs it was given, products of single axes it summed, pairs it multiplied exactly."""

    def __init__(self):
        self.pairs = self.axes = self.exact = 0


def _products(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, safe: bool, work: Work) -> np.ndarray:
    """Whole inner products of pairs; all of them at once where most are wanted."""
    if len(i) > OPEN * len(q) * len(c) and safe:
        work.exact += len(q) * len(c)
        return (q.astype(float) @ c.astype(float).T)[i, j].astype(np.int64)
    work.exact += len(i)
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 1 << 16):
        part = slice(s, s + (1 << 16))
        out[part] = np.einsum("pd,pd->p", q[i[part]], c[j[part]])
    return out


def best(queries: tuple, candidates: tuple, axes: np.ndarray, k: int, work: Work | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, score) of what can be among a query's k best.

    queries: ids, vectors, lengths, least score that still counts; candidates: ids, vectors, lengths.
    """
    work = work or Work()
    qid, q, qn, floor = queries
    cid, c, cn = candidates
    order = np.lexsort((cid, -cn))
    cid, c, cn = cid[order], c[order], cn[order]
    work.pairs += len(q) * len(c)
    longest = float(qn.max()) * float(cn.max())
    safe, slack = longest < SAFE, 1e-6 * (1 + longest)
    qr, cr = q.astype(float) @ axes, c.astype(float) @ axes
    cuts = np.unique(np.linspace(0, q.shape[1], STEPS + 1).astype(int))
    # length of what is left of each vector from each cut on
    left = lambda x: np.sqrt(np.stack([(x[:, at:] ** 2).sum(axis=1) for at in cuts[:-1]]))
    qleft, cleft = left(qr), left(cr)
    floor = floor.astype(float).copy()
    live = np.arange(len(qid))
    held_q, held_c, held_s = np.array([], np.int64), np.array([], np.int64), np.array([], np.int64)
    at, size = 0, FEW
    while at < len(cid):
        live = live[qn[live] * cn[at] + slack >= floor[live]]  # no later candidate is longer
        if not len(live):
            break
        part, least = slice(at, at + size), floor[live, None] - slack
        near = np.ones((len(live), len(cid[part])), bool)
        if (floor[live] > LEAST).mean() > 0.5:
            total = np.zeros(near.shape)
            for n, (s, e) in enumerate(zip(cuts, cuts[1:])):
                near = total + qleft[n, live, None] * cleft[n, None, part] >= least
                if near.mean() <= OPEN:
                    break
                total += qr[live, s:e] @ cr[part, s:e].T
                work.axes += total.size * int(e - s)
            else:
                near = total >= least
        i, j = np.nonzero(near)
        score = _products(q[live], c[part], i, j, safe, work)
        good = (score >= floor[live[i]]) & (cid[part][j] != qid[live[i]])
        held_q, held_c, held_s = np.append(held_q, live[i[good]]), np.append(held_c, j[good] + at), np.append(held_s, score[good])
        top = np.lexsort((cid[held_c], -held_s, held_q))
        held_q, held_c, held_s = held_q[top], held_c[top], held_s[top]
        first = np.flatnonzero(np.diff(held_q, prepend=-1))
        nth = np.arange(len(held_q)) - np.repeat(first, np.diff(np.append(first, len(held_q))))
        last = nth == k - 1
        floor[held_q[last]] = np.maximum(floor[held_q[last]], held_s[last])
        held_q, held_c, held_s = held_q[nth < k], held_c[nth < k], held_s[nth < k]
        at, size = at + size, min(2 * size, MANY)
    return held_q, order[held_c], held_s


def _search(rotations, k: int):
    names = ["dim", "shard", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = rotations.value
        for (dim, _, _), rows in by_group(batches, names):
            asks = rows.column("asks").to_numpy()
            ids = rows.column("vec_id").to_numpy()
            v = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            norm, floor = rows.column("norm").to_numpy(), rows.column("floor").to_numpy()
            if asks.all() or not asks.any():
                continue
            q, c = asks, ~asks
            at, found, score = best((ids[q], v[q], norm[q], floor[q]), (ids[c], v[c], norm[c]), axes[dim], k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q][at]), pa.array(ids[c][found]), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def reach(asked: DataFrame, longest: list[float]) -> DataFrame:
    """Queries with ``reach``, the last shard whose longest vector can still make their ``floor``; 0 where none after the first."""
    longest = np.minimum.accumulate(np.array(longest[1:], float))
    shared = asked.sparkSession.sparkContext.broadcast(longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm, floor = batch.column("norm").to_numpy(), batch.column("floor").to_numpy().astype(float)
            need = (floor - 1e-6 * (1 + np.abs(floor))) / np.maximum(norm, 1e-300)
            need = np.where(floor <= 0, -1.0, need)  # a product of lengths is never below zero
            last = np.searchsorted(-shared.value, -need, side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(last.astype(np.int32))], [*batch.schema.names, "reach"])

    return asked.mapInArrow(run, "dim int, vec_id long, v array<long>, norm double, floor long, reach int")


def top_k(rows: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k best candidates of each query: query_id, rank, vec_id, score.

    Queries are rows whose id is divisible by ``every``; candidates every row but
    those with the query's own id.  Ties go to the smaller id.  A null vector, one
    without components or with a null or non-finite one, and a row with a null id
    take no part; vectors are compared with those of their own dimension; of rows
    with one id the query is the first in order of its components, and as
    candidates each counts.  Other columns are not read.
    """
    vectors = cut(whole_vectors(rows, id_col, vec_col))
    spark, n = vectors.sparkSession, vectors.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n // (every * ASKED)))
    axes = spark.sparkContext.broadcast(rotation(vectors))
    ranged = vectors.repartitionByRange(shards, F.desc("norm"), "vec_id", "v")
    dealt = cut(ranged.withColumn("shard", F.spark_partition_id()))
    queries = dealt.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "norm")).alias("q"))
    queries = cut(queries.select("vec_id", "q.*", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")))
    cols, keys = ["dim", "shard", "block", "asks", "vec_id", "v", "norm", "floor"], ["dim", "shard", "block"]

    def meet(asked: DataFrame, sent: DataFrame) -> DataFrame:
        both = asked.withColumn("asks", F.lit(True)).select(*cols).unionAll(sent.select(*cols))
        return both.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_search(axes, k), "query_id long, vec_id long, score long")

    as_candidates = dealt.withColumn("asks", F.lit(False)).withColumn("floor", F.lit(LEAST).cast("long"))
    every_block = as_candidates.where("shard = 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = cut(meet(queries.withColumn("floor", F.lit(LEAST).cast("long")).withColumn("shard", F.lit(0)), every_block))
    if shards > 1:
        longest = {r["shard"]: r["norm"] for r in dealt.groupBy("shard").agg(F.max("norm").alias("norm")).collect()}  # a number a shard
        kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        asked = queries.drop("block").join(kth, queries.vec_id == kth.query_id, "left").withColumn("floor", F.coalesce("kth", F.lit(LEAST).cast("long")))
        asked = reach(asked.select("dim", "vec_id", "v", "norm", "floor"), [longest.get(s, 0.0) for s in range(shards)]).where("reach > 0")
        asked = cut(asked.repartitionByRange(blocks, F.desc("reach"), "vec_id").withColumn("block", F.spark_partition_id()))
        widest = [r["reach"] for r in asked.groupBy("block").agg(F.max("reach").alias("reach")).orderBy("block").collect()]  # a number a block
        # blocks come in order of reach: those that reach a shard are the first so many
        wide = {s: sum(r >= s for r in widest) for s in range(1, shards)}
        to = spark.createDataFrame([(s, n) for s, n in wide.items() if n] or [(0, 0)], "shard int, blocks int").where("blocks > 0")
        sent = as_candidates.join(to, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        found = found.unionAll(meet(asked.withColumn("shard", F.explode(F.sequence(F.lit(1), "reach"))), sent))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 20, every: int = 20) -> str:
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
