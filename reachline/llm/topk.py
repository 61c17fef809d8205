"""Exact top-k search with bounds from segment means and deviations, coarse to fine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEGMENTS = (1, 4, 16)
EXACT = 2.0**52

FOUND = "query_id bigint, vec_id bigint, score bigint"


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of every component; null if the vector or a component is null or not
    finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.when(sound & (F.size(vector) > 0),
                  F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Root of the length times mean and deviation of each segment, side by side.

    The squared distance of two rows is at least that of their vectors: the mean parts add up
    exactly, and deviations from the mean are no nearer than their sizes differ.
    """
    width = vectors.shape[1]
    edges = np.unique(np.linspace(0, width, min(segments, width) + 1).astype(int))
    lengths = np.diff(edges)
    means = np.add.reduceat(vectors, edges[:-1], axis=1) / lengths
    squares = np.add.reduceat(vectors**2, edges[:-1], axis=1) / lengths
    spread = np.sqrt(np.maximum(squares - means**2, 0))
    return np.hstack([means, spread]) * np.sqrt(np.tile(lengths, 2))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray,
                 ids: np.ndarray, k: int) -> list[tuple]:
    """The k best of one block of vectors for each query.

    At every resolution the lower bound of the distance gives an upper bound of the inner
    product, as 2 <x, y> = |x|^2 + |y|^2 - distance^2. Vectors whose bound is below the k-th
    best exact score so far are out; the most promising ones are computed to raise that score.
    """
    norms, query_norms = (vectors**2).sum(1), (queries**2).sum(1)
    levels = [(segment_statistics(vectors, s), segment_statistics(queries, s)) for s in SEGMENTS]
    sizes = [(a**2).sum(1) for a, _ in levels]
    found = []
    for i, query in enumerate(queries):
        left = np.flatnonzero(ids != query_ids[i])
        floor = -np.inf
        for (rows, points), size in zip(levels, sizes):
            if len(left) <= 4 * k:
                break
            distance = size[left] - 2 * rows[left] @ points[i] + points[i] @ points[i]
            bound = (norms[left] + query_norms[i] - distance) / 2
            bound += 1e-9 * (norms[left] + query_norms[i]) + 1e-6
            likely = left[np.argpartition(bound, len(left) - k)[len(left) - k:]]
            floor = max(floor, (vectors[likely] @ query).min())
            left = left[bound >= floor]
        scores = vectors[left] @ query
        for j in _best(scores, ids[left], k):
            found.append((query_ids[i], ids[left[j]], scores[j]))
    return found


def _plain(queries: list, query_ids: np.ndarray, vectors: list, ids: np.ndarray,
           k: int) -> list[tuple]:
    """As ``search_block``, in whole numbers of any size; scores end at the range of a long."""
    found = []
    for query, own in zip(queries, query_ids):
        scored = sorted((-sum(map(int.__mul__, query, v)), i)
                        for v, i in zip(vectors, ids.tolist()) if i != own)[:k]
        found += [(own, i, max(-2**63, min(2**63 - 1, -s))) for s, i in scored]
    return found


def _searcher(k: int):
    def search(_, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            ids, query_ids = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
            one, other = np.stack(queries["v"].to_list()), np.stack(rows["v"].to_list())
            reach = (float(max(np.abs(one).max(), 1)) * float(max(np.abs(other).max(), 1))
                     * one.shape[1])
            widest = max(float(np.abs(one).max()), float(np.abs(other).max()))
            if max(reach, widest**2 * one.shape[1]) < EXACT:
                found = search_block(one.astype(float), query_ids, other.astype(float), ids, k)
            else:
                found = _plain(one.tolist(), query_ids, other.tolist(), ids, k)
        columns = list(zip(*found)) or [[], [], []]
        return pd.DataFrame({name: np.array(column, dtype=object).astype("int64")
                             for name, column in zip(("query_id", "vec_id", "score"), columns)})
    return search


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20, query_block: int = 2048,
          row_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of every query.

    ``queries`` has (query_id, v), ``rows`` (vec_id, v); ``v`` are arrays of whole numbers.
    Queries meet all rows but their own in blocks of bounded size, one task per pair of blocks;
    each gives at most k rows per query, which are ranked by query. Ties go to smaller ids;
    with fewer than k rows a query gets all. Vectors of other lengths than the query's do not
    meet it. Rows with a null id or vector take no part; of rows that repeat an id, the least
    vector counts. Vectors far beyond the exact range of doubles are computed without bounds.
    """
    least = lambda frame, key: (frame.where(F.col(key).isNotNull() & F.col("v").isNotNull())
                                .groupBy(key).agg(F.min("v").alias("v")))
    queries, rows = least(queries, "query_id"), least(rows, "vec_id")
    parts = lambda frame, size: max(1, -(-frame.count() // size))
    query_parts, row_parts = parts(queries, query_block), parts(rows, row_block)
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["width", "query_part", "row_part"]
    asked = queries.select(
        "query_id", "v", F.size("v").alias("width"),
        F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int").alias("query_part"),
        everywhere(row_parts).alias("row_part"))
    given = rows.select(
        "vec_id", "v", F.size("v").alias("width"),
        F.pmod(F.xxhash64("vec_id"), F.lit(row_parts)).cast("int").alias("row_part"),
        everywhere(query_parts).alias("query_part"))
    found = asked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInPandas(_searcher(k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op4_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return top_k(queries, rows)


ORACLE_SQL = """
  WITH vectors AS (
    SELECT CAST(vec_id AS BIGINT) AS vec_id,
      list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding,
      lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scored AS (
    SELECT q.vec_id AS query_id, r.vec_id,
      CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
    FROM vectors q JOIN vectors r ON r.vec_id <> q.vec_id AND len(r.v) = len(q.v)
    WHERE q.vec_id % 20 = 0),
  ranked AS (
    SELECT query_id, CAST(row_number() OVER (
      PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored)
  SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""
