import numpy as np
import pytest
from pyspark.sql import functions as F

from reachline.llm.topk import quantised, search_block, segment_statistics, top_k


def brute(rows, k):
    """rows: id to vector, of whole numbers."""
    out = []
    for q, x in rows.items():
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows.items()
                            if i != q and len(y) == len(x))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(2048, 4096), (3, 40)])
def test_top_k_matches_brute_force(spark, blocks):
    rng = np.random.default_rng(0)
    vectors = {i: rng.normal(0, 0.3, 48).tolist() for i in range(150)}
    vectors |= {i: vectors[20] for i in range(150, 190)}  # many ties
    rows = [(i, v, "x") for i, v in vectors.items()]
    rows += [(200, None, "x"), (220, [1.0, None], "x"), (240, [float("nan")] * 48, "x"),
             (260, [float("inf")] * 48, "x"), (None, vectors[1], "x"), (280, [0.5, -0.5], "x"),
             (281, [1.0, 2.0], "x"), (300, [], "x"), (20, vectors[20], "x")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank string")
    frame = frame.select("vec_id", quantised(F.col("embedding")).alias("v"), "rank")
    queries = frame.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = top_k(queries, frame, 20, *blocks).collect()
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors.items()}
    whole |= {280: [32, -32], 281: [64, 128]}
    assert sorted(map(tuple, found)) == brute(whole, 20)


def test_large_components_stay_exact(spark):
    rows = spark.createDataFrame([(0, [2**40, 1]), (1, [2**20 + 1, 3]), (2, [2**20, 5]),
                                  (3, [2**62, 0])], "vec_id bigint, v array<bigint>")
    queries = rows.where("vec_id = 0").withColumnRenamed("vec_id", "query_id")
    found = [(r.vec_id, r.score) for r in top_k(queries, rows, 3).collect()]
    assert found == [(3, 2**63 - 1), (1, 2**60 + 2**40 + 3), (2, 2**60 + 5)]


def test_empty_search(spark):
    rows = spark.createDataFrame([], "vec_id bigint, v array<bigint>")
    assert top_k(rows.withColumnRenamed("vec_id", "query_id"), rows).count() == 0


def test_segment_statistics_bound_the_distance():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(50, 37))
    exact = ((rows[:, None] - rows[None]) ** 2).sum(-1)
    last = 0
    for segments in (1, 4, 16):
        marks = segment_statistics(rows, segments)
        bound = ((marks[:, None] - marks[None]) ** 2).sum(-1)
        assert (bound <= exact + 1e-9).all()
        assert bound.sum() > last
        last = bound.sum()
    found = search_block(rows[:5], np.arange(5), rows, np.arange(50), 3)
    scores = rows[:5] @ rows.T
    np.fill_diagonal(scores, -np.inf)
    assert [f[1] for f in found] == np.argsort(-scores, axis=1)[:, :3].ravel().tolist()
