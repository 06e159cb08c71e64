"""Top-k by cells gives the rows of the plain ranking, with less scored, however the vectors lie."""

import random

import pytest

from lectern.operators import cell_index, retrieval

INDEX = "chunk_ord long, embedding array<float>"


def both(spark, rows, queries, k, cells=None):
    index = spark.createDataFrame(rows, INDEX).repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, query_vector array<float>")
    plain = sorted(tuple(r) for r in retrieval.top_k(asked, index, k).select("query_id", "rank", "chunk_ord", "score").collect())
    found, share = cell_index.top_k(asked, cell_index.build(index, cells=cells), k)
    return plain, sorted(tuple(r) for r in found.select("query_id", "rank", "chunk_ord", "score").collect()), share


def test_clustered_vectors(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in centres[i % 20]]) for i in range(2000)]
    rows += [(2000 + i, rows[3][1]) for i in range(1000)]  # a third of all rows is one vector
    queries = [(i, rows[i * 7][1]) for i in range(60)] + [(100, None)]
    plain, found, share = both(spark, rows, queries, 10)
    assert found == plain and 0 < share < 0.5


@pytest.mark.parametrize("cells", [1, 5, 400])
def test_vectors_without_order_ties_and_odd_ones(spark, monkeypatch, cells):
    monkeypatch.setattr(cell_index, "SLICE", 16)  # cells and their queries are cut
    rng = random.Random(cells)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(300)]
    rows += [(300, [0.0] * 4), (301, [1.0]), (302, None), (303, [1.0] * 6), (304, [])]
    queries = [(i, rows[i][1]) for i in range(0, 305, 4) if rows[i][1]] + [(400, [1.0, 1.0]), (401, [0.0] * 4)]
    plain, found, _ = both(spark, rows, queries, 7, cells)
    assert found == plain


def test_few_or_no_vectors(spark):
    assert both(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], [(9, [1.0, 1.0])], 5)[0] == both(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], [(9, [1.0, 1.0])], 5)[1]
    plain, found, share = both(spark, [], [(9, [1.0, 1.0])], 5)
    assert plain == found == [] and share == 0
    assert both(spark, [(1, [1.0, 0.0])], [], 5)[1] == []
