from pagelake.llm import near_vectors


def test_vectors_of_one_id_are_one_node(spark):
    a, b, c = ([float(i == k) for i in range(4)] for k in range(3))
    rows = [(1, a), (1, b), (0, a), (5, b), (7, c), (7, None)]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["component_id"], r["n_links"]) for r in got) == [(0, 0, 1), (1, 0, 1), (1, 0, 1), (5, 0, 1), (7, 7, 0), (7, 7, 0)]
