from lexloom.llm import graph as G


def test_edges(spark):
    schema = "u long, v long"
    assert G.connected_components(spark.createDataFrame([], schema)).count() == 0
    assert G.connected_components(spark.createDataFrame([(1, 1), (2, 2)], schema)).count() == 0
    rows = G.connected_components(spark.createDataFrame([(7, 3), (3, 7), (-4, 7)], schema)).collect()
    assert {(r.node, r.component) for r in rows} == {(7, -4), (3, -4), (-4, -4)}


def test_star(spark):
    hub = spark.createDataFrame([(0, i) for i in range(1, 3000)], "u long, v long").repartition(8)
    rows = G.connected_components(hub).collect()
    assert len(rows) == 3000 and {r.component for r in rows} == {0}
