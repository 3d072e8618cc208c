import numpy as np

from voxlake.llm import topk


def test_query_copies_are_not_broadcast(spark):
    """A broadcast of the queries, one copy for each block of rows, goes through the driver."""
    v = np.random.default_rng(7).normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    out = topk.top_k(df, df.where("vec_id % 5 = 0"), 3)
    assert len(out.collect()) == 180
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_whole_numbers_of_any_width_come_back():
    for top in (3, 1 << 15, -(1 << 15), (1 << 31) - 1, 1 << 31, 1 << 60):
        v = np.array([[0.0, top, -1.0], [5.0, -7.0, 2.0]])
        assert (topk.unpacked(topk.packed(v), 2, 3) == v).all()
    assert topk.unpacked(topk.packed(np.zeros((2, 0))), 2, 0).shape == (2, 0)
