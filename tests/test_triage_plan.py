from voxlake.plans import registry


def test_labels_and_reasons_are_computed_once(spark, tmp_path):
    """A filter that Spark infers from an explode repeated all work in Python; now it reads a stored table."""
    rows = [(i, 0, " ".join(["this", "sample", f"n{i}", "text", "12"] * (1 + i % 4))) for i in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("hallucination_reasons", "error_categories", "error_review_sample"):
        out = getattr(registry, name)(spark, str(tmp_path))
        assert out.collect()
        assert "EvalPython" not in out._jdf.queryExecution().executedPlan().toString()
