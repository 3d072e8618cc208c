"""The loaders' queries take whole tables; their limits are tested here."""

from voxlake.operators import resume
from voxlake.plans import registry
from voxlake.sources import loaders


def test_load_primary_takes_every_document(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(250)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["index"]: r["transcript"] for r in registry.load_primary(spark, str(tmp_path)).collect()} == {i: f"text {i}" for i in range(250)}
    few = loaders.load_primary(spark, docs, "r", "0123456789abcdef", max_examples=7, index_col="doc_id")
    assert sorted(r["index"] for r in few.collect()) == list(range(7))


def test_manifest_select_takes_every_manifest_row(spark, tmp_path):
    rows = spark.createDataFrame([(i, 0, f"text {i}") for i in range(450)], "conv_id long, turn int, text string")
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["index"], r["transcript"], r["sample_id"]) for r in registry.manifest_select(spark, str(tmp_path)).collect()}
    assert got == {(i * 100, f"text {i}", f"m-{i * 100}") for i in range(450) if i * 100 % 3 == 0}
    manifest = spark.createDataFrame([(i, f"s{i}") for i in range(30, 0, -1)], "index long, sample_id string")
    assert sorted(r["index"] for r in resume.manifest_prefix(manifest, 4).collect()) == [1, 2, 3, 4]
