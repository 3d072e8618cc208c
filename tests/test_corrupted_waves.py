"""The signal-processing queries take every wave; corrupted ones come out as null."""

import pytest

from voxlake.functions import audio as A
from voxlake.plans import inputs as I
from voxlake.plans import registry


@pytest.mark.parametrize("name", ["bandpass", "narrowband_roundtrip", "codec_roundtrip", "telephone_degrade", "augment_training"])
def test_every_wave_has_a_defined_result(spark, tmp_path, name):
    waves = [(i, [0.01 * (k % 9 - 4) * (i + 1) for k in range(64)]) for i in range(10)]
    spark.createDataFrame(waves, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = {r["vec_id"]: r for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    assert sorted(rows) == list(range(10))
    sounds = {"codec_roundtrip": ("mulaw", "alaw"), "augment_training": ("samples",)}.get(name, ("out",))
    for i, r in rows.items():
        assert all((r[c] is None) == (i % 5 == 3) for c in sounds)
    if name == "augment_training":
        assert (rows[3]["selected"], rows[3]["transforms"], rows[3]["seed"]) == (False, [], str(A.example_seed(42, "3")))


def test_infinite_and_missing_waves(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(0, [0.1, nan] * 40), (1, [0.1, -inf] * 40), (2, None), (3, [0.1] * 80)], "i int, samples array<double>")
    out = rows.select("i", A.telephone_udf(I.F.col("samples"), I.F.lit(16000)).alias("x")).orderBy("i").collect()
    assert [r["x"] is None for r in out] == [True, True, True, False]
