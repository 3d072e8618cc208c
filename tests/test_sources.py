import json

import pytest

from voxlake import config, report
from voxlake.sources import gates, jsonl, loaders
from voxlake.streaming.audit_stream import running_audit


def test_gates():
    assert gates.check_revision("  12345678 ") == "12345678"
    for bad in (lambda: gates.check_revision("123"), lambda: gates.check_limit(-1), lambda: gates.check_external_split("train"), lambda: gates.transcript_column(["audio"])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(PermissionError):
        gates.check_pseudo_opt_in(True, False)
    with pytest.raises(SystemExit):
        gates.check_primary([{"id": "x", "role": "pseudo"}], "x")
    assert gates.transcript_column(["sentence", "text"]) == "text"


def test_loaders(spark, tmp_path):
    path = str(tmp_path / "data.parquet")
    spark.createDataFrame([(i, f"t{i}", [0.1]) for i in range(5)], "index long, transcription string, audio array<float>").write.parquet(path)
    rows = loaders.load_primary(spark, path, "r", "12345678", max_examples=3, decode_audio=False)
    assert rows.count() == 3 and "audio" not in rows.columns
    assert "audio#" not in rows._jdf.queryExecution().executedPlan().toString().split("FileScan")[1]
    assert loaders.load_primary(spark, path, "r", "12345678").first()["sample_id"] != loaders.load_primary(spark, path, "r", "12345679").first()["sample_id"]
    assert loaders.load_pseudo_labelled(spark, path, "r", "12345678").first()["audio"] is None
    assert loaders.load_pseudo_labelled(spark, path, "r", "12345678", allow_full_audio=True, allow_license_use=True).first()["audio"] is not None
    assert loaders.load_external(spark, path, "r", "12345678", "test").first()["role"] == "external_eval_only"


def test_predictions_and_manifests(spark, tmp_path):
    good = tmp_path / "p.jsonl"
    good.write_text('{"sample_id": "a", "reference": "x", "hypothesis": "y"}\n\n')
    assert jsonl.read_predictions(spark, str(good)).first()["silent"] is False
    bad = tmp_path / "q.jsonl"
    bad.write_text('{"sample_id": "a", "reference": "x", "hypothesis": "y", "extra": 1}\n')
    with pytest.raises(ValueError):
        jsonl.read_predictions(spark, str(bad))
    rows = spark.createDataFrame([("a", 0, None, "h", "EN_ONLY", "g", "train"), ("b", 1, "t", None, "EN_ONLY", "g", "test")], jsonl.MANIFEST_SCHEMA + ", split string")
    jsonl.write_manifests(rows, str(tmp_path / "splits"))
    back = jsonl.read_manifest(spark, str(tmp_path / "splits"))
    assert {r["sample_id"]: r["audio_sha256"] for r in back.collect()} == {"a": "h", "b": None}
    line = next((tmp_path / "splits" / "split=train").glob("part-*")).read_text().strip()
    assert list(json.loads(line)) == sorted(json.loads(line)) and "transcript" not in json.loads(line)
    assert jsonl.read_reported_pairs(spark, str(tmp_path / "none.json")).count() == 0


def valid():
    return {
        "experiment": {"name": "e", "experiment": "E1"}, "model": {"id": "m", "revision": "TBD", "load_in_8bit": True, "dtype": "float16"},
        "lora": {"r": 16, "alpha": 32, "dropout": 0.05, "target_modules": ["v_proj", "q_proj"]},
        "training": {"learning_rate": 1e-4, "epochs": 3, "warmup_ratio": 0.1, "weight_decay": 0.0, "per_device_train_batch_size": 4, "gradient_accumulation_steps": 4, "gradient_checkpointing": True, "fp16": True, "eval_strategy": "epoch", "save_strategy": "epoch", "seed": 42},
        "dataset": {"id": "d", "splits": {"train": 90, "validation": 5, "test": 5, "seed": 42}},
        "augmentation": {"enabled": False, "seed": 42, "telephone_bandpass_probability": 0.3, "narrowband_resample_probability": 0.3, "mulaw_alaw_probability": 0.15, "gain_variation_probability": 0.2, "clipping_probability": 0.1, "noise_probability": 0.15, "speed_perturbation_probability": 0.1, "speed_rate_range": [0.95, 1.05], "apply_probability": 0.0, "preserve_transcript": True},
    }


def test_config():
    assert config.validate(valid())["model"]["revision"] is None
    for path, value in (
        ("lora.alpha", 8), ("lora.target_modules", ["q_proj"]), ("training.seed", 1), ("training.eval_strategy", "steps"), ("training.fp16", False), ("dataset.splits", {"train": 90, "validation": 5, "test": 6, "seed": 42}),
        ("augmentation.apply_probability", 0.3), ("augmentation.speed_rate_range", [0.9, 1.1]), ("model.load_in_8bit", False), ("experiment.experiment", "E2"), ("experiment.experiment", "E3"), ("lora.extra", 1), ("experiment.name", " "),
    ):
        bad = valid()
        section, key = path.split(".")
        bad[section][key] = value
        with pytest.raises(config.ConfigError):
            config.validate(bad)
    with pytest.raises(config.ConfigError):
        config.validate({**valid(), "other": {}})


def test_reports():
    assert report.plain(None) == "TBD" and report.plain(True) == "yes" and report.plain(0.1234567) == "0.123457" and report.percent(1, 0) is None
    assert "NOT RUN" in report.render_audit(None)
    text = report.render_audit({"examples": 4, "silent": 1, "min_seconds": 0.02}, {"languages": [("EN_ONLY", 4)]})
    assert text.endswith("\n") and not text.endswith("\n\n") and "suspicious" in text and all(line == line.rstrip() for line in text.split("\n"))


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.createDataFrame([("hello there",), ("مرحبا ok",), ("",), (None,)], "transcript string")
    rows.write.parquet(path)
    stream = running_audit(spark.readStream.schema("transcript string").parquet(path))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("audit_stream").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("audit_stream").collect())) == sorted(map(tuple, running_audit(rows).collect()))
