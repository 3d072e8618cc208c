import random

import pytest
from pyspark.sql import functions as F

from voxlake.functions.align import align_rows
from voxlake.operators import audit, dedup, evaluate, graph, resume, split, training, triage
from voxlake.operators.neardup import NearDuplicates

PREDICTION = "sample_id string, reference string, hypothesis string, audio_seconds double, processing_seconds double, silent boolean"


def plain_dp(a, b):
    grid = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == j == 0:
                grid[i, j] = (0, 0, 0, 0)
            elif i and j and a[i - 1] == b[j - 1]:
                grid[i, j] = grid[i - 1, j - 1]
            else:
                step = lambda c, k: (c[0] + 1, *(c[m] + (m == k) for m in (1, 2, 3)))
                options = [step(grid[i, j - 1], 1)] if j else []
                options += [step(grid[i - 1, j], 2)] if i else []
                options += [step(grid[i - 1, j - 1], 3)] if i and j else []
                grid[i, j] = min(options)
    cost, ins, dele, sub = grid[len(a), len(b)]
    return [sub, dele, ins, len(a)]


def test_alignment_matches_plain_dp():
    r = random.Random(2)
    pick = lambda: [r.choice("abcde") for _ in range(r.randint(0, 9))]
    refs, hyps = [pick() for _ in range(600)], [pick() for _ in range(600)]
    assert align_rows(refs, hyps).tolist() == [plain_dp(a, b) for a, b in zip(refs, hyps, strict=True)]
    assert align_rows(["one two three".split()], ["one too extra".split()]).tolist() == [[2, 0, 0, 3]]


def test_components_against_union_find(spark):
    r = random.Random(7)
    edges = [(f"n{r.randint(0, 80):02d}", f"n{r.randint(0, 80):02d}") for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {n: find(n) for a, b in edges for n in (a, b) if a != b}
    got = {x["node"]: x["label"] for x in graph.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == want


def test_dedup_by_two_keys(spark):
    rows = [("later", 2, "t1", None), ("earlier", 1, "t1", None), ("audio-a", 3, "t2", "a1"), ("audio-b", 4, "t3", "a1"), ("alone", 5, None, None), ("chain", 6, "t3", "a9"), ("end", 7, None, "a9")]
    df = spark.createDataFrame(rows, "sample_id string, index long, transcript_sha256 string, audio_sha256 string")
    grouped = dedup.with_groups(df)
    got = {r["sample_id"]: r["group_size"] for r in dedup.canonical(grouped).collect()}
    assert got == {"earlier": 2, "audio-a": 4, "alone": 1}
    assert dedup.counters(grouped).first().asDict() == {"input_rows": 7, "removed_rows": 4, "duplicate_groups": 2, "transcript_collisions": 2, "audio_collisions": 2}
    digests = {r["dedupe_group_sha256"] for r in dedup.canonical(grouped).collect()}
    assert {r["dedupe_group_sha256"] for r in dedup.canonical(dedup.with_groups(df.orderBy(F.desc("index")))).collect()} == digests


def _texts(spark, texts):
    return spark.createDataFrame([(f"s{i:03d}", i, t) for i, t in enumerate(texts)], "sample_id string, index long, normalized string")


def test_near_duplicates(spark):
    near = NearDuplicates(_texts(spark, ["the quick brown fox jumps over the lazy dog today", "the quick brown fox jumps over the lazy dogs today", "something else entirely here", "something else entirely here", "abcdefgh", "abcdefgh", ""]))
    pairs = near.reported().collect()
    assert [(p["id_a"], p["id_b"]) for p in pairs] == [("s000", "s001")] and pairs[0]["similarity"] >= 0.9
    got = near.summary().first()
    assert (got["exact_groups"], got["exact_extras"], got["unique_texts_indexed"], got["budget_exhausted"]) == (2, 2, 3, False)


def test_near_duplicate_limits_do_not_depend_on_order(spark):
    texts = [f"templated text number {i:03d} with a common body" for i in range(12)]
    got = []
    for order in (texts, texts[::-1]):
        rows = spark.createDataFrame([(f"s{texts.index(t):03d}", texts.index(t), t) for t in order], "sample_id string, index long, normalized string")
        near = NearDuplicates(rows, budget=3)
        s = near.summary().first()
        assert s["comparisons"] == 3 and s["budget_exhausted"]
        got.append([tuple(r) for r in near.reported().collect()])
    assert got[0] == got[1]


def test_apportion():
    assert split.apportion(43167, {"train": 90, "validation": 5, "test": 5}) == {"train": 38850, "validation": 2159, "test": 2158}
    with pytest.raises(ValueError):
        split.check_ratios({"train": 90, "validation": 5, "test": 4})


def test_split_is_order_free_and_keeps_pairs(spark):
    rows = [(f"id-{i:03d}", i, f"t{i}", "ABCD"[i % 4]) for i in range(100)]
    schema = "sample_id string, index long, transcript_sha256 string, language_category string"
    pairs = spark.createDataFrame([("id-000", "id-099"), ("id-001", "nobody")], "id_a string, id_b string")
    ratios = {"train": 90, "validation": 5, "test": 5}
    out = [{r["sample_id"]: r["split"] for r in split.assign(spark.createDataFrame(x, schema), ratios, pairs).collect()} for x in (rows, rows[::-1])]
    assert out[0] == out[1] and len(out[0]) == 100 and out[0]["id-000"] == out[0]["id-099"]
    assigned = spark.createDataFrame([(a, b, s, d, out[0][a]) for a, b, s, d in rows], schema + ", split string")
    assert split.verify_leakage(assigned, pairs) == {"sample_ids": 100, "exact_keys": 100, "linked_pairs": 1}
    leak = spark.createDataFrame([("a", "h", "train"), ("b", "h", "validation")], "sample_id string, transcript_sha256 string, split string")
    with pytest.raises(ValueError):
        split.verify_leakage(leak)
    with pytest.raises(ValueError):
        split.assign(spark.createDataFrame([rows[0], rows[0]], schema), ratios)


def test_benchmark(spark):
    rows = [("a", "افتح router من فضلك", "افتح rooter من فضلك", 2.0, 1.0, False), ("b", "", "invented", None, None, True)]
    facts = evaluate.prediction_facts(spark.createDataFrame(rows, PREDICTION))
    got = evaluate.benchmark_summary(facts).first()
    assert got["code_switched_wer"]["rate"] == pytest.approx(1 / 4) and got["rtf"] == 0.5 and got["rtf_timed_examples"] == 1
    assert {r["reason"]: r["n"] for r in evaluate.reason_histogram(facts).collect()} == {"invented_english": 2, "silent_speech": 1}
    empty = evaluate.benchmark_summary(evaluate.prediction_facts(spark.createDataFrame([], PREDICTION))).first()
    assert empty["wer_raw"]["rate"] is None and empty["hallucination_rate"] is None and empty["rtf"] is None
    with pytest.raises(ValueError):
        evaluate.check_timings(spark.createDataFrame([("x", "", "", 1.0, -0.1, False)], PREDICTION))
    assert evaluate.real_time_factor(1.0, 0.0) is None


def test_recall_and_numbers(spark):
    rows = [("a", "restart the restart router application", "restart router", 1.0, 1.0, False), ("b", "هات ١٢ و package5 و A-10", "هات 12 و package5 و A-11", 1.0, 1.0, False)]
    facts = {r["sample_id"]: r for r in evaluate.prediction_facts(spark.createDataFrame(rows, PREDICTION)).collect()}
    assert tuple(facts["a"]["english_term_recall"]) == (2, 5)
    assert tuple(facts["b"]["number_accuracy"]) == (2, 3)


def test_triage(spark):
    rows = [("a", "open router 12 now", "open rooter 13 now", 0.8, 0.1, False), ("b", "same", "same", 2.0, 0.1, False), ("c", "مرحبا يا", "مرحبا", 2.0, 0.1, False)]
    labelled = triage.error_labels(spark.createDataFrame(rows, PREDICTION))
    got = {r["sample_id"]: r["labels"] for r in labelled.collect()}
    assert got == {"a": ["english_term_error", "number_error", "short_utterance_failure"], "c": ["other_word_error"]}
    assert "reference" not in labelled.columns
    counts = {r["label"]: r["n"] for r in triage.label_counts(labelled).collect()}
    assert len(counts) == 7 and counts["repetition"] == 0
    assert triage.review_sample(labelled, 1).count() == 4


def test_bookkeeping(spark, tmp_path):
    manifest = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "sample_id string, index long")
    assert [r["sample_id"] for r in resume.manifest_prefix(manifest, 2).collect()] == ["b", "c"]
    assert {r["sample_id"] for r in resume.pending(manifest, manifest.where("index = 0")).collect()} == {"a", "c"}
    out = tmp_path / "predictions.jsonl"
    resume.ensure_sidecar(out, {"model": "m"})
    resume.ensure_sidecar(out, {"model": "m"})
    with pytest.raises(ValueError):
        resume.ensure_sidecar(out, {"model": "n"})
    (tmp_path / "other.jsonl").write_text("{}")
    with pytest.raises(ValueError):
        resume.ensure_sidecar(tmp_path / "other.jsonl", {"model": "m"})
    assert len(resume.file_sha256(tmp_path / "other.jsonl")) == 64


def test_training(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i}", i, 10.0) for i in range(40)], "sample_id string, index long, seconds double")
    assert training.to_target_seconds(rows, 95.0).count() == 10
    assert training.to_target_seconds(rows, 0.0).count() == 1
    assert {r[0] for r in training.seeded_subset(rows, 5).collect()} == {r[0] for r in training.seeded_subset(rows.orderBy(F.desc("index")), 5).collect()}
    steps = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3), (4, float("nan"))], "step int, wer double")
    got = {r["step"]: (r["rising"], r["non_finite"]) for r in training.stop_rule(steps).collect()}
    assert got[2] == (False, False) and got[3] == (True, False) and got[4][1]
    assert training.should_stop([0.1, 0.2, 0.3]) and not training.should_stop([0.1, 0.2])
    for name in ("checkpoint-9", "checkpoint-10", "checkpoint-11"):
        (tmp_path / name).mkdir()
        for f in training.CHECKPOINT_FILES[: 2 if name.endswith("11") else None]:
            (tmp_path / name / f).write_text("x")
    assert training.latest_checkpoint(tmp_path).name == "checkpoint-10"


def test_audit(spark):
    rows = [("a", 0, "call me on 0100112345 now", [0.5] * 64000, 16000), ("b", 1, "مرحبا ok", [0.0] * 10, 16000), ("c", 2, None, None, None)]
    facts = audit.audit_facts(spark.createDataFrame(rows, "sample_id string, index long, transcript string, samples array<float>, sampling_rate int"))
    got = {r["sample_id"]: r for r in facts.collect()}
    assert got["a"]["duration_seconds"] == 4.0 and got["b"]["silent"] and got["c"]["silent"] is None and got["c"]["empty_transcript"]
    s = audit.audit_summary(facts).first()
    assert (s["examples"], s["silent"], s["empty_transcript"], s["n_ar_en_code_switched"]) == (3, 1, 1, 1)
    d = audit.duration_stats(spark.createDataFrame([(float(i),) for i in range(1, 11)], "duration_seconds double")).first()
    assert [d[c] for c in ("p25", "median", "p75", "p95", "total_seconds")] == pytest.approx([3.25, 5.5, 7.75, 9.55, 55.0])
