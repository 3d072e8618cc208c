"""Registered evaluation queries take whole utterances."""

import numpy as np

from voxlake.functions import align as E
from voxlake.plans import registry

from .test_operators import plain_dp

LONG = " ".join(f"word{'abcdefgh'[i % 8]}{'xyz'[i % 3]}" for i in range(40))


def _tables(spark, path, texts):
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def _edited(words, key):
    """The fixed edit of the stand-in predictions."""
    arabic = dict(zip("abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه", strict=True))
    ref = ["".join(arabic.get(c, c) for c in w) if key % 3 == 1 and i % 3 == 0 else w for i, w in enumerate(words)]
    kept = [w for i, w in enumerate(ref) if (i + key) % 5 != 0]
    return ref, ["sub7" if (i + key) % 7 == 0 else w for i, w in enumerate(kept)] + (ref[:1] * 3 if key % 11 == 0 else [])


def test_error_rates_of_whole_utterances(spark, tmp_path):
    texts = [LONG, "just one line", "", LONG + " " + LONG]
    d = _tables(spark, tmp_path, texts)
    words = {r["sample_id"]: [r[c] for c in "sdin"] for r in registry.wer_rows(spark, d).collect()}
    chars = {r["sample_id"]: (r["errors"], r["n"]) for r in registry.cer_rows(spark, d).collect()}
    for i, text in enumerate(texts):
        ref, hyp = _edited(text.split(), i * 100)
        assert words[str(i * 100)] == plain_dp(ref, hyp)
        s, dele, ins, n = plain_dp("".join(ref), "".join(hyp))
        assert chars[str(i * 100)] == (s + dele + ins, n)
    assert words["300"][3] == 80


def test_alignment_of_long_sequences():
    got = E.align_rows([["x"] * 300 + ["y"] * 32600, list("ab"), []], [["y"] * 32610, list("b"), list("cc")])
    assert got.tolist() == [[10, 290, 0, 32900], [0, 1, 0, 2], [0, 0, 2, 0]]
    r = np.random.default_rng(4)
    texts = ["".join(r.choice(list("abc é😀"), r.integers(0, 60))) for _ in range(80)]
    assert E.align_rows(texts[:40], texts[40:]).tolist() == [plain_dp(a, b) for a, b in zip(texts[:40], texts[40:], strict=True)]
