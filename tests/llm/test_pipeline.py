import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from voxlake.llm import tokens

from .util import WORD, varied

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def small_corpus(path, spark):
    passage = varied(80, 1)
    rows = []
    for i in range(160):
        w = varied(90 + i % 60, 500 + i)
        if i % 5 == 0:
            rows.append((i, " ".join(x.upper() + "!!" for x in w), "en", "s0", 1))
        elif i % 16 == 1:
            rows.append((i, " ".join(w[:40] + passage + w[40:]), "en", "s1", 1))
        else:
            rows.append((i, " ".join(w) + ".", "en", f"s{i % 3}", 1))
    rows += [(200 + k, rows[2][1], "en", "s2", 1) for k in range(4)] + [(210, rows[3][1] + " tail", "en", None, 1)]
    labels = [(i, 0 if i % 5 == 0 else 1, 0) for i in range(160)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, passage


def test_stages_take_effect(spark, tmp_path):
    rows, passage = small_corpus(str(tmp_path), spark)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = docs.collect()
    ids = {n: [r["doc_id"] for r in s] for n, s in seen.items()}
    good = {r[0] for r in rows if r[0] % 5 or r[0] >= 200}
    assert set(ids["quality_classifier"]) == good
    assert set(ids["minhash_near_dedup"]) == {i for i in good if i < 200}
    holders = [r["doc_id"] for r in seen["substring_dedup"] if " ".join(passage[10:70]) in r["text"]]
    assert len(holders) == 1 and set(ids["substring_dedup"]) == {i for i in good if i < 200}
    sizes = {r["doc_id"]: len(WORD.findall(r["text"])) for r in seen["substring_dedup"]}
    assert max(ids["mixing"].count(i) for i in sizes) <= 3
    assert abs(sum(sizes[i] for i in ids["mixing"]) - sum(sizes.values())) <= max(sizes.values())
    lib = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json"))
    want = sorted(len(lib.encode(r["text"], add_special_tokens=False).ids) + 1 for r in seen["mixing"])
    assert sum(want) == sum(r["length"] for r in seen["best_fit_packing"])
    assert all(len(np.frombuffer(r["ids"], "<u4")) == r["length"] for r in seen["best_fit_packing"])


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_leave_only_what_their_rows_are_made_of(spark, tmp_path):
    import os

    from voxlake import storage

    small_corpus(str(tmp_path), spark)
    folder = f"{storage.shared_dir(spark)}/voxlake"
    names = lambda: sorted(x.rsplit("-", 1)[0] for x in os.listdir(folder))
    before, docs = names() if os.path.isdir(folder) else [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(P.STAGES[:4]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/left{k}")
        docs = spark.read.parquet(f"{tmp_path}/left{k}")
    left = names()
    for x in before:
        left.remove(x)
    assert left == ["classes", "cuts", "passages", "taken", "touched"]
    rows = P.run(spark, str(tmp_path))
    assert rows.count() > 0 and len(names()) == len(before) + len(left) + 1
