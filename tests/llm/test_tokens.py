import random
import zlib

import numpy as np
import pytest

from voxlake.llm import packing, tokens
from voxlake.llm.token_counts import cached_counts, count_tokens

from .util import DOCS, odd_documents

ALPHABET = [" ", "  ", "\n", "a", "b", "'s", "é", "▁", "<s>", "<|endoftext|>", "1", " ", " ", "漢", "!", "\t", "Don't", "\x1c", "½", "٣", "　"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    return odd_documents() + [(100 + i, "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))), "en", "a", 1) for i in range(300)]


def test_counts_are_the_library_s(spark, rows, tmp_path):
    import sentencepiece

    path = tokens.default_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    cache = str(tmp_path / "cache")
    got = count_tokens(docs, cache_path=cache, limit=20).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(sp.encode(r[1] or "")), len(sp.encode(r[1] or "")) > 20) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    stored = cached_counts(spark, cache, tokens.file_version(path))
    assert stored.count() == stored.select("digest").distinct().count() == len({r[1] or "" for r in rows})
    more = spark.createDataFrame([*rows, (5000, "new text here", "en", "a", 1)], DOCS)
    assert count_tokens(more, cache_path=cache).count() == len(rows) + 1
    assert cached_counts(spark, cache, tokens.file_version(path)).count() == len({r[1] or "" for r in rows}) + 1


def test_library_files_count_too(spark, rows):
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = tokens.default_path(name)
        lib = Tokenizer.from_file(path)
        got = count_tokens(spark.createDataFrame(rows, DOCS), path).collect()
        want = sorted((str(r[0]), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
        assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == want


def test_packing_round_trip(spark, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json"))
    for capacity in (2048, 64):
        unique = [(i, *r[1:]) for i, r in enumerate(rows)]
        got = packing.pack_documents(spark.createDataFrame(unique, DOCS).repartition(3), capacity=capacity).collect()
        by_doc, by_sequence = {}, {}
        for r in got:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_sequence.setdefault(r["sequence_id"], []).append(r)
        for r in unique:
            pieces = sorted(by_doc[r[0]], key=lambda x: x["piece"])
            ids = [i for p in pieces for i in np.frombuffer(p["ids"], "<u4").tolist()]
            assert ids == lib.encode(r[1] or "", add_special_tokens=False).ids + [0]
            assert [p["piece"] for p in pieces] == list(range(len(pieces)))
            assert [p["start"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces])[:-1].tolist()
            assert all(p["length"] == capacity for p in pieces[1:])
        for parts in by_sequence.values():
            at = 0
            for p in sorted(parts, key=lambda x: x["offset"]):
                assert p["offset"] == at
                at += p["length"]
            assert at <= capacity
        assert len(by_sequence) <= 1.02 * (sum(r["length"] for r in got) / capacity) + 2
        assert zlib.crc32(got[0]["ids"]) >= 0
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_plan_uses_every_piece_once():
    r = random.Random(4)
    for trial in range(40):
        capacity = r.choice([10, 50, 2048])
        hist = {}
        for _ in range(r.randint(0, 400)):
            x = r.randint(1, capacity) if trial % 2 else min(capacity, int(r.expovariate(5 / capacity)) + 1)
            hist[x] = hist.get(x, 0) + r.choice([1, 1, 3, 50])
        used = {}
        for pattern, n in packing.plan(hist, capacity):
            assert n > 0 and sum(a * k for a, k in pattern) <= capacity
            for a, k in pattern:
                used[a] = used.get(a, 0) + k * n
        assert used == hist
