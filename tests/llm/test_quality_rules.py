from collections import Counter

from voxlake.llm.quality_rules import repetition_rules

from .util import DOCS, WORD, odd_documents, varied


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)

    def covered(n):
        c = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        hit = set()
        for i in range(len(words) - n + 1):
            if c[tuple(words[i : i + n])] > 1:
                hit |= set(range(i, i + n))
        return hit

    rep = len(covered(3))
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup,
        "n_repeat_words": rep,
        "base_failed": len(words) < 50 or 100 * rep > 50 * len(words),
        **{f"dup_chars_{n}": sum(len(words[i]) for i in covered(n)) for n in (5, 7, 10)},
    }


def test_matches_brute_force(spark):
    w = varied(300, 1)
    rows = odd_documents() + [(20 + i, " ".join(w[j % (7 + 11 * i)] for j in range(260)), "en", "a", 1) for i in range(12)]
    got = repetition_rules(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(got) == len(rows)
    key = lambda x: (str(x[0]), x[1])
    want = sorted(((r[0], sorted(brute(r[1]).items())) for r in rows), key=lambda x: (str(x[0]), str(x[1])))
    have = sorted(((r["doc_id"], sorted((k, r[k]) for k in brute(""))) for r in got), key=lambda x: (str(x[0]), str(x[1])))
    assert want == have
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert repetition_rules(empty).count() == 0
    clash = spark.createDataFrame([(1, "x y z", 3, "q")], "doc_id long, text string, n_words long, kept string")
    assert repetition_rules(clash).first()["n_words"] == 3


def test_words_of_a_regular_pattern_differ(spark):
    """The Thue-Morse word and its complement, which a polynomial hash modulo a power of two can't tell apart."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from voxlake.llm import textops as X
    from voxlake.llm import tokens
    from voxlake.llm.packing import tokenized_pieces

    word = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    for n in (2048, 1024, 256, 64):
        w = X.words(*X.buffers(pa.array([f"{word[:n]} {other[:n]}"])))
        assert w.hash[0] != w.hash[1]
    docs = spark.createDataFrame([(1, f"x {word}"), (2, f"x {other}"), (3, f"{word} {other} " * 3)], "doc_id long, text string").coalesce(1)
    lib = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json"))
    for r in tokenized_pieces(docs).orderBy("doc_id", "piece").collect():
        want = [*lib.encode(docs.where(f"doc_id = {r['doc_id']}").first()["text"], add_special_tokens=False).ids, 0]
        assert list(memoryview(r["ids"]).cast("I")) == want[r["start"] : r["start"] + r["length"]]
