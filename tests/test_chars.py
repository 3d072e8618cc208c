"""The array kernels against plain regular expressions, on odd characters."""

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa

from voxlake.functions import chars as C
from voxlake.functions import text as X
from voxlake.functions import unicode as U


def _class(ranges):
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)


SPACE, MARKS, ARABIC, DIGITS = (_class(r) for r in (U.SPACE_RANGES, (*U.MARK_RANGES, (U.TATWEEL, U.TATWEEL)), U.arabic_ranges(), U.digit_ranges()))
ODD = "aZ9 \t\n\x1f\x85\xa0 　éßـًٰبتﻻﷲ٣۴५𝟜😀ﬁ½._-,\x00﻿ࢗ"


def _texts(n=400):
    rng = random.Random(5)
    return [None if i % 17 == 3 else "".join(rng.choice(ODD) for _ in range(rng.choice((0, 1, 2, 9, 40)))) for i in range(n)] + ["plain ascii  text ", ""]


def _fold(t):
    kept = re.sub(f"[^A-Za-z{DIGITS}{ARABIC}]+", " ", re.sub(f"[{MARKS}]", "", t))
    return "".join(c.lower() if c.isascii() else c for c in kept).strip(" ")


def test_normal_forms(spark, monkeypatch):
    for size in (C._BYTES, 64):
        monkeypatch.setattr(C, "_BYTES", size)
        texts = _texts()
        for column in (pa.array(texts), pa.array(["x", *texts]).slice(1), pa.array([t for t in texts if t is None or t.isascii()])):
            rows = column.to_pylist()
            nfkc = [None if t is None else unicodedata.normalize("NFKC", t) for t in rows]
            got = C.mapped(column, lambda t, valid: C.fold(C.nfkc(t)).arrow(valid), pa.string())
            got.validate(full=True)
            assert got.to_pylist() == [None if t is None else _fold(t) for t in nfkc]
            got = C.mapped(column, lambda t, valid: C.normalize_raw(t).arrow(valid), pa.string())
            assert got.to_pylist() == [None if t is None else re.sub(f"[{SPACE}]+", " ", t).strip(" ") for t in rows]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(_texts())], "i long, t string").orderBy("i")
    assert [r[0] for r in df.select(X.audit_normalize(df.t)).collect()] == [None if t is None else _fold(unicodedata.normalize("NFKC", t)) for t in _texts()]


def test_counts():
    texts = _texts()
    kind = {"arabic": f"[{ARABIC}]", "english": "[A-Za-z]", "digits": f"[{DIGITS}]", "symbols": f"[^A-Za-z{SPACE}{DIGITS}{ARABIC}]"}
    got = C.mapped(pa.array(texts), lambda t, valid: C.struct(C.character_counts(t), valid), pa.null()).to_pylist()
    assert got == [None if t is None else {k: len(re.findall(p, t)) for k, p in kind.items()} for t in texts]
    got = C.mapped(pa.array(texts), lambda t, valid: C.struct(C.token_stats(t), valid), pa.null()).to_pylist()
    for t, g in zip(texts, got, strict=True):
        if t is None:
            assert g is None
            continue
        tokens = [x for x in t.split(" ") if x]
        kinds = [(bool(re.search(f"[{ARABIC}]", x)), bool(re.search("[A-Za-z]", x)), len(x) > 1) for x in tokens]
        assert g == {
            "token_count": len(tokens), "ar_only": sum(a and not b for a, b, _ in kinds), "en_only": sum(b and not a for a, b, _ in kinds), "mixed": sum(a and b for a, b, _ in kinds),
            "other": sum(not a and not b for a, b, _ in kinds), "en_only_meaningful": sum(b and not a and c for a, b, c in kinds),
        }


def test_broken_utf8_is_replaced():
    column = pa.StringArray.from_buffers(2, pa.py_buffer(np.array([0, 3, 5], np.int32).tobytes()), pa.py_buffer(b"a\xffb\xc3\xa9"))
    assert [s for t, _ in C.texts(column) for s in t.strings()] == ["a�b", "é"]


def test_bigrams():
    texts = [t or "" for t in _texts()]
    for t, valid in C.texts(pa.array(texts)):
        pairs, at = C.bigrams(t)
        rows = [[chr(p >> 21) + chr(p & 0x1FFFFF) for p in pairs[a:b]] for a, b in zip(at[:-1], at[1:], strict=True)]
        assert [sorted(r) for r in rows] == [sorted({s[k : k + 2] for k in range(len(s) - 1)}) for s in t.strings()] and len(valid) == len(rows)


def test_multisets_and_phrases(monkeypatch):
    rng = random.Random(2)
    lists = [None if i % 19 == 4 else [rng.choice(["a", "b", "c", None]) for _ in range(rng.choice((0, 1, 3, 6, 14)))] for i in range(300)]
    others = lists[7:] + lists[:7]
    for size in (C._ITEMS, 20):
        monkeypatch.setattr(C, "_ITEMS", size)
        common, surplus, thrice = [], [], []
        for sides, _ in C.lists(pa.array(lists), pa.array(others)):
            n, more = C.shared(*sides)
            common, surplus, thrice = common + n.tolist(), surplus + more.tolist(), thrice + C.thrice(*sides[0], 4).tolist()
        bag = lambda x: Counter(t for t in x or [] if t is not None)
        assert common == [sum((bag(a) & bag(b)).values()) for a, b in zip(lists, others, strict=True)]
        assert surplus == [bool(bag(a) - bag(b)) for a, b in zip(lists, others, strict=True)]
        same = lambda x, i, w: x[i : i + w] == x[i + w : i + 2 * w] == x[i + 2 * w : i + 3 * w]
        assert thrice == [any(same(x or [], i, w) for w in range(1, 5) for i in range(len(x or []) - 3 * w + 1)) for x in lists]


def test_words():
    texts = ["a  b", "", None, " é ", "one"]
    assert C.words(pa.array(["x y", *texts]).slice(1)).to_pylist() == [["a", "b"], [], [], ["é"], ["one"]]


def test_long_batches_are_aligned_in_slices(spark, monkeypatch):
    """Lists of a whole batch as objects of Python took most of a worker's memory."""
    from voxlake.functions import align as E

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "bb", "كلمة", "😀"]) for _ in range(rng.choice((0, 1, 7, 30)))) for _ in range(1300)]
    want = E.align_rows([t.split() for t in texts], [t.split() for t in texts[::-1]])
    chars = E.align_rows([t.replace(" ", "") for t in texts], [t.replace(" ", "") for t in texts[::-1]])
    seen = []
    monkeypatch.setattr(E, "align_flat", lambda a, b, f=E.align_flat: seen.append(len(a[0])) or f(a, b))
    monkeypatch.setattr(C, "_ITEMS", 2000)
    got = E._align_words.func(pa.array(texts), pa.array(texts[::-1])).to_pylist()
    assert [list(r.values()) for r in got] == want.tolist() and len(seen) > 10 and max(seen) <= 2000
    got = E._align_characters.func(pa.array(texts), pa.array(texts[::-1])).to_pylist()
    assert [list(r.values()) for r in got] == chars.tolist()


def test_a_pass_costs_the_same_for_any_class():
    """Regular expressions took 3 microseconds of a core a character (96 s on these); look-ups must stay far below."""
    import time

    text = pa.array([("ordinary words and كلمات و أرقام 123 " * 30) for _ in range(30_000)])
    began = time.process_time()
    C.mapped(text, lambda t, valid: C.struct(C.token_stats(C.fold(C.nfkc(t))), valid), pa.null())
    assert time.process_time() - began < 30


def test_workers_need_no_pandas():
    import os
    import subprocess
    import sys

    code = (
        "import sys, numpy as np, pyarrow as pa; from voxlake.functions import text as X, align as E; s = 'a b aé ١'.encode();"
        "a = pa.StringArray.from_buffers(2, pa.py_buffer(np.array([0, 5, len(s)], np.int32).tobytes()), pa.py_buffer(s));"
        "n = X._audit_normalize.func(a); w = X.C.words(n); X._token_stats.func(n); X._character_counts.func(a); X._bigram_numbers.func(a); X._common_count.func(w, w);"
        "X._has_surplus.func(w, w); X._thrice(4).func(w); E._align_words.func(n, n); E._align_characters.func(n, n); assert 'pandas' not in sys.modules"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
