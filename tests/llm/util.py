"""Small fixtures that every operator must bear."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def varied(n, seed=0):
    """n distinct invented words."""
    import random

    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)]


def odd_documents():
    long_text = " ".join(varied(20000, 3))
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", None, 0),
        (3, " \n\t ", None, "b", 3),
        (4, long_text, "en", "a", len(long_text)),
        (5, "same words here " * 400, "en", "a", 1),
        (6, BASE, "en", "b", 1),
        (6, BASE, "en", "b", 1),
        (7, "É nbsp  wide sep ▁low ∑∂ 漢字 😀 end ", "xx", "c", 1),
        (None, BASE, "en", "a", 1),
        (8, "line one two\nline one two\n\n\nother # $ % line\nline one two", "en", "a", 1),
        (9, "a <|endoftext|> b <s> </s> 'll don't  two  spaces \r\n x\u0085y", "en", "a", 1),
        (10, " ".join(varied(120, 5)), None, None, None),
        (11, "▁", "en", "a", 1),
        (12, " ", "en", "a", 1),
        (13, "tail space ", "en", "a", 1),
    ]
    return rows
