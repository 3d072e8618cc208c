from voxlake.llm import near_dedup as N

from .test_near_dedup import bag, similar
from .util import DOCS, varied


def test_pages_that_repeat_a_menu_meet_those_that_do_not(spark):
    rows = []
    for g in range(60):
        base, menu = varied(210, 10_000 + g), varied(100, 20_000 + g)
        edited = list(base)
        for k in range(6):
            edited[10 + 33 * k] = f"edit{g}x{k}"
        a, b = " ".join(base + menu * 16), " ".join(edited + menu)
        assert 0.8 <= similar(bag(a), bag(b)) < 0.82
        rows += [(2 * g, a, "en", "a", 1), (2 * g + 1, b, "en", "a", 1)]
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: i - i % 2 for i in range(120)}
