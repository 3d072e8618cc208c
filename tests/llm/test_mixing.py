from voxlake.llm.mixing import mix

from .util import DOCS, WORD, odd_documents, varied


def levels(sizes, weights, budget, repeats=3):
    """Water-filling by hand."""
    left, level = {k: repeats * s / weights[k] for k, s in sizes.items() if s}, 0.0
    full = set()
    while left:
        open_w = sum(weights[k] for k in left if k not in full)
        spent = sum(repeats * sizes[k] for k in full)
        if not open_w:
            break
        level = (budget - spent) / open_w
        new = {k for k in left if k not in full and left[k] < level}
        if not new:
            break
        full |= new
    return {k: min(level * weights[k], repeats * s) for k, s in sizes.items()}


def check(spark, rows):
    got = mix(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(got) == len(rows)
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    order = sorted((k for k in size if k is not None), key=lambda k: k.encode()) + [k for k in size if k is None]
    weights = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    want = levels(size, weights, sum(size.values()))
    taken, biggest = dict.fromkeys(size, 0), 0
    for r in got:
        assert r["source_size"] == size[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] % max(r["size"], 1) == 0
        taken[r["source"]] += r["taken"]
        biggest = max(biggest, r["size"])
    for k in size:
        assert abs(taken[k] - want[k]) <= biggest + 1, (k, taken[k], want[k])
    assert sum(taken.values()) <= sum(size.values())
    return sorted(map(str, got))


def test_targets_and_reruns(spark):
    w = varied(3000, 2)
    rows = [(i, " ".join(w[i : i + 5 + i % 37]), "en", ["a", "b", "c", "d", None, "é"][0 if i % 3 == 0 else i % 6], 1) for i in range(900)]
    assert check(spark, rows) == check(spark, rows[::-1])


def test_small_source_is_capped(spark):
    rows = [(i, "one two three four", "en", "a" if i < 5 else "b", 1) for i in range(200)]
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, odd_documents())
    assert mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mix(spark.createDataFrame([(1, None, None, None, None)], DOCS)).first()["taken"] == 0
