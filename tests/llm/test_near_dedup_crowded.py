from voxlake.llm import near_dedup as N

from .test_near_dedup import bag, similar
from .util import DOCS, varied


def test_pairs_in_crowded_buckets_are_not_lost(spark):
    """All texts share a line and are at 0.75 to each other, so that they fill the buckets; pairs among them are at 0.8."""
    line, rows = varied(90, 1), []
    for i in range(250):
        own = varied(14, 100 + i)
        rows += [(2 * i, " ".join(line + own), "en", "a", 1), (2 * i + 1, " ".join(line + own[:3] + varied(11, 5000 + i)), "en", "a", 1)]
    assert similar(bag(rows[0][1]), bag(rows[2][1])) < 0.8 <= similar(bag(rows[0][1]), bag(rows[1][1])) < 0.81
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: i - i % 2 for i in range(500)}


def test_prefixes_against_all_pairs(spark):
    """Every similar pair of texts, by sets or by bags, meets by its prefixes."""
    lines = [varied(14, k) for k in range(3)]
    rows = [(i, " ".join([w for k in range(1 + i % 3) for w in lines[k]] * (1 + i % 4) + varied(16 + i % 5, 50 + i // 6) + varied(i % 4, 500 + i))) for i in range(120)]
    table, bits = N.np.full(1, N.np.uint64(0xFFFFFFFFFFFFFFFF)), 64
    facts = N.written(N.features(spark.createDataFrame(rows, "id long, text string"), table, bits), "facts")
    labels = facts.select(N.F.col("id").alias("node"), N.F.col("id").alias("label"))
    got = {(r["a"], r["b"]) for r in N._pairs_by_prefix(facts, labels, 0.8).collect()}
    bags = {i: bag(t) for i, t in rows}
    want = {(i, j) for i in bags for j in range(i) if similar(bags[i], bags[j]) >= 0.8}
    only_bags = {(i, j) for i, j in want if len(bags[i].keys() & bags[j].keys()) < 0.8 * len(bags[i].keys() | bags[j].keys())}
    assert want <= got and len(want) > 40 and len(only_bags) > 5 and len(got) < 120 * 119 / 4
