import random

import numpy as np
import pyarrow as pa

from voxlake.llm import near_dedup as N
from voxlake.llm.components import connected_components

from .util import DOCS, WORD, odd_documents, varied


def bag(text):
    w = WORD.findall(text or "")
    out = {}
    for s in [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []):
        out[s] = out.get(s, 0) + 1
    return out


def similar(a, b):
    """The larger of plain and probability Jaccard similarity, each by its definition."""
    union, both = set(a) | set(b), set(a) & set(b)
    if not both:
        return 0.0
    bags = 0.0
    if max(a.values()) > 1 or max(b.values()) > 1:
        bags = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in union) for d in both)
    return max(len(both) / len(union), bags)


def classes(rows):
    by_id = {}
    for r in rows:
        if r[0] is not None:
            by_id.setdefault(r[0], r[1])
    ids = sorted(by_id)
    bags = {i: bag(by_id[i]) for i in ids}
    where = {}
    for i in ids:
        for s in bags[i]:
            where.setdefault(s, []).append(i)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in {(a, b) for group in where.values() for k, a in enumerate(group) for b in group[k + 1 :]}:
        if find(a) != find(b) and similar(bags[a], bags[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def planted(seed=3):
    r = random.Random(seed)
    rows = []
    for g in range(12):
        base = varied(r.randint(40, 200), 100 + g)
        for c in range(r.randint(1, 9)):
            words = list(base)
            for _ in range(c % 4):
                words[r.randrange(len(words))] = f"edit{g}x{c}"
            rows.append((g * 100 + c, " ".join(words), "en", "a", 1))
    # A chain: neighbours are similar, the ends are not.
    base = varied(300, 55)
    for c in range(12):
        rows.append((5000 + c, " ".join(base[c * 12 : c * 12 + 150]), "en", "a", 1))
    r.shuffle(rows)
    return rows


def test_classes_match_brute_force(spark):
    rows = planted() + [(None if r[0] is None else r[0] + 9000, *r[1:]) for r in odd_documents()]
    got = N.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(got) == len(rows)
    want = classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got if r["doc_id"] is not None)
    assert all(r["class_id"] is None and r["kept"] for r in got if r["doc_id"] is None)


def test_bag_similarity_and_its_bound(spark):
    r = random.Random(7)
    rows = []
    for i in range(40):
        line = varied(9, r.randint(1, 3))
        words = [w for k in range(r.randint(0, 12)) for w in line] + varied(r.randint(5, 60), r.randint(1, 4)) + varied(r.randint(0, 8), i)
        rows.append((i, " ".join(words)))
    table, bits = np.full(1, np.uint64(0xFFFFFFFFFFFFFFFF)), 64
    facts = {x["id"]: x for x in N.features(spark.createDataFrame(rows, "id long, text string"), table, bits).collect()}
    arrays = {i: (np.frombuffer(x["s"], "<u8"), np.frombuffer(x["c"], "<u4")) for i, x in facts.items()}
    df = spark.createDataFrame(list(facts.values())).withColumn("w", N.F.length("c") > 0).drop("s", "c")
    may = {(x["a"], x["b"]) for x in df.alias("x").join(df.alias("y"), N.F.col("x.id") > N.F.col("y.id")).where(N.may_be_similar(0.8)).select(N.F.col("x.id").alias("a"), N.F.col("y.id").alias("b")).collect()}
    hits = 0
    for i, t in rows:
        for j, u in rows[:i]:
            want = similar(bag(t), bag(u)) >= 0.8
            assert N.similar(*arrays[i], *arrays[j], 0.8) == want
            assert not want or (i, j) in may
            hits += want
    assert 0 < hits <= len(may) < 40 * 39 / 2


def test_hot_bucket_is_split_and_loses_nothing(spark, monkeypatch):
    """A third of the texts share a long line and little else; some pairs among them are similar."""
    monkeypatch.setattr(N, "MINORITY", 4)
    line, rows = varied(60, 1), []
    for i in range(150):
        own = varied(40, 100 + i)
        rows.append((2 * i, " ".join(line + own), "en", "a", 1))
        if i % 5 == 0:
            rows.append((2 * i + 1, " ".join(line + own[:38] + [f"x{i}", f"y{i}"]), "en", "a", 1))
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == classes(rows)


def test_one_id_with_two_texts_and_clashing_columns(spark):
    a, b = " ".join(varied(80, 1)), " ".join(varied(80, 2))
    schema = "doc_id long, text string, id long, digest string, node long, _slot int, key long, class_id int"
    extra = (1, "x", 2, 3, 4, 5)
    got = [tuple(sorted((r["doc_id"], r["class_id"]) for r in N.near_duplicates(spark.createDataFrame(rows, schema)).collect())) for rows in (
        [(1, a, *extra), (1, b, *extra), (2, a, *extra), (3, b, *extra)], [(3, b, *extra), (1, b, *extra), (2, a, *extra), (1, a, *extra)],
    )]
    assert got[0] == got[1] and got[0] in {((1, 1), (1, 1), (2, 1), (3, 3)), ((1, 1), (1, 1), (2, 2), (3, 1))}


def test_empty_tables(spark):
    assert N.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert N.near_duplicates(spark.createDataFrame([(1, None, None, None, None)], DOCS)).first()["class_id"] == 1


def test_registers_estimate_probability_jaccard():
    a = " ".join(varied(400, 1))
    b = " ".join(varied(400, 1)[:330] + varied(70, 9))
    c = " ".join((varied(40, 4) * 5) + varied(100, 6))
    h, first = N.shingles(pa.array([a, b, c, c.replace(varied(100, 6)[50], "zz")]))
    doc, h, w = N.weighted(h, first)
    got = N.prob_min_hash(doc, h, w, 4, 4000)
    for i, (x, y) in enumerate([(a, b), (c, c.replace(varied(100, 6)[50], "zz"))]):
        share = (got[2 * i] == got[2 * i + 1]).mean()
        p, q = bag(x), bag(y)
        union = set(p) | set(q)
        want = sum(1 / sum(max(p.get(e, 0) / p[d], q.get(e, 0) / q[d]) for e in union) for d in set(p) & set(q))
        assert abs(share - want) < 0.04


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(3, 3), (200, 8)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {100, 7} and got[140] == 100 and got[200] == 7
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
