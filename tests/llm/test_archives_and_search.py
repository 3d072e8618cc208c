import hashlib

import numpy as np

from voxlake.llm import topk, warc

PAGES = "page_id long, url string, html string, digest string"


def test_archives_round_trip(spark, tmp_path):
    long = "<p>é漢</p>" * 20_000
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 5
    rows = [
        (1, "http://a.b/c d?x=\n1", long, "x"), (2, "http://a.b/2", long, "x"), (5, "http://a.b/5", tricky, "x"), (4, None, tricky, None), (6, "http://a.b/6", "short", "x"), (7, "http://a.b/7", "short", "x"),
        (8, "http://a.b/8", None, "x"), (9, "http://a.b/9", "", "x"), (None, "http://a.b/n", "unique " * 30, "x"), (10, "http://a.b/10", "z" * 99, "x"), (11, "http://a.b/10", "z" * 99, "x"),
        (13, "http://a.b/13", "y" * 100, "x"), (12, "http://a.b/13", "y" * 100, "x"), (12, "http://a.b/13", "y" * 100, "x"),
    ]
    path = str(tmp_path / "archives")
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3), path).collect()
    first = {}
    for i, _, html, _ in rows:
        if i is not None and html and len(html.encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    want = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        to = first.get(html) if html in first and i != first[html] else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    records = warc.read_archives(spark, path)
    nested = warc.assemble(records).collect()
    assert len(nested) == len(rows)
    for r in nested:
        assert len(r["requests"]) == len(r["metadata"]) == 1
        assert r["requests"][0]["http_header"].startswith("GET /")
        if r["response"]["type"] == "response":
            assert "sha256:" + hashlib.sha256(bytes(r["response"]["payload"])).hexdigest() == r["response"]["payload_digest"]
    assert warc.round_trip(spark.createDataFrame([], PAGES), str(tmp_path / "none")).count() == 0


def test_orphans_are_kept(spark):
    rows = [("r1", "request", ["gone"], "u", None, None, None, 0, "GET /", b""), ("x", "response", [], "u", None, None, None, 0, None, b"p")]
    got = warc.assemble(spark.createDataFrame(rows, warc.RECORD_SCHEMA)).collect()
    assert {(r["capture_id"], r["response"] is None) for r in got} == {("gone", True), ("x", False)}


VECTORS = "vec_id long, embedding array<float>, score long"


def by_hand(rows, k):
    clean = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(np.float64))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for qi, q in clean:
        if qi % 50 == 0:
            found = sorted((-int(q @ x), i) for i, x in clean if i != qi and len(x) == len(q))[:k]
            out |= {(qi, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


def test_search_matches_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=20).tolist()) for i in range(300)] + [(1000 + i, rows_) for i, rows_ in enumerate([[1.0] * 20] * 40)]
    rows += [(2000, None), (2001, [None] * 20), (2050, [float("nan")] * 20), (2100, [float("inf")] * 20), (None, [1.0] * 20), (2150, [0.5, 0.5]), (2151, [0.25, -3.0]), (2200, []), (2250, [1e7] * 20)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).repartition(3)
    got = {tuple(x) for x in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == by_hand(rows, 5)
    empty = spark.createDataFrame([], VECTORS)
    assert topk.top_k(empty, empty).count() == 0


def test_bounds_hold_at_every_level():
    r = np.random.default_rng(6)
    q, x = r.normal(size=(7, 50)) * 100, r.normal(size=(30, 50)) * 100
    exact, before = q @ x.T, None
    for level in topk.LEVELS:
        bound = topk.segment_statistics(q, level) @ topk.segment_statistics(x, level).T
        assert (bound >= exact - 1e-6).all()
        assert before is None or bound.mean() <= before + 1e-6
        before = bound.mean()


def test_large_scores_are_exact():
    q, x = np.array([[2.0**40, 3.0]]), np.array([[2.0**22, 1.0], [2.0**40, 1.0]])
    assert topk.exact_scores(q, x).tolist() == [[2**62 + 3, 2**63 - 1]]
