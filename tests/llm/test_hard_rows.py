"""Rows that are hard on single operators: null and shared ids, huge numbers, characters of all kinds."""

import hashlib
from collections import Counter, defaultdict

import numpy as np

from lumentrace.llm import queries, rotated_codes, warc_store


def test_archive_of_any_url_and_null_ids(spark, tmp_path):
    big = "ü" * 700
    rows = [(1, "http://x.com/é?日本=\U0001f600", big), (None, "http://x.com/ß", big), (3, "http://x.com/%C3%A9", big), (None, None, "only null"), (None, "u", "z" * 1500), (6, "é" * 3000, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc_store.read_archive(*warc_store.write_archive(pages)).collect()
    want = Counter()
    for i, u, h in rows:
        revisit = h == big and i != 3
        want[None if i is None else str(i), u, hashlib.sha1(h.encode()).hexdigest(), len(h.encode()), "revisit" if revisit else "response", "3" if revisit else None] += 1
    assert Counter((r.id, r.url, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to) for r in got) == want
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    assert Counter(r.page_id for r in queries.op3_content_addressed_warc(spark, str(tmp_path)).collect()) == Counter([1, 3, 6, None, None, None])
    odd = spark.createDataFrame([("a>b\r", "u", big), ("null", "u", big), (None, "u", big), ("", "u", "s")], pages.schema.simpleString().replace("struct<", "").replace(">", "").replace("page_id:bigint", "page_id:string"))
    assert Counter(r.id for r in warc_store.read_archive(*warc_store.write_archive(odd)).collect()) == Counter(["a>b\r", "null", None, ""])


def brute(rows, wanted, k):
    """(query id, its vector) -> [(score, id)] of the k best."""
    out = {}
    for i, v in wanted:
        cand = [(-float(np.dot(np.array(v), np.array(w))), (j is None, j), j) for j, w in rows if len(w) == len(v) and j != i]
        out[i, tuple(v)] = [(-s, j) for s, _, j in sorted(cand, key=lambda c: c[:2])[:k]]
    return out


def searched(spark, rows, wanted, kind="long", **kw):
    d = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], f"vec_id {kind}, embedding array<double>")
    index, cells = rotated_codes.build_index(d, block=kw.get("vector_block", rotated_codes.VECTOR_BLOCK))
    got = defaultdict(list)
    for r in rotated_codes.nearest(index, index.where(wanted), cells, **kw).collect():
        got[r.query_id].append((r["rank"], r.score, r.vec_id))
    return {i: sorted(v) for i, v in got.items()}


def test_search_of_huge_vectors_and_null_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(16) * 3e38).tolist()) for i in range(59)] + [(None, (rng.standard_normal(16) * 3e38).tolist()) for _ in range(3)]
    got = searched(spark, rows, "id % 20 = 0")
    want = brute(rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0], 20)
    assert {i: [x for _, _, x in v] for i, v in got.items()} == {i: [j for _, j in v] for (i, _), v in want.items()}
    tiny = [(i, (rng.standard_normal(8) * 1e-200).tolist()) for i in range(40)] + [(i, (rng.standard_normal(8) * 1e150).tolist()) for i in range(40, 80)]
    assert all(len(v) == 20 for v in searched(spark, tiny, "id % 20 = 0").values())
    named = [(f"v{i}", v) for i, v in rows[:59]]
    assert {len(v) for v in searched(spark, named, "id like '%0'", "string").values()} == {20}


def test_search_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(5)
    rows = [(i // 2, rng.standard_normal(6).tolist()) for i in range(80)]
    got = searched(spark, rows, "id = 20", k=5)
    want = brute(rows, [r for r in rows if r[0] == 20], 5)
    assert sorted((round(s, 9), j) for _, s, j in got[20]) == sorted((round(s, 9), j) for v in want.values() for s, j in v)


def test_cells_that_hold_no_near_vector_are_not_met(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((12, 24)) * 4
    rows = [(i, (base[i % 12] + rng.standard_normal(24) * 0.3).tolist()) for i in range(2400)] + [(5000 + i, base[0].tolist()) for i in range(400)]
    small = dict(vector_block=200, query_block=50)
    got = searched(spark, rows, "id % 100 = 0 and id < 2400", **small)
    want = brute(rows, [r for r in rows if r[0] % 100 == 0 and r[0] < 2400], 20)
    for (i, _), v in want.items():
        assert np.allclose([s for _, s, _ in got[i]], [s for s, _ in v]) and [j for _, _, j in got[i]] == [j for _, j in v]
    d = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    index, cells = rotated_codes.build_index(d, block=200)
    stats = {(r.dim, r.cell): r.r for r in index.groupBy("dim", "cell").agg({"length": "max"}).withColumnRenamed("max(length)", "r").collect()}
    from pyspark.sql import functions as F

    q = index.where("id % 100 = 0 and id < 2400").select("id", "dim", "vector", F.xxhash64("id").alias("i"))
    assert len(stats) >= 10 and rotated_codes._met_cells(q, cells, stats, 20).count() < 0.6 * q.count() * len(stats)
