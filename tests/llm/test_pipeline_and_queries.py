"""The registered queries on the smallest tables, and the pipeline's stages against what their operators say."""

import hashlib
import importlib
import os
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumentrace.llm import decontaminate, shingle_dedup, toxicity
from lumentrace.llm.queries import ORACLES, QUERIES


def test_all_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES} and set(QUERIES) | {"pipeline"} <= set(names)


def test_url_query_matches_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf}/pages.parquet')")
    cur = con.execute(ORACLES["op2_template_tree"])
    cols = [c[0] for c in cur.description]
    df = QUERIES["op2_template_tree"](spark, sf)
    want = sorted((tuple(v for _, v in sorted(zip(cols, r))) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_covers_its_table(spark, sf, name):
    df = QUERIES[name](spark, sf)
    n = df.count()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    pages = spark.read.parquet(f"{sf}/pages.parquet").count()
    convs = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    vecs = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").count()
    want = {"op1": docs, "op2": pages, "op3": pages, "op4": docs, "op5": docs, "op7": docs, "op8": docs, "op9": convs + 1, "op10": 20 * vecs, "op11": docs}.get(name.split("_")[0])
    assert n == want if want else n >= (docs if name.startswith("op6") else 100)


def test_contract_of_op8(spark, sf):
    rows = {r.doc_id: r for r in QUERIES["op8_winnowing"](spark, sf).collect()}
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = split(r.text)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[k : k + 13])].add(str(r.item_id))
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w, hit, items = split(r.text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[k]
        got = rows[r.doc_id]
        assert (got.n_words, got.n_hit, got.n_items, got.items_sha256) == (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())


def classes_by_brute_force(rows):
    """The least id of each class over all pairs of sets of 5-word shingles at 0.8."""
    sets = {i: frozenset(shingle_dedup.shingles(t).tolist()) for i, t in sorted(rows)}
    up = {i: i for i in sets}

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (a == b or 0.8 * max(len(a), len(b)) <= min(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {root(i) for i in sets}


def test_columns_of_any_name_stay_and_files_go(spark, sf):
    extra = ["_rk", "_text", "_key", "removed_lines", "id", "rk", "row", "i", "k", "score", "a.b", "q`x", "c0"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").drop("n_chars")
    docs = docs.select("*", *[F.col("doc_id").alias(c) for c in extra])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert out.columns == docs.columns and rows and all(r[c] == r.doc_id for r in rows for c in extra)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "x", 0)], docs.schema))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert set(after) == {r.doc_id for r in toxicity.score(docs, model, "text", "doc_id").collect() if r.score < 0.5}
        if name == "line_dedup":
            assert set(after) == set(before) and after[90001].text is None and all(r.n_chars == len(r.text) for r in after.values() if r.text and r.text != before[r.doc_id].text)
        if name == "simhash_near_dedup":
            kept = classes_by_brute_force([(r.doc_id, r.text) for r in before.values()])
            assert set(after) == kept and len(kept) < len(before)
        if name == "benchmark_decontamination":
            bad = {r.id for r in decontaminate.judged(*decontaminate.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))).where("contaminated").collect()}
            assert set(after) == set(before) - bad
        if name != "line_dedup":
            assert all(after[k] == before[k] for k in after)
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and os.path.exists(f"{sf}/documents.parquet")
