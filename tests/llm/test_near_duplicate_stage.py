"""The near-duplicate stage against brute force."""

import numpy as np

import corpus_pipeline
from lumentrace.llm import shingle_dedup


def test_near_copies_of_five_word_shingles_go(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(12):
        text = list(rng.choice(words, 200))
        rows.append((4 * i, " ".join(text)))
        for k in (1, 3, 8):  # edits far apart: similarity about 0.95, 0.86 and 0.66
            edited = list(text)
            for at in range(k):
                edited[20 + at * 20] = f"new{i}x{k}x{at}"
            rows.append((4 * i + (1, 3, 8).index(k) + 1, " ".join(edited)))
    rows += [(90, ""), (91, None), (92, "one two"), (93, "One  two")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    s = {i: set(shingle_dedup.shingles(t).tolist()) for i, t in rows}
    part = {i: i for i in s}

    def root(i):
        return i if part[i] == i else root(part[i])

    for i in s:
        for j in s:
            if i < j and (s[i] == s[j] or len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])):
                a, b = sorted((root(i), root(j)))
                part[b] = a
    got = {r.doc_id for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()}
    assert got == {root(i) for i in s} and 4 * 12 > len(got) > 12


def test_null_and_shared_ids_keep_one_row_of_each_class(spark):
    a, b, c, d = (" ".join(f"{n}{i}" for i in range(50)) for n in "abcd")
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, c), (1, c), (1, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(None, a), (None, b), (1, c), (1, d)], key=str)
    shared = spark.createDataFrame([(1, a, "en", "s", 9), (0, b, "en", "s", 9), (1, b, "en", "s", 9)], docs.schema)
    assert {(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_near_duplicates(spark, shared, "").collect()} == {(1, a), (0, b)}
