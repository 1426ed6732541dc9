"""Spelling variants against all pairs: the same links, forms and roots, with the words in one block and in many."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumentrace.llm import queries, spelling_variants as sv


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = sv.common(a, b)
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def brute(counts):
    out, form = {}, {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_edit(w, v))
        good = near and -near[0][0] >= 2 * n
        form[w] = near[0][1] if good else None
        out[w] = [form[w], n, len(near), -near[0][0] if good else None]
    for w in out:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w].insert(1, root)
    return {w: tuple(v) for w, v in out.items()}


def found(spark, counts, **kw):
    got = sv.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), **kw).collect()
    assert len(got) == len({r.word for r in got})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


@pytest.mark.parametrize("letters,longest,count", [("ab", 7, 150), ("abcé", 5, 250), ("abcdefgh", 4, 300)])
def test_same_as_all_pairs(spark, letters, longest, count):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(0, longest + 1))) for _ in range(count)} | {"a" * 30, "a" * 31, "a" * 29 + "b"}
    counts = {w: rng.choice([1, 2, 3, 4, 8, 20, 100]) for w in words}
    want = brute(counts)
    assert found(spark, counts) == want
    for block in (3, 16):
        assert found(spark, counts, block=block) == want


def test_each_pair_is_met_once_and_paths_are_short():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(2000)})
    written = Counter(i for lo, hi, _, _ in sv.light_edges(words, []) for i in range(lo, hi))
    assert max(written.values()) <= len(words).bit_length()
    met = Counter()
    where = {w: i for i, w in enumerate(words)}
    group = {}
    for lo, hi, depth, heavy in sv.light_edges(words, []):
        for i in range(lo, hi):
            for t, at in sv._merged_words(words[i], depth, heavy):
                if at < 0:
                    met.update([frozenset((words[i], t))] if t in where else [])
                else:
                    group.setdefault((t, at), {t} & set(where)).add(words[i])
    for g in group.values():
        met.update(frozenset((a, b)) for a in g for b in g if a < b)
    assert set(met.values()) == {1} and set(met) == {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}


def test_hard_words(spark):
    assert found(spark, {"only": 3}) == {"only": (None, "only", 3, 0, None)}
    rows = [("colour", 9), ("color", 9), ("colour", 9), (None, 5), ("colou", 4), ("x" * 5000, 4), ("x" * 5001, 9)]
    got = {r.word: r for r in sv.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["color"].form == "colour" and got["colour"].n == 18 and got["colou"].root == "colour" and got["x" * 5000].form == "x" * 5001 and None not in got
    assert sv.variants(spark.createDataFrame([], "word string, n long")).collect() == []
    with pytest.raises(ValueError):
        sv.variants(spark.createDataFrame(rows, "word string, n long"), ratio=1)
    chain = {"a" * 5: 1, "a" * 6: 2, "a" * 7: 4, "a" * 8: 8, "a" * 9: 16, "a" * 10: 32, "a" * 11: 64}
    assert {v[1] for v in found(spark, chain).values()} == {"a" * 11}
    groups = sv.members(sv.variants(spark.createDataFrame(list(chain.items()), "word string, n long"))).collect()
    assert len(groups) == 1 and groups[0].n_words == 7 and groups[0].variants[0] == "a" * 11


def test_query(spark, tmp_path):
    rng = random.Random(9)
    stems = ["harbour", "harbor", "Étude", "straße", "window", "widow", "planet", "plane", "abcde", "ÄPFELN", "äpfeln", "x×y÷zz"]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice(["", ",", "1", "\n"]) for _ in range(60))) for i in range(60)] + [(1, None), (None, "harbour window"), (5, ""), (5, "window planet 日本"), (5, "window planet 日本")]
    spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, word string, `n.x` int").write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w
            counts[w] += len(w) >= 5
    want = brute({w: n for w, n in counts.items() if n >= 3})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op12_errata_trie(spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 12
    named = sv.vocabulary(spark.createDataFrame(rows, "`a.b` long, `t``` string"), "a.b", "t`", 1, 1)
    assert named.where(F.length("word") < 5).count() == 0 and named.count() > 10
