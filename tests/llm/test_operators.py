"""The corpus operators against brute force, round trips and held-out accuracy, on small fixtures with nulls, empties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumentrace.llm import chat_format, decontaminate, language_id, line_dedup, packing, rotated_codes, simhash_dedup, toxicity, url_templates, warc_store
from lumentrace.llm.common import connected_components

WORDS = [a + b + c for a in ("ka", "lo", "mi", "te") for b in ("ra", "su", "ni", "po") for c in ("n", "l", "m", "st")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 7, 1) for i, t in rows], "doc_id long, text string, id string, fp int, rk int")


# --- SimHash ---------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    s = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(points):
    """Least id of each point's class over links of two bits, by all pairs."""
    ids, fps = zip(*points)
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                up[root(i)] = root(j)
    least = {}
    for i in range(len(ids)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return {(ids[i], fps[i]): least[root(i)] for i in range(len(ids))}


def test_golay_code_is_perfect():
    high, low, leader, wide = simhash_dedup.golay_tables()
    words = np.arange(1 << 23)
    rem = high[words >> 12] ^ low[words & 4095]
    assert np.array_equal(np.sort(rem[leader]), np.arange(2048)) and np.bitwise_count(leader).max() == 3
    weight3 = np.bitwise_count(leader) == 3
    assert (wide[weight3] >= 0).all() and (wide[~weight3] == -1).all() and np.array_equal(np.unique(rem[wide[weight3]]), np.unique(rem[leader[weight3]]))


def test_links_miss_no_pair(spark):
    rng = random.Random(5)
    points = set()
    for _ in range(150):
        x = rng.getrandbits(64)
        points.add(x)
        for _ in range(rng.choice((0, 3))):
            y = x
            for b in rng.sample(range(64), rng.choice((1, 2, 2, 3))):
                y ^= 1 << b
            points.add(y)
    points |= {0, 3, 12, (1 << 63) | 1}
    dense = rng.getrandbits(64)
    points |= {dense ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)}
    signed = [x - (1 << 64) if x >> 63 else x for x in points]
    got = {(r.src, r.dst) for r in simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want
    for crowded in (0, 3, 20):
        finer = simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), crowded=crowded)
        assert {(r.src, r.dst) for r in finer.collect()} == want
    with pytest.raises(ValueError):
        simhash_dedup.links(spark.range(1).select(F.col("id").alias("fp")), 3)


def test_near_duplicate_classes(spark):
    rng = random.Random(1)
    base = sentence(rng, 300)
    rows = [(1, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \n"), (7, "One"), (8, "one"), (9, "a b"), (10, sentence(rng, 40)), (2, base), (11, "long " * 30000), (12, base.upper())]
    got = simhash_dedup.near_duplicate_classes(docs_of(spark, rows))
    assert got.count() == len(rows)
    out = {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in got.collect()}
    want = classes(list(dict.fromkeys((i, brute_fingerprint(t)) for i, t in rows)))
    assert out == want and out[4, 0] == 4 and out[5, 0] == out[6, 0] == 4
    assert simhash_dedup.near_duplicate_classes(docs_of(spark, rows).limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long"), "t").collect())
    assert got == {i: 0 for i in range(41)} | {i: 1000 for i in range(1000, 1100)}


# --- decontamination --------------------------------------------------------------------------------------------------


def brute_contamination(docs, items):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[k : k + 13])].add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out[d, t] = (len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_winnowing_finds_every_window(spark):
    rng = random.Random(2)
    items = [(i, sentence(rng, rng.choice((3, 7, 12, 13, 14, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "ka"), (93, "Über den Berg, 12 Ziegen!"), (94, "same " * 20)]
    docs = []
    for d in range(60):
        parts = [sentence(rng, rng.randrange(0, 30))]
        for _ in range(rng.choice((0, 1, 2))):
            w = rng.choice(items)[1] or "x"
            w = w.split()
            cut = rng.randrange(len(w))
            parts.append(", ".join(w[cut : cut + rng.choice((5, 12, 13, 20, 50))]).upper())
        docs.append((d, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "same " * 15), (0, "other text of the same id"), (103, "über den berg 12 ziegen"), (1, docs[1][1]), (104, items[5][1] + " " + sentence(rng, 30000))]
    dd, ii = docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit("c"))
    got = decontaminate.judged(*decontaminate.contamination(dd, ii))
    keyed = dd.select("doc_id", "text", decontaminate.row_key("text").alias("k")).distinct()
    rows = got.join(keyed, (got.id == keyed.doc_id) & (got.rk == keyed.k)).collect()
    assert len(rows) == len(docs)
    want = brute_contamination(docs, items)
    assert {(r.id, r.text): (r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows} == want
    empty = decontaminate.judged(*decontaminate.contamination(dd, ii.limit(0)))
    assert empty.where("n_hit > 0").count() == 0 and empty.count() == len(docs)
    assert decontaminate.judged(*decontaminate.contamination(dd.limit(0), ii)).count() == 0


# --- line dedup -------------------------------------------------------------------------------------------------------


def brute_removal(rows, least):
    """Texts after removal, document by document and line by line."""
    n = lambda s: len(s.split())
    value = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:7], 16)
    masked = lambda a, b: (value(a) * line_dedup.FACTOR + value(b)) % line_dedup.MODULUS % (1 << line_dedup.MASK_BITS) == 0
    order = sorted(dict.fromkeys((d, t) for d, t in rows if t is not None), key=lambda r: (r[0] is None, r[0], r[1]))
    gaps = Counter(g for _, t in order for g in zip(t.split("\n"), t.split("\n")[1:]))
    first, own = {}, {}
    for d, t in order:
        ls, at, cs = t.split("\n"), 0, []
        for i in range(1, len(ls) + 1):
            if i == len(ls) or gaps[ls[i - 1], ls[i]] < 2 or masked(ls[i - 1], ls[i]) or i - at == line_dedup.MAX_LINES:
                cs.append((at, i))
                first.setdefault(tuple(ls[at:i]), (d, t, at))
                at = i
        own[d, t] = cs
    plan = {}
    for (d, t), cs in own.items():
        ls, runs, last = t.split("\n"), [], None
        for a, z in cs:
            o = first[tuple(ls[a:z])]
            if o == (d, t, a):
                last = None
                continue
            if last == (o[0], o[1], a - o[2]):
                runs[-1][1] = z
            else:
                runs.append([a, z])
            last = o[0], o[1], a - o[2]
        gone = {i for a, z in runs if sum(map(n, ls[a:z])) >= least for i in range(a, z)}
        plan[d, t] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    return plan


def check_removal(spark, rows, least=50):
    d = docs_of(spark, rows)
    got = line_dedup.remove_repeated(d, min_words=least)
    assert got.columns == [*d.columns, "removed_lines", "removed_words"] and got.count() == len(rows)
    plan = brute_removal(rows, least)
    want = Counter((i, None if t is None else plan[i, t]) for i, t in rows)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    return want


def test_repeated_passages(spark):
    rng = random.Random(3)
    passage = [sentence(rng, 20) for _ in range(4)]
    long_line = sentence(rng, 60)
    rows = [(0, "\n".join([sentence(rng, 9), *passage, sentence(rng, 9)])), (1, "\n".join([*passage, sentence(rng, 5)])), (2, "\n".join([sentence(rng, 7), passage[1], passage[2], "mid", passage[3]]))]
    rows += [(3, long_line), (4, sentence(rng, 4) + "\n" + long_line), (5, "\n".join(["short line"] * 5)), (6, "short line\nother"), (7, None), (8, ""), (9, "\n\n\n"), (3, long_line)]
    rows += [(10, "\n".join(passage + ["x"] + passage)), (11, "\n".join(sentence(rng, 12) for _ in range(3000))), (12, "\n".join(["one line again"] * 400)), (13, "\n".join(["one line again"] * 300))]
    rows += [(14, rows[11][1]), (14, sentence(rng, 9) + "\n" + long_line), (15, "\n".join(passage[:2] + [long_line] + passage[2:]))]
    want = check_removal(spark, rows)
    assert want[4, rows[4][1].split("\n")[0]] == 1 and want[1, rows[1][1].split("\n")[-1]] == 1
    assert line_dedup.remove_repeated(docs_of(spark, rows).limit(0)).count() == 0
    small = [sentence(rng, 6) for _ in range(12)]
    check_removal(spark, [(i, "\n".join(rng.choice(small) for _ in range(rng.randrange(1, 40)))) for i in range(60)], 12)


def test_passages_that_stand_nowhere_whole_stay(spark):
    rng = random.Random(8)
    a, b, c, x, y, z, q = (sentence(rng, 30) for _ in range(7))
    joined = [(0, f"{a}\n{b}\n{x}"), (1, f"{b}\n{c}\n{y}"), (2, f"{a}\n{b}\n{c}\n{z}")]
    chained = [(0, f"{a}\n{b}\n{x}"), (1, f"{a}\n{b}\n{c}\n{y}"), (2, f"{q}\n{b}\n{c}\n{z}")]
    for rows in (joined, chained):
        kept = [t for i, t in sorted(check_removal(spark, rows)) if t is not None]
        for r in rows:  # whatever went from a text stands whole in another
            gone = [s for s in r[1].split("\n") if s not in dict(zip(range(3), kept))[r[0]].split("\n")]
            assert not gone or any("\n".join(gone) in k for k in kept)


def test_columns_of_any_name_stay(spark):
    names = ["_key", "_id", "_rk", "_spans", "_lines", "_words", "id", "rk", "row", "i", "k", "cuts", "lines", "words", "removed_words"]
    d = spark.createDataFrame([(0, "a b\nc", *range(len(names))), (1, "a b\nc", *range(len(names)))], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    got = line_dedup.remove_repeated(d, min_words=2)
    assert sorted((r.doc_id, r.text, r.removed_words) for r in got.collect()) == [(0, "a b\nc", 0), (1, "", 3)]
    assert all(tuple(r[n] for n in names[:-1]) == tuple(range(len(names) - 1)) for r in got.collect())


def test_chunks_of_different_bytes_stay(spark):
    d = docs_of(spark, [(0, "a\nb"), (1, "c\nd")])
    keyed = d.select("doc_id", line_dedup.row_key("text").alias("rk"))
    found = keyed.selectExpr("doc_id as id", "rk", "0 as first", "1 as last", "2 as words", "cast(7 as long) as digest")
    assert [r.digest for r in line_dedup.clashing_digests(d, found).collect()] == [7]
    assert line_dedup.clashing_digests(d, found.where("id = 0")).count() == 0


# --- packing ----------------------------------------------------------------------------------------------------------


def test_packing_parts(spark):
    rng = random.Random(4)
    lengths = sorted((rng.randrange(1, 101) for _ in range(300)), reverse=True)
    floor = packing.lower_bound(np.array(lengths), 100)
    assert floor <= len(packing.best_fit(lengths, list(range(300)), 100)) and floor >= -(-sum(lengths) // 100)
    assert packing.lower_bound(np.array([60] * 10), 100) == 10
    hard = sorted([51, 27, 26, 23, 23, 50, 34, 16] * 12, reverse=True)
    genes, _ = packing.evolve(hard, 100, 1, [], 5, 4)
    load = Counter()
    for x, at in zip(hard, genes):
        load[at] += x
    assert max(load.values()) <= 100 and len(load) <= len(packing.best_fit(hard, list(range(len(hard))), 100))
    a, b = packing.best_fit(hard, list(range(len(hard))), 100), packing.best_fit(hard, list(range(len(hard)))[::-1], 100)
    child = packing.crossover(a, b, hard, 100, rng)
    assert sorted(x for c in child for x in c) == list(range(len(hard))) and all(sum(hard[x] for x in c) <= 100 for c in child)


def test_crossover_and_migration_close_the_gap_that_best_fit_leaves(spark):
    rng = random.Random(11)
    lengths = ([51, 26, 23] * 6 + [27, 27, 23, 23] * 3) * 4  # 36 full bins; best fit puts 27 to 51 and needs 44
    rng.shuffle(lengths)
    d = spark.createDataFrame(list(enumerate(lengths)), "item long, length int").withColumn("shard", F.lit("clash"))
    plain = len(packing.best_fit(sorted(lengths, reverse=True), list(range(len(lengths))), 100))
    starts = min(max(packing.evolve(sorted(lengths, reverse=True), 100, i, [], 0, 40)[0]) + 1 for i in range(2))
    told = []
    got = packing.pack(d, 100, told=told, epochs=6)
    rows = got.collect()
    assert got.columns == ["item", "length", "shard", "sequence_id", "offset"] and Counter(r["item"] for r in rows) == Counter(range(len(lengths)))
    t = told[0].collect()[0]
    assert t.best_fit == plain == 44 and t.floor == 36 and t.generations > 0 and t.migrations > 0
    assert t.n_bins <= 38 and t.n_bins < starts  # better than best fit of as many random orders
    assert len({r.sequence_id for r in rows}) == t.n_bins


def test_equal_rows_spread_at_every_level(spark):
    d = spark.range(600).select(F.lit(7).alias("doc_id"), F.lit(60).cast("long").alias("length"))
    told = []
    assert packing.pack(d.repartition(3), 100, shard=50, told=told).count() == 600
    sizes = [[r["count"] for r in spark.read.parquet(x).select(F.size("items").alias("count")).collect()] for x in _shard_files(spark)]
    assert len(told) > 1 and all(max(s) <= 4 * 50 for s in sizes[-len(told) :])


def _shard_files(spark):
    from pathlib import Path

    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    return [str(p) for p in sorted(root.glob("lumentrace-pack-shards-*"), key=lambda p: p.stat().st_mtime)]


def test_pieces_and_sequences(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = ["", None, "It's 3² ½ Été ÀÉ!", "x<|endoftext|>y", "İstanbul é 日本", "a b\x85c", sentence(rng, 20000), "same", "same"] + [sentence(rng, rng.randrange(1, 900)) for _ in range(80)]
    rows = list(enumerate(texts)) + [(7, "same")]
    d = docs_of(spark, rows)
    got = packing.pieces(d, path).collect()
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    packed = packing.pack(packing.pieces(d, path, keep_ids=False), 4096, shard=40).collect()
    assert len(packed) == len(got)
    seq = defaultdict(list)
    for r in packed:
        seq[r.sequence_id].append((r.offset, r.length))
    for s in seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert len(seq) <= -(-sum(r.length for r in packed) // 4096) + 2
    assert packing.pack(packing.pieces(d.limit(0), path, keep_ids=False)).count() == 0


# --- toxicity, language -----------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(7)
    bad = ["zlofty", "zlofted", "zlofter", "grrmuck"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 9 == 0
        words = sentence(rng, rng.randrange(5, 80)).split()
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or toxic:
            labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, sentence(rng, 40000)), (0, rows[0][1])]
    d, lab = docs_of(spark, rows), spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(d.where("doc_id % 5 <> 0"), lab.where("doc_id % 5 <> 0"), prior=0.11)
    got = toxicity.score(d, model, "text", "doc_id").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: i % 9 == 0 for i in range(900)}
    held = [(r.score >= 0.5, truth[r.doc_id]) for r in got if r.doc_id < 900 and r.doc_id % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(r.score < 0.5 for r in got if r.doc_id >= 1000)
    none = toxicity.train(d, lab.limit(0))
    assert {round(r.score, 3) for r in toxicity.score(d.limit(3), none, "text").collect()} == {0.047} and toxicity.score(d.limit(0), model, "text").count() == 0


def risk(p, u, names, w, b, prior):
    """The non-negative risk, text by text."""
    at = {n: i for i, n in enumerate(names)}
    f = lambda x: sum(w[at[i]] for i in x if i in at) + b
    loss = lambda z: float(np.log1p(np.exp(-abs(z))) + max(0.0, -z))  # noqa: E731  of a positive one
    plus, minus = np.mean([loss(f(x)) for x in p]), np.mean([loss(-f(x)) for x in p])
    rest = np.mean([loss(-f(x)) for x in u]) - prior * minus
    return prior * plus + max(0.0, rest), rest


@pytest.mark.parametrize("prior", [0.1, 0.7])
def test_steps_follow_the_gradient_of_the_risk(prior):
    rng = np.random.default_rng(2)
    names = np.arange(12)
    p = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(15)]
    u = [np.sort(rng.choice(12, 3, replace=False)) for _ in range(40)]
    w, b = rng.random(12), -0.5
    g, gb, rest = toxicity.gradient(toxicity._Rows(p, names), toxicity._Rows(u, names), w, b, prior)
    whole, want_rest = risk(p, u, names, w, b, prior)
    assert abs(rest - want_rest) < 1e-9
    part = (lambda w, b: risk(p, u, names, w, b, prior)[0]) if rest >= 0 else (lambda w, b: -risk(p, u, names, w, b, prior)[1])  # below zero the step undoes
    for i in range(12):
        e = np.eye(12)[i] * 1e-6
        assert abs((part(w + e, b) - part(w - e, b)) / 2e-6 - g[i]) < 1e-6
    assert abs((part(w, b + 1e-6) - part(w, b - 1e-6)) / 2e-6 - gb) < 1e-6


def test_non_negative_risk_does_not_overfit():
    p = [np.array([1, 2]), np.array([1, 3])] * 20
    u = [np.array([2]), np.array([3]), np.array([4])] * 60 + p[:20]
    m = toxicity.fit(p, u, np.array([1, 2, 3, 4]), 0.1)
    assert m.weights[1] > 2 and m.weights.get(4, 0) == 0 and m.bias < 0


def test_language(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(9001, None, "fr"), (9002, "", None), (9003, "123 !?", "de"), (9004, "\U0001d400bc 日本", None), (9005, "le " * 50000, None)], d.schema)
    t = language_id.train(d.where("doc_id % 3 <> 0"))
    got = {r.doc_id: r for r in language_id.predict(d.unionByName(extra), t, "text", "doc_id", "lang").collect()}
    held = [r for i, r in got.items() if i % 3 == 0 and i < 9000]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.9 and set(t.langs) <= {"de", "en", "es", "fr"}
    assert [got[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and got[9004].rejected and got[9005].lang_pred == "fr"
    assert language_id.train(d.limit(0)).langs == [] and language_id.predict(extra, language_id.train(d.limit(0)), "text", "doc_id").count() == 5


def test_model_is_a_distribution(spark):
    d = spark.createDataFrame([(0, "abba abab baab", "x"), (1, "aaaa bbbb", "x")], "doc_id long, text string, lang string")
    t = language_id.train(d)
    for h in ((32, 32, 32), (97, 98, 98), (97, 98, 97), (98, 32, 97), (120, 121, 122)):
        k = h[0] << 48 | h[1] << 32 | h[2] << 16
        p = np.exp(language_id._log_p(t, np.array([k | w for w in (32, 97, 98, 113)], np.uint64), 4).astype(np.float64)).ravel()
        # units that no text has share one probability; summed one by one they would meet hashes of others
        assert abs(p[:3].sum() + p[3] * ((1 << 16) - 3) - 1) < 1e-3


# --- WARC, chat, search, urls ------------------------------------------------------------------------------------------


def test_payloads_without_copies_are_not_moved_to_be_archived(spark):
    def moved():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        return sum(context.statusStore().executorList(False).apply(i).totalShuffleWrite() for i in range(context.statusStore().executorList(False).size()))

    rng = random.Random(5)
    rows = [(i, f"http://a/{i}", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4000))) for i in range(1500)]
    pages = spark.createDataFrame(rows + [(i + 2000, u, h) for i, u, h in rows[:20]], "page_id long, url string, html string").repartition(4).localCheckpoint()
    before = moved()
    records, payloads = warc_store.write_archive(pages)
    assert moved() - before < sum(len(h) for _, _, h in rows) // 4
    assert payloads.count() == 1500 == payloads.select("digest").distinct().count() and records.where("is_revisit").count() == 20


def test_archive(spark):
    big = "é" * 600
    rows = [(1, "http://a/", big), (5, "http://b/\r\nx", big), (9, None, big), (2, "u", None), (3, "u", ""), (4, "u", "small"), (6, "u", "small"), (7, "u", "x" * 200_000), (9, None, big), (8, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 50)]
    pages = spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, digest string")
    records, payloads = warc_store.write_archive(pages)
    assert payloads.count() == 5
    got = warc_store.read_archive(records, payloads).collect()
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and h == big and i != 9
        want[str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", "9" if revisit else None] += 1
    assert Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    whole = [bytes(r.record) for r in warc_store.reconstruct(records, payloads).collect()]
    assert any(w.endswith(b"x" * 200_000 + b"\r\n\r\n") for w in whole) and all(w.startswith(b"WARC/1.1\r\n") for w in whole)
    bad = payloads.withColumn("payload", F.lit(b"forged"))
    with pytest.raises(Exception, match="differs"):
        warc_store.read_archive(records, bad).collect()
    assert warc_store.read_archive(*warc_store.write_archive(pages.limit(0))).count() == 0


def test_chat(spark):
    hard = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", hard), (-1, 1, "assistant", hard), (2, 3, "assistant", "b"), (2, 1, "user", None), (2, 2, "assistant", "a\\<|x|>"), (2, 2, "assistant", "a\\<|x|>"), (3, 0, None, "t"), (3, None, "odd|role>", "<<SYS>>"), (4, 0, "system", "s\n"), (None, 0, "assistant", "n")]
    rows += [(7, i, ("user", "assistant")[i % 2], f"turn {i} " * 20) for i in range(400)]
    d = spark.createDataFrame([(c, t, r, x, 1) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, seq int")
    done = chat_format.format_turns(d)
    got = {r.conv_id: r for r in chat_format.read_back(done, chat_format.examples(done)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    for c, v in by.items():
        v.sort()
        loss = "".join(x for _, r, x in v if r == "assistant")
        want = (len(v), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in v).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    assert len(got) == len(by)
    ex = {(r.conv_id, r.example): r for r in chat_format.expanded(done.where("conv_id in (-1, 2)")).collect()}
    assert len(ex) == 4 and all(chat_format.unescape(r.text[r.loss_start : r.loss_stop]) in (hard, "b", "a\\<|x|>") for r in ex.values())
    assert ex[2, 2].text.startswith(ex[2, 0].text) and chat_format.examples(done).where("conv_id = 7").count() == 200
    none = chat_format.format_turns(d.limit(0))
    assert chat_format.read_back(none, chat_format.examples(none)).count() == 0
    moved = chat_format.examples(done).withColumn("context_stop", F.col("context_stop") + 1)
    with pytest.raises(Exception, match="doesn't fit"):
        chat_format.read_back(done, moved).collect()
    named = chat_format.format_turns(d.withColumn("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string"))))
    assert chat_format.read_back(named, chat_format.examples(named)).count() == len(by)


def test_search(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[200:300] = x[20]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(5000, None), (5020, []), (5040, [0.0] * 24), (5060, [float("nan")] + [1.0] * 23), (5080, [None] + [1.0] * 23), (5100, [1.0, 2.0]), (5120, [2.0, 1.0])]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("code", F.lit("clash"))
    index, centres = rotated_codes.build_index(d)
    got = defaultdict(list)
    for r in rotated_codes.nearest(index, index.where("id % 20 = 0"), centres).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    v = x.astype(np.float64)
    hits = 0
    for q in range(0, 1500, 20):
        s = (v * v[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:20].tolist()
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(z - s[i]) < 1e-12 for _, i, z in found)
        hits += len(set(want) & {i for _, i, _ in found})
    assert hits / (20 * 75) > 0.99
    assert [(i, z) for _, i, z in got[5100]] == [(5120, 4.0)] and set(got) == {*range(0, 1500, 20), 5100, 5120}
    none, c = rotated_codes.build_index(d.limit(0))
    assert rotated_codes.nearest(none, none, c).count() == 0


def test_urls(spark):
    rows = ["https://WWW.Example.com/en/1?x", "http://example.com/en/1", "http://a.example.com/en", "http://example.com", "http://x.net/es/", "http://net/fr/2#f", "ftp://y.net/de/1", "no scheme", None, "http://b.org//x//", "http://c.net/es", "http://com/"]
    rows += [f"http://shop.net/{'es' if i % 2 else 'de'}/p{i}/{i}" for i in range(200)] + [f"http://big.org/u/{w}{i}" for i in range(3) for w in WORDS]
    d = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(rows)] + [(0, rows[0], "clash")], "page_id long, url string, host string")
    got = url_templates.judged(d)
    by = {r.page_id: r for r in got.collect()}
    assert got.count() == len(rows) + 1
    told = [(by[i].host, by[i].path, by[i].rule, by[i].verdict) for i in range(12)]
    assert told == [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("example.com", "/en/1", "example.com/en/", "block"), ("a.example.com", "/en", "com/", "allow"),
        ("example.com", "", None, "allow"), ("x.net", "/es/", "net/es/", "block"), ("net", "/fr/2", "net/fr/", "block"), ("y.net", "/de/1", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("b.org", "//x//", None, "allow"), ("c.net", "/es", None, "allow"), ("com", "/", "com/", "allow"),
    ]
    assert by[13].template == by[12].template == "/{}/*/*" and by[13].labelled == by[12].labelled == 100 and by[len(rows) - 1].template == "/u/*"
    assert (by[12].rule, by[12].verdict, by[13].verdict) == (None, "block", "block")
    assert url_templates.judged(d.limit(0)).count() == 0


def test_learned_verdicts_beat_a_constant_where_rules_are_hidden(spark):
    rng = random.Random(9)
    rows = []
    for n in range(900):
        tld, lang = rng.choice(("net", "com")), rng.choice(("en", "de", "es", "fr"))
        rows.append((n, f"http://s{n % 12}.example.{tld}/{lang}/{n}{rng.choice(('', '.html', '/'))}"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    truth = {r.page_id: r.verdict for r in url_templates.judged(pages).where("rule is not null").collect()}
    hidden = F.regexp_extract("host", "^s([0-9]+)", 1).cast("int") % 3 == 0
    got = [(r.learned, truth[r.page_id]) for r in url_templates.judged(pages, hidden=hidden).where(hidden).collect() if r.page_id in truth]
    right = sum(a == b for a, b in got) / len(got)
    assert right > 0.95 > 0.75 > max(sum(b == c for _, b in got) / len(got) for c in ("allow", "block"))
    assert any(r.verdict == "block" and r.labelled > 0 for r in url_templates.judged(pages).where("rule is null").collect())


def test_urls_of_any_length_and_null_ids(spark):
    rows = [(1, "http://a.net/" + "a1" * 50_000 + "x"), (None, "http://a.net/" + "a" * 100_000 + "/" + "9" * 100_000), (None, None), (2, "http://" + "h." * 5_000 + "net/es/" + "/".join("x" * 20_000))]
    got = url_templates.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert Counter((r.page_id, r.rule) for r in got) == Counter([(1, None), (None, None), (None, None), (2, "net/es/")])
    assert {r.page_id: r.template for r in got}[1] == "/*" and {r.template for r in got if r.rule} == {"/es/x/x/x/**"}
