"""Automata, word lists, prefix tables and the walked file source against plain searches."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumentrace.functions.automaton import LANE, Automaton, WordList, code_points
from lumentrace.operators import crack, long_lists, prefixes
from lumentrace.plans import host_queries
from lumentrace.sources import files, walk


def plain(words, texts):
    return sorted((t, i, w) for t, text in enumerate(texts) for w in set(words) if w for i in range(len(text)) if text.startswith(w, i))


def found(words, texts):
    a = Automaton(words)
    t, at, w = a.find([code_points(x) for x in texts])
    return sorted(zip(t.tolist(), at.tolist(), [a.words[i] for i in w]))


@pytest.mark.parametrize("letters", ["ab", "abcé😀"])
def test_automaton_finds_what_a_plain_search_finds(letters):
    rng = random.Random(len(letters))
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    words = [make(rng.randrange(1, 7)) for _ in range(60)] + ["", make(LANE + 5)]
    texts = [make(rng.randrange(0, 60)) for _ in range(30)] + ["", make(3 * LANE + 7), words[-1] * 2]
    assert found(words, texts) == plain(words, texts)
    assert found([], texts) == [] and found(["a"], []) == [] and found(words, [""]) == []


def test_word_list_tiles_like_a_set():
    rng = random.Random(2)
    words = {"".join(rng.choice("abc1") for _ in range(rng.randrange(3, 14))) for _ in range(200)} | {"ABCA", "é" * 5}
    held = WordList.of(words)
    known = {w.lower() for w in words if 4 <= len(w) <= 12 and w.isascii()}
    assert len(held) == len(known)

    def slow(t):
        best = [0] * (len(t) + 1)
        for end in range(1, len(t) + 1):
            best[end] = max([best[end - 1]] + [best[end - n] + n for n in range(4, min(12, end) + 1) if t[end - n : end] in known])
        return best[-1] / len(t) if len(t) >= 8 else 0.0

    for n in (0, 5, 8, 30, 200):
        t = "".join(rng.choice("abc1") for _ in range(n))
        assert held.coverage(t) == slow(t)
    assert crack.LanguageData(frozenset({"word"})).words.coverage("wordword") == 1.0 and not crack.LanguageData().words


def test_word_list_from_a_table(spark):
    df = spark.createDataFrame([("Alpha",), ("alpha",), ("zz",), (None,), ("ünder",), ("zzzzzzzzzzzz",), ("0000",)], "w string")
    held = WordList.of_table(df, "w")
    assert len(held) == 3 and held.coverage("alphazzzzzzzzzzzz0000") == 1.0


def test_terms_in_texts(spark):
    docs = spark.createDataFrame([(1, "Das Öl und das ÖL; Ölölöl"), (2, None), (3, ""), (4, "nothing here"), (1, "again öl")], "`id` int, text string")
    terms = spark.createDataFrame([("öl",), ("und",), ("Und das",), (None,), ("",), ("xyz",)], "term string")
    for states in (1 << 20, 3):
        got = sorted(map(tuple, long_lists.search_terms(docs, "id", "text", terms, states=states).collect()))
        want = []
        for i, t in ((1, "Das Öl und das ÖL; Ölölöl"), (1, "again öl")):
            want += [(i, len(t[:k].encode()), w) for w in ("öl", "und", "Und das") for k in range(len(t)) if t.lower().startswith(w.lower(), k)]
        assert got == sorted(want)
    assert [tuple(r) for r in long_lists.search_terms(docs, "id", "text", terms, case_sensitive=True).where("term = 'Und das'").collect()] == []
    assert long_lists.search_terms(docs, "id", "text", terms.limit(0)).collect() == []


def test_names_and_entries(spark):
    rng = random.Random(4)
    make = lambda: "".join(rng.choice("abX") for _ in range(rng.randrange(0, 6)))
    names, keys = [make() for _ in range(60)] + [None], [make() for _ in range(30)] + [None]
    df, table = spark.createDataFrame([(n, 1) for n in names], "name string, `a.b` int"), spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "name string, i int")
    for both in (True, False):
        want = sorted((n, i) for n in names if n for i, k in enumerate(keys) if k and (n.lower() in k.lower() or both and k.lower() in n.lower()))
        for states in (1 << 20, 20):
            assert sorted((r[0], r["i"]) for r in long_lists.match_table(df, "name", table, "name", both, states).collect()) == want


def test_addresses_and_ranges(spark):
    import ipaddress

    texts = ["1.2.3.4", "255.255.255.255", "::", "::1", "2001:db8::8:800:200c:417a", "1::", "::ffff:1.2.3.4", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7:8", "01.2.3.4", "1:2", ":::", "1::2::3", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", "g::", "", "x", "12345::", ":1::", None]

    def bits(t):
        try:
            ip = ipaddress.ip_address(t)
        except ValueError:
            return None
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return f"{ip.version}{int(ip):0{ip.max_prefixlen}b}"

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", prefixes.address_bits(F.col("t")).alias("b")).collect()
    assert {r.t: r.b for r in got} == {t: bits(t) if t else None for t in texts}
    ranges = ["10.0.0.0/8", "0.0.0.0/0", "::/0", "2001:db8::/32", "1.2.3.4", "1.2.3.4/33", "x/8", "1.2.3.4/", None]
    lengths = [r.n for r in spark.createDataFrame([(t,) for t in ranges], "t string").select(F.length(prefixes.range_bits(F.col("t"))).alias("n")).collect()]
    assert lengths == [9, 1, 1, 33, 33, None, None, None, None]
    empty = prefixes.longest_prefix(spark.createDataFrame([("a",)], "v string"), F.col("v"), spark.createDataFrame([], "p string"), F.col("p")).collect()
    assert len(empty) == 1 and empty[0].entry is None


def test_walk(spark, tmp_path):
    for i in range(7):
        (tmp_path / f"d{i}" / "deep" / "er").mkdir(parents=True)
        (tmp_path / f"d{i}" / "deep" / "er" / f".f{i}").write_bytes(bytes([i]) * i)
    (tmp_path / "a.b c%20é.txt").write_text("text")
    os.symlink(tmp_path / "none", tmp_path / "broken")
    os.symlink(tmp_path / "d1", tmp_path / "linked")
    os.mkfifo(tmp_path / "pipe")
    for folders in (1, 3, 1000):
        got = {os.path.basename(r.path): r for r in walk.walk(spark, str(tmp_path), folders).collect()}
        assert set(got) == {f".f{i}" for i in range(7)} | {"a.b c%20é.txt", "broken", "linked", "pipe"}
        assert got["broken"].error and got["linked"].error == "is a directory" and got["pipe"].error == "not a regular file" and got[".f3"].length == 3
    read = {os.path.basename(r.path): r for r in files.read_files(spark, "file://" + str(tmp_path), largest=5).collect()}
    assert bytes(read[".f5"].content) == b"\x05" * 5 and read[".f6"].content is None and "larger" in read[".f6"].error and bytes(read[".f0"].content) == b"" and bytes(read["a.b c%20é.txt"].content) == b"text"
    assert walk.is_file(walk.walk(spark, str(tmp_path))).count() == 11
    (tmp_path / "d2" / "deep" / "er" / ".f2").unlink()
    again = walk.contents(walk.walk(spark, str(tmp_path / "d1")), str(tmp_path / "d1"), tasks=3).collect()
    assert [bytes(r.content) for r in again] == [b"\x01"]
    one = files.read_files(spark, str(tmp_path / "d1" / "deep" / "er" / ".f1")).collect()
    assert len(one) == 1 and bytes(one[0].content) == b"\x01"
    with pytest.raises(Exception, match="No such file"):
        files.read_files(spark, str(tmp_path / "absent")).collect()


def test_matches_of_a_small_table_are_many_tasks(spark, sf):
    got = host_queries.long_list_theta(spark, sf)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    parts = [(r.p_partkey, r.p_name.lower()) for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    keys = [(f"Entry {i}", n[:9]) for i, n in parts if i % 20 == 0]
    assert Counter(map(tuple, got.collect())) == Counter((i, e) for i, n in parts for e, k in keys if k in n or n in k)


def test_matches_fill_little(spark, tmp_path):
    """Matches come in runs and repeats, so a file of them is small."""
    names, table = spark.range(2000).selectExpr("id", "'Old plate' as name").coalesce(1), spark.range(999).selectExpr("concat('Entry ', id) as entry", "'old plate' as k")
    long_lists.match_table(names, "name", table, "k").select("id", "entry").write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.distinct().count() == 2000 * 999
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.3 * 2000 * 999


def test_matches_of_many_keys_and_wide_rows(spark):
    names = spark.range(2000).selectExpr("id", "'aB' as name").coalesce(1)
    table = spark.range(600).selectExpr("id as `i.d`", "concat('xAb', id) as k")
    got = long_lists.match_table(names, "name", table, "k", columns=("id", "i.d"))
    assert got.columns == ["id", "i.d"] and got.count() == got.distinct().count() == 2000 * 600
    wide = spark.range(40).selectExpr("id", "'ab' as name", "repeat(cast(id % 10 as string), 30000) as text", "named_struct('a', array(id), 'b', null) as s")
    rows = long_lists.match_table(wide, "name", table.where("`i.d` < 30"), "k").selectExpr("id", "`i.d` as i", "text = repeat(cast(id % 10 as string), 30000) as same", "s.a[0] as a", "k").collect()
    assert Counter((r.id, r.i) for r in rows) == Counter((i, j) for i in range(40) for j in range(30)) and all(r.same and r.a == r.id and r.k == f"xAb{r.i}" for r in rows)
    assert [tuple(r) for r in long_lists.match_table(wide.limit(1), "name", table.limit(2), "k", columns=("i.d",)).sort("`i.d`").collect()] == [(0,), (1,)]
