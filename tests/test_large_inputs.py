"""Databases by pages, files by ranges, bounded counters and streams that remember: against whole files and plain counts."""

import json
import os
import random
import sqlite3
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumentrace.functions.entropy import shannon
from lumentrace.operators import entropy_windows, heavy
from lumentrace.sources import files, ranges, sqlite_source, walk
from lumentrace.streaming import stream


def database(path, page_size, rows, encoding="UTF-8"):
    con = sqlite3.connect(path)
    con.execute(f"pragma page_size = {page_size}")
    con.execute(f"pragma encoding = '{encoding}'")
    con.execute('create table other(x)')
    con.execute('create table "Odd name"(id integer primary key, [two words] text, "q""t" blob, real_one double, n numeric(3, 2) default (1 + 2), constraint c check (n > 0))')
    con.executemany('insert into "Odd name" values (?, ?, ?, ?, ?)', rows)
    con.execute("create table no_key(a, b text)")
    con.executemany("insert into no_key values (?, ?)", [(r[0], r[1]) for r in rows])
    con.commit()
    con.close()


@pytest.mark.parametrize("page_size,encoding", [(512, "UTF-8"), (4096, "UTF-16le"), (65536, "UTF-8")])
def test_tables_by_pages(spark, tmp_path, page_size, encoding):
    rng = random.Random(page_size)
    rows = [(i * 7 - 50, "é" * rng.choice([0, 3, 40, 700]) + str(i), bytes(rng.randrange(256) for _ in range(rng.choice([0, 5, 900]))), i / 3 + 0.1, rng.choice([1, 127, 128, 70000, 1 << 33, 1 << 50])) for i in range(400)]
    rows[5] = (5_000_000_000, "long" * 30_000, None, -1.5, 2)
    database(tmp_path / "a.sqlite", page_size, rows, encoding)
    (tmp_path / "junk.sqlite").write_bytes(b"SQLite format 3\0" + b"\7" * 600)
    (tmp_path / "short.sqlite").write_bytes(b"SQLite format 3\0")
    read = files.read_files(spark, str(tmp_path))
    got = [json.loads(r.data) for r in sqlite_source.read_table(read, "ODD NAME").orderBy("row").collect()]
    want = sorted(rows)
    assert [(r["id"], r["two words"], r['q"t'], r["real_one"], r["n"]) for r in got] == [(i, t, None if b is None else b.hex(), d, n) for i, t, b, d, n in want]
    few = sqlite_source.read_table(read, "no_key", max_rows=7).collect()
    assert sorted(r.row for r in few) == list(range(7)) and {json.loads(r.data)["a"] for r in few} == {r[0] for r in rows[:7]}
    assert sqlite_source.read_table(read, "absent").count() == 0 and sqlite_source.read_table(read, "other").count() == 0


def test_files_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = {"rise": b"a plain text " * 2000 + rng.integers(0, 256, 40_000, np.uint8).tobytes(), "flat": b"xyz" * 9000, "small": b"q" * 70, "tiny": b"q" * 9, "none": b"", "exact": bytes(range(256)) * 64}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    profiled = ranges.profiles(walk.walk(spark, str(tmp_path)), str(tmp_path), size=4 * 4096, tasks=3)
    base = F.regexp_extract("path", "[^/]+$", 0)
    whole = spark.createDataFrame([(n, bytearray(c)) for n, c in data.items()], "path string, content binary")
    want = sorted(map(tuple, entropy_windows.windows(whole, "path", "content").collect()))
    assert sorted(map(tuple, ranges.windows(profiled).select(base, "offset", "entropy").collect())) == want
    assert {r.path: (r.length, round(r.bits, 9)) for r in ranges.whole_entropy(profiled).withColumn("path", base).collect()} == {n: (len(c), round(shannon(c), 9)) for n, c in data.items() if c}
    rise = ranges.spikes(profiled).withColumn("path", base).collect()
    assert [r.path for r in rise] == ["rise"] and sorted(map(tuple, rise)) == sorted(map(tuple, entropy_windows.spikes(entropy_windows.windows(whole, "path", "content"), "path").collect()))
    with pytest.raises(ValueError):
        ranges.profiles(walk.walk(spark, str(tmp_path)), str(tmp_path), size=5000)


@pytest.mark.parametrize("counters", [40, 45, 1000])
def test_bounded_counters_lose_nothing_frequent(spark, counters):
    rng = random.Random(counters)
    texts = [" ".join(rng.choice(["the", "of", f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(0, 60))) for _ in range(80)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    every = Counter(g for t in texts if t for g in heavy.word_pairs(t))
    want = {g: n for g, n in every.items() if n * 20 > every.total()}
    assert want and {r.gram: r.n for r in heavy.frequent(df, "text", share=20, counters=counters).collect()} == want
    assert heavy.frequent(df.limit(0), "text", share=20, counters=40).collect() == []
    with pytest.raises(ValueError):
        heavy.frequent(df, "text", share=20, counters=39)


def test_stream_remembers_versions(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    os.makedirs(source)
    schema = "path string, text string, seen_at timestamp"

    def put(*rows):
        spark.createDataFrame([(p, t, None if s is None else f"2024-01-01 00:0{s}:00") for p, t, s in rows], "path string, text string, s string").selectExpr("path", "text", "cast(s as timestamp) as seen_at").coalesce(1).write.mode("append").parquet(str(source))
        q = stream.changed_findings(spark.readStream.schema(schema).parquet(str(source))).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return Counter((r.path, r.value) for r in spark.read.parquet(str(out)).collect())

    first = put(("a", "mail x1@example.com now", 2), ("b", "nothing", 2), ("a", "mail x1@example.com now", 3))
    assert len(first) == 1 and sum(first.values()) == 1
    again = put(("a", "mail x1@example.com now", 4), ("b", "mail y2@example.org", 3), ("a", "late z3@example.net", 1), (None, "n@example.com", 5), ("c", None, 5), ("a", "n@example.com", None))
    assert sum(again.values()) == 2 and {p for p, _ in again} == {"a", "b"}
    assert sum(put(("a", "changed w4@example.com", 5)).values()) == 3


def test_databases_whose_bytes_change_when_read_again(spark):
    """Files that Spark works out anew may come out in another order of rows: each read gives all rows all the same."""

    def made(batches):
        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                con = sqlite3.connect(":memory:")
                con.execute("create table moz_places(id integer primary key, url text, title text, visit_count integer)")
                con.execute("create table urls(url text, title text, visit_count integer)")
                rows = [(i, f"u{path}-{i}", "t" * 9000 if i % 9 == 0 else "t", i) for i in range(1, 200)]
                random.SystemRandom().shuffle(rows)
                con.executemany("insert into moz_places values (?, ?, ?, ?)", rows)
                con.executemany("insert into urls values (?, ?, ?)", [r[1:] for r in rows])
                con.commit()
                out.append(con.serialize())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    files = spark.range(3).selectExpr("cast(id as string) as path").mapInArrow(made, "path string, content binary")
    want = sorted((f"u{p}-{i}", i, 9000 if i % 9 == 0 else 1) for p in range(3) for i in range(1, 200))
    told = lambda df: sorted((r.url, r.visit_count, len(r.title)) for r in df.collect())
    assert told(sqlite_source.firefox_history(files)[0]) == want
    assert told(sqlite_source.chromium_history(files)) == want
    got = [json.loads(r.data) for r in sqlite_source.read_table(files, "moz_places").collect()]
    assert sorted((r["url"], r["visit_count"], len(r["title"])) for r in got) == want
