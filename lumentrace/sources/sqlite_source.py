"""Tables of SQLite files as rows (SRC-09), a page at a time: one large database is many tasks.

Files are cut into pages, each a row. A first pass parses every page by itself and stores what it told: an inner page gives its children, a leaf its cells, whose
values may go on on overflow pages. Files are read once, so contents that come out otherwise when Spark works them out again do no harm. The tree of the asked table is then followed from its root by joins, level by level, which leaves the table's leaves;
overflow chains are followed by joins whose steps double, so a value of very many pages takes few of them. Only then are records put together.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import kept, stored

#: Fixed values of the file format: the first bytes of a file, kinds of pages of a table's tree.
MAGIC = b"SQLite format 3\0"
INNER, LEAF = 5, 13
#: Encodings by the header's number.
ENCODINGS = {1: "utf-8", 2: "utf-16-le", 3: "utf-16-be"}
_CELL = "struct<rowid:bigint,size:bigint,local:binary,next:bigint>"
_PAGE = f"id string, path string, page bigint, size int, reserved int, encoding int, kind int, children array<bigint>, cells array<{_CELL}>, content binary"


def pages(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(id, path, page, size, reserved, encoding, content): the pages of files that begin as databases, from 1; id tells files apart that share a path."""
    c = F.col(content_col)
    number = lambda at, n: F.conv(F.hex(F.substring(c, at, n)), 16, 10).cast("int")
    size = F.when(number(17, 2) == 1, 65536).otherwise(number(17, 2))
    files = files.where(F.hex(F.substring(c, 1, 16)) == MAGIC.hex().upper()).where(F.octet_length(c) >= 100)
    head = files.select(F.xxhash64(path_col, content_col).cast("string").alias("id"), F.col(path_col).cast("string").alias("path"), size.alias("size"), number(21, 1).alias("reserved"), number(57, 4).alias("encoding"), c.alias("c"))
    head = head.where("size >= 512")
    n = (F.octet_length("c") / F.col("size")).cast("int")
    one = F.substring(F.col("c"), (F.col("at") * F.col("size") + 1).cast("int"), F.col("size"))
    cut = head.select("*", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("at"))
    cut = cut.select("id", "path", (F.col("at") + 1).cast("long").alias("page"), "size", "reserved", "encoding", one.alias("content"))
    return cut.repartition("id", "page").dropDuplicates(["id", "page"])  # one file's pages are many tasks' work


def _varint(b: bytes, at: int) -> tuple[int, int]:
    """A number of one to nine bytes, and where it ends."""
    got = 0
    for i in range(9):
        byte = b[at + i]
        if i == 8:
            got = got << 8 | byte
            break
        got = got << 7 | byte & 127
        if byte < 128:
            break
    return got - (1 << 64) if got >= 1 << 63 else got, at + i + 1


def _parsed(page: int, content: bytes, usable: int) -> tuple[int, list[int], list[dict]]:
    """(kind, children, cells) of a page of a table's tree; (0, [], []) of any other or of one that can't be read."""
    start = 100 if page == 1 else 0
    try:
        kind, count = content[start], struct.unpack_from(">H", content, start + 3)[0]
        if kind == INNER:
            at = struct.unpack_from(f">{count}H", content, start + 12)
            return INNER, [struct.unpack_from(">I", content, a)[0] for a in at] + [struct.unpack_from(">I", content, start + 8)[0]], []
        if kind != LEAF:
            return 0, [], []
        cells = []
        most, least = usable - 35, (usable - 12) * 32 // 255 - 23
        for a in struct.unpack_from(f">{count}H", content, start + 8):
            size, a = _varint(content, a)
            rowid, a = _varint(content, a)
            here = size
            if size > most:
                here = least + (size - least) % (usable - 4)
                here = here if here <= most else least
            following = struct.unpack_from(">I", content, a + here)[0] if here < size else 0
            cells.append({"rowid": rowid, "size": size, "local": content[a : a + here], "next": following})
        return LEAF, [], cells
    except (struct.error, IndexError):
        return 0, [], []


def parsed(rows: DataFrame) -> DataFrame:
    """(id, path, page, size, reserved, encoding, kind, children, cells, content) of each of ``pages``; content is null for those of a table's tree.

    An overflow page begins with the next one's number, whose first byte is 0 in files that a cell can hold: none is taken for a page of a tree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {f.name: f.type for f in schema}
        for b in batches:
            told = [_parsed(p, c, s - r) for p, c, s, r in zip(*(b.column(i).to_pylist() for i in (2, 6, 3, 4)))]
            cols = [pa.array([t[i] for t in told], kinds[n]) for i, n in enumerate(("kind", "children", "cells"))]
            rest = pc.if_else(pc.equal(cols[0], 0), b.column(6), pa.scalar(None, b.column(6).type))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *cols, rest], names=["id", "path", "page", "size", "reserved", "encoding", "kind", "children", "cells", "content"])

    cell = pa.struct([("rowid", pa.int64()), ("size", pa.int64()), ("local", pa.binary()), ("next", pa.int64())])
    schema = pa.schema([("kind", pa.int32()), ("children", pa.list_(pa.int64())), ("cells", pa.list_(cell))])
    return rows.mapInArrow(run, _PAGE)


#: Levels of a tree that is sound, at most: pages that point at themselves would have no end.
LEVELS = 20


def _leaves(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, page) of the leaves below ``roots`` (id, page): one join a level; a page that stands in two places counts once."""
    inner = tree.where(F.col("kind") == INNER).select("id", "page", "children")
    leaf = tree.where(F.col("kind") == LEAF).select("id", "page")
    front = roots.select("id", "page").distinct()
    found = front
    for _ in range(LEVELS):
        front = kept(front.join(inner, ["id", "page"]).select("id", F.explode("children").alias("page")).distinct())
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found.distinct().join(leaf, ["id", "page"])


def _overflows(tree: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, first, parts): what the chains of overflow pages that begin at ``starts`` (id, first, need) hold, in turn; need is the number of pages.

    Each page's next one is a link; joining the links with themselves doubles their reach, so that every page learns the first of its chain and its place.
    """
    nxt = F.conv(F.hex(F.substring("content", 1, 4)), 16, 10).cast("long")
    body = tree.where("content is not null").select("id", "page", nxt.alias("nxt"), F.substring(F.col("content"), F.lit(5), F.col("size") - F.col("reserved") - 4).alias("part"))
    chain = kept(starts.groupBy("id", "first").agg(F.max("need").alias("need")).select("id", "first", "need", F.col("first").alias("page"), F.lit(0).cast("long").alias("place")))
    longest = chain.agg(F.max("need")).first()[0] or 0
    jump, reach = kept(body.where("nxt > 0").select("id", "page", F.col("nxt").alias("to"))), 1
    while reach < longest:
        step = chain.join(jump, ["id", "page"]).select("id", "first", "need", F.col("to").alias("page"), (F.col("place") + reach).alias("place")).where("place < need")
        chain = kept(chain.unionByName(step))
        second = jump.select("id", F.col("page").alias("to"), F.col("to").alias("further"))
        jump, reach = kept(jump.join(second, ["id", "to"]).select("id", "page", F.col("further").alias("to"))), 2 * reach
    parts = chain.join(body.select("id", "page", "part"), ["id", "page"])
    return parts.groupBy("id", "first").agg(F.sort_array(F.collect_list(F.struct("place", "part"))).alias("parts")).select("id", "first", F.transform("parts", lambda p: p["part"]).alias("parts"))


def _values(record: bytes, encoding: str) -> list:
    """The values of a record: None, numbers, texts and bytes."""
    end, at = _varint(record, 0)
    kinds = []
    while at < end:
        k, at = _varint(record, at)
        kinds.append(k)
    out: list = []
    sizes = {1: 1, 2: 2, 3: 3, 4: 4, 5: 6, 6: 8}
    for k in kinds:
        if k in sizes:
            out.append(int.from_bytes(record[at : at + sizes[k]], "big", signed=True))
            at += sizes[k]
        elif k == 7:
            out.append(struct.unpack_from(">d", record, at)[0])
            at += 8
        elif k >= 12:
            n = (k - 12) // 2
            raw = record[at : at + n]
            out.append(raw.decode(encoding, "replace") if k % 2 else raw)
            at += n
        else:
            out.append({8: 0, 9: 1}.get(k))
    return out


def _records(tree: DataFrame, roots: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., path, rowid, encoding, payload parts) of the records below ``roots`` (id, page, keep...)."""
    leaves = _leaves(tree, roots)
    cells = tree.join(leaves, ["id", "page"], "left_semi").select("id", "path", F.explode("cells").alias("c")).select("id", "path", "c.*")
    facts = tree.where("page = 1").select("id", "encoding", (F.col("size") - F.col("reserved") - 4).alias("room"))
    cells = cells.join(facts, "id").join(roots.drop("page").distinct(), "id")
    need = F.ceil((F.col("size") - F.octet_length("local")) / F.col("room")).cast("long").alias("need")
    long_ones = _overflows(tree, cells.where("next > 0").select("id", F.col("next").alias("first"), need))
    met = cells.join(long_ones.withColumnRenamed("first", "next"), ["id", "next"], "left")
    parts = F.concat(F.array("local"), F.coalesce("parts", F.array().cast("array<binary>")))
    return met.select(*keep, "id", "path", "rowid", "encoding", "size", parts.alias("parts"))


_QUOTED = re.compile(r"""\[[^\]]*\]|"(?:[^"]|"")*"|'(?:[^']|'')*'|`(?:[^`]|``)*`""")


def _named(sql: str) -> tuple[list[str], int | None]:
    """The columns that a CREATE TABLE names, and which of them is the row id's other name."""
    body = sql[sql.index("(") + 1 : sql.rindex(")")]
    parts, depth, here, quote = [], 0, "", ""
    for c in body:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`[":
            quote = "]" if c == "[" else c
        elif c in "()":
            depth += 1 if c == "(" else -1
        if c == "," and depth == 0 and not quote:
            parts.append(here)
            here = ""
        else:
            here += c
    names, own = [], None
    for part in [p.strip() for p in [*parts, here] if p.strip()]:
        word = part.split()[0].upper()
        if word in ("PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "CONSTRAINT"):
            continue
        quoted = _QUOTED.match(part)
        name = part.split()[0].split("(")[0] if quoted is None else quoted[0][1:-1].replace(2 * quoted[0][-1], quoted[0][-1])
        rest = part[len(name) if quoted is None else quoted.end() :].upper().split()
        if "INTEGER" in rest[:2] and "PRIMARY" in rest and "KEY" in rest:
            own = len(names)
        names.append(name)
    return names, own


def read_table(files: DataFrame, table: str, path_col: str = "path", content_col: str = "content", max_rows: int | None = None) -> DataFrame:
    """(path, row, data): each row as JSON, bytes in hexadecimal; row counts from 0 in the order of row ids; ``max_rows`` per file if given.

    The name is matched regardless of case; files that aren't databases or lack the table give no rows, pages that can't be read none of theirs.
    Tables without row ids aren't read; a value that a later column lacks is null. A file that stands twice under one path counts once.
    """
    return _rows(_tree(files, path_col, content_col), table, max_rows)


def _tree(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``parsed`` pages, stored."""
    return stored(parsed(pages(files, path_col, content_col)), "lumentrace-sqlite-pages")


def _rows(tree: DataFrame, table: str, max_rows: int | None) -> DataFrame:
    top = tree.select("id").distinct().select("id", F.lit(1).cast("long").alias("page"))
    schema = _records(tree, top, [])

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pages_, names, own = [], [], [], []
            for i, e, parts in zip(*(b.column(k).to_pylist() for k in (0, 1, 2))):
                kind, name, _, root, sql = (_values(b"".join(parts), ENCODINGS.get(e, "utf-8")) + [None] * 5)[:5]
                if kind == "table" and name.lower() == table.lower() and root and "(" in (sql or ""):
                    columns, alias = _named(sql)
                    ids.append(i)
                    pages_.append(root)
                    names.append(columns)
                    own.append(-1 if alias is None else alias)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pages_, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(own, pa.int32())], names=["id", "page", "names", "own"])

    found = schema.select("id", "encoding", "parts").mapInArrow(roots, "id string, page long, names array<string>, own int")
    found = kept(found)  # a row per file

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for names, own, rowid, e, size, parts in zip(*(b.column(k).to_pylist() for k in (0, 1, 4, 5, 6, 7))):
                values = _values(b"".join(parts)[:size], ENCODINGS.get(e, "utf-8"))
                values += [None] * (len(names) - len(values))
                if own >= 0 and values[own] is None:
                    values[own] = rowid
                out.append(json.dumps({n: v.hex() if isinstance(v, bytes) else v for n, v in zip(names, values)}, sort_keys=True))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), b.column(4), pa.array(out, pa.string())], names=["id", "path", "rowid", "data"])

    records = _records(tree, found, ["names", "own"])
    data = records.select("names", "own", "id", "path", "rowid", "encoding", "size", "parts").mapInArrow(told, "id string, path string, rowid long, data string")
    return _ordered(data, max_rows)


def _ordered(data: DataFrame, max_rows: int | None) -> DataFrame:
    """Row ids counted through within each file: each block of ids is counted first, so no file is sorted in one task."""
    block = F.shiftright("rowid", 12)
    counts = data.groupBy("id", "path", block.alias("block")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("id", "path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = data.withColumn("block", block).join(counts.select("id", "path", "block", before.alias("before")), ["id", "path", "block"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("id", "path", "block").orderBy("rowid")) - 1
    out = rows.select("path", place.cast("long").alias("row"), "data")
    return out if max_rows is None else out.where(F.col("row") < max_rows)


def _field(name: str) -> Column:
    return F.get_json_object("data", f"$.{name}")


def firefox_history(files: DataFrame, max_rows: int | None = 2000) -> tuple[DataFrame, DataFrame]:
    """(visits, bookmarks) of places.sqlite files: (path, url, title, visit_count) and (path, url, title) (SW-12)."""
    tree = _tree(files)
    places = _rows(tree, "moz_places", max_rows).select("path", _field("id").alias("id"), _field("url").alias("url"), _field("title").alias("title"), _field("visit_count").cast("long").alias("visit_count"))
    marks = _rows(tree, "moz_bookmarks", max_rows).select("path", _field("fk").alias("id"), _field("title").alias("mark")).where("id is not null")
    return places.drop("id"), marks.join(places, ["path", "id"], "left").select("path", "url", F.coalesce("mark", "title").alias("title"))


def chromium_history(files: DataFrame, max_rows: int | None = 2000) -> DataFrame:
    """(path, url, title, visit_count) of Chromium History files (SW-13)."""
    return read_table(files, "urls", max_rows=max_rows).select("path", _field("url").alias("url"), _field("title").alias("title"), _field("visit_count").cast("long").alias("visit_count"))
