"""Removal of repeated passages by content-defined chunks of lines, in DataFrame functions alone.

Every line is hashed, and a rolling hash over each two neighbouring line hashes stands for the gap between them. A gap is
a boundary where the rolling hash falls under a mask (one in 2**``MASK_BITS``), where it occurs in one place of the corpus
only (there shared text ends), and after ``MAX_LINES`` lines. So boundaries depend on the lines around them alone and don't shift
when lines come or go elsewhere; a passage that documents share is cut at its own edges. Chunks have at
least one line.

Chunks are grouped by a digest of their line hashes. A digest's first occurrence (least document id, then row key, then place; null
ids last) always stays; a later one goes if, with its neighbours, it forms a passage: consecutive chunks whose first
occurrences are consecutive in one document too, with ``min_words`` words or more in all. So whatever goes stands
elsewhere as a whole, in a place that nothing is removed from.

Bytes are compared: chunks are grouped by digest and text, and a digest that two different texts share takes no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import field, named, parted, passing, row_key, whole, written

MIN_WORDS = 50
#: A gap's rolling hash is a boundary if this many of its bits are zero; a chunk ends after so many lines at the latest.
MASK_BITS, MAX_LINES = 3, 64
#: Fixed values of the rolling hash: factor and modulus.
FACTOR, MODULUS = 257, 65_521


def _words(line: Column) -> Column:
    """Words between blanks; a line without any has none."""
    return F.when(F.trim(line) == "", 0).otherwise(F.size(F.split(F.trim(line), r"\s+")))


def _value(line: Column) -> Column:
    """What the rolling hash is made of: the first 28 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rk, pos, a, b, words, next_words, masked) per line.

    a is the line's hash, b the following line's (null at the end); masked tells whether the gap between them falls under the mask.
    """
    lines = F.split(named(text_col), "\n", -1)
    told = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), _words(x).cast("int").alias("w"), _value(x).alias("v")))
    rows = docs.where(named(text_col).isNotNull()).select(named(id_col).alias("id"), row_key(text_col).alias("rk"), told.alias("t"))
    paired = F.arrays_zip(F.col("t").alias("l"), F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))).alias("r"))
    rolled = (F.col("p.l.v") * FACTOR + F.col("p.r.v")) % MODULUS
    return rows.select("id", "rk", F.posexplode(paired).alias("pos", "p")).select(
        "id", "rk", "pos", F.col("p.l.h").alias("a"), F.col("p.r.h").alias("b"), F.col("p.l.w").alias("words"), F.col("p.r.w").alias("next_words"),
        (rolled % (1 << MASK_BITS) == 0).alias("masked"),
    )


def chunks(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, rk, first, last, words, digest): the chunks that may occur in two places, from ``line_rows``.

    These are the chunks of lines with a repeated gap beside them, and repeated lines of ``min_words`` words alone.
    """
    gap = F.struct(F.lit(False).alias("alone"), F.col("a").alias("a"), F.col("b").alias("b"))
    long_line = F.struct(F.lit(True).alias("alone"), F.col("a").alias("a"), F.col("a").alias("b"))
    units = F.array_compact(F.array(F.when(F.col("b").isNotNull(), gap), F.when(F.col("words") >= min_words, long_line)))
    met = rows.select("id", "rk", "pos", F.col("a").alias("h"), F.col("b").alias("nh"), "words", "next_words", "masked", F.explode(units).alias("u")).select("*", "u.*").drop("u")
    place = F.xxhash64("id", "rk", "pos")
    seen = met.groupBy("alone", "a", "b").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("alone", "a", "b")
    repeated = met.join(written(seen, "line-gaps"), ["alone", "a", "b"]).drop("a", "b")
    # one exchange by document serves all that follows; equal rows are one document
    own = repeated.repartition("id", "rk").dropDuplicates(["id", "rk", "pos", "alone"])
    doc = Window.partitionBy("id", "rk")
    beside = F.max(F.when(~F.col("alone"), True)).over(doc.orderBy("pos").rangeBetween(-1, 0))
    own = own.withColumn("beside", beside).where(~F.col("alone") | F.col("beside").isNull())
    order = doc.orderBy("pos")
    before, after = F.lag("pos").over(order), F.lead("pos").over(order)
    own = own.withColumns({"joined": F.coalesce((before == F.col("pos") - 1) & ~F.lag("alone").over(order), F.lit(False)) & ~F.col("alone"), "ends": F.coalesce(after != F.col("pos") + 1, F.lit(True)), "cut": F.coalesce(F.lag("masked").over(order), F.lit(False))})
    line = F.struct("pos", "h", "words", (~F.col("joined") | F.col("cut")).alias("starts"))
    following = F.struct((F.col("pos") + 1).alias("pos"), F.col("nh").alias("h"), F.col("next_words").alias("words"), F.col("masked").alias("starts"))
    lines = own.select("id", "rk", F.explode(F.array_compact(F.array(line, F.when(F.col("ends") & ~F.col("alone"), following)))).alias("l")).select("id", "rk", "l.*")
    start = F.max(F.when(F.col("starts"), F.col("pos"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("start", start)
    first = F.col("pos") - (F.col("pos") - F.col("start")) % MAX_LINES
    whole = lines.groupBy("id", "rk", first.alias("first")).agg(F.max("pos").alias("last"), F.sum("words").alias("words"), F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("hs"))  # MAX_LINES lines at most
    return whole.select("id", "rk", "first", "last", "words", F.xxhash64(F.transform("hs", lambda x: x["h"])).alias("digest"))


def clashing_digests(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Those of the digests of ``found`` (chunks) that stand for different bytes: distinct texts, counted by digest."""
    texts = docs.where(named(text_col).isNotNull()).select(named(id_col).alias("i"), row_key(text_col).alias("k"), named(text_col).alias("t"))
    some = passing(texts, F.xxhash64("i", "k"), found.select(F.xxhash64("id", "rk").alias("k")))
    spans = found.groupBy("id", "rk").agg(F.collect_list(F.struct("first", "last", "digest")).alias("cs"))
    met = some.join(spans.hint("shuffle_hash"), F.expr("i <=> id and k = rk")).select(F.split("t", "\n", -1).alias("ls"), F.explode("cs").alias("c"))
    text = F.array_join(F.slice("ls", F.col("c.first") + 1, F.col("c.last") - F.col("c.first") + 1), "\n")
    distinct = met.select(F.col("c.digest").alias("digest"), text.alias("text")).distinct()
    return distinct.groupBy("digest").count().where("count > 1").select("digest")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, rk, first, last, words): passages to remove, by position of lines from 0; rk tells rows apart that share an id."""
    every = written(chunks(written(line_rows(docs, id_col, text_col), "lines"), min_words), "line-chunks")
    # null ids last
    origin = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rk", "first"))
    place = F.xxhash64("id", "rk", "first")
    again = every.groupBy("digest").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("digest")
    found = written(every.join(again, "digest"), "line-repeated")
    origins = found.groupBy("digest").agg(origin.alias("o"))
    sound = origins.join(clashing_digests(docs, found, id_col, text_col), "digest", "left_anti")
    later = found.join(sound, "digest").where(~(F.col("id").eqNullSafe(F.col("o.id")) & (F.col("rk") == F.col("o.rk")) & (F.col("first") == F.col("o.first"))))
    order = Window.partitionBy("id", "rk").orderBy("first")
    was = lambda c: F.lag(c).over(order)
    goes_on = (was("last") + 1 == F.col("first")) & was("o.id").eqNullSafe(F.col("o.id")) & (was("o.rk") == F.col("o.rk")) & (was("first") - was("o.first") == F.col("first") - F.col("o.first"))
    runs = later.withColumn("fresh", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order))
    spans = runs.groupBy("id", "rk", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("words").alias("words"))
    return spans.where(F.col("words") >= min_words).select("id", "rk", "first", "last", "words")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages removed from ``text_col``, and removed_lines and removed_words.

    Null and empty texts stay as they are. A text whose every line goes becomes empty. Equal rows
    (same id and text) count as one document and keep equal texts; rows that
    share an id but not a text are documents of their own; null ids come last in order. Other columns stay, whatever their names; a column of ``docs``
    named removed_lines or removed_words gives way. An empty table stays empty.
    """
    new = ("removed_lines", "removed_words")
    own = [c for c in docs.columns if c not in new]
    spans = repeated_spans(docs.select(named(id_col), named(text_col)), id_col, text_col, min_words)
    gone = spans.groupBy("id", "rk").agg(
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("cuts"), F.sum(F.col("last") - F.col("first") + 1).alias("lines"), F.sum("words").alias("words")
    )
    gone = written(gone, "line-cuts")
    # all columns of docs travel in one struct, so that no name of theirs can clash; only documents with cuts are shuffled
    keyed = docs.select(whole(docs, own), named(id_col).alias("i"), row_key(text_col).alias("k"))
    some, others = parted(keyed, F.xxhash64("i", "k"), gone.select(F.xxhash64("id", "rk").alias("k")))
    none = [F.lit(None).cast(t).alias(c) for c, t in gone.dtypes]
    met = some.join(gone.hint("shuffle_hash"), F.expr("i <=> id and k = rk"), "left").unionByName(others.select("*", *none))
    old, cuts = field(docs, text_col, own), F.col("cuts")
    lines = F.split(old, "\n", -1)
    # the lines between one cut and the next: each line is copied once
    start = lambda n: F.when(n == 0, 0).otherwise(F.get(cuts, n - 1)["last"] + 1)
    stop = lambda n: F.coalesce(F.get(cuts, n)["first"], F.size(lines))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda n: F.slice(lines, start(n) + 1, stop(n) - start(n))))
    text = F.when(cuts.isNull(), old).otherwise(F.array_join(kept, "\n"))
    return met.select(
        *[(text if c == text_col else field(docs, c, own)).alias(c) for c in own],
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(n) for c, n in zip(("lines", "words"), new)],
    )
