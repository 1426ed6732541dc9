"""Longest-prefix match against tables of prefixes of several lengths: ranges of addresses, registries of vendors (NET-01, NET-02, HW-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.network import ipv4_number
from ..functions.regex import let


def _v6_bits(text: Column) -> Column:
    """128 bits of an IPv6 address as a string of 0 and 1, null if it is none; a dotted end counts as two groups."""
    tail = ipv4_number(F.regexp_extract(text, "[^:]*$", 0))
    pair = F.concat(F.lower(F.hex(F.shiftright(tail, 16))), F.lit(":"), F.lower(F.hex(tail.bitwiseAND(65535))))
    whole = F.when(F.contains(text, F.lit(".")), F.concat(F.regexp_extract(text, "^.*:", 0), pair)).otherwise(text)

    def told(s: Column) -> Column:
        sides = F.split(s, "::", -1)
        groups = lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":", -1))
        left, right = groups(sides[0]), F.coalesce(groups(F.get(sides, F.lit(1))), F.array().cast("array<string>"))
        n = F.size(left) + F.size(right)
        fits = F.when(F.size(sides) == 1, n == 8).otherwise((F.size(sides) == 2) & (n <= 7))
        every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), right)
        sound = F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(fits & sound, F.array_join(F.transform(every, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), ""))

    return let(F.lower(whole), told)


def address_bits(ip: Column) -> Column:
    """4 and 32 bits, or 6 and 128 bits, as a string; null for what is no address. An IPv4 address mapped into IPv6 counts as itself."""
    mapped = "0" * 80 + "1" * 16

    def told(s: Column) -> Column:
        six = F.when(F.startswith(s["six"], F.lit(mapped)), F.concat(F.lit("4"), F.right(s["six"], F.lit(32)))).otherwise(F.concat(F.lit("6"), s["six"]))
        return F.when(s["four"].isNotNull(), F.concat(F.lit("4"), F.lpad(F.bin(s["four"]), 32, "0"))).otherwise(six)

    return let(F.struct(ipv4_number(ip).alias("four"), F.when(F.contains(ip, F.lit(":")), _v6_bits(ip)).alias("six")), told)


def range_bits(cidr: Column) -> Column:
    """The leading bits that all addresses of a range such as 10.0.0.0/8 share, as of ``address_bits``; a single address has all of them. Null for what is no range."""
    bits, n = address_bits(F.split_part(cidr, F.lit("/"), F.lit(1))), F.split_part(cidr, F.lit("/"), F.lit(2))
    length = F.when(F.contains(cidr, F.lit("/")), n.try_cast("int")).otherwise(F.length(bits) - 1)
    return let(F.struct(bits.alias("b"), length.alias("n")), lambda s: F.when(s["n"].between(0, F.length(s["b"]) - 1), F.left(s["b"], s["n"] + 1)))


def hexadecimal(text: Column) -> Column:
    """Hexadecimal digits of a hardware address or of a registry's prefix, upper case, without what parts them."""
    return F.upper(F.regexp_replace(text, "[^0-9A-Fa-f]", ""))


def longest_prefix(df: DataFrame, value: Column, table: DataFrame, prefix: Column, entry: str = "entry") -> DataFrame:
    """``df`` with ``entry``: the row of ``table`` whose prefix is the longest that ``value`` begins with, null where there is none.

    Only equal strings are joined: each distinct value is cut to every length that the table has, at most some hundred. Of rows with the same prefix the least one
    counts, so columns must be orderable; null values and prefixes match nothing. A frequent value is looked up once.
    """
    held = table.select(prefix.alias("p"), F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in table.columns]).alias("e")).where("p is not null")
    held = held.groupBy("p").agg(F.min("e").alias("e"))
    lengths = sorted(r.n for r in held.select(F.length("p").alias("n")).distinct().collect())
    rows = df.withColumn("_value", value)
    values = rows.select(F.col("_value").alias("_found")).where("_found is not null").distinct()
    cut = F.array_compact(F.array(*[F.when(F.length("_found") >= n, F.left("_found", F.lit(n))) for n in lengths])) if lengths else F.array().cast("array<string>")
    met = values.select("_found", F.explode(cut).alias("p")).join(held, "p")
    best = met.groupBy("_found").agg(F.max_by("e", F.length("p")).alias(entry))
    return rows.join(best, F.col("_value") == F.col("_found"), "left").drop("_value", "_found")
