"""Predicates on bytes and texts: sniffing, gates, paths, truncation (SRC-03..05, FIL-07..09, ENC-11, CRK-02)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TEXT = 5 * 1024 * 1024
SNIFF = 8192


def size_ok(length: Column, most: int = MAX_TEXT) -> Column:
    """1 byte to ``most``, 5 MiB as a rule (SRC-03)."""
    return length.between(1, most)


def _latin(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def printable_ratio(content: Column) -> Column:
    """Share of bytes that are tab, line ends or printable ASCII; bytes are counted as Latin-1 characters."""
    return F.try_divide(F.regexp_count(_latin(content), F.lit("[\\t\\n\\r\\x20-\\x7E]")), F.octet_length(content))


def looks_like_text(content: Column) -> Column:
    """Of the first 8192 bytes: no NUL, and more than 0.85 printable, or more than 0.60 and valid UTF-8 (SRC-04)."""
    head = F.substring(content, 1, SNIFF)
    ratio = printable_ratio(head)
    ok = ~F.contains(head, F.unhex(F.lit("00"))) & ((ratio > 0.85) | ((ratio > 0.60) & F.is_valid_utf8(head.cast("string"))))
    return F.coalesce((F.octet_length(content) > 0) & ok, F.lit(False))


def looks_meaningful(content: Column) -> Column:
    """Decoded bytes that read as text: four bytes or more when trimmed, no NUL, and as above but without U+FFFD (ENC-11)."""
    trimmed = F.regexp_replace(_latin(content), "^[\\t-\\r \\x85\\xA0]+|[\\t-\\r \\x85\\xA0]+$", "")
    ratio = printable_ratio(content)
    valid = F.is_valid_utf8(content.cast("string")) & ~F.contains(content, F.encode(F.lit("�"), "UTF-8"))
    return F.coalesce((F.length(trimmed) >= 4) & ~F.contains(content, F.unhex(F.lit("00"))) & ((ratio > 0.85) | ((ratio > 0.60) & valid)), F.lit(False))


def extracted_text_ok(text: Column) -> Column:
    """At least 20 bytes when trimmed, and more than 0.75 of what isn't blank are letters or digits (SRC-05)."""
    trimmed = F.regexp_replace(text, "^\\s+|\\s+$", "")
    solid = F.regexp_count(text, F.lit("[^ \\n\\t\\r]"))
    alnum = F.regexp_count(text, F.lit("[\\p{L}\\p{Nd}]"))
    return F.coalesce((F.octet_length(trimmed) >= 20) & (solid > 0) & (alnum / F.greatest(solid, F.lit(1)) > 0.75), F.lit(False))


def sentence_like(text: Column) -> Column:
    """Four words or more, of which 0.7 or more are of two letters or more and letters only (CRK-02)."""
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    clean = F.filter(words, lambda w: F.regexp_replace(w, "[.,!?;:'\"]+$", "").rlike("^\\p{L}+$") & (F.octet_length(F.regexp_replace(w, "[.,!?;:'\"]+$", "")) >= 2))
    return F.coalesce((F.size(words) >= 4) & (F.size(clean) / F.greatest(F.size(words), F.lit(1)) >= 0.7), F.lit(False))


def hidden_path(path: Column) -> Column:
    """A base name that begins with a dot and is longer than it (FIL-07)."""
    base = F.regexp_extract(path, "[^/]+$", 0)
    return F.coalesce(base.startswith(".") & (F.length(base) > 1), F.lit(False))


def real_domain(domain: Column) -> Column:
    """Not a local name (FIL-08)."""
    d = F.lower(domain)
    local = (d == "localhost") | d.endswith(".local") | d.endswith(".test") | d.endswith(".dev") | d.endswith(".internal")
    return F.coalesce(~local & F.contains(d, F.lit(".")), F.lit(False))


def truncated(text: Column, n: int) -> Column:
    """The first ``n`` bytes and three dots; a character cut in two shows as U+FFFD (FIL-09)."""
    raw = F.encode(text, "UTF-8")
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(F.make_valid_utf8(F.substring(raw, 1, n).cast("string")), F.lit("...")))


def domain_of(url: Column) -> Column:
    """Host of a url, lower-cased, without port; null if it can't be parsed (SW-15)."""
    return F.lower(F.regexp_extract(F.try_parse_url(url, F.lit("HOST")), "^\\[?([^\\]]*)\\]?$", 1))
