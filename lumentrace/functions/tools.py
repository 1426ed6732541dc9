"""Digests, hash identification and JWT inspection (TOOL-01..03)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import let

#: Kinds of hash by number of hexadecimal digits, and by beginning.
BY_LENGTH = {
    32: ["MD5", "NTLM", "MD4", "LM hash"], 40: ["SHA-1", "MySQL5"], 56: ["SHA-224", "SHA3-224"], 64: ["SHA-256", "SHA3-256"],
    96: ["SHA-384", "SHA3-384"], 128: ["SHA-512", "SHA3-512"], 8: ["CRC32"],
}
BY_PREFIX = (("$2a$", "bcrypt"), ("$2b$", "bcrypt"), ("$2y$", "bcrypt"), ("$1$", "MD5crypt"), ("$6$", "SHA-512crypt"), ("$argon2", "Argon2"))


def digests(content: Column) -> Column:
    """struct<md5, sha1, sha256, sha512, size> of a binary column (TOOL-01)."""
    return F.struct(F.md5(content).alias("md5"), F.sha1(content).alias("sha1"), F.sha2(content, 256).alias("sha256"), F.sha2(content, 512).alias("sha512"), F.octet_length(content).cast("long").alias("size"))


def identify_hash(text: Column) -> Column:
    """array<string>: algorithms that a bare hash may come from (TOOL-02)."""
    h = F.trim(text)
    none = F.array().cast("array<string>")
    by_length = none
    for n, kinds in BY_LENGTH.items():
        by_length = F.when(h.rlike("^[0-9a-fA-F]+$") & (F.length(h) == n), F.array(*map(F.lit, kinds))).otherwise(by_length)
    by_prefix = none
    for prefix, kind in BY_PREFIX:
        by_prefix = F.when(F.startswith(h, F.lit(prefix)), F.array(F.lit(kind))).otherwise(by_prefix)
    wrapped = F.when((F.length(h) == 44) & F.endswith(h, F.lit("=")), F.array(F.lit("SHA-256 (base64-encoded)"))).otherwise(none)
    return F.concat(by_length, by_prefix, wrapped)


def _json_part(segment: Column) -> Column:
    body = F.regexp_replace(segment, "=+$", "")
    ok = body.rlike("^[A-Za-z0-9_-]+$") & (F.length(body) % 4 != 1)
    text = F.when(ok, F.try_to_binary(F.translate(body, "-_", "+/"), F.lit("base64"))).cast("string")
    return F.when(F.regexp_like(text, F.lit("^\\s*\\{")) & F.json_object_keys(text).isNotNull(), text)


def decode_jwt(token: Column, now: Column) -> Column:
    """struct<valid, header json, payload json, warnings> at the time ``now`` (epoch seconds); the signature isn't checked (TOOL-03)."""
    parts = F.split(F.trim(token), "\\.")
    read = lambda p: F.struct((F.size(p) == 3).alias("three"), _json_part(F.get(p, F.lit(0))).alias("header"), _json_part(F.get(p, F.lit(1))).alias("payload"))
    return let(let(parts, read), lambda j: _told(j, now))


def _told(j: Column, now: Column) -> Column:
    header, payload = j["header"], j["payload"]
    valid = j["three"] & header.isNotNull() & payload.isNotNull()
    number = lambda name: F.floor(F.get_json_object(payload, f"$.{name}").try_cast("double")).cast("long")
    stamp = lambda n: F.date_format(F.timestamp_seconds(n), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    warnings = F.array_compact(
        F.array(
            F.when(F.lower(F.get_json_object(header, "$.alg")) == "none", F.lit("alg=none: the token claims to need no signature")),
            F.when(number("exp") < now, F.concat(F.lit("Token expired at "), stamp(number("exp")))),
            F.when(number("nbf") > now, F.concat(F.lit("Token not valid until "), stamp(number("nbf")))),
        )
    )
    none = F.lit(None).cast("string")
    return F.struct(
        F.coalesce(valid, F.lit(False)).alias("valid"), F.when(valid, header).otherwise(none).alias("header"), F.when(valid, payload).otherwise(none).alias("payload"),
        F.when(valid, warnings).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
