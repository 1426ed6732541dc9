"""A content-addressed WARC archive in two tables.

``payloads`` holds the bytes of each distinct payload once under its SHA-256;
``records`` holds each record's exact header block with the digest of its payload. A record
is its header, its payload found by joining on the digest, and two line ends. Of
records with equal payloads of ``min_revisit`` bytes or more the one with the largest
id is the response and the others revisit it; a revisit has no payload of its own.

Digests are verified: bytes count as equal only if SHA-256, SHA-1 and length agree, and reading
back computes each digest from the stored bytes again and fails on a difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parted, passing, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_archive(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 1000, date: str = "2000-01-01T00:00:00Z"
) -> tuple[DataFrame, DataFrame]:
    """(records, payloads) written to the shared folder.

    A null payload is empty, a null url leaves its header out, line ends within a url are
    percent-encoded; urls may hold any other character. A null id has a record id of its own form and owns a payload
    only if no other id has it. Rows that repeat an id and a payload are each the response if
    that id is the largest. An empty table gives empty archives; other columns are ignored.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    url = F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), payload.alias("payload"))
    digests = written(
        rows.select("id", "url", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n")), "warc-digests"
    )
    owners = digests.groupBy("sha256", "sha1", "n").agg(F.max("id").alias("owner"), F.count("*").alias("copies"))
    # only payloads that may have copies, and of these the rows that may own them, are moved to be joined
    repeated = owners.where("copies > 1").select(F.xxhash64("sha256").alias("k"))
    some, single = parted(rows.select("id", F.sha2("payload", 256).alias("digest"), "payload"), F.xxhash64("digest"), repeated)
    some = passing(some, F.xxhash64("id", "digest"), owners.select(F.xxhash64("owner", "sha256").alias("k")))
    own = F.expr("id <=> owner and digest = sha256")
    kept = some.join(owners.select("owner", "sha256"), own, "left_semi").dropDuplicates(["id", "digest"])
    payloads = written(single.select("digest", "payload").unionByName(kept.select("digest", "payload")), "warc-payloads")
    met = digests.join(owners, ["sha256", "sha1", "n"])
    revisit = (F.col("n") >= min_revisit) & ~F.col("id").eqNullSafe(F.col("owner"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(F.col(c).cast("string")), F.lit(">")), F.lit("<urn:nopage>"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn("owner")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
    )
    return written(met.select(header.cast("binary").alias("header"), F.col("sha256").alias("digest"), revisit.alias("is_revisit")), "warc-records"), payloads


def reconstruct(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """(record binary, digest, payload_sha1, payload_bytes): header, payload and two line ends of every response and revisit.

    For a revisit, digest, payload_sha1 and payload_bytes tell of the payload it stands for. Fails if
    stored bytes don't have the digest they are stored under.
    """
    sound = F.assert_true(F.sha2("payload", 256) == F.col("digest"), F.lit("a stored payload differs from its digest"))
    checked = payloads.select("digest", "payload", F.sha1("payload").alias("payload_sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"), sound.alias("sound")).where("sound is null")
    end = F.lit(b"\r\n\r\n")
    full = (
        records.where("not is_revisit").join(checked, "digest")
        .select(F.concat("header", "payload", end).alias("record"), "digest", "payload_sha1", "payload_bytes")
    )
    bare = (
        records.where("is_revisit").join(checked.select("digest", "payload_sha1", "payload_bytes"), "digest")
        .select(F.concat("header", end).alias("record"), "digest", "payload_sha1", "payload_bytes")
    )
    return full.unionByName(bare)


def read_archive(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """Per record, parsed from its reconstructed bytes: id, url (as string), record_type, refers_to, payload_bytes, payload_digest.

    The header ends at the first empty line, searched and cut by bytes. The id of a record written for a null id is null.
    """
    got = reconstruct(records, payloads)
    blank = F.instr(F.decode("record", "ISO-8859-1"), "\r\n\r\n")  # one character a byte
    head = got.select(F.substring("record", F.lit(1), blank + 1).cast("string").alias("head"), F.octet_length("record").alias("size"), "payload_sha1", "payload_bytes")
    field = lambda name, value: F.regexp_extract("head", rf"\r\n{name}: {value}\r\n", 1)
    page = lambda name: F.when(F.contains("head", F.lit(f"\r\n{name}: <urn:page:")), F.url_decode(field(name, "<urn:page:([^>\r]*)>")))
    told = F.regexp_extract("head", r"\r\nWARC-Payload-Digest: sha1:([0-9a-f]+)\r\n", 1)
    fails = F.raise_error(F.lit("a header's digest or length differs from the payload's"))
    return head.select(
        page("WARC-Record-ID").alias("id"),
        F.nullif(field("WARC-Target-URI", "([^\r]*)"), F.lit("")).alias("url"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        "payload_bytes",
        F.when((told == F.col("payload_sha1")) & (field("Content-Length", "([0-9]+)").cast("long") == F.col("size") - F.octet_length("head") - 6), told).otherwise(fails).alias("payload_digest"),
    )
