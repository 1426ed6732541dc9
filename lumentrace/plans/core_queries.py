"""Registered queries of language, entropy, encoding, cipher, statistics, network, reference and report operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ciphers as C
from ..functions import native_ciphers as N
from ..functions import statistics as S
from ..functions import tables as T
from ..functions import text as X
from ..functions.entropy import band, entropy, high_entropy
from ..functions.network import V4_BLOCKS, classify_ip, hex_address
from ..functions.severity import is_flagged, severity_rank
from ..functions.tools import BY_LENGTH, BY_PREFIX, decode_jwt, digests, identify_hash
from ..operators import crack, encodings, entropy_windows, filesig, intel, language, pii_scan, report
from . import scan as scans
from .pii_queries import _found_sql, _quoted

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "text")


# --- language -----------------------------------------------------------------------------------------------------

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}]+')"


def _hits(words: list[str]) -> str:
    return f"len(list_filter(t, lambda w: w in ({', '.join(map(_quoted, words))})))"


_SCORES = ", ".join(f"case when len(t) > 0 then {_hits(ws)} / len(t) else 0.0 end as {c}" for c, (_, ws) in language.PROFILES.items())
_BEST = "greatest(de, en, es, fr)"
_LANG = "case " + " ".join(f"when {c} = {_BEST} then '{c}'" for c in language.PROFILES) + " end"
_DETECT = f"(select *, case when {_BEST} >= 0.08 then {_LANG} end as language, {_BEST} as confidence from (select *, {_SCORES} from (select doc_id, text, {_TOKENS} as t from documents)))"


@query("lang_detect", f"select doc_id, language, round(confidence, 9) as confidence, cast(len(t) as bigint) as tokens_checked from {_DETECT}")
def lang_detect(spark, sf_dir):
    """LNG-01, LNG-03."""
    return language.detect(_docs(spark, sf_dir), "text").select("doc_id", "language", F.round("confidence", 9).alias("confidence"), "tokens_checked")


@query("lang_scores", f"select doc_id, round(de, 9) as de, round(en, 9) as en, round(es, 9) as es, round(fr, 9) as fr from {_DETECT}")
def lang_scores(spark, sf_dir):
    """LNG-02."""
    s = language.language_scores(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", s.alias("s")).select("doc_id", *[F.round(F.col("s")[c], 9).alias(c) for c in language.PROFILES])


_PAIRS = "(select doc_id, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) as ps from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') as t from {}))"
_TOP_PAIRS = "select p as text, count(*) as popularity from (select unnest(ps) as p from {}) group by p having count(*) >= 2 order by popularity desc, text limit 5000"


@query("derive_bigrams_topk", _TOP_PAIRS.format(_PAIRS.format("documents")))
def derive_bigrams(spark, sf_dir):
    """SRC-11: the 5000 most frequent word pairs."""
    return language.derive_bigrams(_docs(spark, sf_dir), "text")


@query(
    "bigram_plausibility",
    f"with b as ({_TOP_PAIRS.format(_PAIRS.format('documents'))}), p as (select doc_id, unnest(case when len(ps) > 0 then ps else [null] end) as pair from {_PAIRS.format('documents')}) "
    "select doc_id, round(coalesce(count(b.text) / nullif(count(pair), 0), 0), 9) as score from p left join b on p.pair = b.text group by doc_id",
)
def bigram_plausibility(spark, sf_dir):
    """LNG-04 against pairs derived from the documents themselves."""
    d = _docs(spark, sf_dir)
    return language.bigram_plausibility(d, "doc_id", "text", language.derive_bigrams(d, "text")).select("doc_id", F.round("score", 9).alias("score"))


@query("popularity_dedup", "select text, popularity from (select *, row_number() over (partition by lower(text) order by popularity desc, text) as n from (select w as text, count(*) as popularity from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from documents) group by w)) where n = 1")
def popularity_dedup(spark, sf_dir):
    """LNG-06 over the documents' words in their own case."""
    words = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("text")).groupBy("text").agg(F.count("*").alias("popularity"))
    return language.dedup_by_popularity(words)


_DICT = "(select w as text, min(d) as definition from (select unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) as w, 'see ' || cast(item_id as varchar) || '; item' as d from benchmark) group by w)"


def _dictionary(spark, sf_dir):
    b = _t(spark, sf_dir, "benchmark")
    rows = b.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("text"), F.concat(F.lit("see "), F.col("item_id").cast("string"), F.lit("; item")).alias("definition"))
    return rows.groupBy("text").agg(F.min("definition").alias("definition"))


_TRIMMED = """list_filter(list_transform(list_filter(string_split_regex(text, '[\\t\\n\\x0b\\f\\r ]+'), lambda w: w <> ''), lambda w: regexp_replace(regexp_replace(w, '^[.,!?;:"'']+', ''), '[.,!?;:"'']+$', '')), lambda w: w <> '')"""


@query(
    "dictionary_gloss",
    f"""with d as {_DICT}, k as (select conv_id * 1000 + turn as id, {_TRIMMED} as t from conversations), r as (select id, i, t[i] as w from (select id, t, unnest(range(1, len(t) + 1)) as i from k)),
    m as (select r.*, d.definition from r left join d on lower(w) = d.text)
    select k.id, '' as language, count(w) as tokens, count(definition) as found, round(coalesce(100.0 * count(definition) / nullif(count(w), 0), 0), 6) as coverage,
      coalesce(string_agg(coalesce(left(trim(split_part(definition, ';', 1)), 40), w), ' ' order by i), '') as rough from k left join m on k.id = m.id group by k.id""",
)
def dictionary_gloss(spark, sf_dir):
    """LNG-09 of conversations, with words of the benchmark as dictionary."""
    c = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return language.gloss(c, "id", "text", _dictionary(spark, sf_dir))


@query("word_lookup", f"with d as {_DICT} select w, n, d.definition from (select w, count(*) as n from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from conversations) group by w) left join d on lower(w) = d.text")
def word_lookup(spark, sf_dir):
    """LNG-05: words of conversations in the dictionary, regardless of case."""
    words = _t(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return language.lookup(words, "w", _dictionary(spark, sf_dir)).select("w", "n", "definition")


@query("sentence_parts", f"""with d as {_DICT}, w as (select item_id, list_transform(list_filter(string_split_regex(lower(text), '[\\t\\n\\x0b\\f\\r ]+'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '^[.,!?;:"'']+', ''), '[.,!?;:"'']+$', '')) as ws from benchmark)
  select item_id, cast(i - 1 as int) as position, ws[i] as text from (select item_id, ws, unnest(range(1, len(ws) + 1)) as i from w) where ws[i] in (select text from d)""")
def sentence_parts(spark, sf_dir):
    """LNG-07: known words of benchmark sentences."""
    return language.sentence_parts(_t(spark, sf_dir, "benchmark"), "item_id", "text", _dictionary(spark, sf_dir))


# --- entropy, text predicates --------------------------------------------------------------------------------------

_HEX = "hex(encode(text))"
_BYTES = "unnest(list_transform(range(1, strlen({0}) + 1), lambda i: substr(hex(encode({0})), 2 * i - 1, 2)))"
_BAND = "case when {0} < 4 then 'low' when {0} < 5.5 then 'plaintext' when {0} < 7 then 'executable' when {0} < 7.9 then 'compressed' else 'encrypted' end"
_ENTROPY = f"(select doc_id, text, coalesce(e, 0) as bits from documents left join (select doc_id, entropy(b) as e from (select doc_id, {_BYTES.format('text')} as b from documents) group by doc_id) using (doc_id))"


@query("shannon_entropy", f"select doc_id, round(bits, 9) as bits, {_BAND.format('round(bits, 9)')} as band, strlen(text) >= 24 and round(bits, 9) >= 4.6 as high from {_ENTROPY}")
def shannon_entropy(spark, sf_dir):
    """ENT-01..03."""
    raw = F.encode("text", "UTF-8")
    d = _docs(spark, sf_dir).select("doc_id", raw.alias("c")).withColumn("bits", F.round(entropy(F.col("c")), 9))
    return d.select("doc_id", "bits", band(F.col("bits")).alias("band"), high_entropy(F.col("c"), F.col("bits")).alias("high"))


_WINDOWS = """(select id, o as "offset", round(entropy(b), 9) as entropy from (select id, o, unnest(list_transform(range(o + 1, least(o + {1}, n) + 1), lambda i: substr(h, 2 * i - 1, 2))) as b
  from (select *, unnest(range(0, n, {1})) as o from (select {2} as id, hex(encode({3})) as h, strlen({3}) as n from {0})) where n - o >= 64) group by id, o)"""


@query("entropy_windows", f"select id as doc_id, \"offset\", entropy from {_WINDOWS.format('documents', 4096, 'doc_id', 'text')}")
def windows_4096(spark, sf_dir):
    """ENT-04."""
    d = _docs(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("c"))
    return entropy_windows.windows(d, "doc_id", "c").select("doc_id", "offset", F.round("entropy", 9).alias("entropy"))


@query("entropy_windows_256", f"select id as page_id, \"offset\", entropy from {_WINDOWS.format('pages', 256, 'page_id', 'html')}")
def windows_256(spark, sf_dir):
    """ENT-04 with small windows over pages."""
    d = _t(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("c"))
    return entropy_windows.windows(d, "page_id", "c", 256).select("page_id", "offset", F.round("entropy", 9).alias("entropy"))


_FLAT = "(select page_id, repeat('aaaabbbbccccdddd', 64) || html as html from pages)"


@query(
    "entropy_spike",
    f"""with w as {_WINDOWS.format(_FLAT, 256, 'page_id', 'html')}, l as (select id, list(struct_pack(o := "offset", e := entropy) order by "offset") as w from w group by id having count(*) >= 4),
    b as (select id, list_sort(list_transform(w[1:len(w) // 2], lambda x: x.e))[len(w) // 2 // 2 + 1] as before, w[len(w) // 2 + 1:] as late from l)
    select id as page_id, hit.o as "offset", before, hit.e as after from (select id, before, list_filter(late, lambda x: x.e - before >= 1.5 and {_BAND.format('(x.e + 3)')} in ('compressed', 'encrypted'))[1] as hit from b where before < 7) where hit is not null""",
)
def entropy_spike(spark, sf_dir):
    """ENT-05 on a flat beginning followed by a page; entropies of texts are raised by three bits so that the bands are met."""
    html = F.concat(F.repeat(F.lit("aaaabbbbccccdddd"), 64), F.col("html"))
    d = _t(spark, sf_dir, "pages").select("page_id", F.encode(html, "UTF-8").alias("c"))
    w = entropy_windows.windows(d, "page_id", "c", 256).withColumn("entropy", F.round("entropy", 9) + 3)
    got = entropy_windows.spikes(w, "page_id")
    return got.select("page_id", "offset", F.round(F.col("before") - 3, 9).alias("before"), F.round(F.col("after") - 3, 9).alias("after"))


# a string's first bytes are cut out in hexadecimal; cut texts of these pages are valid but where the cut splits a character
@query("text_sniff", """select page_id, coalesce(n > 0 and not contains(h, '00,') and (ratio > 0.85 or (ratio > 0.6 and whole)), false) as is_text
  from (select page_id, n, h, len(regexp_extract_all(h, '(?:[2-6][0-9A-F]|7[0-9A-E]|09|0A|0D),')) / (length(h) / 3) as ratio, n <= 8192 or hex[16385:16385] not in ('8', '9', 'A', 'B') as whole
  from (select page_id, strlen(html) as n, hex(encode(html)) as hex, regexp_replace(left(hex(encode(html)), 16384), '(..)', '\\1,', 'g') as h from pages))""")
def text_sniff(spark, sf_dir):
    """SRC-04 on whole pages, of which the operator itself reads 8192 bytes."""
    return _t(spark, sf_dir, "pages").select("page_id", X.looks_like_text(F.encode("html", "UTF-8")).alias("is_text"))


@query("extracted_text_gate", r"select page_id, coalesce(strlen(trim(html, chr(32) || chr(9) || chr(10) || chr(13))) >= 20 and len(regexp_extract_all(html, '[\p{L}\p{Nd}]')) / greatest(len(regexp_extract_all(html, '[^ \n\t\r]')), 1) > 0.75, false) as ok from pages")
def text_gate(spark, sf_dir):
    """SRC-05."""
    return _t(spark, sf_dir, "pages").select("page_id", X.extracted_text_ok(F.col("html")).alias("ok"))


@query("size_gate", "select page_id, strlen(html) between 1 and 5242880 as ok from pages")
def size_gate(spark, sf_dir):
    """SRC-03."""
    return _t(spark, sf_dir, "pages").select("page_id", X.size_ok(F.octet_length("html")).alias("ok"))


@query("sentence_like", r"""select conv_id, turn, len(ws) >= 4 and len(list_filter(ws, lambda w: regexp_full_match(w, '\p{L}+') and strlen(w) >= 2)) / greatest(len(ws), 1) >= 0.7 as ok
  from (select conv_id, turn, list_transform(list_filter(string_split_regex(text, '[\t\n\x0b\f\r ]+'), lambda w: w <> ''), lambda w: regexp_replace(w, '[.,!?;:''"]+$', '')) as ws from conversations)""")
def sentence_like(spark, sf_dir):
    """CRK-02."""
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", X.sentence_like(F.col("text")).alias("ok"))


@query("hidden_paths", "select page_id, regexp_extract(p, '[^/]+$') like '.%' and length(regexp_extract(p, '[^/]+$')) > 1 as hidden from (select page_id, case when page_id % 3 = 0 then url || '/.cfg' else url end as p from pages)")
def hidden_paths(spark, sf_dir):
    """FIL-07 on urls, every third with a hidden name."""
    p = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/.cfg"))).otherwise(F.col("url"))
    return _t(spark, sf_dir, "pages").select("page_id", X.hidden_path(p).alias("hidden"))


@query("real_domains", "select c_custkey, d not in ('localhost') and not regexp_matches(d, '\\.(local|test|dev|internal)$') and contains(d, '.') as ok from (select c_custkey, lower(list_value('localhost', 'x.Local', 'host', 'a.example.com', 'b.TEST', 'c.dev.org')[1 + c_custkey % 6]) as d from customer)")
def real_domains(spark, sf_dir):
    """FIL-08."""
    names = F.array(*map(F.lit, ["localhost", "x.Local", "host", "a.example.com", "b.TEST", "c.dev.org"]))
    return _t(spark, sf_dir, "customer").select("c_custkey", X.real_domain(F.element_at(names, (1 + F.col("c_custkey") % 6).cast("int"))).alias("ok"))


@query("truncated_names", "select p_partkey, case when strlen(n) > 20 then left(n, 20) || '...' else n end as short from (select p_partkey, p_name || ' ' || p_type as n from part)")
def truncated_names(spark, sf_dir):
    """FIL-09."""
    return _t(spark, sf_dir, "part").select("p_partkey", X.truncated(F.concat_ws(" ", "p_name", "p_type"), 20).alias("short"))


# --- encodings -----------------------------------------------------------------------------------------------------

_RATIO = "len(regexp_extract_all(txt, '[\\t\\n\\r\\x20-\\x7e]')) / strlen(txt)"


@query("enc_base64_detect", rf"""select doc_id, cast(pos as bigint) as pos, left(raw, 60) || case when length(raw) > 60 then '...' else '' end as sample, decodable
  from (select *, not (regexp_matches(b, '[+/]') and regexp_matches(b, '[-_]')) and ((k = 0 and length(b) % 4 <> 1) or (k > 0 and (length(b) + k) % 4 = 0)) as decodable
  from (select *, rtrim(raw, '=') as b, length(raw) - length(rtrim(raw, '=')) as k, row_number() over (partition by doc_id order by pos) as n from ({_found_sql('select doc_id, text from documents', encodings.CANDIDATES['base64'])}))) where n <= 30""")
def enc_base64(spark, sf_dir):
    """ENC-01, ENC-09, ENC-10 for base64."""
    return encodings.detect(_docs(spark, sf_dir), "doc_id", "text", ["base64"]).select("doc_id", "pos", "sample", "decodable")


@query("enc_hex_detect", rf"""select doc_id, cast(pos as bigint) as pos, left(raw, 60) || case when length(raw) > 60 then '...' else '' end as sample, length(raw) % 2 = 0 as decodable
  from (select *, row_number() over (partition by doc_id order by pos) as n from ({_found_sql('select doc_id, text from documents', encodings.CANDIDATES['hex'])})) where n <= 30""")
def enc_hex(spark, sf_dir):
    """ENC-02, ENC-09, ENC-10 for hexadecimal."""
    return encodings.detect(_docs(spark, sf_dir), "doc_id", "text", ["hex"]).select("doc_id", "pos", "sample", "decodable")


def _coded(spark, sf_dir, f):
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("é code "), f(F.col("text")), F.lit(" end")).alias("text"))


_WHOLE = "(select item_id as doc_id, text as txt from benchmark)"


def _kind_sql(kind: str, coded: str) -> str:
    return rf"""select doc_id, '{kind}' as kind, cast(pos as bigint) as pos, txt as decoded from ({_found_sql(f"select doc_id, 'é code ' || {coded} || ' end' as text from {_WHOLE}", encodings.CANDIDATES[kind])}) join {_WHOLE} using (doc_id) where {_RATIO} > 0.6 and strlen(trim(txt)) >= 4"""


def _kind_query(kind: str, f):
    def run(spark, sf_dir):
        got = encodings.detect(_coded(spark, sf_dir, f), "doc_id", "text", [kind], shown=None).where("meaningful")
        return got.select("doc_id", "kind", "pos", "decoded")

    run.__doc__ = f"ENC-04..11: texts put into {kind}, found and decoded."
    return run


_ASC = "list_transform(range(1, strlen(txt) + 1), lambda i: cast('0x' || substr(hex(encode(txt)), 2 * i - 1, 2) as int))"
for _kind, _f, _sql in (
    ("decimal", N.decimal_encode, f"array_to_string({_ASC}, ' ')"),
    ("octal", N.octal_encode, f"array_to_string(list_transform({_ASC}, lambda b: cast(cast(b // 64 as int) * 100 + cast(b // 8 % 8 as int) * 10 + b % 8 as varchar)), ' ')"),
):
    QUERIES[f"enc_{_kind}_detect"] = _kind_query(_kind, _f)
    # groups of one digit break a run of numbers in either engine alike, so only whole runs are compared
    ORACLES[f"enc_{_kind}_detect"] = _kind_sql(_kind, _sql) + f" and raw = {_sql}"
QUERIES["enc_url_detect"] = _kind_query("url_encoded", lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
ORACLES["enc_url_detect"] = _kind_sql("url_encoded", "regexp_replace(hex(encode(txt)), '(..)', '%\\1', 'g')")
QUERIES["enc_binary_detect"] = _kind_query("binary", N.binary_encode)
ORACLES["enc_binary_detect"] = _kind_sql("binary", f"array_to_string(list_transform({_ASC}, lambda b: lpad(bin(b), 8, '0')), ' ')")


@query("enc_all_detect")
def enc_all(spark, sf_dir):
    """ENC-10 over documents with all kinds at once."""
    return encodings.detect(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", "kind", "pos", "sample", "decodable", "meaningful", "decoded")


@query("enc_findings")
def enc_findings(spark, sf_dir):
    """ENC-12."""
    return encodings.findings(encodings.detect(_docs(spark, sf_dir), "doc_id", "text"), "doc_id").groupBy("subtype", "severity").agg(F.count("*").alias("n"))


@query("enc_roundtrip", "select doc_id, md5(to_base64(encode(text))) as b64, md5(lower(hex(encode(text)))) as hex, true as same from documents")
def enc_roundtrip(spark, sf_dir):
    """ENC-01, ENC-02 there and back over whole documents."""
    d = _docs(spark, sf_dir)
    b, h = N.base64_encode(F.col("text")), N.hex_encode(F.col("text"))
    same = (N.base64_decode(b).cast("string") == F.col("text")) & (N.hex_decode(h).cast("string") == F.col("text"))
    return d.select("doc_id", F.md5(b).alias("b64"), F.md5(h).alias("hex"), same.alias("same"))


_MORSE = "map {" + ", ".join(f"'{c}': '{m}'" for c, m in N.MORSE.items()) + "}"


@query("enc_morse", rf"""select item_id, array_to_string(list_filter(list_transform(list_filter(string_split_regex(lower(text), '[\t\n\x0b\f\r ]+'), lambda w: w <> ''),
  lambda w: array_to_string(list_filter(list_transform(regexp_extract_all(w, '[a-z0-9]'), lambda c: {_MORSE}[c]), lambda c: c is not null), ' ')), lambda w: w <> ''), ' / ') as morse from benchmark""")
def enc_morse(spark, sf_dir):
    """ENC-06."""
    return _t(spark, sf_dir, "benchmark").select("item_id", N.morse_encode(F.col("text")).alias("morse"))


@query("enc_leet", "select doc_id, md5(translate(text, 'oieastbOIEASTB', '01345780134578')) as leet, md5(translate(text, '0134578@$', 'oieastbas')) as plain from documents")
def enc_leet(spark, sf_dir):
    """ENC-08."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(N.leet_encode(F.col("text"))).alias("leet"), F.md5(N.leet_decode(F.col("text"))).alias("plain"))


# --- ciphers -------------------------------------------------------------------------------------------------------


def _translate_sql(source: str, target: str) -> str:
    return f"md5(translate(text, {_quoted(source)}, {_quoted(target)}))"


_AZ = N.UPPER + N.LOWER
_PRINT = "".join(map(chr, range(33, 127)))


def _order_table(order: str, by: int) -> tuple[str, str]:
    to = dict(zip(order, N.rotate(order, by)))
    full = dict(to)
    for c, x in to.items():
        for o in (c.lower(), c.upper()):
            full.setdefault(o, x)
    return "".join(full), "".join(full.values())


@query("cipher_translate", "select doc_id, " + ", ".join(f"{s} as {n}" for n, s in {
    "caesar": _translate_sql(_AZ, N.rotate(N.UPPER, 7) + N.rotate(N.LOWER, 7)), "rot13": _translate_sql(_AZ, N.rotate(N.UPPER, 13) + N.rotate(N.LOWER, 13)),
    "atbash": _translate_sql(_AZ, N.UPPER[::-1] + N.LOWER[::-1]), "rot47": _translate_sql(_PRINT, N.rotate(_PRINT, 47)),
    "qwerty": _translate_sql(*_order_table(N.KEYBOARDS["QWERTY"], 2)), "dvorak": _translate_sql(*_order_table(N.KEYBOARDS["DVORAK"], -3)),
}.items()) + " from documents")
def cipher_translate(spark, sf_dir):
    """CIP-01..05, CIP-34 over whole documents, as digests."""
    t = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id", F.md5(N.caesar(t, 7)).alias("caesar"), F.md5(N.rot13(t)).alias("rot13"), F.md5(N.atbash(t)).alias("atbash"), F.md5(N.rot47(t)).alias("rot47"),
        F.md5(N.keyboard(t, 2)).alias("qwerty"), F.md5(N.keyboard(t, -3, "DVORAK")).alias("dvorak"),
    )


def _key_sql(rule: str, key: str) -> str:
    ks = "list_value(" + ", ".join(str(s) for s in N._shifts(key)) + ")"
    n = "length(regexp_replace(substr(text, 1, i - 1), '[^A-Za-z]', '', 'g'))"
    k = f"{ks}[1 + {n} % {len(N._shifts(key))}]"
    c = "substr(text, i, 1)"
    return f"array_to_string(list_transform(range(1, length(text) + 1), lambda i: case when regexp_full_match({c}, '[A-Z]') then chr(cast((({rule.format(c=f'(ascii({c}) - 65)', k=k)}) % 26 + 26) % 26 + 65 as int)) when regexp_full_match({c}, '[a-z]') then chr(cast((({rule.format(c=f'(ascii({c}) - 97)', k=k)}) % 26 + 26) % 26 + 97 as int)) else {c} end), '')"


@query("cipher_vigenere", f"select item_id, {_key_sql('{c} + {k}', 'Secret')} as vigenere, {_key_sql('{k} - {c}', 'Secret')} as beaufort from benchmark")
def cipher_vigenere(spark, sf_dir):
    """CIP-06, CIP-07 over the benchmark's texts."""
    t = F.col("text")
    return _t(spark, sf_dir, "benchmark").select("item_id", N.vigenere(t, "Secret").alias("vigenere"), N.beaufort(t, "Secret").alias("beaufort"))


_CLEAN = "upper(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))"


def _grid_sql(order: list[int]) -> str:
    w = len(order)
    rows = f"cast(ceil(length(t) / {w}) as int)"
    cols = ", ".join(f"list_transform(range(0, {rows}), lambda r: substr(rpad(t, {rows} * {w}, 'X'), cast(r * {w} + {c} + 1 as int), 1))" for c in order)
    return f"array_to_string(flatten(list_value({cols})), '')"


@query("cipher_transpose", f"""select item_id, (select string_agg(substr(t, i + 1, 1), '' order by least(i % 4, 4 - i % 4), i) from (select unnest(range(0, length(t))) as i)) as railfence,
  {_grid_sql([0, 1, 2, 3, 4])} as scytale, {_grid_sql(N.columnar_order('ZEBRA'))} as columnar from (select item_id, {_CLEAN} as t from benchmark)""")
def cipher_transpose(spark, sf_dir):
    """CIP-10..12."""
    t = F.col("text")
    return _t(spark, sf_dir, "benchmark").select("item_id", N.railfence(t, 3).alias("railfence"), N.scytale(t, 5).alias("scytale"), N.columnar(t, "ZEBRA").alias("columnar"))


_ROUTE = "array_to_string(list_transform(list_value(" + ", ".join(map(str, N.route_order("6x7_counter-clockwise_top-left"))) + "), lambda i: substr(rpad(g, 42, 'X'), cast(i + 1 as int), 1)), '')"
_SQ = N.polybius_square("")


@query("cipher_grid", f"""select item_id, {_ROUTE} as route, array_to_string(list_transform(regexp_extract_all(translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'J', 'I'), '[A-Z]'),
  lambda c: cast((instr('{_SQ}', c) - 1) // 5 + 1 as varchar) || cast((instr('{_SQ}', c) - 1) % 5 + 1 as varchar)), ' ') as polybius from (select item_id, text, replace(upper(replace(regexp_replace(text, '[ \\t\\n\\r]', '', 'g'), 'ß', chr(57344))), chr(57344), 'ß') as g from benchmark)""")
def cipher_grid(spark, sf_dir):
    """CIP-16, CIP-17."""
    t = F.col("text")
    return _t(spark, sf_dir, "benchmark").select("item_id", N.route(t, "6x7_counter-clockwise_top-left").alias("route"), N.polybius(t).alias("polybius"))


@query("cipher_xor", f"select doc_id, array_to_string(list_transform({_ASC}, lambda b: lpad(lower(to_hex(xor(b, 90))), 2, '0')), '') as coded from {_WHOLE}")
def cipher_xor(spark, sf_dir):
    """CIP-09."""
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), N.xor_hex(F.col("text"), 90).alias("coded"))


_KEYS = {"caesar": "3", "xor": "90", "railfence": "3", "scytale": "4", "keyboard": "2", "one_time_pad": "pad" * 400_000, "route_cipher": "8x8_clockwise_top-left", "four_square": "ALPHA,OMEGA"}
#: Methods whose way back gives the text itself; the others keep letters only or upper-case them. Of the first SQL can make the cipher text.
_IN_SQL = {
    "base64": "to_base64(encode(text))", "hex": "lower(hex(encode(text)))", "binary": f"array_to_string(list_transform({_ASC}, lambda b: lpad(bin(b), 8, '0')), ' ')",
    "octal": f"array_to_string(list_transform({_ASC}, lambda b: ltrim(cast(b // 64 as varchar) || cast(b // 8 % 8 as varchar) || cast(b % 8 as varchar), '0')), ' ')", "decimal": f"array_to_string({_ASC}, ' ')",
    "caesar": f"translate(text, '{_AZ}', '{N.rotate(N.UPPER, 3) + N.rotate(N.LOWER, 3)}')", "rot13": f"translate(text, '{_AZ}', '{N.rotate(N.UPPER, 13) + N.rotate(N.LOWER, 13)}')",
    "atbash": f"translate(text, '{_AZ}', '{N.UPPER[::-1] + N.LOWER[::-1]}')", "rot47": f"translate(text, {_quoted(_PRINT)}, {_quoted(N.rotate(_PRINT, 47))})",
    "xor": f"array_to_string(list_transform({_ASC}, lambda b: lpad(lower(to_hex(xor(b, 90))), 2, '0')), '')",
    "one_time_pad": f"array_to_string(list_transform({_ASC}, lambda b, i: lpad(lower(to_hex(xor(b, list_value(112, 97, 100)[cast((i - 1) % 3 + 1 as int)]))), 2, '0')), '')",
}
_STATEFUL = ("base32", "url", "vigenere", "beaufort", "autokey", "rc4", "lfsr", "chacha20", "salsa20")


def _method_sql(method: str) -> str:
    code = _IN_SQL[method].replace("txt", "text")
    return f"select '{method}' as method, count(*) as n, count(*) as same, cast(sum(cast('0x' || left(md5({code}), 8) as bigint)) as bigint) as digests from conversations"


@query("arrow_cipher_roundtrip", " union all ".join(map(_method_sql, _IN_SQL)))
def arrow_roundtrip(spark, sf_dir):
    """CIP-01..05, CIP-09, CIP-20, ENC-01..07 through Arrow: cipher texts of all conversations, summed up by method as digests, and the way back."""
    return C.roundtrips(_t(spark, sf_dir, "conversations"), "text", {m: _KEYS.get(m, "SECRET") for m in _IN_SQL})


@query("arrow_stream_ciphers")
def arrow_streams(spark, sf_dir):
    """CIP-06..08, CIP-18..22 the same way; their cipher texts are held against published vectors in the tests."""
    return C.roundtrips(_t(spark, sf_dir, "conversations"), "text", {m: _KEYS.get(m, "SECRET") for m in _STATEFUL})


@query("arrow_ciphers")
def arrow_ciphers(spark, sf_dir):
    """CIP-13..15, CIP-23..33 over the benchmark, as text."""
    methods = ("playfair", "two_square", "four_square", "enigma", "des", "spn", "tea", "vowel_to_number", "braille")
    return _t(spark, sf_dir, "benchmark").select("item_id", *[C.cipher_column(F.col("text"), m, _KEYS.get(m, "SECRET"))["text"].alias(m) for m in methods])


# --- cryptanalysis -------------------------------------------------------------------------------------------------

_COUNTS = "list_transform(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' '), lambda c: length(l) - length(replace(l, c, '')))"
_SHARES = "list_value(" + ", ".join(map(str, S.LETTER_SHARE.values())) + ")"


@query("letter_statistics", f"""select doc_id, case when n > 0 then round(list_sum(list_transform(range(1, 27), lambda i: power(k[i] - sh[i] / 100 * n, 2) / (sh[i] / 100 * n))), 6) else 1e9 end as chi_squared,
  case when n > 1 then round(cast(list_sum(list_transform(k, lambda x: x * (x - 1))) as double) / (n * (n - 1)), 12) else 0 end as coincidence
  from (select doc_id, k, cast(list_sum(k) as bigint) as n, {_SHARES} as sh from (select doc_id, {_COUNTS} as k from (select doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') as l from documents)))""")
def letter_statistics(spark, sf_dir):
    """CRK-04, CRK-05."""
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.round(S.chi_squared(t), 6).alias("chi_squared"), F.round(S.index_of_coincidence(t), 12).alias("coincidence"))


_DIGRAPH = "map {" + ", ".join(f"'{p}': {v}" for p, v in S.DIGRAPH_SHARE.items()) + "}"


@query("digraph_chi2", f"""with p as (select doc_id, substr(l, i, 2) as pair from (select doc_id, l, unnest(range(1, length(l))) as i from (select doc_id, lower(text) as l from documents)) where regexp_full_match(substr(l, i, 2), '[a-z]{{2}}')),
  c as (select doc_id, pair, count(*) as o, sum(count(*)) over (partition by doc_id) as n from p group by doc_id, pair),
  e as (select *, coalesce({_DIGRAPH}[pair], 0.8) / 10000 * n as x from c)
  select d.doc_id, case when coalesce(max(n), 0) >= 8 then round(sum(power(o - x, 2) / x), 4) else 1e9 end as score from documents d left join e on d.doc_id = e.doc_id group by d.doc_id""")
def digraph_chi2(spark, sf_dir):
    """CRK-11."""
    return S.digraph_chi_squared(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", F.round("score", 4).alias("score"))


_VIG = _key_sql("{c} + {k}", "LEMON")


@query("vigenere_keylen", f"""with b as (select item_id, repeat(text, 3) as text from benchmark), v as (select item_id, regexp_replace(lower({_VIG}), '[^a-z]', '', 'g') as t from b),
  e as (select item_id, i, substr(t, i + 1, 1) as c, k from (select item_id, t, unnest(range(0, length(t))) as i from v where length(t) >= 100), (select unnest(range(2, 13)) as k)),
  g as (select item_id, k, i % k as col, c, count(*) as n from e group by all), s as (select item_id, k, col, sum(n * (n - 1)) as same, sum(n) as m from g group by all),
  ic as (select item_id, k, round(sum(case when m > 1 then same / (m * (m - 1)) else 0 end) / k, 9) as ic from s group by item_id, k),
  w as (select item_id, max(ic) as best, avg(ic) as mean, arg_max(k, ic - k * 1e-12) as top from ic group by item_id),
  d as (select w.item_id, min(k) as k from w join ic on w.item_id = ic.item_id and k < top and top % k = 0 and ic >= best * 0.85 group by w.item_id)
  select b.item_id, cast(case when best >= 0.058 and best - mean >= 0.01 then coalesce(d.k, top) end as int) as key_length from b left join w using (item_id) left join d using (item_id)""")
def vigenere_keylen(spark, sf_dir):
    """CRK-06 on benchmark texts, three times over, under a key of five."""
    b = _t(spark, sf_dir, "benchmark").select("item_id", N.vigenere(F.repeat("text", F.lit(3)), "LEMON").alias("text"))
    return S.key_length(b, "item_id", "text")


_CAESARED = "(select doc_id, translate(text, '{0}', '{1}') as text from documents)".format(_AZ, N.rotate(N.UPPER, 5) + N.rotate(N.LOWER, 5))


def _shifted_scores() -> str:
    rows = []
    for s in range(1, 26):
        back = f"translate(text, '{_AZ}', '{N.rotate(N.UPPER, -s) + N.rotate(N.LOWER, -s)}')"
        rows.append(f"select doc_id, {s} as shift, regexp_extract_all(lower({back}), '[\\p{{L}}]+') as t from {_CAESARED}")
    return f"select *, {_SCORES} from ({' union all '.join(rows)}) where len(t) > 0"


@query("caesar_crack_candidates", f"select doc_id, shift, case when {_BEST} >= 0.08 then {_LANG} end as language, round({_BEST}, 9) as confidence, cast(row_number() over (partition by doc_id order by {_BEST} desc, shift) as int) as rank from ({_shifted_scores()})")
def caesar_candidates(spark, sf_dir):
    """CRK-01 over all documents, moved by five."""
    d = _docs(spark, sf_dir).select("doc_id", N.caesar(F.col("text"), 5).alias("text"))
    return crack.caesar_candidates(d, "doc_id", "text").select("doc_id", "shift", "language", F.round("confidence", 9).alias("confidence"), "rank")


@query("crack_classical")
def crack_classical(spark, sf_dir):
    """CRK-03, CRK-07..16: conversations under a cipher that depends on the turn, cracked."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    t = F.col("text")
    coded = F.when(F.col("turn") % 2 == 0, N.caesar(t, 7)).otherwise(N.atbash(t))
    return c.select("conv_id", "turn", crack.crack_column(coded).alias("r")).select("conv_id", "turn", "r.method", "r.key", "r.language", F.round("r.confidence", 6).alias("confidence"))


_CLEAN_WORDS = r"list_transform(list_filter(string_split_regex(text, '[\t\n\x0b\f\r ]+'), lambda w: w <> ''), lambda w: regexp_replace(w, '[.,!?;:''\"]+$', ''))"


@query("crack_xor_hex", rf"""select item_id, case when ok then '42' end as key, case when ok then {_LANG} end as language from (select *, {_BEST} >= {crack.SURE} and len(ws) >= 4 and len(list_filter(ws, lambda w: regexp_full_match(w, '\p{{L}}+') and strlen(w) >= 2)) / greatest(len(ws), 1) >= 0.7 as ok
  from (select *, {_SCORES} from (select item_id, text, {_TOKENS} as t, {_CLEAN_WORDS} as ws from benchmark)))""")
def crack_xor_hex(spark, sf_dir):
    """CRK-10."""
    b = _t(spark, sf_dir, "benchmark").select("item_id", N.xor_hex(F.col("text"), 42).alias("h"))
    return b.select("item_id", crack.xor_hex(F.col("h")).alias("r")).select("item_id", "r.key", "r.language")


@query("cipher_findings")
def cipher_findings(spark, sf_dir):
    """CRK-18: documents without a known language."""
    return crack.findings(language.detect(_docs(spark, sf_dir), "text"), "doc_id", "text", "language").groupBy("subtype", "severity").agg(F.count("*").alias("n"))


@query("analyze_texts")
def analyze_texts(spark, sf_dir):
    """CRK-17."""
    got = crack.analyze(_docs(spark, sf_dir), "doc_id", "text")
    return got.select("doc_id", "language", F.round("confidence", 9).alias("confidence"), "pii", F.col("crack.method").alias("method"), "encodings")


# --- network, reference tables, tools --------------------------------------------------------------------------------


def _ip_number(ip: str) -> str:
    return " + ".join(f"cast(split_part({ip}, '.', {i + 1}) as bigint) * {256 ** (3 - i)}" for i in range(4))


def _scope_sql(n: str) -> str:
    import ipaddress

    return "case " + " ".join(f"when {n} between {int(ipaddress.ip_address(a))} and {int(ipaddress.ip_address(a)) + (1 << (32 - b)) - 1} then '{s}'" for a, b, s in V4_BLOCKS) + " else 'public' end"


_IPS = "(select o_orderkey, cast(list_value(10, 100, 127, 169, 172, 192, 198, 203, 224, 255, 0, 8)[1 + o_orderkey % 12] as varchar) || '.' || cast(list_value(0, 64, 254, 16, 168, 51, 255)[1 + o_custkey % 7] as varchar) || '.' || cast(list_value(0, 2, 100, 113, 255)[1 + (o_orderkey // 12) % 5] as varchar) || '.' || cast(o_custkey % 256 as varchar) as ip from orders)"


@query("ip_classify", f"select o_orderkey, ip, true as valid, 'IPv4' as version, {_scope_sql('n')} as scope, {_scope_sql('n')} = 'public' as is_public from (select *, {_ip_number('ip')} as n from {_IPS})")
def ip_classify(spark, sf_dir):
    """NET-01 on addresses made of order keys."""
    at = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (1 + i).cast("int")).cast("string")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ip = F.concat_ws(".", at([10, 100, 127, 169, 172, 192, 198, 203, 224, 255, 0, 8], k % 12), at([0, 64, 254, 16, 168, 51, 255], c % 7), at([0, 2, 100, 113, 255], F.floor(k / 12) % 5), (c % 256).cast("string"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", ip.alias("ip")).withColumn("k", classify_ip(F.col("ip"), with_v6=False)).select("o_orderkey", "ip", "k.*")


_DNS = "(values " + ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in T.DNS_PROVIDERS) + ") d(ip, provider)"


@query("dns_provider", f"select s_suppkey, s.ip, provider from (select s_suppkey, list_value('8.8.8.8', '1.1.1.1', '9.9.9.9', '10.0.0.1', '208.67.222.222')[1 + s_suppkey % 5] as ip from supplier) s left join {_DNS} on s.ip = d.ip")
def dns_provider(spark, sf_dir):
    """NET-02."""
    ips = F.array(*map(F.lit, ["8.8.8.8", "1.1.1.1", "9.9.9.9", "10.0.0.1", "208.67.222.222"]))
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(ips, (1 + F.col("s_suppkey") % 5).cast("int")).alias("ip"))
    return intel.dns_providers(s, "ip", intel.table(spark, "dns_providers"))


@query("proc_tcp_decode", "select event_id, cast(user_id % 256 as varchar) || '.' || cast(event_id % 256 as varchar) || '.0.127' as ip, cast(event_id % 65536 as int) as port from events")
def proc_tcp(spark, sf_dir):
    """NET-07 on addresses made of event keys."""
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    field = F.concat(F.lit("7F00"), two(F.col("event_id") % 256), two(F.col("user_id") % 256), F.lit(":"), F.lpad(F.hex(F.col("event_id") % 65536), 4, "0"))
    return _t(spark, sf_dir, "events").select("event_id", hex_address(field).alias("a")).select("event_id", "a.ip", "a.port")


_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


@query("url_domain_topk", f"select {_HOST} as domain, count(*) as visits from pages where {_HOST} <> '' group by 1 order by visits desc, domain limit 15")
def url_domains(spark, sf_dir):
    """SW-14, SW-15: the 15 most frequent domains."""
    return intel.top_domains(_t(spark, sf_dir, "pages"), "url")


@query("url_domain_counts", f"select {_HOST} as domain, count(*) as visits from pages where {_HOST} <> '' group by 1")
def url_counts(spark, sf_dir):
    """AGG-03."""
    return intel.domain_counts(_t(spark, sf_dir, "pages"), "url")


@query("history_summary", f"select count(*) as rows, count(distinct {_HOST}) as domains from pages where {_HOST} <> ''")
def history_summary(spark, sf_dir):
    """SW-14."""
    return intel.history_summary(_t(spark, sf_dir, "pages"), "url")


@query("domain_reputation", f"with s as (select {_HOST} as domain, max(case when page_id % 4 = 0 then 1 else 0 end) as is_malicious from pages where page_id % 2 = 0 group by 1), c as (select {_HOST} as domain, count(*) as visits from pages group by 1) select c.domain, visits, is_malicious from c join s on regexp_replace(c.domain, '^www\\.', '') = s.domain")
def domain_reputation(spark, sf_dir):
    """SW-16 with a reputation table made of the pages' own hosts."""
    p = _t(spark, sf_dir, "pages")
    sites = p.where("page_id % 2 = 0").groupBy(X.domain_of(F.col("url")).alias("domain")).agg(F.max(F.when(F.col("page_id") % 4 == 0, 1).otherwise(0)).alias("is_malicious"))
    return intel.reputation(p, "url", sites).select("domain", "visits", "is_malicious")


_SOFT = ["TunnelToad 1.2", "coupon ferret", "Northwind Tools", "logger", "Linden Logger", "harbour editor", "linden press suite", "vim", "Harbour Editors 9", "Reader"]
_SOFT_SQL = f"(select c_custkey, list_value({', '.join(map(_quoted, _SOFT))})[1 + c_custkey % {len(_SOFT)}] as name from customer)"


def _software(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, _SOFT)), (1 + F.col("c_custkey") % len(_SOFT)).cast("int")).alias("name"))


def _theta(rows, cols, both=True) -> str:
    values = ", ".join("(" + ", ".join(_quoted(str(r[i])) for i in cols) + ")" for r in rows)
    key = "contains(lower(b.k), lower(s.name))" + (" or contains(lower(s.name), lower(b.k))" if both else "")
    return f"from {_SOFT_SQL} s join (values {values}) b(k{''.join(f', c{i}' for i in range(1, len(cols)))}) on {key}"


@query("blacklist_theta", f"select c_custkey, name, b.k as entity_name, b.c1 as severity {_theta(T.BLACKLIST, (1, 3))}")
def blacklist(spark, sf_dir):
    """SW-07, SW-10."""
    return intel.blacklisted(_software(spark, sf_dir), "name").select("c_custkey", "name", "entity_name", "severity")


@query("whitelist_theta", f"select c_custkey, name, b.k as entity_name, cast(b.c1 as int) as trust_level {_theta(T.WHITELIST, (1, 3))}")
def whitelist(spark, sf_dir):
    """SW-08."""
    return intel.whitelisted(_software(spark, sf_dir), "name").select("c_custkey", "name", "entity_name", "trust_level")


@query("cve_theta", f"select c_custkey, name, b.c1 as cve_id, b.c2 as severity {_theta(T.SOFTWARE_CVES, (4, 0, 3), False)}")
def cves(spark, sf_dir):
    """SW-09."""
    return intel.vulnerable(_software(spark, sf_dir), "name").select("c_custkey", "name", "cve_id", "severity")


@query("package_inventory", "select count(*) as packages, count(*) filter (p_size % 5 = 0) as broken from part")
def package_inventory(spark, sf_dir):
    """SW-06, SW-11."""
    p = _t(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("version"), F.when(F.col("p_size") % 5 == 0, "deinstall ok config-files").otherwise("install ok installed").alias("status"))
    return intel.inventory(p).select("packages", "broken")


@query("mac_vendor", "select s_suppkey, mac, case when s_suppkey % 3 = 0 then 'Acme' end as vendor from (select s_suppkey, (case when s_suppkey % 3 = 0 then 'aa:bb:cc' else '00:11:22' end) || ':00:00:01' as mac from supplier)")
def mac_vendor(spark, sf_dir):
    """HW-09 with a registry of one row."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.when(F.col("s_suppkey") % 3 == 0, "aa:bb:cc").otherwise("00:11:22"), F.lit(":00:00:01")).alias("mac"))
    return intel.mac_vendor(s, "mac", spark.createDataFrame([("AA-BB-CC", "Acme")], "prefix string, vendor string"))


@query("hash_digests", "select doc_id, md5(text) as md5, sha1(text) as sha1, sha256(text) as sha256, strlen(text) as size from documents")
def hash_digests(spark, sf_dir):
    """TOOL-01 without SHA-512, which the SQL lacks."""
    return _docs(spark, sf_dir).select("doc_id", digests(F.encode("text", "UTF-8")).alias("d")).select("doc_id", "d.md5", "d.sha1", "d.sha256", "d.size")


_HASHES = "(select o_orderkey, list_value(md5(o_orderpriority), sha1(o_orderpriority), sha256(o_orderpriority), '$2a$10$x', '$1$x', '$6$x', '$argon2id$x', repeat('a', 43) || '=', 'deadbeef', 'plain')[1 + o_orderkey % 10] as h from orders)"


@query("hash_identify", "select o_orderkey, array_to_string(list_concat(case " + " ".join(f"when length(h) = {n} and regexp_full_match(h, '[0-9a-fA-F]+') then list_value({', '.join(map(_quoted, v))})" for n, v in BY_LENGTH.items())
       + " else [] end, case " + " ".join(f"when starts_with(h, '{p}') then ['{k}']" for p, k in BY_PREFIX) + f" else [] end, case when length(h) = 44 and h like '%=' then ['SHA-256 (base64-encoded)'] else [] end), '|') as kinds from {_HASHES}")
def hash_identify(spark, sf_dir):
    """TOOL-02."""
    p = F.encode("o_orderpriority", "UTF-8")
    hs = F.array(F.md5(p), F.sha1(p), F.sha2(p, 256), *map(F.lit, ["$2a$10$x", "$1$x", "$6$x", "$argon2id$x", "a" * 43 + "=", "deadbeef", "plain"]))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.array_join(identify_hash(F.element_at(hs, (1 + F.col("o_orderkey") % 10).cast("int"))), "|").alias("kinds"))


@query("jwt_decode", """select event_id, event_id % 7 <> 0 as valid, case when event_id % 7 <> 0 then event_id % 5 = 0 end as unsigned, case when event_id % 7 <> 0 then event_id % 2000 < 1000 end as expired from events""")
def jwt_decode(spark, sf_dir):
    """TOOL-03 on tokens made of event keys, at second 1000."""
    e = _t(spark, sf_dir, "events")
    part = lambda c: F.regexp_replace(F.translate(F.regexp_replace(F.base64(F.encode(c, "UTF-8")), "\\s", ""), "+/", "-_"), "=+$", "")
    head = F.concat(F.lit('{"alg":"'), F.when(F.col("event_id") % 5 == 0, "None").otherwise("HS256"), F.lit('"}'))
    body = F.concat(F.lit('{"exp":'), (F.col("event_id") % 2000).cast("string"), F.lit(',"sub":"é"}'))
    token = F.concat(part(head), F.lit("."), F.when(F.col("event_id") % 7 == 0, "no!").otherwise(part(body)), F.lit(".sig"))
    r = e.select("event_id", decode_jwt(token, F.lit(1000)).alias("j"))
    told = lambda word: F.when(F.col("j.valid"), F.exists("j.warnings", lambda w: F.contains(w, F.lit(word))))
    return r.select("event_id", "j.valid", told("alg=none").alias("unsigned"), told("expired").alias("expired"))


# --- signatures, reports, scan ---------------------------------------------------------------------------------------

_EXTS = ["pdf", "png", "html", "svg", "txt", "zip", "exe", "csv"]


def _sig_sql(cps) -> str:
    h = "hex(encode(html))"
    return " and ".join(f"substr({h}, {2 * o + 1}, 2) in ({', '.join(map(_quoted, alts))})" if alts else f"substr({h}, {2 * o + 1}, {len(w)}) = '{w}'" for o, w, alts in cps)


def _sig_any(sure: bool) -> str:
    return " or ".join(f"(ext = '{e}' and {_sig_sql(c)})" for _, e, s, c in T.FILE_SIGNATURES if s == sure)


_SIG_BODY = "(select page_id, list_value('pdf', 'png', 'html', 'svg', 'txt', 'zip', 'exe', 'csv')[1 + page_id % 8] as ext, case page_id % 6 when 0 then '%PDF-1.4 ' when 1 then 'MZ ' when 2 then 'PK' || chr(3) || chr(4) else '' end || html as html from pages)"
_TYPE_MAP = "map {" + ", ".join(f"'{e}': '{t}'" for e, t in T.TYPE_NAMES.items()) + "}"
_ACTUAL = "case " + " ".join(f"when ext <> '{e}' and {_sig_sql(c)} then '{e}'" for _, e, s, c in sorted(T.FILE_SIGNATURES) if s) + " end"


@query("filesig_check", f"""select page_id, ext as claimed_ext, ext in ({', '.join(_quoted(e) for e in sorted({e for _, e, s, _ in T.FILE_SIGNATURES if s}))}) as known_ext, matched, heuristic as heuristic_matched,
  case when not matched then actual end as actual_type, case when not matched then {_TYPE_MAP}[actual] end as actual_description, left(hex(encode(html)), 32) as header_hex from (select *, {_sig_any(True)} as matched, {_sig_any(False)} as heuristic, {_ACTUAL} as actual from {_SIG_BODY})""")
def filesig_check(spark, sf_dir):
    """SIG-01..03 on pages with made beginnings and extensions."""
    return filesig.check(_sig_pages(spark, sf_dir), "page_id", "content", "ext")


def _sig_pages(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    k = F.col("page_id") % 6
    head = F.when(k == 0, "%PDF-1.4 ").when(k == 1, "MZ ").when(k == 2, "PK\x03\x04").otherwise("")
    return p.select("page_id", F.element_at(F.array(*map(F.lit, _EXTS)), (1 + F.col("page_id") % 8).cast("int")).alias("ext"), F.encode(F.concat(head, F.col("html")), "UTF-8").alias("content"))


@query("filesig_mismatch", "select subtype, severity, n from (select 'file_signature_mismatch' as subtype, 'high' as severity, count(*) as n from (" + ORACLES["filesig_check"] + ") where known_ext and not matched and not heuristic_matched) where n > 0")
def filesig_mismatch(spark, sf_dir):
    """SIG-04."""
    checked = filesig.check(_sig_pages(spark, sf_dir), "page_id", "content", "ext")
    return filesig.mismatches(checked, "page_id").groupBy("subtype", "severity").agg(F.count("*").alias("n"))


_SEV = "list_value('clean', 'info', 'low', 'medium', 'high', 'critical', 'odd')"
_CAT = "list_value('software', 'hardware', 'storage', 'network', 'users')"
_SUB = "list_value('pii_email', 'hidden_file', 'clean_file', 'process', 'cpu', 'usb_none', 'wifi_profile', 'interface', 'scan_error', 'ssh_dir_none')"
_MADE = f"(select event_id, {_CAT}[1 + event_id % 5] as category, {_SUB}[1 + (event_id // 5) % 10] as subtype, {_SEV}[1 + user_id % 7] as severity from events)"


def _made(spark, sf_dir):
    at = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (1 + i).cast("int"))
    subs = "pii_email hidden_file clean_file process cpu usb_none wifi_profile interface scan_error ssh_dir_none".split()
    return _t(spark, sf_dir, "events").select(
        "event_id", at(["software", "hardware", "storage", "network", "users"], F.col("event_id") % 5).alias("category"),
        at(subs, F.floor(F.col("event_id") / 5) % 10).alias("subtype"), at(["clean", "info", "low", "medium", "high", "critical", "odd"], F.col("user_id") % 7).alias("severity"),
    )


_RANK = "case severity when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 else 0 end"


@query("severity_rank", f"select event_id, {_RANK} as rank, {_RANK} > 0 as flagged from {_MADE} where {_RANK} >= 2")
def severity_ranks(spark, sf_dir):
    """FIL-01..03."""
    from ..functions.severity import min_severity

    got = min_severity(_made(spark, sf_dir), "medium")
    return got.select("event_id", severity_rank(F.col("severity")).alias("rank"), is_flagged(F.col("severity")).alias("flagged"))


@query("report_by_severity", f"select s.severity, count(m.severity) as n from (values ('clean'), ('info'), ('low'), ('medium'), ('high'), ('critical')) s(severity) left join {_MADE} m on s.severity = m.severity group by s.severity")
def by_severity(spark, sf_dir):
    """AGG-01."""
    return report.by_severity(_made(spark, sf_dir))


@query("report_by_category", f"select s.category, count(m.severity) as n, count(*) filter ({_RANK} > 0) as flagged from (values ('software'), ('hardware'), ('storage'), ('network'), ('users')) s(category) left join {_MADE} m on s.category = m.category group by s.category")
def by_category(spark, sf_dir):
    """AGG-01."""
    return report.by_category(_made(spark, sf_dir))


@query("report_summary", f"select count(*) as total_findings, count(*) filter ({_RANK} > 0) as flagged_findings, max({_RANK}) as highest_rank from {_MADE}")
def report_summary(spark, sf_dir):
    """AGG-01."""
    return report.summary(_made(spark, sf_dir)).drop("by_severity")


_KEEP = "subtype in ('clean_file', 'scan_error')"


@query("check_filter", f"select event_id, category, subtype from {_MADE} where (category <> 'storage' or {_KEEP} or starts_with(subtype, 'pii_') or starts_with(subtype, 'ssh_')) and (category <> 'hardware' or {_KEEP} or starts_with(subtype, 'cpu'))")
def check_filter(spark, sf_dir):
    """FIL-04."""
    return report.filter_checks(_made(spark, sf_dir), {"files": ["pii", "ssh"], "hardware": ["cpu"], "unknown": ["x"]}).select("event_id", "category", "subtype")


@query("clean_docs", "with hit as (select doc_id from documents where len(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}')) > 0) select doc_id from documents where doc_id not in (select doc_id from hit)")
def clean_docs(spark, sf_dir):
    """SRC-02: documents without an e-mail finding."""
    d = _docs(spark, sf_dir)
    found = scans.with_clean_rows(pii_scan.findings(d, "doc_id", "text", ["EMAIL"]), d, "doc_id")
    return found.where("subtype = 'clean_file'").select(F.col("location").cast("long").alias("doc_id"))


@query("scan_documents")
def scan_documents(spark, sf_dir):
    """SRC-02, FIL-05: all detectors over all documents, rolled up."""
    d = _docs(spark, sf_dir)
    found = scans.scan_texts(d, "doc_id", "text", clean=True, terms=[{"term": "licensed under"}])
    return found.groupBy("category", "subtype", "severity").agg(F.count("*").alias("n"))
