"""Registered queries of long lists, prefix tables, the file source and roll-ups, each with the SQL that gives the same rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native_ciphers as N
from ..functions import sql_text
from ..functions.tables import PII_RULES
from ..operators import crack, encodings, entropy_windows, heavy, language, long_lists, pii_scan, prefixes, report
from ..sources import files
from ..sources import hostfiles as H
from . import scan as scans
from .core_queries import ORACLES as ORACLES_OF_CORE
from .core_queries import _BEST, _CLEAN_WORDS, _LANG, _MADE, _SCORES, _TOKENS, _docs, _made, _t
from .pii_queries import ORACLES as ORACLES_OF_PII

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- long lists ------------------------------------------------------------------------------------------------------

_TERMS = "(select distinct lower(term) as term from (select unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) as term from benchmark union all select unnest(string_split(p_name, ' ')) from part union all select c_name from customer) where term <> '')"


@query("many_terms", f"select doc_id, cast(count(*) as bigint) as terms, cast(sum(strlen(left(l, strpos(l, term) - 1))) as bigint) as firsts from (select doc_id, lower(text) as l from documents) join {_TERMS} on contains(l, term) group by doc_id")
def many_terms(spark, sf_dir):
    """SEA-03 with a list of thousands of terms from three tables, over all documents: terms met and the sum of their first places, regardless of case."""
    words = _t(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("term"))
    names = _t(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term"))
    terms = words.unionByName(names).unionByName(_t(spark, sf_dir, "customer").select(F.col("c_name").alias("term"))).select(F.lower("term").alias("term")).where("term <> ''")
    found = long_lists.search_terms(_docs(spark, sf_dir), "doc_id", "text", terms)
    return found.groupBy("doc_id", "term").agg(F.min("pos").alias("first")).groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("first").alias("firsts"))


# --- prefixes --------------------------------------------------------------------------------------------------------

_EVENT_IP = "'10.' || (event_id % 40) || '.' || (user_id % 256) || '.' || (event_id % 256)"
_RANGES = """(select 'r8' as name, 8 as n, 10::bigint * 16777216 as base union all select 'n' || n_nationkey, 16, 10::bigint * 16777216 + n_nationkey * 65536 from nation
  union all select 's' || s_suppkey, 24, 10::bigint * 16777216 + (s_suppkey % 40) * 65536 + (s_suppkey * 7 % 256) * 256 from supplier where s_suppkey <= 40)"""


@query("address_ranges", f"""with e as (select event_id, 10::bigint * 16777216 + (event_id % 40) * 65536 + (user_id % 256) * 256 + event_id % 256 as ip from events)
  select event_id, (select arg_max(name, n) from {_RANGES} r where ip // (1 << (32 - n)) = base // (1 << (32 - n))) as name from e""")
def address_ranges(spark, sf_dir):
    """NET-01, NET-02: addresses of events by the longest range that holds them, of lengths 8, 16 and 24."""
    e = _t(spark, sf_dir, "events").selectExpr("event_id", "concat('10.', event_id % 40, '.', user_id % 256, '.', event_id % 256) as ip")
    ranges = _t(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) as name", "concat('10.', n_nationkey, '.0.0/16') as cidr")
    ranges = ranges.unionByName(_t(spark, sf_dir, "supplier").where("s_suppkey <= 40").selectExpr("concat('s', s_suppkey) as name", "concat('10.', s_suppkey % 40, '.', s_suppkey * 7 % 256, '.9/24') as cidr"))
    ranges = ranges.unionByName(spark.createDataFrame([("r8", "10.0.0.0/8"), ("no", "10.0.0.0/40"), ("no", "x")], "name string, cidr string"))
    got = prefixes.longest_prefix(e, prefixes.address_bits(F.col("ip")), ranges, prefixes.range_bits(F.col("cidr")))
    return got.select("event_id", F.col("entry.name").alias("name"))


@query("address_ranges_v6", """with e as (select event_id, event_id % 30 as a, user_id % 16 as b from events)
  select event_id, case when a = b then 'h' || a when a < 25 then 'n' || a else 'all' end as name from e""")
def address_ranges_v6(spark, sf_dir):
    """NET-01: IPv6 addresses by ranges of 32, 48 and 64 bits."""
    e = _t(spark, sf_dir, "events").selectExpr("event_id", "concat('2001:DB8:', lower(hex(event_id % 30)), ':', lower(hex(user_id % 16)), '::', lower(hex(event_id % 60000))) as ip")
    ranges = _t(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) as name", "concat('2001:db8:', lower(hex(n_nationkey)), '::/48') as cidr")
    ranges = ranges.unionByName(spark.range(16).selectExpr("concat('h', id) as name", "concat('2001:db8:', lower(hex(id)), ':', lower(hex(id)), '::/64') as cidr"))
    ranges = ranges.unionByName(spark.createDataFrame([("all", "2001:db8::/32")], "name string, cidr string"))
    return prefixes.longest_prefix(e, prefixes.address_bits(F.col("ip")), ranges, prefixes.range_bits(F.col("cidr"))).select("event_id", F.col("entry.name").alias("name"))


@query("registry_prefixes", "select c_custkey, case when c_custkey % 4 = 0 then 'long' || c_custkey % 8 when c_custkey % 4 = 1 then 'short' when c_custkey % 4 = 2 and c_nationkey < 16 then 'mid' || c_nationkey end as vendor from customer")
def registry_prefixes(spark, sf_dir):
    """HW-09: vendors by registry prefixes of 24, 28 and 36 bits."""
    mac = "case c_custkey % 4 when 0 then concat('aa-bb-cc-1', lower(hex(c_custkey % 8)), '-00-01') when 1 then 'AA:BB:CC:00:00:01' when 2 then concat('dd:ee:ff:', lower(hex(c_nationkey % 16)), if(c_nationkey < 16, '0', '1'), ':00:01') else '' end"
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.expr(mac).alias("mac"))
    table = spark.createDataFrame([("AABBCC", "short"), ("", "none")], "prefix string, vendor string").where("prefix <> ''")
    table = table.unionByName(spark.range(8).selectExpr("concat('AA:BB:CC:1', hex(id), ':0') as prefix", "concat('long', id) as vendor"))
    table = table.unionByName(spark.range(16).selectExpr("concat('DDEEFF', hex(id), '0') as prefix", "concat('mid', id) as vendor"))
    got = prefixes.longest_prefix(c, prefixes.hexadecimal(F.col("mac")), table, prefixes.hexadecimal(F.col("prefix")))
    return got.select("c_custkey", F.col("entry.vendor").alias("vendor"))


# --- files -----------------------------------------------------------------------------------------------------------


def _tree(spark, sf_dir) -> str:
    """A folder by nation with a file for each supplier, written by the executors: hidden, empty and plain ones, and links that lead nowhere."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    top = f"{shared.removeprefix('file://').rstrip('/') if shared else tempfile.mkdtemp(prefix='lumentrace-')}/tree-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                key, folder = r["s_suppkey"], f"{top}/n{r['s_nationkey']}/k{r['s_suppkey'] % 3}"
                os.makedirs(folder, exist_ok=True)
                if key % 5 == 1:
                    if not os.path.islink(f"{folder}/s{key}.txt"):
                        os.symlink(f"{top}/nowhere", f"{folder}/s{key}.txt")
                    continue
                with open(f"{folder}/{'.' if key % 5 == 2 else '_' if key % 5 == 3 else ''}s{key}.txt", "w") as f:
                    f.write("" if key % 5 == 4 else f"{r['s_name']} writes to s{key}@example.com about it")
            yield b

    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    os.makedirs(top, exist_ok=True)
    rows.mapInArrow(run, rows.schema).count()
    return top


_KIND = "case s_suppkey % 5 when 1 then 'unreadable' when 2 then 'hidden' when 4 then 'empty' else 'file' end"


@query("file_tree", f"select {_KIND} as kind, count(*) as files, cast(sum(case when s_suppkey % 5 in (1, 4) then 0 else length(s_name) + length(' writes to s@example.com about it') + length(cast(s_suppkey as varchar)) end) as bigint) as bytes from supplier group by 1")
def file_tree(spark, sf_dir):
    """SRC-01: a tree of files walked and read by the executors, hidden and empty ones and those that can't be read among them."""
    found = files.read_files(spark, _tree(spark, sf_dir))
    base = F.regexp_extract("path", "[^/]+$", 0)
    kind = F.when(F.col("error").isNotNull(), "unreadable").when(base.startswith("."), "hidden").when(F.col("length") == 0, "empty").otherwise("file")
    return found.groupBy(kind.alias("kind")).agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes"))


@query("scanned_tree", "select subtype, count(*) as n from (select unnest(case s_suppkey % 5 when 1 then ['scan_error'] when 2 then ['hidden_file', 'pii_email'] when 4 then ['clean_file'] else ['pii_email'] end) as subtype from supplier) group by 1")
def scanned_tree(spark, sf_dir):
    """SRC-02: the scan over that tree, an error for each file that can't be read."""
    return scans.scan_files(spark, _tree(spark, sf_dir), ["hidden_files", "pii"], pii_types=["EMAIL"]).groupBy("subtype").agg(F.count("*").alias("n"))


# --- cracking --------------------------------------------------------------------------------------------------------

_SECRET = "text || ' write to ' || 'user' || item_id || '@example.com about it'"
_PLAIN = f"(select *, {_SCORES} from (select item_id, text, {_TOKENS} as t, {_CLEAN_WORDS} as ws from (select item_id, {_SECRET} as text from benchmark)))"
_ACCEPTED = rf"{_BEST} >= {crack.SURE} and len(ws) >= 4 and len(list_filter(ws, lambda w: regexp_full_match(w, '\p{{L}}+') and strlen(w) >= 2)) / greatest(len(ws), 1) >= 0.7"


@query("crack_shifts", f"select item_id, case when ok then case when item_id % 2 = 0 then 'caesar' else 'atbash' end end as method, case when ok then case when item_id % 2 = 0 then '7' else '' end end as key, case when ok then {_LANG} end as language, coalesce(ok, false) as mail from (select *, {_ACCEPTED} as ok from {_PLAIN})")
def crack_shifts(spark, sf_dir):
    """CRK-16, CRK-18: the benchmark's texts with an address, under Caesar's cipher or mirrored letters, cracked; the address is found in the plain text."""
    b = _t(spark, sf_dir, "benchmark").select("item_id", F.concat("text", F.lit(" write to user"), F.col("item_id").cast("string"), F.lit("@example.com about it")).alias("text"))
    coded = F.when(F.col("item_id") % 2 == 0, N.caesar(F.col("text"), 7)).otherwise(N.atbash(F.col("text")))
    got = b.select("item_id", crack.crack_column(coded).alias("r"))
    mail = F.contains("r.plaintext", F.concat(F.lit("user"), F.col("item_id").cast("string"), F.lit("@example.com")))
    return got.select("item_id", "r.method", "r.key", "r.language", F.coalesce(mail, F.lit(False)).alias("mail"))


# --- findings, reports and loaders -------------------------------------------------------------------------------------

_HIGH = ORACLES_OF_CORE["shannon_entropy"]


@query("entropy_findings", f"select 'high_entropy_content' as subtype, band, count(*) as n from ({_HIGH}) where high group by band")
def entropy_findings(spark, sf_dir):
    """ENT-06, ENT-07: entropy findings of all documents by band."""
    d = _docs(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("c"))
    found = entropy_windows.findings(d, "doc_id", "c")
    return found.groupBy("subtype", F.col("evidence")["band"].alias("band")).agg(F.count("*").alias("n"))


@query("hex_xor_pieces", f"select item_id, case when key is not null then 'hex_xor' else 'hex' end as kind, case when key is not null then '200' end as key from ({ORACLES_OF_CORE['crack_xor_hex']})")
def hex_xor_pieces(spark, sf_dir):
    """ENC-10: texts XORed and written in hexadecimal amid others, found and cracked by the detection."""
    coded = F.concat(F.lit("see "), N.xor_hex(F.col("text"), 200), F.lit(" for it"))
    b = _t(spark, sf_dir, "benchmark").select("item_id", coded.alias("text"))
    return encodings.detect(b, "item_id", "text", ["hex"]).select("item_id", "kind", "key")


def _shared(spark, name: str) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/') if shared else tempfile.mkdtemp(prefix='lumentrace-')}/{name}-{uuid.uuid4().hex}"


_SEV = "case user_id % 4 when 0 then 'clean' when 1 then 'low' when 2 then 'high' else 'info' end"


@query("json_report", f"select 'event_' || event_id % 5 as subtype, {_SEV} as severity, count(*) as n, (select count(*) from events where user_id % 4 in (1, 2)) as flagged from events group by 1, 2")
def json_report(spark, sf_dir):
    """SNK-01: findings and summary written as JSON and read back."""
    e = _t(spark, sf_dir, "events").selectExpr("concat('event_', event_id % 5) as subtype", f"{_SEV} as severity", "cast(event_id as string) as location")
    path = _shared(spark, "report")
    report.write_json(e, path)
    flagged = spark.read.json(f"{path}/summary").select(F.col("flagged_findings").alias("flagged"))
    return spark.read.json(f"{path}/findings").groupBy("subtype", "severity").agg(F.count("*").alias("n")).crossJoin(F.broadcast(flagged))


@query("language_files", "select lower(c_name) as text, cast(max(c_custkey % 100) as bigint) as popularity from (select c_custkey, 'word' || c_nationkey as c_name from customer) group by 1")
def language_files(spark, sf_dir):
    """SRC-10, LNG-06: a words.csv as it is loaded, repeated words with their highest popularity."""
    path = _shared(spark, "words")
    _t(spark, sf_dir, "customer").selectExpr("concat('word', c_nationkey) as word", "c_custkey % 100 as popularity", "'x' as meaning").write.option("header", True).csv(f"{path}/en/words.csv")
    return language.load_language_data(spark, path, "en")["words"].select("text", "popularity")


_FAMILIES = "(values " + ", ".join(f"('{c}', '{i}', '{'|'.join(p)}')" for c, f in report.CHECKS.items() for i, p in f.items()) + ") t(category, check_id, prefixes)"


@query("check_families", f"""select t.category, check_id, prefixes, count(m.event_id) as n from {_FAMILIES} left join {_MADE} m
  on m.category = case when t.category = 'files' then 'storage' else t.category end and len(list_filter(string_split(prefixes, '|'), lambda p: starts_with(m.subtype, p))) > 0 group by all""")
def check_families(spark, sf_dir):
    """SNK-06: all check families and how many findings belong to each."""
    return report.counts_by_check(_made(spark, sf_dir)).withColumn("prefixes", F.array_join("prefixes", "|"))


_TYPES = "(values " + ", ".join("('{}', '{}')".format(r["id"], r["label"].replace("'", "''")) for r in PII_RULES) + ", ('PERSON_NAME', 'Person name')) t(id, label)"


@query("pii_types", f"select id, label, count(rule_id) as n from {_TYPES} left join ({ORACLES_OF_PII['pii_merged']}) m on id = rule_id group by id, label")
def pii_types(spark, sf_dir):
    """SNK-05: all types of personal data and how many matches the documents have of each."""
    return report.counts_by_type(pii_scan.merged(_docs(spark, sf_dir), "doc_id", "text"))


@query("not_implemented", "select cast(s_suppkey as varchar) as host, category, subtype from supplier, (values ('network', 'wifi_profiles_not_implemented'), ('storage', 'suid_audit_not_implemented')) t(category, subtype) where s_suppkey % 3 <> 0")
def not_implemented(spark, sf_dir):
    """NET-10, SEC-04: what other platforms' hosts lack."""
    hosts = _t(spark, sf_dir, "supplier").selectExpr("s_suppkey as host", "element_at(array('Linux', 'windows', 'darwin'), cast(s_suppkey % 3 as int) + 1) as platform")
    got = H.not_implemented(hosts, [("network", "wifi_profiles_not_implemented"), ("storage", "suid_audit_not_implemented")])
    return got.select(F.col("location").alias("host"), "category", "subtype")


# --- SQL ----------------------------------------------------------------------------------------------------------------


@query("sql_pii_merged", ORACLES_OF_PII["pii_merged"])
def sql_pii_merged(spark, sf_dir):
    """The matches and names of all documents by a query in SQL alone, with the registered functions (section 2.15 of the survey)."""
    sql_text.register(spark)
    return spark.sql(
        """with found as (select doc_id, m.* from parquet.`{}` as d, lateral lumentrace_pii(d.text) as m)
        select doc_id, pos, rule_id, value, severity, row_number() over (partition by doc_id order by pos, ord, value) as rank from found""".format(f"{sf_dir}/documents.parquet")
    )


# --- derived data ------------------------------------------------------------------------------------------------------

_GRAMS = "(select unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as gram from (select regexp_extract_all(lower(text), '[a-z0-9'']+') as t from documents))"


@query("frequent_bigrams", f"select gram, cast(n as bigint) as n from (select gram, count(*) as n, sum(count(*)) over () as total from {_GRAMS} group by gram) where n * 2000 > total")
def frequent_bigrams(spark, sf_dir):
    """SRC-11: pairs of words of which one in 2,000 is or more, counted exactly, with bounded counters first."""
    return heavy.frequent(_docs(spark, sf_dir), "text", share=2_000)


@query("frequent_letter_pairs", "select gram, cast(n as bigint) as n from (select gram, count(*) as n, sum(count(*)) over () as total from (select substr(l, i, 2) as gram from (select l, unnest(range(1, length(l))) as i from (select lower(text) as l from documents))) where regexp_full_match(gram, '[a-z]{2}') group by gram) where n * 100 > total")
def frequent_letter_pairs(spark, sf_dir):
    """SRC-11: pairs of letters of which one in a hundred is or more."""
    return heavy.frequent(_docs(spark, sf_dir), "text", share=100, grams=heavy.letter_pairs, counters=1_000)


@query("merged_glossary", """select word, string_agg(meaning, '; ' order by k) as meaning from (select word, meaning, row_number() over (partition by word order by p desc, meaning) as k
  from (select c_nationkey as word, c_name[10:] as meaning, max(c_custkey % 50) as p from customer group by all)) where k <= 5 group by word""")
def merged_glossary(spark, sf_dir):
    """LNG-06, SRC-11: at most five meanings of a word, the most popular ones."""
    entries = _t(spark, sf_dir, "customer").selectExpr("c_nationkey as word", "substr(c_name, 10) as meaning", "c_custkey % 50 as popularity")
    return heavy.glossary(entries.unionByName(entries))


# --- roll-ups --------------------------------------------------------------------------------------------------------


@query("report_cube", """select category, severity, count(*) as n, cast(count(*) filter (where severity in ('low', 'medium', 'high', 'critical')) as bigint) as flagged
  from (select case event_id % 3 when 0 then 'network' when 1 then 'storage' else 'software' end as category, case user_id % 4 when 0 then 'clean' when 1 then 'low' when 2 then 'high' else 'info' end as severity from events) group by cube (category, severity)""")
def report_cube(spark, sf_dir):
    """AGG-01: every roll-up of findings in one pass."""
    e = _t(spark, sf_dir, "events").selectExpr("case event_id % 3 when 0 then 'network' when 1 then 'storage' else 'software' end as category", "case user_id % 4 when 0 then 'clean' when 1 then 'low' when 2 then 'high' else 'info' end as severity")
    return report.rollups(e)

