"""Registered PII and search queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pii import RULES, luhn_valid, ssn_valid
from ..functions.severity import STEPS
from ..operators import pii_scan
from ..operators.names import FORENAMES, SURNAMES
from ..operators.report import by_severity

#: Rules without hits in the documents get texts made of other columns, in the same way in both languages.
BUILT = {
    "SSN_US": ("orders", "concat('ssn ', lpad(cast(o_custkey % 1000 as string), 3, '0'), '-', lpad(cast(o_orderkey % 100 as string), 2, '0'), '-', lpad(cast(o_orderkey % 10000 as string), 4, '0'))", "o_orderkey"),
    "SIN_CA": ("orders", "concat('x ', lpad(cast(o_custkey % 1000 as string), 3, '0'), ' ', lpad(cast(o_orderkey % 1000 as string), 3, '0'), ' ', lpad(cast((o_orderkey * 7) % 1000 as string), 3, '0'), ' end')", "o_orderkey"),
    "AWS_ACCESS_KEY": ("customer", "concat('key AKIA', lpad(cast(c_custkey as string), 16, '0'), ' / ASIA', lpad(cast(c_custkey * 3 as string), 16, 'Z'))", "c_custkey"),
    "PRIVATE_KEY_BLOCK": ("supplier", "concat('-----BEGIN ', case when s_suppkey % 2 = 0 then 'RSA ' else '' end, 'PRIVATE KEY----- ', s_name)", "s_suppkey"),
    "PASSPORT_GENERIC": ("customer", "concat('passport AB', lpad(cast(c_custkey as string), 7, '0'), '. ', c_name)", "c_custkey"),
    "RAMQ_QC": ("customer", "concat('ramq ABCD ', lpad(cast(c_custkey % 10000 as string), 4, '0'), ' ', lpad(cast((c_custkey * 3) % 10000 as string), 4, '0'))", "c_custkey"),
    "DOB": ("orders", "concat('born ', cast(cast(o_orderdate as date) as string), ', paid ', cast(o_totalprice as int))", "o_orderkey"),
    "ADDRESS_US": ("customer", "concat('lives at ', cast(c_custkey as string), ' Old Mill Road. ', c_name)", "c_custkey"),
    "DRIVER_LICENSE": ("customer", "concat('licence D', lpad(cast(c_custkey as string), 7, '0'), ' of ', c_name)", "c_custkey"),
}


def _texts(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    if rule not in BUILT:
        return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    table, expr, key = BUILT[rule]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("doc_id"), F.expr(expr).alias("text"))


def _texts_sql(rule: str) -> str:
    if rule not in BUILT:
        return "select doc_id, text from documents"
    table, expr, key = BUILT[rule]
    return f"select {key} as doc_id, {expr.replace('as string)', 'as varchar)')} as text from {table}"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _found_sql(source: str, pattern: str) -> str:
    """doc_id, pos, raw, low, size: each match with its place in bytes and the hexadecimal of the lower-cased text."""
    p = _quoted(pattern)
    return f"""select doc_id, ms[i] as raw, hex(encode(lower(text))) as low,
      cast(coalesce(list_sum(list_transform(sg[1:i], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: strlen(x))), 0) as bigint) as pos
      from (select doc_id, text, ms, sg, unnest(range(1, len(ms) + 1)) as i from (
        select doc_id, text, regexp_extract_all(text, {p}, 0) as ms, string_split_regex(text, {p}) as sg from ({source})))"""


def _step_sql(e: str, by: int) -> str:
    cases = " ".join(f"when '{s}' then '{STEPS[min(len(STEPS) - 1, max(0, i + by))]}'" for i, s in enumerate(STEPS))
    return f"case {e} {cases} else {e} end"


def _luhn_sql(d: str) -> str:
    return f"""(length({d}) >= 2 and coalesce(list_sum(list_transform(range(1, length({d}) + 1), lambda i: case when (length({d}) - i) % 2 = 0 then cast(substr({d}, i, 1) as int)
      else (cast(substr({d}, i, 1) as int) * 2) // 10 + (cast(substr({d}, i, 1) as int) * 2) % 10 end)), 1) % 10 = 0)"""


def _ssn_sql(d: str) -> str:
    return f"(length({d}) = 9 and substr({d}, 1, 3) not in ('000', '666') and substr({d}, 1, 1) <> '9' and substr({d}, 4, 2) <> '00' and substr({d}, 6, 4) <> '0000')"


def match_sql(rule: str, source: str | None = None) -> str:
    """The SQL of one rule's matches with the columns of ``pii_scan.scan`` but the raw value."""
    r = RULES[rule]
    d = "regexp_replace(raw, '[^0-9]', '', 'g')"
    passed = {"luhn": f"(length({d}) between {r['min_digits']} and {r['max_digits']} and {_luhn_sql(d)})", "ssn_us": _ssn_sql(d)}.get(r["checksum"], "cast(null as boolean)")
    near = "cast(null as varchar)"
    for lang, w in reversed([(lang, w) for lang in sorted(r["context_keywords"]) for w in r["context_keywords"][lang]]):
        h = w.lower().encode().hex().upper()
        near = f"case when instr(win, '{h}') % 2 = 1 then {_quoted(lang + ':' + w)} else {near} end"
    if rule in ("CREDIT_CARD", "SSN_US", "SIN_CA"):
        value = f"repeat('*', length({d}) - 4) || right({d}, 4)"
    elif rule == "EMAIL":
        value = "case when instr(raw, '@') > 2 then left(raw, 1) || repeat('*', instr(raw, '@') - 2) || substr(raw, instr(raw, '@')) else raw end"
    else:
        value = "case when strlen(raw) > 6 then left(raw, 3) || repeat('*', strlen(raw) - 3) else repeat('*', strlen(raw)) end"
    base = f"'{r['severity']}'"
    return f"""select doc_id, '{rule}' as rule_id, {_quoted(r['label'])} as label, cast(pos as bigint) as pos, {value} as value, {base} as base_severity,
      case when near is not null then {_step_sql('checked', 1)} else checked end as severity, {r['importance_score']} as importance, passed as checksum_passed, near as context_matched
      from (select *, case when passed = false then {_step_sql(base, -1)} else {base} end as checked from (
        select *, {passed} as passed, {near} as near from (
          select *, substr(low, 2 * greatest(pos - 40, 0) + 1, 2 * (least(pos + strlen(raw) + 40, length(low) // 2) - greatest(pos - 40, 0))) as win
          from ({_found_sql(source or _texts_sql(rule), r['pattern'])}))))"""


_COLUMNS = ["doc_id", "rule_id", "label", "pos", "value", "base_severity", "severity", "importance", "checksum_passed", "context_matched"]


def _rule_query(rule: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pii_scan.scan(_texts(spark, sf_dir, rule), "doc_id", "text", [rule]).select(*_COLUMNS)

    run.__doc__ = f"Matches of {rule} (PII-01..08)."
    return run


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _all_sql() -> str:
    return " union all ".join(f"({match_sql(r, 'select doc_id, text from documents')})" for r in RULES)


def _names(lst: list[str]) -> str:
    return ", ".join(_quoted(n.lower()) for n in lst)


_NAMES_SQL = f"""select doc_id, cast(pos as bigint) as pos, split_part(raw, ' ', 1) as forename, split_part(raw, ' ', 2) as surname
  from ({_found_sql('select doc_id, text from (select doc_id, text from documents union all select c_custkey as doc_id, text from built)', pii_scan.NAME_PATTERN)})
  where lower(split_part(raw, ' ', 1)) in ({_names(FORENAMES)}) and lower(split_part(raw, ' ', 2)) in ({_names(SURNAMES)})"""


def _name_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.element_at(F.array(*map(F.lit, FORENAMES)), (1 + F.col("c_custkey") % len(FORENAMES)).cast("int"))
    last = F.element_at(F.array(*map(F.lit, SURNAMES)), (1 + (F.col("c_custkey") * 7) % len(SURNAMES)).cast("int"))
    built = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("Ask, "), first, F.lit(" "), last, F.lit(" at once.")).alias("text"))
    return _documents(spark, sf_dir).unionByName(built)


def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in documents and in built sentences (PII-09)."""
    return pii_scan.person_names(_name_texts(spark, sf_dir), "doc_id", "text").select("doc_id", "pos", "forename", "surname")


def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of all rules by severity, zero-filled (PII-06, AGG-01)."""
    return by_severity(pii_scan.scan(_documents(spark, sf_dir), "doc_id", "text"))


def doc_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document (PII-12, AGG-02)."""
    got = pii_scan.document_score(_documents(spark, sf_dir), "doc_id", "text")
    return got.select("doc_id", F.round("score", 9).alias("score"))


_SCORE_SQL = f"""
with m as ({_all_sql()}),
f as (select *, row_number() over (partition by doc_id, rule_id order by pos) as n from m),
s as (select doc_id, sum(importance * case when context_matched is not null then 1.3 else 1.0 end * case when coalesce(checksum_passed, false) and base_severity = 'critical' then 1.2 else 1.0 end) as s from f where n = 1 group by doc_id),
w as (select doc_id, count(*) as n from ({_found_sql('select doc_id, text from documents', pii_scan.NAME_PATTERN)}) where lower(split_part(raw, ' ', 1)) in ({_names(FORENAMES)}) and lower(split_part(raw, ' ', 2)) in ({_names(SURNAMES)}) group by doc_id)
select d.doc_id, round(least(coalesce(s, 0) + 60 * coalesce(n, 0), 150) / 1000, 9) as score from documents d left join s using (doc_id) left join w using (doc_id)"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches and names of documents by position (PII-10, PII-11)."""
    return pii_scan.merged(_documents(spark, sf_dir), "doc_id", "text").select("doc_id", "pos", "rule_id", "value", "severity", "rank")


_MERGED_SQL = f"""
with m as (select doc_id, pos, {"case rule_id " + " ".join(f"when '{r}' then {i}" for i, r in enumerate(RULES)) + " end"} as ord, rule_id, value, severity from ({_all_sql()})
 union all select doc_id, cast(pos as bigint), 99, 'PERSON_NAME', raw, 'high' from ({_found_sql('select doc_id, text from documents', pii_scan.NAME_PATTERN)})
 where lower(split_part(raw, ' ', 1)) in ({_names(FORENAMES)}) and lower(split_part(raw, ' ', 2)) in ({_names(SURNAMES)}))
select doc_id, pos, rule_id, value, severity, cast(row_number() over (partition by doc_id order by pos, ord, value) as int) as rank from m"""


def luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luhn checks of numbers made of order keys (PII-04)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    digits = F.concat(F.col("o_orderkey").cast("string"), F.lpad((F.col("o_custkey") * 31 % 10000).cast("string"), 4, "0"))
    return o.select("o_orderkey", luhn_valid(digits).alias("valid"), luhn_valid(F.right(digits, F.lit(1))).alias("one_digit"))


def ssn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SSN checks of numbers made of order keys (PII-05)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    digits = F.concat(F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))
    return o.select("o_orderkey", ssn_valid(digits).alias("valid"))


def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All forms of one name in built sentences (SEA-01, SEA-02)."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    forms = ["John Henry Smith", "JOHN H. SMITH", "Smith, John", "J. Smith", "John S. ", "Johnson Smith", "smith, j.x"]
    form = F.element_at(F.array(*map(F.lit, forms)), (1 + F.col("c_custkey") % len(forms)).cast("int"))
    rows = c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("é "), form, F.lit(" called "), F.col("c_name")).alias("text"))
    return pii_scan.search_variants(rows, "doc_id", "text", pii_scan.name_variants("John", "Henry", "Smith"))


def _name_search_sql() -> str:
    forms = ["John Henry Smith", "JOHN H. SMITH", "Smith, John", "J. Smith", "John S. ", "Johnson Smith", "smith, j.x"]
    src = f"select c_custkey as doc_id, 'é ' || list_value({', '.join(map(_quoted, forms))})[1 + c_custkey % {len(forms)}] || ' called ' || c_name as text from customer"
    parts = [f"select doc_id, cast(pos as bigint) as pos, raw as value, {_quoted(v.label)} as label, '{v.confidence}' as confidence, {i} as i from ({_found_sql(src, '(?i)' + chr(92) + 'b' + pii_scan._quoted(v.text) + chr(92) + 'b')})" for i, v in enumerate(pii_scan.name_variants("John", "Henry", "Smith"))]
    return f"select doc_id, pos, value, label, confidence from (select *, row_number() over (partition by doc_id, pos order by strlen(value) desc, i) as n from ({' union all '.join(parts)})) where n = 1"


def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal and a pattern in all documents (SEA-03)."""
    d = _documents(spark, sf_dir)
    return pii_scan.search_term(d, "doc_id", "text", "licensed under").unionByName(pii_scan.search_term(d, "doc_id", "text", r"\b(loser|idiot)\b", is_regex=True, case_sensitive=True))


def pii_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PII findings of all documents by subtype and severity (PII-13)."""
    return pii_scan.findings(_documents(spark, sf_dir), "doc_id", "text").groupBy("category", "subtype", "title", "severity").agg(F.count("*").alias("n"), F.min("detail").alias("least_detail"))


QUERIES = {f"pii_{r.lower()}": _rule_query(r) for r in RULES} | {
    "pii_person_names": person_names, "pii_severity_summary": severity_summary, "pii_doc_score": doc_score, "pii_merged": merged, "luhn_valid": luhn, "ssn_valid": ssn,
    "custom_name_search": name_search, "custom_term_search": term_search, "pii_findings": pii_findings,
}

_SQL_FIRST = f"list_value({', '.join(map(_quoted, FORENAMES))})[1 + c_custkey % {len(FORENAMES)}]"
_SQL_LAST = f"list_value({', '.join(map(_quoted, SURNAMES))})[1 + (c_custkey * 7) % {len(SURNAMES)}]"
ORACLES = {f"pii_{r.lower()}": match_sql(r) for r in RULES} | {
    "pii_person_names": f"with built as (select c_custkey, 'Ask, ' || {_SQL_FIRST} || ' ' || {_SQL_LAST} || ' at once.' as text from customer) {_NAMES_SQL}",
    "pii_severity_summary": f"select s.severity, count(m.severity) as n from (values ('clean'), ('info'), ('low'), ('medium'), ('high'), ('critical')) s(severity) left join ({_all_sql()}) m on s.severity = m.severity group by s.severity",
    "pii_doc_score": _SCORE_SQL,
    "pii_merged": _MERGED_SQL,
    "luhn_valid": f"select o_orderkey, {_luhn_sql('d')} as valid, false as one_digit from (select o_orderkey, cast(o_orderkey as varchar) || lpad(cast(o_custkey * 31 % 10000 as varchar), 4, '0') as d from orders)",
    "ssn_valid": f"select o_orderkey, {_ssn_sql('d')} as valid from (select o_orderkey, lpad(cast(o_custkey % 1000 as varchar), 3, '0') || lpad(cast(o_orderkey % 100 as varchar), 2, '0') || lpad(cast(o_orderkey % 10000 as varchar), 4, '0') as d from orders)",
    "custom_name_search": _name_search_sql(),
    "custom_term_search": " union all ".join(f"select doc_id, cast(pos as bigint) as pos, raw as value from ({_found_sql('select doc_id, text from documents', p)})" for p in ("(?i)licensed under", r"\b(loser|idiot)\b")),
    "pii_findings": f"""select 'storage' as category, 'pii_' || lower(rule_id) as subtype, label || ' detected' as title, severity, count(*) as n, min('Matched value (redacted): ' || value) as least_detail from ({_all_sql()}) group by rule_id, label, severity
      union all select 'storage', 'pii_person_name', 'Person name detected', 'medium', count(*), min('Possible name: ' || split_part(raw, ' ', 1) || ' ' || left(split_part(raw, ' ', 2), 1) || '****')
      from ({_found_sql('select doc_id, text from documents', pii_scan.NAME_PATTERN)}) where lower(split_part(raw, ' ', 1)) in ({_names(FORENAMES)}) and lower(split_part(raw, ' ', 2)) in ({_names(SURNAMES)}) having count(*) > 0""",
}
