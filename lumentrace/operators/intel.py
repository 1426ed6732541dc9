"""Reference tables joined to hosts, software and hardware (SW-06..16, HW-09, HW-10, NET-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.severity import finding
from ..functions.text import domain_of


def table(spark: SparkSession, name: str) -> DataFrame:
    """One of the built-in reference tables: blacklist, whitelist, cves, websites, dns_providers, cpu_vulnerabilities."""
    rows, schema = {
        "blacklist": (T.BLACKLIST, "entity_type string, entity_name string, reason string, severity string, source string"),
        "whitelist": (T.WHITELIST, "entity_type string, entity_name string, reason string, trust_level int"),
        "cves": (T.SOFTWARE_CVES, "cve_id string, description string, cvss_score double, severity string, affected_software string, exploit_available int, has_patch int"),
        "websites": (T.WEBSITES, "domain string, category string, security_rating int, risk_level string, is_malicious int, reputation_score double"),
        "dns_providers": (T.DNS_PROVIDERS, "ip string, provider string"),
        "cpu_vulnerabilities": (T.CPU_VULNERABILITIES, "cve_id string, title string, description string, cvss_score double, cvss_severity string, mitigation string, affected_companies string"),
    }[name]
    kinds = [f.split()[1] for f in schema.split(", ")]
    fit = lambda v, k: None if v is None else float(v) if k == "double" else int(v) if k == "int" else str(v)
    return spark.createDataFrame([tuple(fit(v, k) for v, k in zip(r, kinds)) for r in rows], schema)


def match_substring(df: DataFrame, name_col: str, rows: list[tuple], key: int, both_ways: bool = True) -> DataFrame:
    """``df`` with one row per entry of a short list whose key contains the name, or (``both_ways``) lies within it, regardless of case (SW-07, SW-08, SW-09).

    The list folds into the projection as literals, so a theta join needs no nested loop over partitions.
    """
    name = F.lower(F.col(name_col))
    hits = []
    for i, r in enumerate(rows):
        entry = F.lit(str(r[key]).lower())
        hits.append(F.when(F.contains(entry, name) | (F.contains(name, entry) if both_ways else F.lit(False)), F.lit(i)))
    return df.withColumn("_hit", F.explode(F.array_compact(F.array(*hits)))).where(F.length(name_col) > 0)


def blacklisted(df: DataFrame, name_col: str, rows: list[tuple] = T.BLACKLIST) -> DataFrame:
    """Matches with entity_name, reason and severity (SW-07, SW-10)."""
    got = match_substring(df, name_col, rows, 1)
    pick = lambda n: F.element_at(F.array(*[F.lit(r[n]) for r in rows]), F.col("_hit") + 1)
    return got.withColumns({"entity_name": pick(1), "reason": pick(2), "severity": normal_severity(pick(3))}).drop("_hit")


def whitelisted(df: DataFrame, name_col: str, rows: list[tuple] = T.WHITELIST) -> DataFrame:
    """Matches with entity_name and trust_level (SW-08)."""
    got = match_substring(df, name_col, rows, 1)
    pick = lambda n: F.element_at(F.array(*[F.lit(r[n]) for r in rows]), F.col("_hit") + 1)
    return got.withColumns({"entity_name": pick(1), "trust_level": pick(3)}).drop("_hit")


def vulnerable(df: DataFrame, name_col: str, rows: list[tuple] = T.SOFTWARE_CVES) -> DataFrame:
    """Matches with cve_id and severity: the list of affected software contains the name (SW-09, SW-10)."""
    got = match_substring(df, name_col, rows, 4, both_ways=False)
    pick = lambda n: F.element_at(F.array(*[F.lit(r[n]) for r in rows]), F.col("_hit") + 1)
    return got.withColumns({"cve_id": pick(0), "severity": normal_severity(pick(3))}).drop("_hit")


def normal_severity(word):
    """Known severities in lower case, everything else medium (SW-10)."""
    low = F.lower(word)
    return F.when(low.isin("clean", "info", "low", "medium", "high", "critical"), low).otherwise(F.lit("medium"))


def broken_packages(packages: DataFrame) -> DataFrame:
    """Packages whose status doesn't end in `` installed`` (SW-06)."""
    return packages.where(~F.coalesce(F.endswith("status", F.lit(" installed")), F.lit(False)))


def inventory(packages: DataFrame) -> DataFrame:
    """One row: packages, broken, and a digest-friendly sorted sample of ``name=version`` for the report (SW-11)."""
    broken = ~F.coalesce(F.endswith("status", F.lit(" installed")), F.lit(False))
    return packages.agg(F.count("*").alias("packages"), F.count_if(broken).alias("broken"), F.sort_array(F.collect_list(F.concat_ws("=", "name", "version"))).alias("list"))


def domain_counts(df: DataFrame, url_col: str) -> DataFrame:
    """(domain, visits) (AGG-03)."""
    return df.select(domain_of(F.col(url_col)).alias("domain")).where("domain is not null and domain <> ''").groupBy("domain").agg(F.count("*").alias("visits"))


def top_domains(df: DataFrame, url_col: str, n: int = 15) -> DataFrame:
    """The most visited domains, ties by name (SW-14)."""
    return domain_counts(df, url_col).orderBy(F.desc("visits"), "domain").limit(n)


def history_summary(df: DataFrame, url_col: str) -> DataFrame:
    """One row: rows and distinct domains (SW-14)."""
    return domain_counts(df, url_col).agg(F.coalesce(F.sum("visits"), F.lit(0)).alias("rows"), F.count("*").alias("domains"))


def reputation(df: DataFrame, url_col: str, sites: DataFrame) -> DataFrame:
    """Visited domains that ``sites`` knows, ``www.`` apart (SW-16); domains are counted before the join."""
    counts = domain_counts(df, url_col).withColumn("_key", F.regexp_replace("domain", "^www\\.", ""))
    return counts.join(sites.withColumnRenamed("domain", "_site"), F.col("_key") == F.col("_site")).drop("_key", "_site")


def bad_domain_findings(known: DataFrame) -> DataFrame:
    """Malicious ones as findings (SW-16)."""
    return known.where("is_malicious = 1").select(*finding("software", "browser_visited_known_bad_domain", "Known bad domain visited", "high", F.concat(F.col("domain"), F.lit(": "), F.col("category")), F.col("domain"), source="browser_history", tags=["browser"]))


def dns_providers(df: DataFrame, ip_col: str, providers: DataFrame) -> DataFrame:
    """``df`` with the provider of a resolver's address, null if unknown (NET-02)."""
    return df.join(providers.withColumnRenamed("ip", "_ip"), F.col(ip_col) == F.col("_ip"), "left").drop("_ip")


def normal_hex(col):
    """Registry keys: upper case without ``:``, ``-`` and a leading 0X (HW-09)."""
    return F.regexp_replace(F.regexp_replace(F.upper(col), "[:-]", ""), "^0X", "")


def mac_vendor(df: DataFrame, mac_col: str, registry: DataFrame) -> DataFrame:
    """``df`` with the vendor of an address's first six digits; ``registry`` is (prefix, vendor) (HW-09)."""
    return df.join(registry.select(normal_hex(F.col("prefix")).alias("_p"), "vendor"), F.left(normal_hex(F.col(mac_col)), F.lit(6)) == F.col("_p"), "left").drop("_p")


def device_names(df: DataFrame, vendor_col: str, device_col: str, registry: DataFrame, device_key: str = "product_id") -> DataFrame:
    """``df`` with the registry's names of a USB or PCI device (HW-04, HW-05, HW-09)."""
    reg = registry.withColumn("_v", normal_hex(F.col("vendor_id"))).withColumn("_d", normal_hex(F.col(device_key))).drop("vendor_id", device_key)
    return df.join(reg, (normal_hex(F.col(vendor_col)) == F.col("_v")) & (normal_hex(F.col(device_col)) == F.col("_d")), "left").drop("_v", "_d")


