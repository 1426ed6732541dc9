"""Filters over findings and the report's roll-ups (FIL-02..06, SNK-01, SNK-05, SNK-06, AGG-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.severity import CATEGORIES, SEVERITIES, is_flagged, severity_rank
from ..functions.tables import PII_RULES

#: Category -> check family -> subtype prefixes.
CHECKS = {
    "files": {
        "hidden_files": ["hidden_file"], "file_signature": ["file_signature_mismatch"], "pii": ["pii_"], "encoded_content": ["encoded_content_"],
        "cipher": ["cipher_cracked_", "unrecognized_language"], "entropy": ["high_entropy_content", "entropy_spike"], "extraction": ["extraction_"],
        "ssh": ["ssh_"], "suid": ["suid_"], "credential_files": ["credential_file_"], "custom_search": ["custom_name_search", "custom_term_search"],
    },
    "network": {
        "interfaces": ["interface"], "hosts_file": ["hosts_entry", "hosts_file_"], "dns": ["dns_"], "listening_ports": ["listening_port"],
        "wifi": ["wifi_"], "firewall": ["firewall_"],
    },
    "software": {
        "os_info": ["os_identity"], "users": ["local_user_account", "users_"], "processes": ["process", "processes_"],
        "packages": ["installed_packages", "package_", "packages_"], "browsers": ["browser_"], "persistence": ["persistence_"],
    },
    "hardware": {
        "cpu": ["cpu"], "memory": ["memory"], "storage_volumes": ["storage_volume", "storage_unreadable"], "usb": ["usb_"], "pci": ["pci_"],
        "cpu_vulnerabilities": ["hw_cpu_vulnerabilit"], "tpm": ["tpm_"], "secure_boot": ["secure_boot_"], "encryption": ["disk_encryption"],
    },
}
#: Findings about the scan itself, which no check filter removes.
HOUSEKEEPING = ["clean_file", "scan_error"]


def checks(spark: SparkSession) -> DataFrame:
    """(category, check_id, prefixes): the check families (SNK-06)."""
    return spark.createDataFrame([(c, i, p) for c, fam in CHECKS.items() for i, p in fam.items()], "category string, check_id string, prefixes array<string>")


def pii_types(spark: SparkSession) -> DataFrame:
    """(id, label) of all PII rules and names (SNK-05)."""
    return spark.createDataFrame([(r["id"], r["label"]) for r in PII_RULES] + [("PERSON_NAME", "Person name")], "id string, label string")


def counts_by_check(findings: DataFrame) -> DataFrame:
    """(category, check_id, prefixes, n) of all check families: how many findings belong to each. Findings are counted by subtype before families are asked."""
    kinds = findings.groupBy("category", "subtype").agg(F.count("*").alias("n")).withColumnRenamed("category", "c")
    own = checks(findings.sparkSession)
    fits = (F.when(own.category == "files", "storage").otherwise(own.category) == F.col("c")) & F.exists("prefixes", lambda p: F.startswith("subtype", p))
    return own.join(F.broadcast(kinds), fits, "left").groupBy("category", "check_id", "prefixes").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def counts_by_type(matches: DataFrame) -> DataFrame:
    """(id, label, n) of all PII types: how many matches (rule_id) are of each."""
    counts = matches.groupBy(F.col("rule_id").alias("id")).agg(F.count("*").alias("n"))
    return pii_types(matches.sparkSession).join(F.broadcast(counts), "id", "left").fillna(0, ["n"])


def filter_checks(findings: DataFrame, selected: dict[str, list[str]]) -> DataFrame:
    """Findings of the selected families (FIL-04); categories without a selection pass whole, unknown ones are ignored."""
    keep = F.lit(True)
    for category, ids in selected.items():
        if category in CHECKS and ids:
            prefixes = [p for i in ids for p in CHECKS[category].get(i, [])]
            fits = F.col("subtype").isin(HOUSEKEEPING)
            for p in prefixes:
                fits = fits | F.startswith("subtype", F.lit(p))
            keep = keep & ((F.col("category") != ("storage" if category == "files" else category)) | fits)
    return findings.where(keep)


def flagged_only(findings: DataFrame) -> DataFrame:
    return findings.where(is_flagged(F.col("severity")))


def by_severity(findings: DataFrame) -> DataFrame:
    """(severity, n) for all six severities (AGG-01): one pass of counts, turned into rows."""
    counts = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in SEVERITIES])).alias("r")).select("r.*")


def by_category(findings: DataFrame) -> DataFrame:
    """(category, n, flagged) for all five categories (AGG-01)."""
    counts = findings.agg(*[x for c in CATEGORIES for x in (F.count_if(F.col("category") == c).alias(c), F.count_if((F.col("category") == c) & is_flagged(F.col("severity"))).alias(f"{c}_f"))])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("n"), F.col(f"{c}_f").alias("flagged")) for c in CATEGORIES])).alias("r")).select("r.*")


def summary(findings: DataFrame) -> DataFrame:
    """One row: total_findings, flagged_findings, highest severity rank and counts by severity (AGG-01)."""
    return findings.agg(
        F.count("*").alias("total_findings"), F.count_if(is_flagged(F.col("severity"))).alias("flagged_findings"), F.coalesce(F.max(severity_rank(F.col("severity"))), F.lit(0)).alias("highest_rank"),
        F.map_from_arrays(F.array(*map(F.lit, SEVERITIES)), F.array(*[F.count_if(F.col("severity") == s) for s in SEVERITIES])).alias("by_severity"),
    )


def rollups(findings: DataFrame) -> DataFrame:
    """(category, severity, n, flagged) by both, by each and in total, null standing for all (AGG-01): one pass, from which the other roll-ups can be read."""
    return findings.cube("category", "severity").agg(F.count("*").alias("n"), F.count_if(is_flagged(F.col("severity"))).alias("flagged"))


def write_json(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines at ``path`` and the summary beside them (SNK-01)."""
    findings.write.mode("overwrite").json(f"{path}/findings")
    summary(findings).write.mode("overwrite").json(f"{path}/summary")
