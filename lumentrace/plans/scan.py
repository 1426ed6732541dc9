"""The scan as one lazy plan: texts or files to findings, then filters and the report (SRC-02, FIL-05, SNK-03)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.entropy import profile
from ..functions.regex import let
from ..functions.severity import FINDING, finding
from ..functions.text import MAX_TEXT, hidden_path
from ..operators import crack, encodings, entropy_windows, filesig, language, pii_scan
from ..operators.report import by_category, by_severity, filter_checks, summary
from ..sources import hostfiles as H
from ..sources.files import extension, extraction_finding, read_files, scan_error, with_text

CATEGORIES = ("files", "network", "software", "hardware")
ALL = ("hidden_files", "file_signature", "extraction", "pii", "custom_search", "encoded_content", "cipher", "entropy")


def _union(parts: Iterable[DataFrame | None]) -> DataFrame:
    found = [p for p in parts if p is not None]
    out = found[0]
    for p in found[1:]:
        out = out.unionByName(p)
    return out


_KIND = "array<" + FINDING.simpleString() + ">"


def text_findings(
    rows: DataFrame, id_col: str, text_col: str, detectors: Iterable[str] = ALL, pii_types: list[str] | None = None, names: list[tuple[str, str, str]] = (), terms: list[dict] = (),
    data: crack.LanguageData = crack.LanguageData(), most: int | None = encodings.MOST, shown: int | None = encodings.SHOWN, content_col: str | None = None, found: str = "findings",
) -> DataFrame:
    """``rows`` with ``found``, the findings of the chosen detectors over each text as one array: no row is read twice, joined or shuffled.

    Decoded pieces and cracked plain texts go through the PII rules once more, with a note of where they came from. Of encoded pieces ``most`` of a
    kind are told and ``shown`` bytes of each, which the PII rules see too; with None all of both. Entropy is taken of ``content_col``, else of the text.
    """
    d, location, text = set(detectors), F.col(id_col), F.col(text_col)
    pii = "pii" in d
    steps: dict[str, Column] = {}
    arrays: list[Column] = []
    if pii:
        arrays.append(pii_scan.finding_array(text, location, pii_types))
    if "custom_search" in d and (names or terms):
        arrays.append(pii_scan.search_finding_array(text, location, names, terms))
    if "encoded_content" in d:
        steps["_cracked"] = encodings.cracked_hex(text, most, data)

        def told(m: Column) -> Column:
            own = F.array(F.struct(*encodings.finding_columns(m.getField, location))).cast(_KIND)
            if not pii:
                return own
            note = F.concat(F.lit("decoded from "), m["kind"], F.lit(" at position "), m["pos"].cast("string"))
            return F.concat(own, pii_scan.finding_array(F.when(m["meaningful"], m["decoded"]), location, pii_types, note=note).cast(_KIND))

        arrays.append(F.flatten(F.transform(encodings.pieces(text, F.col("_cracked"), None, most, shown), told)))
    if "cipher" in d:
        steps["_suspect"] = crack.suspect(text, language.known(text))
        steps["_candidates"] = crack.candidates_column(F.col("_suspect"), data)
        steps["_crack"] = crack.winner(F.col("_candidates"))
        arrays.append(crack.finding_array(F.col("_suspect"), F.col("_crack"), location, pii_types, pii))
    if "entropy" in d:
        content = F.encode(text, "UTF-8") if content_col is None else F.col(content_col)
        steps["_content"] = F.when(F.octet_length(content).between(1, MAX_TEXT), content) if content_col else content
        steps["_profile"] = profile(F.col("_content"), entropy_windows.LEAST_FILE, entropy_windows.WINDOW, entropy_windows.LEAST_WINDOW)
        arrays.append(entropy_windows.finding_array(F.col("_content"), F.col("_profile"), location))
    out = rows
    for name, column in steps.items():
        out = out.withColumn(name, column)
    every = F.concat(*[F.coalesce(a.cast(_KIND), F.array().cast(_KIND)) for a in arrays]) if arrays else F.array().cast(_KIND)
    return out.withColumn(found, every).drop(*steps)


def unfolded(rows: DataFrame, found: Column, location: Column, clean: bool) -> DataFrame:
    """Arrays of findings as rows; with ``clean`` a row without any has a clean_file finding (SRC-02)."""
    none = F.array(F.struct(*finding("storage", "clean_file", "No findings", "clean", F.lit("No findings"), location))).cast(_KIND)
    every = let(found, lambda a: F.when(F.size(a) == 0, none).otherwise(a)) if clean else found
    return rows.select(F.explode(every).alias("f")).select("f.*")


def scan_texts(df: DataFrame, id_col: str, text_col: str, detectors: Iterable[str] = ALL, clean: bool = False, **options) -> DataFrame:
    """Findings of the chosen detectors over texts (``text_findings``, which has the options); detectors left out are not in the plan.

    With ``clean`` a text without findings has a clean_file row.
    """
    rows = df.select(F.col(id_col).alias("location"), F.col(text_col).alias("text"))
    return unfolded(text_findings(rows, "location", "text", detectors, **options), F.col("findings"), F.col("location"), clean)


def with_clean_rows(findings: DataFrame, sources: DataFrame, id_col: str) -> DataFrame:
    """A clean_file row for each source without findings (SRC-02), where findings come from elsewhere; filters belong above this, so they make no file clean."""
    seen = findings.select(F.col("location").alias("_seen")).distinct()
    rest = sources.select(F.col(id_col)).distinct().join(seen, F.col(id_col).cast("string") == F.col("_seen"), "left_anti")
    return findings.unionByName(rest.select(*finding("storage", "clean_file", "No findings", "clean", F.lit("No findings"), F.col(id_col))))


def scan_files(spark: SparkSession, target: str, detectors: Iterable[str] = ALL, limits: dict | None = None, **options) -> DataFrame:
    """Findings of all files below ``target``: names, signatures, extraction, then the detectors over their text, in one pass over each file.

    What can't be read gives a scan_error. ``limits`` are arguments of ``with_text``.
    """
    d = set(detectors)
    files = with_text(read_files(spark, target), **limits or {})
    path, parts = F.col("path"), [scan_error(F.col("error"), F.col("path"))]
    if "hidden_files" in d:
        told = finding("storage", "hidden_file", "Hidden file", "low", path, path, tags=["hidden"])
        parts.append(F.when(hidden_path(path) & F.col("length").isNotNull(), F.struct(*told)))
    if "file_signature" in d:
        files = files.withColumn("_verdict", filesig.verdict(F.col("content"), extension(path)))
        parts.append(F.when(F.col("content").isNotNull(), filesig.mismatch(F.col("_verdict"), path)))
    if "extraction" in d:
        parts.append(extraction_finding(F.col("text_status"), path))
    rows = text_findings(files, "path", "text", d, content_col="content", **options)
    own = F.array_compact(F.array(*[p.cast(FINDING) for p in parts])).cast(_KIND)
    return unfolded(rows, F.concat(own, F.col("findings")), path, True)


#: Captured files by the ends of their paths, as patterns: (category, how they are read, parser and findings).
CAPTURED = {
    "/etc/hosts": ("network", "lines", lambda r: H.hosts_findings(H.hosts(r))),
    "/etc/resolv[.]conf": ("network", "lines", lambda r: H.resolver_findings(H.resolvers(r))),
    "/ipconfig[.]txt": ("network", "whole", lambda r: H.resolver_findings(H.ipconfig_resolvers(r))),
    "/proc/net/tcp6?": ("network", "lines", lambda r: H.listening_findings(H.listening(r))),
    "[.]nmconnection": ("network", "whole", lambda r: H.wifi_findings(H.wifi(r))),
    "/etc/(nftables[.]conf|iptables/rules[.]v[46])": ("network", "whole", lambda r: H.firewall_findings(H.firewall(r))),
    "/os-release": ("software", "lines", lambda r: H.os_findings(H.os_release(r))),
    "/etc/passwd": ("software", "lines", lambda r: H.user_findings(H.passwd(r))),
    "/var/lib/dpkg/status": ("software", "paragraphs", lambda r: H.package_findings(H.dpkg_paragraphs(r))),
    "/rpm-qa[.]tsv": ("software", "lines", lambda r: H.package_findings(H.rpm(r))),
    "/etc/(crontab|cron[.]d/[^/]+)": ("software", "lines", lambda r: H.persistence_findings(H.crontab(r))),
    "/var/spool/cron/(crontabs/)?[^/]+": ("software", "lines", lambda r: H.persistence_findings(H.user_crontab(r))),
    "/etc/cron[.](hourly|daily|weekly|monthly)/[^/]+": ("software", "whole", lambda r: H.placed_findings(r, "persistence_cron_periodic", "Periodic job")),
    "/etc/systemd/system/[^/]+[.]wants/[^/]+": ("software", "whole", lambda r: H.placed_findings(r, "persistence_systemd_unit", "Unit that the system starts")),
    "/autostart/[^/]+[.]desktop": ("software", "whole", lambda r: H.autostart_findings(H.autostart(r))),
    "/etc/rc[.]local": ("software", "whole", lambda r: H.rc_local(r)),
    "/cpu/vulnerabilities/[^/]+": ("hardware", "whole", lambda r: H.cpu_vulnerability_findings(r)),
    "/proc/cpuinfo": ("hardware", "lines", lambda r: H.cpu_findings(H.cpuinfo(r))),
    "/proc/meminfo": ("hardware", "lines", lambda r: H.memory_findings(H.meminfo(r))),
    "/proc/(self/)?mounts": ("hardware", "lines", lambda r: H.volume_findings(H.mounts(r).withColumn("used_pct", F.lit(None).cast("double")))),
    "/sys/bus/usb/devices/[^/]+/product": ("hardware", "whole", lambda r: H.usb_findings(r.select(F.trim("value").alias("label")))),
    "/tpm[0-9]+/tpm_version_major": ("hardware", "whole", lambda r: H.tpm_findings(r)),
    "/efivars/SecureBoot-[^/]+": ("hardware", "whole", lambda r: H.secure_boot_findings(r)),
    "/dm/uuid": ("hardware", "whole", lambda r: H.crypt_findings(r)),
}


def scan_captured(captured: DataFrame, categories: Iterable[str] = ("software", "hardware", "network")) -> DataFrame:
    """Findings of the chosen categories over captured host files (path, value: the whole text), of one host or of many.

    A category left out isn't in the plan. Files of no known kind give nothing.
    """
    wanted, parts = set(categories), []
    cut = {"whole": None, "lines": "\r?\n", "paragraphs": "\n\n"}
    for end, (category, kind, found) in CAPTURED.items():
        if category in wanted:
            own = captured.where(F.col("path").rlike(end + "$")).select("path", "value")
            parts.append(found(own if cut[kind] is None else own.select("path", F.explode(F.split("value", cut[kind], -1)).alias("value"))))
    return _union(parts) if parts else captured.limit(0).select(*finding("storage", "", "", "", F.lit(""), F.col("path")))


def scan_all(spark: SparkSession, target: str | None = None, captured: DataFrame | None = None, perms: DataFrame | None = None, categories: Iterable[str] = CATEGORIES, **options) -> DataFrame:
    """One scan over all chosen categories (FIL-05): files below ``target``, captured host files, and, with the files, the checks of permissions (path, mode, is_dir)."""
    wanted, parts = set(categories), []
    if "files" in wanted and target is not None:
        parts.append(scan_files(spark, target, **options))
    if "files" in wanted and perms is not None:
        parts += [H.ssh_findings(perms), H.suid_findings(perms), H.credential_findings(perms)]
    if captured is not None and wanted - {"files"}:
        parts.append(scan_captured(captured, wanted))
    return _union(parts) if parts else spark.createDataFrame([], FINDING)


def report(findings: DataFrame, checks: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The filtered findings and their roll-ups: findings, by_category, by_severity, summary."""
    kept = filter_checks(findings, checks or {})
    return {"findings": kept, "by_category": by_category(kept), "by_severity": by_severity(kept), "summary": summary(kept)}
