"""Captured host state as tables: each parser takes (path, value) lines or whole texts, as ``spark.read.text`` gives them.

NET-03..10, SW-01..06, SW-17, SW-18, HW-01..08, SEC-01..04. Nothing here reads the host itself but ``interfaces``
and ``permissions``; captured files make every parser testable and let one job scan many hosts.
"""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.network import classify_ip, hex_address
from ..functions.severity import finding
from ..functions.text import real_domain

_NO_COMMENT = "value not rlike '^[ \\t]*(#|$)'"


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _fields(col="value"):
    return F.filter(F.split(F.trim(F.col(col)), "\\s+"), lambda x: x != "")


def hosts(rows: DataFrame) -> DataFrame:
    """(path, ip, domain): one row per name of a hosts file, comments cut (NET-04)."""
    bare = rows.withColumn("value", F.regexp_replace("value", "#.*$", "")).withColumn("f", _fields())
    return bare.where(F.size("f") >= 2).select("path", F.get("f", F.lit(0)).alias("ip"), F.explode(F.slice("f", 2, 1 << 20)).alias("domain"))


def hosts_findings(entries: DataFrame) -> DataFrame:
    """Low where a real domain points to this machine or nowhere (NET-04)."""
    scope = classify_ip(F.col("ip"))["scope"]
    sev = F.when(real_domain(F.col("domain")) & scope.isin("loopback", "unspecified"), "low").otherwise("info")
    return entries.select(*finding("network", "hosts_entry", "Hosts file entry", sev, F.concat_ws(" -> ", "domain", "ip"), F.col("path"), source="hosts_file", tags=["hosts"]))


def resolvers(rows: DataFrame) -> DataFrame:
    """(path, server) of nameserver lines of exactly two fields (NET-05)."""
    f = rows.withColumn("f", _fields())
    return f.where((F.size("f") == 2) & (F.get("f", F.lit(0)) == "nameserver")).select("path", F.get("f", F.lit(1)).alias("server"))


def resolver_findings(servers: DataFrame) -> DataFrame:
    """One finding per file with its servers in turn of their text, and what is known of them (NET-02, NET-05)."""
    from ..functions.tables import DNS_PROVIDERS

    known = F.create_map(*[F.lit(x) for pair in DNS_PROVIDERS for x in pair])
    told = servers.groupBy("path").agg(F.sort_array(F.collect_set("server")).alias("servers"))
    names = F.array_join(F.array_compact(F.transform("servers", lambda s: F.try_element_at(known, s))), ", ")
    return told.select(*finding("network", "dns_resolvers", "DNS resolvers", "info", F.array_join("servers", ", "), F.col("path"), source="resolv_conf", evidence=F.create_map(F.lit("providers"), names), tags=["dns"]))


def ipconfig_resolvers(whole: DataFrame) -> DataFrame:
    """(path, server) of ``DNS Servers`` lines of whole captured ipconfig outputs and the bare addresses below them (NET-06)."""
    block = F.regexp_extract_all("value", F.lit("DNS Servers[ .]*:\\s*([0-9A-Fa-f:.%]+(?:\\n\\s+[0-9A-Fa-f:.%]+(?=\\s*(?:\\n|$)))*)"), F.lit(1))
    return whole.select("path", F.explode(F.flatten(F.transform(block, lambda b: F.split(F.trim(b), "\\s+")))).alias("server"))


def listening(rows: DataFrame) -> DataFrame:
    """(path, local_addr, local_port, state, uid, scope) of sockets in state 0A of /proc/net/tcp and tcp6 (NET-07)."""
    f = rows.withColumn("f", _fields()).where((F.size("f") >= 8) & (F.get("f", F.lit(3)) == "0A"))
    a = hex_address(F.get("f", F.lit(1)))
    got = f.select("path", a["ip"].alias("local_addr"), a["port"].alias("local_port"), F.lit("LISTEN").alias("state"), F.get("f", F.lit(7)).try_cast("int").alias("uid"))
    return got.withColumn("scope", classify_ip(F.col("local_addr"))["scope"])


def listening_findings(sockets: DataFrame) -> DataFrame:
    return sockets.select(*finding("network", "listening_port", "Listening port", "info", F.concat_ws(":", "local_addr", F.col("local_port").cast("string")), F.col("path"), source="proc_net_tcp", evidence=F.create_map(F.lit("uid"), F.col("uid").cast("string"), F.lit("scope"), F.col("scope")), tags=["port"]))


def _ini(name: str):
    return F.nullif(F.regexp_extract("value", rf"(?m)^\s*{name}\s*=\s*(.*?)\s*$", 1), F.lit(""))


def wifi(whole: DataFrame) -> DataFrame:
    """(path, ssid, key_mgmt, has_psk) of NetworkManager profiles; the key itself is never kept (NET-08)."""
    return whole.select("path", _ini("ssid").alias("ssid"), _ini("key-mgmt").alias("key_mgmt"), _ini("psk").isNotNull().alias("has_psk")).where("ssid is not null")


def wifi_findings(profiles: DataFrame) -> DataFrame:
    """Medium with a stored key, low for an open network, else info (NET-08)."""
    sev = F.when(F.col("has_psk"), "medium").when(F.coalesce("key_mgmt", F.lit("none")) == "none", "low").otherwise("info")
    return profiles.select(*finding("network", "wifi_profile", "Saved WiFi profile", sev, F.col("ssid"), F.col("path"), source="network_manager", tags=["wifi"]))


def firewall(whole: DataFrame) -> DataFrame:
    """(path, rules, preview): lines that aren't comments of a captured rule set, and its first 200 characters (NET-09)."""
    rules = F.size(F.filter(F.split("value", "\n"), lambda x: ~x.rlike("^\\s*(#|$)")))
    return whole.select("path", rules.alias("rules"), F.left("value", F.lit(200)).alias("preview"))


def firewall_findings(sets: DataFrame) -> DataFrame:
    return sets.select(*finding("network", "firewall_ruleset", "Firewall rules", "info", F.concat(F.col("rules").cast("string"), F.lit(" rules")), F.col("path"), source="firewall", evidence=F.create_map(F.lit("preview"), F.col("preview")), tags=["firewall"]))


def os_release(rows: DataFrame) -> DataFrame:
    """(path, name) of PRETTY_NAME (SW-01)."""
    return rows.where(F.startswith("value", F.lit("PRETTY_NAME="))).select("path", F.regexp_replace(F.regexp_replace("value", "^[^=]*=", ""), '^"|"$', "").alias("name"))


def os_findings(names: DataFrame) -> DataFrame:
    return names.select(*finding("software", "os_identity", "Operating system", "info", F.col("name"), F.col("path"), source="os_release", tags=["os"]))


def passwd(rows: DataFrame) -> DataFrame:
    """(path, username, uid, gid, gecos, home, shell) of lines of seven fields or more (SW-02)."""
    f = rows.where(_NO_COMMENT).withColumn("f", F.split("value", ":", -1)).where(F.size("f") >= 7)
    at = lambda i: F.get("f", F.lit(i))
    return f.select("path", at(0).alias("username"), at(2).try_cast("int").alias("uid"), at(3).try_cast("int").alias("gid"), at(4).alias("gecos"), at(5).alias("home"), at(6).alias("shell"))


def user_findings(users: DataFrame) -> DataFrame:
    """Critical for a second root, low for a system account that can log in (SW-02)."""
    can_log_in = ~F.col("shell").rlike("(nologin|false|sync|halt|shutdown)$") & (F.col("shell") != "")
    sev = F.when((F.col("uid") == 0) & (F.col("username") != "root"), "critical").when((F.col("uid") < 1000) & (F.col("uid") != 0) & can_log_in, "low").otherwise("info")
    return users.select(*finding("software", "local_user_account", "Local user account", sev, F.col("username"), F.col("path"), source="passwd", evidence=F.create_map(F.lit("uid"), F.col("uid").cast("string"), F.lit("shell"), F.col("shell")), tags=["user"]))


def process_findings(processes: DataFrame, most: int | None = 500) -> DataFrame:
    """The first ``most`` (None: all) captured processes (pid, uid, exe, cmdline): medium if the program was deleted, low for root's without a known program (SW-03)."""
    gone = F.endswith("exe", F.lit(" (deleted)"))
    sev = F.when(gone, "medium").when((F.col("uid") == 0) & F.col("exe").isNull() & (F.coalesce("cmdline", F.lit("")) != ""), "low").otherwise("clean")
    return (processes if most is None else processes.orderBy("pid").limit(most)).select(*finding("software", "process", "Running process", sev, F.coalesce("cmdline", "exe"), F.col("pid"), source="proc", tags=["process"]))


def dpkg(spark: SparkSession, path: str) -> DataFrame:
    """(name, version, arch, section, status) of a dpkg status file's paragraphs (SW-04)."""
    return dpkg_paragraphs(spark.read.text(path, lineSep="\n\n"))


def dpkg_paragraphs(rows: DataFrame) -> DataFrame:
    """The same of paragraphs (value)."""
    field = lambda n: F.nullif(F.regexp_extract("value", rf"(?m)^{n}: *(.*)$", 1), F.lit(""))
    return rows.select(*[field(n).alias(a) for n, a in (("Package", "name"), ("Version", "version"), ("Architecture", "arch"), ("Section", "section"), ("Status", "status"))]).where("name is not null")


def rpm(rows: DataFrame) -> DataFrame:
    """The same of captured tab-separated name, version, arch, group (SW-05)."""
    f = F.split("value", "\t")
    return rows.where("value <> ''").select(*[F.get(f, F.lit(i)).alias(a) for i, a in enumerate(("name", "version", "arch", "section"))], F.lit("install ok installed").alias("status"))


def package_findings(packages: DataFrame) -> DataFrame:
    """Broken states, blacklisted packages and known vulnerabilities (SW-06, SW-07, SW-09)."""
    from ..operators.intel import blacklisted, broken_packages, vulnerable

    a = broken_packages(packages).select(*finding("software", "package_broken_state", "Package in a broken state", "low", F.concat_ws(": ", "name", "status"), F.col("name"), source="packages", tags=["package"]))
    b = blacklisted(packages, "name").select(*finding("software", "package_blacklisted", "Blacklisted software", F.col("severity"), F.concat_ws(": ", "name", "reason"), F.col("name"), source="packages", tags=["package"]))
    c = vulnerable(packages, "name").select(*finding("software", "package_known_cve", "Known vulnerability", F.col("severity"), F.concat_ws(": ", "name", "cve_id"), F.col("name"), source="packages", tags=["package"]))
    return a.unionByName(b).unionByName(c)


def crontab(rows: DataFrame) -> DataFrame:
    """(path, schedule, line): entries of six fields or more that are neither comments nor assignments (SW-17)."""
    f = rows.where(_NO_COMMENT).where(~F.col("value").rlike("^\\s*[A-Za-z_][A-Za-z0-9_]*\\s*=")).withColumn("f", _fields())
    return f.where(F.size("f") >= 6).select("path", F.array_join(F.slice("f", 1, 5), " ").alias("schedule"), F.trim("value").alias("line"))


def user_crontab(rows: DataFrame) -> DataFrame:
    """The same of a user's own table, whose lines name no user: five fields and a command."""
    f = rows.where(_NO_COMMENT).where(~F.col("value").rlike("^\\s*[A-Za-z_][A-Za-z0-9_]*\\s*=")).withColumn("f", _fields())
    return f.where(F.size("f") >= 6).select("path", F.array_join(F.slice("f", 1, 5), " ").alias("schedule"), F.trim("value").alias("line"))


def placed_findings(files: DataFrame, subtype: str, title: str) -> DataFrame:
    """Files that something runs because of where they lie: periodic jobs, wanted units (SW-17, SW-18)."""
    return files.select(*finding("software", subtype, title, "clean", F.regexp_extract("path", "[^/]+$", 0), F.col("path"), source="persistence", tags=["persistence"]))


def persistence_findings(entries: DataFrame) -> DataFrame:
    return entries.select(*finding("software", "persistence_cron_entry", "Scheduled job", "clean", F.col("line"), F.col("path"), source="cron", tags=["persistence"]))


def autostart(whole: DataFrame) -> DataFrame:
    """(path, exec) of desktop entries (SW-18)."""
    return whole.select("path", _ini("Exec").alias("exec")).where("exec is not null")


def autostart_findings(entries: DataFrame) -> DataFrame:
    return entries.select(*finding("software", "persistence_autostart", "Program started at login", "clean", F.col("exec"), F.col("path"), source="autostart", tags=["persistence"]))


def rc_local(whole: DataFrame) -> DataFrame:
    """Findings for rc.local files that do something (SW-18)."""
    active = F.exists(F.split("value", "\n"), lambda x: ~x.rlike("^\\s*(#|$|exit 0\\s*$)"))
    return whole.where(active).select(*finding("software", "persistence_rc_local", "rc.local runs commands", "low", F.left("value", F.lit(200)), F.col("path"), source="rc_local", tags=["persistence"]))


def cpuinfo(rows: DataFrame) -> DataFrame:
    """(path, model, cores) (HW-01)."""
    key, val = F.regexp_extract("value", "^(.*?)\\s*:", 1), F.regexp_extract("value", ":\\s*(.*?)\\s*$", 1)
    return rows.groupBy("path").agg(F.max(F.when(key == "model name", val)).alias("model"), F.count_if(key == "processor").alias("cores"))


def meminfo(rows: DataFrame) -> DataFrame:
    """(path, total_gb, available_gb) to one decimal (HW-02)."""
    kb = lambda n: F.max(F.when(F.startswith("value", F.lit(n + ":")), F.regexp_extract("value", "(\\d+)", 1).try_cast("bigint")))
    return rows.groupBy("path").agg(F.round(kb("MemTotal") / 1048576, 1).alias("total_gb"), F.round(kb("MemAvailable") / 1048576, 1).alias("available_gb"))


def cpu_findings(cpus: DataFrame) -> DataFrame:
    return cpus.select(*finding("hardware", "cpu", "Processor", "info", F.coalesce("model", F.lit("unknown")), F.col("path"), source="cpuinfo", evidence=F.create_map(F.lit("cores"), F.col("cores").cast("string")), tags=["cpu"]))


def memory_findings(sizes: DataFrame) -> DataFrame:
    told = F.concat(F.col("total_gb").cast("string"), F.lit(" GB, "), F.coalesce(F.col("available_gb").cast("string"), F.lit("?")), F.lit(" GB available"))
    return sizes.select(*finding("hardware", "memory", "Memory", "info", told, F.col("path"), source="meminfo", tags=["memory"]))


#: Kinds of file system that hold no files of their own.
PSEUDO = ("proc sysfs tmpfs devtmpfs devpts cgroup cgroup2 pstore bpf debugfs tracefs securityfs configfs fusectl mqueue hugetlbfs autofs rpc_pipefs squashfs overlay").split()


def mounts(rows: DataFrame) -> DataFrame:
    """(path, device, mountpoint, fstype) of real devices (HW-03)."""
    f = rows.withColumn("f", _fields()).where(F.size("f") >= 3)
    got = f.select("path", *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(("device", "mountpoint", "fstype"))])
    return got.where(F.startswith("device", F.lit("/dev/")) & ~F.col("fstype").isin(PSEUDO))


def volume_findings(volumes: DataFrame) -> DataFrame:
    """Volumes with used_pct: low from 95 per cent (HW-03)."""
    return volumes.select(*finding("hardware", "storage_volume", "Storage volume", F.when(F.col("used_pct") >= 95, "low").otherwise("info"), F.concat_ws(" ", "device", "mountpoint", "fstype"), F.col("mountpoint"), source="mounts", tags=["storage"]))


#: Words in a USB device's name that call for a look.
SUSPICIOUS = ("rubber ducky", "badusb", "keylogger", "hak5", "bash bunny", "malduino")


def usb_findings(devices: DataFrame) -> DataFrame:
    """USB devices (label): clean, medium if the label has a suspicious word (HW-04)."""
    bad = F.lower("label").rlike("|".join(SUSPICIOUS))
    return devices.select(*finding("hardware", "usb_device", "USB device", F.when(bad, "medium").otherwise("clean"), F.col("label"), F.col("label"), source="usb", tags=["usb"]))


def cpu_vulnerability_findings(rows: DataFrame) -> DataFrame:
    """Files below /sys/devices/system/cpu/vulnerabilities: high where vulnerable, info where mitigated (HW-06)."""
    low = F.lower("value")
    sev = F.when(F.contains(low, F.lit("vulnerable")), "high").when(F.startswith(low, F.lit("mitigation")), "info").otherwise("clean")
    name = F.regexp_extract("path", "[^/]+$", 0)
    cve = F.create_map(*[F.lit(x) for kv in (("spectre_v1", "CVE-2017-5753"), ("spectre_v2", "CVE-2017-5715"), ("meltdown", "CVE-2017-5754"), ("l1tf", "CVE-2018-3615")) for x in kv])
    return rows.select(*finding("hardware", "hw_cpu_vulnerability", F.concat(F.lit("CPU vulnerability: "), name), sev, F.col("value"), F.col("path"), source="sysfs", evidence=F.create_map(F.lit("cve_id"), F.try_element_at(cve, name)), tags=["cpu"]))


def tpm_and_secure_boot(tpm_versions: list[str], secure_boot: int | None, spark: SparkSession) -> DataFrame:
    """Findings from captured TPM versions and the Secure Boot byte (null: unknown) (HW-07)."""
    tpm = ("tpm_status", "clean" if tpm_versions else "low", ", ".join(tpm_versions) or "no TPM found")
    boot = ("secure_boot_status", "info" if secure_boot is None else "clean" if secure_boot else "low", {None: "unknown", 0: "off"}.get(secure_boot, "on"))
    rows = spark.createDataFrame([tpm, boot], "subtype string, severity string, detail string")
    return rows.select(*finding("hardware", F.col("subtype"), F.col("subtype"), F.col("severity"), F.col("detail"), F.lit("firmware"), source="sysfs", tags=["firmware"]))


def disk_encryption(block_devices: DataFrame) -> DataFrame:
    """One finding: whether any captured device (name, uuid) is a dm-crypt mapping (HW-08)."""
    n = block_devices.agg(F.count_if(F.startswith("uuid", F.lit("CRYPT-"))).alias("n"))
    return n.select(*finding("hardware", "disk_encryption", "Disk encryption", F.when(F.col("n") > 0, "clean").otherwise("low"), F.concat(F.col("n").cast("string"), F.lit(" encrypted devices")), F.lit("block"), source="sysfs", tags=["encryption"]))


def tpm_findings(whole: DataFrame) -> DataFrame:
    """A captured tpm_version_major file tells that there is a TPM (HW-07)."""
    return whole.select(*finding("hardware", "tpm_status", "TPM", "clean", F.concat(F.lit("version "), F.trim("value")), F.col("path"), source="sysfs", tags=["firmware"]))


def secure_boot_findings(whole: DataFrame) -> DataFrame:
    """The last byte of a captured SecureBoot variable: 1 is on (HW-07)."""
    on = F.ascii(F.right("value", F.lit(1))) == 1
    return whole.select(*finding("hardware", "secure_boot_status", "Secure Boot", F.when(on, "clean").otherwise("low"), F.when(on, "on").otherwise("off"), F.col("path"), source="efivars", tags=["firmware"]))


def crypt_findings(whole: DataFrame) -> DataFrame:
    """Captured device mapper ids: an encrypted mapping or not (HW-08)."""
    crypt = F.startswith("value", F.lit("CRYPT-"))
    return whole.select(*finding("hardware", "disk_encryption", "Disk encryption", F.when(crypt, "clean").otherwise("low"), F.trim("value"), F.col("path"), source="sysfs", tags=["encryption"]))


def interface_findings(rows: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Interfaces (name, mac, up, addresses): vendor of the address and classes of its addresses; info where one is up without any but isn't the loopback, else clean (NET-03)."""
    from ..operators.intel import mac_vendor

    known = rows.withColumn("vendor", F.lit(None).cast("string")) if registry is None else mac_vendor(rows, "mac", registry)
    one = known.select("name", "mac", "up", "vendor", F.col("addresses"), F.explode_outer("addresses").alias("ip")).withColumn("scope", classify_ip(F.col("ip"))["scope"])
    told = one.groupBy("name", "mac", "up", "vendor").agg(F.count("ip").alias("n"), F.sort_array(F.collect_set("scope")).alias("scopes"))
    bare = F.col("up") & (F.col("n") == 0) & (F.col("name") != "lo")
    return told.select(*finding("network", "interface", "Network interface", F.when(bare, "info").otherwise("clean"), F.concat_ws(" ", "name", "mac", "vendor"), F.col("name"), source="interfaces", evidence=F.create_map(F.lit("vendor"), F.col("vendor"), F.lit("scopes"), F.array_join("scopes", ",")), tags=["interface"]))


def interfaces(spark: SparkSession) -> DataFrame:
    """(name, mac, up) of the driver's interfaces from /sys/class/net, none where that is missing (NET-03)."""
    rows, top = [], "/sys/class/net"
    read = lambda *p: open(os.path.join(*p)).read().strip() if os.path.exists(os.path.join(*p)) else None
    for name in sorted(os.listdir(top)) if os.path.isdir(top) else []:
        rows.append((name, read(top, name, "address"), read(top, name, "operstate") == "up"))
    return spark.createDataFrame(rows, "name string, mac string, up boolean")


def permissions(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, mode, is_dir) of the driver's files directly within folders."""
    rows = []
    for d in folders:
        if os.path.isdir(d):
            rows.append((d, os.lstat(d).st_mode, True))
            rows += [(e.path, e.stat(follow_symlinks=False).st_mode, e.is_dir(follow_symlinks=False)) for e in os.scandir(d)]
    return spark.createDataFrame(rows, "path string, mode long, is_dir boolean")


def ssh_findings(perms: DataFrame) -> DataFrame:
    """Folders open to others, private keys others can read, authorized_keys and config others can write (SEC-01); contents are never kept."""
    base, mode = F.regexp_extract("path", "[^/]+$", 0), F.col("mode")
    has = lambda bits: mode.bitwiseAND(F.lit(bits)) != 0
    private = base.rlike("^(id_[A-Za-z0-9]+|.*\\.pem|identity)$")
    kind = (
        F.when(F.col("is_dir") & has(0o077), "ssh_dir_permissions").when(private, "ssh_private_key")
        .when((base == "config") & has(0o022), "ssh_config_permissions").when((base == "authorized_keys") & has(0o022), "ssh_authorized_keys_permissions")
    )
    sev = F.when(kind == "ssh_private_key", F.when(has(0o077), "high").otherwise("info")).when(kind == "ssh_authorized_keys_permissions", "high").otherwise("medium")
    return perms.where(kind.isNotNull()).select(*finding("storage", kind, "SSH file", sev, F.lpad(F.conv(mode.bitwiseAND(F.lit(0o777)).cast("string"), 10, 8), 3, "0"), F.col("path"), source="ssh_audit", tags=["ssh"]))


def authorized_keys(rows: DataFrame) -> DataFrame:
    """(path, key_type, comment) of entries, never the key (SEC-01)."""
    f = rows.where(_NO_COMMENT).withColumn("f", _fields())
    at = F.array_position(F.transform("f", lambda x: x.rlike("^(ssh-|ecdsa-|sk-)")), F.lit(True))
    return f.where(at > 0).select("path", F.get("f", (at - 1).cast("int")).alias("key_type"), F.array_join(F.slice("f", (at + 2).cast("int"), 1 << 20), " ").alias("comment"))


#: Programs that have the set-user-id bit on most systems.
KNOWN_SUID = ("sudo su passwd chsh chfn newgrp gpasswd mount umount ping fusermount fusermount3 pkexec at crontab ssh-agent expiry chage wall write").split()


def suid_findings(perms: DataFrame) -> DataFrame:
    """Programs with a set-user-id or set-group-id bit: info if known, else low (SEC-02)."""
    bits = F.col("mode").bitwiseAND(F.lit(stat.S_ISUID | stat.S_ISGID))
    base = F.regexp_extract("path", "[^/]+$", 0)
    return perms.where((bits != 0) & ~F.col("is_dir")).select(*finding("storage", "suid_sgid_binary", "SUID/SGID program", F.when(base.isin(KNOWN_SUID), "info").otherwise("low"), base, F.col("path"), source="suid_audit", tags=["suid"]))


#: Path endings of files that commonly hold credentials.
CREDENTIAL_FILES = (".aws/credentials", ".netrc", ".docker/config.json", ".kube/config", ".git-credentials", ".pgpass", ".npmrc", ".pypirc")


def credential_findings(paths: DataFrame) -> DataFrame:
    """Presence of credential files by path alone, high (SEC-03)."""
    hit = F.lit(None).cast("string")
    for p in CREDENTIAL_FILES:
        hit = F.when(F.endswith("path", F.lit("/" + p)), p).otherwise(hit)
    name = F.regexp_replace(F.regexp_replace(hit, "[^A-Za-z0-9]+", "_"), "^_", "")
    return paths.where(hit.isNotNull()).select(*finding("storage", F.concat(F.lit("credential_file_"), name), "Credential file present", "high", hit, F.col("path"), source="credential_scan", tags=["credentials"]))


def not_implemented(hosts: DataFrame, subtypes: list[tuple[str, str]], host_col: str = "host", platform_col: str = "platform") -> DataFrame:
    """Info findings (category, subtype) of each host for checks that its platform lacks, which all but linux do (NET-10, SEC-04)."""
    lacks = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(s).alias("subtype")) for c, s in subtypes])
    rows = hosts.where(F.lower(platform_col) != "linux").select(F.col(host_col).alias("host"), F.explode(lacks).alias("l"))
    return rows.select(F.col("l.category").alias("category"), *finding("storage", F.col("l.subtype"), "Not implemented on this platform", "info", F.col("l.subtype"), F.col("host"), source="host")[1:])
