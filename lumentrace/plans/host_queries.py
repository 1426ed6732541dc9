"""Registered queries of host files, file formats, dictionaries and transpositions, with their SQL.

Host files are made of table rows, line by line, so that SQL gives what parsing must find from the rows themselves.
"""

from __future__ import annotations

import io
import sqlite3
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ciphers as C
from ..functions import native_ciphers as N
from ..functions.automaton import WordList
from ..operators import crack, intel, language, long_lists, pii_scan
from ..operators.report import by_severity
from ..sources import files, sqlite_source
from ..sources import hostfiles as H
from ..streaming import stream
from . import scan as scans
from .core_queries import ORACLES as ORACLES_OF_CORE
from .core_queries import _AZ, _dictionary, _t

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


def _rows(spark, sf_dir, table: str, value: str, path: str = "'host'") -> DataFrame:
    """(path, value): a line or file a row, from SQL expressions over ``table``."""
    return _t(spark, sf_dir, table).select(F.expr(path).alias("path"), F.expr(value).alias("value"))


# --- network -------------------------------------------------------------------------------------------------------

_HOSTS = "case c_custkey % 4 when 0 then '# note' when 1 then concat('10.0.0.', c_custkey % 256, ' host', c_custkey, ' Alias', c_custkey, ' # x') when 2 then concat('127.0.0.1\\tshop', c_custkey, '.example.com') else '   ' end"
_HOSTS_SQL = "select '10.0.0.' || c_custkey % 256 as ip, unnest(['host' || c_custkey, 'Alias' || c_custkey]) as domain from customer where c_custkey % 4 = 1 union all select '127.0.0.1', 'shop' || c_custkey || '.example.com' from customer where c_custkey % 4 = 2"


@query("hosts_file", _HOSTS_SQL)
def hosts_file(spark, sf_dir):
    """NET-04: names and addresses of hosts files."""
    return H.hosts(_rows(spark, sf_dir, "customer", _HOSTS)).select("ip", "domain")


@query("hosts_severity", f"select case when ip = '127.0.0.1' then 'low' else 'info' end as severity, count(*) as n from ({_HOSTS_SQL}) group by 1")
def hosts_severity(spark, sf_dir):
    """NET-04: real domains that point to this machine."""
    return H.hosts_findings(H.hosts(_rows(spark, sf_dir, "customer", _HOSTS))).groupBy("severity").agg(F.count("*").alias("n"))


@query("resolv_conf", "select '9.9.9.' || s_suppkey % 256 as server from supplier where s_suppkey % 4 = 0")
def resolv_conf(spark, sf_dir):
    """NET-05."""
    line = "case s_suppkey % 4 when 0 then concat(' nameserver\\t9.9.9.', s_suppkey % 256) when 1 then 'nameserver' when 2 then 'nameserver a b' else 'search example.com' end"
    return H.resolvers(_rows(spark, sf_dir, "supplier", line)).select("server")


@query("ipconfig_dns", "select cast(s_suppkey as varchar) as path, unnest(['8.8.8.' || s_suppkey % 256, '1.1.1.1']) as server from supplier")
def ipconfig_dns(spark, sf_dir):
    """NET-06: an address on the line and one below it, in whole captured outputs."""
    text = "concat('Adapter\\n   DNS Servers . . . . : 8.8.8.', s_suppkey % 256, '\\n                         1.1.1.1\\n   NetBIOS . . : on\\n')"
    return H.ipconfig_resolvers(_rows(spark, sf_dir, "supplier", text, "cast(s_suppkey as string)"))


@query("listening_ports", "select cast(event_id % 256 as varchar) || '.' || user_id % 256 || '.0.10' as local_addr, cast(event_id % 65536 as int) as local_port, cast(user_id as int) as uid, case event_id % 256 when 10 then 'private' when 127 then 'loopback' else 'other' end as scope from events where event_id % 3 = 0 and event_id % 256 in (10, 127)")
def listening_ports(spark, sf_dir):
    """NET-07: sockets in state 0A, by address and class."""
    line = "concat('  ', event_id, ': 0A00', lpad(hex(user_id % 256), 2, '0'), lpad(hex(event_id % 256), 2, '0'), ':', lpad(hex(event_id % 65536), 4, '0'), ' 00000000:0000 ', if(event_id % 3 = 0, '0A', '01'), ' 0:0 0:0 0 ', user_id, ' 0 1')"
    got = H.listening(_rows(spark, sf_dir, "events", line))
    return got.where("scope in ('private', 'loopback') and (local_addr like '10.%' or local_addr like '127.%')").select("local_addr", "local_port", "uid", "scope")


@query("wifi_profiles", "select case s_suppkey % 3 when 0 then 'medium' when 1 then 'low' else 'info' end as severity, s_name as ssid from supplier where s_suppkey % 5 <> 0")
def wifi_profiles(spark, sf_dir):
    """NET-08: stored keys, open networks and others; files without a network give nothing."""
    text = "concat('[connection]\\nid=x\\n[wifi]\\n', if(s_suppkey % 5 = 0, '', concat('ssid=', s_name, '\\n')), '[wifi-security]\\n', case s_suppkey % 3 when 0 then 'key-mgmt=wpa-psk\\npsk = hidden\\n' when 1 then '' else 'key-mgmt=sae\\n' end)"
    got = H.wifi_findings(H.wifi(_rows(spark, sf_dir, "supplier", text)))
    return got.select("severity", F.col("detail").alias("ssid"))


@query("firewall_rules", "select cast(s_suppkey as varchar) as path, cast(2 + s_suppkey % 7 as int) as rules from supplier")
def firewall_rules(spark, sf_dir):
    """NET-09."""
    text = "concat('# rules\\n\\ntable x {\\n', repeat('  accept\\n', cast(s_suppkey % 7 as int)), '  # end\\n}\\n')"
    return H.firewall(_rows(spark, sf_dir, "supplier", text, "cast(s_suppkey as string)")).select("path", "rules")


# --- software ------------------------------------------------------------------------------------------------------


@query("os_name", "select s_name || ' 12' as name from supplier where s_suppkey % 2 = 0")
def os_name(spark, sf_dir):
    """SW-01."""
    return H.os_release(_rows(spark, sf_dir, "supplier", "if(s_suppkey % 2 = 0, concat('PRETTY_NAME=\"', s_name, ' 12\"'), 'ID=x')")).select("name")


_PASSWD = "case when c_custkey % 7 = 0 then '# off' when c_custkey % 11 = 0 then 'bad:x:1' else concat(case when c_custkey % 50 = 1 then 'root' else concat('u', c_custkey) end, ':x:', c_custkey % 50 * 40, ':', c_nationkey, ':', c_name, ':/home/', c_custkey, ':', if(c_custkey % 3 = 0, '/usr/sbin/nologin', '/bin/sh')) end"
_USERS = "(select case when c_custkey % 50 = 1 then 'root' else 'u' || c_custkey end as username, cast(c_custkey % 50 * 40 as int) as uid, c_nationkey as gid, case when c_custkey % 3 = 0 then '/usr/sbin/nologin' else '/bin/sh' end as shell from customer where c_custkey % 7 <> 0 and c_custkey % 11 <> 0)"


@query("passwd_users", f"select * from {_USERS}")
def passwd_users(spark, sf_dir):
    """SW-02."""
    return H.passwd(_rows(spark, sf_dir, "customer", _PASSWD)).select("username", "uid", "gid", "shell")


@query("user_accounts", f"select case when uid = 0 and username <> 'root' then 'critical' when uid < 1000 and uid <> 0 and shell = '/bin/sh' then 'low' else 'info' end as severity, count(*) as n from {_USERS} group by 1")
def user_accounts(spark, sf_dir):
    """SW-02: a second root, system accounts that can log in."""
    return H.user_findings(H.passwd(_rows(spark, sf_dir, "customer", _PASSWD))).groupBy("severity").agg(F.count("*").alias("n"))


@query("process_list", "select case when event_id % 4 = 0 then 'medium' when event_id % 4 = 1 and user_id % 2 = 0 then 'low' else 'clean' end as severity, count(*) as n from events group by 1")
def process_list(spark, sf_dir):
    """SW-03 over all captured processes."""
    p = _t(spark, sf_dir, "events").selectExpr(
        "event_id as pid", "cast(user_id % 2 as int) as uid", "case event_id % 4 when 0 then '/tmp/x (deleted)' when 1 then null else '/bin/x' end as exe", "concat('x ', event_id) as cmdline"
    )
    return H.process_findings(p, most=None).groupBy("severity").agg(F.count("*").alias("n"))


_STATUS = "concat('Package: ', p_name, '\\nStatus: ', if(p_size % 5 = 0, 'deinstall ok config-files', 'install ok installed'), '\\nSection: x\\nArchitecture: amd64\\nVersion: ', p_size, '\\nDescription: y\\n more\\n')"


@query("dpkg_packages", "select p_name as name, cast(p_size as varchar) as version, 'amd64' as arch, case when p_size % 5 = 0 then 'deinstall ok config-files' else 'install ok installed' end as status from part")
def dpkg_packages(spark, sf_dir):
    """SW-04."""
    return H.dpkg_paragraphs(_rows(spark, sf_dir, "part", _STATUS)).select("name", "version", "arch", "status")


@query("package_states", "select 'package_broken_state' as subtype, 'low' as severity, count(*) as n from part where p_size % 5 = 0 having count(*) > 0")
def package_states(spark, sf_dir):
    """SW-06, SW-07, SW-09 over packages of a status file, none of which is on a list."""
    return H.package_findings(H.dpkg_paragraphs(_rows(spark, sf_dir, "part", _STATUS))).groupBy("subtype", "severity").agg(F.count("*").alias("n"))


@query("rpm_packages", "select p_name as name, cast(p_size as varchar) as version, p_brand as arch, p_type as section from part")
def rpm_packages(spark, sf_dir):
    """SW-05."""
    return H.rpm(_rows(spark, sf_dir, "part", "concat_ws('\\t', p_name, p_size, p_brand, p_type)")).select("name", "version", "arch", "section")


@query("cron_entries", "select o_orderkey % 60 || ' ' || o_custkey % 24 || ' * * 1' as schedule, o_orderkey % 60 || ' ' || o_custkey % 24 || ' * * 1 root /bin/run ' || o_orderkey as line from orders where o_orderkey % 4 = 3")
def cron_entries(spark, sf_dir):
    """SW-17."""
    line = "case o_orderkey % 4 when 0 then '# c' when 1 then 'MAILTO=x' when 2 then '1 2 3' else concat(' ', o_orderkey % 60, ' ', o_custkey % 24, ' * * 1 root /bin/run ', o_orderkey, ' ') end"
    return H.crontab(_rows(spark, sf_dir, "orders", line)).select("schedule", "line")


@query("autostart_entries", "select '/opt/' || s_name as exec from supplier where s_suppkey % 3 <> 0")
def autostart_entries(spark, sf_dir):
    """SW-18."""
    return H.autostart(_rows(spark, sf_dir, "supplier", "concat('[Desktop Entry]\\nName=x\\n', if(s_suppkey % 3 <> 0, concat('Exec = /opt/', s_name, '\\n'), ''), 'Type=Application')")).select("exec")


@query("rc_local_files", "select cast(s_suppkey as varchar) as location from supplier where s_suppkey % 3 = 1")
def rc_local_files(spark, sf_dir):
    """SW-18: files that do more than end."""
    return H.rc_local(_rows(spark, sf_dir, "supplier", "concat('#!/bin/sh\\n', if(s_suppkey % 3 = 1, 'mount x\\n', ''), 'exit 0\\n')", "cast(s_suppkey as string)")).select("location")


# --- hardware, security ----------------------------------------------------------------------------------------------


@query("cpu_models", "select cast(s_suppkey as varchar) as path, 'Model ' || s_nationkey as model, cast(1 + s_suppkey % 4 as bigint) as cores from supplier")
def cpu_models(spark, sf_dir):
    """HW-01: lines of many hosts at once."""
    s = _t(spark, sf_dir, "supplier")
    core = F.expr("explode(flatten(transform(sequence(0, cast(s_suppkey % 4 as int)), i -> array(concat('processor\\t: ', i), concat('model name\\t: Model ', s_nationkey, ' ')))))")
    return H.cpuinfo(s.select(F.col("s_suppkey").cast("string").alias("path"), core.alias("value")))


@query("memory_sizes", "select cast(s_suppkey as varchar) as path, round((s_suppkey % 64 + 1) * 1000000 / 1048576, 1) as total_gb, round((s_suppkey % 64 + 1) * 500000 / 1048576, 1) as available_gb from supplier")
def memory_sizes(spark, sf_dir):
    """HW-02."""
    s = _t(spark, sf_dir, "supplier")
    line = F.expr("explode(array(concat('MemTotal:   ', (s_suppkey % 64 + 1) * 1000000, ' kB'), concat('MemAvailable: ', (s_suppkey % 64 + 1) * 500000, ' kB'), 'Cached: 1 kB'))")
    return H.meminfo(s.select(F.col("s_suppkey").cast("string").alias("path"), line.alias("value")))


@query("mounted_devices", "select '/dev/sd' || s_suppkey as device, '/mnt/' || s_suppkey as mountpoint, 'ext4' as fstype from supplier where s_suppkey % 4 = 0")
def mounted_devices(spark, sf_dir):
    """HW-03: devices with files of their own."""
    line = "case s_suppkey % 4 when 0 then concat('/dev/sd', s_suppkey, ' /mnt/', s_suppkey, ' ext4 rw 0 0') when 1 then 'proc /proc proc rw 0 0' when 2 then concat('/dev/loop', s_suppkey, ' /snap squashfs ro 0 0') else 'short' end"
    return H.mounts(_rows(spark, sf_dir, "supplier", line)).select("device", "mountpoint", "fstype")


@query("usb_devices", "select case when s_suppkey % 3 = 0 then 'medium' else 'clean' end as severity, count(*) as n from supplier group by 1")
def usb_devices(spark, sf_dir):
    """HW-04."""
    d = _t(spark, sf_dir, "supplier").selectExpr("if(s_suppkey % 3 = 0, concat(s_name, ' Rubber DUCKY'), s_name) as label")
    return H.usb_findings(d).groupBy("severity").agg(F.count("*").alias("n"))


@query("pci_names", "select s_suppkey, case when s_nationkey < 5 then 'Maker ' || s_nationkey end as vendor_name from supplier")
def pci_names(spark, sf_dir):
    """HW-05, HW-09: a registry of five makers, written in another form."""
    registry = spark.createDataFrame([(f"0x000{i}", f"00:0{i}", f"Maker {i}") for i in range(5)], "vendor_id string, device_id string, vendor_name string")
    s = _t(spark, sf_dir, "supplier").selectExpr("s_suppkey", "lpad(cast(s_nationkey as string), 4, '0') as v", "lpad(cast(s_nationkey as string), 4, '0') as d")
    return intel.device_names(s, "v", "d", registry, "device_id").select("s_suppkey", "vendor_name")


@query("cpu_vulnerabilities", "select case s_suppkey % 3 when 0 then 'high' when 1 then 'info' else 'clean' end as severity, case s_suppkey % 2 when 0 then 'CVE-2017-5754' end as cve_id, count(*) as n from supplier group by 1, 2")
def cpu_vulnerabilities(spark, sf_dir):
    """HW-06, HW-10."""
    rows = _rows(spark, sf_dir, "supplier", "case s_suppkey % 3 when 0 then 'Vulnerable: x' when 1 then 'Mitigation: PTI' else 'Not affected' end", "concat('/h', s_suppkey, '/', if(s_suppkey % 2 = 0, 'meltdown', 'srbds'))")
    return H.cpu_vulnerability_findings(rows).select("severity", F.col("evidence")["cve_id"].alias("cve_id")).groupBy("severity", "cve_id").agg(F.count("*").alias("n"))


@query("firmware_state", "select * from (values ('tpm_status', 'clean', '2.0'), ('secure_boot_status', 'low', 'off')) t(subtype, severity, detail)")
def firmware_state(spark, sf_dir):
    """HW-07."""
    return H.tpm_and_secure_boot(["2.0"], 0, spark).select("subtype", "severity", "detail")


@query("disk_encryption", "select case when count(*) filter (s_suppkey % 4 = 0) > 0 then 'clean' else 'low' end as severity, count(*) filter (s_suppkey % 4 = 0) || ' encrypted devices' as detail from supplier")
def disk_encryption(spark, sf_dir):
    """HW-08."""
    return H.disk_encryption(_t(spark, sf_dir, "supplier").selectExpr("s_name as name", "if(s_suppkey % 4 = 0, concat('CRYPT-LUKS2-', s_suppkey), '') as uuid")).select("severity", "detail")


_MODES = "(select c_custkey, [493, 420, 384, 438, 448][1 + c_custkey % 5] as mode, ['.ssh', 'id_rsa', 'authorized_keys', 'config', 'known_hosts'][1 + c_custkey // 5 % 5] as base from customer)"


@query("ssh_audit", f"""select subtype, severity, count(*) as n from (select case when base = '.ssh' and mode & 63 <> 0 then 'ssh_dir_permissions' when base = 'id_rsa' then 'ssh_private_key' when base = 'config' and mode & 18 <> 0 then 'ssh_config_permissions'
  when base = 'authorized_keys' and mode & 18 <> 0 then 'ssh_authorized_keys_permissions' end as subtype, case when base = 'id_rsa' then case when mode & 63 <> 0 then 'high' else 'info' end when base = 'authorized_keys' then 'high' else 'medium' end as severity from {_MODES}) where subtype is not null group by all""")
def ssh_audit(spark, sf_dir):
    """SEC-01."""
    base = "element_at(array('.ssh', 'id_rsa', 'authorized_keys', 'config', 'known_hosts'), cast(1 + floor(c_custkey / 5) % 5 as int))"
    perms = _t(spark, sf_dir, "customer").selectExpr(f"concat('/home/', c_custkey, '/', {base}) as path", "cast(element_at(array(493, 420, 384, 438, 448), cast(1 + c_custkey % 5 as int)) as bigint) as mode", f"{base} = '.ssh' as is_dir")
    return H.ssh_findings(perms).groupBy("subtype", "severity").agg(F.count("*").alias("n"))


@query("authorized_keys", "select case when c_custkey % 2 = 0 then 'ssh-ed25519' else 'ecdsa-sha2-nistp256' end as key_type, 'user' || c_custkey || '@host' as comment from customer where c_custkey % 3 <> 0")
def authorized_keys(spark, sf_dir):
    """SEC-01: kinds and comments, behind options too, never the key."""
    line = "if(c_custkey % 3 = 0, '# none', concat(if(c_custkey % 5 = 0, 'no-pty ', ''), if(c_custkey % 2 = 0, 'ssh-ed25519', 'ecdsa-sha2-nistp256'), ' AAAA', c_custkey, ' user', c_custkey, '@host'))"
    return H.authorized_keys(_rows(spark, sf_dir, "customer", line)).select("key_type", "comment")


@query("suid_programs", "select case when c_custkey % 3 = 0 then 'info' else 'low' end as severity, count(*) as n from customer where c_custkey % 2 = 0 group by 1")
def suid_programs(spark, sf_dir):
    """SEC-02."""
    perms = _t(spark, sf_dir, "customer").selectExpr("concat('/usr/bin/', if(c_custkey % 3 = 0, 'sudo', concat('x', c_custkey))) as path", "cast(if(c_custkey % 2 = 0, if(c_custkey % 4 = 0, 35309, 34285), 33261) as bigint) as mode", "false as is_dir")
    return H.suid_findings(perms).groupBy("severity").agg(F.count("*").alias("n"))


@query("credential_files", "select case c_custkey % 4 when 0 then 'credential_file_aws_credentials' else 'credential_file_netrc' end as subtype, count(*) as n from customer where c_custkey % 4 in (0, 1) group by 1")
def credential_files(spark, sf_dir):
    """SEC-03: by path alone."""
    p = _t(spark, sf_dir, "customer").selectExpr("concat('/home/', c_custkey, case c_custkey % 4 when 0 then '/.aws/credentials' when 1 then '/.netrc' when 2 then '/x.netrc' else '/notes' end) as path")
    return H.credential_findings(p).groupBy("subtype").agg(F.count("*").alias("n"))


# --- files -----------------------------------------------------------------------------------------------------------


def _made(df: DataFrame, make) -> DataFrame:
    """(path, length, content) of files that ``make`` builds from the rows of (path, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [make(items) for items in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(c) for c in out], pa.int64()), pa.array(out, pa.binary())], names=["path", "length", "content"])

    return df.select("path", "items").mapInArrow(run, "path string, length long, content binary")


def _database(statements: list[str]):
    def make(rows: list[dict]) -> bytes:
        con = sqlite3.connect(":memory:")
        for s in statements:
            con.execute(s)
        for r in rows:
            con.execute(f"insert into {r['into']} values ({', '.join('?' * (len(r) - 1))})", [v for k, v in r.items() if k != "into"])
        con.commit()
        got = con.serialize()
        con.close()
        return got

    return make


def _grouped(rows: DataFrame) -> DataFrame:
    """(path, items) of (path, r), in a fixed order: a file made again is the same file."""
    return rows.groupBy("path").agg(F.sort_array(F.collect_list("r")).alias("items"))


def _places(spark, sf_dir) -> DataFrame:
    p = _t(spark, sf_dir, "pages").selectExpr("cast(page_id div 200 as string) as path", "struct('moz_places' as into, page_id as id, url, html as title, page_id % 9 as visit_count) as r")
    return _made(_grouped(p), _database(["create table moz_places(id integer primary key, url text, title text, visit_count integer)", "create table moz_bookmarks(fk integer, title text)"]))


@query("sqlite_rows", "select cast(page_id // 200 as varchar) as path, page_id, md5(html) as html from pages")
def sqlite_rows(spark, sf_dir):
    """SRC-09: databases made of pages, with long values, read back."""
    get = lambda c: F.get_json_object("data", f"$.{c}")
    return sqlite_source.read_table(_places(spark, sf_dir), "MOZ_places").select("path", get("id").cast("long").alias("page_id"), F.md5(get("title")).alias("html"))


@query("firefox_visits", "select url, cast(page_id % 9 as bigint) as visit_count from pages")
def firefox_visits(spark, sf_dir):
    """SW-12 without a limit of rows."""
    return sqlite_source.firefox_history(_places(spark, sf_dir), max_rows=None)[0].select("url", "visit_count")


@query("chromium_visits", "select url, cast(page_id as bigint) as visit_count from pages")
def chromium_visits(spark, sf_dir):
    """SW-13 without a limit of rows."""
    p = _t(spark, sf_dir, "pages").selectExpr("cast(page_id div 300 as string) as path", "struct('urls' as into, url, 't' as title, page_id as visit_count) as r")
    made = _made(_grouped(p), _database(["create table urls(url text, title text, visit_count integer)"]))
    return sqlite_source.chromium_history(made, max_rows=None).select("url", "visit_count")


def _pdf(text: str) -> bytes:
    body = " ".join(text.split()).encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    return b"%PDF-1.4\n1 0 obj <</Filter /FlateDecode>>\nstream\n" + zlib.compress(b"BT (" + body + b") Tj ET") + b"\nendstream\n%%EOF"


def _docx(text: str) -> bytes:
    from xml.sax.saxutils import escape

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="u"><w:p><w:r><w:t>{escape(text)}</w:t></w:r></w:p></w:document>')
    return out.getvalue()


_FLATTED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def _extracted(spark, sf_dir, make) -> DataFrame:
    b = _t(spark, sf_dir, "benchmark").selectExpr("cast(item_id as string) as path", "text as items")
    return files.with_text(_made(b, make)).select("path", "text_status", F.md5(F.trim(F.regexp_replace("text", "\\s+", " "))).alias("text"))


@query("pdf_texts", f"select cast(item_id as varchar) as path, 'extracted' as text_status, md5({_FLATTED}) as text from benchmark")
def pdf_texts(spark, sf_dir):
    """SRC-06: PDF files made of the benchmark's texts."""
    return _extracted(spark, sf_dir, _pdf)


@query("ooxml_texts", f"select cast(item_id as varchar) as path, 'extracted' as text_status, md5({_FLATTED}) as text from benchmark")
def ooxml_texts(spark, sf_dir):
    """SRC-07: documents made of the benchmark's texts."""
    return _extracted(spark, sf_dir, _docx)


@query("extraction_states", "select 'extraction_no_text' as subtype, count(*) as n from benchmark where item_id % 2 = 0 having count(*) > 0")
def extraction_states(spark, sf_dir):
    """SRC-08: every other PDF file has no text."""
    b = _t(spark, sf_dir, "benchmark").selectExpr("cast(item_id as string) as path", "if(item_id % 2 = 0, '', text) as items")
    return files.extraction_findings(files.with_text(_made(b, _pdf))).groupBy("subtype").agg(F.count("*").alias("n"))


# --- searches, dictionaries, cracking, streams -------------------------------------------------------------------------


@query("search_severity", "select 'custom_term_search' as subtype, 'medium' as severity, cast(sum(len(regexp_extract_all(text, '(?i)licensed under'))) as bigint) as n from documents having sum(len(regexp_extract_all(text, '(?i)licensed under'))) > 0")
def search_severity(spark, sf_dir):
    """SEA-04."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_scan.search_findings(d, "doc_id", "text", terms=[{"term": "licensed under"}]).groupBy("subtype", "severity").agg(F.count("*").alias("n"))


@query("auto_gloss", "select id, 'en' as language, tokens, found, coverage, rough from (" + ORACLES_OF_CORE["dictionary_gloss"] + ") where coverage >= 10")
def auto_gloss(spark, sf_dir):
    """LNG-10, LNG-11: conversations glossed by the benchmark's words rather than by a dictionary of another script."""
    c = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    other = spark.createDataFrame([("\u5929", "sky")], "text string, definition string")
    return language.auto_gloss(c, "id", "text", {"en": _dictionary(spark, sf_dir), "zh": other}, floor=10.0)


@query("cjk_segments", f"select p_partkey, case p_partkey % 3 when 0 then ['天地', '人'] when 1 then ['人', '山水火'] else ['x', '天地', '天地'] end as parts from part")
def cjk_segments(spark, sf_dir):
    """LNG-08: the longest known word at each place, else one character."""
    t = F.expr("case p_partkey % 3 when 0 then '天地人' when 1 then '人山水火' else 'x天地天地' end")
    return _t(spark, sf_dir, "part").select("p_partkey", language.segment_cjk(t, ["天地", "山水", "山水火", "地人"]).alias("parts"))


def _letters(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def _known(spark, sf_dir) -> crack.LanguageData:
    """Words of four letters or more of the benchmark: the list is what makes a transposition plausible."""
    b = _t(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,12}"), F.lit(0))).alias("w"))
    return crack.LanguageData(WordList.of_table(b, "w"))


_SIGNS = {m: "".join(C.SYMBOLS[m]["standard"]) for m in ("wingdings", "arrow", "simple_symbols", "symbol_lookalikes", "emoticons")}


@query("symbol_ciphers", "select item_id, " + ", ".join(f"md5(translate(text, '{_AZ}', '{s + s}')) as {m}" for m, s in _SIGNS.items()) + " from benchmark")
def symbol_ciphers(spark, sf_dir):
    """CIP-28..31, CIP-33: the benchmark's texts in signs."""
    return _t(spark, sf_dir, "benchmark").select("item_id", *[F.md5(C.cipher_column(F.col("text"), m)["text"]).alias(m) for m in _SIGNS])


@query("crack_transpositions")
def crack_transpositions(spark, sf_dir):
    """CRK-11..15: the benchmark's texts under a rail fence, a scytale or by columns, found with its own words as the list."""
    t = F.col("text")
    coded = F.when(F.col("item_id") % 3 == 0, N.railfence(t, 3)).when(F.col("item_id") % 3 == 1, N.scytale(t, 5)).otherwise(N.columnar(t, "ZEBRA"))
    # a projection of its own: Spark can't hand Python what higher-order functions are still to make
    b = _t(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(F.array(coded)).alias("coded"))
    got = b.select("item_id", "text", crack.crack_column(F.col("coded"), _known(spark, sf_dir)).alias("r"))
    return got.select("item_id", "r.method", "r.key", F.startswith("r.plaintext", _letters(F.col("text"))).alias("right"))


@query("crack_polyalphabetic")
def crack_polyalphabetic(spark, sf_dir):
    """CRK-07..09: the benchmark's texts, three times over, under Vigenere's or Beaufort's cipher alone."""
    t = F.repeat("text", F.lit(3))
    b = _t(spark, sf_dir, "benchmark")
    return b.select("item_id", crack.only_column(N.vigenere(t, "LEMON"), "vigenere").alias("v"), crack.only_column(N.beaufort(t, "SECRET"), "beaufort").alias("b")).select(
        "item_id", F.col("v.key").alias("vigenere_key"), F.col("b.key").alias("beaufort_key"), F.round("v.confidence", 6).alias("vigenere_confidence"), F.round("b.confidence", 6).alias("beaufort_confidence")
    )


@query("stream_windows", "select cast(time_bucket(interval '10 minutes', ts) as timestamp) as start, case user_id % 3 when 0 then 'low' when 1 then 'high' else 'info' end as severity, count(*) as n from events group by all")
def stream_windows(spark, sf_dir):
    """The streaming counts by ten-minute window, over events as they would arrive."""
    e = _t(spark, sf_dir, "events").selectExpr("cast(ts as timestamp) as seen_at", "case user_id % 3 when 0 then 'low' when 1 then 'high' else 'info' end as severity")
    return stream.severity_counts(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "severity", "n")


@query("scan_categories", f"""with f as (select 'network' as category, 'hosts_entry' as subtype, case when ip = '127.0.0.1' then 'low' else 'info' end as severity from ({_HOSTS_SQL})
  union all select 'software', 'local_user_account', case when uid = 0 and username <> 'root' then 'critical' when uid < 1000 and uid <> 0 and shell = '/bin/sh' then 'low' else 'info' end from {_USERS}
  union all select 'storage', 'suid_sgid_binary', 'low' from customer where c_custkey % 2 = 0)
  select category, subtype, severity, count(*) as n from f group by all""")
def scan_categories(spark, sf_dir):
    """FIL-05: one scan over captured files of many hosts and their permissions, hardware left out."""
    captured = _rows(spark, sf_dir, "customer", _HOSTS, "concat('/h', c_custkey, '/etc/hosts')").unionByName(_rows(spark, sf_dir, "customer", _PASSWD, "concat('/h', c_custkey, '/etc/passwd')"))
    perms = _t(spark, sf_dir, "customer").selectExpr("concat('/h/bin/x', c_custkey) as path", "cast(if(c_custkey % 2 = 0, 35309, 33261) as bigint) as mode", "false as is_dir")
    found = scans.scan_all(spark, captured=captured, perms=perms, categories=["files", "network", "software"])
    return found.groupBy("category", "subtype", "severity").agg(F.count("*").alias("n"))


#: Path and text of a captured file of each kind, and the findings that it gives.
_FILES = [
    ("/etc/hosts", "127.0.0.1 localhost\\n127.0.0.1 shop.example.com", [("network", "hosts_entry", "info"), ("network", "hosts_entry", "low")]),
    ("/etc/resolv.conf", "nameserver 9.9.9.9\\nnameserver 8.8.8.8", [("network", "dns_resolvers", "info")]),
    ("/proc/net/tcp", " 0: 0100007F:1F90 00000000:0000 0A 0:0 0:0 0 7 0 1", [("network", "listening_port", "info")]),
    ("/proc/net/tcp6", " 0: 00000000000000000000000001000000:0016 0:0 0A 0:0 0:0 0 0 0 1\\n 1: 00000000000000000000000001000000:0017 0:0 01 0:0 0:0 0 0 0 1", [("network", "listening_port", "info")]),
    ("/x.nmconnection", "[wifi]\\nssid=home\\n[wifi-security]\\nkey-mgmt=wpa-psk\\npsk=secret", [("network", "wifi_profile", "medium")]),
    ("/etc/nftables.conf", "table x {\\n}", [("network", "firewall_ruleset", "info")]),
    ("/etc/os-release", 'ID=x\\nPRETTY_NAME="A=B 12"', [("software", "os_identity", "info")]),
    ("/etc/passwd", "root:x:0:0::/root:/bin/sh\\nroot2:x:0:0::/root:/bin/sh", [("software", "local_user_account", "info"), ("software", "local_user_account", "critical")]),
    ("/var/lib/dpkg/status", "Package: zzqqx\\nStatus: install ok half-installed\\n\\nPackage: zzqqy\\nStatus: install ok installed", [("software", "package_broken_state", "low")]),
    ("/etc/cron.d/job", "X=1\\n* * * * * root run", [("software", "persistence_cron_entry", "clean")]),
    ("/var/spool/cron/crontabs/bob", "* * * * * run\\n# no", [("software", "persistence_cron_entry", "clean")]),
    ("/etc/cron.daily/clean", "#!/bin/sh", [("software", "persistence_cron_periodic", "clean")]),
    ("/etc/systemd/system/multi-user.target.wants/a.service", "[Unit]", [("software", "persistence_systemd_unit", "clean")]),
    ("/home/b/.config/autostart/a.desktop", "[Desktop Entry]\\nExec=a --b", [("software", "persistence_autostart", "clean")]),
    ("/etc/rc.local", "#!/bin/sh\\nrun\\nexit 0", [("software", "persistence_rc_local", "low")]),
    ("/sys/devices/system/cpu/vulnerabilities/spectre_v2", "Vulnerable", [("hardware", "hw_cpu_vulnerability", "high")]),
    ("/sys/devices/system/cpu/vulnerabilities/l1tf", "Mitigation: x", [("hardware", "hw_cpu_vulnerability", "info")]),
    ("/proc/cpuinfo", "processor : 0\\nmodel name : M", [("hardware", "cpu", "info")]),
    ("/proc/meminfo", "MemTotal: 1048576 kB", [("hardware", "memory", "info")]),
    ("/proc/mounts", "/dev/sda1 / ext4 rw\\nproc /proc proc rw", [("hardware", "storage_volume", "info")]),
    ("/sys/bus/usb/devices/1-1/product", "USB Rubber Ducky", [("hardware", "usb_device", "medium")]),
    ("/sys/class/tpm/tpm0/tpm_version_major", "2", [("hardware", "tpm_status", "clean")]),
    ("/sys/firmware/efi/efivars/SecureBoot-1", "x0", [("hardware", "secure_boot_status", "low")]),
    ("/sys/block/dm-0/dm/uuid", "CRYPT-LUKS2-1", [("hardware", "disk_encryption", "clean")]),
    ("/etc/unknown", "x", []),
]


@query("captured_files", f"""with k as (select s_suppkey % {len(_FILES)} as k from supplier), f(k, category, subtype, severity) as (values {', '.join(f"({i}, '{c}', '{s}', '{v}')" for i, (_, _, fs) in enumerate(_FILES) for c, s, v in fs)})
  select category, subtype, severity, count(*) as n from k join f using (k) group by all""")
def captured_files(spark, sf_dir):
    """FIL-05: one scan over captured files of every kind that has a parser, of many hosts."""
    pick = lambda i: "element_at(array(" + ", ".join(f"'{f[i]}'" for f in _FILES) + f"), cast(s_suppkey % {len(_FILES)} as int) + 1)"
    found = scans.scan_captured(_rows(spark, sf_dir, "supplier", pick(1), f"concat('/h', s_suppkey, {pick(0)})"))
    return found.groupBy("category", "subtype", "severity").agg(F.count("*").alias("n"))


@query("interface_states", "select name, case when up and n = 0 then 'info' else 'clean' end as severity, vendor, case when n > 0 then case when s_suppkey % 2 = 0 then 'loopback,private' else 'private' end else '' end as scopes from (select s_suppkey, 'eth' || s_suppkey as name, s_suppkey % 3 <> 0 as up, case when s_suppkey % 4 = 0 then 0 else 1 end as n, case when s_suppkey % 5 = 0 then 'Acme' end as vendor from supplier)")
def interface_states(spark, sf_dir):
    """NET-03: vendors and classes of addresses."""
    rows = _t(spark, sf_dir, "supplier").selectExpr(
        "concat('eth', s_suppkey) as name", "concat(if(s_suppkey % 5 = 0, 'aa:bb:cc', '00:11:22'), ':00:00:01') as mac", "s_suppkey % 3 <> 0 as up",
        "case when s_suppkey % 4 = 0 then array() when s_suppkey % 2 = 0 then array('10.0.0.1', '127.0.0.1') else array('10.0.0.1') end as addresses",
    )
    got = H.interface_findings(rows, spark.createDataFrame([("AABBCC", "Acme")], "prefix string, vendor string"))
    return got.select(F.col("location").alias("name"), "severity", F.col("evidence")["vendor"].alias("vendor"), F.col("evidence")["scopes"].alias("scopes"))


_LIST = "(select 'Entry ' || p_partkey as entry, lower(left(p_name, 9)) as k from part where p_partkey % 20 = 0)"


@query("long_list_theta", f"select p_partkey, entry from part join {_LIST} on contains(lower(p_name), k) or contains(k, lower(p_name))")
def long_list_theta(spark, sf_dir):
    """SW-07..09 with a list that is a table: names of parts that contain an entry, or lie within one."""
    p = _t(spark, sf_dir, "part")
    entries = p.where("p_partkey % 20 = 0").selectExpr("concat('Entry ', p_partkey) as entry", "lower(left(p_name, 9)) as k")
    # the table is one small file, but its matches grow with its square: they are dealt to many tasks, by name so that each makes rows of few entries
    names = p.select("p_partkey", "p_name").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_name", "p_partkey")
    return long_lists.match_table(names, "p_name", entries, "k", columns=("p_partkey", "entry"))


@query("analyze_glossed")
def analyze_glossed(spark, sf_dir):
    """LNG-12: analyses of conversations with a gloss by the benchmark's words."""
    c = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    got = crack.analyze(c, "id", "text", dictionaries={"en": _dictionary(spark, sf_dir)})
    return got.select("id", "language", "gloss_language", "coverage", F.md5("gloss").alias("gloss"))
