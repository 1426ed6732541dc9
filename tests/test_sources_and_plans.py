"""Files, captured host state, the scan, the report, streams and the command line."""

import io
import json
import sqlite3
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lumentrace import cli
from lumentrace.operators import report
from lumentrace.plans import scan as scans
from lumentrace.sources import files as sources
from lumentrace.sources import hostfiles as H
from lumentrace.sources import sqlite_source
from lumentrace.streaming import stream


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="u"><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:document>')
    return out.getvalue()


@pytest.fixture()
def folder(tmp_path):
    body = zlib.compress(b"BT (Contact bob@example.org about the \\(old\\) contract please) Tj <48692074686572652c20667269656e64> Tj ET")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj <</Filter /FlateDecode>>\nstream\n" + body + b"\nendstream")
    (tmp_path / "b.docx").write_bytes(docx("Her card is 4111 1111 1111 1111 and that is all there is"))
    (tmp_path / "c.png").write_bytes(b"MZ not a picture, and no text " + bytes(range(256)))
    (tmp_path / ".hidden.txt").write_text("the house by the river is where they were at the end of it all")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "clean.txt").write_text("the people of the town were at the river and they had their children with them")
    (tmp_path / "empty.txt").write_bytes(b"")
    return tmp_path


def test_extraction():
    assert "(old) contract" in sources.pdf_text(b"%PDF-1.4 <</Filter/FlateDecode>>\nstream\n" + zlib.compress(b"(the \\(old\\) contract)") + b"\nendstream")
    assert sources.pdf_text(b"no") is None and sources.ooxml_text(b"PK\x03\x04bad") is None and sources.ooxml_text(docx("hi")) == "hi\n"


def test_scan_files(spark, folder):
    found = scans.scan_files(spark, str(folder)).collect()
    by = {(r.location.rsplit("/", 1)[-1], r.subtype) for r in found}
    assert {("a.pdf", "pii_email"), ("b.docx", "pii_credit_card"), ("c.png", "file_signature_mismatch"), (".hidden.txt", "hidden_file"), ("clean.txt", "clean_file"), ("empty.txt", "clean_file")} <= by
    assert not any(n == "a.pdf" and s == "clean_file" for n, s in by)
    kept = report.filter_checks(spark.createDataFrame([(r.category, r.subtype, r.severity) for r in found], "category string, subtype string, severity string"), {"files": ["pii"]})
    assert all(r.subtype.startswith("pii_") or r.subtype == "clean_file" for r in kept.collect())


def test_report(spark):
    f = spark.createDataFrame([("storage", "pii_x", "high"), ("storage", "clean_file", "clean"), ("network", "interface", "odd")], "category string, subtype string, severity string")
    assert {r.severity: r.n for r in report.by_severity(f).collect()} == {"clean": 1, "info": 0, "low": 0, "medium": 0, "high": 1, "critical": 0}
    assert {r.category: (r.n, r.flagged) for r in report.by_category(f).collect()}["storage"] == (2, 1)
    s = report.summary(f).first()
    assert (s.total_findings, s.flagged_findings, s.highest_rank) == (3, 1, 3)
    assert report.summary(f.limit(0)).first().highest_rank == 0 and report.checks(spark).count() == 32


def test_command_line(spark, folder, tmp_path):
    out = tmp_path / "out"
    assert cli.main(["--target", str(folder), "--output", str(out), "--min-severity", "high"]) == 0
    rows = [json.loads(x) for p in (out / "findings").glob("*.json") for x in p.read_text().splitlines()]
    assert rows and {r["severity"] for r in rows} <= {"high", "critical"}


def test_sqlite(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "places.sqlite")
    con.execute("create table moz_places(id integer primary key, url text, title text, visit_count integer)")
    con.execute("create table moz_bookmarks(fk integer, title text)")
    con.executemany("insert into moz_places values (?, ?, ?, ?)", [(i, f"https://h{i % 3}.example/{i}", "t" * 5000 if i == 7 else "t", i) for i in range(1, 301)])
    con.execute("insert into moz_bookmarks values (7, null)")
    con.commit()
    con.close()
    (tmp_path / "junk.sqlite").write_bytes(b"SQLite format 3\0junk")
    files = sources.read_files(spark, str(tmp_path))
    places, marks = sqlite_source.firefox_history(files)
    assert places.count() == 300 and len(marks.first().title) == 5000
    assert sqlite_source.read_table(files, "MOZ_PLACES", max_rows=10).count() == 10 and sqlite_source.read_table(files, "absent").count() == 0


def lines(spark, text, path="f"):
    return spark.createDataFrame([(path, x) for x in text.split("\n")], "path string, value string")


def whole(spark, text, path="f"):
    return spark.createDataFrame([(path, text)], "path string, value string")


def test_host_files(spark, tmp_path):
    e = H.hosts(lines(spark, "127.0.0.1 localhost # c\n# x\n0.0.0.0 bank.example.com ads.example.com\n"))
    assert e.count() == 3 and {r.severity for r in H.hosts_findings(e).collect()} == {"info", "low"}
    assert [r.server for r in H.resolvers(lines(spark, "nameserver 1.1.1.1\nnameserver a b\nsearch x")).collect()] == ["1.1.1.1"]
    assert [r.server for r in H.ipconfig_resolvers(whole(spark, "   DNS Servers . . . : 8.8.8.8\n        1.1.1.1\n   Other: x")).collect()] == ["8.8.8.8", "1.1.1.1"]
    s = H.listening(lines(spark, "  sl  local\n   0: 0100007F:1F90 00000000:0000 0A 0:0 0:0 0 1000 0 1\n   1: 0100007F:1F91 00000000:0000 01 0:0 0:0 0 0 0 1")).collect()
    assert [(r.local_addr, r.local_port, r.uid, r.scope) for r in s] == [("127.0.0.1", 8080, 1000, "loopback")]
    w = H.wifi(whole(spark, "[wifi]\nssid=Home\n[wifi-security]\nkey-mgmt=wpa-psk\npsk=secret\n"))
    assert [r.severity for r in H.wifi_findings(w).collect()] == ["medium"] and "secret" not in str(w.collect())
    assert H.firewall(whole(spark, "# c\ntable x\n\nchain y")).first().rules == 2
    assert H.os_release(lines(spark, 'NAME=x\nPRETTY_NAME="Some OS 1"')).first().name == "Some OS 1"
    u = H.user_findings(H.passwd(lines(spark, "root:x:0:0:r:/root:/bin/bash\ntoor:x:0:0::/:/bin/sh\nbin:x:1:1::/:/usr/sbin/nologin\nsvc:x:9:9::/:/bin/sh\nann:x:1000:1000::/h:/bin/sh\nbad")))
    assert {r.detail: r.severity for r in u.collect()} == {"root": "info", "toor": "critical", "bin": "info", "svc": "low", "ann": "info"}
    (tmp_path / "status").write_text("Package: vim\nStatus: install ok installed\nVersion: 9\n\nPackage: TunnelToad\nStatus: deinstall ok config-files\nVersion: 1\n")
    p = H.dpkg(spark, str(tmp_path / "status"))
    assert p.count() == 2 and {r.subtype for r in H.package_findings(p).collect()} == {"package_broken_state", "package_blacklisted"}
    assert H.rpm(lines(spark, "a\t1\tx\tg")).first().version == "1"
    c = H.crontab(lines(spark, "# c\nSHELL=/bin/sh\n1 2 * * * root /bin/x y\nbad"))
    assert [(r.schedule, r.line) for r in c.collect()] == [("1 2 * * *", "1 2 * * * root /bin/x y")]
    assert H.autostart(whole(spark, "[Desktop Entry]\nExec=/bin/a b\n")).first()["exec"] == "/bin/a b"
    assert H.rc_local(whole(spark, "#!/bin/sh\nexit 0\n")).count() == 0 and H.rc_local(whole(spark, "#!/bin/sh\nfoo\nexit 0")).count() == 1
    assert tuple(H.cpuinfo(lines(spark, "processor\t: 0\nmodel name\t: X 1\nprocessor\t: 1")).first()) == ("f", "X 1", 2)
    assert H.meminfo(lines(spark, "MemTotal: 16777216 kB\nMemAvailable: 8388608 kB")).first().total_gb == 16.0
    assert [r.mountpoint for r in H.mounts(lines(spark, "/dev/sda1 / ext4 rw 0 0\nproc /proc proc rw 0 0\n/dev/loop0 /s squashfs ro 0 0")).collect()] == ["/"]
    v = H.cpu_vulnerability_findings(spark.createDataFrame([("/x/meltdown", "Mitigation: PTI"), ("/x/l1tf", "Vulnerable"), ("/x/srbds", "Not affected")], "path string, value string"))
    assert {r.title.split()[-1]: r.severity for r in v.collect()} == {"meltdown": "info", "l1tf": "high", "srbds": "clean"}
    perms = spark.createDataFrame([("/h/.ssh", 0o40755, True), ("/h/.ssh/id_rsa", 0o100644, False), ("/h/.ssh/authorized_keys", 0o100666, False), ("/h/.ssh/known_hosts", 0o100644, False)], "path string, mode long, is_dir boolean")
    assert {r.subtype: r.severity for r in H.ssh_findings(perms).collect()} == {"ssh_dir_permissions": "medium", "ssh_private_key": "high", "ssh_authorized_keys_permissions": "high"}
    assert tuple(H.authorized_keys(lines(spark, "# c\nssh-ed25519 AAAA ann@host")).first())[1:] == ("ssh-ed25519", "ann@host")
    suid = spark.createDataFrame([("/usr/bin/sudo", 0o104755, False), ("/usr/bin/odd", 0o102755, False), ("/usr/bin/ls", 0o100755, False)], "path string, mode long, is_dir boolean")
    assert {r.detail: r.severity for r in H.suid_findings(suid).collect()} == {"sudo": "info", "odd": "low"}
    assert H.credential_findings(spark.createDataFrame([("/h/.aws/credentials",), ("/h/x",)], "path string")).first().subtype == "credential_file_aws_credentials"
    procs = spark.createDataFrame([(1, 0, None, "kthread x"), (2, 5, "/tmp/x (deleted)", "x"), (3, 0, "/bin/y", "y")], "pid long, uid int, exe string, cmdline string")
    assert {r.location: r.severity for r in H.process_findings(procs).collect()} == {"1": "low", "2": "medium", "3": "clean"}
    assert H.tpm_and_secure_boot([], 1, spark).count() == 2 and H.not_implemented(spark.createDataFrame([("h", "Windows"), ("l", "linux")], "host string, platform string"), [("network", "wifi_profiles_not_implemented")]).collect()[0].location == "h"
    assert H.interfaces(spark).columns == ["name", "mac", "up"] and H.permissions(spark, [str(tmp_path)]).count() >= 2


def test_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("mail bob@example.org and 10.0.0.1")
    q = stream.write_findings(stream.pii_stream(stream.read_text_stream(spark, src)), out, ck)
    q.awaitTermination(60)
    assert {r.rule_id for r in spark.read.json(out).collect()} == {"EMAIL", "IPV4"}
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "low"), ("2024-01-01 00:02:00", "low"), ("2024-01-01 00:11:00", "high")], "t string, severity string").select(F.to_timestamp("t").alias("seen_at"), "severity")
    assert sorted(r.n for r in stream.severity_counts(rows).collect()) == [1, 2]
