import hashlib
import ipaddress

import pytest
from pyspark.sql import functions as F

from duskwatch import config
from duskwatch.functions import columns as C
from duskwatch.operators import ecs, enrich, indicators, normalize, response, yara
from duskwatch.schema import TELEMETRY
from duskwatch.sources import indicators as ind
from tests.test_sigma import events


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "f,value,want",
    [
        (C.basename, '"C:\\a\\b".exe"', 'b".exe'),
        (C.basename, "C:\\a\\", None),
        (C.basename, "/x/y.z", "y.z"),
        (C.extension, "C:\\Users\\alice\\evil.ps1", "ps1"),
        (C.extension, "C:\\a.b\\file", None),
        (C.extension, "x.", None),
        (C.clean, "a\0b\0\0", "a\0b"),
        (C.clean, "\0", None),
        (C.parse_pid, "0x4D2", 1234),
        (C.parse_pid, " 12 ", 12),
        (C.parse_pid, "4294967296", None),
        (C.parse_pid, "-1", None),
        (C.parse_pid, "0xfffffffff", None),
        (C.truth, " SIGNED ", True),
        (C.truth, "maybe", None),
        (C.ip_text, "2001:DB8:0:0::1", "2001:db8::1"),
        (C.ip_text, "1.2.3.04", None),
        (C.ip_text, "1.2.3.4\n", None),
        (C.ip_text, "fe80::1%eth0", None),
        (C.addresses, "b 9.9.9.9;type: 1 1.1.1.1;1.1.1.1;300.1.1.1", ["1.1.1.1", "9.9.9.9"]),
        (lambda c: C.whole_number(c, 65535).cast("int"), "65536", None),
        (lambda c: C.whole_number(c, 65535).cast("int"), " 0080 ", 80),
        (lambda c: normalize.dos_path(c, {"\\Device\\HarddiskVolume1": "C:", "\\Device\\HarddiskVolume12": "D:"}), "\\device\\HarddiskVolume12\\x", "D:\\x"),
        (lambda c: normalize.dos_path(c, {"\\Device\\HarddiskVolume1": "C:"}), "\\Device\\HarddiskVolume12\\x", "\\Device\\HarddiskVolume12\\x"),
        (normalize.resolve_sid, "S-1-5-20", "NT AUTHORITY\\NETWORK SERVICE"),
        (normalize.resolve_sid, "S-1-5-21-9", "S-1-5-21-9"),
        (yara.device_free, "\\??\\C:\\a.exe", "C:\\a.exe"),
        (indicators.normal_host, " WWW.Example.COM.. ", "www.example.com"),
        (indicators.normal_host, "..", None),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, value, f) == want


def test_numbers(spark):
    assert one(spark, 0x1F90901F, C.port_swap, "long") == 0x1F90
    assert one(spark, 3232235777, C.ipv4_text, "long") == "192.168.1.1"
    assert one(spark, 0, C.filetime, "long") == "1970-01-01T00:00:00Z"
    assert one(spark, 133485408000000009, C.filetime, "long") == "2024-01-01T00:00:00Z"


@pytest.mark.parametrize(
    "user,want",
    [("NT AUTHORITY\\SYSTEM", ("SYSTEM", None, "NT AUTHORITY")), ("S-1-5-18", (None, "S-1-5-18", None)), ("bob", ("bob", None, None)), ("a\\b\\c", ("b\\c", None, "a")), ("", (None, None, None)), (None, (None, None, None))],
)
def test_users(spark, user, want):
    r = spark.createDataFrame([(user,)], "u string").select(*(v.alias(k) for k, v in C.user_parts(F.col("u")).items())).first()
    assert (r.name, r.id, r.domain) == want


@pytest.mark.parametrize(
    "path,kind,want",
    [
        ("HKLM\\Software\\Test\\Value", "SetValue", ("HKLM", "Software\\Test", "Value")),
        ("HKLM\\Software\\Test", "CreateKey", ("HKLM", "Software\\Test", None)),
        ("HKLM\\V", "SetValue", ("HKLM", None, "V")),
        ("HKLM", "SetValue", ("HKLM", None, None)),
        ("HKLM\\A", None, ("HKLM", "A", None)),
    ],
)
def test_registry_paths(spark, path, kind, want):
    r = spark.createDataFrame([(path, kind)], "p string, k string").select(*(v.alias(k) for k, v in C.registry_parts(F.col("p"), F.col("k")).items())).first()
    assert tuple(r) == want


@pytest.mark.parametrize("category,opcode,want", [("Process", 1, 1), ("Process", 2, 5), ("Process", 10, 7), ("ImageLoad", 10, 7), ("File", 65, 11), ("File", 72, 23), ("File", 66, 99), ("Registry", 41, 12), ("Registry", 39, 13), ("Registry", 7, 99), ("Network", 15, 3), ("Network", 13, 99), ("Dns", 0, 22), ("Wmi", 0, 19), ("Scripting", 3, 4104), ("Service", 0, 7045), ("Task", 0, 106)])
def test_event_ids(spark, category, opcode, want):
    df = spark.createDataFrame([(category, opcode, 99)], "category string, opcode int, event_id int")
    assert df.select(normalize.mapped_event_id()).first()[0] == want


RAW = "seq long, provider string, event_id int, opcode int, level int, keywords long, header_pid long, filetime long, props map<string,string>"


def test_normalization(spark):
    rows = [
        (1, "kernel-process", 1, 1, 4, 0x10, 77, 133485408000000000, {"ImageName": "\\Device\\HarddiskVolume1\\a.exe\0\0", "UserSID": "S-1-5-18", "CommandLine": "", "ParentProcessID": "4"}),
        (2, "kernel-process", 2, 2, 4, 0x10, 77, 0, {"ProcessID": "77"}),
        (3, "kernel-network", 12, 12, 4, 0x30, 5, 0, {"daddr": "16909060", "dport": "20480", "saddr": "fe80::1"}),
        (4, "kernel-network", 10, 10, 4, 0x30, 5, 0, {}),
        (5, "kernel-file", 64, 64, 4, 0x40, 5, 0, {"FileName": "x", "UserSID": "S-1-5-99"}),  # masked out
        (6, "kernel-file", 64, 64, 4, 0x80, 5, 0, {"FileName": "x", "UserSID": "S-1-5-99"}),
        (7, "kernel-registry", 39, 39, 5, 0xF000, 5, 0, {}),  # too chatty a level
        (8, "kernel-registry", 39, 39, 4, 0xF000, 5, 0, {"RelativeName": "rel", "KeyName": "", "ValueName": "v"}),
        (9, "mystery", 1, 1, 1, 0, 5, 0, {}),
        (10, "kernel-process", 7, 10, 4, 0x40, 5, 0, {"ImageName": "l.dll", "ParentImageName": "p.exe"}),
    ]
    got = {r.seq: r for r in normalize.normalize(spark.createDataFrame(rows, RAW), {"\\Device\\HarddiskVolume1": "C:"}).collect()}
    assert sorted(got) == [1, 3, 6, 8, 10]
    p = got[1]
    assert (p.Image, p.User, p.ProcessId, p.CommandLine, p.timestamp) == ("C:\\a.exe", "NT AUTHORITY\\SYSTEM", "77", None, "2024-01-01T00:00:00Z")
    assert (got[3].DestinationIp, got[3].DestinationPort, got[3].SourceIp, got[3].ProcessId, got[3].event_id) == ("1.2.3.4", "80", "fe80::1", "5", 3)
    assert (got[6].TargetFilename, got[6].ProcessId, got[8].TargetObject, got[8].Details) == ("x", None, "rel", "v")
    assert (got[10].category, got[10].ImageLoaded, got[10].Image) == ("ImageLoad", "l.dll", "p.exe")
    life = sorted((r.kind, r.pid or "") for r in normalize.lifecycle(spark.createDataFrame(rows, RAW)).collect())
    assert life == [("start", ""), ("stop", "77")] or life == [("start", "77"), ("stop", "77")]


def test_side_tables(spark):
    ev = events(spark, [{"Image": "C:\\A.EXE", "ProcessId": "5"}, {"Image": "C:\\b.exe", "Product": "own", "ProcessId": "6", "CommandLine": "mine"}])
    files = spark.createDataFrame([("c:\\a.exe", "O", "P", None), ("c:\\b.exe", "O2", "P2", "D2"), ("c:\\b.exe", "O2", "P2", "D2")], "path string, OriginalFileName string, Product string, Description string")
    got = [(r.OriginalFileName, r.Product, r.Description) for r in normalize.with_file_metadata(ev, files).orderBy("seq").collect()]
    assert got == [("O", "P", None), ("O2", "own", "D2")]
    lines = normalize.with_command_lines(ev, spark.createDataFrame([(5, "found"), (6, "no")], "pid long, command_line string"))
    assert [r.CommandLine for r in lines.orderBy("seq").collect()] == ["found", "mine"]


def test_process_lookup_ties_and_grave(spark):
    starts = spark.createDataFrame([(10, 1, "a"), (50, 1, "b"), (200, 2, "c")], "seq long, pid long, Image string")
    stops = spark.createDataFrame([(60, 1), (200, 2)], "seq long, pid long")
    probes = spark.createDataFrame([(9, 1), (10, 1), (49, 1), (50, 1), (60, 1), (120, 1), (121, 1), (200, 2), (260, 2), (261, 2), (5, 3), (5, None)], "seq long, pid long")
    got = {(r.seq, r.pid): r.proc_Image for r in enrich.asof_process(probes, starts, stops).collect()}
    assert got == {(9, 1): None, (10, 1): "a", (49, 1): "a", (50, 1): "b", (60, 1): "b", (120, 1): "b", (121, 1): None, (200, 2): "c", (260, 2): "c", (261, 2): None, (5, 3): None, (5, None): None}


def test_dns_window(spark):
    cache = spark.createDataFrame([("1.1.1.1", 0, "old"), ("1.1.1.1", 100, "new")], "ip string, seq long, hostname string")
    probes = spark.createDataFrame([(50, "1.1.1.1"), (999, "1.1.1.1"), (1000, "1.1.1.1"), (5, "2.2.2.2")], "seq long, ip string")
    assert {r.seq: r.asof_hostname for r in enrich.asof_dns(probes, cache).collect()} == {50: "old", 999: "new", 1000: None, 5: None}
    assert {r.seq for r in enrich.asof_dns(probes, cache, ttl=0).where("asof_hostname IS NOT NULL").collect()} == set()


def test_connections(spark):
    rows = [(1, "i", "9.9.9.9", 80, "tcp", 1), (2, "i", "9.9.9.9", 80, "tcp", 2), (3, "i", "9.9.9.9", 80, "tcp", 3), (4, "i", "8.8.8.8", 80, "tcp", 1), (5, "i", "9.9.9.9", 81, "tcp", 1), (6, None, "9.9.9.9", 80, "tcp", 1), (7, None, "9.9.9.9", 80, "tcp", 1)]
    df = spark.createDataFrame(rows, "seq long, image string, dest_ip string, dest_port int, protocol string, pid long")
    assert sorted(r.seq for r in enrich.first_connections(df).collect()) == [1, 4, 5, 6, 7]
    s = enrich.connection_stats(df).where("dest_ip = '9.9.9.9' AND dest_port = 80 AND image = 'i'").first()
    assert (s.first_seen, s.last_seen, s.connections, s.pids) == (1, 3, 3, 3)
    b = {(r.dest_ip, r.dest_port): (r.intervals, r.stddev) for r in enrich.beacon_stddev(df.where("image = 'i'")).collect()}
    assert b == {("9.9.9.9", 80): (2, 0.0), ("8.8.8.8", 80): (0, None), ("9.9.9.9", 81): (0, None)}
    limited = enrich.rate_limited(df.select(F.lit("k").alias("k"), "seq"), "k", "seq", 3).orderBy("seq").collect()
    assert [(r.seq, r.suppressed) for r in limited] == [(1, 0), (4, 2), (7, 2)]


def test_indicator_files(tmp_path):
    text = "# c\n// c\n\n ABCDEF0123456789abcdef0123456789 ; first\nabcdef0123456789abcdef0123456789;second\nxyz\n"
    assert ind.hashes(text, "h") == [ind.Indicator("md5", "abcdef0123456789abcdef0123456789", "second", "h", 5)]
    assert [(i.kind, i.value) for i in ind.ips("1.2.3.4\n::1\n10.1.2.3/8\nbad\n1.2.3.4/99\n")] == [("ip", "1.2.3.4"), ("ip", "::1"), ("cidr", "10.1.2.3/8")]
    assert [(i.kind, i.value) for i in ind.domains("Example.COM.\n*.x.y\n.z\n.\n")] == [("domain", "example.com"), ("suffix", "x.y"), ("suffix", "z")]
    assert [(i.value, i.comment) for i in ind.paths("a;b\n(?=x)\n")] == [("a", "b")]
    (tmp_path / "d.txt").write_text("a.b\n")
    assert ind.load({"domains": str(tmp_path / "d.txt"), "ips": str(tmp_path / "missing")}).stats()[5] == ("domain", 1)


def test_indicator_matches(spark):
    i = ind.Indicators(ind.domains("foo.example.com;x\n*.example.com\n") + ind.ips("10.0.0.1\n10.0.0.0/24\n::ffff:0:0/96\n") + ind.paths("EVIL\n"))
    net = events(spark, [{"DestinationIp": "10.0.0.1", "SourceIp": "10.0.0.1", "DestinationHostname": "Foo.Example.com."}, {"DestinationHostname": "example.com"}, {"DestinationHostname": "notexample.com", "SourceIp": "::ffff:1.2.3.4"}], "Network")
    got = sorted((r.seq, r.kind, r.indicator, r.observed) for r in indicators.match_all(net, i).collect())
    assert got == [(0, "domain", ".example.com", "foo.example.com"), (0, "domain", "foo.example.com", "foo.example.com"), (0, "ip", "10.0.0.0/24", "10.0.0.1"), (0, "ip", "10.0.0.1", "10.0.0.1"), (1, "domain", ".example.com", "example.com"), (2, "ip", "::ffff:0.0.0.0/96", "::ffff:1.2.3.4")]
    told = {r.rule_name: (r.rule_description, r.severity) for r in indicators.alert_columns(indicators.match_domains(net.where("seq = 0"), i), "nope").collect()}
    assert told == {"ioc:domain:foo.example.com": ("x | source: ", "High"), "ioc:domain:.example.com": ("observed: foo.example.com | source: ", "High")}
    files = events(spark, [{"TargetFilename": "C:\\evil.txt"}], "File")
    assert indicators.match_paths(files, i).count() == 1
    assert indicators.match_all(net, ind.Indicators()).count() == 0


def test_file_hashes(spark):
    files = spark.createDataFrame([("C:\\a", 3, 1, b"abc"), ("C:\\a", 3, 1, b"abc"), ("C:\\Windows\\b", 3, 1, b"abc"), ("C:\\big", 99, 1, b"abc")], "path string, size long, mtime long, content binary")
    i = ind.Indicators(ind.hashes("900150983cd24fb0d6963f7d28e17f72\na9993e364706816aba3e25717850c26c9cd0d89d\n"))
    got = indicators.match_hashes(files, i, most_bytes=50, allow=("C:\\Win",)).collect()
    assert sorted((r.path, r.kind) for r in got) == [("C:\\a", "md5"), ("C:\\a", "sha1")]
    assert indicators.match_hashes(files, i, most_bytes=0).where("path = 'C:\\\\big'").count() == 2
    assert indicators.match_hashes(files, ind.Indicators()).count() == 0


def alert(spark, fields, category, **more):
    df = events(spark, [fields], category)
    return df.withColumns({"rule_name": F.lit("r"), "rule_description": F.lit(None).cast("string"), "severity": F.lit("High"), "engine": F.lit("Sigma"), **{k: F.lit(v) for k, v in more.items()}})


def test_ecs_shapes(spark):
    r = ecs.project(alert(spark, {"QueryName": "x", "QueryResults": "1.1.1.1;", "User": "ignored"}, "Dns")).first()
    assert (r["dns.resolved_ip"], r["related.ip"], r["network.direction"], r["user.name"], r["dns.answers"][0].data) == (["1.1.1.1"], ["1.1.1.1"], "egress", None, "1.1.1.1;")
    r = ecs.project(alert(spark, {"TargetObject": "HKLM\\Software\\Test\\Value", "EventType": "SetValue", "opcode": 39}, "Registry")).first()
    assert (r["registry.hive"], r["registry.key"], r["registry.value"], r["event.action"], r["event.type"]) == ("HKLM", "Software\\Test", "Value", "SetValue", ["change"])
    r = ecs.project(alert(spark, {"ServiceName": "s", "event_id": 7045}, "Service", ctx_User="NT AUTHORITY\\SYSTEM", ctx_ProcessId="4321", ctx_Image="C:\\w.exe")).first()
    assert (r["user.name"], r["user.domain"], int(r["process.pid"]), r["process.name"], r["event.action"]) == ("SYSTEM", "NT AUTHORITY", 4321, "w.exe", "service-create")
    r = ecs.project(alert(spark, {"User": "S-1-5-18", "Image": "a"}, "File", ctx_User="D\\u")).first()
    assert (r["user.name"], r["user.id"], r["user.domain"], r["related.user"]) == ("u", "S-1-5-18", "D", ["S-1-5-18", "u"])
    r = ecs.project(alert(spark, {"SourceIp": "::1", "DestinationIp": "1.2.3.4", "DestinationPort": "70000", "opcode": 15}, "Network")).first()
    assert (r["network.type"], r["network.transport"], r["destination.port"], r["related.ip"]) == ("ipv6", "udp", None, ["1.2.3.4", "::1"])


def test_ndjson_leaves_nulls_out(spark, tmp_path):
    got = ecs.project(alert(spark, {"Image": "a\\b.exe"}, "Process"))
    line = ecs.ndjson(got).first().value
    assert '"process.name":"b.exe"' in line and "null" not in line and '"event.category":["process"]' in line
    ecs.write_ndjson(got.withColumn("@timestamp", F.lit("2024-05-06T00:00:00Z")), f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "alert_date=2024-05-06").is_dir()


def test_response_ladder(spark):
    policy = response.Policy("high", dry_run=True, own_pid=99, allow_images=("ok.exe", "C:/full.exe"), allow_paths=("C:\\Windows",))

    def decide(fields, category="Process", **more):
        return response.decide(alert(spark, fields, category, **more), policy).first().response_decision

    assert decide({"Image": "x"}) == "skip-no-pid"
    assert decide({"Image": "x", "ProcessId": "4"}) == decide({"Image": "x", "ProcessId": "99"}) == "skip-protected-pid"
    assert decide({"ProcessId": "0x10"}) == "skip-no-image"
    assert decide({"ProcessId": "16", "Image": "c:/windows/x.exe"}) == decide({"ProcessId": "16", "Image": "D:\\OK.exe"}) == decide({"ProcessId": "16", "Image": "c:\\FULL.exe"}) == "skip-allowlisted"
    assert decide({"ProcessId": "16", "Image": "c:\\windowsx\\x.exe"}) == "dry-run"
    assert decide({"ProcessId": "16", "Image": "x"}, severity="Medium") is None
    assert decide({"ProcessId": "16", "Image": "x"}, severity="Low", engine="Yara") == "dry-run"
    assert decide({"SourceProcessId": "16", "TargetProcessId": "17", "TargetImage": "D:\\ok.exe", "SourceImage": "s"}, "RemoteThread") == "skip-allowlisted"
    assert decide({}, "Dns", ctx_ProcessId="33", ctx_Image="y") == "dry-run"


YARA = r"""
import "pe"
/* a comment */ rule t : one two { meta: author = "x" n = 3
  strings: $a = "ab\x41" nocase $w = "Hi" wide $f = "cat" fullword $h = { E2 ?4 [1-2] (01 | 02 03) ~00 } $r = /x[0-9]+y/i
  condition: 2 of them or #a >= 3 or ($h and filesize < 1KB) or $r at 0 }
private rule n { condition: not true or none of them }
"""


def test_yara_bytes(spark):
    rules = yara.parse("rule a { strings: $a = \"ab\\x41\" nocase $w = \"Hi\" wide $f = \"cat\" fullword $h = { E2 ?4 [1-2] (01 | 02 03) ~00 } $r = /x[0-9]+y/i condition: any of them } rule at : t { strings: $r = /x/ condition: $r at 0 and #r == 2 and $r in (1..9) and filesize < 1KB }")
    data = [b"zABaz", b"H\0i\0", b"a cat.", b"concat", b"\xe2\x14\x00\x01\x07", b"\xe2\x14\x00\x02\x03\x00", b"X12Y", b"xabx", b"", None]
    df = spark.createDataFrame(list(enumerate(data)), "id int, content binary")
    got = sorted((r.id, r.yara.rule, r.yara.strings[0].id, r.yara.strings[0].offset) for r in yara.scan(df, rules).collect())
    assert got == [(0, "a", "$a", 1), (1, "a", "$w", 0), (2, "a", "$f", 2), (4, "a", "$h", 0), (6, "a", "$r", 0), (7, "at", "$r", 0)]
    assert yara.scan(df, rules, detail="off").first().yara.strings == []
    assert len(yara.parse(YARA)) == 2


@pytest.mark.parametrize("text", ["rule x { condition: $a }", "rule x { strings: $a = { GG } condition: $a }", "rule x { strings: $a = /(/ condition: $a }", "rule x { }", "rule x { strings: $a = \"b\" condition: any of ($c*) }"])
def test_yara_refuses(text):
    with pytest.raises(ValueError):
        yara.parse(text)


def test_yara_files_and_text(spark, tmp_path):
    (tmp_path / "a.yar").write_text('rule t { strings: $a = "x" fullword $b = "Y" nocase condition: all of them and #a > 1 }')
    (tmp_path / "b.yara").write_text("rule broken {")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.yar").write_text("rule deep { condition: true }")
    rules, failed = yara.load(str(tmp_path))
    assert [r.name for r in rules] == ["t"] and len(failed) == 1 and yara.load(str(tmp_path / "none")) == ([], [])
    df = spark.createDataFrame([(1, "x x y"), (2, "x xx y"), (3, None)], "id int, t string")
    assert [r.id for r in yara.text_hits(df, rules, "t").collect()] == [1]
    found = spark.createDataFrame([("p", "7")], "path string, pid string").crossJoin(yara.scan(spark.createDataFrame([(b"x x y",)], "content binary"), rules).select("yara"))
    a = yara.alerts(found).first()
    assert (a.severity, a.engine, a.Image, a.ProcessId, a.rule_name) == ("Critical", "Yara", "p", "7", "t")


def test_configuration_layers(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('[ioc]\ndefault_severity = "low"\nmax_file_size_mb = 7\n[allowlist]\npaths = ["C:\\\\Windows"]\n[response]\nallowlist_paths = ["D:"]\n')
    cfg = config.load(str(p), {"EDR__IOC__MAX_FILE_SIZE_MB": "9", "EDR__SCANNER__YARA_ENABLED": "false", "OTHER": "x"}, "debug")
    assert (cfg.ioc.default_severity, cfg.ioc.max_file_size_mb, cfg.scanner.yara_enabled, cfg.logging.level) == ("low", 9, False, "debug")
    assert cfg.ioc.hash_allowlist_paths == ("C:\\Windows",) and cfg.response.allowlist_paths == ("D:",)
    assert config.load(None, {}).ioc.default_severity == "high"
    assert ("ioc.enabled", "True") in config.as_rows(config.load(None, {}))


def test_detector_and_command_line(spark, tmp_path, capsys):
    from duskwatch.__main__ import main
    from duskwatch.engine import Detector

    for d in ("sigma", "yara"):
        (tmp_path / d).mkdir()
    (tmp_path / "sigma" / "w.yml").write_text("title: w\nlevel: critical\nlogsource: {category: process_creation}\ndetection: {i: {Image|endswith: '\\whoami.exe'}, c: {CommandLine|contains: ' /all'}, condition: i and c}\n")
    (tmp_path / "paths.txt").write_text("whoami;seen\n")
    (tmp_path / "c.toml").write_text(f'[scanner]\nsigma_rules_path = "{tmp_path}/sigma"\nyara_rules_path = "{tmp_path}/yara"\n[ioc]\npaths_regex_path = "{tmp_path}/paths.txt"\n[alerts]\nmatch_debug = "full"\n')
    ev = events(spark, [{"Image": "C:\\whoami.exe", "CommandLine": "whoami /all", "ProcessId": "500", "timestamp": "2024-01-02T03:04:05Z"}, {"Image": "x"}])
    d = Detector.load(config.load(str(tmp_path / "c.toml"), {}))
    got = {r["rule.name"]: r for r in d.run(ev).collect()}
    assert set(got) == {"w", "ioc:path_regex:whoami"}
    assert got["w"]["response_decision"] == "dry-run" and got["w"]["edr.match"].summary.startswith("condition matched: i and c")
    ev.write.parquet(f"{tmp_path}/t.parquet")
    assert main(["run", "--config", str(tmp_path / "c.toml"), "--input", f"{tmp_path}/t.parquet", "--output", f"{tmp_path}/out"]) == 0
    assert (tmp_path / "out" / "alert_date=2024-01-02").is_dir()
    assert main(["rules", "--config", str(tmp_path / "c.toml")]) == 0
    assert "total\t1" in capsys.readouterr().out
    assert TELEMETRY.names[0] == "seq"


def test_addresses_of_both_families(spark):
    rows = [("10.0.0.1;2001:DB8::1", ["10.0.0.1", "2001:db8::1"]), ("type: 5 a::b c", ["a::b"]), ("::ffff:10.0.0.1 1.2.3.4.5 :: x", ["::", "::ffff:10.0.0.1"]), ("no", []), (None, None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r[0] for r in df.select(C.addresses(F.col("t"))).collect()] == [w for _, w in rows]


def test_networks_of_both_families_are_joined_by_equality(spark):
    nets = ["10.0.0.0/9", "0.0.0.0/0", "2001:db8::/33", "2001:db8:8000::/127", "::/0", "2001:db8::5/128"]
    ips = ["10.1.2.3", "192.168.0.1", "2001:DB8::5", "2001:db8:8000::1", "2001:db8:8000::2", "fe80::1", "x"]
    df = events(spark, [{"category": "Network", "DestinationIp": i, "seq": n} for n, i in enumerate(ips)])
    got = {(r.DestinationIp, r.indicator) for r in indicators.match_ips(df, ind.Indicators(ind.ips("\n".join(nets) + "\n", "f"))).collect()}
    inside = lambda i, n: ipaddress.ip_address(i) in ipaddress.ip_network(n)
    plain = {n: next(i.value for i in ind.ips(n + "\n", "f")) for n in nets}
    assert got == {(i, plain[n]) for i in ips if i != "x" for n in nets if ":" in i and ":" in n or ":" not in i + n if inside(i, n)}


def test_stop_of_an_earlier_process_does_not_end_the_later_one(spark):
    starts = spark.createDataFrame([(1, 10, "a"), (1, 30, "b")], "pid long, seq long, Image string")
    stops = spark.createDataFrame([(1, 20)], "pid long, seq long")
    probes = spark.createDataFrame([(1, t) for t in (5, 15, 25, 85, 200)], "pid long, seq long")
    got = {r.seq: r.proc_Image for r in enrich.asof_process(probes, starts, stops).collect()}
    assert got == {5: None, 15: "a", 25: "a", 85: "b", 200: "b"}


def test_files_decisions_and_streams(spark, tmp_path):
    import json

    from duskwatch.engine import Detector
    from duskwatch.operators import yara
    from duskwatch.operators.sigma import RuleSet
    from duskwatch.plans.catalog import compiled
    from duskwatch.sources.files import read_files

    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "evil.exe").write_bytes(b"MZ evil")
    (tmp_path / "f" / "fine.exe").write_bytes(b"MZ fine")
    files = read_files(spark, f"file://{tmp_path}/f", strip=f"file:{tmp_path}/f/")
    assert sorted((r.path, r.size) for r in files.collect()) == [("evil.exe", 7), ("fine.exe", 7)]
    rules = RuleSet([compiled("process_creation", {"s": {"CommandLine|contains": "go"}, "condition": "s"}, title="goes", level="high")])
    listed = ind.Indicators(ind.hashes(hashlib.sha256(b"MZ evil").hexdigest() + ";bad\n", "h"))
    d = Detector(rules, listed, yara.parse('rule e { strings: $a = "evil" condition: $a }'), policy=response.Policy("high"))
    ev = events(spark, [{"seq": 1, "category": "Process", "opcode": 1, "Image": "EVIL.exe", "ProcessId": "50", "CommandLine": "go"}, {"seq": 2, "category": "Process", "opcode": 1, "Image": "fine.exe", "ProcessId": "51"}])
    d.write(ev, f"{tmp_path}/out", files=files)
    got = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert sorted((g["edr.rule.engine"], g["process.executable"], g["edr.response.decision"]) for g in got) == [("Ioc", "EVIL.exe", "dry-run"), ("Sigma", "EVIL.exe", "dry-run"), ("Yara", "EVIL.exe", "dry-run")]
    ev.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in")
    d.follow(stream, f"{tmp_path}/live", f"{tmp_path}/state").awaitTermination()
    live = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/live").collect()]
    assert [(g["rule.name"], g["edr.response.decision"]) for g in live] == [("goes", "dry-run")]
