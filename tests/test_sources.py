import datetime as dt
import json
import struct

import pytest
from pyspark.sql import functions as F

from wirelight.functions.ja3 import frames_ja3
from wirelight.functions.times import clamp_cursor, eve_ts, msdns_ts, wire_time, zeek_epoch
from wirelight.operators.projections import event_unified, to_ip_entry, with_direction, with_sensor_direction
from wirelight.sources import registry
from wirelight.sources.documents import decode, land_hits, newest_ingested, page, pages, search, source_projection
from wirelight.sources.lines import number_lines, read_landed_lines, read_lines, split_errors
from wirelight.sources.capture_ranges import pcap_frames
from wirelight.sources.pcap import split_captures
from wirelight.sources.search_config import Search
from wirelight.sources.zeek import header_fill, zeek_events, zeek_scan


def ts(text):
    return dt.datetime.fromisoformat(text)


HEAD = ["#separator \\x09", "#set_separator\t,", "#empty_field\t(empty)", "#unset_field\t-", "#path\tdns"]
DNS_FIELDS = "#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tquery\tqtype_name"


def _write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_zeek_dns(spark, tmp_path):
    _write(tmp_path / "a.log", HEAD + [DNS_FIELDS,
        "1700000000.384253\tC1\t10.0.0.1\t4242\t10.0.0.2\t53\tUDP\tshop.example.org\tA", "",
        "1700000001.5\tC2\tFD00::0001\t4243\t10.0.0.2\t53\ttcp\t-\t-", "#close\t2024"])
    # other columns, other separator, and a second header in the same file
    _write(tmp_path / "b.log", ["#separator \\x2c", "#unset_field,*", "#fields,query,ts,id.orig_h", "q1,1700000002.0,10.0.0.3",
        "#separator \\x09", "#fields\tts\tid.orig_h\tquery\tqtype_name", "1700000003.0\tbad\tq2\t*"])
    rows = zeek_events(read_landed_lines(spark, str(tmp_path)), "dns").orderBy("ts").collect()
    got = [(r.srcIP, r.srcPort, r.destPort, r.proto, r.query, r.qtype) for r in rows]
    assert got == [("10.0.0.1", 4242, 53, "udp", "shop.example.org", "A"), ("fd00::1", 4243, 53, "tcp", "-", ""),
                   ("10.0.0.3", None, None, None, "q1", None), (None, None, None, None, "q2", "")]
    assert rows[0].ts == ts("2023-11-14T22:13:20.384253")
    assert header_fill(read_landed_lines(spark, str(tmp_path))).count() == 9
    scan = zeek_scan(read_landed_lines(spark, str(tmp_path / "b.log"))).collect()
    assert [r.fields for r in scan] == [{"query": "q1", "ts": "1700000002.0", "id.orig_h": "10.0.0.3"},
                                       {"ts": "1700000003.0", "id.orig_h": "bad", "query": "q2", "qtype_name": "*"}]


def test_zeek_many_files_path(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("wirelight.operators.lookup.BROADCAST_BYTES", 0)
    for i in range(3):
        _write(tmp_path / f"{i}.log", HEAD + [DNS_FIELDS, f"170000000{i}.0\tC\t10.0.0.{i}\t1\t10.0.0.9\t53\tudp\tq{i}\tA"])
    rows = zeek_events(read_landed_lines(spark, str(tmp_path)), "dns").collect()
    assert sorted((r.srcIP, r.query) for r in rows) == [(f"10.0.0.{i}", f"q{i}") for i in range(3)]


def test_zeek_rows_do_not_depend_on_splits(spark, tmp_path, monkeypatch):
    """Headers found under one cutting of the files, data read under another; header changes in mid-file and compressed files included."""
    import gzip

    swapped = DNS_FIELDS.replace("query\tqtype_name", "qtype_name\tquery")
    row = lambda i, a, b: f"{1700000000 + i}.0\tC\t10.0.{i // 250}.{i % 250}\t1\t10.0.0.9\t53\tudp\t{a}\t{b}"
    lines = HEAD + [DNS_FIELDS] + [row(i, f"q{i}", "A") for i in range(3000)] + [swapped] + [row(i, "A", f"q{i}") for i in range(3000, 6000)]
    _write(tmp_path / "plain.log", lines)
    (tmp_path / "packed.log.gz").write_bytes(gzip.compress("\r\n".join(lines).encode()))
    for size in ("1000", "77777", "1048576"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            landed = read_landed_lines(spark, str(tmp_path))
            # what is read later is cut in other ways
            spark.conf.set("spark.sql.files.maxPartitionBytes", "33333")
            found = zeek_events(landed, "dns", on_error="fail").collect()
            numbers = number_lines(landed).orderBy("source_file", "line_no").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert len(found) == 12_000 and {r.qtype for r in found} == {"A"}
        assert len({r.query for r in found}) == 6000
        if size == "1000":
            assert landed.select("source_file", "block_start").distinct().count() > 100
        for n, file in enumerate(("packed.log.gz", "plain.log")):
            mine = numbers[n * len(lines) : (n + 1) * len(lines)]
            assert {r.source_file.rsplit("/", 1)[1] for r in mine} == {file}
            assert [(r.line_no, r.value.rstrip()) for r in mine] == list(enumerate(lines, 1))


def test_only_header_files_are_read_for_headers(spark, tmp_path):
    _write(tmp_path / "a.log", HEAD + [DNS_FIELDS] + [f"{i}.0\tC\t10.0.0.1\t1\t10.0.0.9\t53\tudp\tq\tA" for i in range(50)])
    headers = header_fill(read_landed_lines(spark, str(tmp_path)))
    assert headers.count() > 0
    assert "PartitionFilters: [isnotnull(mark" in headers._jdf.queryExecution().executedPlan().toString().replace("\n", " ")


def test_zeek_conn_http_and_errors(spark, tmp_path):
    f = _write(tmp_path / "conn.log", HEAD + ["#fields\tts\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\torig_bytes\tresp_bytes\torig_ip_bytes\tresp_ip_bytes\tja3",
        "1.0\t10.0.0.1\t1\t8.8.8.8\t53\tUDP\t-\t-\t10\t0\t-", "2.0\t10.0.0.1\t1\t8.8.8.8\t53\tUDP\t-5\t7\t-\t13\tabc"])
    rows = zeek_events(read_landed_lines(spark, f), "ip").orderBy("ts").collect()
    assert [(r.bytesCount, r.ja3, r.destIP, r.destPort) for r in rows] == [(10, "", "8.8.8.8", 53), (20, "abc", "8.8.8.8", 53)]
    assert to_ip_entry(zeek_events(read_landed_lines(spark, f), "ip")).agg(F.sum("bytesOut")).first()[0] == 30
    f = _write(tmp_path / "http.log", HEAD + ["#fields\tts\tid.orig_h\tid.orig_p\tmethod\thost\turi\treferrer\tuser_agent\trequest_body_len\tresponse_body_len\tstatus_code\tresp_mime_types",
        "1.0\t10.0.0.1\t99\tGET\tex.org\t/a?b\t-\t(empty)\t0\t3698\t200\ttext/html", "2.0\t10.0.0.1\t99\tGET\tex.org\t/\t-\tx\t-\t0\t-\t-"])
    rows = zeek_events(read_landed_lines(spark, f), "http", on_error="skip").orderBy("ts").collect()
    assert (rows[0].url, rows[0].status, rows[0].bytesIn, rows[0].referrer, rows[0].userAgent) == ("http://ex.org/a?b", 200, 3698, "", "")
    assert rows[1].status is None and len(rows) == 2
    with pytest.raises(Exception, match="zeek: bad"):
        zeek_events(read_landed_lines(spark, f), "http").collect()
    f = _write(tmp_path / "bad.log", HEAD + [DNS_FIELDS, "x\ty", "1.0\tC\t10.0.0.1\t70000\t10.0.0.9\t53\tudp\tq\tA",
        "1\tC\t10.0.0.1\t7\t10.0.0.9\t53\tudp\tq\tA", "1.0\tC\t10.0.0.1\t7\t10.0.0.9\t53\tudp\tq\tA"])
    good, bad = split_errors(zeek_events(read_landed_lines(spark, f), "dns", on_error="keep"))
    assert good.count() == 1 and sorted(r._error for r in bad.collect()) == [
        "zeek: bad port", "zeek: bad timestamp", "zeek: wrong number of columns"]
    assert all(r._raw for r in bad.collect())


def test_suricata(spark, tmp_path):
    rec = lambda **k: json.dumps({"timestamp": "2024-05-01T10:00:00.250000+0200", "src_ip": "10.9.0.5", "src_port": 9, **k})
    f = _write(tmp_path / "eve.json", ["", rec(dest_port=53, proto="UDP", dns={"type": "query", "rrname": "shop.example.org", "rrtype": "A"}),
        rec(dest_port=53, proto="UDP", dns={"type": "answer", "rrname": "x", "rrtype": "A"}),
        rec(dest_port=443, proto="TCP", http={"hostname": "ex.org", "url": "/a//b/", "http_method": "GET", "status": 200}),
        rec(dest_port=8080, proto="TCP", http={"hostname": "ex.org", "url": "/"})])
    r = registry.read_events(spark, f, "suricata", "dns").collect()
    assert [(x.ts, x.srcIP, x.destPort, x.proto, x.query, x.qtype) for x in r] == [
        (ts("2024-05-01T08:00:00.250000"), "10.9.0.5", 53, "udp", "shop.example.org", "A")]
    r = registry.read_events(spark, f, "suricata", "http").collect()
    assert [(x.url, x.method, x.status) for x in r] == [("https://ex.org/a/b", "GET", 200), ("ex.org", None, None)]
    f = _write(tmp_path / "bad.json", ["{oops", rec(dns={"type": "query"}), rec(src_port=70000, dns={"type": "query"}),
                                       '{"timestamp":"yesterday","dns":{"type":"query"}}'])
    good, bad = split_errors(registry.read_events(spark, f, "suricata", "dns", on_error="keep"))
    assert good.count() == 1 and bad.count() == 3
    assert registry.read_events(spark, f, "suricata", "dns", on_error="skip").count() == 1


def test_msdns_named_edge(spark, tmp_path):
    f = _write(tmp_path / "ms.log", ["DNS Server log file", "",
        "2024-05-01 10:00:00 0F10 PACKET  00000000AB12 UDP Rcv 10.9.0.7 00aa Q [0001 D NOERROR] AAAA (3)cdn(7)example(3)org(0)",
        "2024/05/01 3:00:00 PM 0F10 PACKET  00000000AB12 UDP Rcv 10.9.0.8 00aa Q [0001 D NOERROR] A (1)a(0)",
        "2024-05-01 10:00:00 0F10 PACKET  00000000AB12 UDP Snd 10.9.0.7 00aa R Q [0001 D NOERROR] AAAA (3)cdn(0)",
        "2024-05-01 10:00:00 0F10 EVENT   The DNS server has started something or other today ok"])
    r = registry.read_events(spark, f, "msdns", "dns").orderBy("ts").collect()
    assert [(x.ts, x.srcIP, x.proto, x.query, x.qtype) for x in r] == [
        (ts("2024-05-01T10:00:00"), "10.9.0.7", "udp", "cdn.example.org", "AAAA"),
        (ts("2024-05-01T15:00:00"), "10.9.0.8", "udp", "a", "A")]
    f = _write(tmp_path / "named.log", [
        "1714557600 May 1 10:00:00 ns1 named[7]: queries: info: client 10.9.0.8#4242 (a.example.org): query: a.example.org IN MX +E (10.9.0.1)",
        "nothing"])
    r = registry.read_events(spark, f, "syslog-named", "dns").collect()
    assert [(x.ts, x.srcIP, x.proto, x.query, x.qtype) for x in r] == [
        (ts("2024-05-01T10:00:00"), "10.9.0.8", "udp", "a.example.org", "MX")]
    f = _write(tmp_path / "e.json", [json.dumps([
        {"time": 1714557600250, "source": "10.9.0.9", "query": "b.example.org.", "queryType": "A", "queryProtocol": "UDP"},
        {"time": 1714557600251, "source": "::1", "query": "c", "queryType": "A", "queryProtocol": "tcp"}])])
    r = registry.read_events(spark, f, "edge", "dns").orderBy("ts").collect()
    assert [(x.ts, x.srcIP, x.proto, x.query) for x in r] == [
        (ts("2024-05-01T10:00:00.250"), "10.9.0.9", "udp", "b.example.org."), (ts("2024-05-01T10:00:00.251"), "::1", "tcp", "c")]
    with pytest.raises(ValueError):
        registry.read_events(spark, f, "edge", "ip")
    with pytest.raises(ValueError):
        registry.get_format("nope")


def test_times(spark):
    df = spark.createDataFrame([("1.5", "2024-05-01T10:00:00+0000", "2024-05-01 1:00:00 AM")], "z string, e string, m string")
    r = df.select(zeek_epoch("z").alias("z"), zeek_epoch("z", "nanoseconds").alias("zn"), eve_ts("e").alias("e"),
                  msdns_ts("m").alias("m"), msdns_ts("m", zone="America/New_York").alias("mz"),
                  wire_time(zeek_epoch("z")).alias("w"), wire_time(eve_ts("e")).alias("w2")).first()
    assert r.z == ts("1970-01-01T00:00:01.5") and r.zn == ts("1970-01-01T00:00:01") and r.e == ts("2024-05-01T10:00:00")
    assert r.m == ts("2024-05-01T01:00:00") and r.mz == ts("2024-05-01T05:00:00")
    assert (r.w, r.w2) == ("1970-01-01T00:00:01.5Z", "2024-05-01T10:00:00Z")
    now = F.lit("2024-05-02T00:00:00Z").cast("timestamp")
    df = spark.createDataFrame([("2024-05-01T12:00:00Z",), ("2020-01-01T00:00:00Z",), ("junk",), (None,)], "c string")
    assert [r.x for r in df.select(clamp_cursor("c", now).alias("x")).collect()] == [
        ts("2024-05-01T12:00:00"), ts("2024-05-01T00:00:00"), ts("2024-05-01T00:00:00"), None]


# --- packets -----------------------------------------------------------------

MAC = bytes.fromhex("020000000001")


def _ipv4(proto, body, src="10.0.2.15", dst="8.8.8.8", frag=0):
    pack = lambda ip: bytes(int(x) for x in ip.split("."))
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 1, frag, 64, proto, 0) + pack(src) + pack(dst)
    return bytes.fromhex("020000000002") + MAC + b"\x08\x00" + head + body


def _udp(body, sport=13705, dport=53):
    return struct.pack(">HHHH", sport, dport, 8 + len(body), 0) + body


def _dns(flags=0x0120, questions=1, name=b"\x03api\x07example\x03org\x00", qtype=1):
    return struct.pack(">HHHHHH", 1, flags, questions, 0, 0, 0) + name + struct.pack(">HH", qtype, 1)


def _tcp(body, sport=49206, dport=443):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, 0x18, 1000, 0, 0) + body


def _ipv6(nxt, body):
    src, dst = bytes.fromhex("fd" + "00" * 14 + "01"), bytes.fromhex("2001" + "00" * 13 + "05")
    return bytes.fromhex("020000000002") + bytes(6) + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, len(body), nxt, 64) + src + dst + body


def _hello(ciphers=(0x0A0A, 60, 47), curves=(23, 0x1A1A, 24), exts=True):
    ext = b""
    if exts:
        groups = b"".join(struct.pack(">H", c) for c in curves)
        data = struct.pack(">H", len(groups)) + groups
        ext = struct.pack(">HH", 0x2A2A, 0) + struct.pack(">HH", 10, len(data)) + data + struct.pack(">HH", 11, 2) + b"\x01\x00"
        ext = struct.pack(">H", len(ext)) + ext
    suites = b"".join(struct.pack(">H", c) for c in ciphers)
    body = struct.pack(">H", 771) + bytes(32) + b"\x00" + struct.pack(">H", len(suites)) + suites + b"\x01\x00" + ext
    body = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(body)) + body


def _pcap(frames, order="<", magic=0xA1B2C3D4, linktype=1):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, linktype)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 1700000000 + i, 250000, len(f), len(f)) + f
    return out


def test_pcap(spark, tmp_path):
    frames = [_ipv4(17, _udp(_dns())), _ipv4(17, _udp(_dns(flags=0x8180))), _ipv4(17, _udp(_dns(questions=0))),
              _ipv4(6, _tcp(_hello())), _ipv6(17, _udp(_dns(qtype=28, name=b"\x01a\x00"))), _ipv4(1, b"\x08\x00" * 10),
              _ipv4(17, _udp(_dns()), frag=100), b"\x00" * 20,
              _ipv4(6, _tcp(struct.pack(">H", 20) + _dns(qtype=65534, name=b"\x02tt\x00"), dport=53)),
              _ipv4(6, _tcp(_hello()[:60])), _ipv4(6, _tcp(_hello(exts=False)))]
    (tmp_path / "a.pcap").write_bytes(_pcap(frames))
    (tmp_path / "b.pcap").write_bytes(_pcap(frames[:1], ">", 0xA1B23C4D) + b"\x00" * 7)
    raw = pcap_frames(spark, str(tmp_path)).persist()
    assert raw.count() == len(frames) + 1
    ip = registry.parse(raw, "pcap", "ip").where("source_file like '%a.pcap'").orderBy("ts").collect()
    assert len(ip) == 8
    first = ip[0]
    assert (first.srcIP, first.srcPort, first.destIP, first.destPort, first.proto) == ("10.0.2.15", 13705, "8.8.8.8", 53, "udp")
    assert first.bytesCount == len(frames[0]) and first.srcMac == MAC.hex() and first.ts == ts("2023-11-14T22:13:20.25")
    assert {(r.srcIP, r.destIP) for r in ip if ":" in r.srcIP} == {("fd00::1", "2001::5")}
    dns = registry.parse(raw, "pcap", "dns").orderBy("source_file", "ts").collect()
    assert [(r.query, r.qtype, r.proto) for r in dns] == [("api.example.org", "A", "udp"), ("a", "AAAA", "udp"),
                                                         ("tt", "Unknown", "tcp"), ("api.example.org", "A", "udp")]
    ja3 = frames_ja3(raw).orderBy("ts").collect()
    assert [r.ja3_text for r in ja3] == ["771,60-47,10-11,23-24,0", "771,60-47,,,"]
    directions = {r.direction for r in with_direction(registry.parse(raw, "pcap", "ip"), "02:00:00:00:00:01").collect()}
    assert directions == {"in", "out"}
    sensors = spark.createDataFrame([("s", "02-00-00-00-00-01")], "sensor string, mac string")
    tagged = with_sensor_direction(registry.parse(raw, "pcap", "ip").withColumn("sensor", F.lit("s")), sensors)
    assert {r.direction for r in tagged.collect()} == {"in", "out"}


def test_published_client_hello(spark):
    # a hello that yields a fingerprint known from other tools: text fixes the digest
    suites = [60, 47, 61, 53, 5, 10, 49191, 49171, 49172, 49195, 49187, 49196, 49188, 49161, 49162, 64, 50, 106, 56, 19, 4]
    files = spark.createDataFrame([("f", bytearray(_pcap([_ipv4(6, _tcp(_hello(suites, (23, 24))))])))], "path string, content binary")
    r = frames_ja3(split_captures(files)).first()
    assert r.ja3_text == "771," + "-".join(map(str, suites)) + ",10-11,23-24,0"
    import hashlib
    assert r.ja3 == hashlib.md5(r.ja3_text.encode()).hexdigest()


# --- documents -----------------------------------------------------------------

def _hit(i, source, stamp="2024-05-01T10:00:00.000Z", ingested="2024-05-01T10:01:00.000Z"):
    return (json.dumps({"_id": str(i), "_source": source, "fields": {"@timestamp": [stamp], "event.ingested": [ingested]}}),)


def test_documents(spark):
    base = {"source": {"ip": "10.0.0.1", "port": 99, "bytes": 5}, "destination": {"ip": "8.8.8.8", "port": "443", "bytes": 7},
            "network": {"protocol": 6}, "dns": {"question": {"name": "q.org", "type": "A"}}}
    bad_ip = {**base, "source": {"ip": "nope"}}
    hits = [_hit(1, base), _hit(2, bad_ip), _hit(3, base, stamp="yesterday"), _hit(4, {"source": {"ip": "10.0.0.1"}}),
            _hit(5, base, ingested="2024-05-01T10:05:00.5Z"), _hit(6, base, ingested="2024-05-01T09:00:00Z")]
    docs = land_hits(spark.createDataFrame(hits, "value string"))
    cursor = F.lit("2024-05-01T10:00:00Z").cast("timestamp")
    s = Search("ip", "ecs")
    found = search(docs, s, cursor)
    assert sorted(r.id for r in found.collect()) == ["1", "2", "3", "5"]
    rows = decode(found, s).orderBy("id").collect()
    assert [(r.id, r.srcIP, r.srcPort, r.destIP, r.destPort, r.proto, r.bytesIn, r.bytesOut) for r in rows] == [
        ("1", "10.0.0.1", 99, "8.8.8.8", 0, "tcp", 7, 5), ("5", "10.0.0.1", 99, "8.8.8.8", 0, "tcp", 7, 5)]
    assert newest_ingested(found).first().newest == ts("2024-05-01T10:05:00.5")
    first = page(found, 2).collect()
    assert [r.id for r in first] == ["1", "2"]
    after = (F.lit(first[-1].ingested), F.lit(first[-1].id))
    assert [r.id for r in page(found, 5, after).collect()] == ["3", "5"]
    dns = Search("dns", "ecs", fields={"qtype": "dns.kind"})
    assert [(r.query, r.qtype) for r in decode(search(docs, dns, cursor), dns).where("id = '1'").collect()] == [("q.org", "")]
    now = F.lit("2024-05-01T10:06:30Z").cast("timestamp")
    assert sorted(r.id for r in search(docs, s, None, now).collect()) == ["5"]


@pytest.mark.parametrize("raw,want", [('"6"', "tcp"), ("6", "tcp"), ('"253"', "253"), ("253", "253"), ('"udp"', "udp"),
                                      ('"foo"', "foo"), ("256", ""), ("0", ""), ("-1", ""), ("null", ""), ('"300"', ""), ("17", "udp")])
def test_document_protocol(spark, raw, want):
    from wirelight.functions.documents import doc_proto
    df = spark.createDataFrame([('{"p":' + raw + "}",)], "j string")
    assert df.select(doc_proto(F.try_parse_json("j"), "p").alias("x")).first().x == want


def test_search_config():
    assert Search("dns", "ecs", fields={"query": "q"}).field_map()["query"] == "q"
    assert Search("tls", "corelight", fields={"event_ingested": "a", "timestamp": "b", "src_ip": "c"}).final_terms() == {"_path": "ssl"}
    for bad in ({"event_type": "x"}, {"event_type": "dns", "schema": "zzz"}, {"event_type": "dns"},
                {"event_type": "dns", "schema": "corelight"}, {"event_type": "dns", "schema": "ecs", "fields": {"nope": "x"}}):
        with pytest.raises(ValueError):
            Search(**bad)


def test_unified(spark):
    a = spark.createDataFrame([("10.0.0.1", "q")], "srcIP string, query string")
    b = spark.createDataFrame([("10.0.0.2", "u")], "srcIP string, url string")
    u = event_unified({"dns": a, "http": b})
    assert u.count() == 2 and len(u.columns) == 24


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan text")


def test_all_types_from_one_scan(spark, tmp_path):
    fields = "#fields\tts\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tquery\tqtype_name\thost\turi\torig_bytes"
    _write(tmp_path / "a.log", HEAD + [fields] + [f"{i}.5\t10.0.0.{i}\t7\t8.8.8.8\t53\tUDP\tq{i}\tA\th{i}\t/x\t{i}" for i in range(5)])
    lines = read_landed_lines(spark, str(tmp_path))
    tagged = registry.read_all_types(lines, "bro")
    assert sorted((r.event_type, r.found) for r in registry.events_found(tagged).collect()) == [("dns", 5), ("http", 5), ("ip", 5)]
    for kind in ("dns", "ip", "http"):
        one = zeek_events(lines, kind).orderBy("ts")
        assert registry.of_type(tagged, kind).orderBy("ts").select(*one.columns).collect() == one.collect()
    # the data is read once for three types; headers lie in a table of their own
    assert tagged._jdf.queryExecution().executedPlan().toString().count("Location: InMemoryFileIndex") == 2
    registry.write_all_types(tagged, f"{tmp_path}/out", ["dns", "http", "ip"])
    out = {(r.event_type, json.loads(r.value).get("query") or json.loads(r.value).get("url") or json.loads(r.value)["bytesOut"]) for r in spark.read.text(f"{tmp_path}/out").collect()}
    assert out == {(k, v) for i in range(5) for k, v in (("dns", f"q{i}"), ("http", f"http://h{i}/x"), ("ip", i))}


def test_all_types_of_eve_records(spark, tmp_path):
    rec = lambda **more: json.dumps({"timestamp": "2024-05-01T10:00:00.000000+0000", "src_ip": "10.0.0.1", "dest_port": 80, "proto": "TCP"} | more)
    _write(tmp_path / "e.json", [rec(dns={"type": "query", "rrname": "a.org", "rrtype": "A"}), rec(dns={"type": "answer", "rrname": "b.org"}),
        rec(http={"hostname": "c.org", "url": "/d"}), rec(), "{broken", rec(dns={"type": "query", "rrname": "e.org"}, http={"hostname": "f.org"})])
    rows = read_lines(spark, str(tmp_path / "e.json"))
    tagged = registry.read_all_types(rows, "suricata", on_error="keep")
    assert _scans(tagged) == 1
    good, bad = split_errors(tagged)
    assert sorted((r.event_type, r.query or r.url) for r in good.collect()) == [("dns", "a.org"), ("dns", "e.org"), ("http", "http://c.org/d"), ("http", "http://f.org")]
    assert [r._raw for r in bad.collect()] == ["{broken"] * 2
    assert registry.read_all_types(rows, "suricata", on_error="skip").count() == 4
    with pytest.raises(Exception, match="not a valid record"):
        registry.read_all_types(rows, "suricata").count()
    with pytest.raises(ValueError, match="holds no"):
        registry.read_all_types(rows, "suricata", ["ip"])


def test_only_mapped_leaves_are_read(spark, tmp_path):
    spark.sql("""SELECT '1' AS id, map('@timestamp', array('2024-05-01T10:00:00Z'), 'event.ingested', array('2024-05-01T10:00:01Z')) AS fields, TIMESTAMP '2024-05-01 10:00:01' AS ingested,
     named_struct('source', named_struct('ip', '10.0.0.1', 'port', 5, 'user', 'u'), 'dns', named_struct('question', named_struct('name', 'a.org', 'class', 'IN'), 'id', 7),
      'big', repeat('x', 100), 'odd.name', named_struct('q', 'b.org')) AS source
     UNION ALL SELECT '2', map('@timestamp', array('2024-05-01T10:00:00Z'), 'event.ingested', array('2024-05-01T10:00:01Z')), TIMESTAMP '2024-05-01 10:00:02',
     named_struct('source', named_struct('ip', '10.0.0.2', 'port', NULL, 'user', 'u'), 'dns', NULL, 'big', 'y', 'odd.name', named_struct('q', 'c.org'))""").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")

    def run(wanted):
        found = decode(search(source_projection(docs, wanted), wanted, F.lit("2000-01-01").cast("timestamp")), wanted)
        plan = found._jdf.queryExecution().executedPlan().toString()
        return [(r.srcIP, r.query, r.qtype) for r in found.orderBy("id").collect()], plan[plan.index("ReadSchema") :].split("\n")[0]

    got, read = run(Search("dns", "ecs"))
    assert got == [("10.0.0.1", "a.org", "")]
    assert "source:struct<source:struct<ip:string,port:int>,dns:struct<question:struct<name:string>>>" in read
    got, read = run(Search("dns", "ecs", fields={"query": "$['odd.name']['q']", "qtype": "no.such.path"}, must_have=("source.ip",)))
    assert got == [("10.0.0.1", "b.org", ""), ("10.0.0.2", "c.org", "")]
    assert "big" not in read and "user" not in read and "odd.name:struct<q:string>" in read


def test_pages_to_the_end_with_equal_times(spark):
    rows = [(f"{i:03d}", "{}", {}, i // 7) for i in range(50)]
    docs = spark.createDataFrame(rows, "id string, source string, fields map<string,array<string>>, s int").select(
        "id", "source", "fields", F.timestamp_seconds("s").alias("ingested"))
    for size, sizes in ((10, [10] * 5), (17, [17, 17, 16]), (50, [50]), (60, [50])):
        paths = {"event_ingested": "event.ingested", "timestamp": "@timestamp", "src_ip": "source.ip", "query": "dns.question.name"}
        wanted = Search("dns", fields=paths, where="true", page_size=size)
        found = [[r.id for r in p.collect()] for p in pages(docs, wanted, F.lit("1969-01-01").cast("timestamp"))]
        assert [len(p) for p in found] == sizes and sum(found, []) == [r[0] for r in rows]


def test_hellos_cut_anywhere_are_read_side_by_side(spark):
    """Whole, cut and odd hellos in one column: each gives its own fields or none, and none is read one by one in Python."""
    import pyarrow as pa

    from wirelight.functions import ja3

    whole = _hello()
    none = dict.fromkeys(["version", "ciphers", "extensions", "curves", "formats"])
    read = {"version": 771, "ciphers": [0x0A0A, 60, 47], "extensions": [0x2A2A, 10, 11], "curves": [23, 0x1A1A, 24], "formats": [0]}
    bare = {"version": 771, "ciphers": [0x0A0A, 60, 47], "extensions": [], "curves": [], "formats": []}
    payloads = [whole, None, b"", whole + b"more", _hello(exts=False), *[whole[:n] for n in range(1, len(whole))], b"\x17" + whole[1:]]
    wanted = [read, none, none, read, bare, *[none] * (len(whole) - 1), none]
    assert ja3._hellos(pa.array(payloads, pa.binary())).to_pylist() == wanted
    # a part of a column, which begins in the midst of its bytes
    assert ja3._hellos(pa.array(payloads, pa.binary())[3:6]).to_pylist() == wanted[3:6]
    # the text is made once, not for a filter as well
    files = spark.createDataFrame([("f", bytearray(_pcap([_ipv4(6, _tcp(whole))])))], "path string, content binary")
    plan = frames_ja3(split_captures(files))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join") == 4
