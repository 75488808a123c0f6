import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from wirelight import schemas
from wirelight.operators.alerts import enrich_alerts
from wirelight.operators.dedup import dedup_last8, flush_batches
from wirelight.sinks.events import dead_letters, entry_json, replay_dead_letters, write_dead_letters
from wirelight.sinks.formats import Product, alert_json, cef_line, format_alerts, gelf_line, leef_line, line_format
from wirelight.sources.alert_pages import explode_pages, parse_pages
from wirelight.sources.scope_file import ScopeGroup
from wirelight.streaming.jobs import tail_to_events

PRODUCT = Product("Acme", "Pipe|Works", "1.0", "h")


def _page(**event):
    return {"follow": "f1", "more": False,
            "alerts": [{"eventType": event.pop("kind"), "event": {"ts": "2018-09-06T14:09:04.123Z", "srcIP": "10.2.3.4", **event},
                        "threats": ["c2_comm", "gone"], "wisdom": {"flags": ["c2", "a=b"], "labels": []}}],
            "threats": {"c2_comm": {"title": "C2 | comm", "severity": 5, "policy": True}}}


def _alerts(spark, *pages):
    lines = spark.createDataFrame([(json.dumps(p),) for p in pages], "value string")
    groups = [ScopeGroup("boston", "Boston", ("10.0.0.0/8",)), ScopeGroup("none", "None", ("11.0.0.0/8",))]
    return enrich_alerts(explode_pages(parse_pages(lines)), groups)


def _lines(df):
    return sorted(r.value for r in df.collect())


def test_cef(spark):
    ip = _page(kind="ip", srcPort=16830, destIP="4.3.2.1", destPort=443, proto="tcp", bytesIn=744, bytesOut=1376)
    dns = _page(kind="dns", query="virus.example", qtype="A")
    head = "CEF:0|Acme|Pipe\\|Works|1.0|"
    common = "rt=Sep 06 2018 14:09:04.123 UTC src=10.2.3.4 cs1=c2,a\\=b cs1Label=flags cs2=boston cs2Label=groups"
    tails = {"dns": "query=virus.example requestMethod=A", "ip": "spt=16830 dst=4.3.2.1 dpt=443 proto=tcp in=744 out=1376"}
    want = [f"{head}{tid}|{desc}|{sev}|app={kind} {common} {tail}" for kind, tail in tails.items()
            for tid, desc, sev in (("c2_comm", "C2 \\| comm", 10), ("gone", "", 0))]
    assert _lines(line_format(lambda: cef_line(PRODUCT))(_alerts(spark, ip, dns))) == sorted(want)


def test_json_leef_gelf(spark):
    alerts = _alerts(spark, _page(kind="dns", query="q", qtype="A", srcPort=0))
    record = json.loads(alert_json(alerts).first().value)
    assert record == {"severity": 5, "threats": {"c2_comm": {"severity": 5, "desc": "C2 | comm", "policy": True}, "gone": {"severity": 0, "desc": ""}},
                      "flags": ["c2", "a=b"], "groups": [{"label": "boston", "desc": "Boston"}], "eventType": "dns",
                      "ts": "2018-09-06T14:09:04.123Z", "srcIP": "10.2.3.4", "query": "q", "qtype": "A"}
    leef = _lines(line_format(lambda: leef_line(PRODUCT))(alerts))[0]
    assert leef.startswith("LEEF:2.0|Acme|Pipe|Works|1.0|c2_comm|sev=10\tpolicy=1\tflags=c2,a=b\t") and "\tdst=<nil>\t" in leef
    now = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    gelf = json.loads(_lines(line_format(lambda: gelf_line(PRODUCT, now))(alerts))[0])
    assert gelf["_original_event"] == "2018-09-06 14:09:04.123 +0000 UTC" and gelf["timestamp"] == 1704067200 and gelf["_dest_ip"] == ""
    with pytest.raises(ValueError):
        format_alerts(alerts, "nope")


def test_empty_page(spark):
    assert _lines(format_alerts(_alerts(spark, {"follow": "x", "more": False}), "cef")) == []


def test_entry_json(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), "10.0.0.1")], "ts timestamp, srcIP string")
    tls = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schemas.TLS_ENTRY.fields])
    assert json.loads(tls.select(entry_json("tls").alias("v")).first().v) == {"ts": "2024-01-01T00:00:00Z", "srcIP": "10.0.0.1", "srcPort": 0}


def test_dedup_and_batches(spark):
    rows = [(i, dt.datetime(2024, 1, 1), "s", q) for i, q in enumerate("abaXcdefghYia" + "a")]
    df = spark.createDataFrame(rows, "seq long, ts timestamp, sensor string, query string")
    kept = dedup_last8(df, ["sensor"], ["seq"], ["query"]).orderBy("seq").collect()
    # "a" comes back once eight other names were kept in between
    assert "".join(r.query for r in kept) == "abXcdefghYia"
    cut = flush_batches(df, "seq", ["sensor"], size=5).orderBy("seq").collect()
    assert [r.batch_no for r in cut] == [i // 5 for i in range(14)]


def test_tail_twice(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    rec = lambda q, s: json.dumps({"timestamp": f"2024-05-01T10:00:{s:02d}.000000+0000", "src_ip": "10.0.0.1", "proto": "UDP",
                                   "dns": {"type": "query", "rrname": q, "rrtype": "A"}})
    (landing / "1.json").write_text("\n".join([rec("a.org", 0), rec("a.org", 5), rec("x.lan", 6), rec("a.org", 50), "{bad"]))
    groups = [ScopeGroup("g", in_scope=("10.0.0.0/8",), trusted_domains=("*.lan",))]

    def run():
        tail_to_events(spark, str(landing), "suricata", "dns", groups, str(tmp_path / "out"), str(tmp_path / "cp"),
                       dead_letter_path=str(tmp_path / "dead"), once=True).awaitTermination()
        return sorted(json.loads(r.value)["ts"][14:19] + json.loads(r.value)["query"] for r in spark.read.text(str(tmp_path / "out")).collect())

    assert run() == ["00:00a.org", "00:50a.org"]
    (landing / "2.json").write_text(rec("b.org", 7))
    assert run() == ["00:00a.org", "00:07b.org", "00:50a.org"]
    assert spark.read.parquet(str(tmp_path / "dead" / "batch_id=0")).count() == 1


def test_dead_letters(spark, tmp_path):
    bad = spark.createDataFrame([("line", "why", "f")], "_raw string, _error string, source_file string")
    write_dead_letters(dead_letters(bad, "dns"), str(tmp_path / "d"))
    assert [r.value for r in replay_dead_letters(spark, str(tmp_path / "d"), "dns").collect()] == ["line"]
