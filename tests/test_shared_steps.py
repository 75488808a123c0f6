"""Work that several event types or sinks share is done once."""

import datetime as dt
import json

from pyspark.sql import functions as F

from wirelight.functions.times import wire_time
from wirelight.operators.alerts import enrich_alerts
from wirelight.plans import alert_queries, stream_queries
from wirelight.sinks.events import write_alerts
from wirelight.sinks.formats import per_threat
from wirelight.sources import registry
from wirelight.sources.alert_pages import explode_pages, parse_pages, stream_pages
from wirelight.sources.lines import read_landed_lines, split_errors
from wirelight.sources.scope_file import ScopeGroup
from wirelight.sources.zeek import zeek_events
from wirelight.streaming.jobs import follow_alerts


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


FIELDS = ["ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "query", "qtype_name", "orig_bytes", "host", "uri", "status_code"]


def _log(path, rows):
    path.write_text("\n".join(["#separator \\x09", "#unset_field\t-", "#fields\t" + "\t".join(FIELDS), *("\t".join(r) for r in rows)]) + "\n")


def _row(i, source="10.0.0.1", dest="2600:0:0::5", port="7", count="4", status="200"):
    return [f"{i}.5", source, port, dest, "53", "UDP", f"q{i}", "-", count, "h", "/x", status]


def test_lines_are_read_once_for_all_types(spark, tmp_path):
    _log(tmp_path / "a.log", [_row(i, source) for i, source in enumerate(["10.0.0.1", "FD00:0::1", "10.300.1.1", "-", "::ffff:9.9.9.9"])])
    lines = read_landed_lines(spark, str(tmp_path))
    tagged = registry.read_all_types(lines, "bro")
    plan = _plan(tagged)
    # addresses and times are worked out below the generator, which no filter repeats
    events = plan.index("inline(array(_event_0")
    assert plan.count("size(") == plan[events:].count("size(") and "size(array" not in plan and "size(knownnot" not in plan
    assert "regexp" not in plan[:events].lower() and "rlike" not in plan[:events].lower()
    for kind in ("dns", "ip", "http"):
        one = zeek_events(lines, kind)
        assert sorted(map(str, registry.of_type(tagged, kind).select(*one.columns).collect())) == sorted(map(str, one.collect()))
    shown = {r.srcIP for r in tagged.collect()}
    assert shown == {"10.0.0.1", "fd00::1", None, "9.9.9.9", "::ffff:9.9.9.9"} & shown and len(shown) == 4


def test_bad_cells_are_told_in_every_type(spark, tmp_path):
    bad = [_row(1, port="70000"), _row(2, count="x"), _row(3, status="y"), _row(4)[:-1], ["5", *_row(5)[1:]], _row(6, status="-"), _row(7)]
    _log(tmp_path / "a.log", bad)
    lines = read_landed_lines(spark, str(tmp_path))
    for on_error in ("keep", "skip"):
        tagged = registry.read_all_types(lines, "bro", on_error=on_error)
        for kind in ("dns", "ip", "http"):
            one = zeek_events(lines, kind, on_error=on_error)
            assert sorted(map(str, registry.of_type(tagged, kind).select(*one.columns).collect())) == sorted(map(str, one.collect()))
    good, wrong = split_errors(registry.read_all_types(lines, "bro", on_error="keep"))
    assert sorted((r.event_type, r.n) for r in good.groupBy("event_type").agg(F.count("*").alias("n")).collect()) == [("dns", 4), ("http", 3), ("ip", 3)]
    assert wrong.count() == 21 - 10


def test_events_are_written_by_type_without_a_sort(spark, tmp_path, monkeypatch):
    _log(tmp_path / "a.log", [_row(i) for i in range(20)])
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before, seen = spark.conf.get(name), []
    monkeypatch.setattr(registry, "entry_json", lambda kind, columns: seen.append(kind) or F.lit(kind))
    plans = []
    from pyspark.sql.readwriter import DataFrameWriter

    text = DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, *a, **b: plans.append(spark.conf.get(name)) or text(self, *a, **b))
    registry.write_all_types(registry.read_all_types(read_landed_lines(spark, str(tmp_path / "a.log")), "bro"), f"{tmp_path}/out", ["dns", "http", "ip"])
    # with as many as there are types, Spark would go back to sorting at the last one
    assert plans == ["4"] and spark.conf.get(name) == before
    assert sorted((r.event_type, r["count"]) for r in spark.read.text(f"{tmp_path}/out").groupBy("event_type").count().collect()) == [("dns", 20), ("http", 20), ("ip", 20)]


def test_wire_times(spark):
    utc = dt.timezone.utc
    times = [dt.datetime(2024, 5, 1, 10, 0, tzinfo=utc), dt.datetime(2024, 5, 1, 10, 0, 0, 500000, utc), dt.datetime(1, 2, 3, 4, 5, 6, 7, utc),
             dt.datetime(1969, 12, 31, 23, 59, 59, 999990, utc), None]
    rows = spark.createDataFrame([(t,) for t in times], "t timestamp")
    assert [r[0] for r in rows.select(wire_time("t")).collect()] == [
        "2024-05-01T10:00:00Z", "2024-05-01T10:00:00.5Z", "0001-02-03T04:05:06.000007Z", "1969-12-31T23:59:59.99999Z", None]
    far = spark.sql("SELECT timestamp_micros(253402300800000000) AS t")
    old = F.concat(F.regexp_replace(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", ""), F.lit("Z"))
    assert far.select(wire_time("t").alias("a"), old.alias("b")).where("a = b").count() == 1


GROUPS = [ScopeGroup("g", "G", ("10.0.0.0/8",))]


def _alert_pages(spark, n):
    page = lambda i: {"follow": "f", "more": False, "alerts": [
        {"eventType": "ip", "event": {"ts": "2024-05-01T10:00:00Z", "srcIP": f"10.0.{i % 250}.1", "destIP": "8.8.8.8"}, "threats": ["a", "b"], "wisdom": {"flags": ["c2"], "labels": []}}],
        "threats": {"a": {"title": "A", "severity": 3, "policy": True}}}
    return spark.createDataFrame([(json.dumps(page(i)),) for i in range(n)], "value string")


def _files(folder):
    """(bytes, names) of the data files."""
    found = [f for f in folder.rglob("part-*") if f.is_file()]
    return sum(f.stat().st_size for f in found), [f.name for f in found]


def _read(spark, path):
    return sorted(r.value for r in spark.read.text(str(path)).select("value").collect())


def test_compressed_alert_lines_are_the_same_lines(spark, tmp_path):
    pages = _alert_pages(spark, 400).coalesce(1)
    alerts = enrich_alerts(explode_pages(parse_pages(pages)), GROUPS)
    for kind in ("none", "gzip"):
        write_alerts(alerts, {f: f"{tmp_path}/{kind}/{f}" for f in ("cef", "json")}, 0, *([] if kind == "none" else [kind]))
    for f, lines in (("cef", 800), ("json", 400)):
        plain, packed = _read(spark, tmp_path / "none" / f), _read(spark, tmp_path / "gzip" / f)
        assert plain == packed and len(plain) == lines
        (size, names), (small, gz) = _files(tmp_path / "none" / f), _files(tmp_path / "gzip" / f)
        assert small * 5 < size and all(n.endswith(".txt") for n in names) and all(n.endswith(".gz") for n in gz)


def test_followed_pages_and_lines_may_be_compressed(spark, tmp_path):
    pages = _alert_pages(spark, 60).coalesce(2)
    for kind in ("none", "gzip"):
        pages.write.option("compression", kind).text(f"{tmp_path}/{kind}/pages")
        follow_alerts(stream_pages(spark, f"{tmp_path}/{kind}/pages"), GROUPS, {"cef": f"{tmp_path}/{kind}/cef"}, f"{tmp_path}/{kind}/check", once=True,
                      **({} if kind == "none" else {"compression": kind})).awaitTermination()
    assert _read(spark, tmp_path / "none/cef") == _read(spark, tmp_path / "gzip/cef") and len(_read(spark, tmp_path / "gzip/cef")) == 120
    # a batch that runs again replaces its files, compressed or not
    alerts = enrich_alerts(explode_pages(parse_pages(pages)), GROUPS)
    write_alerts(alerts, {"cef": f"{tmp_path}/gzip/cef"}, 0)
    assert len(_read(spark, tmp_path / "gzip/cef")) == 120


def test_queries_keep_alert_lines_and_pages_compressed(spark, sf_dir, tmp_path, monkeypatch):
    for plans in (alert_queries, stream_queries):
        monkeypatch.setattr(plans, "work_dir", lambda _, name: f"{tmp_path}/{name}")
    found = {r.sink: r.lines for r in alert_queries.several_sinks(spark, sf_dir).collect()}
    assert found["json"] == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert stream_queries.followed(spark, sf_dir).first().lines == found["cef"]
    for folder in ("cef", "json", "pages", "follow/cef"):
        names = _files(tmp_path / folder)[1]
        assert names and all(n.endswith(".gz") for n in names)


def test_line_items_are_shuffled_by_order_as_they_are(spark, sf_dir):
    plan = alert_queries._alert_rows(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(l_orderkey") == 1
    assert plan.index("partial_collect_set") < plan.index("hashpartitioning(l_orderkey")


def test_threats_are_looked_up_once_for_lines(spark):
    alerts = enrich_alerts(explode_pages(parse_pages(_alert_pages(spark, 3))), GROUPS)
    lines = per_threat(alerts.unionByName(alerts.withColumn("threats", F.map_filter("threats", lambda k, _: k == "none"))))
    assert _plan(per_threat(alerts)).count("map_from_entries") == 1 and lines.count() == 6


def test_landed_lines_of_compressed_files_are_cut_not_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_queries, "work_dir", lambda _, name: f"{tmp_path}/{name}")
    lines = spark.range(250_000).select(F.col("id").cast("string").alias("value")).coalesce(1)
    assert spark.read.text(stream_queries._landed(lines, "a", "gzip")).distinct().count() == 250_000
    assert len(_files(tmp_path / "a")[1]) == 3
    assert spark.read.text(stream_queries._landed(lines, "b")).count() == 250_000 and len(_files(tmp_path / "b")[1]) == 1
