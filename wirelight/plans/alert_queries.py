"""Alerts made from orders, their line items and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelight import schemas
from wirelight.functions.times import wire_time
from wirelight.operators.alerts import alert_threats, enrich_alerts, join_catalogue
from wirelight.operators.projections import to_dns_entry, to_ip_entry
from wirelight.plans.registry import query
from wirelight.plans.scope_queries import GROUPS, _group_tests
from wirelight.plans.views import ALERT_EVENT, KNOWN_THREAT, THREAT, read_table, view, view_sql
from wirelight.sinks.events import events_ndjson, write_alerts
from wirelight.sinks.formats import (
    Product, alert_json, cef_line, format_alerts, gelf_line, leef_line, line_format, per_threat, register_formatter,
)
from wirelight.sources.alert_pages import catalogue_entries, explode_pages, parse_pages
from wirelight.session import work_dir

_PRODUCT = Product("Acme", "Sensor|1", "1.2.3", "host-1")


def _alert_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One alert per order: event, threat ids (part brands) and its page's catalogue."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey")
    listed = items.join(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    # an order has a handful of line items; ids alone are shuffled, as they are: sets of one or two are longer than their ids.
    # What the catalogue says of them is worked out behind
    per_order = listed.select("l_orderkey", "p_brand").repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("threats"))
    entry = ", ".join(f"'{name}', {expr}".replace("p_brand", "b") for name, expr in THREAT.items() if name != "id")
    known = f"transform(filter(threats, b -> {KNOWN_THREAT.replace('p_brand', 'b')}), b -> struct(b AS id, named_struct({entry}) AS t))"
    per_order = per_order.withColumn("catalogue", F.expr(f"map_from_entries({known})"))
    # orders are joined as they are stored, their longer texts are made behind the shuffle
    joined = read_table(spark, sf, "orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    alerts = joined.selectExpr(*[f"{expr} AS {column}" for column, expr in ALERT_EVENT.items()], "threats", "catalogue")
    fields = [(F.col(n) if n in alerts.columns else F.lit(None)).alias(n) for n in schemas.UNIFIED_EVENT.names]
    none = F.array().cast("array<string>")
    return alerts.select(
        "alert_id", F.lit("f").alias("follow"), "eventType", F.struct(*fields).cast(schemas.UNIFIED_EVENT).alias("event"),
        F.coalesce("threats", none).alias("threats"),
        F.struct(F.array("flag").alias("flags"), none.alias("labels")).alias("wisdom"), "catalogue")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Alert pages as JSON text, one alert each."""
    alerts = _alert_rows(spark, sf)
    event = F.col("event").withField("ts", wire_time("event.ts"))
    page = F.struct("follow", F.lit(False).alias("more"), F.array(F.struct("eventType", event.alias("event"), "threats", "wisdom")).alias("alerts"),
                    F.col("catalogue").alias("threats"))
    return alerts.select(F.to_json(page).alias("value"))


_B = "CAST(substr(p_brand, 7) AS INTEGER)"
_ALERT_THREATS = f"""(SELECT DISTINCT l_orderkey, p_brand AS id, CASE WHEN {_B} % 9 <> 0 THEN {_B} % 6 ELSE 0 END AS sev,
 CASE WHEN {_B} % 9 <> 0 THEN concat('Threat | ', p_brand) ELSE '' END AS title, CASE WHEN {_B} % 9 <> 0 THEN {_B} % 2 = 0 ELSE false END AS policy
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_LABELS = "concat_ws(',', " + ", ".join(f"CASE WHEN {m} AND NOT {x} THEN '{g}' END" for g, (m, x) in sorted(_group_tests('"srcIP"').items())) + ")"
_LINES = f"(SELECT a.*, t.*, {_LABELS} AS labels FROM {view_sql('alert')} a JOIN {_ALERT_THREATS} t ON t.l_orderkey = a.alert_id)"


@query("s19_alert_pages", f"""SELECT "eventType", epoch_us(ts) AS ts, "srcIP", coalesce(threats, '') AS threats FROM {view_sql('alert')} a LEFT JOIN
 (SELECT l_orderkey, string_agg(id, ',' ORDER BY id) AS threats FROM {_ALERT_THREATS} GROUP BY l_orderkey) t ON t.l_orderkey = a.alert_id""")
def pages(spark: SparkSession, sf: str) -> DataFrame:
    alerts = explode_pages(parse_pages(_pages(spark, sf)))
    return alerts.select("eventType", F.unix_micros("event.ts").alias("ts"), F.col("event.srcIP").alias("srcIP"),
                         F.array_join(F.array_sort("threats"), ",").alias("threats"))


_PER_ALERT = f"""SELECT alert_id, coalesce(list, '') AS threats, coalesce(sev, 0) AS severity FROM {view_sql('alert')} LEFT JOIN
 (SELECT l_orderkey, max(sev) AS sev, string_agg(concat(id, '=', CAST(sev AS VARCHAR), '/', title, '/', CAST(policy AS VARCHAR)), ',' ORDER BY id) AS list
 FROM {_ALERT_THREATS} GROUP BY l_orderkey) ON l_orderkey = alert_id"""


def _spelled(threats: DataFrame) -> DataFrame:
    entries = F.transform(F.map_entries("threats"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"]["severity"].cast("string"), F.lit("/"), e["value"]["desc"], F.lit("/"), e["value"]["policy"].cast("string")))
    return threats.select("alert_id", F.array_join(entries, ",").alias("threats"), "severity")


@query("j10_alert_threats", _PER_ALERT)
def threats_of_page(spark: SparkSession, sf: str) -> DataFrame:
    """Threats looked up in the alert's own page."""
    return _spelled(alert_threats(_alert_rows(spark, sf)))


@query("j10_catalogue_join", _PER_ALERT)
def threats_of_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Threats joined from a catalogue table."""
    parts = spark.read.parquet(f"{sf}/part.parquet").where(KNOWN_THREAT)
    table = parts.selectExpr(*[f"{e} AS {n}" for n, e in THREAT.items()]).distinct()
    return _spelled(join_catalogue(_alert_rows(spark, sf), "alert_id", "threats", table))


@query("a02_alert_severity", f"""SELECT severity, count(*) AS alerts FROM ({_PER_ALERT}) GROUP BY severity""")
def severities(spark: SparkSession, sf: str) -> DataFrame:
    return alert_threats(_alert_rows(spark, sf)).groupBy("severity").agg(F.count("*").alias("alerts"))


@query("a03_threat_map", f"SELECT DISTINCT p_brand AS id, concat('Threat | ', p_brand) AS title, {_B} % 6 AS severity, {_B} % 2 = 0 AS policy FROM part JOIN lineitem ON p_partkey = l_partkey WHERE {_B} % 9 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)")
def threat_maps(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue all pages together carry."""
    return catalogue_entries(parse_pages(_pages(spark, sf)))


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrich_alerts(_alert_rows(spark, sf), GROUPS)


@query("j11_alert_groups", f"SELECT \"srcIP\", \"srcPort\", {_LABELS} AS labels FROM {view_sql('alert')}")
def alert_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf).select("srcIP", "srcPort", F.array_join(F.col("groups.label"), ",").alias("labels"))


_TS = "strftime(ts, '{}')".format
_ESC = "replace(replace(replace({}, chr(92), chr(92) || chr(92)), '=', chr(92) || '='), chr(10), chr(92) || 'n')".format
_CEF = f"""concat('CEF:0|Acme|Sensor', chr(92), '|1|1.2.3|', id, '|', replace(title, '|', chr(92) || '|'), '|', CAST(sev * 2 AS VARCHAR), '|app=', "eventType", ' rt=', {_TS('%b %d %Y %H:%M:%S.000 UTC')},
 ' src=', "srcIP", ' cs1=', {_ESC('flag')}, ' cs1Label=flags', CASE WHEN labels <> '' THEN concat(' cs2=', labels, ' cs2Label=groups') ELSE '' END,
 CASE "eventType" WHEN 'dns' THEN concat(' query=', "query", ' requestMethod=', qtype) WHEN 'ip' THEN concat(' spt=', CAST("srcPort" AS VARCHAR), ' dst=', "destIP", ' dpt=', CAST("destPort" AS VARCHAR),
 ' proto=', proto, ' in=', CAST("bytesIn" AS VARCHAR), ' out=', CAST("bytesOut" AS VARCHAR)) ELSE '' END)"""


@query("k03_alert_cef", f"SELECT {_CEF} AS value FROM {_LINES}")
def cef(spark: SparkSession, sf: str) -> DataFrame:
    return line_format(lambda: cef_line(_PRODUCT))(_enriched(spark, sf))


_LEEF_PARTS = [("sev", "CAST(sev * 2 AS VARCHAR)"), ("policy", "CASE WHEN policy THEN '1' ELSE '0' END"), ("flags", "flag"), ("description", "title"),
               ("devTimeFormat", "'MMM dd yyyy HH:mm:ss'"), ("devTime", _TS("%b %d %Y %H:%M:%S")), ("proto", "proto"), ("src", '"srcIP"'), ("srcPort", 'CAST("srcPort" AS VARCHAR)'),
               ("dst", '"destIP"'), ("dstPort", 'CAST("destPort" AS VARCHAR)'), ("srcBytes", 'CAST("bytesIn" AS VARCHAR)'), ("dstBytes", 'CAST("bytesOut" AS VARCHAR)'),
               ("query", '"query"'), ("recordType", "qtype")]
_LEEF = "concat('LEEF:2.0|Acme|Sensor|1|1.2.3|', id, '|', " + ", ".join(f"'{k}=', {e}, chr(9)" for k, e in _LEEF_PARTS) + ")"


@query("k04_alert_leef", f"SELECT {_LEEF} AS value FROM {_LINES}")
def leef(spark: SparkSession, sf: str) -> DataFrame:
    return line_format(lambda: leef_line(_PRODUCT))(_enriched(spark, sf))


_GELF = f"""concat('{{"_bytes_in":', CAST("bytesIn" AS VARCHAR), ',"_bytes_out":', CAST("bytesOut" AS VARCHAR), ',"_dest_ip":"', "destIP", '","_dest_port":', CAST("destPort" AS VARCHAR),
 ',"_engine_agent":"Acme Sensor|1/1.2.3","_flags":"', flag, '","_ja3":"","_original_event":"', {_TS('%Y-%m-%d %H:%M:%S')}, ' +0000 UTC","_policy":"', CAST(policy AS VARCHAR), '","_protocol":"', proto,
 '","_query":"', "query", '","_record_type":"', qtype, '","_severity":', CAST(sev AS VARCHAR), ',"_src_ip":"', "srcIP", '","_src_port":', CAST("srcPort" AS VARCHAR), ',"_threat":"', id,
 '","full_message":"","host":"host-1","level":1,"short_message":"', title, '","timestamp":1704067200,"version":"1.1"}}')"""


@query("k05_alert_gelf", f"SELECT {_GELF} AS value FROM {_LINES}")
def gelf(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    return line_format(lambda: gelf_line(_PRODUCT, now))(_enriched(spark, sf))


_JSON = f"""SELECT concat('{{"severity":', CAST(severity AS VARCHAR), ',"threats":{{', coalesce(threats, ''), '}},"flags":["', flag, '"],"groups":[', groups, '],"eventType":"', "eventType", '","ts":"', {_TS('%Y-%m-%dT%H:%M:%SZ')},
 '","srcIP":"', "srcIP", '","srcPort":', CAST("srcPort" AS VARCHAR), CASE WHEN "bytesIn" > 0 THEN concat(',"bytesIn":', CAST("bytesIn" AS VARCHAR)) ELSE '' END,
 CASE WHEN "bytesOut" > 0 THEN concat(',"bytesOut":', CAST("bytesOut" AS VARCHAR)) ELSE '' END, ',"query":"', "query", '","qtype":"A","destIP":"', "destIP", '","destPort":443,"proto":"tcp"}}') AS value
 FROM (SELECT a.*, coalesce(t.sev, 0) AS severity, t.threats, CASE WHEN {_LABELS} LIKE '%core%' THEN CASE WHEN {_LABELS} LIKE 'branch%' THEN '{{"label":"branch","desc":"Branch offices"}},' ELSE '' END || '{{"label":"core","desc":"Core"}}'
 WHEN {_LABELS} = 'branch' THEN '{{"label":"branch","desc":"Branch offices"}}' ELSE '' END AS groups FROM {view_sql('alert')} a LEFT JOIN (SELECT l_orderkey, max(sev) AS sev,
 string_agg(concat('"', id, '":{{"severity":', CAST(sev AS VARCHAR), ',"desc":"', title, '"', CASE WHEN policy THEN ',"policy":true' ELSE '' END, '}}'), ',' ORDER BY id) AS threats
 FROM {_ALERT_THREATS} GROUP BY l_orderkey) t ON t.l_orderkey = a.alert_id)"""


@query("k02_alert_json", _JSON)
def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    return alert_json(_enriched(spark, sf))


@query("k06_multi_sink", f"SELECT 'cef' AS sink, count(*) AS lines FROM {_LINES} UNION ALL SELECT 'json', count(*) FROM {view_sql('alert')}")
def several_sinks(spark: SparkSession, sf: str) -> DataFrame:
    """The same alerts written to two folders; lines in each."""
    out = {name: work_dir(spark, name) for name in ("cef", "json")}
    write_alerts(_enriched(spark, sf), out, 0, "gzip")
    counts = [spark.read.text(path).agg(F.lit(name).alias("sink"), F.count("*").alias("lines")) for name, path in out.items()]
    return counts[0].unionByName(counts[1])


@query("u02_register_formatter", f"SELECT concat(id, ' ', \"srcIP\", ' ', CAST(sev AS VARCHAR)) AS value FROM {_LINES}")
def user_formatter(spark: SparkSession, sf: str) -> DataFrame:
    """An alert format of the user's own."""
    register_formatter("brief", lambda alerts: per_threat(alerts).select(
        F.concat_ws(" ", "threatId", "srcIP", F.col("threat.severity").cast("string")).alias("value")))
    return format_alerts(_enriched(spark, sf), "brief")


_FRACTION = "CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE rtrim('.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0'), '0') END"


@query("k01_events_ndjson", f"""SELECT concat('{{"ts":"', strftime(ts, '%Y-%m-%dT%H:%M:%S'), {_FRACTION}, 'Z","srcIP":"', "srcIP", '","query":"', "query", '","qtype":"', qtype, '"}}') AS value FROM {view_sql('dns')}
 UNION ALL SELECT concat('{{"ts":"', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '","srcIP":"', coalesce("srcIP", ''), '","srcPort":', CAST("srcPort" AS VARCHAR), ',"destIP":"', "destIP", '","destPort":', CAST("destPort" AS VARCHAR),
 ',"proto":"', proto, '","bytesIn":', CASE WHEN direction = 'in' THEN CAST("bytesCount" AS VARCHAR) ELSE '0' END, ',"bytesOut":', CASE WHEN direction = 'in' THEN '0' ELSE CAST("bytesCount" AS VARCHAR) END, ',"ja3":"', ja3, '"}}')
 FROM {view_sql('conn')}""")
def ndjson(spark: SparkSession, sf: str) -> DataFrame:
    dns = events_ndjson(to_dns_entry(view(spark, sf, "dns")), "dns")
    return dns.unionByName(events_ndjson(to_ip_entry(view(spark, sf, "conn")), "ip"))
