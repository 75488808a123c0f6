"""Log formats and captures: text made from the views, parsed back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelight.functions.columns import derive_once
from wirelight.functions.ip import with_ip_keys
from wirelight.functions.ja3 import frames_ja3
from wirelight.operators.projections import with_direction, with_sensor_direction
from wirelight.plans.registry import query
from wirelight.plans.scope_queries import _us
from wirelight.plans.views import valid4, valid_ip, view, view_sql
from wirelight.sources import registry
from wirelight.session import work_dir
from wirelight.sources.lines import number_lines, read_landed_lines, split_errors
from wirelight.sources.capture_ranges import pcap_frames
from wirelight.sources.pcap import joined_records, split_captures
from wirelight.sources.zeek import header_fill, zeek_scan


def _epoch(ts: str = "ts") -> Column:
    us = F.unix_micros(ts)
    return F.concat((us / 1000000).cast("bigint").cast("string"), F.lit("."),
                    F.lpad(F.pmod(us, F.lit(1000000)).cast("string"), 6, "0"))


def _or_dash(column: str) -> Column:
    return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("-"))


def _zeek_lines(rows: DataFrame, names: list[str], cells: list[Column], seq: str, late: list[str] | None = None) -> DataFrame:
    """Zeek text, a file per sensor: header lines, then a row's cells.

    Odd sensors use commas and reversed columns; ``late`` header lines come back
    before the rows whose number is high.
    """
    odd = F.col("sensor").isin("s1", "s3", "s5", "s7")
    tab = ["#separator \\x09", "#empty_field\t(empty)", "#unset_field\t-", "#fields\t" + "\t".join(names)]
    comma = ["#separator \\x2c", "#unset_field,-", "#fields," + ",".join(reversed(names))]
    body = F.when(odd, F.concat_ws(",", *reversed(cells))).otherwise(F.concat_ws("\t", *cells))
    data = rows.select(body.alias("value"), F.col("sensor").alias("source_file"), F.lit(0).cast("bigint").alias("block_start"),
                       F.col(seq).alias("line_no"))
    heads = rows.select("sensor").distinct()
    lines = F.when(odd, F.array(*map(F.lit, comma))).otherwise(F.array(*map(F.lit, tab)))
    heads = heads.select(F.posexplode(lines).alias("n", "value"), F.col("sensor").alias("source_file"))
    heads = heads.select("value", "source_file", F.lit(0).cast("bigint").alias("block_start"),
                         (F.col("n") - 1000).cast("bigint").alias("line_no"))
    return heads.unionByName(data)


def _zeek_files(lines: DataFrame) -> str:
    """The lines as a folder of text files, one per sensor."""
    path = work_dir(lines.sparkSession, "zeek-files")
    lines.repartition("source_file").sortWithinPartitions("source_file", "line_no").select("value", F.col("source_file").alias("sensor")).write.partitionBy("sensor").text(path)
    return path


def _sensor() -> Column:
    return F.regexp_extract("source_file", "/sensor=([^/]+)/", 1)


_DNS_NAMES = ["ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "query", "qtype_name"]


def _zeek_dns_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "dns")
    cells = [_epoch(), F.col("srcIP"), F.col("srcPort").cast("string"), F.col("destIP"), F.lit("53"), F.upper("proto"),
             F.col("query"), F.when(F.col("qtype") == "TXT", "-").otherwise(F.col("qtype"))]
    return _zeek_lines(rows, _DNS_NAMES, cells, "event_id")


@query("s01_zeek_scan", f"""SELECT sensor AS source_file, row_number() OVER (PARTITION BY sensor ORDER BY event_id) + CASE WHEN sensor IN ('s1', 's3', 's5', 's7') THEN 3 ELSE 4 END AS line_no,
 8 AS columns, "query", CAST("srcPort" AS VARCHAR) AS port FROM {view_sql('dns')}""")
def scan(spark: SparkSession, sf: str) -> DataFrame:
    """Files read line by line, numbered in their file."""
    out = zeek_scan(number_lines(read_landed_lines(spark, _zeek_files(_zeek_dns_lines(spark, sf)))))
    return out.select(_sensor().alias("source_file"), "line_no", F.size("fields").alias("columns"), F.col("fields")["query"].alias("query"),
                      F.col("fields")["id.orig_p"].alias("port"))


@query("w01_header_fill", f"""SELECT sensor AS source_file, 'query' AS wanted, CASE WHEN sensor IN ('s1', 's3', 's5', 's7') THEN ',' ELSE chr(9) END AS sep,
 8 AS width FROM {view_sql('dns')} GROUP BY sensor""")
def headers(spark: SparkSession, sf: str) -> DataFrame:
    """The complete header of each file."""
    out = header_fill(read_landed_lines(spark, _zeek_files(_zeek_dns_lines(spark, sf)))).where(F.size("fields") > 0)
    wanted = F.when(F.array_contains("fields", "query"), "query")
    return out.select(_sensor().alias("source_file"), wanted.alias("wanted"), "sep", F.size("fields").alias("width"))


_DNS_OUT = "epoch_us(ts) AS ts, \"srcIP\", \"srcPort\", proto, \"query\", CASE WHEN qtype = 'TXT' THEN '' ELSE qtype END AS qtype"


@query("s02_zeek_dns", f"SELECT {_DNS_OUT} FROM {view_sql('dns')}")
def zeek_dns(spark: SparkSession, sf: str) -> DataFrame:
    out = registry.read_events(spark, _zeek_files(_zeek_dns_lines(spark, sf)), "bro", "dns")
    return _us(out.select("ts", "srcIP", "srcPort", "proto", "query", "qtype"), "ts")


_CONN_NAMES = ["ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "orig_bytes", "resp_bytes", "orig_ip_bytes", "ja3"]


def _zeek_conn_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "conn")
    cells = [_epoch(), _or_dash("srcIP"), F.col("srcPort").cast("string"), F.col("destIP"), F.col("destPort").cast("string"),
             F.upper("proto"), F.lit("-"), F.col("bytesCount").cast("string"), F.lit("-7"), _or_dash("ja3")]
    return _zeek_lines(rows, _CONN_NAMES, cells, "conn_id")


@query("s03_zeek_conn", f"""SELECT epoch_us(ts) AS ts, CASE WHEN {valid_ip('"srcIP"')} THEN "srcIP" END AS "srcIP", "srcPort", "destIP", "destPort", proto, "bytesCount", ja3
 FROM {view_sql('conn')}""")
def zeek_conn(spark: SparkSession, sf: str) -> DataFrame:
    out = registry.read_events(spark, _zeek_files(_zeek_conn_lines(spark, sf)), "bro", "ip")
    return _us(out.select("ts", "srcIP", "srcPort", "destIP", "destPort", "proto", "bytesCount", "ja3"), "ts")


@query("s04_zeek_http", f"""SELECT epoch_us(ts) AS ts, "srcIP", "srcPort", concat('http://h', CAST(page_id AS VARCHAR), '.org/p?', CAST(page_id AS VARCHAR)) AS url, method,
 status, "bytesIn", page_id AS "bytesOut", "userAgent", '' AS referrer FROM {view_sql('http')}""")
def zeek_http(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "http").withColumn("sensor", F.concat(F.lit("s"), (F.col("page_id") % 4).cast("string")))
    page = F.col("page_id").cast("string")
    cells = [_epoch(), F.col("srcIP"), F.col("srcPort").cast("string"), F.col("method"), F.concat(F.lit("h"), page, F.lit(".org")),
             F.concat(F.lit("/p?"), page), F.lit("-"), F.col("userAgent"), page, F.col("bytesIn").cast("string"), F.col("status").cast("string")]
    names = ["ts", "id.orig_h", "id.orig_p", "method", "host", "uri", "referrer", "user_agent", "request_body_len", "response_body_len", "status_code"]
    out = registry.read_events(spark, _zeek_files(_zeek_lines(rows, names, cells, "page_id")), "bro", "http")
    return _us(out.select("ts", "srcIP", "srcPort", "url", "method", "status", "bytesIn", "bytesOut", "userAgent", "referrer"), "ts")


def _eve_time() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx")


def eve_dns_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "dns")
    kind = F.when(F.col("event_id") % 4 == 3, "answer").otherwise("query")
    record = F.struct(
        _eve_time().alias("timestamp"), F.col("srcIP").alias("src_ip"), F.col("srcPort").alias("src_port"), F.lit(53).alias("dest_port"),
        F.upper("proto").alias("proto"), F.struct(kind.alias("type"), F.col("query").alias("rrname"), F.col("qtype").alias("rrtype")).alias("dns"),
    )
    return rows.select(F.to_json(record).alias("value"), F.col("sensor").alias("source_file"))


@query("s05_suricata_dns", f"SELECT epoch_us(ts) AS ts, \"srcIP\", 53 AS \"destPort\", proto, \"query\", qtype FROM {view_sql('dns')} WHERE event_id % 4 <> 3")
def suricata_dns(spark: SparkSession, sf: str) -> DataFrame:
    out = registry.parse(eve_dns_lines(spark, sf), "suricata", "dns")
    return _us(out.select("ts", "srcIP", "destPort", "proto", "query", "qtype"), "ts")


def eve_http_lines(spark: SparkSession, sf: str) -> DataFrame:
    host = F.when(F.col("page_id") % 5 != 4, F.concat(F.lit("h"), F.col("page_id").cast("string")))
    port = F.when(F.col("page_id") % 3 == 0, 80).when(F.col("page_id") % 3 == 1, 443).otherwise(8080)
    record = F.struct(
        _eve_time().alias("timestamp"), F.col("srcIP").alias("src_ip"), F.col("srcPort").alias("src_port"), port.alias("dest_port"), F.lit("TCP").alias("proto"),
        F.struct(host.alias("hostname"), F.lit("/a//x/../b/").alias("url"), F.col("method").alias("http_method"), "status",
                 F.col("userAgent").alias("http_user_agent")).alias("http"),
    )
    file = F.concat(F.lit("h"), (F.col("page_id") % 4).cast("string"))
    return view(spark, sf, "http").select(F.to_json(record).alias("value"), file.alias("source_file"))


@query("s06_suricata_http", f"""SELECT epoch_us(ts) AS ts, "srcIP", "srcPort", concat(CASE page_id % 3 WHEN 0 THEN 'http://' WHEN 1 THEN 'https://' ELSE '' END, 'h', CAST(page_id AS VARCHAR), '/a/b') AS url,
 method, status, "userAgent" FROM {view_sql('http')} WHERE page_id % 5 <> 4""")
def suricata_http(spark: SparkSession, sf: str) -> DataFrame:
    out = registry.parse(eve_http_lines(spark, sf), "suricata", "http")
    return _us(out.select("ts", "srcIP", "srcPort", "url", "method", "status", "userAgent"), "ts")


@query("s07_msdns_dns", f"SELECT epoch_us(date_trunc('second', ts)) AS ts, \"srcIP\", proto, \"query\", qtype FROM {view_sql('dns')} WHERE event_id % 4 <> 3")
def msdns(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "dns")
    stamp = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd H:mm:ss")).otherwise(F.date_format("ts", "yyyy/MM/dd h:mm:ss a"))
    way = F.when(F.col("event_id") % 4 == 3, "Snd").otherwise("Rcv")
    name = F.concat(F.lit("(3)"), F.replace("query", F.lit("."), F.lit("(4)")), F.lit("(0)"))
    line = F.concat_ws(" ", stamp, F.lit("0F10 PACKET  00AB12"), F.upper("proto"), way, "srcIP", F.lit("00aa Q [0001   D   NOERROR]"), "qtype", name)
    out = registry.parse(rows.select(line.alias("value"), F.col("sensor").alias("source_file")), "msdns", "dns")
    return _us(out.select("ts", "srcIP", "proto", "query", "qtype"), "ts")


@query("s08_named_dns", f"SELECT epoch_us(date_trunc('second', ts)) AS ts, \"srcIP\", 'udp' AS proto, \"query\", qtype FROM {view_sql('dns')}")
def named(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "dns")
    line = F.concat(F.unix_timestamp("ts").cast("string"), F.lit(" May 1 10:00:00 ns1 named[7]: queries: info: client "), "srcIP", F.lit("#4242 ("), "query",
                    F.lit("): query: "), "query", F.lit(" IN "), "qtype", F.lit(" +E (10.9.0.1)"))
    noise = rows.select(F.concat(F.lit("named[7]: starting "), "query").alias("value"), F.col("sensor").alias("source_file"))
    lines = rows.select(line.alias("value"), F.col("sensor").alias("source_file")).unionByName(noise)
    return _us(registry.parse(lines, "syslog-named", "dns").select("ts", "srcIP", "proto", "query", "qtype"), "ts")


@query("s09_edge_dns", f"SELECT epoch_us(ts) // 1000 * 1000 AS ts, \"srcIP\", proto, concat(\"query\", '.') AS \"query\", qtype FROM {view_sql('dns')}")
def edge(spark: SparkSession, sf: str) -> DataFrame:
    records = view(spark, sf, "dns").select(
        F.unix_millis("ts").alias("time"), F.col("srcIP").alias("source"), F.concat("query", F.lit(".")).alias("query"),
        F.col("qtype").alias("queryType"), F.upper("proto").alias("queryProtocol"), F.col("sensor").alias("source_file"))
    return _us(registry.parse(records, "edge", "dns").select("ts", "srcIP", "proto", "query", "qtype"), "ts")


# --- captures -------------------------------------------------------------------------


def _hex(value: Column | int, digits: int) -> Column:
    return F.lpad(F.hex(F.lit(value) if isinstance(value, int) else value), digits, "0")


def _le32(value: Column) -> Column:
    h = _hex(value, 8)
    return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])


def _narrow(key: str) -> Column:
    return F.substring(key, 2, 8)


def _wide(key: str) -> Column:
    """16 address bytes; an IPv4 address in mapped form."""
    return F.when(F.col(key).startswith("4"), F.concat(F.lit("0" * 20 + "FFFF"), _narrow(key))).otherwise(F.substring(key, 2, 32))


def _captures(rows: DataFrame, key: str, seq: str, body: Column, proto: int) -> DataFrame:
    """Capture files (path, content), one per key, of Ethernet frames around a transport body (hex).

    Two IPv4 addresses travel in IPv4, all others in IPv6; what is no address has no frame.
    """
    rows = with_ip_keys(rows, {"_src": "srcIP", "_dst": "destIP"}).where("_src IS NOT NULL AND _dst IS NOT NULL")
    # in steps that are compiled: an aggregate's own input is not, and it would work out each use of the body anew
    rows = derive_once(rows, {"_body": body})
    rows = derive_once(rows, {"_len": (F.length("_body") / 2).cast("int"), "_four": F.col("_src").startswith("4") & F.col("_dst").startswith("4")})
    mac = F.concat(F.lit("0200000000"), _hex(F.pmod(F.col("srcPort"), F.lit(4)), 2))
    v4 = F.concat(F.lit("08004500"), _hex(F.col("_len") + 20, 4), F.lit("0001000040"), _hex(proto, 2), F.lit("0000"), _narrow("_src"), _narrow("_dst"))
    v6 = F.concat(F.lit("86DD60000000"), _hex(F.col("_len"), 4), _hex(proto, 2), F.lit("40"), _wide("_src"), _wide("_dst"))
    frame = F.concat(F.lit("020000000099"), mac, F.when(F.col("_four"), v4).otherwise(v6), F.col("_body"))
    us = F.unix_micros("ts")
    rows = derive_once(rows, {
        "_time": F.concat(_le32((us / 1000000).cast("bigint")), _le32(F.pmod(us, F.lit(1000000)))),
        "_size": _le32(F.col("_len") + F.when(F.col("_four"), 34).otherwise(54)), "_frame": frame})
    records = derive_once(rows, {"_r": F.unhex(F.concat("_time", "_size", "_size", "_frame"))}).select(key, seq, "_r")
    ordered = records.repartition(key).sortWithinPartitions(key, seq, "_r")
    return ordered.select(F.col(key).cast("string"), "_r").mapInArrow(joined_records, "path string, content binary")


_FRAMED = f"{view_sql('conn')} WHERE {valid_ip('\"srcIP\"')} AND {valid_ip('\"destIP\"')}"
_HEADERS = f"CASE WHEN {valid4('\"srcIP\"')} AND {valid4('\"destIP\"')} THEN 42 ELSE 62 END"


def _udp_body() -> Column:
    return F.concat(_hex(F.col("srcPort"), 4), _hex(F.col("destPort"), 4), _hex(8, 4), F.lit("0000"), F.repeat(F.lit("AB"), F.col("bytesCount").cast("int")))


def _conn_captures(spark: SparkSession, sf: str) -> DataFrame:
    return _captures(view(spark, sf, "conn"), "order_id", "conn_id", _udp_body(), 17)


@query("s10_pcap_frames", f"SELECT CAST(order_id AS VARCHAR) AS source_file, epoch_us(ts) AS ts, 1 AS linktype, CAST({_HEADERS} + \"bytesCount\" AS INTEGER) AS captured FROM {_FRAMED}")
def frames(spark: SparkSession, sf: str) -> DataFrame:
    return _us(split_captures(_conn_captures(spark, sf)).select("source_file", "ts", "linktype", "captured"), "ts")


@query("s10_capture_files", f"""SELECT CAST(order_id // 4000 AS VARCHAR) AS capture, count(*) AS frames, count(*) - 1 AS last_no, CAST(sum(epoch_us(ts) // 1000000) AS BIGINT) AS seconds,
 CAST(sum({_HEADERS} + "bytesCount") AS BIGINT) AS bytes FROM {_FRAMED} GROUP BY ALL""")
def capture_files(spark: SparkSession, sf: str) -> DataFrame:
    """Capture files of some thousand orders each, read from disk by as many tasks as they have splits."""
    out = work_dir(spark, "captures")
    rows = view(spark, sf, "conn").withColumn("capture", F.floor(F.col("order_id") / 4000).cast("bigint"))
    # a text writer puts bytes as they are, and a byte 10 behind them
    files = _captures(rows, "capture", "conn_id", _udp_body(), 17).select(F.col("path").alias("capture"), F.col("content").cast("string").alias("value"))
    files.write.partitionBy("capture").text(out)
    found = pcap_frames(spark, out)
    return found.groupBy(F.substring_index(F.substring_index("source_file", "/capture=", -1), "/", 1).alias("capture")).agg(
        F.countDistinct("frame_no").alias("frames"), F.max("frame_no").alias("last_no"), F.sum(F.unix_seconds("ts")).alias("seconds"), F.sum("captured").alias("bytes"))


@query("s11_frames_ip", f"""SELECT epoch_us(ts) AS ts, "srcIP", "srcPort", "destIP", "destPort", 'udp' AS proto, {_HEADERS} + "bytesCount" AS "bytesCount" FROM {_FRAMED}""")
def frame_connections(spark: SparkSession, sf: str) -> DataFrame:
    out = registry.parse(split_captures(_conn_captures(spark, sf)), "pcap", "ip")
    return _us(out.select("ts", "srcIP", "srcPort", "destIP", "destPort", "proto", "bytesCount"), "ts")


@query("p03_direction", f"""SELECT "srcIP", "srcPort", "destPort", CASE WHEN "srcPort" % 4 = 1 THEN 'out' ELSE 'in' END AS direction FROM {_FRAMED}""")
def directions(spark: SparkSession, sf: str) -> DataFrame:
    out = with_direction(registry.parse(split_captures(_conn_captures(spark, sf)), "pcap", "ip"), "02:00:00:00:00:01")
    return out.select("srcIP", "srcPort", "destPort", "direction")


@query("p03_sensor_direction", f"""SELECT "srcIP", "srcPort", "destPort", CASE WHEN "srcPort" % 4 = order_id % 5 THEN 'out' ELSE 'in' END AS direction FROM {_FRAMED}""")
def sensor_directions(spark: SparkSession, sf: str) -> DataFrame:
    """One interface address per sensor, here a sensor in each region."""
    macs = spark.read.parquet(f"{sf}/region.parquet").select(
        F.col("r_regionkey").cast("string").alias("sensor"), F.concat(F.lit("02-00-00-00-00-0"), F.col("r_regionkey").cast("string")).alias("mac"))
    out = registry.parse(split_captures(_conn_captures(spark, sf)), "pcap", "ip")
    out = out.withColumn("sensor", (F.col("source_file").cast("bigint") % 5).cast("string"))
    return with_sensor_direction(out, macs).select("srcIP", "srcPort", "destPort", "direction")


@query("s12_frames_dns", f"""SELECT epoch_us(ts) AS ts, "srcIP", "srcPort", 53 AS "destPort", 'udp' AS proto, concat('host', lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0'), '.org') AS "query",
 CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'AAAA' END AS qtype FROM {view_sql('dns')} WHERE event_id % 4 <> 3""")
def frame_queries(spark: SparkSession, sf: str) -> DataFrame:
    """DNS messages in frames; every fourth is an answer."""
    rows = view(spark, sf, "dns")
    label = F.concat(F.lit("host"), F.lpad(F.pmod("event_id", F.lit(1000)).cast("string"), 3, "0"))
    flags = F.when(F.col("event_id") % 4 == 3, "8180").otherwise("0100")
    kind = F.when(F.col("event_id") % 2 == 0, "0001").otherwise("001C")
    message = F.concat(F.lit("0001"), flags, F.lit("0001000000000000"), F.lit("07"), F.hex(label), F.lit("036F726700"), kind, F.lit("0001"))
    udp = F.concat(_hex(F.col("srcPort"), 4), F.lit("0035"), _hex((F.length(message) / 2).cast("int") + 8, 4), F.lit("0000"), message)
    out = registry.parse(split_captures(_captures(rows, "event_id", "event_id", udp, 17)), "pcap", "dns")
    return _us(out.select("ts", "srcIP", "srcPort", "destPort", "proto", "query", "qtype"), "ts")



@query("f23_ja3", f"SELECT \"srcPort\", ja3_text, md5(ja3_text) AS ja3 FROM (SELECT \"srcPort\", concat('771,', CAST(order_id % 1000 + 1 AS VARCHAR), '-47,10-11,23-24,0') AS ja3_text FROM {_FRAMED})")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Client hellos in frames, with GREASE values to be left out."""
    rows = view(spark, sf, "conn")
    suites = F.concat(F.lit("0A0A"), _hex(F.pmod("order_id", F.lit(1000)) + 1, 4), F.lit("002F"))
    extensions = "2A2A0000" + "000A00080006" + "1A1A00170018" + "000B00020100"
    hello = F.concat(F.lit("0303" + "00" * 32 + "00" + "0006"), suites, F.lit("0100" + f"{len(extensions) // 2:04X}" + extensions))
    size = (F.length(hello) / 2).cast("int")
    record = F.concat(F.lit("160301"), _hex(size + 4, 4), F.lit("01"), _hex(size, 6), hello)
    tcp = F.concat(_hex(F.col("srcPort"), 4), F.lit("01BB" + "00" * 8 + "5018" + "00" * 6), record)
    out = frames_ja3(split_captures(_captures(rows, "order_id", "conn_id", tcp, 6)))
    return out.select("srcPort", "ja3_text", "ja3")


# --- several types, errors, user formats ---------------------------------------------------


@query("s22_read_all_types", f"""SELECT 'dns' AS event_type, sensor AS source_file, count(*) AS found FROM {view_sql('dns')} WHERE event_id % 4 <> 3 GROUP BY sensor
 UNION ALL SELECT 'http', concat('h', CAST(page_id % 4 AS VARCHAR)), count(*) FROM {view_sql('http')} WHERE page_id % 5 <> 4 GROUP BY ALL""")
def all_types(spark: SparkSession, sf: str) -> DataFrame:
    """Mixed records read as DNS and HTTP in one pass."""
    lines = eve_dns_lines(spark, sf).unionByName(eve_http_lines(spark, sf))
    return registry.events_found(registry.read_all_types(lines, "suricata"))


_LINE_IP = f"""(SELECT CASE WHEN {valid_ip('"srcIP"')} THEN "srcIP" END AS "srcIP", "bytesCount" FROM {view_sql('conn')})"""


@query("s22_write_all_types", f"""SELECT event_type, "srcIP", count(*) AS entries, CAST(sum(CASE WHEN event_type = 'ip' THEN "bytesCount" ELSE 0 END) AS BIGINT) AS bytes
 FROM {_LINE_IP}, (VALUES ('dns'), ('http'), ('ip')) t(event_type) GROUP BY ALL""")
def all_types_written(spark: SparkSession, sf: str) -> DataFrame:
    """Zeek files split and read once, every line as an event of each type, written to a folder per type in one job."""
    out = work_dir(spark, "all-types")
    lines = read_landed_lines(spark, _zeek_files(_zeek_conn_lines(spark, sf)))
    kinds = ["dns", "http", "ip"]
    registry.write_all_types(registry.read_all_types(lines, "bro", kinds), out, kinds)
    read = spark.read.schema("srcIP string, bytesOut bigint, event_type string").json(out)
    return read.groupBy("event_type", F.nullif("srcIP", F.lit("")).alias("srcIP")).agg(
        F.count("*").alias("entries"), F.sum(F.coalesce("bytesOut", F.lit(0))).alias("bytes"))


@query("a06_events_found", f"SELECT 'ip' AS event_type, sensor AS source_file, count(*) AS found FROM {view_sql('conn')} GROUP BY sensor")
def found(spark: SparkSession, sf: str) -> DataFrame:
    return registry.events_found(registry.read_all_types(_zeek_conn_lines(spark, sf), "bro", ["ip"]))


@query("l03_parse_drop", f"SELECT count(*) AS kept FROM {view_sql('dns')} WHERE event_id % 4 <> 3")
def dropped(spark: SparkSession, sf: str) -> DataFrame:
    """Answers are left out without a trace."""
    out = registry.parse(eve_dns_lines(spark, sf), "suricata", "dns", on_error="keep")
    return out.agg(F.count("*").alias("kept"))


def broken_eve_lines(spark: SparkSession, sf: str) -> DataFrame:
    """EVE lines of which every tenth is cut off."""
    lines = eve_dns_lines(spark, sf).withColumn("_n", F.regexp_extract("value", '"src_port":(\\d+)', 1).cast("int"))
    return lines.withColumn("value", F.when(F.col("_n") % 10 == 0, F.substring("value", 1, 40)).otherwise(F.col("value"))).drop("_n")


@query("l04_error_route", f"""SELECT sensor AS source_file, CASE WHEN bad THEN 'suricata: not a valid record' ELSE 'ok' END AS outcome, count(*) AS n
 FROM (SELECT *, (1024 + event_id % 60000) % 10 = 0 AS bad FROM {view_sql('dns')}) WHERE bad OR event_id % 4 <> 3 GROUP BY ALL""")
def routed(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = split_errors(registry.parse(broken_eve_lines(spark, sf), "suricata", "dns", on_error="keep"))
    both = good.select("source_file", F.lit("ok").alias("outcome")).unionByName(
        bad.select("source_file", F.col("_error").alias("outcome")))
    return both.groupBy("source_file", "outcome").agg(F.count("*").alias("n"))


@query("u01_register_format", f"SELECT event_id, \"srcIP\", \"query\" FROM {view_sql('dns')}")
def user_format(spark: SparkSession, sf: str) -> DataFrame:
    """A format of the user's own: three fields behind semicolons."""
    from wirelight.sources.lines import finish, read_lines

    def parse_plain(lines: DataFrame, on_error: str = "fail") -> DataFrame:
        parts = F.split("value", ";")
        rows = lines.select(F.get(parts, F.lit(0)).cast("bigint").alias("event_id"), F.get(parts, F.lit(1)).alias("_src"),
                            F.get(parts, F.lit(2)).alias("query"), "source_file")
        return finish(rows, {"srcIP": "_src"}, F.lit(None).cast("string"), on_error)

    registry.register_format("plain", registry.LogFormat(read_lines, {"dns": parse_plain}))
    rows = view(spark, sf, "dns")
    lines = rows.select(F.concat_ws(";", F.col("event_id").cast("string"), "srcIP", "query").alias("value"), F.col("sensor").alias("source_file"))
    return registry.parse(lines, "plain", "dns").select("event_id", "srcIP", "query")
