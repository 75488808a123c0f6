"""One query per scalar function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelight.functions import documents as d
from wirelight.functions import times as t
from wirelight.functions import values as v
from wirelight.functions.columns import derive_once
from wirelight.functions.ip import (
    cidr_bounds, cidr_length, cidr_valid, ip16, ip_canonical, ip_family, with_cidr_keys, with_ip_keys,
)
from wirelight.functions.names import is_domain_name, join_clean_path, scheme_by_port, url_host
from wirelight.operators.special import SPECIAL_IPV4, is_special_ip
from wirelight.plans.registry import query
from wirelight.plans.scope_queries import _SPECIAL6
from wirelight.plans.views import in_nets, int4, valid4, view, view_sql


def _table(spark: SparkSession, sf: str, name: str, **columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def _text(sql: str) -> str:
    return f"CAST({sql} AS STRING)"


@query("f01_zeek_epoch", "SELECT event_id, CASE WHEN event_id % 10 = 9 THEN NULL ELSE epoch_us(ts) END AS ts_us FROM events")
def zeek_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds with six digits; every tenth text lacks its dot."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    whole, part = (us / 1000000).cast("bigint"), F.lpad(F.pmod(us, F.lit(1000000)).cast("string"), 6, "0")
    text = F.concat(whole.cast("string"), F.when(F.col("event_id") % 10 == 9, "").otherwise("."), part)
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_id", text.alias("x"))
    return df.select("event_id", F.unix_micros(t.zeek_epoch("x")).alias("ts_us"))


@query("f02_eve_ts", "SELECT event_id, CASE WHEN event_id % 10 = 9 THEN NULL ELSE epoch_us(ts) - 7200000000 END AS ts_us FROM events")
def eve_ts(spark: SparkSession, sf: str) -> DataFrame:
    df = _table(spark, sf, "events", event_id="event_id",
                x="concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), CASE WHEN event_id % 10 = 9 THEN 'Z' ELSE '+0200' END)")
    return df.select("event_id", F.unix_micros(t.eve_ts("x")).alias("ts_us"))


@query("f03_msdns_ts", "SELECT event_id, epoch_us(date_trunc('second', ts)) AS ts_us FROM events")
def msdns_ts(spark: SparkSession, sf: str) -> DataFrame:
    """The four layouts in turn."""
    layouts = ["yyyy-MM-dd h:mm:ss a", "yyyy/MM/dd h:mm:ss a", "yyyy-MM-dd H:mm:ss", "yyyy/MM/dd H:mm:ss"]
    cases = " ".join(f"WHEN {i} THEN date_format(ts, '{p}')" for i, p in enumerate(layouts))
    df = _table(spark, sf, "events", event_id="event_id", x=f"CASE CAST(event_id % 4 AS INT) {cases} END")
    return df.select("event_id", F.unix_micros(t.msdns_ts("x")).alias("ts_us"))


@query("f04_epoch_ms", "SELECT event_id, CASE WHEN event_id % 10 = 9 THEN NULL ELSE event_id * 1000 * 1700000 + 1000 END AS ts_us FROM events")
def epoch_ms(spark: SparkSession, sf: str) -> DataFrame:
    df = _table(spark, sf, "events", event_id="event_id",
                x="CASE WHEN event_id % 10 = 9 THEN -event_id ELSE event_id * 1700000 + 1 END")
    return df.select("event_id", F.unix_micros(t.epoch_ms("x")).alias("ts_us"))


@query("f05_lower_proto", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'tcp' ELSE 'udp' END AS proto FROM lineitem")
def lower_proto(spark: SparkSession, sf: str) -> DataFrame:
    df = _table(spark, sf, "lineitem", l_orderkey="l_orderkey", l_linenumber="l_linenumber",
                x="CASE WHEN l_returnflag = 'A' THEN 'TCP' ELSE 'Udp' END")
    return df.select("l_orderkey", "l_linenumber", v.lower_proto("x").alias("proto"))


@query("f06_msdns_name", "SELECT event_id, concat(event_type, '.x', CAST(user_id AS VARCHAR), '.org') AS name FROM events")
def msdns_name(spark: SparkSession, sf: str) -> DataFrame:
    df = _table(spark, sf, "events", event_id="event_id",
                x="concat('(', length(event_type), ')', event_type, '(4)x', user_id, '(3)org(0)')")
    return df.select("event_id", v.msdns_name("x").alias("name"))


@query("f07_blank_unset", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 < 2 THEN '' ELSE l_returnflag END AS value FROM lineitem")
def blank_unset(spark: SparkSession, sf: str) -> DataFrame:
    df = _table(spark, sf, "lineitem", l_orderkey="l_orderkey", l_linenumber="l_linenumber",
                x="CASE l_linenumber % 3 WHEN 0 THEN '-' WHEN 1 THEN '(empty)' ELSE l_returnflag END")
    return df.select("l_orderkey", "l_linenumber", v.blank_unset("x", F.lit("(empty)"), F.lit("-")).alias("value"))


@query("f08_port16", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey * 40 <= 65535 THEN CAST(p_partkey * 40 AS INTEGER) END AS port FROM part")
def port16(spark: SparkSession, sf: str) -> DataFrame:
    df = _table(spark, sf, "part", p_partkey="p_partkey",
                x="CASE WHEN p_partkey % 7 = 0 THEN '-' ELSE CAST(p_partkey * 40 AS STRING) END")
    return df.select("p_partkey", v.port16("x").alias("port"))


@query("f09_byte_total", """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) + CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE 0 END
 + CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey END AS total FROM lineitem""")
def byte_total(spark: SparkSession, sf: str) -> DataFrame:
    df = _table(spark, sf, "lineitem", l_orderkey="l_orderkey", l_linenumber="l_linenumber", a="CAST(l_quantity AS BIGINT)",
                b="CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE -l_partkey END", c="CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey END")
    return df.select("l_orderkey", "l_linenumber", v.byte_total(F.col("a"), F.col("b"), F.col("c")).alias("total"))


@query("f10_join_clean_path", """SELECT page_id, concat('h', CAST(page_id AS VARCHAR), CASE page_id % 5 WHEN 0 THEN '/a/b' WHEN 1 THEN '/b' WHEN 2 THEN ''
 WHEN 3 THEN '/a?x=1' ELSE '/a/b' END) AS path FROM pages""")
def clean_path(spark: SparkSession, sf: str) -> DataFrame:
    df = _table(spark, sf, "pages", page_id="page_id", h="concat('h', page_id)",
                p="CASE page_id % 5 WHEN 0 THEN '/a//b/' WHEN 1 THEN '/a/../b' WHEN 2 THEN '/' WHEN 3 THEN 'a?x=1' ELSE '/./a/./b/.' END")
    return df.select("page_id", join_clean_path("h", "p").alias("path"))


@query("f11_scheme_by_port", f"SELECT conn_id, CASE \"destPort\" WHEN 80 THEN 'http://' WHEN 443 THEN 'https://' ELSE '' END AS scheme FROM {view_sql('conn')}")
def scheme(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "conn").select("conn_id", scheme_by_port("destPort").alias("scheme"))


@query("f12_url_host", f"""SELECT page_id, lower(nullif(split_part(split_part(split_part(split_part(regexp_replace(url, '^[a-z]*://', ''), '/', 1), ':', 1), '?', 1), '#', 1), '')) AS host
 FROM {view_sql('http')}""")
def host(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "http").select("page_id", url_host("url").alias("host"))


@query("f13_is_domain_name", r"""SELECT DISTINCT word, strlen(word) < 254 + CAST(word LIKE '%.' AS INT) AND regexp_matches(word, '[A-Za-z_]')
 AND len(list_filter(string_split(regexp_replace(word, '[.]$', ''), '.'), lambda l: NOT (strlen(l) BETWEEN 1 AND 63 AND regexp_matches(l, '^[A-Za-z0-9_-]*$')
 AND l NOT LIKE '-%' AND l NOT LIKE '%-'))) = 0 AS ok FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents)""")
def domain_name(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct word of the documents as a name."""
    words = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.split("text", " ")).alias("word"))
    return words.distinct().select("word", is_domain_name("word").alias("ok"))


_HEX4 = "lower(lpad(to_hex({}), 8, '0'))".format(int4('"srcIP"'))
_V6 = """concat(CASE WHEN "srcIP" LIKE 'fd%' THEN concat('fd00', repeat('0', 20), lpad(split_part("srcIP", ':', 3), 4, '0'))
 ELSE concat('20010db8', repeat('0', 20)) END, lpad(split_part("srcIP", ':', CASE WHEN "srcIP" LIKE 'fd%' THEN 4 ELSE 4 END), 4, '0'))"""


@query("f14_ip_norm", f"""SELECT conn_id, CASE WHEN {valid4('"srcIP"')} THEN 4 WHEN contains("srcIP", ':') THEN 6 END AS fam,
 CASE WHEN {valid4('"srcIP"')} THEN concat('00000000000000000000ffff', {_HEX4}) WHEN contains("srcIP", ':') THEN {_V6} END AS ip16,
 CASE WHEN {valid4('"srcIP"')} OR contains("srcIP", ':') THEN "srcIP" END AS ip FROM {view_sql('conn')}""")
def ip_norm(spark: SparkSession, sf: str) -> DataFrame:
    """Family, 16-byte form and canonical text of connection sources."""
    df = with_ip_keys(view(spark, sf, "conn"), {"k": "srcIP"})
    return df.select("conn_id", ip_family("k").cast("int").alias("fam"), ip16("k").alias("ip16"),
                     ip_canonical("srcIP", "k").alias("ip"))


@query("f15_cidr_parse", """SELECT s_suppkey, s_suppkey % 40 <= 32 AS ok, CASE WHEN s_suppkey % 40 <= 32 THEN CAST(s_suppkey % 40 AS INTEGER) END AS bits,
 CASE WHEN s_suppkey % 40 <= 32 THEN n - n % size END AS lo, CASE WHEN s_suppkey % 40 <= 32 THEN n - n % size + size - 1 END AS hi
 FROM (SELECT s_suppkey, 167772160 + s_suppkey * 65536 + 777 AS n, CAST(pow(2, greatest(32 - s_suppkey % 40, 0)) AS BIGINT) AS size FROM
 (SELECT s_suppkey FROM supplier WHERE s_suppkey < 200)) WHERE true""".replace("FROM supplier WHERE s_suppkey < 200", "FROM supplier").replace("s_suppkey * 65536", "(s_suppkey % 200) * 65536"))
def cidr_parse(spark: SparkSession, sf: str) -> DataFrame:
    df = _table(spark, sf, "supplier", s_suppkey="s_suppkey",
                c="concat('10.', CAST(s_suppkey % 200 AS STRING), '.3.9/', CAST(s_suppkey % 40 AS STRING))")
    df = with_cidr_keys(df, "c", "k")
    lo, hi = cidr_bounds("c", "k")
    ok = cidr_valid("c", "k")

    def number(key):
        return F.conv(F.substring(key, 2, 8), 16, 10).cast("bigint")

    return df.select("s_suppkey", ok.alias("ok"), F.when(ok, cidr_length("c", "k")).alias("bits"),
                     number(lo).alias("lo"), number(hi).alias("hi"))


@query("f17_is_special_ip", "SELECT conn_id, {d} AS special FROM {v}".format(v=view_sql("conn"), d=in_nets('"destIP"', list(SPECIAL_IPV4), _SPECIAL6)))
def special(spark: SparkSession, sf: str) -> DataFrame:
    return with_ip_keys(view(spark, sf, "conn"), {"k": "destIP"}).select("conn_id", is_special_ip("k").alias("special"))


@query("f18_proto_name", "SELECT p_partkey, CASE p_size WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE CAST(p_size AS VARCHAR) END AS proto FROM part")
def proto_name(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", v.proto_name("p_size").alias("proto"))


_PROTO = "CASE n WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE CAST(n AS VARCHAR) END"


@query("f19_doc_proto", f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN n = 0 OR n > 255 THEN '' ELSE {_PROTO} END
 WHEN 1 THEN CASE WHEN n > 255 THEN '' ELSE {_PROTO} END WHEN 2 THEN p_type ELSE '' END AS proto FROM (SELECT *, CAST(p_size * 7 % 300 AS INTEGER) AS n FROM part)""")
def doc_proto(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers, numbers as text, names, and absent values."""
    n = "CAST(p_size * 7 % 300 AS STRING)"
    df = _table(spark, sf, "part", p_partkey="p_partkey", x=f"""concat('{{"p":', CASE p_partkey % 4 WHEN 0 THEN {n} WHEN 1 THEN concat('"', {n}, '"')
        WHEN 2 THEN concat('"', p_type, '"') ELSE 'null' END, '}}')""")
    df = derive_once(df, {"doc": F.try_parse_json("x")})
    return df.select("p_partkey", d.doc_proto(F.col("doc"), "p").alias("proto"))


@query("f20_doc_getters", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS text, CASE WHEN p_partkey % 3 = 1 THEN p_partkey ELSE 0 END AS number,
 CAST(CASE WHEN p_partkey % 3 = 1 AND p_partkey <= 255 THEN p_partkey ELSE 0 END AS INTEGER) AS small, p_partkey % 3 <> 2 AS present FROM part""")
def doc_getters(spark: SparkSession, sf: str) -> DataFrame:
    """Text, number or nothing at the same path: wrong types read as blank."""
    df = _table(spark, sf, "part", p_partkey="p_partkey", x="""concat('{"a":{"b.c":', CASE p_partkey % 3 WHEN 0 THEN concat('"', p_name, '"')
        WHEN 1 THEN CAST(p_partkey AS STRING) ELSE 'null' END, '}}')""")
    df, path = derive_once(df, {"doc": F.try_parse_json("x")}), "$['a']['b.c']"
    doc = F.col("doc")
    return df.select("p_partkey", d.doc_string(doc, path).alias("text"), d.doc_int(doc, path).alias("number"),
                     d.doc_uint8(doc, path).alias("small"), d.doc_exists(doc, path).alias("present"))


@query("f21_doc_ts", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE epoch_us(ts) END AS ts_us FROM events")
def doc_ts(spark: SparkSession, sf: str) -> DataFrame:
    stamp = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    df = _table(spark, sf, "events", event_id="event_id",
                f=f"map('@timestamp', array(concat({stamp}, CASE WHEN event_id % 5 = 4 THEN '' ELSE 'Z' END), 'x'))")
    return df.select("event_id", F.unix_micros(d.doc_field_ts(F.col("f"), "@timestamp")).alias("ts_us"))


@query("f22_clamp_cursor", """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE greatest(CASE WHEN event_id % 5 = 3 THEN 0 ELSE epoch_us(ts) END,
 epoch_us(TIMESTAMP '2024-01-15 00:00:00') - 86400000000) END AS ts_us FROM events""")
def clamp(spark: SparkSession, sf: str) -> DataFrame:
    df = _table(spark, sf, "events", event_id="event_id", x="""CASE CAST(event_id % 5 AS INT) WHEN 4 THEN NULL WHEN 3 THEN 'junk'
        ELSE concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), 'Z') END""")
    now = F.lit("2024-01-15T00:00:00Z").cast("timestamp")
    return df.select("event_id", F.unix_micros(t.clamp_cursor("x", now)).alias("ts_us"))


@query("f24_dns_type_name", """SELECT p_partkey, CASE p_size WHEN 1 THEN 'A' WHEN 2 THEN 'NS' WHEN 3 THEN 'MD' WHEN 4 THEN 'MF' WHEN 5 THEN 'CNAME' WHEN 6 THEN 'SOA'
 WHEN 7 THEN 'MB' WHEN 8 THEN 'MG' WHEN 9 THEN 'MR' WHEN 10 THEN 'NULL' WHEN 11 THEN 'WKS' WHEN 12 THEN 'PTR' WHEN 13 THEN 'HINFO' WHEN 14 THEN 'MINFO'
 WHEN 15 THEN 'MX' WHEN 16 THEN 'TXT' WHEN 28 THEN 'AAAA' WHEN 33 THEN 'SRV' WHEN 41 THEN 'OPT' ELSE 'Unknown' END AS qtype FROM part""")
def dns_type(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", v.dns_type_name("p_size").alias("qtype"))
