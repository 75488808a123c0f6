"""Search documents made from the views, searched and decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelight.functions.columns import derive_once
from wirelight.functions.times import wire_time
from wirelight.plans.registry import query
from wirelight.plans.scope_queries import _us
from wirelight.plans.views import valid_ip, view, view_sql
from wirelight.session import work_dir
from wirelight.sources.documents import (
    decode, ingested_after, must_exist, newest_ingested, numbered_pages, page, search, source_projection, term_filter,
)
from wirelight.sources.search_config import Search

_CURSOR = "TIMESTAMP '2024-01-10 00:00:00'"


def _documents(rows: DataFrame, doc_id: str, source: Column, ingested: Column) -> DataFrame:
    fields = F.create_map(
        F.lit("@timestamp"), F.array(wire_time("ts")), F.lit("event.ingested"), F.array(wire_time(ingested)))
    return rows.select(F.lpad(F.col(doc_id).cast("string"), 12, "0").alias("id"), F.to_json(source).alias("source"),
                       fields.alias("fields"), ingested.alias("ingested"))


def dns_documents(spark: SparkSession, sf: str) -> DataFrame:
    """ECS documents of DNS queries; every seventh lacks the question."""
    rows = view(spark, sf, "dns")
    name = F.when(F.col("event_id") % 7 != 6, F.col("query"))
    source = F.struct(
        F.struct(F.col("srcIP").alias("ip"), F.col("srcPort").alias("port")).alias("source"),
        F.struct(F.struct(name.alias("name"), F.col("qtype").alias("type")).alias("question")).alias("dns"),
        F.when(F.col("event_id") % 2 == 0, "dns").otherwise("conn").alias("_path"),
    )
    return _documents(rows, "event_id", source, F.col("ts"))


def conn_documents(spark: SparkSession, sf: str) -> DataFrame:
    """ECS documents of connections; odd orders have their port as text."""
    rows = view(spark, sf, "conn")
    odd = F.col("order_id") % 2 == 1
    source = F.struct(
        F.struct(F.col("srcIP").alias("ip"), F.when(~odd, F.col("srcPort")).alias("port"), F.col("bytesCount").alias("bytes")).alias("source"),
        F.struct(F.col("destIP").alias("ip"), F.when(odd, F.col("destPort").cast("string")).alias("port"), F.lit(7).alias("bytes")).alias("destination"),
        F.struct(F.when(odd, "6").otherwise("udp").alias("protocol")).alias("network"),
    )
    return _documents(rows, "conn_id", source, F.col("ts"))


_DNS = Search("dns", "ecs", page_size=500)
_ID = "lpad(CAST(event_id AS VARCHAR), 12, '0')"


@query("s13_doc_search", f"SELECT {_ID} AS id FROM {view_sql('dns')} WHERE event_id % 7 <> 6 AND ts > {_CURSOR} ORDER BY ts, id LIMIT 500")
def doc_search(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of documents newer than the cursor."""
    found = search(dns_documents(spark, sf), _DNS, F.expr(_CURSOR))
    return page(found, _DNS.page_size).select("id")


@query("s13_doc_pages", f"SELECT {_ID} AS id, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 400 AS INT) AS page FROM {view_sql('dns')} WHERE event_id % 7 <> 6 AND ts > TIMESTAMP '2024-01-29 00:00:00'")
def doc_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The documents since a time, page by page to the end."""
    wanted, out = Search("dns", "ecs", page_size=400), work_dir(spark, "pages")
    docs = dns_documents(spark, sf)
    docs.write.parquet(f"{out}/landed")
    landed = spark.read.schema(docs.schema).parquet(f"{out}/landed")
    found = search(landed, wanted, F.expr("TIMESTAMP '2024-01-29 00:00:00'")).select("ingested", "id")
    numbered_pages(found, wanted.page_size).select("id", "page").write.parquet(f"{out}/found")
    return spark.read.parquet(f"{out}/found")


@query("p04_source_projection", f"""SELECT epoch_us(ts) AS ts, "srcIP", "srcPort", "destIP", "destPort", 'udp' AS proto, CAST(7 AS BIGINT) AS "bytesIn", "bytesCount" AS "bytesOut"
 FROM {view_sql('conn')} WHERE {valid_ip('"srcIP"')}""")
def projected(spark: SparkSession, sf: str) -> DataFrame:
    """Documents landed with nested columns, most of which no connection search reads; the scan reads the mapped leaves."""
    out, wanted = work_dir(spark, "nested"), Search("ip", "ecs")
    rows = view(spark, sf, "conn")
    source = F.struct(
        F.struct(F.col("srcIP").alias("ip"), F.col("srcPort").alias("port"), F.col("bytesCount").alias("bytes"), F.concat(F.lit("host-"), "sensor").alias("name")).alias("source"),
        F.struct(F.col("destIP").alias("ip"), F.col("destPort").alias("port"), F.lit(7).alias("bytes"), F.struct(F.lit("DE").alias("country")).alias("geo")).alias("destination"),
        F.struct(F.lit("udp").alias("protocol"), F.lit("flow").alias("type")).alias("network"),
        F.struct(wire_time("ts").alias("ingested"), F.repeat(F.col("sensor"), 20).alias("original")).alias("event"), wire_time("ts").alias("@timestamp"))
    fields = F.create_map(F.lit("@timestamp"), F.array(wire_time("ts")), F.lit("event.ingested"), F.array(wire_time("ts")))
    docs = rows.select(F.lpad(F.col("conn_id").cast("string"), 12, "0").alias("id"), source.alias("source"), fields.alias("fields"), F.col("ts").alias("ingested"))
    docs.write.parquet(out)
    found = search(source_projection(spark.read.schema(docs.schema).parquet(out), wanted), wanted, F.expr("TIMESTAMP '1970-01-01 00:00:00'"))
    return _us(decode(found, wanted).select("ts", "srcIP", "srcPort", "destIP", "destPort", "proto", "bytesIn", "bytesOut"), "ts")


@query("s14_doc_dns", f"SELECT epoch_us(ts) AS ts, \"srcIP\", \"query\", qtype FROM {view_sql('dns')} WHERE event_id % 7 <> 6 AND ts > {_CURSOR}")
def doc_dns(spark: SparkSession, sf: str) -> DataFrame:
    found = search(dns_documents(spark, sf), _DNS, F.expr(_CURSOR))
    return _us(decode(found, _DNS).select("ts", "srcIP", "query", "qtype"), "ts")


@query("s15_doc_ip", f"""SELECT epoch_us(ts) AS ts, "srcIP", CASE WHEN order_id % 2 = 1 THEN 0 ELSE "srcPort" END AS "srcPort", "destIP", 0 AS "destPort",
 CASE WHEN order_id % 2 = 1 THEN 'tcp' ELSE 'udp' END AS proto, 7 AS "bytesIn", "bytesCount" AS "bytesOut" FROM {view_sql('conn')} WHERE {valid_ip('"srcIP"')}""")
def doc_ip(spark: SparkSession, sf: str) -> DataFrame:
    out = decode(conn_documents(spark, sf), Search("ip", "ecs"))
    return _us(out.select("ts", "srcIP", "srcPort", "destIP", "destPort", "proto", "bytesIn", "bytesOut"), "ts")


@query("s16_doc_http", f"""SELECT epoch_us(ts) AS ts, "srcIP", url, method, status, "bytesIn", "userAgent", '' AS referrer FROM {view_sql('http')}""")
def doc_http(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "http")
    source = F.struct(
        F.struct(F.col("srcIP").alias("ip")).alias("source"), F.struct(F.col("url").alias("original")).alias("url"),
        F.struct(F.struct("method").alias("request"), F.struct(F.col("status").alias("status_code")).alias("response")).alias("http"),
        F.struct(F.col("bytesIn").alias("bytes")).alias("destination"), F.struct(F.col("userAgent").alias("original")).alias("user_agent"))
    out = decode(_documents(rows, "page_id", source, F.col("ts")), Search("http", "ecs"))
    return _us(out.select("ts", "srcIP", "url", "method", "status", "bytesIn", "userAgent", "referrer"), "ts")


@query("s17_doc_tls", f"""SELECT "srcIP", CASE WHEN order_id % 3 = 0 THEN NULL ELSE "destIP" END AS "destIP", concat('CN=', sensor) AS issuer, epoch_us(ts) AS "validFrom",
 CAST(NULL AS BIGINT) AS "validTo", concat('j', sensor) AS ja3 FROM {view_sql('conn')} WHERE {valid_ip('"srcIP"')}""")
def doc_tls(spark: SparkSession, sf: str) -> DataFrame:
    """TLS documents; a third has no destination, none a readable end of validity."""
    rows = view(spark, sf, "conn")
    source = F.struct(
        F.struct(F.col("srcIP").alias("ip")).alias("source"),
        F.struct(F.when(F.col("order_id") % 3 != 0, F.col("destIP")).alias("ip")).alias("destination"),
        F.struct(F.struct(F.concat(F.lit("CN="), "sensor").alias("issuer"), wire_time("ts").alias("not_before"), F.lit("soon").alias("not_after")).alias("server"),
                 F.struct(F.concat(F.lit("j"), "sensor").alias("ja3")).alias("client")).alias("tls"))
    out = decode(_documents(rows, "conn_id", source, F.col("ts")), Search("tls", "ecs"))
    return _us(out.select("srcIP", "destIP", "issuer", "validFrom", "validTo", "ja3"), "validFrom", "validTo")


@query("s21_field_map", f"SELECT {_ID} AS id, CASE WHEN event_id % 7 = 6 THEN '' ELSE \"query\" END AS qtype, qtype AS \"query\" FROM {view_sql('dns')}")
def field_map(spark: SparkSession, sf: str) -> DataFrame:
    """The user's paths win field by field: name and type swapped."""
    swapped = Search("dns", "ecs", fields={"query": "dns.question.type", "qtype": "dns.question.name"})
    return decode(dns_documents(spark, sf), swapped).select("id", "query", "qtype")


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return derive_once(dns_documents(spark, sf), {"doc": F.try_parse_json("source")})


@query("l05_must_exist", f"SELECT {_ID} AS id FROM {view_sql('dns')} WHERE event_id % 7 <> 6")
def existing(spark: SparkSession, sf: str) -> DataFrame:
    condition = must_exist(F.col("doc"), F.col("fields"), _DNS.final_must_have())
    return _parsed(spark, sf).where(condition).select("id")


@query("l06_term_filter", f"SELECT {_ID} AS id FROM {view_sql('dns')} WHERE event_id % 2 = 0")
def terms(spark: SparkSession, sf: str) -> DataFrame:
    wanted = Search("dns", "corelight", fields={"event_ingested": "event.ingested", "timestamp": "@timestamp", "src_ip": "source.ip", "query": "dns.question.name"})
    return _parsed(spark, sf).where(term_filter(F.col("doc"), wanted.final_terms())).select("id")


@query("l07_ingested_after", f"SELECT {_ID} AS id FROM {view_sql('dns')} WHERE ts > {_CURSOR}")
def newer(spark: SparkSession, sf: str) -> DataFrame:
    return dns_documents(spark, sf).where(ingested_after(F.expr(_CURSOR))).select("id")


@query("a04_newest_ingested", f"SELECT epoch_us(max(ts)) AS newest FROM {view_sql('dns')} WHERE event_id % 7 <> 6")
def newest(spark: SparkSession, sf: str) -> DataFrame:
    return _us(newest_ingested(search(dns_documents(spark, sf), _DNS, F.lit("1970-01-01").cast("timestamp"))), "newest")


@query("o01_order_by_ingested", f"SELECT {_ID} AS id, row_number() OVER (ORDER BY ts, event_id) AS place FROM {view_sql('dns')} ORDER BY ts, event_id LIMIT 200")
def ordered(spark: SparkSession, sf: str) -> DataFrame:
    """A page in ingested order, with the places spelled out."""
    first = page(dns_documents(spark, sf), 200)
    numbered = first.agg(F.array_sort(F.collect_list(F.struct("ingested", "id"))).alias("p")).select(F.posexplode("p").alias("n", "r"))
    return numbered.select(F.col("r.id").alias("id"), (F.col("n") + 1).cast("bigint").alias("place"))


@query("o02_page_limit", f"SELECT {_ID} AS id FROM {view_sql('dns')} WHERE ts > {_CURSOR} ORDER BY ts, event_id LIMIT 1000")
def limited(spark: SparkSession, sf: str) -> DataFrame:
    return page(dns_documents(spark, sf).where(ingested_after(F.expr(_CURSOR))), 1000).select("id")


@query("o03_keyset_page", f"SELECT {_ID} AS id FROM {view_sql('dns')} WHERE ts > {_CURSOR} ORDER BY ts, event_id LIMIT 1000 OFFSET 1000")
def next_page(spark: SparkSession, sf: str) -> DataFrame:
    """The page after the first thousand, by the last row's sort key."""
    docs = dns_documents(spark, sf).where(ingested_after(F.expr(_CURSOR)))
    last = page(docs, 1000).agg(F.max(F.struct("ingested", "id")).alias("k")).select("k.*").first()
    return page(docs, 1000, (F.lit(last.ingested), F.lit(last.id))).select("id")
