"""Telemetry views derived from the star-schema tables.

Each view is one select list in SQL that Spark and other engines read alike, so
a query and its check start from the same rows.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, SparkSession

_S = "CAST({} AS STRING)".format

_SRC = f"""CASE CAST(l_suppkey % 6 AS INT)
  WHEN 0 THEN concat('10.', {_S('l_partkey % 4')}, '.', {_S('l_suppkey % 250')}, '.', {_S('l_orderkey % 250 + 1')})
  WHEN 1 THEN concat('192.168.', {_S('l_partkey % 250')}, '.', {_S('l_orderkey % 250')})
  WHEN 2 THEN concat('172.', {_S('14 + l_partkey % 6')}, '.0.', {_S('l_orderkey % 250')})
  WHEN 3 THEN concat('81.2.', {_S('l_partkey % 250')}, '.9')
  WHEN 4 THEN concat('fd00::', {_S('1 + l_partkey % 999')}, ':', {_S('1 + l_orderkey % 999')})
  ELSE CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN '10.300.1.1'
       WHEN 1 THEN concat('2001:db8::', {_S('1 + l_orderkey % 999')}) ELSE NULL END END"""

_DST = f"""CASE CAST((l_linenumber + l_partkey) % 10 AS INT)
  WHEN 0 THEN concat('10.9.', {_S('l_partkey % 250')}, '.7')
  WHEN 1 THEN concat('8.8.', {_S('l_partkey % 250')}, '.8')
  WHEN 2 THEN concat('224.0.0.', {_S('l_partkey % 250')})
  WHEN 3 THEN concat('240.1.1.', {_S('l_partkey % 250')})
  WHEN 4 THEN '255.255.255.255'
  WHEN 5 THEN '127.0.0.1'
  WHEN 6 THEN concat('2600::', {_S('1 + l_partkey % 999')})
  WHEN 7 THEN concat('fe80::', {_S('1 + l_partkey % 999')})
  WHEN 8 THEN concat('198.', {_S('17 + l_partkey % 4')}, '.3.4')
  ELSE concat('93.184.', {_S('l_partkey % 250')}, '.34') END"""

CONN = {
    "conn_id": "l_orderkey * 8 + l_linenumber",
    "order_id": "l_orderkey",
    "line_id": "l_linenumber",
    "ts": "CAST(l_shipdate AS TIMESTAMP)",
    "srcIP": _SRC,
    "srcPort": "CAST(1024 + l_orderkey % 60000 AS INT)",
    "destIP": _DST,
    "destPort": "CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN 53 WHEN 1 THEN 80 WHEN 2 THEN 443 ELSE 8080 END",
    "proto": "CASE WHEN l_returnflag = 'A' THEN 'tcp' ELSE 'udp' END",
    "bytesCount": "CAST(l_quantity AS BIGINT)",
    "direction": "CASE WHEN l_partkey % 10 = 0 THEN 'unknown' WHEN l_linestatus = 'O' THEN 'out' ELSE 'in' END",
    "sensor": f"concat('s', {_S('l_suppkey % 8')})",
    "ja3": f"CASE WHEN l_partkey % 5 = 0 THEN concat('j', {_S('l_partkey')}) ELSE '' END",
}

DNS = {
    "event_id": "event_id",
    "ts": "CAST(ts AS TIMESTAMP)",
    "srcIP": f"""CASE CAST(user_id % 5 AS INT) WHEN 0 THEN concat('10.0.0.', {_S('user_id % 250')})
  WHEN 1 THEN concat('192.168.1.', {_S('user_id % 250')}) WHEN 2 THEN concat('fd00::', {_S('1 + user_id % 250')})
  WHEN 3 THEN concat('9.9.9.', {_S('user_id % 250')}) ELSE concat('10.1.0.', {_S('user_id % 250')}) END""",
    "srcPort": "CAST(1024 + event_id % 60000 AS INT)",
    "destIP": f"concat('10.53.0.', {_S('user_id % 4')})",
    "query": """concat(event_type, '.', CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'example.com' WHEN 1 THEN 'corp.lan'
  WHEN 2 THEN 'printer.local' WHEN 3 THEN 'Sub.Internal' WHEN 4 THEN '1.in-addr.arpa' WHEN 5 THEN 'notlan'
  ELSE 'intra.example.org' END)""",
    "qtype": "CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'A' WHEN 1 THEN 'AAAA' ELSE 'TXT' END",
    "proto": "CASE WHEN event_id % 2 = 0 THEN 'udp' ELSE 'tcp' END",
    "sensor": f"concat('s', {_S('user_id % 8')})",
}

# few distinct questions, so that repeats are close together
CHATTER = {
    "event_id": "event_id",
    "ts": "CAST(ts AS TIMESTAMP)",
    "srcIP": f"concat('10.0.0.', {_S('user_id % 3')})",
    "destIP": "'10.53.0.1'",
    "query": "concat(event_type, '.example.com')",
    "qtype": "CASE WHEN event_id % 4 = 0 THEN 'AAAA' ELSE 'A' END",
    "sensor": f"concat('s', {_S('user_id % 2')})",
}

HTTP = {
    "page_id": "page_id",
    "ts": "TIMESTAMP '2024-01-01 00:00:00'",
    "srcIP": f"""CASE WHEN page_id % 5 = 3 THEN concat('9.9.9.', {_S('page_id % 250')})
  ELSE concat('10.0.', {_S('page_id % 200')}, '.', {_S('page_id % 250')}) END""",
    "srcPort": "CAST(1024 + page_id % 60000 AS INT)",
    "url": f"""CASE CAST(page_id % 6 AS INT) WHEN 0 THEN url WHEN 1 THEN concat('http://Wiki.corp.LAN:8080/p/', {_S('page_id')})
  WHEN 2 THEN replace(replace(url, 'https://', ''), 'http://', '') WHEN 3 THEN concat('/only/path/', {_S('page_id')})
  WHEN 4 THEN concat('https://printer.local/?q=', {_S('page_id')}) ELSE url END""",
    "method": "CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END",
    "status": "CAST(200 + page_id % 5 AS INT)",
    "bytesIn": "length(html)",
    "userAgent": f"concat('agent/', {_S('page_id % 9')})",
}

ALERT_EVENT = {
    "alert_id": "o_orderkey",
    "eventType": "CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'dns' WHEN 1 THEN 'ip' ELSE 'http' END",
    "ts": "CAST(o_orderdate AS TIMESTAMP)",
    "srcIP": f"""CASE WHEN o_custkey % 4 = 0 THEN concat('9.9.9.', {_S('o_custkey % 250')})
  ELSE concat('10.0.', {_S('o_custkey % 200')}, '.', {_S('o_custkey % 250')}) END""",
    "srcPort": "CAST(1024 + o_orderkey % 60000 AS INT)",
    "destIP": f"concat('8.8.', {_S('o_custkey % 200')}, '.8')",
    "destPort": "443",
    "proto": "'tcp'",
    "bytesIn": "CAST(o_orderkey % 1000 AS BIGINT)",
    "bytesOut": "CAST(o_custkey AS BIGINT)",
    "query": f"concat('q', {_S('o_custkey')}, '.example.com')",
    "qtype": "'A'",
    "flag": "CASE WHEN o_orderstatus = 'F' THEN 'c2' ELSE 'young=domain' END",
}

# A part brand is a threat id; every ninth is missing from the catalogue.
THREAT = {
    "id": "p_brand",
    "title": "concat('Threat | ', p_brand)",
    "severity": "CAST(substr(p_brand, 7) AS INT) % 6",
    "policy": "CAST(substr(p_brand, 7) AS INT) % 2 = 0",
}
KNOWN_THREAT = "CAST(substr(p_brand, 7) AS INT) % 9 <> 0"

_TABLES = {"conn": "lineitem", "dns": "events", "chatter": "events", "http": "pages", "alert": "orders"}
_VIEWS = {"conn": CONN, "dns": DNS, "chatter": CHATTER, "http": HTTP, "alert": ALERT_EVENT}


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table, spread over the cores when its scan has fewer splits than there are cores.

    One small file is one split, hence one task; a large table has splits enough,
    in however few files, and is left as it is: nothing is shuffled.
    """
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame."""
    table = read_table(spark, sf_dir, _TABLES[name])
    return table.selectExpr(*[f"{expr} AS {column}" for column, expr in _VIEWS[name].items()])


def view_sql(name: str) -> str:
    """The view as a parenthesised SQL query."""
    columns = ", ".join(f'{expr} AS "{column}"' for column, expr in _VIEWS[name].items())
    return f"(SELECT {columns} FROM {_TABLES[name]})"


# --- plain SQL tests used by the checks ------------------------------------------


def valid4(ip: str) -> str:
    octets = " AND ".join(f"TRY_CAST(split_part({ip}, '.', {i}) AS BIGINT) <= 255" for i in range(1, 5))
    return f"(regexp_matches({ip}, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') AND {octets})"


def int4(ip: str) -> str:
    return "(" + " + ".join(
        f"TRY_CAST(split_part({ip}, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5)
    ) + ")"


def valid_ip(ip: str) -> str:
    return f"coalesce({valid4(ip)} OR contains({ip}, ':'), false)"


def in_nets(ip: str, cidrs: list[str], v6: list[str] = ()) -> str:
    """Address in IPv4 networks (integer ranges) or matching IPv6 text patterns."""
    tests = []
    for cidr in cidrs:
        net = ipaddress.ip_network(cidr)
        tests.append(f"{int4(ip)} BETWEEN {int(net[0])} AND {int(net[-1])}")
    four = f"({valid4(ip)} AND ({' OR '.join(tests) or 'false'}))"
    six = " OR ".join(f"{ip} LIKE '{pattern}'" for pattern in v6) or "false"
    return f"coalesce({four} OR ({six}), false)"
