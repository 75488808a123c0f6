"""Networks, domains, scope verdicts, batching, paging and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelight.functions.ip import with_ip_keys
from wirelight.operators.busy_groups import dedup_last8_sliced
from wirelight.operators.dedup import dedup_horizon, dedup_last8, flush_batches
from wirelight.operators.domains import domain_join, drop_trusted
from wirelight.operators.networks import NetworkMatch, cidr_filter, cidr_join, cidr_join_sorted
from wirelight.operators.projections import (
    event_unified, to_dns_entry, to_http_entry, to_ip_entry, union_inputs,
)
from wirelight.operators.reports import ingest_report
from wirelight.operators.scope import (
    fold_verdicts, groups_of_src, scope_dns, scope_http, scope_ip, scope_join,
)
from wirelight.operators.special import SPECIAL_IPV4, drop_special
from wirelight.plans.registry import query
from wirelight.plans.views import in_nets, int4, read_table, valid4, valid_ip, view, view_sql
from wirelight.sources.scope_file import ScopeGroup, load_scope, scope_domains, scope_frame, scope_networks

_IN4 = ["10.0.0.0/8", "192.168.0.0/16", "172.16.0.0/12"]
_TRUST4 = ["10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/8",
           "255.255.255.255/32"]
_ULA = ["fc%", "fd%"]
_LOCAL6 = ["fe8%", "fe9%", "fea%", "feb%"]
_SPECIAL6 = [*_LOCAL6, *_ULA, "::1", "2001:db8:%", "2002:%", "2001::%", "ff%"]

# A scope of several overlapping groups.
GROUPS = [
    ScopeGroup("branch", "Branch offices", ("10.1.0.0/16", "192.168.0.0/16"), ("10.1.7.0/24",), ("8.8.0.0/16",),
               ("*.example.com",)),
    ScopeGroup("core", "Core", ("10.0.0.0/8", "fc00::/7"), ("10.2.0.0/15",), ("10.0.0.0/8",), ("*.lan", "*.internal")),
    ScopeGroup("guest", "Guests", ("172.16.0.0/12",), (), (), ("click.printer.local",)),
]


def _group_tests(ip: str) -> dict[str, tuple[str, str]]:
    """Per group of GROUPS: (source matched, source excluded) in SQL."""
    return {
        "branch": (in_nets(ip, ["10.1.0.0/16", "192.168.0.0/16"]), in_nets(ip, ["10.1.7.0/24"])),
        "core": (in_nets(ip, ["10.0.0.0/8"], _ULA), in_nets(ip, ["10.2.0.0/15"])),
        "guest": (in_nets(ip, ["172.16.0.0/12"]), "false"),
    }


def _verdict_sql(missing: str, tests: dict[str, tuple[str, str]]) -> str:
    """keep, reason from (matched, excluded) per group, groups in name order."""
    denied = " ".join(f"WHEN {m} AND {x} THEN '{g}'" for g, (m, x) in sorted(tests.items()))
    matched = " OR ".join(m for m, _ in tests.values())
    reason = f"CASE WHEN {missing} THEN '<no-data>' {denied} WHEN NOT ({matched}) THEN '<no-match>' END"
    return f"({reason}) IS NULL AS keep, {reason} AS reason"


def _multi(event_type: str) -> str:
    if event_type == "ip":
        dst = {"branch": in_nets('"destIP"', ["8.8.0.0/16"]), "core": in_nets('"destIP"', ["10.0.0.0/8"]), "guest": "false"}
        missing = f"NOT {valid_ip('\"srcIP\"')} OR NOT {valid_ip('\"destIP\"')}"
        extra = dst
    else:
        host = 'lower("query")' if event_type == "dns" else (
            "lower(nullif(regexp_extract(url, '^(?:(.*?)://)?([-a-zA-Z0-9_.]+)(?:[:](\\d+))?[^?&#]*', 2), ''))"
        )
        extra = {
            "branch": f"coalesce(({host} = 'example.com' OR {host} LIKE '%.example.com'), false)",
            "core": f"coalesce(({host} LIKE '%.lan' OR {host} = 'lan' OR {host} LIKE '%.internal'), false)",
            "guest": f"coalesce({host} = 'click.printer.local', false)",
        }
        missing = f"NOT {valid_ip('\"srcIP\"')}" + (" OR coalesce(url, '') = ''" if event_type == "http" else "")
    tests = {g: (m, f"({x} OR {extra[g]})") for g, (m, x) in _group_tests('"srcIP"').items()}
    return _verdict_sql(missing, tests)


_SCOPE_IP = _verdict_sql(
    f"NOT {valid_ip('\"srcIP\"')} OR NOT {valid_ip('\"destIP\"')}",
    {"default": (in_nets('"srcIP"', _IN4, _ULA), in_nets('"destIP"', _TRUST4, [*_ULA, *_LOCAL6, "ff%"]))},
)


@query("j06_scope_ip", f"SELECT conn_id, {_SCOPE_IP} FROM {view_sql('conn')}")
def scope_ip_default(spark: SparkSession, sf: str) -> DataFrame:
    """Connections against the default scope."""
    return scope_ip(view(spark, sf, "conn"), load_scope(), flag=True).select("conn_id", "keep", "reason")


@query("j06_scope_ip_kept", f"SELECT conn_id, \"srcIP\", \"destIP\", \"bytesCount\" FROM (SELECT *, {_SCOPE_IP} FROM {view_sql('conn')}) WHERE keep")
def scope_ip_kept(spark: SparkSession, sf: str) -> DataFrame:
    return scope_ip(view(spark, sf, "conn"), load_scope()).select("conn_id", "srcIP", "destIP", "bytesCount")


@query("j06_scope_ip_join", f"SELECT conn_id, {_multi('ip')} FROM {view_sql('conn')}")
def scope_ip_join(spark: SparkSession, sf: str) -> DataFrame:
    """Connections against a scope kept as a table."""
    out = scope_join(view(spark, sf, "conn"), scope_frame(spark, GROUPS), "ip", flag=True)
    return out.select("conn_id", "keep", "reason")


@query("j06_scope_ip_join_sorted", f"SELECT conn_id, {_multi('ip')} FROM {view_sql('conn')}")
def scope_ip_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """The same by address order, as for a scope too large to broadcast."""
    out = scope_join(view(spark, sf, "conn"), scope_frame(spark, GROUPS), "ip", flag=True, by_order=True)
    return out.select("conn_id", "keep", "reason")


@query("j06_scope_ip_groups", f"SELECT conn_id, {_multi('ip')} FROM {view_sql('conn')}")
def scope_ip_groups(spark: SparkSession, sf: str) -> DataFrame:
    return scope_ip(view(spark, sf, "conn"), GROUPS, flag=True).select("conn_id", "keep", "reason")


@query("j07_scope_dns", f"SELECT event_id, {_multi('dns')} FROM {view_sql('dns')}")
def scope_dns_groups(spark: SparkSession, sf: str) -> DataFrame:
    return scope_dns(view(spark, sf, "dns"), GROUPS, flag=True).select("event_id", "keep", "reason")


@query("j07_scope_dns_join", f"SELECT event_id, {_multi('dns')} FROM {view_sql('dns')}")
def scope_dns_join(spark: SparkSession, sf: str) -> DataFrame:
    out = scope_join(view(spark, sf, "dns"), scope_frame(spark, GROUPS), "dns", flag=True)
    return out.select("event_id", "keep", "reason")


@query("j08_scope_http", f"SELECT page_id, {_multi('http')} FROM {view_sql('http')}")
def scope_http_groups(spark: SparkSession, sf: str) -> DataFrame:
    return scope_http(view(spark, sf, "http"), GROUPS, flag=True).select("page_id", "keep", "reason")


@query("j08_scope_http_join", f"SELECT page_id, {_multi('http')} FROM {view_sql('http')}")
def scope_http_join(spark: SparkSession, sf: str) -> DataFrame:
    out = scope_join(view(spark, sf, "http"), scope_frame(spark, GROUPS), "http", flag=True)
    return out.select("page_id", "keep", "reason")


# --- networks ---------------------------------------------------------------------

# Networks from the suppliers: one /16 or /24 each, some wide ones among them.
_NETS = {
    "cidr": "CASE WHEN s_suppkey % 9 = 0 THEN '10.0.0.0/8' WHEN s_suppkey % 2 = 0 THEN concat('192.168.', CAST(s_suppkey % 250 AS STRING), '.0/24') "
            "ELSE concat('81.2.', CAST(s_suppkey % 250 AS STRING), '.0/25') END",
    "tag": "concat('n', CAST(s_suppkey % 7 AS STRING))",
}
_NET_HIT = ("(c.\"srcIP\" LIKE '10.%' AND s_suppkey % 9 = 0) OR "
            "(s_suppkey % 9 <> 0 AND s_suppkey % 2 = 0 AND c.\"srcIP\" LIKE concat('192.168.', CAST(s_suppkey % 250 AS VARCHAR), '.%')) OR "
            "(s_suppkey % 9 <> 0 AND s_suppkey % 2 = 1 AND c.\"srcIP\" LIKE concat('81.2.', CAST(s_suppkey % 250 AS VARCHAR), '.%'))")
_TAGGED = (f"SELECT DISTINCT c.\"srcIP\" AS ip, concat('n', CAST(s_suppkey % 7 AS VARCHAR)) AS tag FROM "
           f"(SELECT DISTINCT \"srcIP\" FROM {view_sql('conn')} WHERE {valid_ip('\"srcIP\"')}) c JOIN supplier ON {_NET_HIT}")


def _networks(spark: SparkSession, sf: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/supplier.parquet")
    return table.selectExpr(*[f"{e} AS {n}" for n, e in _NETS.items()])


@query("j01_cidr_join", f"SELECT conn_id, coalesce(tags, '') AS tags FROM {view_sql('conn')} v LEFT JOIN "
                        f"(SELECT ip, string_agg(tag, ',' ORDER BY tag) AS tags FROM ({_TAGGED}) GROUP BY ip) t ON t.ip = v.\"srcIP\"")
def network_tags(spark: SparkSession, sf: str) -> DataFrame:
    """All networks of a table that hold a connection's source."""
    out = cidr_join(view(spark, sf, "conn"), "srcIP", _networks(spark, sf), "cidr", "tag", "tags")
    return out.select("conn_id", F.array_join("tags", ",").alias("tags"))


_PART_NET = "concat('10.', CAST(p_partkey % 4 AS VARCHAR), '.', CAST(p_partkey * 7 % 250 AS VARCHAR), '.', CAST(p_partkey * 31 % 256 AS VARCHAR))"
_PART_BITS = "CAST(14 + p_partkey % 19 AS INT)"


@query("j01_cidr_join_sorted", f"""WITH nets AS (SELECT DISTINCT p_brand AS tag, bits, {int4('ip')} // (1 << (32 - bits)) AS net FROM (SELECT p_brand, {_PART_NET} AS ip, {_PART_BITS} AS bits FROM part)),
 ips AS (SELECT DISTINCT "srcIP" AS ip, {int4('"srcIP"')} AS n FROM {view_sql('conn')} WHERE {valid4('"srcIP"')}),
 cut AS (SELECT ip, n // (1 << (32 - bits)) AS net, bits FROM ips, (SELECT DISTINCT bits FROM nets)),
 tagged AS (SELECT ip, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM cut JOIN nets USING (net, bits) GROUP BY ip)
 SELECT conn_id, coalesce(tags, '') AS tags FROM {view_sql('conn')} v LEFT JOIN tagged t ON t.ip = v."srcIP" """)
def many_networks(spark: SparkSession, sf: str) -> DataFrame:
    """A network per part, in and around each other, and all connections, in address order."""
    cidr = f"concat({_PART_NET}, '/', CAST({_PART_BITS} AS VARCHAR)) AS cidr".replace("VARCHAR", "STRING")
    nets = read_table(spark, sf, "part").selectExpr(cidr, "p_brand AS tag")
    out = cidr_join_sorted(view(spark, sf, "conn"), "srcIP", nets, "cidr", "tag", "tags")
    return out.select("conn_id", F.array_join("tags", ",").alias("tags"))


@query("j01_cidr_filter", f"SELECT conn_id FROM {view_sql('conn')} WHERE \"srcIP\" IN (SELECT ip FROM ({_TAGGED}))")
def network_filter(spark: SparkSession, sf: str) -> DataFrame:
    return cidr_filter(view(spark, sf, "conn"), "srcIP", _networks(spark, sf), "cidr").select("conn_id")


_MATCH = NetworkMatch(("10.0.0.0/8", "81.0.0.0/8", "fc00::/7"), ("10.1.0.0/16", "81.2.3.9"), ("0.0.0.0/0",),
                      ("8.0.0.0/7", "255.255.255.255"))
_SRC_IN, _SRC_OUT = in_nets('"srcIP"', ["10.0.0.0/8", "81.0.0.0/8"], _ULA), in_nets('"srcIP"', ["10.1.0.0/16", "81.2.3.9/32"])
_DST_IN, _DST_OUT = in_nets('"destIP"', ["0.0.0.0/0"]), in_nets('"destIP"', ["8.0.0.0/7", "255.255.255.255/32"])


def _matching(spark: SparkSession, sf: str) -> DataFrame:
    return with_ip_keys(view(spark, sf, "conn"), {"_src": "srcIP", "_dst": "destIP"})


@query("j02_src_match", f"SELECT conn_id, {_SRC_IN} AS matched, {_SRC_IN} AND {_SRC_OUT} AS excluded FROM {view_sql('conn')}")
def src_match(spark: SparkSession, sf: str) -> DataFrame:
    matched, excluded = _MATCH.src_match("_src")
    return _matching(spark, sf).select("conn_id", matched.alias("matched"), excluded.alias("excluded"))


@query("j03_dst_match", f"SELECT conn_id, {_DST_IN} AS matched, {_DST_IN} AND {_DST_OUT} AS excluded FROM {view_sql('conn')}")
def dst_match(spark: SparkSession, sf: str) -> DataFrame:
    matched, excluded = _MATCH.dst_match("_dst")
    return _matching(spark, sf).select("conn_id", matched.alias("matched"), excluded.alias("excluded"))


@query("j04_pair_match", f"SELECT conn_id, {_SRC_IN} AND ({_SRC_OUT} OR {_DST_IN}) AS matched, "
                         f"{_SRC_IN} AND ({_SRC_OUT} OR ({_DST_IN} AND {_DST_OUT})) AS excluded FROM {view_sql('conn')}")
def pair_match(spark: SparkSession, sf: str) -> DataFrame:
    matched, excluded = _MATCH.pair_match("_src", "_dst")
    return _matching(spark, sf).select("conn_id", matched.alias("matched"), excluded.alias("excluded"))


@query("l01_special_ip_filter", "SELECT conn_id FROM {v} WHERE NOT ((direction = 'out' AND {d}) OR (direction = 'in' AND {s}))".format(
    v=view_sql("conn"), d=in_nets('"destIP"', list(SPECIAL_IPV4), _SPECIAL6), s=in_nets('"srcIP"', list(SPECIAL_IPV4), _SPECIAL6)))
def special_filter(spark: SparkSession, sf: str) -> DataFrame:
    return drop_special(view(spark, sf, "conn")).select("conn_id")


@query("l08_valid_ip", f"SELECT conn_id FROM {view_sql('conn')} WHERE {valid_ip('\"srcIP\"')}")
def valid_sources(spark: SparkSession, sf: str) -> DataFrame:
    from wirelight.sources.documents import valid_ip as keep_valid

    return keep_valid(view(spark, sf, "conn"), "srcIP").select("conn_id")


# --- domains ------------------------------------------------------------------------

_PATTERNS = {
    "pattern": "CASE CAST(n_nationkey % 5 AS INT) WHEN 0 THEN '*.lan' WHEN 1 THEN '*.Sub.internal' WHEN 2 THEN '*.in-addr.arpa' "
               "WHEN 3 THEN 'view.example.com' ELSE '*.example.org' END",
    "tag": "concat('t', CAST(n_nationkey % 10 AS STRING))",
}
_NAME_TAGS = """CASE WHEN q LIKE '%.lan' THEN 't0,t5' WHEN q LIKE '%.sub.internal' THEN 't1,t6' WHEN q LIKE '%.in-addr.arpa' THEN 't2,t7'
 WHEN q = 'view.example.com' THEN 't3,t8' WHEN q LIKE '%.example.org' THEN 't4,t9' ELSE '' END"""


def _patterns(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/nation.parquet").selectExpr(*[f"{e} AS {n}" for n, e in _PATTERNS.items()])


@query("j05_domain_trust", f"SELECT event_id, {_NAME_TAGS} AS tags FROM (SELECT event_id, lower(\"query\") AS q FROM {view_sql('dns')})")
def trusted_tags(spark: SparkSession, sf: str) -> DataFrame:
    out = domain_join(view(spark, sf, "dns"), "query", _patterns(spark, sf), "pattern", "tag", "tags")
    return out.select("event_id", F.array_join("tags", ",").alias("tags"))


@query("j05_domain_filter", f"SELECT event_id FROM (SELECT event_id, lower(\"query\") AS q FROM {view_sql('dns')}) WHERE {_NAME_TAGS} = ''")
def untrusted(spark: SparkSession, sf: str) -> DataFrame:
    return drop_trusted(view(spark, sf, "dns"), "query", _patterns(spark, sf), "pattern").select("event_id")


# --- groups and folds ------------------------------------------------------------------

_FOUND = ", ".join(f"CASE WHEN {m} AND NOT {x} THEN '{g}' END" for g, (m, x) in sorted(_group_tests('"srcIP"').items()))


@query("j09_groups_of_src", f"SELECT conn_id, concat_ws(',', {_FOUND}) AS labels FROM {view_sql('conn')}")
def source_groups(spark: SparkSession, sf: str) -> DataFrame:
    out = groups_of_src(view(spark, sf, "conn"), GROUPS, "groups")
    return out.select("conn_id", F.array_join(F.col("groups.label"), ",").alias("labels"))


@query("a01_verdict_any_none", """SELECT l_orderkey AS order_id, bool_or(l_returnflag <> 'N') AND NOT bool_or(l_returnflag = 'R' AND l_returnflag <> 'N') AS keep,
 CASE WHEN bool_or(l_returnflag = 'R') THEN min(CASE WHEN l_returnflag = 'R' THEN concat('g', CAST(l_linenumber AS VARCHAR)) END)
      WHEN NOT bool_or(l_returnflag <> 'N') THEN '<no-match>' END AS reason FROM lineitem GROUP BY l_orderkey""")
def folded(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict rows (one per line item) folded per order."""
    tests = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_orderkey AS order_id", "concat('g', CAST(l_linenumber AS STRING)) AS name",
        "l_returnflag <> 'N' AS matched", "l_returnflag = 'R' AS excluded")
    return fold_verdicts(tests, "order_id")


_VERDICTS = f"SELECT proto, keep, coalesce(reason, '') AS reason FROM (SELECT proto, {_SCOPE_IP} FROM {view_sql('conn')})"


@query("a05_ingest_report", f"""SELECT proto AS event_type, CAST(sum(n) AS BIGINT) AS received, CAST(sum(CASE WHEN reason = '' THEN n ELSE 0 END) AS BIGINT) AS accepted,
 coalesce(string_agg(CASE WHEN reason <> '' THEN concat(reason, '=', CAST(n AS VARCHAR)) END, ',' ORDER BY reason), '') AS rejected
 FROM (SELECT proto, reason, count(*) AS n FROM ({_VERDICTS}) GROUP BY proto, reason) GROUP BY proto""")
def report(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = scope_ip(view(spark, sf, "conn"), load_scope(), flag=True).withColumn("event_type", F.col("proto"))
    entries = F.transform(F.map_entries("rejected"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return ingest_report(verdicts).select(
        "event_type", "received", "accepted", F.array_join(F.array_sort(entries), ",").alias("rejected"))


# --- scope as a table -------------------------------------------------------------------


_SUPPLIER_NET = "concat('10.', CAST(s_suppkey % 200 AS VARCHAR), '.', CAST(s_nationkey AS VARCHAR), '.0/24')"
_SUPPLIER_HOST = "concat('8.8.', CAST(s_suppkey % 200 AS VARCHAR), '.', CAST(s_nationkey AS VARCHAR))"


@query("s20_scope_table", f"""WITH s AS (SELECT concat('g', CAST(s_suppkey AS VARCHAR)) AS name, s_suppkey AS k, {_SUPPLIER_NET} AS net, {_SUPPLIER_HOST} AS host FROM supplier)
 SELECT name, CASE WHEN k % 3 = 0 THEN 'src_dst' ELSE 'src_in' END AS role, net AS entry FROM s WHERE k % 5 <> 0
 UNION ALL SELECT name, CASE WHEN k % 3 = 0 THEN 'src_dst' ELSE 'src_in' END, e FROM s, (VALUES ('0.0.0.0/0'), ('::/0')) t(e) WHERE k % 5 = 0
 UNION ALL SELECT name, 'src_out', '10.1.0.0/16' FROM s WHERE k % 2 = 0 UNION ALL SELECT name, 'dst_in', host FROM s WHERE k % 3 = 0
 UNION ALL SELECT name, 'dst_out', host FROM s UNION ALL SELECT name, 'domain', concat('*.', name, '.example.org') FROM s""")
def scope_table(spark: SparkSession, sf: str) -> DataFrame:
    """A scope group per supplier, taken apart into networks by role and trusted domains."""
    one = lambda expr, condition: f"IF({condition}, array({expr}), array())"
    net, host = _SUPPLIER_NET.replace("VARCHAR", "STRING"), _SUPPLIER_HOST.replace("VARCHAR", "STRING")
    scope = read_table(spark, sf, "supplier").selectExpr(
        "concat('g', s_suppkey) AS name", "s_name AS label", f"{one(net, 's_suppkey % 5 <> 0')} AS in_scope", f"""{one("'10.1.0.0/16'", 's_suppkey % 2 = 0')} AS out_scope""",
        f"array({host}) AS trusted_ips", "array(concat('*.g', s_suppkey, '.example.org')) AS trusted_domains", f"{one(host, 's_suppkey % 3 = 0')} AS dst_includes")
    networks = scope_networks(scope).select("name", "role", F.col("cidr").alias("entry"))
    return networks.unionByName(scope_domains(scope).select("name", F.lit("domain").alias("role"), F.col("pattern").alias("entry")))


# --- projections -------------------------------------------------------------------------


def _us(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.unix_micros(n) for n in names})


@query("p01_to_dns_entry", f"SELECT epoch_us(ts) AS ts, \"srcIP\", \"query\", qtype FROM {view_sql('dns')}")
def dns_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _us(to_dns_entry(view(spark, sf, "dns")), "ts")


@query("p02_to_ip_entry", f"""SELECT epoch_us(ts) AS ts, \"srcIP\", \"srcPort\", \"destIP\", \"destPort\", proto,
 CASE WHEN direction = 'in' THEN \"bytesCount\" ELSE 0 END AS \"bytesIn\", CASE WHEN direction = 'in' THEN 0 ELSE \"bytesCount\" END AS \"bytesOut\", ja3
 FROM {view_sql('conn')}""")
def ip_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _us(to_ip_entry(view(spark, sf, "conn")), "ts")


@query("p05_event_unified", f"""SELECT 'dns' AS "eventType", epoch_us(ts) AS ts, "srcIP", CAST(NULL AS INTEGER) AS "srcPort", "query", NULL AS url FROM {view_sql('dns')}
 UNION ALL SELECT 'http', epoch_us(ts), "srcIP", "srcPort", NULL, url FROM {view_sql('http')}""")
def unified(spark: SparkSession, sf: str) -> DataFrame:
    tables = {"dns": to_dns_entry(view(spark, sf, "dns")), "http": to_http_entry(view(spark, sf, "http"))}
    return _us(event_unified(tables).select("eventType", "ts", "srcIP", "srcPort", "query", "url"), "ts")


@query("o04_union_inputs", f"SELECT event_id, \"query\", sensor FROM {view_sql('dns')} UNION ALL SELECT event_id, \"query\", sensor FROM {view_sql('chatter')}")
def all_inputs(spark: SparkSession, sf: str) -> DataFrame:
    one, two = (view(spark, sf, v).select("event_id", "query", "sensor") for v in ("dns", "chatter"))
    return union_inputs(one, two)


# --- batches and repeats --------------------------------------------------------------------

_DAY, _SIZE = 86_400, 100
_BATCHED = f"""(SELECT *, epoch_us(ts) // 86400000000 AS win,
 (row_number() OVER (PARTITION BY sensor, epoch_us(ts) // 86400000000 ORDER BY event_id) - 1) // {_SIZE} AS batch_no FROM {view_sql('chatter')})"""


@query("w04_flush_batches", f"SELECT event_id, sensor, win * 86400000000 AS window_start, batch_no FROM {_BATCHED}")
def batches(spark: SparkSession, sf: str) -> DataFrame:
    out = flush_batches(view(spark, sf, "chatter"), "event_id", ["sensor"], seconds=_DAY, size=_SIZE)
    return _us(out.select("event_id", "sensor", "window_start", "batch_no"), "window_start")


@query("w02_dns_dedup_last8", f"""SELECT CAST(split_part(kept, '|', 2) AS BIGINT) AS event_id FROM (SELECT unnest(list_reduce(rows, lambda a, b:
 CASE WHEN list_contains(list_transform(a[-8:], lambda e: split_part(e, '|', 1)), split_part(b[1], '|', 1)) THEN a ELSE list_concat(a, b) END)) AS kept
 FROM (SELECT list([concat("srcIP", '/', qtype, '/', "query", '|', CAST(event_id AS VARCHAR))] ORDER BY event_id) AS rows FROM {_BATCHED} GROUP BY sensor, win, batch_no))""")
def unrepeated(spark: SparkSession, sf: str) -> DataFrame:
    """Rows unlike the last eight kept ones of their sensor's batch."""
    out = flush_batches(view(spark, sf, "chatter"), "event_id", ["sensor"], seconds=_DAY, size=_SIZE)
    kept = dedup_last8(out, ["sensor", "window_start", "batch_no"], ["event_id"], ["srcIP", "destIP", "qtype", "query"])
    return kept.select("event_id")


@query("w02_one_busy_sensor", f"""SELECT CAST(split_part(kept, '|', 2) AS BIGINT) AS event_id FROM (SELECT unnest(list_reduce(rows, lambda a, b:
 CASE WHEN list_contains(list_transform(a[-8:], lambda e: split_part(e, '|', 1)), split_part(b[1], '|', 1)) THEN a ELSE list_concat(a, b) END)) AS kept
 FROM (SELECT list([concat("srcIP", '/', qtype, '/', "query", '|', CAST(event_id AS VARCHAR))] ORDER BY event_id) AS rows FROM {view_sql('chatter')}))""")
def one_sensor(spark: SparkSession, sf: str) -> DataFrame:
    """The same rule over all rows as one sensor's, cut into slices that are run side by side."""
    rows = view(spark, sf, "chatter").withColumn("sensor", F.lit("busy"))
    return dedup_last8_sliced(rows, ["sensor"], ["event_id"], ["srcIP", "destIP", "qtype", "query"]).select("event_id")


@query("w03_dns_dedup_horizon", f"""SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY "srcIP", qtype, "query" ORDER BY ts, event_id) AS prev
 FROM {view_sql('chatter')}) WHERE prev IS NULL OR ts > prev + INTERVAL 2 HOUR""")
def spaced(spark: SparkSession, sf: str) -> DataFrame:
    out = dedup_horizon(view(spark, sf, "chatter"), ["srcIP", "qtype", "query"], ["event_id"], "2 HOURS")
    return out.select("event_id")
