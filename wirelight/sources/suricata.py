"""Suricata EVE JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelight import schemas
from wirelight.functions import values as v
from wirelight.functions.columns import derive_once
from wirelight.functions.names import join_clean_path, scheme_by_port
from wirelight.functions.times import eve_ts
from wirelight.sources.lines import Shape, all_types, first_error, one_type

_CORRUPT = "_corrupt"
_SCHEMA = T.StructType([*schemas.EVE_RECORD.fields, T.StructField(_CORRUPT, T.StringType())])


def _records(lines: DataFrame) -> DataFrame:
    parsed = F.from_json("value", _SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    return derive_once(lines.where(F.col("value") != ""), {"e": parsed})


def _problem():
    ts = eve_ts("e.timestamp")
    port = F.col("e.src_port")
    return first_error(
        (F.col(f"e.{_CORRUPT}").isNotNull(), "suricata: not a valid record"),
        (F.col("e.timestamp").isNotNull() & ts.isNull(), "suricata: bad timestamp"),
        (~port.between(0, 65535), "suricata: bad port"),
    )


def _shapes() -> dict[str, Shape]:
    broken = F.col(f"e.{_CORRUPT}").isNotNull()
    url = F.concat(scheme_by_port("e.dest_port"), join_clean_path("e.http.hostname", "e.http.url"))
    nothing = F.lit(None).cast("bigint")
    dns = {
        "ts": eve_ts("e.timestamp"), "srcPort": F.lit(None).cast("int"), "destPort": F.col("e.dest_port"),
        "proto": v.lower_proto("e.proto"), "query": F.col("e.dns.rrname"), "qtype": F.col("e.dns.rrtype"),
    }
    http = {
        "ts": eve_ts("e.timestamp"), "srcPort": F.col("e.src_port"), "url": url, "method": F.col("e.http.http_method"),
        "status": F.col("e.http.status"), "action": F.lit(None).cast("string"), "bytesIn": nothing, "bytesOut": nothing,
        "contentType": F.col("e.http.http_content_type"), "referrer": F.col("e.http.http_refer"),
        "userAgent": F.col("e.http.http_user_agent"),
    }
    source = {"srcIP": F.col("e.src_ip")}
    return {
        "dns": Shape(dns, source, _problem(), broken | (F.col("e.dns.type") == "query")),
        "http": Shape(http, source, _problem(), broken | (F.col("e.http.hostname") != "")),
    }


def suricata_dns(lines: DataFrame, on_error: str = "fail") -> DataFrame:
    """DNS queries; answers and other records are skipped."""
    return one_type(_records(lines), _shapes()["dns"], F.col("value"), on_error)


def suricata_http(lines: DataFrame, on_error: str = "fail") -> DataFrame:
    """HTTP requests with a host name; byte counts are not part of the records."""
    return one_type(_records(lines), _shapes()["http"], F.col("value"), on_error)


def suricata_all(lines: DataFrame, kinds: list[str], on_error: str = "fail") -> DataFrame:
    """Queries and requests, each record parsed once."""
    shapes = _shapes()
    return all_types(_records(lines), {kind: shapes[kind] for kind in kinds}, F.col("value"), on_error)
