"""Event, alert and log record schemas (column names are the wire names)."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_TS, _STR, _INT, _BIG, _BOOL = (
    T.TimestampType(),
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.BooleanType(),
)

DNS_ENTRY = _struct(("ts", _TS), ("srcIP", _STR), ("query", _STR), ("qtype", _STR))

IP_ENTRY = _struct(
    ("ts", _TS), ("srcIP", _STR), ("srcPort", _INT), ("destIP", _STR), ("destPort", _INT),
    ("proto", _STR), ("bytesIn", _BIG), ("bytesOut", _BIG), ("ja3", _STR),
)

HTTP_ENTRY = _struct(
    ("ts", _TS), ("srcIP", _STR), ("srcPort", _INT), ("url", _STR), ("method", _STR),
    ("status", _INT), ("action", _STR), ("bytesIn", _BIG), ("bytesOut", _BIG),
    ("contentType", _STR), ("referrer", _STR), ("userAgent", _STR),
)

TLS_ENTRY = _struct(
    ("ts", _TS), ("srcIP", _STR), ("srcPort", _INT), ("destIP", _STR), ("destPort", _INT),
    ("certHash", _STR), ("issuer", _STR), ("subject", _STR), ("validFrom", _TS),
    ("validTo", _TS), ("ja3", _STR), ("ja3s", _STR),
)

ENTRY = {"dns": DNS_ENTRY, "ip": IP_ENTRY, "http": HTTP_ENTRY, "tls": TLS_ENTRY}

# Fields of an event record that are written only when they hold a value.
OPTIONAL = {
    "dns": frozenset(),
    "ip": frozenset(),
    "http": frozenset(),
    "tls": frozenset(TLS_ENTRY.names) - {"ts", "srcIP", "srcPort"},
}

UNIFIED_EVENT = _struct(
    ("ts", _TS), ("srcIP", _STR), ("srcPort", _INT), ("srcHost", _STR), ("srcMac", _STR),
    ("srcUser", _STR), ("srcID", _STR), ("connID", _STR), ("bytesIn", _BIG),
    ("bytesOut", _BIG), ("query", _STR), ("qtype", _STR), ("destIP", _STR),
    ("destPort", _INT), ("proto", _STR), ("ja3", _STR), ("url", _STR), ("method", _STR),
    ("status", _INT), ("action", _STR), ("contentType", _STR), ("referrer", _STR),
    ("userAgent", _STR),
)

CATALOGUE_THREAT = _struct(("title", _STR), ("severity", _INT), ("policy", _BOOL))

ALERT = _struct(
    ("eventType", _STR),
    ("event", UNIFIED_EVENT),
    ("threats", T.ArrayType(_STR)),
    ("wisdom", _struct(("flags", T.ArrayType(_STR)), ("labels", T.ArrayType(_STR)))),
)

ALERT_PAGE = _struct(
    ("follow", _STR), ("more", _BOOL), ("after", _STR), ("before", _STR),
    ("alerts", T.ArrayType(ALERT)),
    ("threats", T.MapType(_STR, CATALOGUE_THREAT)),
)

EVE_RECORD = _struct(
    ("timestamp", _STR), ("src_ip", _STR), ("src_port", _INT), ("dest_port", _INT),
    ("proto", _STR),
    ("dns", _struct(("type", _STR), ("rrname", _STR), ("rrtype", _STR))),
    ("http", _struct(
        ("hostname", _STR), ("url", _STR), ("http_user_agent", _STR),
        ("http_content_type", _STR), ("http_refer", _STR), ("http_method", _STR),
        ("status", _INT),
    )),
)

EDGE_RECORD = _struct(
    ("time", _BIG), ("source", _STR), ("query", _STR), ("queryType", _STR),
    ("queryProtocol", _STR),
)

FRAME = _struct(
    ("source_file", _STR), ("frame_no", _BIG), ("ts", _TS), ("linktype", _INT),
    ("captured", _INT), ("payload", T.BinaryType()),
)
