"""Scalar clean-up used by the log formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelight.functions.columns import ColumnOrName, as_column

# DNS record types by number, as registered.
DNS_TYPES = {
    1: "A", 2: "NS", 3: "MD", 4: "MF", 5: "CNAME", 6: "SOA", 7: "MB", 8: "MG", 9: "MR",
    10: "NULL", 11: "WKS", 12: "PTR", 13: "HINFO", 14: "MINFO", 15: "MX", 16: "TXT",
    28: "AAAA", 33: "SRV", 41: "OPT", 256: "URI", 257: "CAA",
}

_SPACE = " \t\n\x0b\x0c\r\u0085\u00a0"


def trim_space(text: ColumnOrName) -> Column:
    return F.trim(as_column(text), F.lit(_SPACE))


def lower_proto(proto: ColumnOrName) -> Column:
    return F.lower(as_column(proto))


def msdns_name(text: ColumnOrName) -> Column:
    """``(8)host(3)com(0)`` -> ``host.com``."""
    return F.trim(F.regexp_replace(as_column(text), r"\(\d+\)", "."), F.lit("."))


def blank_unset(value: ColumnOrName, empty: ColumnOrName, unset: ColumnOrName) -> Column:
    """Empty string for the format's empty and unset markers."""
    value = as_column(value)
    marked = value.eqNullSafe(as_column(empty)) | value.eqNullSafe(as_column(unset))
    return F.when(marked, "").otherwise(value)


def port16(text: ColumnOrName) -> Column:
    """Unsigned 16-bit number from digits; NULL otherwise."""
    text = as_column(text)
    number = text.try_cast("int")
    return F.when(text.rlike(r"\A[0-9]+\z") & number.between(0, 65535), number)


def count64(text: ColumnOrName) -> Column:
    """Signed 64-bit number from text; NULL otherwise."""
    text = as_column(text)
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))


def byte_total(*counters: Column) -> Column:
    """Sum of the positive counters; unset (NULL) and negative ones count as 0."""
    total = F.lit(0).cast("bigint")
    for counter in counters:
        total = total + F.greatest(F.coalesce(counter.try_cast("bigint"), F.lit(0)), F.lit(0))
    return total


def proto_name(number: ColumnOrName) -> Column:
    number = as_column(number)
    return F.when(number == 6, "tcp").when(number == 17, "udp").otherwise(number.cast("string"))


def dns_type_name(number: ColumnOrName) -> Column:
    """Record type name; types without one are shown as ``Unknown``."""
    number = as_column(number)
    names = F.create_map(*[F.lit(x) for pair in DNS_TYPES.items() for x in pair])
    return F.when(number.isNotNull(), F.coalesce(F.try_element_at(names, number.cast("int")), F.lit("Unknown")))
