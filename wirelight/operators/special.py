"""Special-use addresses (reserved, private, multicast, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelight.functions.columns import ColumnOrName, as_column
from wirelight.functions.ip import in_prefixes
from wirelight.operators.networks import keyed_events, prefixes_of

# Special-use IPv4 networks (RFC 3330).
SPECIAL_IPV4 = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "14.0.0.0/8",
    "24.0.0.0/8",
    "39.0.0.0/8",
    "127.0.0.0/8",
    "128.0.0.0/16",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "191.255.0.0/16",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.88.99.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "223.255.255.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
)

# Special-use IPv6 networks (RFC 5156).
SPECIAL_IPV6 = (
    "::1/128",
    "fe80::/10",
    "fc00::/7",
    "2001:db8::/32",
    "2002::/16",
    "2001::/32",
    "5f00::/8",
    "3ffe::/16",
    "2001:10::/28",
    "ff00::/8",
)

_SPECIAL = prefixes_of(SPECIAL_IPV4 + SPECIAL_IPV6)


def is_special_ip(key: ColumnOrName) -> Column:
    """Is the address (key) reserved? 28 networks, five membership tests."""
    return in_prefixes(key, _SPECIAL)


def is_local_chatter(direction: ColumnOrName, src_key: ColumnOrName, dst_key: ColumnOrName) -> Column:
    """Outgoing to, or incoming from, a special address; unknown direction never is."""
    direction = as_column(direction)
    chatter = F.when(direction == "out", is_special_ip(dst_key)).when(
        direction == "in", is_special_ip(src_key)
    )
    return F.coalesce(chatter, F.lit(False))


def drop_special(events: DataFrame) -> DataFrame:
    """Keep connection rows that are not local chatter."""
    keyed = keyed_events(events, "_src", "_dst")
    return keyed.where(~is_local_chatter("direction", "_src", "_dst")).drop("_src", "_dst")
