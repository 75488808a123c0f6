"""CIDR containment and include/exclude matching."""

from __future__ import annotations

from dataclasses import dataclass, field
import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelight.functions.columns import ColumnOrName
from wirelight.functions.ip import cidr_prefixes, in_prefixes, with_cidr_keys, with_ip_keys
from wirelight.operators.intervals import interval_join
from wirelight.operators.lookup import broadcast_levels, level_join, materialise

ANYWHERE = ("0.0.0.0/0", "::/0")

# Above this many networks in one list, tests become joins.
LITERAL_LIMIT = 2000


def network_prefixes(entry: str, plain_ip: bool = False) -> list[str]:
    """Key prefixes of one configured network; ValueError when it is malformed."""
    address, slash, bits = entry.partition("/")
    if (not slash and not plain_ip) or (slash and not bits.isdigit()):
        raise ValueError(f"{entry} is not cidr" + (" or ip" if plain_ip else ""))
    if "%" in entry:
        raise ValueError(f"{entry}: zones are not allowed")
    net = ipaddress.ip_network(entry, strict=False)
    if net.version == 6 and net.network_address.ipv4_mapped is not None and net.prefixlen >= 96:
        net = ipaddress.ip_network((net.network_address.ipv4_mapped, net.prefixlen - 96))
    digits = net.max_prefixlen // 4
    whole, rest = divmod(net.prefixlen, 4)
    start = f"{int(net.network_address):0{digits}X}"
    if not rest:
        return [f"{net.version}{start[:whole]}"]
    nibble = int(start[whole], 16)
    return [f"{net.version}{start[:whole]}{n:X}" for n in range(nibble, nibble + 2 ** (4 - rest))]


def prefixes_of(entries: list[str] | tuple[str, ...], plain_ip: bool = False) -> list[str]:
    return [p for entry in entries for p in network_prefixes(entry, plain_ip)]


def in_networks(key: ColumnOrName, entries: list[str] | tuple[str, ...]) -> Column:
    """Is the address (key) in any of the configured networks or plain addresses?"""
    return in_prefixes(key, prefixes_of(entries, plain_ip=True))


@dataclass(frozen=True)
class NetworkMatch:
    """Include and exclude lists for sources and destinations (empty include: all)."""

    src_includes: tuple[str, ...] = ()
    src_excludes: tuple[str, ...] = ()
    dst_includes: tuple[str, ...] = ()
    dst_excludes: tuple[str, ...] = ()
    _prefixes: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        self._prefixes.update(
            src_in=prefixes_of(self.src_includes or ANYWHERE),
            src_out=prefixes_of(self.src_excludes, plain_ip=True),
            dst_in=prefixes_of(self.dst_includes or ANYWHERE),
            dst_out=prefixes_of(self.dst_excludes, plain_ip=True),
        )

    def prefixes(self, role: str) -> list[str]:
        return self._prefixes[role]

    def src_match(self, key: ColumnOrName) -> tuple[Column, Column]:
        """(matched, excluded) of a source address key."""
        matched = in_prefixes(key, self.prefixes("src_in"))
        return matched, matched & in_prefixes(key, self.prefixes("src_out"))

    def dst_match(self, key: ColumnOrName) -> tuple[Column, Column]:
        matched = in_prefixes(key, self.prefixes("dst_in"))
        return matched, matched & in_prefixes(key, self.prefixes("dst_out"))

    def pair_match(self, src: ColumnOrName, dst: ColumnOrName) -> tuple[Column, Column]:
        """The source decides unless it matched and is not excluded."""
        src_matched, src_excluded = self.src_match(src)
        dst_matched, dst_excluded = self.dst_match(dst)
        by_src = ~src_matched | src_excluded
        return (
            F.when(by_src, src_matched).otherwise(dst_matched),
            F.when(by_src, src_excluded).otherwise(dst_excluded),
        )


def network_table(cidrs: DataFrame, cidr: str, *tags: str, strict: bool = False) -> DataFrame:
    """One row (prefix, tags...) per key prefix of each valid network, as a written table.

    Malformed networks are left out, or an error with ``strict``.
    """
    return materialise(_prefix_rows(cidrs, cidr, *tags, strict=strict).distinct(), "networks")


def network_entries(cidrs: DataFrame, cidr: str, tag: str, strict: bool = False) -> DataFrame:
    """One row (level, entry, tags) per distinct key prefix, its length being the level, as a written table."""
    rows = _prefix_rows(cidrs, cidr, tag, strict=strict)
    entries = rows.groupBy(F.col("prefix").alias("entry")).agg(F.collect_set(tag).alias("tags"))
    return materialise(entries.select(F.length("entry").alias("level"), "entry", "tags"), "networks")


def key_prefix(key: str):
    """What an address key looks up at a level of ``network_entries``."""
    return lambda level: F.substring(key, 1, level)


def _prefix_rows(cidrs: DataFrame, cidr: str, *tags: str, strict: bool = False) -> DataFrame:
    keyed = with_cidr_keys(cidrs.select(cidr, *tags), cidr, "_net")
    prefixes = cidr_prefixes(cidr, "_net")
    if strict:
        message = F.concat(F.coalesce(F.col(cidr), F.lit("NULL")), F.lit(" is not cidr or ip"))
        prefixes = F.coalesce(prefixes, F.raise_error(message).cast("array<string>"))
    return keyed.select(F.explode(prefixes).alias("prefix"), *tags)


def cidr_join(
    events: DataFrame, ip: str, cidrs: DataFrame, cidr: str, tag: str, out: str
) -> DataFrame:
    """Add ``out``: the sorted tags of all networks that hold the event's address.

    Networks of a small size in bytes are broadcast.  Beyond it events meet the
    networks in address order, see ``interval_join``.
    """
    entries = network_entries(cidrs, cidr, tag)
    levels = broadcast_levels(entries, F.lit(True))
    if levels is None:
        return _tagged(events, ip, entries, out)
    small = entries.select("level", "entry", F.struct("tags").alias("facts"))
    keyed = with_ip_keys(events, {"_ip_key": ip})
    found = level_join(keyed, small, levels[0], key_prefix("_ip_key"), "_facts")
    return found.select(*events.columns, F.coalesce("_facts.tags", F.array().cast("array<string>")).alias(out))


def cidr_join_sorted(events: DataFrame, ip: str, cidrs: DataFrame, cidr: str, tag: str, out: str) -> DataFrame:
    """``cidr_join`` for network tables that are known to be large."""
    return _tagged(events, ip, network_entries(cidrs, cidr, tag), out)


def _tagged(events: DataFrame, ip: str, entries: DataFrame, out: str) -> DataFrame:
    facts = entries.select("level", "entry", F.struct("tags").alias("facts"))
    joined = interval_join(with_ip_keys(events, {"_ip_key": ip}), "_ip_key", facts, "_facts")
    return joined.select(*events.columns, F.coalesce("_facts.tags", F.array().cast("array<string>")).alias(out))


def cidr_filter(events: DataFrame, ip: str, cidrs: DataFrame, cidr: str) -> DataFrame:
    """Events whose address is in any network of the table.

    A short list is read once and becomes a literal membership test without any
    shuffle; a longer one goes through ``cidr_join``.
    """
    networks = network_table(cidrs, cidr)
    short = networks.limit(LITERAL_LIMIT + 1).collect()
    if len(short) <= LITERAL_LIMIT:
        keyed = with_ip_keys(events, {"_ip_key": ip})
        return keyed.where(in_prefixes("_ip_key", [r.prefix for r in short])).drop("_ip_key")
    tagged = cidr_join(events, ip, cidrs.withColumn("_any", F.lit("x")), cidr, "_any", "_tags")
    return tagged.where(F.size("_tags") > 0).drop("_tags")


def keyed_events(events: DataFrame, src: str | None = None, dst: str | None = None) -> DataFrame:
    """Add address keys under the given names.

    Tables that still carry ``srcKey``/``destKey`` from their reader reuse them.
    """
    wanted = {name: (key, ip) for name, key, ip in
              ((src, "srcKey", "srcIP"), (dst, "destKey", "destIP")) if name}
    ready = {name: F.col(key) for name, (key, _) in wanted.items() if key in events.columns}
    parsed = {name: ip for name, (key, ip) in wanted.items() if name not in ready}
    events = events.withColumns(ready) if ready else events
    return with_ip_keys(events, parsed) if parsed else events
