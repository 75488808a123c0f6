"""Which format yields which event types, and how to add one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelight.operators.projections import entry_columns, to_dns_entry, to_http_entry, to_ip_entry
from wirelight.sinks.events import entry_json
from wirelight.sources import capture_ranges, dns_logs, pcap, suricata, zeek
from wirelight.sources.lines import read_landed_lines, read_lines

Reader = Callable[[SparkSession, str], DataFrame]
Parser = Callable[..., DataFrame]


@dataclass(frozen=True)
class LogFormat:
    """How to scan a format, and one parser per event type it can hold.

    ``stateless`` parsers look at one line at a time and may run on a stream;
    others take their lines from a table, see ``land_lines``.
    ``text`` formats are lines of text; only these can be tailed.  ``every`` takes
    the raw rows and event types and reads all of them in one pass.
    """

    read: Reader
    parsers: dict[str, Parser]
    stateless: bool = True
    text: bool = True
    every: Callable[..., DataFrame] | None = None


_FORMATS: dict[str, LogFormat] = {}
_ENTRIES = {"dns": to_dns_entry, "ip": to_ip_entry, "http": to_http_entry}


def register_format(name: str, log_format: LogFormat) -> None:
    """Make a log format available under a name (replacing any earlier one)."""
    unknown = set(log_format.parsers) - set(_ENTRIES)
    if unknown:
        raise ValueError(f"unknown event types {sorted(unknown)}")
    _FORMATS[name] = log_format


def formats() -> dict[str, LogFormat]:
    return dict(_FORMATS)


def get_format(name: str) -> LogFormat:
    if name not in _FORMATS:
        raise ValueError(f"format {name!r} is not supported, known: {sorted(_FORMATS)}")
    return _FORMATS[name]


def parse(rows: DataFrame, name: str, event_type: str, **options) -> DataFrame:
    """Typed rows of one event type from the raw rows of a format."""
    parsers = get_format(name).parsers
    if event_type not in parsers:
        raise ValueError(f"{name} holds no {event_type} events")
    return parsers[event_type](rows, **options)


def read_events(spark: SparkSession, path: str, name: str, event_type: str, **options) -> DataFrame:
    return parse(get_format(name).read(spark, path), name, event_type, **options)


def read_all_types(rows: DataFrame, name: str, types: list[str] | None = None, **options) -> DataFrame:
    """Every event type the format holds (or the given ones) from one pass over its rows.

    ``event_type`` and the columns of all types; see ``of_type`` and ``write_all_types``.
    """
    known = get_format(name)
    wanted = types or sorted(known.parsers)
    unknown = set(wanted) - set(known.parsers)
    if unknown:
        raise ValueError(f"{name} holds no {sorted(unknown)} events")
    if known.every is not None:
        return known.every(rows, wanted, **options)
    if len(wanted) > 1:
        raise ValueError(f"{name} has no parser for several types at once")
    return parse(rows, name, wanted[0], **options).withColumn("event_type", F.lit(wanted[0]))


def of_type(tagged: DataFrame, event_type: str) -> DataFrame:
    """The rows of one type among those of several."""
    return tagged.where(F.col("event_type") == event_type)


def write_all_types(tagged: DataFrame, path: str, types: list[str], mode: str = "append") -> None:
    """Entries of all types as JSON lines, a folder per type, in one job."""
    lines = [F.when(F.col("event_type") == kind, entry_json(kind, entry_columns(kind, tagged.columns))) for kind in types]
    conf, name = tagged.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    # a task keeps a file open per type; Spark sorts all its events by type otherwise, or once it has as many files open
    conf.set(name, str(len(types) + 1))
    try:
        tagged.select("event_type", F.coalesce(*lines).alias("value")).write.mode(mode).partitionBy("event_type").text(path)
    finally:
        conf.set(name, before)


def to_entry(rows: DataFrame, event_type: str) -> DataFrame:
    """Typed rows as wire entries of their event type."""
    return _ENTRIES[event_type](rows)


def events_found(tagged: DataFrame) -> DataFrame:
    """Rows found per event type and input file."""
    return tagged.groupBy("event_type", "source_file").agg(F.count("*").alias("found"))


def _zeek(kind: str) -> Parser:
    return lambda rows, **options: zeek.zeek_events(rows, kind, **options)


register_format("bro", LogFormat(read_landed_lines, {k: _zeek(k) for k in ("dns", "ip", "http")}, stateless=False, every=zeek.zeek_all))
register_format("suricata", LogFormat(read_lines, {"dns": suricata.suricata_dns, "http": suricata.suricata_http}, every=suricata.suricata_all))
register_format("msdns", LogFormat(read_lines, {"dns": dns_logs.msdns_dns}))
register_format("syslog-named", LogFormat(read_lines, {"dns": dns_logs.named_dns}))
register_format("edge", LogFormat(dns_logs.read_edge, {"dns": dns_logs.edge_dns}, text=False))
register_format("pcap", LogFormat(capture_ranges.pcap_frames, {"dns": pcap.frames_dns, "ip": pcap.frames_ip}, text=False, every=pcap.frames_all))
