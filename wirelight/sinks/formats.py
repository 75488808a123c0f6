"""Alert text formats: JSON, CEF, LEEF and GELF.

Each formatter takes flat alert events (``operators.alerts.enrich_alerts``) and
returns a table with one text column ``value``.  JSON gives a line per alert, the
others a line per threat of an alert.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelight import __version__, schemas
from wirelight.functions.times import wire_time

Formatter = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Product:
    """What the lines name as their origin."""

    vendor: str = "Wirelight"
    product: str = "Telemetry"
    version: str = __version__
    host: str = "localhost"
    level: int = 1

    @property
    def agent(self) -> str:
        return f"{self.vendor} {self.product}/{self.version}"


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _number(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def _address(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("<nil>"))


def _present(column: str) -> Column:
    """NULL (and so left out of JSON) for empty text and zero."""
    field = schemas.UNIFIED_EVENT[column]
    blank = F.lit("") if field.dataType.typeName() == "string" else F.lit(0).cast(field.dataType)
    return F.nullif(F.col(column), blank)


def alert_json(alerts: DataFrame) -> DataFrame:
    """One JSON object per alert; optional fields only when they hold a value."""
    policy = F.transform_values(F.col("threats"), lambda _, t: F.struct(
        t["severity"].alias("severity"), t["desc"].alias("desc"),
        F.when(t["policy"], True).alias("policy"),
    ))
    event = [
        (wire_time("ts") if n == "ts" else _text(n) if n == "srcIP" else _present(n)).alias(n)
        for n in schemas.UNIFIED_EVENT.names
    ]
    record = F.struct(
        "severity", policy.alias("threats"), "flags",
        F.when(F.size("labels") > 0, F.col("labels")).alias("labels"), "groups", "eventType", *event,
    )
    return alerts.select(F.to_json(record).alias("value"))


def per_threat(alerts: DataFrame) -> DataFrame:
    """One row per alert and threat: adds threatId and threat {severity, desc, policy}."""
    # of a plain explode Spark makes a filter that works out the threats once more below
    return alerts.select("*", F.explode_outer("threats").alias("threatId", "threat")).where(F.col("threatId").isNotNull())


def _escape(value: Column, marks: str) -> Column:
    escaped = F.regexp_replace(value, rf"([{marks}])", r"\\$1")
    return F.regexp_replace(escaped, r"\n", r"\\n") if "=" in marks else escaped


def cef_line(product: Product) -> Column:
    """CEF line of a row of ``per_threat``."""
    header = [
        F.lit("CEF:0"), F.lit(product.vendor), F.lit(product.product), F.lit(product.version),
        F.col("threatId"), F.col("threat.desc"), (F.col("threat.severity") * 2).cast("string"),
    ]
    header = [header[0], *[_escape(part, r"\\|") for part in header[1:]]]

    def pair(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"{key}="), _escape(value, r"\\="))

    flags, groups = F.array_join("flags", ","), F.array_join(F.col("groups.label"), ",")
    listed = F.size("groups") > 0
    dns, ip = F.col("eventType") == "dns", F.col("eventType") == "ip"
    extension = F.concat_ws(
        " ",
        pair("app", _text("eventType")),
        pair("rt", F.date_format("ts", "MMM dd yyyy HH:mm:ss.SSS z")),
        pair("src", _address("srcIP")),
        F.when(flags != "", pair("cs1", flags)),
        F.when(flags != "", F.lit("cs1Label=flags")),
        F.when(listed, pair("cs2", groups)),
        F.when(listed, F.lit("cs2Label=groups")),
        F.when(dns, pair("query", _text("query"))),
        F.when(dns, pair("requestMethod", _text("qtype"))),
        F.when(ip, pair("spt", _number("srcPort").cast("string"))),
        F.when(ip, pair("dst", _address("destIP"))),
        F.when(ip, pair("dpt", _number("destPort").cast("string"))),
        F.when(ip, pair("proto", _text("proto"))),
        F.when(ip, pair("in", _number("bytesIn").cast("string"))),
        F.when(ip, pair("out", _number("bytesOut").cast("string"))),
    )
    return F.concat_ws("|", *header, extension)


def leef_line(product: Product) -> Column:
    """LEEF 2.0 line of a row of ``per_threat``; every attribute ends with a tab."""
    header = ["LEEF:2.0", product.vendor, product.product, product.version.removeprefix("v")]
    attributes = {
        "sev": (F.col("threat.severity") * 2).cast("string"),
        "policy": F.when(F.col("threat.policy"), "1").otherwise("0"),
        "flags": F.array_join("flags", ","),
        "description": F.col("threat.desc"),
        "devTimeFormat": F.lit("MMM dd yyyy HH:mm:ss"),
        "devTime": F.coalesce(F.date_format("ts", "MMM dd yyyy HH:mm:ss"), F.lit("")),
        "proto": _text("proto"),
        "src": _address("srcIP"),
        "srcPort": _number("srcPort").cast("string"),
        "dst": _address("destIP"),
        "dstPort": _number("destPort").cast("string"),
        "srcBytes": _number("bytesIn").cast("string"),
        "dstBytes": _number("bytesOut").cast("string"),
        "query": _text("query"),
        "recordType": _text("qtype"),
    }
    # a tab ends an attribute and a line end the line, so neither may stand inside
    plain = {key: F.coalesce(F.regexp_replace(value, r"[\t\r\n]+", " "), F.lit("")) for key, value in attributes.items()}
    body = [F.concat(F.lit(f"{key}="), value, F.lit("\t")) for key, value in plain.items()]
    return F.concat(F.concat_ws("|", *map(F.lit, header), F.col("threatId"), F.lit("")), *body)


def gelf_line(product: Product, now: Column | None = None) -> Column:
    """GELF 1.1 object of a row of ``per_threat`` (keys in order)."""
    sent = F.unix_timestamp(F.current_timestamp() if now is None else now)
    when = F.concat(
        F.regexp_replace(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", ""), F.lit(" +0000 UTC")
    )
    fields = {
        "_bytes_in": _number("bytesIn"), "_bytes_out": _number("bytesOut"), "_dest_ip": _text("destIP"),
        "_dest_port": _number("destPort"), "_engine_agent": F.lit(product.agent),
        "_flags": F.array_join("flags", ","), "_ja3": _text("ja3"), "_original_event": when,
        "_policy": F.col("threat.policy").cast("string"), "_protocol": _text("proto"),
        "_query": _text("query"), "_record_type": _text("qtype"), "_severity": F.col("threat.severity"),
        "_src_ip": _text("srcIP"), "_src_port": _number("srcPort"), "_threat": F.col("threatId"),
        "full_message": F.lit(""), "host": F.lit(product.host), "level": F.lit(product.level),
        "short_message": F.col("threat.desc"), "timestamp": sent, "version": F.lit("1.1"),
    }
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def line_format(line: Callable[[], Column]) -> Formatter:
    """Formatter with a line per threat from an expression over ``per_threat`` rows."""
    return lambda alerts: per_threat(alerts).select(line().alias("value"))


_FORMATTERS: dict[str, Formatter] = {}


def register_formatter(name: str, formatter: Formatter) -> None:
    """Make an alert format available to the sinks under a name."""
    _FORMATTERS[name] = formatter


def format_alerts(alerts: DataFrame, name: str) -> DataFrame:
    if name not in _FORMATTERS:
        raise ValueError(f"unknown alert format {name!r}, known: {sorted(_FORMATTERS)}")
    return _FORMATTERS[name](alerts)


register_formatter("json", alert_json)
register_formatter("cef", line_format(lambda: cef_line(Product())))
register_formatter("leef", line_format(lambda: leef_line(Product())))
register_formatter("gelf", line_format(lambda: gelf_line(Product())))
