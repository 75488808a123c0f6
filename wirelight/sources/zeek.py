"""Zeek logs: tab-separated text that describes its own columns.

``#`` lines set the separator, the empty and unset markers and the column names
for the lines that follow, and may come again in mid-file.  Only those few lines
are ordered per file; data lines find their header by position and are never
sorted or grouped.  Header lines and data lines are taken from one table, in which
every line keeps its place: see ``land_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirelight.functions import values as v
from wirelight.functions.columns import derive, derive_once
from wirelight.functions.times import zeek_epoch
from wirelight.operators.lookup import fits_broadcast, lookup_join, materialise
from wirelight.sources.lines import RAW, Shape, all_types, finish, first_error, one_type

_FIELDS = {
    "dns": ["ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "query", "qtype_name"],
    "ip": ["ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "orig_bytes",
           "orig_ip_bytes", "resp_bytes", "resp_ip_bytes", "ja3"],
    "http": ["ts", "id.orig_h", "id.orig_p", "method", "host", "uri", "referrer", "user_agent",
             "request_body_len", "response_body_len", "status_code", "resp_mime_types"],
}


def header_fill(lines: DataFrame) -> DataFrame:
    """Header versions per file: (source_file, block_start, line_no, sep, empty, unset, fields).

    One row for every place where the header in force changes.
    """
    if "mark" in lines.columns:
        lines = lines.where("mark")
    marks = lines.select("*", v.trim_space("value").alias("_line")).where(F.col("_line").startswith("#"))
    file_order = Window.partitionBy("source_file").orderBy("block_start", "line_no")
    so_far = file_order.rowsBetween(Window.unboundedPreceding, 0)

    def latest(value: Column) -> Column:
        return F.last(value, ignorenulls=True).over(so_far)

    declares_sep = F.col("_line").startswith("#separator")
    hex_sep = F.trim(F.regexp_replace("_line", r"^#separator ", ""), F.lit("\\x"))
    decoded = F.when(declares_sep, F.decode(F.unhex(hex_sep), "utf-8"))
    marks = marks.withColumn("sep", F.coalesce(latest(decoded), F.lit(" ")))
    body = F.expr("substring(_line, 2)")
    name = F.call_function("substring_index", body, F.col("sep"), F.lit(1))
    rest = F.substring(body, F.length(name) + F.length("sep") + 1, F.length(body))
    marks = marks.withColumns({"_name": F.when(~declares_sep, name), "_rest": rest})

    def directive(which: str) -> Column:
        return latest(F.when(F.col("_name") == which, F.col("_rest")))

    pattern = F.concat(F.lit("\\Q"), F.col("sep"), F.lit("\\E"))
    fields = latest(F.when(F.col("_name") == "fields", F.split("_rest", pattern)))
    marks = marks.withColumns({
        "empty": F.coalesce(directive("empty_field"), F.lit("")),
        "unset": F.coalesce(directive("unset_field"), F.lit("")),
        "fields": F.coalesce(fields, F.array().cast("array<string>")),
    })
    state = F.struct("sep", "empty", "unset", "fields")
    changed = ~F.lag(state).over(file_order).eqNullSafe(state)
    return marks.withColumn("_changed", changed).where("_changed").select(
        "source_file", "block_start", "line_no", "sep", "empty", "unset", "fields"
    )


def _headers_by_file(lines: DataFrame, names: list[str]) -> DataFrame:
    """(source_file, versions): header versions with the position of every wanted column."""
    index = [
        # the last of several columns with the same name counts, as in the header's order
        (F.size("fields") - F.nullif(F.array_position(F.reverse("fields"), n), F.lit(0))).cast("int").alias(f"c{i}")
        for i, n in enumerate(names)
    ]
    version = F.struct(
        F.struct("block_start", "line_no").alias("at"),
        F.when(F.col("sep").rlike(r"\A[\t ,;:]\z"), F.col("sep"))
        .otherwise(F.concat(F.lit("\\Q"), F.col("sep"), F.lit("\\E"))).alias("pattern"),
        "empty", "unset", F.size("fields").alias("width"),
        # every row carries its header: the names or the places of the wanted ones
        F.struct(*index).alias("ix") if index else F.col("fields"),
    )
    # one entry per header change of a file, not per line
    return header_fill(lines).groupBy("source_file").agg(
        F.array_sort(F.collect_list(version)).alias("versions")
    )


def zeek_rows(lines: DataFrame, names: list[str]) -> DataFrame:
    """Data lines with ``parts`` (split text) and ``header`` (version in force, or NULL)."""
    # header lines are looked up in one pass over the text and kept as a small table
    headers = materialise(_headers_by_file(lines, names), "headers")
    data = lines.where("NOT mark") if "mark" in lines.columns else lines
    data = data.withColumn("_line", v.trim_space("value")).where(
        (F.col("_line") != "") & ~F.col("_line").startswith("#")
    )
    if fits_broadcast(headers):
        data = data.join(F.broadcast(headers), "source_file", "left")
    else:
        facts = headers.select(F.col("source_file").alias("key"), F.struct("versions").alias("facts"))
        data = lookup_join(data, "source_file", lambda files: files.join(facts, "key"), "_file")
        data = data.withColumn("versions", F.col("_file.versions")).drop("_file")
    here = F.struct("block_start", "line_no")
    in_force = F.when(F.size("versions") == 1, F.get("versions", F.lit(0))).otherwise(
        F.try_element_at(F.filter("versions", lambda h: h["at"] < here), F.lit(-1))
    )
    in_force = F.when(F.get("versions", F.lit(0))["at"] < here, in_force)
    data = data.withColumn("header", in_force).drop("versions")
    return data.withColumn("parts", F.split("_line", F.col("header.pattern")))


def zeek_scan(lines: DataFrame, on_error: str = "fail") -> DataFrame:
    """Every data line as a map from column name to text."""
    rows = zeek_rows(lines, [])
    bad = ~F.coalesce(F.size("parts") == F.col("header.width"), F.lit(False))
    fields = F.when(~bad, F.map_from_arrays("header.fields", "parts"))
    rows = rows.select("source_file", "block_start", "line_no", fields.alias("fields"),
                       F.col("_line").alias(RAW), bad.alias("_bad"))
    error = first_error((F.col("_bad"), "zeek: wrong number of columns"))
    return finish(rows, {}, error, on_error).drop("_bad")


def _named_columns(lines: DataFrame, kinds: list[str], fraction: str, step=derive_once) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """Rows, their cells by column name, and what the cells of times and numbers say (NULL: unreadable)."""
    names = list(dict.fromkeys(name for kind in kinds for name in _FIELDS[kind]))
    rows = zeek_rows(lines, names)
    cells = {f"c{i}": F.get("parts", F.col(f"header.ix.c{i}")) for i in range(len(names))}
    rows = step(rows, {
        **cells, "_width": F.size("parts"), "_want": F.col("header.width"),
        "_empty": F.col("header.empty"), "_unset": F.col("header.unset"),
    }).drop("parts", "header")
    at = {name: f"c{i}" for i, name in enumerate(names)}
    # values are asked for by columns and by checks, of several types at times: they are read once
    parsed = {at["ts"]: zeek_epoch(at["ts"], fraction)}
    parsed |= {at[n]: v.port16(at[n]) for n in ("id.orig_p", "id.resp_p", "status_code") if n in at}
    counters = ("orig_bytes", "orig_ip_bytes", "resp_bytes", "resp_ip_bytes", "request_body_len", "response_body_len")
    parsed |= {at[n]: v.count64(at[n]) for n in counters if n in at}
    rows = step(rows, {f"_of_{c}": value for c, value in parsed.items()})
    return rows, {n: F.col(c) for n, c in at.items()}, {n: F.col(f"_of_{c}") for n, c in at.items() if c in parsed}


def _bad(cell: Column, parsed: Column) -> Column:
    return cell.isNotNull() & parsed.isNull()


def _shape(kind: str, c: dict[str, Column], parsed: dict[str, Column], on_error: str) -> Shape:
    checks = [
        (~(F.col("_width") == F.col("_want")) | F.col("_want").isNull(), "zeek: wrong number of columns"),
        (_bad(c["ts"], parsed["ts"]), "zeek: bad timestamp"),
        (_bad(c["id.orig_p"], parsed["id.orig_p"]), "zeek: bad port"),
    ]
    out: dict[str, Column] = {"ts": parsed["ts"], "srcPort": parsed["id.orig_p"]}
    ips = {"srcIP": c["id.orig_h"]}

    def shown(name: str) -> Column:
        return v.blank_unset(c[name], "_empty", "_unset")

    def count(name: str) -> Column:
        return F.when(c[name] != F.col("_unset"), c[name])

    def number(name: str) -> Column:
        return F.when(c[name] != F.col("_unset"), parsed[name])

    if kind in ("dns", "ip"):
        out["destPort"] = parsed["id.resp_p"]
        out["proto"] = v.lower_proto(c["proto"])
        checks.append((_bad(c["id.resp_p"], parsed["id.resp_p"]), "zeek: bad port"))
    if kind == "dns":
        # the asked server plays no part in DNS rows
        out |= {"query": c["query"], "qtype": shown("qtype_name")}
    elif kind == "ip":
        ips["destIP"] = c["id.resp_h"]
        counters = ["orig_bytes", "orig_ip_bytes", "resp_bytes", "resp_ip_bytes"]
        out["bytesCount"] = v.byte_total(*[number(n) for n in counters])
        out["direction"] = F.lit("unknown")
        out["ja3"] = shown("ja3")
        checks += [(_bad(count(n), number(n)), "zeek: bad byte count") for n in counters]
    else:
        out |= {
            "url": F.concat(F.lit("http://"), F.coalesce(c["host"], F.lit("")), F.coalesce(c["uri"], F.lit(""))),
            "method": c["method"],
            "status": number("status_code"),
            "action": F.lit(None).cast("string"),
            "bytesIn": number("response_body_len"),
            "bytesOut": number("request_body_len"),
            "contentType": shown("resp_mime_types"),
            "referrer": shown("referrer"),
            "userAgent": shown("user_agent"),
        }
        strict = on_error == "fail"
        for name in ("status_code", "response_body_len", "request_body_len"):
            checks.append((_bad(c[name], parsed[name]) if strict else _bad(count(name), number(name)), f"zeek: bad {name}"))
    return Shape(out, ips, first_error(*checks))


def zeek_events(
    lines: DataFrame, kind: str, on_error: str = "fail", fraction: str = "decimal"
) -> DataFrame:
    """dns.log, conn.log or http.log lines as dns, ip or http rows.

    Columns the file does not have are blank.  ``fraction`` see ``zeek_epoch``.
    """
    rows, c, parsed = _named_columns(lines, [kind], fraction)
    return one_type(rows, _shape(kind, c, parsed, on_error), F.col("_line"), on_error)


def zeek_all(
    lines: DataFrame, kinds: list[str], on_error: str = "fail", fraction: str = "decimal"
) -> DataFrame:
    """Every line as an event of each of the kinds, split and read once."""
    rows, c, parsed = _named_columns(lines, kinds, fraction, derive)
    return all_types(rows, {kind: _shape(kind, c, parsed, on_error) for kind in kinds}, F.col("_line"), on_error)
