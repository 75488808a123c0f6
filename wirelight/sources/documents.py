"""Search documents landed as JSON: search, page and decode into entries.

A landed document has ``id``, ``source``, ``fields`` (formatted values, map of
text arrays) and ``ingested`` (timestamp column, so that the cursor condition
reaches the Parquet scan). ``source`` is JSON text, or nested columns, of which
``source_projection`` leaves the scan those that a search names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wirelight import schemas
from wirelight.functions import documents as d
from wirelight.functions.columns import all_of, derive_once, settle
from wirelight.functions.ip import with_ip_keys
from wirelight.operators.lookup import materialise
from wirelight.sources.search_config import LOOK_BACK, Search

LANDED = "id string, source string, fields map<string,array<string>>, ingested timestamp"
HIT = "_id string, _source variant, fields map<string,array<string>>"


def land_hits(lines: DataFrame, ingested: str = "event.ingested") -> DataFrame:
    """Search hits (JSON text, column value) -> landed documents."""
    hits = lines.select(F.from_json("value", HIT).alias("h"))
    return hits.select(
        F.col("h._id").alias("id"), F.to_json("h._source").alias("source"), F.col("h.fields").alias("fields"),
        d.doc_field_ts(F.col("h.fields"), ingested).alias("ingested"),
    )


def _steps(path: str) -> list[str]:
    """``a.b``, ``$.a.b`` or ``$['a']['b']`` as field names."""
    return [quoted or bare for _, quoted, bare in re.findall(r"""(['"])(.*?)\1|([^.\[\]$'"]+)""", path)]


def source_projection(docs: DataFrame, search: Search) -> DataFrame:
    """Documents with the fields that a search reads, and no others, in nested ``source``.

    Each wanted leaf is named by itself, so a columnar scan reads those leaves
    alone. Paths that the documents don't have are left out.
    """
    tree: dict = {}
    for path in search.read_paths():
        node, kind = tree, docs.schema["source"].dataType
        steps = _steps(path)
        for i, step in enumerate(steps):
            if not isinstance(kind, T.StructType) or step not in kind.names:
                break
            kind = kind[step].dataType
            if i + 1 < len(steps):
                node = node.setdefault(step, {})
            else:
                node[step] = None

    def struct(node: dict, at: Column) -> list[Column]:
        out = []
        for name, below in node.items():
            inner = struct(below, at.getField(name)) if below else None
            if below is None or inner:
                out.append((at.getField(name) if below is None else F.when(at.getField(name).isNotNull(), F.struct(*inner))).alias(name))
        return out

    kept = struct(tree, F.col("source"))
    source = F.struct(*kept) if kept else F.lit(None).cast("struct<none:string>")
    return docs.select("id", source.alias("source"), "fields", "ingested")


def parsed(docs: DataFrame) -> DataFrame:
    """Adds ``doc``, the source as a schemaless value; once, whatever is tested later."""
    nested = isinstance(docs.schema["source"].dataType, T.StructType)
    return derive_once(docs, {"doc": F.to_variant_object("source") if nested else F.try_parse_json("source")})


def must_exist(doc: Column, fields: Column, paths: list[str]) -> Column:
    """All paths hold a value, in the document or among its formatted fields."""
    return all_of([
        F.coalesce(F.size(F.try_element_at(fields, F.lit(path))) > 0, F.lit(False)) | d.doc_exists(doc, path)
        for path in paths
    ])


def term_filter(doc: Column, terms: dict[str, str]) -> Column:
    return all_of([d.doc_string(doc, path) == value for path, value in terms.items()])


def ingested_after(cursor: Column | None, now: Column | None = None) -> Column:
    """Strictly newer than the cursor; without one, than five minutes ago."""
    now = F.current_timestamp() if now is None else now
    since = now - F.expr(f"INTERVAL {LOOK_BACK}")
    return F.col("ingested") > (since if cursor is None else F.coalesce(cursor, since))


def search(
    docs: DataFrame, search: Search, cursor: Column | None = None, now: Column | None = None
) -> DataFrame:
    """Documents a search finds, newer than the cursor; adds the parsed ``doc``."""
    # the cheap, pushed-down conditions come before any JSON is parsed
    found = docs.where(ingested_after(cursor, now))
    if search.where:
        found = found.where(search.where)
    found = parsed(found)
    return found.where(
        term_filter(F.col("doc"), search.final_terms())
        & must_exist(F.col("doc"), F.col("fields"), search.final_must_have())
    )


def page(found: DataFrame, size: int, after: tuple[Column, Column] | None = None) -> DataFrame:
    """First ``size`` documents in ingested order, or those after a row's (ingested, id)."""
    if after is not None:
        ingested, doc_id = after
        # the range condition alone is pushed down, the tie-break is not
        found = found.where(F.col("ingested") >= ingested).where(
            (F.col("ingested") > ingested) | (F.col("id") > doc_id)
        )
    return found.orderBy("ingested", "id").limit(size)


def numbered_pages(found: DataFrame, size: int) -> DataFrame:
    """The documents with column ``page``, from 0 on: ``size`` documents each, in order of (ingested, id).

    The documents are put in order once, range by range, and written down; a row's
    number is its place in its range and the counts of the ranges before.
    """
    placed = found.orderBy("ingested", "id").withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, "ordered").withColumn("_range", F.shiftright("_at", 33))
    ranges = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    # one small row per range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(F.broadcast(ranges), "_range")
    return numbered.select(*found.columns, F.floor(number / size).cast("int").alias("page"))


def pages(docs: DataFrame, search_: Search, cursor: Column | None = None, now: Column | None = None) -> Iterator[DataFrame]:
    """The found documents page by page (the search's ``page_size``), to the end.

    Documents are searched and put in order once, by (ingested, id), see
    ``numbered_pages``; a page is a lookup of its number in that table, whose files
    hold neighbouring pages. Equal times are neither lost nor repeated. Documents
    that arrive meanwhile are not seen.
    """
    numbered = materialise(numbered_pages(search(docs, search_, cursor, now), search_.page_size), "pages")
    last = numbered.agg(F.max("page")).first()[0]
    for n in range(0 if last is None else last + 1):
        yield numbered.where(F.col("page") == n).drop("page").orderBy("ingested", "id")


def newest_ingested(found: DataFrame) -> DataFrame:
    return found.agg(F.max("ingested").alias("newest"))


def _entry_columns(kind: str, paths: dict[str, str]) -> dict[str, Column]:
    doc = F.col("doc")

    def text(name: str) -> Column:
        return F.coalesce(d.doc_string(doc, paths.get(name)), F.lit(""))

    columns = {"srcPort": d.doc_uint16(doc, paths.get("src_port"))}
    if kind == "dns":
        columns |= {"query": d.doc_string(doc, paths["query"]), "qtype": text("qtype")}
    if kind in ("ip", "tls"):
        columns["destPort"] = d.doc_uint16(doc, paths.get("dest_port"))
    if kind in ("ip", "http"):
        columns["bytesIn"] = d.doc_int(doc, paths.get("bytes_in"))
        columns["bytesOut"] = d.doc_int(doc, paths.get("bytes_out"))
    if kind == "ip":
        columns |= {"proto": d.doc_proto(doc, paths.get("proto")), "ja3": F.lit("")}
    if kind == "http":
        columns |= {
            "url": d.doc_string(doc, paths["url"]), "method": text("method"),
            "status": d.doc_int(doc, paths.get("status_code")).cast("int"), "action": F.lit(""),
            "contentType": text("content_type"), "referrer": text("referrer"), "userAgent": text("user_agent"),
        }
    if kind == "tls":
        columns |= {
            "certHash": text("cert_hash"), "issuer": text("issuer"), "subject": text("subject"),
            "validFrom": d.doc_timestamp(doc, paths.get("valid_from")),
            "validTo": d.doc_timestamp(doc, paths.get("valid_to")),
            "ja3": text("ja3"), "ja3s": text("ja3s"),
        }
    return columns


def decode(found: DataFrame, search: Search) -> DataFrame:
    """Found documents as entries of the search's event type.

    Documents without a valid timestamp, source address or other required field
    are left out.  Address keys and ``ingested``/``id`` stay on the row.
    """
    kind, paths = search.event_type, search.field_map()
    if "doc" not in found.columns:
        found = parsed(found)
    ts = d.doc_field_ts(F.col("fields"), paths["timestamp"])
    dest = d.doc_string(F.col("doc"), paths.get("dest_ip"))
    picked = found.select(
        "id", "ingested", ts.alias("ts"), d.doc_string(F.col("doc"), paths["src_ip"]).alias("_src"),
        dest.alias("_dst"), *[expr.alias(name) for name, expr in _entry_columns(kind, paths).items()],
    )
    rows = with_ip_keys(
        settle(picked), {"srcKey": "_src", "destKey": "_dst"}, {"srcKey": "srcIP", "destKey": "destIP"}
    )
    needed = {"dns": ["query"], "ip": ["destKey"], "http": ["url"], "tls": []}[kind]
    rows = rows.where(all_of([F.col(c).isNotNull() for c in ["ts", "srcKey", *needed]]))
    keys = ["srcKey", "destKey"] if kind in ("ip", "tls") else ["srcKey"]
    return rows.select(*schemas.ENTRY[kind].names, *keys, "ingested", "id")


def valid_ip(rows: DataFrame, ip: str) -> DataFrame:
    """Rows whose address parses."""
    return with_ip_keys(rows, {"_k": ip}).where(F.col("_k").isNotNull()).select(*rows.columns)

