"""Typed getters over a schemaless document (VARIANT).

A value of another JSON type yields the blank, never a conversion: Spark would
read the text "443" as a number, the engine must not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelight.functions.times import rfc3339
from wirelight.functions.values import proto_name


def json_path(path: str) -> str:
    """``a.b`` -> ``$['a']['b']``; a path that starts with ``$`` is taken as is."""
    if path.startswith("$"):
        return path
    if not path or any(not step for step in path.split(".")) or re.search(r"['\"\\]", path):
        raise ValueError(f"not a field path: {path!r}")
    return "$" + "".join(f"['{step}']" for step in path.split("."))


def _value(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, json_path(path), "variant")


def doc_exists(doc: Column, path: str) -> Column:
    value = _value(doc, path)
    return value.isNotNull() & ~F.is_variant_null(value)


def doc_string(doc: Column, path: str | None) -> Column:
    """Text at the path; NULL when absent or not text."""
    if not path:
        return F.lit(None).cast("string")
    is_text = F.schema_of_variant(_value(doc, path)) == "STRING"
    return F.when(is_text, F.try_variant_get(doc, json_path(path), "string"))


def doc_int(doc: Column, path: str | None) -> Column:
    """Whole number at the path; 0 when absent or not a whole number."""
    if not path:
        return F.lit(0).cast("bigint")
    is_whole = F.schema_of_variant(_value(doc, path)) == "BIGINT"
    number = F.when(is_whole, F.try_variant_get(doc, json_path(path), "bigint"))
    return F.coalesce(number, F.lit(0).cast("bigint"))


def doc_uint(doc: Column, path: str | None, highest: int) -> Column:
    number = doc_int(doc, path)
    return F.when(number.between(0, highest), number).otherwise(0).cast("int")


def doc_uint16(doc: Column, path: str | None) -> Column:
    return doc_uint(doc, path, 65535)


def doc_uint8(doc: Column, path: str | None) -> Column:
    return doc_uint(doc, path, 255)


def doc_timestamp(doc: Column, path: str | None) -> Column:
    return rfc3339(doc_string(doc, path))


def doc_field_ts(fields: Column, name: str) -> Column:
    """Timestamp from the first value kept under a document's formatted fields."""
    return rfc3339(F.get(F.try_element_at(fields, F.lit(name)), F.lit(0)))


def doc_proto(doc: Column, path: str | None) -> Column:
    """Protocol from a number, numeric text or name; blank when out of range."""
    number, text = doc_uint8(doc, path), doc_string(doc, path)
    is_number = text.rlike(r"\A[+-]?[0-9]+\z")
    parsed = text.try_cast("int")
    from_text = F.when(~is_number, text).when(parsed.between(0, 255), proto_name(parsed))
    return F.coalesce(F.when(number > 0, proto_name(number)).otherwise(from_text), F.lit(""))
