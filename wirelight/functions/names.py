"""Domain names and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelight.functions.columns import ColumnOrName, any_of, as_column

_LABEL = "[A-Za-z0-9_](?:[A-Za-z0-9_-]{0,61}[A-Za-z0-9_])?"
_NAME = rf"\A(?=.*[A-Za-z_]){_LABEL}(?:\.{_LABEL})*\.?\z"

# Fixed value: the pattern that takes scheme, host and port from a URL.
URL_PATTERN = r"^(?:(.*?)://)?([-a-zA-Z0-9_.]+)(?:[:](\d+))?[^?&#]*"


def is_domain_name(name: ColumnOrName) -> Column:
    """Letters, digits, hyphen and underscore labels of 1-63 characters."""
    text = as_column(name)
    size = F.octet_length(text)
    fits = (size < 254) | ((size == 254) & text.endswith("."))
    return F.coalesce(fits & text.rlike(_NAME), F.lit(False))


def url_host(url: ColumnOrName) -> Column:
    """Lower-cased host of a URL with or without scheme; NULL when there is none."""
    return F.lower(F.nullif(F.regexp_extract(as_column(url), URL_PATTERN, 2), F.lit("")))


def valid_pattern(pattern: ColumnOrName) -> Column:
    """A trusted-domain entry: a name, or a name behind ``*.``."""
    text = as_column(pattern)
    return is_domain_name(text) | is_domain_name(F.regexp_replace(text, r"^\*\.", ""))


def pattern_name(pattern: ColumnOrName) -> Column:
    """The name an entry is looked up by: no ``*``, no outer dots, lower case."""
    return F.lower(F.trim(F.regexp_replace(as_column(pattern), r"^\*", ""), F.lit(".")))


def name_suffixes(name: ColumnOrName, max_labels: int) -> Column:
    """The trailing 1..max_labels labels of a name (array, shortest first)."""
    text = as_column(name)
    labels = F.size(F.split(text, r"\."))
    return F.transform(
        F.sequence(F.lit(1), F.least(F.lit(max_labels), labels)),
        lambda n: F.array_join(F.slice(F.split(text, r"\."), labels - n + 1, n), "."),
    )


def trusted_by(name: ColumnOrName, patterns: list[str]) -> Column:
    """Is the lower-cased name covered by one of the (literal) entries?

    ``*.a`` covers ``a`` and everything below it, any other entry only itself.
    One hashed membership test per distinct label count.
    """
    text = F.lower(as_column(name))
    exact = sorted({p.strip(".").lower() for p in patterns if not p.startswith("*")})
    tails: dict[int, set[str]] = {}
    for pattern in patterns:
        if pattern.startswith("*"):
            tail = pattern[1:].strip(".").lower()
            tails.setdefault(tail.count(".") + 1, set()).add(tail)
    tests = [text.isin(exact)] if exact else []
    tests += [
        F.substring_index(text, ".", -labels).isin(sorted(values))
        for labels, values in sorted(tails.items())
    ]
    return F.coalesce(any_of(tests), F.lit(False))


def clean_path(path: ColumnOrName) -> Column:
    """Shortest equivalent path: no ``//``, ``.``, inner ``..`` or trailing slash."""
    text = as_column(path)
    rooted = text.startswith("/")
    steps = F.filter(F.split(text, "/"), lambda s: (s != "") & (s != "."))

    def walk(done: Column, step: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        climbs = (step == "..") & (F.size(done) > 0) & (last != "..")
        return (
            F.when(climbs, F.slice(done, F.lit(1), F.size(done) - 1))
            .when((step == "..") & rooted, done)
            .otherwise(F.concat(done, F.array(step)))
        )

    joined = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/")
    cleaned = F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(
        F.when(joined == "", ".").otherwise(joined)
    )
    # most paths are clean already and never reach the segment walk
    return F.when(text.rlike(r"//|(?:^|/)\.\.?(?:/|\z)|.*/\z|\A\z"), cleaned).otherwise(text)


def join_clean_path(host: ColumnOrName, path: ColumnOrName) -> Column:
    """Host and path as one clean path; empty parts are left out."""
    host, path = (F.coalesce(as_column(c), F.lit("")) for c in (host, path))
    joined = F.when(host == "", path).when(path == "", host).otherwise(F.concat(host, F.lit("/"), path))
    return F.when(joined == "", "").otherwise(clean_path(joined))


def scheme_by_port(port: ColumnOrName) -> Column:
    port = as_column(port)
    return F.when(port == 80, "http://").when(port == 443, "https://").otherwise("")
