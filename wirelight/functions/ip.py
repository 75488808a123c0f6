"""IP addresses and networks as native expressions.

An address is held as its *key*: the family digit followed by upper-case hex,
``4`` + 8 digits or ``6`` + 32 digits.  A network then is a set of at most eight
key prefixes, so "address in network" is a string-prefix test and joins become
equi-joins.  Families never mix because the family digit leads the key; an
IPv4-mapped IPv6 address has an IPv4 key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelight.functions.columns import ColumnOrName, as_column, derive_once

V4_KEY_LENGTH = 9
V6_KEY_LENGTH = 33
_MAPPED = "0" * 20 + "FFFF"
_HEX = "[0-9A-Fa-f]{1,4}"
_GROUPS = f"{_HEX}(?::{_HEX})*"
_V6_PLAIN = rf"\A(?:{_GROUPS})?(?:::(?:{_GROUPS})?)?\z"
_V6_DOTTED = rf"\A(?:(?:{_GROUPS})?::(?:{_GROUPS}:)?|{_GROUPS}:)[0-9]+(?:\.[0-9]+){{3}}\z"


def _v4_key(text: Column) -> Column:
    parts = F.split(text, r"\.")
    a, b, c, d = (F.get(parts, F.lit(i)).try_cast("int") for i in range(4))
    # the same text again: four plain decimal numbers without leading zeros
    canonical = F.concat_ws(".", a, b, c, d) == text
    in_range = (F.greatest(a, b, c, d) <= 255) & (F.least(a, b, c, d) >= 0)
    number = a.cast("bigint") * 16777216 + b * 65536 + c * 256 + d
    # the family digit sits just above the 32 address bits
    return F.when(canonical & in_range, F.hex(number + F.lit(4 << 32)))


def _v6_padded(text: Column, tail_key: Column) -> Column:
    """Upper-case groups of four digits, ``::`` kept; NULL for malformed text."""
    head = F.substring(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, ":", -1)))
    spelled = F.when(text.rlike(_V6_PLAIN), text).when(
        text.rlike(_V6_DOTTED),
        F.concat(head, F.substring(tail_key, 2, 4), F.lit(":"), F.substring(tail_key, 6, 4)),
    )
    # three zeros in front of every group, then its last four digits
    long = F.regexp_replace(F.upper(spelled), "([0-9A-F]+)", "000$1")
    return F.regexp_replace(long, "[0-9A-F]*([0-9A-F]{4})", "$1")


def _v6_key(padded: Column) -> Column:
    known = F.length(F.replace(padded, F.lit(":"), F.lit("")))
    zeros = F.when(known <= 28, F.repeat(F.lit("0"), F.lit(32) - known))
    full = F.when(
        F.contains(padded, F.lit("::")), F.replace(padded, F.lit("::"), zeros)
    ).otherwise(padded)
    key = F.concat(F.lit("6"), F.replace(full, F.lit(":"), F.lit("")))
    # padded text holds hex digits and colons alone, so its length says whether it is whole
    return F.when(F.length(key) == V6_KEY_LENGTH, unmapped_key(key))


def unmapped_key(key: Column) -> Column:
    """The IPv4 key of an address in mapped form, any other key as it is."""
    return F.when(key.startswith(f"6{_MAPPED}"), F.concat(F.lit("4"), F.substring(key, 26, 8))).otherwise(key)


def _is_v6(text: Column) -> Column:
    return F.contains(text, F.lit(":"))


def ip_key(ip: ColumnOrName) -> Column:
    """Key of an address; NULL when the text is not a valid IPv4 or IPv6 address.

    One large expression, meant for small tables; event tables go through
    ``with_ip_keys``, which evaluates it in short steps.
    """
    text = as_column(ip)
    tail_key = _v4_key(F.substring_index(text, ":", -1))
    return F.when(_is_v6(text), _v6_key(_v6_padded(text, tail_key))).otherwise(tail_key)


def with_ip_keys(
    df: DataFrame, keys: Mapping[str, ColumnOrName], canonical: Mapping[str, str] | None = None,
    step: Callable[[DataFrame, Mapping[str, Column]], DataFrame] = derive_once,
) -> DataFrame:
    """Add address keys (``{new column: address text}``), each worked out once per row.

    ``canonical`` names, per key, a column that gets the address's canonical text.
    The steps are separate operators so that generated methods stay small enough
    for the JIT; rows without IPv6 text skip all but the first.  ``step`` may be
    ``derive`` where nothing filters the rows further on.
    """
    columns = df.columns
    texts = {key: as_column(ip) for key, ip in keys.items()}
    tails = {f"_v4_{k}": _v4_key(F.substring_index(t, ":", -1)) for k, t in texts.items()}
    df = step(df, {**{f"_ip_{k}": t for k, t in texts.items()}, **tails})
    texts = {key: F.col(f"_ip_{key}") for key in keys}
    df = step(df, {
        f"_v6_{k}": F.when(_is_v6(t), _v6_padded(t, F.col(f"_v4_{k}"))) for k, t in texts.items()
    })
    df = step(df, {
        k: F.when(_is_v6(t), _v6_key(F.col(f"_v6_{k}"))).otherwise(F.col(f"_v4_{k}"))
        for k, t in texts.items()
    })
    shown = {name: ip_canonical(texts[key], key) for key, name in (canonical or {}).items()}
    kept = [c for c in columns if c not in keys and c not in shown]
    return df.select(*kept, *keys, *[expr.alias(name) for name, expr in shown.items()])


def ip_family(key: ColumnOrName) -> Column:
    return F.substring(as_column(key), 1, 1).cast("tinyint")


def ip16(key: ColumnOrName) -> Column:
    """32 lower-case hex digits of the 16-byte form."""
    key = as_column(key)
    digits = F.lower(F.substring(key, 2, 32))
    return F.when(key.startswith("4"), F.concat(F.lit(_MAPPED.lower()), digits)).otherwise(digits)


# four digits without the zeros in front, but for the last
_GROUP = "000(.)|00(..)|0(...)|(....)"
# the first of the longest runs of two or more zero groups; one pass, the longest is tried first
_RUNS = range(8, 1, -1)
_SQUEEZED = "^(?:" + "|".join(rf"(.*?)(?:^|:)0(?::0){{{run - 1}}}(?::|$)(.*)" for run in _RUNS) + ")$"
_SQUEEZED_TO = "".join(f"${2 * i + 1}" for i in range(len(_RUNS))) + "::" + "".join(f"${2 * i + 2}" for i in range(len(_RUNS)))


def _hex_int(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("int")


def key_text(key: ColumnOrName) -> Column:
    """Canonical text of an address key (dotted, or compressed lower-case IPv6)."""
    key = as_column(key)
    dotted = F.concat_ws(".", *[_hex_int(F.substring(key, 2 + 2 * i, 2)) for i in range(4)])
    spelled = F.regexp_replace(F.lower(F.substring(key, 2, 32)), _GROUP, "$1$2$3$4:")
    text = F.regexp_replace(F.rtrim(spelled, F.lit(":")), _SQUEEZED, _SQUEEZED_TO)
    return F.when(key.startswith("4"), dotted).when(key.startswith("6"), text)


def ip_canonical(ip: ColumnOrName, key: ColumnOrName) -> Column:
    """Canonical text of an address whose key is known; NULL for invalid input."""
    text, key = as_column(ip), as_column(key)
    return F.when(key.isNull(), None).when(F.contains(text, F.lit(":")), key_text(key)).otherwise(text)


def cidr_valid(cidr: ColumnOrName, key: ColumnOrName) -> Column:
    """Well-formed CIDR text?  ``key`` is the key of its address part."""
    text = as_column(cidr)
    bits = F.substring_index(text, "/", -1).try_cast("int")
    limit = F.when(_is_v6(text), 128).otherwise(32)
    well_formed = text.rlike(r"\A[^/]+/[0-9]{1,3}\z") & (bits <= limit)
    return F.coalesce(well_formed & as_column(key).isNotNull(), F.lit(False))


def _network_start(text: Column, key: Column) -> tuple[Column, Column]:
    """Key and prefix length of a network in one address family.

    A network of IPv4-mapped addresses is an IPv4 network from 96 bits on; a
    wider one holds more than them and stays IPv6.
    """
    bits = F.substring_index(text, "/", -1).try_cast("int")
    mapped = _is_v6(text) & key.startswith("4")
    wide = F.concat(F.lit("6" + "0" * 20 + "FFFF"), F.substring(key, 2, 8))
    return F.when(mapped & (bits < 96), wide).otherwise(key), F.when(mapped & (bits >= 96), bits - 96).otherwise(bits)


def cidr_length(cidr: ColumnOrName, key: ColumnOrName) -> Column:
    """Prefix length within the address family of the network."""
    return _network_start(as_column(cidr), as_column(key))[1]


def cidr_prefixes(cidr: ColumnOrName, key: ColumnOrName) -> Column:
    """Key prefixes that together cover a network given as CIDR or plain address.

    ``key`` is the key of the address part.  NULL for invalid text.  One prefix
    when the length is a multiple of four, otherwise up to eight neighbours.
    """
    text, key = as_column(cidr), as_column(key)
    valid, plain = cidr_valid(text, key), ~F.contains(text, F.lit("/")) & key.isNotNull()
    given = key
    key, bits = _network_start(text, key)
    bits = F.coalesce(bits, F.lit(0))
    whole = F.floor(bits / 4).cast("int")
    head = F.substring(key, F.lit(1), whole + 1)
    span = F.pow(F.lit(2), (4 - bits % 4) % 4).cast("int")
    digit = _hex_int(F.substring(key, whole + 2, F.lit(1)))
    first = digit - digit % span
    network = F.when(bits % 4 == 0, F.array(head)).otherwise(
        F.transform(F.sequence(first, first + span - 1), lambda n: F.concat(head, F.hex(n)))
    )
    return F.when(plain, F.array(given)).when(valid, network)


def cidr_bounds(cidr: ColumnOrName, key: ColumnOrName) -> tuple[Column, Column]:
    """Lowest and highest address key of a network."""
    prefixes = cidr_prefixes(cidr, key)
    low, high = F.array_min(prefixes), F.array_max(prefixes)
    width = F.when(low.startswith("4"), V4_KEY_LENGTH).otherwise(V6_KEY_LENGTH)
    return F.rpad(low, width, "0"), F.rpad(high, width, "F")


def with_cidr_keys(df: DataFrame, cidr: str, out: str) -> DataFrame:
    """Add the key of a network's address part."""
    return with_ip_keys(df, {out: F.substring_index(F.col(cidr), "/", 1)})


def in_prefixes(key: ColumnOrName, prefixes: list[str]) -> Column:
    """Does the address key start with any of the (literal) prefixes?

    One hashed membership test per distinct prefix length, never one per
    network.  A NULL key is in no network.
    """
    key = as_column(key)
    kept: dict[int, dict[str, None]] = {}
    for prefix in sorted(set(prefixes), key=lambda p: (len(p), p)):
        covered = any(prefix[:n] in kept[n] for n in kept)
        if not covered:
            kept.setdefault(len(prefix), {})[prefix] = None
    if not kept:
        return F.lit(False)
    tests = [
        key.startswith(values[0]) if len(values) == 1 else F.substring(key, 1, n).isin(values)
        for n, values in sorted((n, list(found)) for n, found in kept.items())
    ]
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return F.coalesce(result, F.lit(False))
