"""Scope verdicts: which events are to be monitored.

An event is kept when at least one group matches it and no matching group
excludes it.  Two physical forms give the same answer:

* ``scope_ip`` / ``scope_dns`` / ``scope_http``: the groups become literal
  membership tests.  No shuffle, works on streams; for scopes up to a few
  thousand entries.
* ``scope_join``: the scope stays a table of any size.  Its networks and names are
  broadcast while they are small in bytes; beyond it, it is joined on distinct
  addresses and names (see ``operators.lookup``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelight.functions.columns import any_of, derive_once
from wirelight.functions.ip import in_prefixes, with_ip_keys
from wirelight.functions.names import trusted_by, url_host, valid_pattern
from wirelight.operators.domains import domain_entries, domain_hits, domain_table, name_tail
from wirelight.operators.lookup import broadcast_levels, level_join, lookup_join
from wirelight.operators.intervals import interval_join, range_counts
from wirelight.operators.networks import key_prefix, keyed_events, network_entries
from wirelight.sources.scope_file import ScopeGroup, scope_domains, scope_networks

NO_DATA = "<no-data>"
NO_MATCH = "<no-match>"


def _judge(
    events: DataFrame,
    keyed: DataFrame,
    groups: Sequence[ScopeGroup],
    tests: Callable[[ScopeGroup], dict[str, Column]],
    missing: Column,
    flag: bool,
) -> DataFrame:
    """Filter, or flag with keep/reason, by the groups' tests.

    ``tests`` gives per group: ``in`` (source matched), ``out`` (source excluded)
    and optionally ``dst_in``, ``dst_out``, ``trusted``.  They become boolean
    columns first, so the verdict itself is a short expression.
    """
    if not groups:
        if not flag:
            return events
        return events.select("*", F.lit(True).alias("keep"), F.lit(None).cast("string").alias("reason"))
    ordered = sorted(groups, key=lambda g: g.name)
    flags = {f"_{role}_{i}": test for i, g in enumerate(ordered) for role, test in tests(g).items()}
    tested = derive_once(keyed, flags)
    no = F.lit(False)

    def matches(i: int) -> tuple[Column, Column]:
        def get(role: str, default: Column) -> Column:
            return F.col(f"_{role}_{i}") if f"_{role}_{i}" in flags else default

        src_in, src_out = get("in", no), get("out", no)
        # a source that matches and is not excluded leaves it to the destination
        matched = src_in & (src_out | get("dst_in", F.lit(True)))
        return matched, src_out | get("dst_out", no) | get("trusted", no)

    verdicts = [(g.name, *matches(i)) for i, g in enumerate(ordered)]
    denied = F.coalesce(*[F.when(m & x, name) for name, m, x in verdicts])
    matched = any_of([m for _, m, _ in verdicts])
    if not flag:
        return tested.where(~missing & matched & denied.isNull()).select(*events.columns)
    reason = (
        F.when(missing, NO_DATA).when(denied.isNotNull(), denied).when(~matched, NO_MATCH)
    )
    judged = tested.withColumn("_reason", reason)
    return judged.select(
        *events.columns, F.col("_reason").isNull().alias("keep"), F.col("_reason").alias("reason")
    )


def _src_tests(group: ScopeGroup) -> dict[str, Column]:
    net = group.networks()
    return {
        "in": in_prefixes("_src", net.prefixes("src_in")),
        "out": in_prefixes("_src", net.prefixes("src_out")),
    }


def _dst_tests(group: ScopeGroup) -> dict[str, Column]:
    net = group.networks()
    return {
        "dst_in": in_prefixes("_dst", net.prefixes("dst_in")),
        "dst_out": in_prefixes("_dst", net.prefixes("dst_out")),
    }


def scope_ip(events: DataFrame, groups: Sequence[ScopeGroup], flag: bool = False) -> DataFrame:
    """Keep connection or TLS rows in scope; ``flag=True`` adds keep/reason instead."""
    keyed = keyed_events(events, "_src", "_dst")
    missing = F.col("_src").isNull() | F.col("_dst").isNull()
    return _judge(events, keyed, groups, lambda g: {**_src_tests(g), **_dst_tests(g)}, missing, flag)


def scope_dns(
    events: DataFrame, groups: Sequence[ScopeGroup], flag: bool = False, use_dest: bool = False
) -> DataFrame:
    """Keep DNS rows in scope.  The asked server only counts with ``use_dest``."""
    keyed = keyed_events(events, "_src", "_dst" if use_dest else None)

    def tests(group: ScopeGroup) -> dict[str, Column]:
        found = {**_src_tests(group), "trusted": trusted_by("query", list(group.trusted_domains))}
        if use_dest:
            dst = _dst_tests(group)
            unknown = F.col("_dst").isNull()
            found["dst_in"] = unknown | dst["dst_in"]
            found["dst_out"] = ~unknown & dst["dst_out"]
        return found

    missing = F.col("_src").isNull() | (F.coalesce("query", F.lit("")) == "")
    return _judge(events, keyed, groups, tests, missing, flag)


def scope_http(events: DataFrame, groups: Sequence[ScopeGroup], flag: bool = False) -> DataFrame:
    """Keep HTTP rows in scope; a URL without a host skips the domain test."""
    keyed = derive_once(keyed_events(events, "_src"), {"_host": url_host("url")})

    def tests(group: ScopeGroup) -> dict[str, Column]:
        return {**_src_tests(group), "trusted": trusted_by("_host", list(group.trusted_domains))}

    missing = F.col("_src").isNull() | (F.coalesce("url", F.lit("")) == "")
    return _judge(events, keyed, groups, tests, missing, flag)


def groups_of_src(events: DataFrame, groups: Sequence[ScopeGroup], out: str, ip: str = "srcIP") -> DataFrame:
    """Add ``out``: [(label, desc)] of every group that holds and does not exclude the source."""
    keyed = with_ip_keys(events, {"_src": ip})
    found = []
    for group in sorted(groups, key=lambda g: g.name):
        tests = _src_tests(group)
        entry = F.struct(F.lit(group.name).alias("label"), F.lit(group.label).alias("desc"))
        found.append(F.when(tests["in"] & ~tests["out"], entry))
    empty = F.array().cast("array<struct<label:string,desc:string>>")
    listed = F.array_compact(F.array(*found)) if found else empty
    return keyed.select(*events.columns, listed.alias(out))


_SRC_ROLES, _DST_ROLES = ("src_in", "src_dst", "src_out"), ("dst_in", "dst_out")


def _has_role(roles: Sequence[str]) -> Column:
    return F.exists("tags", lambda t: t["role"].isin(*roles))


def _role_lists(entries: DataFrame, roles: Sequence[str]) -> DataFrame:
    """(level, entry, tags) -> facts with one group array per role."""

    def names(role: str) -> Column:
        return F.transform(F.filter("tags", lambda t: t["role"] == role), lambda t: t["name"]).alias(role)

    return entries.where(_has_role(roles)).select("level", "entry", F.struct(*[names(r) for r in roles]).alias("facts"))


def _valid_or_fail(table: DataFrame, valid: Column, text: str, what: str) -> DataFrame:
    """The table; a row that isn't valid stops the job, as it does in the literal form."""
    message = F.concat(F.coalesce(F.col(text), F.lit("NULL")), F.lit(f" is not a valid {what}"))
    return table.where(F.when(F.coalesce(valid, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")))


def scope_join(
    events: DataFrame, scope: DataFrame, event_type: str, flag: bool = False, use_dest: bool = False, by_order: bool = False,
) -> DataFrame:
    """Verdicts against a scope table of any size (see ``scope_file.scope_frame``).

    The same as the literal forms: a scope without groups keeps everything,
    ``use_dest`` lets the asked server of DNS rows count, and a malformed network
    or domain is an error.  Networks too large to broadcast, or known to be
    (``by_order``), meet the events in address order.
    """
    if event_type not in ("ip", "tls", "dns", "http"):
        raise ValueError(f"unknown event type {event_type}")
    if scope.isEmpty():
        return _judge(events, events, [], lambda _: {}, F.lit(False), flag)
    named = scope_networks(scope)
    whole = ~F.col("role").isin("src_in", "src_dst", "dst_in") | F.contains("cidr", F.lit("/"))
    tag = F.struct("name", "role").alias("tag")
    entries = network_entries(_valid_or_fail(named, whole, "cidr", "network").select("cidr", tag), "cidr", "tag", strict=True)
    sides = (_SRC_ROLES, _DST_ROLES)
    levels = None if by_order else broadcast_levels(entries, *[_has_role(roles) for roles in sides])

    def with_groups(rows: DataFrame, key: str, roles: Sequence[str], out: str) -> DataFrame:
        if levels is not None:
            return level_join(rows, _role_lists(entries, roles), levels[sides.index(roles)], key_prefix(key), out)
        return interval_join(rows, key, _role_lists(entries, roles), out, counts[key])

    by_dest = event_type in ("ip", "tls") or (event_type == "dns" and use_dest)
    keyed = keyed_events(events, "_src", "_dst" if by_dest else None)
    if event_type == "dns":
        keyed = keyed.withColumn("_name", F.lower("query"))
    elif event_type == "http":
        keyed = keyed.withColumn("_name", url_host("url"))
    if levels is None:
        counts = range_counts(keyed, ["_src", "_dst"] if by_dest else ["_src"])
    joined = with_groups(keyed, "_src", _SRC_ROLES, "_src_groups")
    none = F.array().cast("array<string>")
    anywhere, bound = F.coalesce("_src_groups.src_in", none), F.coalesce("_src_groups.src_dst", none)
    excluded = [F.coalesce("_src_groups.src_out", none)]
    missing = F.col("_src").isNull()
    if by_dest:
        joined = with_groups(joined, "_dst", _DST_ROLES, "_dst_groups")
        # a source that is excluded needn't ask for the destination
        reached = F.array_intersect(bound, F.concat(excluded[0], F.coalesce("_dst_groups.dst_in", none)))
        bound = F.when(F.col("_dst").isNull(), bound).otherwise(reached)
        excluded.append(F.coalesce("_dst_groups.dst_out", none))
    included = F.concat(anywhere, bound)
    if event_type in ("ip", "tls"):
        missing = missing | F.col("_dst").isNull()
    else:
        trusted = _valid_or_fail(scope_domains(scope), valid_pattern("pattern"), "pattern", "domain name")
        table = domain_table(trusted.withColumnRenamed("name", "tag"), "pattern", "tag")
        names = domain_entries(table, "tag")
        name_levels = broadcast_levels(names, F.lit(True))

        def trusting(asked: DataFrame) -> DataFrame:
            return domain_hits(asked, table, "tag").groupBy("key").agg(
                F.struct(F.collect_set("tag").alias("tags")).alias("facts")
            )

        if name_levels is not None:
            small = names.select("level", "entry", F.struct("tags").alias("facts"))
            joined = level_join(joined, small, name_levels[0], name_tail("_name"), "_name_groups")
        else:
            joined = lookup_join(joined, "_name", trusting, "_name_groups", keys_from=keyed)
        excluded.append(F.coalesce("_name_groups.tags", none))
        field = "query" if event_type == "dns" else "url"
        missing = missing | (F.coalesce(F.col(field), F.lit("")) == "")
    denied = F.array_min(F.array_intersect(included, F.flatten(F.array(*excluded))))
    reason = (
        F.when(missing, NO_DATA).when(denied.isNotNull(), denied).when(F.size(included) == 0, NO_MATCH)
    )
    judged = joined.withColumn("_reason", reason)
    if flag:
        return judged.select(
            *events.columns, F.col("_reason").isNull().alias("keep"), F.col("_reason").alias("reason")
        )
    return judged.where(F.col("_reason").isNull()).select(*events.columns)


def fold_verdicts(tests: DataFrame, event_id: str) -> DataFrame:
    """Fold (event, name, matched, excluded) rows into one verdict per event."""
    hit = F.col("matched") & F.col("excluded")
    return tests.groupBy(event_id).agg(
        F.bool_or("matched").alias("_any"), F.min(F.when(hit, F.col("name"))).alias("_denied"),
    ).select(
        event_id,
        (F.col("_any") & F.col("_denied").isNull()).alias("keep"),
        F.when(F.col("_denied").isNotNull(), F.col("_denied")).when(~F.col("_any"), NO_MATCH).alias("reason"),
    )
