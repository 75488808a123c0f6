"""Monitoring scope: named groups of networks and trusted destinations."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelight.operators.networks import NetworkMatch, network_prefixes

# The scope used when no file is given.
DEFAULT_SCOPE: dict[str, Any] = {
    "default": {
        "label": "Default",
        "in_scope": ["10.0.0.0/8", "192.168.0.0/16", "172.16.0.0/12", "fc00::/7"],
        "trusted_domains": ["*.arpa", "*.lan", "*.local", "*.internal"],
        "trusted_ips": [
            "10.0.0.0/8",
            "127.0.0.0/8",
            "169.254.0.0/16",
            "172.16.0.0/12",
            "192.168.0.0/16",
            "224.0.0.0/8",
            "255.255.255.255/32",
            "fc00::/7",
            "fe80::/10",
            "ff00::/8",
        ],
    },
}

_LISTS = ("in_scope", "out_scope", "trusted_ips", "trusted_domains")
_LABEL = re.compile(r"[A-Za-z0-9_](?:[A-Za-z0-9_-]{0,61}[A-Za-z0-9_])?")


def _is_name(text: str) -> bool:
    body = text.removesuffix(".")
    return (
        len(text) <= 254 - (body == text)
        and re.search("[A-Za-z_]", text) is not None
        and all(_LABEL.fullmatch(label) for label in body.split("."))
    )


@dataclass(frozen=True)
class ScopeGroup:
    """One group: which sources to watch, which destinations to trust."""

    name: str
    label: str = ""
    in_scope: tuple[str, ...] = ()
    out_scope: tuple[str, ...] = ()
    trusted_ips: tuple[str, ...] = ()
    trusted_domains: tuple[str, ...] = ()
    dst_includes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for domain in self.trusted_domains:
            if not _is_name(domain) and not _is_name(domain.removeprefix("*.")):
                raise ValueError(f"{domain} is not a valid domain name")
        self.networks()

    def networks(self) -> NetworkMatch:
        return NetworkMatch(self.in_scope, self.out_scope, self.dst_includes, self.trusted_ips)


def _groups(config: dict[str, Any]) -> list[ScopeGroup]:
    groups = []
    for name, body in (config or {}).items():
        body = body or {}
        unknown = set(body) - {"label", *_LISTS}
        if unknown:
            raise ValueError(f"scope group {name}: unknown keys {sorted(unknown)}")
        lists = {key: tuple(body.get(key) or ()) for key in _LISTS}
        for key in _LISTS[:3]:
            for cidr in lists[key]:
                network_prefixes(cidr)
        groups.append(ScopeGroup(name, body.get("label") or "", **lists))
    return sorted(groups, key=lambda g: g.name)


def load_scope(path: str | None = None) -> list[ScopeGroup]:
    """Groups of a YAML or JSON scope file, or the default scope; sorted by name."""
    if path is None:
        return _groups(DEFAULT_SCOPE)
    text = Path(path).read_text()
    if path.endswith(".json"):
        config = json.loads(text)
    else:
        import yaml

        config = yaml.safe_load(text)
    unknown = set(config or {}) - {"groups"}
    if unknown:
        raise ValueError(f"scope file: unknown keys {sorted(unknown)}")
    return _groups((config or {}).get("groups"))


def merge_scope(groups: list[ScopeGroup], **overrides: Any) -> list[ScopeGroup]:
    """The same groups with some of their settings replaced."""
    return [replace(group, **overrides) for group in groups]


def scope_frame(spark: SparkSession, groups: list[ScopeGroup]) -> DataFrame:
    """The scope as a small table, one row per group."""
    rows = [
        (g.name, g.label, list(g.in_scope), list(g.out_scope), list(g.trusted_ips),
         list(g.trusted_domains), list(g.dst_includes))
        for g in groups
    ]
    lists = ", ".join(f"{name} array<string>" for name in (*_LISTS, "dst_includes"))
    return spark.createDataFrame(rows, f"name string, label string, {lists}")


def scope_networks(scope: DataFrame) -> DataFrame:
    """(name, role, cidr): the networks of every group; an empty in_scope is everything.

    The sources of a group that is bound to destinations (``dst_includes``, a
    column the table may lack) have the role ``src_dst`` instead of ``src_in``.
    """
    none = F.array().cast("array<string>")

    def given(name: str) -> Column:
        return F.coalesce(F.col(name), none) if name in scope.columns else none

    everywhere = F.array(F.lit("0.0.0.0/0"), F.lit("::/0"))
    in_scope = F.when(F.size(given("in_scope")) > 0, given("in_scope")).otherwise(everywhere)
    bound = F.size(given("dst_includes")) > 0
    roles = {
        "src_in": F.when(~bound, in_scope).otherwise(none), "src_dst": F.when(bound, in_scope).otherwise(none),
        "src_out": given("out_scope"), "dst_in": given("dst_includes"), "dst_out": given("trusted_ips"),
    }

    def with_role(role: str, cidrs: Column) -> Column:
        return F.transform(cidrs, lambda c: F.struct(F.lit(role).alias("role"), c.alias("cidr")))

    tagged = [with_role(role, cidrs) for role, cidrs in roles.items()]
    return scope.select("name", F.inline(F.concat(*tagged)))


def scope_domains(scope: DataFrame) -> DataFrame:
    """(name, pattern): the trusted domains of every group."""
    return scope.select("name", F.explode("trusted_domains").alias("pattern"))
