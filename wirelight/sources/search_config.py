"""Which document fields hold what: default mappings, user overrides, search terms."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

EVENT_TYPES = ("dns", "ip", "http", "tls")
SCHEMAS = ("ecs", "corelight")

PAGE_SIZE = 10_000
LOOK_BACK = "5 MINUTES"

# Default document paths per event type (ecs schema).
_COMMON = {
    "event_ingested": "event.ingested",
    "timestamp": "@timestamp",
    "src_ip": "source.ip",
    "src_port": "source.port",
}
ECS_FIELDS: dict[str, dict[str, str]] = {
    "dns": {
        **_COMMON,
        "query": "dns.question.name",
        "qtype": "dns.question.type",
    },
    "ip": {
        **_COMMON,
        "dest_ip": "destination.ip",
        "dest_port": "destination.port",
        "proto": "network.protocol",
        "bytes_in": "destination.bytes",
        "bytes_out": "source.bytes",
    },
    "http": {
        **_COMMON,
        "url": "url.original",
        "method": "http.request.method",
        "status_code": "http.response.status_code",
        "bytes_in": "destination.bytes",
        "bytes_out": "source.bytes",
        "user_agent": "user_agent.original",
        "content_type": "http.response.mime_type",
        "referrer": "http.request.referrer",
    },
    "tls": {
        **_COMMON,
        "dest_ip": "destination.ip",
        "dest_port": "destination.port",
        "cert_hash": "tls.server.hash.sha1",
        "issuer": "tls.server.issuer",
        "subject": "tls.server.subject",
        "valid_from": "tls.server.not_before",
        "valid_to": "tls.server.not_after",
        "ja3": "tls.client.ja3",
        "ja3s": "tls.server.ja3s",
    },
}

# Fields a document must have (ecs schema).
ECS_MUST_HAVE = {
    "dns": ["@timestamp", "event.ingested", "source.ip", "dns.question.name"],
    "ip": ["@timestamp", "event.ingested", "source.ip", "destination.ip"],
    "http": ["@timestamp", "event.ingested", "source.ip", "url.original"],
    "tls": ["@timestamp", "event.ingested", "source.ip"],
}

# Record type terms (corelight schema).
CORELIGHT_TERMS = {
    "dns": {"_path": "dns"},
    "ip": {"_path": "conn"},
    "http": {"_path": "http"},
    "tls": {"_path": "ssl"},
}

_REQUIRED = {"dns": ["query"], "ip": ["dest_ip"], "http": ["url"], "tls": []}
_KNOWN = {name for fields in ECS_FIELDS.values() for name in fields}


@dataclass(frozen=True)
class Search:
    """One search over landed documents.

    ``fields`` overrides the schema's paths one by one.  ``terms`` are equality
    conditions on document paths; ``where`` is an SQL condition on the landed
    columns instead of terms.
    """

    event_type: str
    schema: str = ""
    fields: Mapping[str, str] = field(default_factory=dict)
    must_have: tuple[str, ...] = ()
    terms: Mapping[str, str] = field(default_factory=dict)
    where: str | None = None
    page_size: int = PAGE_SIZE

    def __post_init__(self) -> None:
        if self.event_type not in EVENT_TYPES:
            raise ValueError(f"unsupported event type: {self.event_type!r}")
        if self.schema and self.schema not in SCHEMAS:
            raise ValueError(f"schema must be one of {SCHEMAS} or empty")
        unknown = set(self.fields) - _KNOWN
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        if not self.final_terms() and not self.where and not self.final_must_have():
            raise ValueError("a search needs terms, a condition or fields that must exist")
        paths = self.field_map()
        for name in ["event_ingested", "timestamp", "src_ip", *_REQUIRED[self.event_type]]:
            if not paths.get(name):
                raise ValueError(f"{name} is required for {self.event_type} searches")

    def field_map(self) -> dict[str, str]:
        """The schema's paths with the user's on top."""
        defaults = ECS_FIELDS[self.event_type] if self.schema == "ecs" else {}
        return {**defaults, **{name: path for name, path in self.fields.items() if path}}

    def final_must_have(self) -> list[str]:
        if self.must_have:
            return list(self.must_have)
        return list(ECS_MUST_HAVE[self.event_type]) if self.schema == "ecs" else []

    def final_terms(self) -> dict[str, str]:
        if self.terms or self.where:
            return dict(self.terms)
        return dict(CORELIGHT_TERMS[self.event_type]) if self.schema == "corelight" else {}

    def source_paths(self) -> list[str]:
        """Document paths to fetch, timestamps aside."""
        paths = self.field_map()
        return [p for name, p in paths.items() if name not in ("event_ingested", "timestamp")]

    def read_paths(self) -> list[str]:
        """All document paths the search looks at: those it fetches, tests for existence or compares."""
        return list(dict.fromkeys([*self.source_paths(), *self.final_must_have(), *self.final_terms()]))
