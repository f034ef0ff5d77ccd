"""Dataset profiles: validation, runtime settings, lifecycle and listing. Driver-side, small documents."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quern.operators.ingest import IngestError
from quern.operators.schema_drift import fold_header
from quern.operators.retrieval import public_columns
from quern.sources.files import Files
from quern.sources.snapshots import Snapshots

_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
#: Settings that may change without a new ingestion.
RUNTIME = ("minimum_score", "candidate_k", "result_k", "default_mode", "field_aliases", "description", "excluded_fields")
MOST_CANDIDATES = 200


def positive(value: object, name: str) -> int:
    """A positive whole number, also given as text; booleans are none."""
    if isinstance(value, str) and re.fullmatch(r"\s*\d+\s*", value):
        value = int(value)
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise IngestError(f"{name} must be a positive whole number")
    return value


@dataclass(frozen=True)
class Profile:
    """A validated profile."""

    name: str
    mapping: dict[str, str]
    primary: str
    id_key: str | None = None
    excluded: tuple[str, ...] | None = None
    settings: dict = field(default_factory=dict)

    @property
    def public(self) -> list[str]:
        return public_columns(list(self.mapping), None if self.excluded is None else list(self.excluded))


def validate(document: dict) -> Profile:
    """A profile from its document; the first fault found is raised."""
    mapping = document.get("schema_mapping")
    if not isinstance(mapping, dict) or not mapping:
        raise IngestError("schema_mapping must map keys to headers")
    for key, label in mapping.items():
        if not _KEY.match(key) or key in ("id", "record_id", "_raw_json", "raw_json"):
            raise IngestError(f"not a usable key: {key!r}")
        if not isinstance(label, str) or not label.strip():
            raise IngestError(f"no header for {key!r}")
    if len({fold_header(v) for v in mapping.values()}) < len(mapping):
        raise IngestError("two keys map to one header")
    primary = document.get("primary_entity")
    if primary not in mapping:
        raise IngestError("primary_entity must be a mapped key")
    id_key = document.get("source_id_field")
    if id_key is not None and id_key not in mapping:
        raise IngestError("source_id_field must be a mapped key")
    excluded = document.get("excluded_fields")
    unknown = set(excluded or []) - set(mapping)
    if unknown or primary in (excluded or []):
        raise IngestError("excluded_fields must be mapped keys other than the primary")
    settings = {k: document[k] for k in RUNTIME if k in document}
    k, r = positive(settings.get("candidate_k", 20), "candidate_k"), positive(settings.get("result_k", 5), "result_k")
    if k > MOST_CANDIDATES or r > k:
        raise IngestError("result_k must not exceed candidate_k, nor that its limit")
    score = settings.get("minimum_score", 0.01)
    if isinstance(score, bool) or not isinstance(score, (int, float)) or not 0 <= score <= 1:
        raise IngestError("minimum_score must lie between 0 and 1")
    return Profile(document.get("domain_name", ""), dict(mapping), primary, id_key, None if excluded is None else tuple(excluded), settings)


def overlay(document: dict, *layers: dict) -> dict:
    """A profile with runtime settings laid over it, later layers first in force; structural keys are refused."""
    out = dict(document)
    for layer in layers:
        unknown = set(layer) - set(RUNTIME)
        if unknown:
            raise IngestError("these need a new ingestion: " + ", ".join(sorted(unknown)))
        out.update(layer)
    validate(out)
    return out


class Registry:
    """Datasets under one folder, each with its snapshots and a lifecycle state."""

    def __init__(self, folder: str, protected: str = "default"):
        self.folder, self.protected = folder.rstrip("/"), protected
        self.files = Files(self.folder)
        self.files.make()

    def snapshots(self, name: str) -> Snapshots:
        if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", name):
            raise IngestError("not a usable dataset name")
        return Snapshots(f"{self.folder}/{name}")

    def state(self, name: str) -> str:
        got = self.files.read_json(f"{name}/lifecycle.json")
        return got.get("status", "enabled") if isinstance(got, dict) else "enabled"

    def set_state(self, name: str, status: str) -> None:
        if status not in ("enabled", "disabled", "deleted"):
            raise IngestError("unknown state")
        if name == self.protected and status == "deleted":
            raise IngestError("the default dataset can't be deleted")
        self.files.make(name)
        self.files.write_json(f"{name}/lifecycle.json", {"status": status})

    def names(self) -> list[str]:
        """The protected dataset and all that have a folder."""
        return sorted({self.protected, *(n for n in self.files.names() if self.files.is_folder(n))})

    def ready(self) -> list[str]:
        """Enabled datasets with an active generation."""
        return [n for n in self.names() if self.state(n) == "enabled" and self.files.is_folder(n) and self.snapshots(n).active()]
