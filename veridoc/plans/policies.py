"""Per-topic policies: strict, immutable settings that plans turn into literals."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any

from veridoc.functions.text import IDENTIFIERS


@dataclass(frozen=True)
class Chunking:
    max_chars: int = 2000
    overlap_chars: int = 200
    min_chars_to_split: int = 2600

    def __post_init__(self):
        if self.max_chars <= 0 or not 0 <= self.overlap_chars < self.max_chars:
            raise ValueError("max_chars must be positive and overlap_chars below it, not negative")


@dataclass(frozen=True)
class Cleanup:
    folio_border: int = 1
    fraction: float = 0.6
    border_lines: int = 3
    min_pages: int = 3


@dataclass(frozen=True)
class DocumentClass:
    name: str
    markers: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    types: tuple[str, ...] = ()


@dataclass(frozen=True)
class Documents:
    classes: tuple[DocumentClass, ...] = ()
    default: str = "interna"
    exposes: tuple[str, ...] = ()

    def __post_init__(self):
        unknown = set(self.exposes) - {c.name for c in self.classes} - {self.default}
        if unknown:
            raise ValueError(f"exposed classes that do not exist: {sorted(unknown)}")


@dataclass(frozen=True)
class Profile:
    slug: str
    chunking: Chunking = field(default_factory=Chunking)
    cleanup: Cleanup = field(default_factory=Cleanup)
    documents: Documents = field(default_factory=Documents)
    top_k: int = 6
    min_score: float = 0.12
    redaction: tuple[str, ...] = ()
    banned_markers: tuple[str, ...] = ()
    path_metadata: tuple[str, ...] = ()
    decline: str = "No consta en los documentos disponibles."

    def __post_init__(self):
        unknown = set(self.redaction) - set(IDENTIFIERS)
        if unknown:
            raise ValueError(f"unknown identifier patterns: {sorted(unknown)}")


_NESTED = {"chunking": Chunking, "cleanup": Cleanup, "documents": Documents}


def _build(kind: type, values: dict[str, Any]):
    known = {f.name for f in dataclasses.fields(kind)}
    unknown = set(values) - known
    if unknown:
        raise ValueError(f"unknown keys for {kind.__name__}: {sorted(unknown)}")
    made = {}
    for key, value in values.items():
        if kind is Profile and key in _NESTED:
            value = _build(_NESTED[key], value)
        elif kind is Documents and key == "classes":
            value = tuple(_build(DocumentClass, v) for v in value)
        elif isinstance(value, list):
            value = tuple(value)
        made[key] = value
    return kind(**made)


def read_profiles(values: list[dict[str, Any]]) -> dict[str, Profile]:
    """Profiles by slug from parsed settings; the first is the default. Unknown keys and repeated slugs raise."""
    found: dict[str, Profile] = {}
    for v in values:
        profile = _build(Profile, v)
        if profile.slug in found:
            raise ValueError(f"two profiles are called {profile.slug}")
        found[profile.slug] = profile
    return found


def read_profile_file(spark, path: str) -> dict[str, Profile]:
    """read_profiles of a JSON file, one object by slug or a list of objects, in storage that Spark reads."""
    values = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return read_profiles([{"slug": k, **v} for k, v in values.items()] if isinstance(values, dict) else values)


#: The two topics that the plans run with: one public, one that masks and exposes nothing.
PUBLIC = Profile(
    slug="publico",
    chunking=Chunking(2000, 250, 2600),
    top_k=8,
    min_score=0.12,
    documents=Documents(
        classes=(
            DocumentClass("licencia", markers=("MIT License", "CC BY"), types=()),
            DocumentClass("abierta", paths=("src1*/*",), types=()),
            DocumentClass("ficha", types=("ficha_tecnica", "documento")),
        ),
        default="interna",
        exposes=("abierta", "licencia"),
    ),
    path_metadata=("origen", "idioma"),
    banned_markers=("password", "BEGIN PRIVATE KEY", "api_key"),
)
PRIVATE = Profile(slug="privado", chunking=Chunking(2000, 200, 6000), min_score=0.0, redaction=("curp", "rfc", "telefono", "cedula"), banned_markers=("INE", "CURP"))
