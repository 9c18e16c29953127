"""Description of an organism's files, from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Annotation:
    path: str
    dialect: str | None = None
    id_prefix: str | None = None
    linkage: str = "auto"


@dataclass(frozen=True)
class Functional:
    path: str
    tool: str | None = None
    minimum_match_rate: float = 1.0


@dataclass(frozen=True)
class OrganismConfig:
    genus: str
    species: str
    assembly: str
    fasta: str | None = None
    strain: str = "reference"
    version: str | None = None
    accession: str | None = None
    common_name: str | None = None
    ncbi_taxon_id: int | None = None
    annotations: tuple[Annotation, ...] = ()
    functional: tuple[Functional, ...] = field(default=())

    @property
    def label(self) -> str:
        return " ".join(x for x in (self.genus, self.species, self.strain, self.assembly, self.version) if x)


def _need(table: dict, key: str, where: str):
    if key not in table:
        raise ValueError(f"{where}: {key} is missing")
    return table[key]


def load_config(path: str | Path) -> OrganismConfig:
    """Paths in the file are relative to it."""
    p = Path(path)
    data = tomllib.loads(p.read_text())
    at = lambda x: x if x is None or "://" in x or Path(x).is_absolute() else str((p.parent / x).resolve())
    o, a = _need(data, "organism", str(p)), _need(data, "assembly", str(p))
    return OrganismConfig(
        _need(o, "genus", "organism"), _need(o, "species", "organism"), _need(a, "name", "assembly"), at(a.get("fasta")), o.get("strain", "reference"), a.get("version"), a.get("accession"), o.get("common_name"), o.get("ncbi_taxon_id"),
        tuple(Annotation(at(_need(x, "path", "annotation")), x.get("dialect"), x.get("id_prefix"), x.get("linkage", "auto")) for x in data.get("annotation", [])),
        tuple(Functional(at(_need(x, "path", "functional")), x.get("tool"), float(x.get("minimum_match_rate", 1.0))) for x in data.get("functional", [])),
    )
