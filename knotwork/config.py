"""Domain schemas and experiment modes as plain data."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from knotwork.sources.readers import config


@dataclass(frozen=True)
class Settings:
    """What a run switches on and its limits."""

    mode: str = "hyper"
    prompts: str = "chemistry"
    chunk_tokens: int = 1200
    overlap_tokens: int = 100
    top_k: int = 60
    normalise: bool = True
    numeric_instances: bool = True
    repair: bool = True
    hybrid_rank: bool = True

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)


# Experiment modes: query mode, prompt profile, and whether names are normalised, numeric instances kept, hyperedges repaired, evidence ranked by all features.
PRESETS = {
    "graph_final": ("graph", "chemistry", True, True, True, True),
    "hyper_base": ("hyper", "generic_json", False, False, False, False),
    "hyper_chem_prompt": ("hyper", "chemistry", False, False, False, False),
    "hyper_norm": ("hyper", "chemistry", True, False, False, False),
    "hyper_final": ("hyper", "chemistry", True, True, True, True),
    "final_no_measurement": ("hyper", "chemistry", True, False, True, True),
    "final_no_repair": ("hyper", "chemistry", True, True, False, True),
    "final_no_rerank": ("hyper", "chemistry", True, True, True, False),
    "final_full": ("hyper", "chemistry", True, True, True, True),
}


def preset(name: str) -> Settings:
    """The settings of an experiment mode; an unknown one is refused."""
    if name not in PRESETS:
        raise ValueError(f"unknown mode {name!r}; one of {sorted(PRESETS)}")
    mode, prompts, normalise, instances, repair, hybrid = PRESETS[name]
    return Settings(mode=mode, prompts=prompts, normalise=normalise, numeric_instances=instances, repair=repair, hybrid_rank=hybrid)


def domains(root: str) -> list[str]:
    """Names of the domain packs under a folder: sub-folders with a config.json."""
    base = Path(root)
    return sorted(p.name for p in base.iterdir() if (p / "config.json").is_file()) if base.is_dir() else []


def domain(root: str, name: str, fallback: str = "default") -> dict:
    """A domain's configuration, else the fallback's."""
    return config(Path(root) / name / "config.json") or config(Path(root) / fallback / "config.json")


def condition(text: str, column: str = "type") -> Column:
    """A field's condition (`type in [...]` or `type == '...'`) as an expression; any other text is refused, never evaluated."""
    if m := re.fullmatch(r"\s*type\s*==\s*['\"]([^'\"]*)['\"]\s*", text):
        return F.col(column) == m[1]
    if m := re.fullmatch(r"\s*type\s+in\s+\[([^\]]*)\]\s*", text):
        return F.col(column).isin([x.strip().strip("'\"") for x in m[1].split(",") if x.strip()])
    raise ValueError(f"condition {text!r} is not understood")


def schema_errors(fields: list[dict], column: str = "type") -> Column:
    """Messages for a row against a declared schema: required, conditional, enum, range and number fields."""
    out = []
    for f in fields:
        name, kind = f["name"], f.get("type", "string")
        need = f.get("required", False)
        wanted = F.lit(bool(need)) if need != "conditional" else condition(f["condition"], column)
        empty = F.col(name).isNull() if kind in ("number", "integer", "array") else F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) == ""
        out.append(F.when(wanted & empty, F.lit(f"{name} is required")))
        if f.get("values"):
            out.append(F.when(~empty & ~F.col(name).isin(f["values"]), F.lit(f"{name} is not allowed")))
        if f.get("range"):
            low, high = f["range"]
            out.append(F.when(~F.col(name).between(low, high), F.lit(f"{name} is out of range")))
        if kind == "integer":
            out.append(F.when(F.col(name) != F.floor(name), F.lit(f"{name} is not whole")))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")
