"""Configuration of conversions: five fixed sections from TOML or YAML, and command-line overrides."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields, replace

# Accepted names.
STORAGE = ("sparse-csr", "sparse-csc", "dense")
BACKENDS = ("zarr", "icechunk")
PLACES = ("local", "gcs")


@dataclass(frozen=True)
class IO:
    overwrite: bool = False
    consolidate_metadata: bool = False
    x_storage: str = "sparse-csr"
    backed: bool = False
    backend: str = "zarr"
    icechunk_storage: str = "local"
    gcs_bucket: str | None = None
    gcs_prefix: str = ""


@dataclass(frozen=True)
class Chunks:
    x_row_chunk: int = 2048
    x_col_chunk: int = 2048
    sparse_flat_chunk: int = 1_000_000
    cpus: int = 1
    x_shard_factor: int = 1


@dataclass(frozen=True)
class Validation:
    reject_spatial: bool = True
    require_non_empty: bool = True
    min_obs: int = 1
    min_vars: int = 1


@dataclass(frozen=True)
class Grouping:
    enabled: bool = False
    sort_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Concat:
    obs_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class AppConfig:
    io: IO = field(default_factory=IO)
    chunks: Chunks = field(default_factory=Chunks)
    validation: Validation = field(default_factory=Validation)
    grouping: Grouping = field(default_factory=Grouping)
    concat: Concat = field(default_factory=Concat)


def check(cfg: AppConfig) -> AppConfig:
    """Enumerations in lower case and known, numbers positive."""
    io = replace(cfg.io, **{k: str(getattr(cfg.io, k)).strip().lower() for k in ("x_storage", "backend", "icechunk_storage")})
    for value, known, name in ((io.x_storage, STORAGE, "x_storage"), (io.backend, BACKENDS, "backend"), (io.icechunk_storage, PLACES, "icechunk_storage")):
        if value not in known:
            raise ValueError(f"{name} must be one of {list(known)}, not {value!r}")
    for name, value in asdict(cfg.chunks).items():
        if not isinstance(value, int) or value < 1:
            raise ValueError(f"chunks.{name} must be 1 or more")
    if cfg.grouping.enabled and not cfg.grouping.sort_by:
        raise ValueError("grouping is enabled without sort_by")
    if io.backend == "icechunk" and io.backed:
        raise ValueError("the versioned backend takes no backed input")
    return replace(cfg, io=io)


def _listed(kind: type, key: str, value):
    """A list as a tuple; a bare name where a list may stand is a list of one."""
    several = isinstance(next(f.default for f in fields(kind) if f.name == key), tuple)
    return (value,) if several and isinstance(value, str) else tuple(value) if isinstance(value, list) else value


def from_dict(raw: dict) -> AppConfig:
    known = {f.name: f for f in fields(AppConfig)}
    unknown = sorted(set(raw) - set(known))
    if unknown:
        raise ValueError(f"unknown config sections: {unknown}")
    parts = {}
    for name, f in known.items():
        kind, values = f.default_factory, raw.get(name) or {}
        bad = sorted(set(values) - {x.name for x in fields(kind)})
        if bad:
            raise ValueError(f"unknown keys in [{name}]: {bad}")
        parts[name] = kind(**{k: _listed(kind, k, v) for k, v in values.items()})
    return check(AppConfig(**parts))


def load_config(path: str | None) -> AppConfig:
    if not path:
        return AppConfig()
    with open(path, "rb") as f:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise ValueError("YAML configs need pyyaml") from e
            return from_dict(yaml.safe_load(f) or {})
        if path.endswith(".toml"):
            return from_dict(tomllib.load(f))
    raise ValueError(f"config must be .toml, .yaml or .yml: {path}")


def override(cfg: AppConfig, **flags) -> AppConfig:
    """Flags that are not None replace the config's; sort_by switches grouping on."""
    given = {k: v for k, v in flags.items() if v is not None}
    for name in ("io", "chunks", "validation", "concat"):
        section = getattr(cfg, name)
        mine = {f.name: given[f.name] for f in fields(section) if f.name in given}
        cfg = replace(cfg, **{name: replace(section, **{k: _listed(type(section), k, v) for k, v in mine.items()})})
    if "sort_by" in given:
        cfg = replace(cfg, grouping=Grouping(True, _listed(Grouping, "sort_by", given["sort_by"])))
    return check(cfg)
