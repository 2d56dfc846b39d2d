"""Settings of the pipeline: a small YAML file of nested keys and lists of sources."""

from __future__ import annotations

from dataclasses import dataclass, field

DEFAULT_TARGETS = {"literature": 26000, "trials": 7000}


@dataclass(frozen=True)
class Config:
    store: str = ""
    user_agent: str = ""
    targets: dict[str, int] = field(default_factory=lambda: dict(DEFAULT_TARGETS))


def load(path: str) -> Config:
    """Reads the keys that matter: ``db.path`` (or host, port and name), ``logic.user_agent`` and
    each source's ``name`` and ``target_count``. Sources that are not named keep their default."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading a configuration file needs PyYAML") from e
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    db, targets = raw.get("db") or {}, dict(DEFAULT_TARGETS)
    for s in raw.get("sources") or []:
        if s.get("name") and s.get("target_count") is not None:
            targets[s["name"]] = int(s["target_count"])
    store = db.get("path") or "/".join(str(db[k]) for k in ("host", "port", "name") if k in db)
    return Config(store, (raw.get("logic") or {}).get("user_agent", ""), targets)
