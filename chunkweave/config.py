"""Settings of the engine and of the links between nodes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of a run; unknown keys of a config file are ignored, values are cast to the default's type."""

    put_batch: int = 128
    get_batch: int = 128
    restore_window_size: int = 4096
    cloud_full_threshold: int = 1
    rpc_timeout_ms: int = 3000
    max_message_bytes: int = 64 << 20
    placer: str = "round_robin"
    replicate_to_cloud: bool = False
    container_bytes: int = 4 << 20
    container_meta_bytes: int = 32 << 10
    nodes: tuple[str, ...] = field(default_factory=lambda: tuple(f"edge{i}" for i in range(1, 11)))

    def overridden(self, values: dict[str, str]) -> EngineConfig:
        out = {}
        for f in fields(self):
            if f.name in values:
                now, raw = getattr(self, f.name), values[f.name]
                if isinstance(now, bool):
                    out[f.name] = str(raw).strip().lower() in ("1", "true", "yes", "on")
                elif isinstance(now, tuple):
                    out[f.name] = tuple(x.strip() for x in raw.split(",")) if isinstance(raw, str) else tuple(raw)
                else:
                    out[f.name] = type(now)(raw)
        return replace(self, **out)


@dataclass(frozen=True)
class LinkModel:
    """Bandwidth in bits a second and round-trip time in seconds of the edge and the cloud link."""

    edge_bps: float = 1.5e9
    edge_rtt: float = 0.002
    cloud_bps: float = 1e8
    cloud_rtt: float = 0.05
    batch: int = 128
    nodes: int = 10


def key_values(text: str, strip_quotes: bool = True) -> dict[str, str]:
    """key=value lines; blank lines and # comments are skipped, the last value of a key wins."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            key, _, value = line.partition("=")
            value = value.strip()
            if strip_quotes and len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            out[key.strip()] = value
    return out


def simple_yaml(text: str) -> dict[str, object]:
    """`key: value` and `key:` with `- item` lines of one level, which is all that config files use."""
    out: dict[str, object] = {}
    key = None
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        if line.lstrip().startswith("- ") and key:
            items = out.setdefault(key, [])
            if items == "":
                items = out[key] = []
            items.append(line.strip()[2:].strip().strip("\"'"))
        else:
            key, _, value = line.strip().partition(":")
            out[key] = value.strip().strip("\"'")
    return out
