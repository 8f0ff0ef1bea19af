"""Options of a feature extraction."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """What to extract and how. Times are in seconds unless a name says otherwise."""

    flow_timeout: float = 60.0
    terminate_on_fin_rst: bool = True
    sampling_rate: float | None = None
    sampling_seed: int = 7
    groups: tuple[str, ...] = ("all",)
    features: tuple[str, ...] | None = None
    profile: str | None = None
    bidirectional_split: bool = False
    include_raw_sequences: bool = False
    include_splt: bool = False
    max_sequence_length: int = 50
    include_ip_addresses: bool = True
    include_ports: bool = True
    anonymize_ips: bool = False
    anonymization_salt: str = ""
    include_flow_id: bool = False
    burst_threshold_ms: float = 50.0
    entropy_sample_bytes: int = 256
    bpf_filter: str | None = None
    connection_use_ports: bool = False
    connection_include_graph_metrics: bool = True
    connection_include_temporal: bool = False

    def __post_init__(self) -> None:
        if self.flow_timeout <= 0:
            raise ValueError("flow_timeout must be positive")
        if self.sampling_rate is not None and not 0 < self.sampling_rate <= 1:
            raise ValueError("sampling_rate must be in (0, 1]")
        if self.max_sequence_length <= 0 or self.entropy_sample_bytes <= 0:
            raise ValueError("max_sequence_length and entropy_sample_bytes must be positive")
        if self.burst_threshold_ms < 0:
            raise ValueError("burst_threshold_ms must not be negative")
        if self.profile not in (None, "core", "extended", "experimental"):
            raise ValueError(f"unknown profile {self.profile!r}")

    @property
    def timeout_us(self) -> int:
        return round(self.flow_timeout * 1_000_000)

    @property
    def burst_us(self) -> int:
        return round(self.burst_threshold_ms * 1000)

    def wants(self, group: str) -> bool:
        return "all" in self.groups or group in self.groups

    def to_dict(self) -> dict:
        return asdict(self)

    def digest(self) -> str:
        """SHA-256 of the options; the salt is left out."""
        shown = {k: v for k, v in self.to_dict().items() if k != "anonymization_salt"}
        return hashlib.sha256(json.dumps(shown, sort_keys=True).encode()).hexdigest()

    @classmethod
    def from_dict(cls, options: dict) -> Config:
        known = {f.name for f in fields(cls)}
        if unknown := set(options) - known:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in options.items()})

    @classmethod
    def from_file(cls, path: str) -> Config:
        """Options of a JSON file, or of a YAML file where a YAML reader is installed; an empty file has none."""
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.from_dict(yaml.safe_load(text) or {})
        return cls.from_dict(json.loads(text or "{}"))


@dataclass(frozen=True)
class LabelSpec:
    """Which columns of a label table hold the endpoints, the flow id and the label."""

    label: str = "label"
    src_ip: str = "src_ip"
    dst_ip: str = "dst_ip"
    src_port: str = "src_port"
    dst_port: str = "dst_port"
    protocol: str = "protocol"
    flow_id: str | None = None
    default: str = "unknown"
    extra: dict = field(default_factory=dict)
