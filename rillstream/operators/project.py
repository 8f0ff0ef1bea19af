"""Choosing and renaming feature columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import Config

#: Undirected features that the split renames.
SPLIT_TOTALS = (
    "total_bytes",
    "burst_count",
    "iat_sequence",
    "tcp_syn_count",
    "tcp_fin_count",
    "tcp_rst_count",
    "tcp_ack_count",
    "tcp_psh_count",
    "tcp_urg_count",
    "entropy_payload",
    "byte_distribution_uniformity",
    "printable_ratio",
    "null_ratio",
    "high_byte_ratio",
)


def split_name(name: str) -> str:
    """A directed feature's name with its direction in front; listed undirected ones get ``total_``."""
    for tail, head in (("_initiator", "fwd_"), ("_responder", "bwd_")):
        if name.endswith(tail):
            return head + name.removesuffix(tail)
    return f"total_{name}" if name in SPLIT_TOTALS else name


def split_bidirectional(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    return df.withColumnsRenamed({n: split_name(n) for n in names}), [split_name(n) for n in names]


def merge_directional(fwd: DataFrame, bwd: DataFrame, on: list[str]) -> DataFrame:
    """Two directions' features side by side, prefixed."""
    a = fwd.select(*on, *(fwd[c].alias(f"fwd_{c}") for c in fwd.columns if c not in on))
    b = bwd.select(*on, *(bwd[c].alias(f"bwd_{c}") for c in bwd.columns if c not in on))
    return a.join(b, on, "full_outer")


def project(names: list[str], cfg: Config) -> list[str]:
    """The names that the options keep, in order: a profile's, else the listed ones (as names or ``group.name``), else all."""
    if cfg.profile is not None:
        from ..plans.registry import names_of

        wanted = set(names_of(cfg.profile))
    elif cfg.features is not None:
        wanted = {f.rpartition(".")[2] for f in cfg.features}
    else:
        return names
    return [n for n in names if n in wanted]
