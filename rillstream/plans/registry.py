"""The catalogue of features, made from the groups themselves."""

from __future__ import annotations

import csv
import io
from dataclasses import asdict, dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from ..config import Config

TIERS = ("core", "extended", "experimental")
_EVERYTHING = Config(include_raw_sequences=True, include_splt=True, include_flow_id=True, connection_include_temporal=True)
GRAPH_OPTIONAL = ("conn_src_flow_rate", "conn_temporal_spread", "conn_burst_connections")


@dataclass(frozen=True)
class Feature:
    """A feature's name, its group, its tier (none for what only an option turns on) and its column type."""

    name: str
    group: str
    tier: str | None
    dtype: str

    @property
    def id(self) -> str:
        return f"{self.group}.{self.name}"


@lru_cache(1)
def catalogue() -> tuple[Feature, ...]:
    """Every feature, in the order of the output. Types come from a plan over an empty packet table; needs an active session."""
    from ..schema import packet_type
    from .extract import GROUPS, extract

    spark = SparkSession.getActiveSession()
    wide = extract(spark.createDataFrame([], packet_type()), Config(**{**_EVERYTHING.to_dict(), "groups": tuple(GROUPS)})).schema
    types = {f.name: f.dataType.simpleString() for f in wide}
    out = []
    for g in GROUPS.values():
        for name in g.finish(_EVERYTHING):
            out.append(Feature(name, g.name, None if name in g.optional else g.tier, types[name]))
    for name in GRAPH_NAMES:
        kind = "double" if name.endswith(("betweenness", "clustering", "rate", "spread")) else "bigint"
        out.append(Feature(name, "connection", None if name in GRAPH_OPTIONAL else "experimental", kind))
    if len({f.name for f in out}) != len(out):
        raise ValueError("two features share a name")
    return tuple(out)


#: Names of the graph's features, in order.
GRAPH_NAMES = (
    *(f"conn_{x}" for x in ("src_unique_dsts", "dst_unique_srcs", "src_dst_flows", "src_port_flows", "src_total_flows", "dst_total_flows", "src_total_packets", "src_total_bytes")),
    *(f"conn_{x}" for x in ("dst_total_packets", "dst_total_bytes", "src_unique_ports", "src_out_degree", "dst_in_degree", "src_betweenness", "dst_betweenness")),
    *(f"conn_{x}" for x in ("src_community", "dst_community", "same_community", "src_clustering", "dst_clustering", "src_flow_rate", "temporal_spread", "burst_connections")),
)


def names_of(tier: str) -> list[str]:
    """Features of a tier's own profile."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier!r}")
    return [f.name for f in catalogue() if f.tier == tier]


def table(spark: SparkSession) -> DataFrame:
    """The catalogue as a table: ``id, name, group, tier, dtype``."""
    return spark.createDataFrame([(f.id, f.name, f.group, f.tier, f.dtype) for f in catalogue()], "id string, name string, group string, tier string, dtype string")


def json_schema(tier: str | None = None) -> dict:
    """A JSON Schema of one output row."""
    kinds = {"bigint": "integer", "int": "integer", "double": "number", "boolean": "boolean", "string": "string"}
    shown = [f for f in catalogue() if tier is None or f.tier == tier]
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        "type": "object",
        "properties": {f.name: {"type": kinds.get(f.dtype, "array"), "description": f"{f.group}, {f.tier or 'optional'}"} for f in shown},
    }


def markdown() -> str:
    """The catalogue as a Markdown table."""
    rows = [f"| `{f.name}` | {f.group} | {f.tier or 'optional'} | {f.dtype} |" for f in catalogue()]
    return "\n".join(["| feature | group | tier | type |", "|-|-|-|-|", *rows]) + "\n"


def as_dicts() -> list[dict]:
    return [asdict(f) | {"id": f.id} for f in catalogue()]


def csv_text() -> str:
    """The catalogue as CSV: ``id,name,group,tier,dtype``; types that hold commas stand in quotes."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["id", "name", "group", "tier", "dtype"])
    w.writerows([f.id, f.name, f.group, f.tier or "", f.dtype] for f in catalogue())
    return out.getvalue()
