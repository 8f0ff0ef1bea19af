"""From packets to one wide row per session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import flow_features, net_features, payload_features
from ..operators.base import Group
from ..operators.filters import expression
from ..operators.graph import connection_features
from ..operators.project import project, split_bidirectional
from ..operators.sessionize import SESSION, sample, sessionize
from ..schema import conform

GROUPS: dict[str, Group] = {g.name: g for g in (*flow_features.GROUPS, *net_features.GROUPS, *payload_features.GROUPS)}


def _with_needs(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in (*GROUPS[n].needs, n) if x not in out]
    return out


def aggregate(sessions: DataFrame, names: list[str], cfg: Config) -> DataFrame:
    """One row per session with the features of the named groups.

    All groups share one grouping by session, which reuses the partitioning of the session windows: the packets are shuffled once.
    """
    df = sessions
    for n in _with_needs(names):
        df = GROUPS[n].prepare(df, cfg)
    aggregates = {k: v for n in names for k, v in GROUPS[n].aggregate(cfg).items()}
    kept = {"close_reason": F.first("close_reason")}
    wide = df.groupBy(*SESSION).agg(*(v.alias(k) for k, v in (kept | aggregates).items()))
    features = {k: v for n in names for k, v in GROUPS[n].finish(cfg).items()}
    keys = [F.col(k).alias(f"_{k}") for k in SESSION]
    return wide.select(*keys, F.col("close_reason").alias("_close_reason"), *(v.alias(k) for k, v in features.items()))


def extract(packets: DataFrame, cfg: Config | None = None, keep_keys: bool = False) -> DataFrame:
    """Features of every session: filter, sample, sessionize, aggregate, add the graph, rename and project as the options say."""
    cfg = cfg or Config()
    packets = conform(packets)
    if cfg.bpf_filter:
        packets = packets.where(expression(cfg.bpf_filter))
    sessions = sessionize(sample(packets, cfg), cfg)
    names = [n for n in GROUPS if cfg.wants(n)]
    graph = cfg.wants("connection")
    if graph and "flow_meta" not in names:
        names.insert(0, "flow_meta")
    whole = cfg if not graph else Config(**{**cfg.to_dict(), "include_ip_addresses": True, "include_ports": True, "anonymize_ips": False})
    out = aggregate(sessions, names, whole)
    shown = [c for c in out.columns if not c.startswith("_")]
    if cfg.bidirectional_split:
        out, shown = split_bidirectional(out, shown)
    if graph:
        out = _graph(out, cfg)
        shown += [c for c in out.columns if c.startswith("conn_")]
        if not cfg.wants("flow_meta"):
            own = set(GROUPS["flow_meta"].finish(whole))
            shown = [c for c in shown if c not in own]
        shown = [c for c in shown if (cfg.include_ip_addresses or c not in ("src_ip", "dst_ip")) and (cfg.include_ports or c not in ("src_port", "dst_port", "dst_port_class", "dst_port_class_num"))]
        if cfg.anonymize_ips:
            from ..functions.columns import hashed_ip

            out = out.withColumns({c: hashed_ip(F.col(c), cfg.anonymization_salt) for c in ("src_ip", "dst_ip")})
    keys = [c for c in out.columns if c.startswith("_")] if keep_keys else []
    return out.select(*keys, *project(shown, cfg))


def _graph(out: DataFrame, cfg: Config) -> DataFrame:
    n, size = ("total_packets", "total_bytes" if "total_bytes" in out.columns else "total_total_bytes")
    flows = out.withColumns(
        {
            "file_id": F.col("_file_id"),
            "src_node_ip": F.col("src_ip"),
            "src_node_port": F.col("src_port"),
            "dst_node_ip": F.col("dst_ip"),
            "dst_node_port": F.col("dst_port"),
            "packets": F.col(n),
            "bytes": F.col(size),
            "start_us": F.round(F.col("start_time") * 1e6).cast("long"),
            "end_us": F.round(F.col("end_time") * 1e6).cast("long"),
        }
    )
    joined = connection_features(flows, cfg, metrics=cfg.connection_include_graph_metrics)
    return joined.drop("file_id", "src_node_ip", "src_node_port", "dst_node_ip", "dst_node_port", "packets", "bytes", "start_us", "end_us")
